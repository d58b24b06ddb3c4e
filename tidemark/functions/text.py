"""UTC times, durations, positions and numbers as text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_utc(x: Column | str) -> Column:
    """Timestamp of the exact form YYYY-MM-DDTHH:MM:SSZ, null for anything else."""
    x = F.col(x) if isinstance(x, str) else x
    ok = x.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$")
    return F.when(ok, F.try_to_timestamp(x, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")))


def format_utc(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_duration(text: str) -> int:
    """Seconds of a duration such as 90m, 2h, 1h30m or 45s; a bare number is minutes."""
    if re.fullmatch(r"\d+", text):
        return int(text) * 60
    m = re.fullmatch(r"(?:(\d+)h)?(?:(\d+)m)?(?:(\d+)s)?", text)
    if not m or not any(m.groups()):
        raise ValueError(f"not a duration: {text!r}")
    h, mi, s = (int(g or 0) for g in m.groups())
    return h * 3600 + mi * 60 + s


def parse_intervals(text: str) -> list[tuple[int, int | None]]:
    """Tiers (interval, until) of a schedule such as 20m@1h,40m; only the last tier has no end."""
    parts = [p.split("@") for p in text.split(",")]
    tiers = [(parse_duration(p[0]), parse_duration(p[1]) if len(p) > 1 else None) for p in parts]
    ends = [u for _, u in tiers]
    if None in ends[:-1] or ends[-1] is not None or any(i <= 0 for i, _ in tiers) or sorted(set(ends[:-1])) != ends[:-1]:
        raise ValueError(f"not a schedule: {text!r}")
    return tiers


def parse_position(text: str) -> tuple[float, float]:
    lat, lon = (float(x) for x in text.split(","))
    if not (-90 <= lat <= 90 and -180 <= lon <= 180):
        raise ValueError(f"not a position: {text!r}")
    return lat, lon


def number_text(x: float) -> str:
    """17 significant digits in general form."""
    return f"{x:.17g}"


def coordinate_text(x: float) -> str:
    """Ten decimals without trailing zeros."""
    return f"{x:.10f}".rstrip("0").rstrip(".")


def fnv1a64(data: bytes) -> str:
    """64-bit FNV-1a as 16 hex digits."""
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & (1 << 64) - 1
    return f"{h:016x}"
