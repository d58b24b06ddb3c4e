"""SQL fragments (DuckDB) of the column functions, for the counterparts of the queries."""

from __future__ import annotations

R = "3440.065e0"


def lat(k: str) -> str:
    return f"((({k}) * 37) % 1600) / 10e0 - 80"


def lon(k: str) -> str:
    return f"((({k}) * 91) % 3600) / 10e0 - 180"


def norm(x: str) -> str:
    return f"(((({x}) % 360e0) + 360e0) % 360e0)"


def diff(a: str, b: str) -> str:
    d = f"(abs(({a}) - ({b})) % 360e0)"
    return f"least({d}, 360e0 - {d})"


def dist(a: str, b: str, p: str, q: str) -> str:
    return f"(2 * {R} * asin(least(1e0, sqrt(power(sin((radians({p}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({p})) * power(sin(radians(({q}) - ({b})) / 2), 2)))))"


def bearing(a: str, b: str, p: str, q: str) -> str:
    dl = f"radians(({q}) - ({b}))"
    return norm(f"degrees(atan2(sin({dl}) * cos(radians({p})), cos(radians({a})) * sin(radians({p})) - sin(radians({a})) * cos(radians({p})) * cos({dl})))")


def wrap(x: str) -> str:
    return f"({norm(f'({x}) + 180e0')} - 180e0)"


def to_lat(a: str, h: str, nm: str) -> str:
    return f"degrees(asin(sin(radians({a})) * cos(({nm}) / {R}) + cos(radians({a})) * sin(({nm}) / {R}) * cos(radians({h}))))"


def to_lon(a: str, b: str, h: str, nm: str) -> str:
    s = f"(sin(radians({a})) * cos(({nm}) / {R}) + cos(radians({a})) * sin(({nm}) / {R}) * cos(radians({h})))"
    return wrap(f"degrees(radians({b}) + atan2(sin(radians({h})) * sin(({nm}) / {R}) * cos(radians({a})), cos(({nm}) / {R}) - sin(radians({a})) * {s}))")


def speed(u: str, v: str) -> str:
    return f"(sqrt(({u}) * ({u}) + ({v}) * ({v})) * 1.9438444924406048e0)"


def wind_from(u: str, v: str) -> str:
    return f"(CASE WHEN ({u}) = 0 AND ({v}) = 0 THEN 0e0 ELSE {norm(f'degrees(atan2(-({u}), -({v})))')} END)"


def side(h: str, w: str) -> str:
    d = norm(f"({h}) - ({w})")
    return f"(CASE WHEN {d} = 0 OR {d} = 180 THEN 0 WHEN {d} < 180 THEN 1 ELSE -1 END)"


def r(x: str, name: str, digits: int = 6) -> str:
    """Rounded, with negative zero made zero."""
    return f"round({x}, {digits}) + 0e0 AS {name}"


#: The built-in boat speed table as rows.
def polar_rows() -> str:
    from tidemark.functions.polar import TABLE, TWS

    return "(VALUES " + ", ".join(f"({a}e0, {w}e0, {v}e0)" for a, row in TABLE.items() for w, v in zip(TWS, row, strict=True)) + ") AS polar(twa, tws, speed)"
