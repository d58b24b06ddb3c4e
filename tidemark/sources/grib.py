"""Wind at 10 m from GRIB files (editions 1 and 2, regular latitude/longitude grids, simple packing).

Files are split into messages, messages are spread over tasks, and each message is
unpacked with numpy into one row for each grid cell.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, message int, component string, init_time timestamp, valid_time timestamp, j int, i int, lat double, lon double, value double, packing_error double"


def split_messages(data: bytes) -> list[tuple[int, bytes]]:
    """(number, bytes) of each message of a file; bytes between messages are passed over."""
    out, at = [], data.find(b"GRIB")
    while at >= 0:
        edition = data[at + 7]
        if edition == 1:
            size = int.from_bytes(data[at + 4 : at + 7], "big")
        elif edition == 2:
            size = int.from_bytes(data[at + 8 : at + 16], "big")
        else:
            raise ValueError(f"edition {edition} is not supported")
        message = data[at : at + size]
        if len(message) < size or message[-4:] != b"7777":
            raise ValueError("a message is cut short")
        out.append((len(out), message))
        at = data.find(b"GRIB", at + size)
    if not out:
        raise ValueError("no message found")
    return out


def _uint(b: bytes, at: int, n: int) -> int:
    """Unsigned number at octet `at`, counted from 1."""
    return int.from_bytes(b[at - 1 : at - 1 + n], "big")


def _sint(b: bytes, at: int, n: int) -> int:
    """Number whose first bit is its sign."""
    v, top = _uint(b, at, n), 1 << (8 * n - 1)
    return -(v & (top - 1)) if v & top else v


def _ibm_float(b: bytes) -> float:
    v = int.from_bytes(b, "big")
    return (-1 if v >> 31 else 1) * (v & 0xFFFFFF) / (1 << 24) * 16.0 ** ((v >> 24 & 0x7F) - 64)


def _hours(unit: int, n: int) -> dt.timedelta:
    seconds = {0: 60, 1: 3600, 2: 86400, 10: 3 * 3600, 11: 6 * 3600, 12: 12 * 3600, 13: 1}.get(unit)
    if seconds is None:
        raise ValueError(f"time unit {unit} is not supported")
    return dt.timedelta(seconds=seconds * n)


def _unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits == 0:
        return np.zeros(n)
    raw = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    return raw @ (2.0 ** np.arange(bits - 1, -1, -1))


def _arrange(values: np.ndarray, ni: int, nj: int, scan: int) -> np.ndarray:
    """Rows from south to north, columns from west to east."""
    g = values.reshape(ni, nj).T.copy() if scan & 0x20 else values.reshape(nj, ni).copy()
    if scan & 0x10:
        if scan & 0x20:
            g[:, 1::2] = g[::-1, 1::2]
        else:
            g[1::2] = g[1::2, ::-1]
    g = g[:, ::-1] if scan & 0x80 else g
    return g if scan & 0x40 else g[::-1]


def decode(message: bytes) -> dict | None:
    """component, times, south, west, steps, values and packing error of a wind message; None for any other."""
    return (_decode1 if message[7] == 1 else _decode2)(message)


def _filled(packed: np.ndarray, present: np.ndarray | None, n: int) -> np.ndarray:
    if present is None:
        return packed
    out = np.full(n, np.nan)
    out[present] = packed
    return out


def _decode2(m: bytes) -> dict | None:
    sections, at = {}, 16
    while m[at : at + 4] != b"7777":
        size, number = int.from_bytes(m[at : at + 4], "big"), m[at + 4]
        sections[number] = m[at : at + size]
        at += size
    s1, s3, s4, s5, s6, s7 = (sections[k] for k in (1, 3, 4, 5, 6, 7))
    level = (s4[22], _sint(s4, 25, 4) / 10.0 ** _sint(s4, 24, 1))
    if m[6] != 0 or s4[9] != 2 or s4[10] not in (2, 3) or level != (103, 10.0):
        return None
    if _uint(s3, 13, 2) != 0 or _uint(s5, 10, 2) != 0:
        raise ValueError("only regular latitude/longitude grids with simple packing are supported")
    init = dt.datetime(_uint(s1, 13, 2), s1[14], s1[15], s1[16], s1[17], s1[18])
    ni, nj, scan = _uint(s3, 31, 4), _uint(s3, 35, 4), s3[71]
    la1, lo1, la2, lo2 = (_sint(s3, o, 4) / 1e6 for o in (47, 51, 56, 60))
    ref, e, d, bits = float(np.frombuffer(s5[11:15], ">f4")[0]), _sint(s5, 16, 2), _sint(s5, 18, 2), s5[19]
    present = None
    if s6[5] == 0:
        present = np.unpackbits(np.frombuffer(s6[6:], np.uint8), count=ni * nj).astype(bool)
    elif s6[5] != 255:
        raise ValueError("a predefined bitmap is not supported")
    n = ni * nj if present is None else int(present.sum())
    values = _filled((ref + _unpack(s7[5:], n, bits) * 2.0**e) / 10.0**d, present, ni * nj)
    return _grid("u" if s4[10] == 2 else "v", init, init + _hours(s4[17], _uint(s4, 19, 4)), ni, nj, scan, (la1, lo1, la2, lo2), values, 0.5 * 2.0**e / 10.0**d)


def _decode1(m: bytes) -> dict | None:
    pds = m[8 : 8 + int.from_bytes(m[8:11], "big")]
    wanted = {33: "u", 34: "v", 165: "u", 166: "v"}.get(pds[8])
    if wanted is None or pds[8] < 100 and (pds[9], _uint(pds, 11, 2)) != (105, 10):
        return None
    if not pds[7] & 0x80:
        raise ValueError("a message without its grid is not supported")
    at = 8 + len(pds)
    gds = m[at : at + int.from_bytes(m[at : at + 3], "big")]
    at += len(gds)
    if gds[5] != 0:
        raise ValueError("only regular latitude/longitude grids are supported")
    ni, nj, scan = _uint(gds, 7, 2), _uint(gds, 9, 2), gds[27]
    place = tuple(_sint(gds, o, 3) / 1e3 for o in (11, 14, 18, 21))
    present = None
    if pds[7] & 0x40:
        bms = m[at : at + int.from_bytes(m[at : at + 3], "big")]
        at += len(bms)
        present = np.unpackbits(np.frombuffer(bms[6:], np.uint8), count=ni * nj).astype(bool)
    bds = m[at : at + int.from_bytes(m[at : at + 3], "big")]
    if bds[3] & 0xF0:
        raise ValueError("only simple packing is supported")
    e, d, bits = _sint(bds, 5, 2), _sint(pds, 27, 2), bds[10]
    n = ni * nj if present is None else int(present.sum())
    values = _filled((_ibm_float(bds[6:10]) + _unpack(bds[11:], n, bits) * 2.0**e) / 10.0**d, present, ni * nj)
    init = dt.datetime((pds[24] - 1) * 100 + pds[12], pds[13], pds[14], pds[15], pds[16])
    ahead = _uint(pds, 19, 2) if pds[20] == 10 else pds[18]
    return _grid(wanted, init, init + _hours(pds[17], ahead), ni, nj, scan, place, values, 0.5 * 2.0**e / 10.0**d)


def _grid(component, init, valid, ni, nj, scan, place, values, error) -> dict:
    la1, lo1, la2, lo2 = place
    if ni < 2 or nj < 2:
        raise ValueError("a grid needs two rows and columns")
    south, north = min(la1, la2), max(la1, la2)
    west, east = (lo2, lo1) if scan & 0x80 else (lo1, lo2)
    return {"component": component, "init_time": init, "valid_time": valid, "south": south, "west": west, "dlat": (north - south) / (nj - 1), "dlon": ((east - west) % 360.0 or 360.0) / (ni - 1), "values": _arrange(values, ni, nj, scan), "error": error}


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, number, data in zip(b.column("path").to_pylist(), b.column("message").to_pylist(), b.column("data").to_pylist(), strict=True):
            g = decode(data)
            if g is None:
                continue
            nj, ni = g["values"].shape
            n, j, i = nj * ni, np.repeat(np.arange(nj, dtype=np.int32), ni), np.tile(np.arange(ni, dtype=np.int32), nj)
            same = lambda v, t: pa.array([v] * n, t)  # noqa: B023, E731
            stamp = pa.timestamp("us", "UTC")
            when = [g[k].replace(tzinfo=dt.UTC) for k in ("init_time", "valid_time")]
            yield pa.RecordBatch.from_arrays(
                [same(path, pa.string()), same(number, pa.int32()), same(g["component"], pa.string()), same(when[0], stamp), same(when[1], stamp), pa.array(j), pa.array(i), pa.array(g["south"] + j * g["dlat"]), pa.array(g["west"] + i * g["dlon"]), pa.array(g["values"].ravel()), same(g["error"], pa.float64())],
                names=[x.split()[0] for x in SCHEMA.split(", ")],
            )


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
            for number, message in split_messages(data):
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([number], pa.int32()), pa.array([message], pa.binary())], names=["path", "message", "data"])


def read_wind(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """One row for each cell of each wind message of the files under `path`; missing cells are NaN.

    A file is split by the task that reads it (so it must fit there); its messages are then dealt to all tasks.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    messages = files.mapInArrow(_split, "path string, message int, data binary")
    messages = messages.repartition(partitions, "path", "message") if partitions else messages.repartition("path", "message")
    return messages.mapInArrow(_rows, SCHEMA)


def paired(cells: DataFrame) -> DataFrame:
    """(valid_time, j, i, u, v) of cells that read_wind gave; a component that a cell lacks is null."""
    value = lambda c: F.max(F.when(F.col("component") == c, F.col("value")))
    return cells.groupBy("valid_time", "j", "i").agg(value("u").alias("u"), value("v").alias("v"))
