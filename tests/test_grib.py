"""GRIB files made here: the same fields in both editions, in several scan orders."""

import datetime as dt
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.sources import grib

T0 = dt.datetime(2026, 7, 14, 12)
FIELD = np.array([[8.0, 10, 12, 14], [10, 12, 14, 16], [12, 14, 16, 18.5]])  # south to north


def scanned(field, scan):
    g = field if scan & 0x40 else field[::-1]
    g = g[:, ::-1] if scan & 0x80 else g
    g = g.copy()
    if scan & 0x10 and scan & 0x20:
        g[:, 1::2] = g[::-1, 1::2]
    elif scan & 0x10:
        g[1::2] = g[1::2, ::-1]
    return (g.T if scan & 0x20 else g).ravel()


def packed(values, bits=12):
    ref, e = float(np.nanmin(values)), -4
    x = np.round((values[~np.isnan(values)] - ref) * 2.0**-e).astype(int)
    s = "".join(format(v, f"0{bits}b") for v in x)
    s += "0" * (-len(s) % 8)
    return ref, e, bits, int(s, 2).to_bytes(len(s) // 8, "big")


def signed(v, n):
    return (abs(v) | (1 << (8 * n - 1) if v < 0 else 0)).to_bytes(n, "big")


def edition2(field, number, hours, scan=0x00, level=10):
    nj, ni = field.shape
    v = scanned(field, scan)
    ref, e, bits, data = packed(v)
    la = (-1_000_000, 1_000_000) if scan & 0x40 else (1_000_000, -1_000_000)
    lo = (3_000_000, 0) if scan & 0x80 else (0, 3_000_000)
    sec = lambda k, body: struct.pack(">IB", len(body) + 5, k) + body
    s1 = sec(1, bytes(7) + struct.pack(">HBBBBB", T0.year, T0.month, T0.day, T0.hour, 0, 0) + bytes(2))
    s3 = sec(3, struct.pack(">BIBBH", 0, ni * nj, 0, 0, 0) + bytes(16) + struct.pack(">II", ni, nj) + bytes(8) + signed(la[0], 4) + signed(lo[0], 4) + b"\0" + signed(la[1], 4) + signed(lo[1], 4) + struct.pack(">II", 1_000_000, 1_000_000) + bytes([scan]))
    s4 = sec(4, struct.pack(">HHBB", 0, 0, 2, number) + bytes(6) + struct.pack(">BIBBI", 1, hours, 103, 0, level) + bytes(6))
    s5 = sec(5, struct.pack(">IHf", len(v), 0, ref) + signed(e, 2) + signed(0, 2) + bytes([bits, 0]))
    gaps = np.isnan(v).any()
    s6 = sec(6, b"\0" + np.packbits(~np.isnan(v)).tobytes() if gaps else b"\xff")
    body = s1 + s3 + s4 + s5 + s6 + sec(7, data) + b"7777"
    return b"GRIB\0\0\0\x02" + struct.pack(">Q", len(body) + 16) + body


def ibm(x):
    if x == 0:
        return bytes(4)
    s, x, k = (0x80 if x < 0 else 0), abs(x), 64
    while x >= 1:
        x, k = x / 16, k + 1
    while x < 1 / 16:
        x, k = x * 16, k - 1
    return bytes([s | k]) + round(x * (1 << 24)).to_bytes(3, "big")


def edition1(field, number, hours):
    nj, ni = field.shape
    v = scanned(field, 0x00)
    ref, e, bits, data = packed(v)
    pds = bytearray(28)
    pds[0:3], pds[7], pds[8], pds[9], pds[11] = (28).to_bytes(3, "big"), 0x80, number, 105, 10
    pds[12:17], pds[17], pds[18], pds[24] = bytes([26, 7, 14, 12, 0]), 1, hours, 21
    gds = bytearray(32)
    gds[0:3], gds[6:8], gds[8:10] = (32).to_bytes(3, "big"), ni.to_bytes(2, "big"), nj.to_bytes(2, "big")
    gds[10:13], gds[13:16], gds[17:20], gds[20:23] = signed(1000, 3), signed(0, 3), signed(-1000, 3), signed(3000, 3)
    bds = bytes([0]) + signed(e, 2) + ibm(ref) + bytes([bits]) + data
    bds = (len(bds) + 3).to_bytes(3, "big") + bds
    body = bytes(pds) + bytes(gds) + bds + b"7777"
    return b"GRIB" + (len(body) + 8).to_bytes(3, "big") + b"\x01" + body


def test_read(spark, tmp_path):
    holed = FIELD.copy()
    holed[1, 2] = np.nan
    (tmp_path / "a.grib").write_bytes(b"junk" + edition2(FIELD, 2, 0) + edition2(-FIELD, 3, 0, level=80) + edition2(-FIELD, 3, 0) + edition2(FIELD + 6, 2, 6, 0x40))
    (tmp_path / "b.grib").write_bytes(edition1(FIELD - 20, 34, 6) + edition2(holed, 2, 12))
    df = grib.read_wind(spark, str(tmp_path), 3).cache()
    got = {(r.component, r.valid_time): np.array(r.v).reshape(3, 4) for r in df.groupBy("component", "valid_time").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "i", "value"))), lambda x: x["value"]).alias("v")).collect()}
    h = lambda n: T0 + dt.timedelta(hours=n)
    assert set(got) == {("u", h(0)), ("v", h(0)), ("u", h(6)), ("v", h(6)), ("u", h(12))}
    np.testing.assert_allclose(got["u", h(0)], FIELD)
    np.testing.assert_allclose(got["v", h(0)], -FIELD)
    np.testing.assert_allclose(got["u", h(6)], FIELD + 6)
    np.testing.assert_allclose(got["v", h(6)], FIELD - 20, atol=1e-5)
    np.testing.assert_allclose(got["u", h(12)], holed)
    corner = df.where("j = 0 and i = 3 and component = 'u'").first()
    assert (round(corner.lat, 6), round(corner.lon, 6), corner.packing_error) == (-1.0, 3.0, 0.03125)
    assert grib.paired(df).where("valid_time < timestamp'2026-07-14 20:00:00' and (u is null or v is null)").count() == 0
    df.unpersist()


@pytest.mark.parametrize("scan", [0x00, 0x40, 0x80, 0xC0, 0x20, 0x60, 0x10, 0x50, 0x30, 0xB0])
def test_scan_orders(scan):
    g = grib.decode(edition2(FIELD, 2, 3, scan))
    np.testing.assert_allclose(g["values"], FIELD)
    assert (g["south"], g["west"], g["dlat"], g["dlon"]) == (-1.0, 0.0, 1.0, 1.0)


def test_faults():
    with pytest.raises(ValueError, match="no message"):
        grib.split_messages(b"nothing")
    with pytest.raises(ValueError, match="cut short"):
        grib.split_messages(edition2(FIELD, 2, 0)[:-3])
    with pytest.raises(ValueError, match="edition"):
        grib.split_messages(b"GRIB\0\0\0\x03" + bytes(20))
