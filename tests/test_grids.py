"""Nested grids and the NTv2 format."""

import struct

import numpy as np
import pytest

from silvaquery.sources import grids as gr


def ntv2(subs, order="<"):
    """A file of sub-grids (name, parent, south, north, east, west, step), all in degrees to the east; shifts are linear in the place."""
    rec = lambda key, value: key.ljust(8).encode() + value
    num, real, text = lambda v: struct.pack(f"{order}i4x", v), lambda v: struct.pack(f"{order}d", v), lambda v: v.ljust(8).encode()
    out = b"".join(rec(k, v) for k, v in (("NUM_OREC", num(11)), ("NUM_SREC", num(11)), ("NUM_FILE", num(len(subs))), ("GS_TYPE", text("SECONDS")), ("VERSION", text("1")), ("SYSTEM_F", text("A")), ("SYSTEM_T", text("B")), ("MAJOR_F", real(1)), ("MINOR_F", real(1)), ("MAJOR_T", real(1)), ("MINOR_T", real(1))))
    for k, (name, parent, south, north, west, east, step) in enumerate(subs):
        lat, lon = np.arange(south, north + step / 2, step), np.arange(west, east + step / 2, step)
        out += b"".join(rec(a, b) for a, b in (("SUB_NAME", text(name)), ("PARENT", text(parent)), ("CREATED", text("")), ("UPDATED", text("")), ("S_LAT", real(south * 3600)), ("N_LAT", real(north * 3600)), ("E_LONG", real(-east * 3600)), ("W_LONG", real(-west * 3600)), ("LAT_INC", real(step * 3600)), ("LONG_INC", real(step * 3600)), ("GS_COUNT", num(len(lat) * len(lon)))))
        for y in lat:
            for x in lon[::-1]:
                out += struct.pack(f"{order}4f", *shift(k, x, y), 0.0, 0.0)
    return out


def shift(k, x, y):
    """(north, west) in seconds of the k-th sub-grid."""
    return 0.5 + k + 0.1 * (x - 20) + 0.2 * (y - 60), -(0.3 + k + 0.05 * (x - 20))


SUBS = [("WIDE", "NONE", 60.0, 64.0, 20.0, 26.0, 1.0), ("FINE", "WIDE", 61.0, 63.0, 22.0, 24.0, 0.25), ("FINEST", "FINE", 61.5, 62.0, 22.5, 23.0, 0.125)]


@pytest.mark.parametrize("order", ["<", ">"])
def test_the_finest_sub_grid_counts(spark, order):
    rng = np.random.default_rng(1)
    p = np.column_stack([rng.random(400) * 8 + 19, rng.random(400) * 6 + 59]).tolist() + [[26.0, 64.0], [20.0, 60.0], [24.0, 63.0], [22.5, 61.5]]
    df = spark.createDataFrame([(n, *map(float, v)) for n, v in enumerate(p)], "id int, x double, y double")
    got = {r.id: r for r in gr.shifted(spark, df, ntv2(SUBS, order)).collect()}
    seen = set()
    for n, (x, y) in enumerate(p):
        k = max((k for k, (_, _, s, t, w, e, _) in enumerate(SUBS) if s <= y <= t and w <= x <= e), default=None)
        seen.add(k)
        assert got[n].moved == (k is not None)
        north, west = shift(k, x, y) if k is not None else (0.0, 0.0)
        assert got[n].x == pytest.approx(x - west / 3600, abs=1e-9) and got[n].y == pytest.approx(y + north / 3600, abs=1e-9)
    assert seen == {None, 0, 1, 2}


def test_broken_files_are_refused():
    with pytest.raises(ValueError, match="not an NTv2"):
        gr.read_ntv2(b"\0" * 400)
    whole = ntv2(SUBS[:1])
    wrong = whole.replace(struct.pack("<i4x", 35), struct.pack("<i4x", 34))
    with pytest.raises(ValueError, match="34 nodes"):
        gr.read_ntv2(wrong)
