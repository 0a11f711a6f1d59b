"""TIFF files of many layouts, written here by hand, read back as tables."""

import struct
import zlib

import numpy as np
import pytest

from orbisframe.sources import geotiff
from orbisframe.world import Source, WorldMap


def _pack_lzw(data):
    """Codes of nine bits only, with a clear before they'd get longer."""
    bits = "".join(f"{c:09b}" for k in range(0, len(data), 200) for c in (256, *data[k : k + 200])) + f"{257:09b}"
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8))


def _pack_bits(data):
    out = b""
    for k in range(0, len(data), 100):
        part = data[k : k + 100]
        out += bytes([len(part) - 1]) + part
    return out + b"\x80"


PACK = {1: bytes, 5: _pack_lzw, 8: zlib.compress, 32773: _pack_bits}


def write_tiff(path, a, order="<", big=False, tile=None, rows=None, packing=1, apart=False, predictor=1, nodata=None, west=-180.0, north=90.0, step=1.0):
    """``a``: (bands, rows, columns)."""
    bands, height, width = a.shape
    w, h = tile or (width, rows or height)
    blocks = []
    for plane in ([a[k : k + 1] for k in range(bands)] if apart else [a]):
        for y in range(0, height, h):
            for x in range(0, width, w):
                part = plane[:, y : y + h, x : x + w]
                if tile:
                    part = np.pad(part, ((0, 0), (0, h - part.shape[1]), (0, w - part.shape[2])))
                part = part.transpose(1, 2, 0)
                if predictor == 2:
                    part = np.diff(part, axis=1, prepend=np.zeros_like(part[:, :1]))
                blocks.append(PACK[packing](part.astype(a.dtype.newbyteorder(order)).tobytes()))
    kind = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
    offset, size = ("Q", 16) if big else ("I", 4)
    at, places = 16, []
    for b in blocks:
        places.append(at)
        at += len(b)
    tags = [(256, "I", [width]), (257, "I", [height]), (258, "H", [a.dtype.itemsize * 8] * bands), (259, "H", [packing]), (277, "H", [bands]), (284, "H", [2 if apart else 1]), (317, "H", [predictor]), (339, "H", [kind] * bands)]
    tags += [(322, "I", [w]), (323, "I", [h]), (324, offset, places), (325, offset, [len(b) for b in blocks])] if tile else [(273, offset, places), (278, "I", [h]), (279, offset, [len(b) for b in blocks])]
    tags += [(33550, "d", [step, step, 0.0]), (33922, "d", [0.0, 0.0, 0.0, west, north, 0.0])]
    if nodata is not None:
        tags.append((42113, "s", [f"{nodata}\0".encode()]))
    tags.sort()
    codes = {"H": 3, "I": 4, "d": 12, "Q": 16, "s": 2}
    inline, entry = (8, 20) if big else (4, 12)
    after = at + (8 if big else 2) + len(tags) * entry + (8 if big else 4)
    table, tail = b"", b""
    for tag, code, values in tags:
        raw = values[0] if code == "s" else struct.pack(f"{order}{len(values)}{code}", *values)
        n = len(raw) if code == "s" else len(values)
        if len(raw) > inline:
            place = struct.pack(order + offset, after + len(tail))
            tail += raw
            raw = place
        table += struct.pack(f"{order}HH{offset}", tag, codes[code], n) + raw.ljust(inline, b"\0")
    mark = b"II" if order == "<" else b"MM"
    head = mark + (struct.pack(f"{order}HHHQ", 43, 8, 0, at) if big else struct.pack(f"{order}HI", 42, at).ljust(14, b"\0"))
    path.write_bytes(head + b"".join(blocks) + struct.pack(order + ("Q" if big else "H"), len(tags)) + table + b"\0" * (8 if big else 4) + tail)
    return str(path)


LAYOUTS = [
    ("u1", {}), ("i2", {"order": ">", "rows": 3}), ("f4", {"tile": (16, 16), "packing": 8, "apart": True}), ("f8", {"big": True, "rows": 4}),
    ("u2", {"packing": 8, "predictor": 2, "rows": 5}), ("i4", {"order": ">", "big": True, "tile": (16, 32), "packing": 5}), ("u1", {"packing": 32773, "rows": 2, "apart": True}),
]


@pytest.mark.parametrize(("dtype", "layout"), LAYOUTS)
def test_layouts_round_trip(spark, tmp_path, dtype, layout):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 120, (3, 21, 37)).astype(dtype)
    path = write_tiff(tmp_path / "a.tif", a, nodata=7, west=-10.0, north=30.0, step=0.5, **layout)
    rows, head = geotiff.read_geotiff(spark, path)
    assert (head.width, head.height, head.bands, head.nodata) == (37, 21, 3, 7.0)
    assert (head.west, head.south, head.limits().width, head.limits().height) == (-10.0, 19.5, 18.5, 10.5)
    assert rows.rdd.getNumPartitions() == len(head.blocks)
    got = rows.toPandas()
    assert len(got) == a.size
    back = np.full(a.shape, -1.0)
    back[got["band"] - 1, 20 - got["py"], got["px"]] = got["value"].fillna(7)
    assert (back == a).all() and (got["value"].isna().sum() == (a == 7).sum())
    second, _ = geotiff.read_geotiff(spark, path, bands=[2], blocks=3)
    assert {r.band for r in second.select("band").distinct().collect()} == {2} and second.count() == 21 * 37


def test_what_isnt_known_is_an_error(tmp_path):
    (tmp_path / "x.tif").write_bytes(b"no raster at all, sorry")
    with pytest.raises(ValueError, match="not a TIFF"):
        geotiff.geotiff_info(str(tmp_path / "x.tif"))
    path = write_tiff(tmp_path / "p.tif", np.ones((1, 2, 2), "u1"))
    data = bytearray((tmp_path / "p.tif").read_bytes())
    at = data.index(struct.pack("<HHI", 259, 3, 1))
    data[at + 8] = 7
    (tmp_path / "p.tif").write_bytes(bytes(data))
    with pytest.raises(ValueError, match="compression 7"):
        geotiff.geotiff_info(path)


def test_world_of_a_raster(spark, tmp_path):
    """The map has the raster's extent and its heights' limits."""
    y, x = np.mgrid[0:20, 0:40]
    path = write_tiff(tmp_path / "h.tif", (100.0 * x - 50.0 * y).astype("f4")[None], rows=4, west=5.0, north=50.0, step=0.25)
    source = Source.from_raster(spark, path, n_tiles=60)
    assert (source.limits.west, source.limits.south, source.limits.width, source.limits.height) == (5.0, 45.0, 10.0, 5.0)
    assert (source.limits.low, source.limits.high) == (-950.0, 3900.0)
    w = WorldMap(spark, source).create()
    for r in w.tiles.select("site_x", "site_y", "elevation").collect():
        assert r.elevation == 100.0 * int((r.site_x - 5) / 0.25) - 50.0 * (19 - int((r.site_y - 45) / 0.25))
