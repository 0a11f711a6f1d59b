"""TIFF rasters as tables: a data source whose partitions are strips or tiles.

``geotiff_info`` reads a file's head: size, bands, bounds and the value that
stands for no data. The data source "geotiff" (``register(spark)``, then
``spark.read.format("geotiff").load(path)``) gives (band, px, py, value), one
row a pixel, row 0 in the south, null where there is no data. A task reads the
bytes of its own blocks only; ``blocks`` says how many a partition has. The
file has to be where pyarrow's file systems can open it on every executor:
a shared folder, hdfs://, s3://, gs://.

Classic TIFF and BigTIFF in either byte order, whole and floating numbers of 8
to 64 bits, bands together or apart, uncompressed, Deflate, LZW or PackBits,
with differences along rows. Anything else is an error by name.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from orbisframe.operators.terrain import Limits

# Tags and types of the format.
_WIDTH, _HEIGHT, _BITS, _PACKING, _STRIPS, _BANDS, _ROWS, _SIZES, _PLANES, _PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
_TILE_WIDTH, _TILE_HEIGHT, _TILES, _TILE_SIZES, _FORMAT, _SCALE, _TIEPOINT, _TRANSFORM, _NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34264, 42113
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
_NONE, _LZW, _DEFLATE, _OLD_DEFLATE, _PACKBITS = 1, 5, 8, 32946, 32773


@dataclass(frozen=True)
class Raster:
    """Head of a file; ``blocks``: (band or -1 for all, column, row, offset, bytes)."""

    width: int
    height: int
    bands: int
    dtype: str
    packing: int
    predictor: int
    block_width: int
    block_height: int
    blocks: tuple[tuple[int, int, int, int, int], ...]
    west: float
    south: float
    step_x: float
    step_y: float
    nodata: float | None

    def limits(self, low: float = -11000.0, high: float = 9000.0) -> Limits:
        """The raster's extent as a map's."""
        return Limits(low, high, self.west, self.south, self.width * self.step_x, self.height * self.step_y)


def _open(path: str):
    system, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(at)


def _tags(f) -> tuple[str, dict[int, tuple]]:
    """Byte order and tags of the first image."""
    head = f.read(16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    magic = struct.unpack(f"{order}H", head[2:4])[0] if order else 0
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    big = magic == 43
    at = struct.unpack(f"{order}{'Q' if big else 'I'}", head[8:16] if big else head[4:8])[0]
    count, entry, inline = ("Q", 20, 8) if big else ("H", 12, 4)
    f.seek(at)
    n = struct.unpack(order + count, f.read(struct.calcsize(count)))[0]
    table, out = f.read(n * entry), {}
    for k in range(n):
        tag, kind, size = struct.unpack(f"{order}HH{'Q' if big else 'I'}", table[k * entry : k * entry + entry - inline])
        if kind not in _TYPES:
            continue
        code = f"{order}{size}{_TYPES[kind]}"
        raw = table[k * entry + entry - inline : (k + 1) * entry]
        if struct.calcsize(code) > inline:
            f.seek(struct.unpack(f"{order}{'Q' if big else 'I'}", raw)[0])
            raw = f.read(struct.calcsize(code))
        out[tag] = struct.unpack(code, raw[: struct.calcsize(code)])
    return order, out


def geotiff_info(path: str) -> Raster:
    with _open(path) as f:
        order, tags = _tags(f)
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    width, height, bands = one(_WIDTH), one(_HEIGHT), one(_BANDS, 1)
    kind = {1: "u", 2: "i", 3: "f"}.get(one(_FORMAT, 1))
    bits = set(tags.get(_BITS, (1,)))
    if kind is None or len(bits) > 1 or not bits <= {8, 16, 32, 64} or (kind, *bits) == ("f", 8):
        raise ValueError(f"numbers of {sorted(bits)} bits and format {one(_FORMAT, 1)} aren't known")
    if one(_PACKING, 1) not in (_NONE, _LZW, _DEFLATE, _OLD_DEFLATE, _PACKBITS) or one(_PREDICTOR, 1) not in (1, 2) or (one(_PREDICTOR, 1) == 2 and kind == "f"):
        raise ValueError(f"compression {one(_PACKING, 1)} with predictor {one(_PREDICTOR, 1)} isn't known")
    tiled = _TILES in tags
    w, h = (one(_TILE_WIDTH), one(_TILE_HEIGHT)) if tiled else (width, min(one(_ROWS, height), height))
    across, down = -(-width // w), -(-height // h)
    apart = one(_PLANES, 1) == 2 and bands > 1
    places = list(zip(tags[_TILES if tiled else _STRIPS], tags[_TILE_SIZES if tiled else _SIZES], strict=True))
    blocks = tuple((k // (across * down) if apart else -1, k % across, k // across % down, *place) for k, place in enumerate(places))
    west, north, sx, sy = 0.0, float(height), 1.0, 1.0
    if _TRANSFORM in tags:
        t = tags[_TRANSFORM]
        west, north, sx, sy = t[3], t[7], t[0], -t[5]
    elif _SCALE in tags and _TIEPOINT in tags:
        (sx, sy, *_), (i, j, _, x, y, *_) = tags[_SCALE], tags[_TIEPOINT]
        west, north = x - i * sx, y + j * sy
    text = b"".join(tags.get(_NODATA, ())).split(b"\0")[0].decode().strip()
    return Raster(width, height, bands, f"{order}{kind}{bits.pop() // 8}", one(_PACKING, 1), one(_PREDICTOR, 1), w, h, blocks, west, north - height * sy, sx, sy, float(text) if text else None)


def unpack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            out += data[at + 1 : at + 2] * (257 - n) if n > 128 else b""
            at += 2 if n > 128 else 1
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest bit first; 256 clears, 257 ends."""
    out, table, size, held, bits, last = bytearray(), [], 9, 0, 0, None
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < size:
            continue
        bits -= size
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, size, last = [], 9, None
            continue
        if code < 256:
            now = bytes([code])
        else:
            now = table[code - 258] if code - 258 < len(table) else last + last[:1]
        if last is not None:
            table.append(last + now[:1])
        out += now
        last = now
        size = max(9, min(12, (len(table) + 259).bit_length()))
    return bytes(out)


def read_block(raster: Raster, data: bytes, block: tuple[int, int, int, int, int]) -> np.ndarray:
    """(bands of the block, rows, columns) of a block's bytes."""
    data = {_NONE: bytes, _LZW: unpack_lzw, _PACKBITS: unpack_bits}.get(raster.packing, zlib.decompress)(data)
    bands = 1 if block[0] >= 0 else raster.bands
    values = np.frombuffer(data, raster.dtype)
    row = raster.block_width * bands
    values = values[: len(values) // row * row].reshape(-1, raster.block_width, bands)
    if raster.predictor == 2:
        values = np.cumsum(values, axis=1, dtype=values.dtype.newbyteorder("="))
    # the last strip may have fewer rows, tiles may reach beyond the image
    values = values[: raster.height - block[2] * raster.block_height, : raster.width - block[1] * raster.block_width]
    return values.transpose(2, 0, 1)


@dataclass
class _Blocks(InputPartition):
    blocks: tuple[tuple[int, int, int, int, int], ...]


class _Reader(DataSourceReader):
    def __init__(self, path: str, bands: set[int] | None, per: int):
        self.path, self.wanted, self.per, self.raster = path, bands, per, geotiff_info(path)

    def partitions(self) -> list[_Blocks]:
        mine = [b for b in self.raster.blocks if b[4] and (self.wanted is None or b[0] < 0 or b[0] + 1 in self.wanted)]
        return [_Blocks(tuple(mine[k : k + self.per])) for k in range(0, len(mine), self.per)] or [_Blocks(())]

    def read(self, partition: _Blocks) -> Iterator[pa.RecordBatch]:
        r = self.raster
        with _open(self.path) as f:
            for block in partition.blocks:
                f.seek(block[3])
                values = read_block(r, f.read(block[4]), block)
                for k, plane in enumerate(values):
                    band = (block[0] if block[0] >= 0 else k) + 1
                    if self.wanted is not None and band not in self.wanted:
                        continue
                    value = plane.astype(np.float64)
                    none = np.isnan(value) if r.nodata is None else np.isnan(value) | (value == (np.float64(np.float32(r.nodata)) if r.dtype.endswith("f4") else r.nodata))
                    rows, columns = np.indices(plane.shape)
                    x, y = columns + block[1] * r.block_width, r.height - 1 - rows - block[2] * r.block_height
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(value.size, band, np.int32)), pa.array(x.ravel()), pa.array(y.ravel()), pa.array(value.ravel(), mask=none.ravel())], ["band", "px", "py", "value"]
                    )


class GeoTiffSource(DataSource):
    """Options: path, bands (such as "1,3"; all by default), blocks (to a
    partition, 1 by default)."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return "band int, px long, py long, value double"

    def reader(self, schema) -> _Reader:
        bands = self.options.get("bands")
        return _Reader(self.options["path"], {int(b) for b in bands.split(",")} if bands else None, int(self.options.get("blocks", "1")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GeoTiffSource)


def read_geotiff(spark: SparkSession, path: str, bands: list[int] | None = None, blocks: int = 1) -> tuple[DataFrame, Raster]:
    """(pixels, head) of a file."""
    register(spark)
    read = spark.read.format("geotiff").option("blocks", str(blocks))
    if bands:
        read = read.option("bands", ",".join(map(str, bands)))
    return read.load(path), geotiff_info(path)
