"""GeoPackage layers as a Python data source.

``spark.dataSource.register(GeoPackage)``, then
``spark.read.format("geopackage").option("path", file).option("layer", "tiles").load()``.
A layer is read in fid ranges, one task each; geometry comes as WKB with the
file's header removed. Files must be reachable from the executors by path.
"""

from __future__ import annotations

import os
import pickle
import sqlite3
import struct
import uuid
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

_KINDS = {"INTEGER": LongType(), "INT": LongType(), "MEDIUMINT": LongType(), "REAL": DoubleType(), "DOUBLE": DoubleType(), "FLOAT": DoubleType(), "BOOLEAN": BooleanType(), "BLOB": BinaryType()}
_ENVELOPE = (0, 32, 48, 48, 64)


def strip_header(blob: bytes | None) -> bytes | None:
    """WKB of a stored geometry."""
    if blob is None or blob[:2] != b"GP":
        return blob
    return blob[8 + _ENVELOPE[(blob[3] >> 1) & 7] :]


def add_header(wkb: bytes | None, srs: int = 4326) -> bytes | None:
    return None if wkb is None else b"GP" + bytes((0, 1)) + struct.pack("<i", srs) + bytes(wkb)


def wkb_bounds(wkb: bytes) -> tuple[float, float, float, float] | None:
    """(west, south, east, north) of a geometry, None if it is empty."""
    low, high, at = [float("inf")] * 2, [float("-inf")] * 2, 0

    def read(code: str) -> tuple:
        nonlocal at
        got = struct.unpack_from(code, wkb, at)
        at += struct.calcsize(code)
        return got

    def points(order: str, n: int, size: int) -> None:
        for _ in range(n):
            p = read(f"{order}{size}d")
            for k in (0, 1):
                if p[k] == p[k]:
                    low[k], high[k] = min(low[k], p[k]), max(high[k], p[k])

    def shape() -> None:
        order = "<" if read("B")[0] else ">"
        kind = read(f"{order}I")[0]
        size = 2 + bool(kind & 0x80000000) + bool(kind & 0x40000000)
        kind &= 0x0FFFFFFF
        size, kind = size + (0, 1, 1, 2)[kind // 1000 % 4], kind % 1000
        if kind == 1:
            points(order, 1, size)
        elif kind == 2:
            points(order, read(f"{order}I")[0], size)
        elif kind == 3:
            for _ in range(read(f"{order}I")[0]):
                points(order, read(f"{order}I")[0], size)
        elif kind in (4, 5, 6, 7):
            for _ in range(read(f"{order}I")[0]):
                shape()
        else:
            raise ValueError(f"geometry type {kind}")

    shape()
    return (*low, *high) if low[0] <= high[0] and low[1] <= high[1] else None


def layers(path: str) -> list[str]:
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        return [r[0] for r in db.execute("select table_name from gpkg_contents order by 1")]


class GeoPackage(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geopackage"

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)

    def schema(self) -> StructType:
        with self._open() as db:
            geometry = {r[0] for r in db.execute("select column_name from gpkg_geometry_columns where table_name=?", (self.options["layer"],))}
            rows = db.execute(f'pragma table_info("{self.options["layer"]}")').fetchall()
        return StructType([StructField(r[1], BinaryType() if r[1] in geometry else _KINDS.get(r[2].split("(")[0].upper(), StringType())) for r in rows])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, schema, overwrite)


# The reference systems that every GeoPackage holds.
_WGS84 = 'GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]]'
_SYSTEMS = (("Undefined cartesian", -1, "NONE", -1, "undefined"), ("Undefined geographic", 0, "NONE", 0, "undefined"), ("WGS 84", 4326, "EPSG", 4326, _WGS84))


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.layer, self.columns = options["path"], options["layer"], schema.fieldNames()
        self.step = int(options.get("rows", "100000"))
        self.binary = [f.name for f in schema if isinstance(f.dataType, BinaryType)]

    def partitions(self) -> list[InputPartition]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            low, high = db.execute(f'select min(fid), max(fid) from "{self.layer}"').fetchone()
        return [_Range(k, min(k + self.step - 1, high)) for k in range(low, high + 1, self.step)] if low is not None else []

    def read(self, partition: _Range) -> Iterator[tuple]:
        names = ", ".join(f'"{c}"' for c in self.columns)
        at = [self.columns.index(c) for c in self.binary]
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            for row in db.execute(f'select {names} from "{self.layer}" where fid between ? and ? order by fid', (partition.low, partition.high)):
                row = list(row)
                for k in at:
                    row[k] = strip_header(row[k])
                yield tuple(row)


# The tables that every GeoPackage has.
_TABLES = (
    "create table if not exists gpkg_spatial_ref_sys (srs_name text not null, srs_id integer not null primary key, organization text not null, organization_coordsys_id integer not null, definition text not null, description text)",
    "create table if not exists gpkg_contents (table_name text not null primary key, data_type text not null, identifier text unique, description text default '', "
    "last_change datetime not null default (strftime('%Y-%m-%dT%H:%M:%fZ','now')), min_x double, min_y double, max_x double, max_y double, srs_id integer, "
    "constraint fk_gc_r_srs_id foreign key (srs_id) references gpkg_spatial_ref_sys(srs_id))",
    "create table if not exists gpkg_geometry_columns (table_name text not null, column_name text not null, geometry_type_name text not null, srs_id integer not null, z tinyint not null, m tinyint not null, "
    "constraint pk_geom_cols primary key (table_name, column_name), constraint uk_gc_table_name unique (table_name), "
    "constraint fk_gc_tn foreign key (table_name) references gpkg_contents(table_name), constraint fk_gc_srs foreign key (srs_id) references gpkg_spatial_ref_sys (srs_id))",
)


class _Done(WriterCommitMessage):
    def __init__(self, part: str):
        self.part = part


class _Writer(DataSourceWriter):
    """Rows become visible in one transaction when all tasks are done. A
    GeoPackage is one SQLite file, which one process writes; tasks leave their
    rows in files beside it, and the driver takes them in one row at a time."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.layer, self.overwrite, self.schema = options["path"], options["layer"], overwrite, schema
        self.geometry = options.get("geometry", "geom")

    def write(self, rows: Iterator) -> WriterCommitMessage:
        part = f"{self.path}-{uuid.uuid4().hex}.part"
        with open(part, "wb") as f:
            for r in rows:
                pickle.dump(tuple(r), f)
        return _Done(part)

    def _rows(self, messages: list) -> Iterator[list]:
        for m in messages:
            if m is not None:
                with open(m.part, "rb") as f:
                    while f.peek(1):
                        yield list(pickle.load(f))

    def commit(self, messages: list) -> None:
        try:
            self._commit(messages)
        finally:
            self.abort(messages)

    def _commit(self, messages: list) -> None:
        kinds = {LongType: "INTEGER", DoubleType: "DOUBLE", BooleanType: "BOOLEAN", BinaryType: "BLOB"}
        fields = ", ".join(f'"{f.name}" ' + ("INTEGER PRIMARY KEY AUTOINCREMENT NOT NULL" if f.name == "fid" else "GEOMETRY" if f.name == self.geometry else kinds.get(type(f.dataType), "TEXT")) for f in self.schema)
        at = self.schema.fieldNames().index(self.geometry) if self.geometry in self.schema.fieldNames() else None
        with sqlite3.connect(self.path) as db:
            db.execute("pragma application_id = 1196444487")  # "GPKG"
            db.execute("pragma user_version = 10300")
            for table in _TABLES:
                db.execute(table)
            for row in _SYSTEMS:
                db.execute("insert or ignore into gpkg_spatial_ref_sys values (?,?,?,?,?,null)", row)
            if db.execute("select 1 from gpkg_contents where table_name=?", (self.layer,)).fetchone():
                if not self.overwrite:
                    raise ValueError(f"layer {self.layer} exists")
                for table in ("gpkg_geometry_columns", "gpkg_contents"):
                    db.execute(f"delete from {table} where table_name=?", (self.layer,))
                db.execute(f'drop table if exists "{self.layer}"')
            db.execute(f'create table "{self.layer}" ({fields})')
            db.execute("insert into gpkg_contents (table_name, data_type, identifier, srs_id) values (?,?,?,?)", (self.layer, "features" if at is not None else "attributes", self.layer, 4326 if at is not None else None))
            if at is not None:
                db.execute("insert into gpkg_geometry_columns values (?,?,'GEOMETRY',4326,0,0)", (self.layer, self.geometry))
            marks = ",".join("?" * len(self.schema))
            box = None
            for r in self._rows(messages):
                if at is not None and r[at] is not None:
                    one = wkb_bounds(bytes(r[at]))
                    if one is not None:
                        box = one if box is None else (min(box[0], one[0]), min(box[1], one[1]), max(box[2], one[2]), max(box[3], one[3]))
                    r[at] = add_header(r[at])
                if any(isinstance(v, float) and v != v for v in r):
                    raise ValueError("NaN can't be written")
                db.execute(f'insert into "{self.layer}" values ({marks})', r)
            if box is not None:
                db.execute("update gpkg_contents set min_x=?, min_y=?, max_x=?, max_y=? where table_name=?", (*box, self.layer))

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.part):
                os.remove(m.part)
