"""Worlds on storage as versions: tables that are never changed, and manifests
that name a version's tables.

A folder holds ``layers/<table>-<id>`` and ``versions/<number>``. A commit
writes new tables beside the old ones and then one manifest, whose number no
other may have, so of two writers on one version one fails. A version is there
when its manifest is complete; until then, and whatever fails before, readers
see the last one; a manifest that was cut off holds its number until ``vacuum``
takes it away. Going back is a new version with an old one's tables.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_END = "end"


class ConflictError(RuntimeError):
    """Somebody else has made the next version."""


def _fs(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path, path(folder).getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str, part: str) -> list[str]:
    path, fs = _fs(spark, folder)
    at = path(f"{folder}/{part}")
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def _manifest(spark: SparkSession, folder: str, version: int) -> dict[str, str] | None:
    """Tables of a version by name, or None if it isn't complete."""
    path, fs = _fs(spark, folder)
    at = path(f"{folder}/versions/{version:09d}")
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        reader = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(stream, "UTF-8"))
        lines = []
        while (line := reader.readLine()) is not None:
            lines.append(line)
    finally:
        stream.close()
    return json.loads(lines[0]) if lines[1:] == [_END] else None


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the complete versions, ascending."""
    return [int(n) for n in _names(spark, folder, "versions") if n.isdigit() and _manifest(spark, folder, int(n)) is not None]


def _put(spark: SparkSession, folder: str, version: int, tables: dict[str, str]) -> None:
    path, fs = _fs(spark, folder)
    at = path(f"{folder}/versions/{version:09d}")
    try:
        out = fs.create(at, False)
    except Exception as e:
        raise ConflictError(f"version {version} of {folder} exists") from e
    try:
        out.write(bytearray(f"{json.dumps(tables)}\n{_END}\n".encode()))
    finally:
        out.close()


def commit(spark: SparkSession, folder: str, tables: dict[str, DataFrame], kept: dict[str, str] | None = None, base: int | None = None, write: Callable[[DataFrame, str], None] | None = None) -> tuple[int, dict[str, str]]:
    """(version, places): a new version of ``tables`` on top of ``base`` (the
    last one if it isn't given, nothing if that is 0). ``kept`` names tables
    that the folder has already, by their places."""
    last = max(versions(spark, folder), default=0) if base is None else base
    places = dict(kept or {})
    for name, rows in tables.items():
        if name not in places:
            place = f"layers/{name}-{uuid.uuid4().hex}"
            (write or (lambda rows, at: rows.write.parquet(at)))(rows, f"{folder}/{place}")
            places[name] = place
    _put(spark, folder, last + 1, {name: places[name] for name in tables})
    return last + 1, places


def read(spark: SparkSession, folder: str, version: int | None = None) -> tuple[int, dict[str, str], dict[str, DataFrame]]:
    """(version, places, tables) of a version, the last one by default."""
    have = versions(spark, folder)
    if not have or version is not None and version not in have:
        raise FileNotFoundError(f"{folder}: version {version or 'any'}")
    version = have[-1] if version is None else version
    places = _manifest(spark, folder, version)
    return version, places, {name: spark.read.parquet(f"{folder}/{place}") for name, place in places.items()}


def rollback(spark: SparkSession, folder: str, version: int) -> int:
    """A new version with the tables of an old one."""
    _, places, _ = read(spark, folder, version)
    last = versions(spark, folder)[-1]
    _put(spark, folder, last + 1, places)
    return last + 1


def vacuum(spark: SparkSession, folder: str, keep: int = 1) -> list[str]:
    """Delete the manifests before the last ``keep`` and the tables that only
    they name; places of the tables that went. Not beside a running commit,
    whose tables no manifest names yet."""
    path, fs = _fs(spark, folder)
    have = versions(spark, folder)
    alive = have[-keep:]
    named = {place for v in alive for place in _manifest(spark, folder, v).values()}
    for n in _names(spark, folder, "versions"):
        if not n.isdigit() or int(n) not in alive:
            fs.delete(path(f"{folder}/versions/{n}"), False)
    gone = [f"layers/{n}" for n in _names(spark, folder, "layers") if f"layers/{n}" not in named]
    for place in gone:
        fs.delete(path(f"{folder}/{place}"), True)
    return gone
