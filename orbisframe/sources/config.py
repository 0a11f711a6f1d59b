"""Configuration files: namers, culture sets, terrain recipes, height maps."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from orbisframe.functions.rand import uniform, whole


def read_word_lists(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(name, word) from files of one word a line, named by the file; a later
    file of the same name replaces an earlier one."""
    order = spark.createDataFrame([(k, os.path.splitext(os.path.basename(p))[0], p) for k, p in enumerate(paths)], "k int, name string, path string")
    if not paths:
        return spark.createDataFrame([], "name string, word string")
    last = order.groupBy("name").agg(F.max_by("path", "k").alias("path"))
    lines = [spark.read.text(r.path).select(F.lit(r.name).alias("name"), F.trim("value").alias("word")) for r in last.collect()]
    out = lines[0]
    for x in lines[1:]:
        out = out.unionByName(x)
    return out.where(F.length("word") > 0)


def read_cultures(spark: SparkSession, path: str) -> DataFrame:
    """(position, name, namer, probability, preferences as JSON): entries with
    a count stand for so many cultures."""
    raw = json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
    rows = []
    for x in raw:
        rows += [(x.get("name"), x.get("namer"), float(x.get("probability", 1)), json.dumps(x.get("preferences")))] * int(x.get("count", 1))
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "position int, name string, namer string, probability double, preferences string")


def read_recipes(spark: SparkSession, path: str) -> dict[str, list[dict]]:
    """Named task lists, or one list under the empty name."""
    raw = json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
    return {"": raw} if isinstance(raw, list) else dict(sorted(raw.items()))


def choose_recipe(recipes: dict[str, list[dict]], name: str | None = None, seed: int | str = 0) -> list[dict]:
    if name is not None:
        return recipes[name]
    names = sorted(recipes)
    return recipes[names[whole(0, len(names) - 1, seed, "recipe")]]


def read_ascii_grid(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, float]]:
    """An ESRI ASCII grid as (px, py, value), row 0 in the south, and its
    header. Lines are read as a table; no row order is assumed beyond the
    line number that the file's byte order gives."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("n", "line")).where(F.length(F.trim("line")) > 0)
    head = {r.k.lower(): float(r.v) for r in lines.where(F.col("line").rlike("^\\s*[A-Za-z]")).select(F.split(F.trim("line"), "\\s+")[0].alias("k"), F.split(F.trim("line"), "\\s+")[1].alias("v")).collect()}
    body = lines.where(~F.col("line").rlike("^\\s*[A-Za-z]")).select((F.col("n") - len(head)).alias("r"), F.posexplode(F.split(F.trim("line"), "\\s+")).alias("px", "v"))
    none = head.get("nodata_value")
    value = F.col("v").cast("double")
    return body.select("px", (F.lit(int(head["nrows"]) - 1) - F.col("r")).cast("int").alias("py"), F.when(value != none, value).otherwise(None).alias("value") if none is not None else value.alias("value")), head


def raster_bounds(head: dict[str, float]) -> tuple[float, float, float, float]:
    """(west, south, width, height) of a grid by its header; a header that
    names the middle of the first cell is half a cell off its corner."""
    cell = head["cellsize"]
    west = head["xllcorner"] if "xllcorner" in head else head["xllcenter"] - cell / 2
    south = head["yllcorner"] if "yllcorner" in head else head["yllcenter"] - cell / 2
    return west, south, head["ncols"] * cell, head["nrows"] * cell


def raster_min_max(raster: DataFrame) -> DataFrame:
    """One row: lowest and highest value."""
    return raster.agg(F.min("value").alias("low"), F.max("value").alias("high"))


def read_namers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(name, method, words, doubled, behaviors, suffix) of namers: JSON files
    hold lists of them, text files one word list each. Later files replace
    earlier ones of the same name; behaviours and suffix are JSON."""
    found: dict[str, tuple] = {}
    for path in paths:
        text = spark.read.text(path, wholetext=True).first()
        body = text[0] if text else ""
        if not path.endswith(".json"):
            name = os.path.splitext(os.path.basename(path))[0]
            found[name] = (name, "Markov", [w.strip() for w in body.split("\n") if w.strip()], [], "[]", '"Default"')
            continue
        for x in json.loads(body or "[]"):
            kind, method = next(iter(x["method"].items()))
            words = method["seed_words"] if kind == "Markov" else method
            doubled = sorted(method.get("duplicatable_letters") or "") if kind == "Markov" else []
            found[x["name"]] = (x["name"], kind, words, doubled, json.dumps(x.get("state_name") or []), json.dumps(x.get("state_suffix") or "Default"))
    return spark.createDataFrame(list(found.values()), "name string, method string, words array<string>, doubled array<string>, behaviors string, suffix string")


def namer_json(namers: DataFrame) -> str:
    """Namers, a configuration's table, as the JSON that ``read_namers`` reads."""
    out = []
    for r in namers.orderBy("name").collect():
        method = {"Markov": {"duplicatable_letters": "".join(r.doubled), "seed_words": list(r.words)}} if r.method == "Markov" else {r.method: list(r.words)}
        out.append({"name": r.name, "method": method, "state_name": json.loads(r.behaviors), "state_suffix": json.loads(r.suffix)})
    return json.dumps(out, ensure_ascii=False, indent=1)


def culture_json(cultures: DataFrame) -> str:
    """Culture sets as the JSON that ``read_cultures`` reads."""
    rows = cultures.orderBy("position").collect()
    return json.dumps([{"name": r.name, "namer": r.namer, "probability": r.probability, "preferences": json.loads(r.preferences)} for r in rows], ensure_ascii=False, indent=1)


def task_json(task: dict) -> str:
    """One terrain task as JSON, its name first."""
    return json.dumps({"task": task["task"], **{k: v for k, v in task.items() if k != "task"}})


def write_layer(rows: DataFrame, folder: str, name: str, overwrite: bool = False) -> DataFrame:
    """A layer as a Parquet table of a world's folder, read back: points and
    triangles too. An existing one is an error without ``overwrite``."""
    path = os.path.join(folder, name)
    rows.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def weighted_sets(cultures: DataFrame, count: int, stream: str = "") -> DataFrame:
    """Choose ``count`` entries without replacement, likelier ones first: the
    largest keyed draws to the power of 1 / probability."""
    key = F.pow(uniform(f"{stream}culture_set", "position"), 1 / F.greatest(F.col("probability"), F.lit(1e-9)))
    return cultures.withColumn("_k", F.row_number().over(Window.orderBy(F.desc(key), "position"))).where(F.col("_k") <= count).drop("_k")
