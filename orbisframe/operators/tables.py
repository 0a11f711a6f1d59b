"""Layer tables: typed scans, lookups, inserts, updates, key-value properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_rows(rows: DataFrame, order: list[str], name: str = "fid", start: int = 1) -> DataFrame:
    """Consecutive numbers in the given order without bringing all rows to one
    task: a range sort, the number of rows of each partition (a few numbers to
    the driver), and offsets added in place."""
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_k", F.monotonically_increasing_id())
    from orbisframe.session import cut

    # the number of the partition is in the upper bits, that of the row in it in the lower 33
    ordered = cut(ordered).withColumn("_p", F.shiftright("_k", 33))
    sizes = ordered.groupBy("_p").agg(F.count("*").alias("n"))
    before = sizes.select("_p", (F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).alias("_b"))
    at = F.col("_k").bitwiseAND(F.lit((1 << 33) - 1)) + F.coalesce("_b", F.lit(0)) + start
    return ordered.join(F.broadcast(before), "_p").withColumn(name, at.cast("long")).drop("_p", "_k", "_b")


def require_columns(rows: DataFrame, *columns: str) -> DataFrame:
    """Fail, when the rows are read, if one of the columns is null: this is
    how a step says which steps must have run before."""
    for c in columns:
        rows = rows.withColumn(c, F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.lit(f"column {c} isn't filled; run the step that makes it first"))))
    return rows


def lookup_or_fail(rows: DataFrame, key: str, table: DataFrame, table_key: str, value: str) -> DataFrame:
    """Join an optional reference; a set key without a row is an error."""
    t = table.select(F.col(table_key).alias("_k"), F.col(value).alias("_v"), F.lit(True).alias("_there"))
    j = rows.join(t, rows[key] == F.col("_k"), "left")
    bad = F.col(key).isNotNull() & F.col("_there").isNull()
    return j.withColumn(value, F.when(bad, F.raise_error(F.concat(F.lit(f"no row for {key} "), F.col(key).cast("string")))).otherwise(F.col("_v"))).drop("_k", "_v", "_there")


def index_by_name(rows: DataFrame) -> DataFrame:
    """One row a name; the last fid wins."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("fid")))).where("_r = 1").drop("_r")


def insert_rows(layer: DataFrame, new: DataFrame) -> DataFrame:
    """Append rows with fids after the largest, in the order of the new rows'
    first columns; missing columns are null."""
    top = layer.agg(F.coalesce(F.max("fid"), F.lit(0)).alias("top")).first()[0]
    numbered = number_rows(new, new.columns[:1], "fid", int(top) + 1)
    return layer.unionByName(numbered, allowMissingColumns=True)


def update_rows(layer: DataFrame, delta: DataFrame) -> DataFrame:
    """Replace columns of the rows that ``delta`` names by fid; nulls in it are written."""
    cols = [c for c in delta.columns if c != "fid"]
    d = delta.select(F.col("fid").alias("_f"), *[F.col(c).alias(f"_new_{c}") for c in cols])
    out = layer.join(d, layer["fid"] == F.col("_f"), "left")
    return out.select(*[F.when(F.col("_f").isNotNull(), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in layer.columns])


def set_property(properties: DataFrame, name: str, value: str) -> DataFrame:
    one = properties.sparkSession.createDataFrame([(name, value)], "name string, value string")
    return properties.where(F.col("name") != name).select("name", "value").unionByName(one)


def get_property(properties: DataFrame, name: str) -> str:
    got = properties.where(F.col("name") == name).select("value").take(1)
    if not got:
        raise KeyError(f"property {name} isn't set")
    return got[0][0]


def not_nan(c: Column) -> Column:
    """NaN is never written."""
    return F.when(F.isnan(c), F.raise_error(F.lit("NaN can't be written"))).otherwise(c)
