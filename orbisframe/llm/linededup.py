"""Line dedup over overlapping three-line windows.

Every three consecutive lines are one window. A window that stands more than
once in the corpus keeps its first place (smallest doc_id, then
line); every later place covers its three lines, and the covered lines of a
document are removed together.

Defined results: a null text stays null and has no lines; a text of fewer
than three lines has no window and stays whole; windows of white space alone
don't count. Rows with equal doc_id and text are one document to the operator
and get equal results; rows that share a doc_id only are ordered by the text's
hash; a null doc_id comes after all others, and rows without one are told apart
by their text. An empty table gives no rows; a text of any length is one row.
Columns of the input keep their names, whatever these are; only ``lines_total``
and ``lines_removed`` are replaced. The windows travel as hashes, are
aggregated before they are shuffled, and the join side is one row a window; a
window with very many places is a skewed join key, which AQE deals anew.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbisframe.llm.textvec import covered

SIZE = 3


def _windows(keyed: DataFrame, size: int) -> DataFrame:
    """(doc_id, row_key, pos, a, b): a 128-bit hash of every window."""
    lines = F.split("text", "\n", -1)
    # two 64-bit hashes of a line with different seeds; a blank line is marked
    marked = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(x, F.lit(11)).alias("b"), (F.length(F.trim(F.regexp_replace(x, r"\s+", ""))) > 0).alias("w")))
    rows = keyed.where("text is not null").select("doc_id", "row_key", marked.alias("m"))
    rows = rows.where(F.size("m") >= size)
    every = F.transform(
        F.sequence(F.lit(0), F.size("m") - size),
        lambda i: F.struct(
            i.alias("pos"),
            F.xxhash64(*[F.get("m", i + k)["a"] for k in range(size)]).alias("a"),
            F.xxhash64(*[F.get("m", i + k)["b"] for k in range(size)], F.lit(5)).alias("b"),
            F.greatest(*[F.get("m", i + k)["w"].cast("int") for k in range(size)]).alias("w"),
        ),
    )
    return rows.select("doc_id", "row_key", F.explode(every).alias("e")).where("e.w = 1").select("doc_id", "row_key", "e.pos", "e.a", "e.b")


def later_windows(keyed: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, row_key, cover): where a row's later occurrences begin."""
    windows = _windows(keyed, size)
    place = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("row_key").alias("r"), F.col("pos").alias("p"))
    firsts = windows.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").drop("last")
    later = windows.join(firsts, ["a", "b"]).where(place != F.col("first"))
    return later.groupBy("doc_id", "row_key").agg(F.collect_list("pos").alias("cover"))


def _remove(size: int):
    @F.pandas_udf("text string, n_removed long")
    def remove(text: pd.Series, cover: pd.Series) -> pd.DataFrame:
        out, n = [], []
        for whole, at in zip(text, cover, strict=True):
            if whole is None or at is None:
                out.append(None), n.append(0)
                continue
            lines = whole.split("\n")
            at = np.asarray(at, np.int64)
            gone = covered(at, at + size, len(lines))
            out.append("\n".join(x for x, g in zip(lines, gone.tolist(), strict=True) if not g)), n.append(int(gone.sum()))
        return pd.DataFrame({"text": out, "n_removed": n})

    return remove


def dedup_lines(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """The columns of ``docs`` with the cleaned ``text``, then ``lines_total``
    and ``lines_removed``. A text that loses every line becomes empty. Only
    the texts that lose lines go through Python."""
    kept = [c for c in docs.columns if c not in ("lines_total", "lines_removed")]
    found = later_windows(docs.select("doc_id", F.xxhash64("text").alias("row_key"), "text"), size)
    # the input's columns stay inside one struct, so their names can't clash
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.xxhash64("text").alias("row_key"))
    out = whole.join(found, F.col("row.doc_id").eqNullSafe(found["doc_id"]) & (whole["row_key"] == found["row_key"]), "left").select("row", "cover")
    fixed = _remove(size)(F.when(F.col("cover").isNotNull(), F.col("row.text")), F.col("cover"))
    out = out.withColumn("fixed", fixed)
    old = F.col("row.text")
    text = F.when(F.col("cover").isNull(), old).otherwise(F.col("fixed.text"))
    total = F.when(old.isNull(), F.lit(0)).otherwise(F.length(old) - F.length(F.translate(old, "\n", "")) + 1)
    return out.select(
        *[text.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in kept],
        total.cast("long").alias("lines_total"),
        F.coalesce("fixed.n_removed", F.lit(0)).cast("long").alias("lines_removed"),
    )
