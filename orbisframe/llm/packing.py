"""Best-fit packing of token sequences, hierarchically.

Documents are encoded once into pieces of at most ``capacity`` tokens; only
longer ones are cut. Groups of pieces are packed by best-fit decreasing on
their own; bins with no room left that anything could use are done (full, or
with less room than the smallest bin there is), and the others become items of
the next round, in fewer and wider groups, dealt anew, until one group has been
packed whole or a round no longer joins any bins. Every group is bounded, and a
bin travels as (id, fill) only: its members are found again by joining the
rounds' placements.

Defined results: a null text is empty and is packed as the end token alone.
Every row is packed, also repeated ones and those with a null doc_id, whose
pieces have a null doc_id. An empty table gives no pieces. A text of any length
is encoded whole. Only doc_id and text are read of the input.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbisframe.llm.bytebpe import SLICE, worker_encoder
from orbisframe.llm.textvec import slices
from orbisframe.session import cut

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def encode_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int = 0) -> DataFrame:
    """Pieces of every document: the ids, then ``end_id``. The remainder of a
    long document is its first piece, so every later piece fills a sequence."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in slices(batches, limit=SLICE):
            ids, off = worker_encoder(tokenizer_path).encode(t, part.column(1))
            rows: list[tuple] = []
            doc = part.column(0).to_pylist()
            for k in range(t.n):
                own = np.append(ids[off[k] : off[k + 1]], np.uint32(end_id)).astype("<u4")
                head = len(own) % capacity or capacity
                start = 0
                for piece in range(-(-len(own) // capacity)):
                    end = head if not piece else start + capacity
                    rows.append((doc[k], piece, start, end - start, zlib.crc32(own[start:end].tobytes())))
                    start = end
            yield pa.RecordBatch.from_pandas(
                pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"piece": "int32"}),
                schema=pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]),
                preserve_index=False,
            )

    return docs.select("doc_id", "text").mapInArrow(work, PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each item: largest item first, each into the
    fullest bin that still takes it. Bins are kept by remaining room, so an
    item costs one search among at most ``capacity`` different rooms."""
    order = np.argsort(-lengths, kind="stable")
    which, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    rooms: list[int] = []
    bins: dict[int, list[int]] = {}
    n = 0
    for k in order.tolist():
        size = int(lengths[k])
        at = bisect.bisect_left(rooms, size)
        if at == len(rooms):
            b, room, n = n, capacity, n + 1
        else:
            room = rooms[at]
            b = bins[room].pop()
            if not bins[room]:
                del bins[room], rooms[at]
        which[k], offset[k] = b, capacity - room
        left = room - size
        if left:
            if left not in bins:
                bins[left] = []
                bisect.insort(rooms, left)
            bins[left].append(b)
    return which, offset


def _pack_round(items: DataFrame, groups: int, salt: int, capacity: int) -> DataFrame:
    """(item, parent, offset, fill) after best-fit in each of ``groups`` groups.
    A parent is named by its smallest item, so names stay unique."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item", ignore_index=True)
        which, offset = best_fit_decreasing(pdf["fill"].to_numpy(), capacity)
        pdf["parent"] = pdf.groupby(which)["item"].transform("min")
        pdf["total"] = pdf.groupby(which)["fill"].transform("sum")
        pdf["offset"] = offset
        return pdf[["item", "parent", "offset", "total"]]

    keyed = items.select("item", "fill", F.pmod(F.xxhash64("item", F.lit(salt)), F.lit(groups)).alias("g"))
    return keyed.groupBy("g").applyInPandas(lambda pdf: work(pdf), "item long, parent long, offset long, total long")


def pack(pieces: DataFrame, capacity: int, group_items: int = 60_000) -> DataFrame:
    """Place every piece: adds ``sequence_id`` and ``offset``.

    ``group_items``: items of one group, in about, which bounds a task's memory
    whatever the input's size."""
    full = F.col("length") >= capacity
    numbered = cut(pieces.withColumn("item", F.monotonically_increasing_id()))
    done = numbered.where(full).select("item", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    items = numbered.where(~full).select("item", F.col("length").alias("fill"))
    left, salt, rounds = items.count(), 0, []
    while left:
        groups = -(-left // group_items)
        placed = cut(_pack_round(items, groups, salt, capacity))
        rounds.append(placed)
        if groups == 1:
            break
        bins = placed.where("item = parent").select("item", F.col("total").alias("fill"))
        joined = left - bins.count()
        least = bins.agg(F.min("fill")).first()[0]
        items = bins.where(F.col("fill") <= capacity - least)
        left, salt = items.count(), salt + 1
        if not joined:
            break
    if not rounds:
        return numbered.join(done, "item").drop("item")
    place = rounds[0].select("item", F.col("parent").alias("sequence_id"), "offset")
    for later in rounds[1:]:
        step = later.select(F.col("item").alias("sequence_id"), F.col("parent"), F.col("offset").alias("more"))
        place = place.join(step, "sequence_id", "left").select(
            "item", F.coalesce("parent", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("more", F.lit(0))).alias("offset")
        )
    return numbered.join(place.unionByName(done), "item").drop("item")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, group_items: int = 60_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    out = pack(encode_pieces(docs, tokenizer_path, capacity, end_id), capacity, group_items)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
