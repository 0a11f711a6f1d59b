"""MinHash near-dedup on multisets of word shingles (BagMinHash).

A document is the multiset of its five-word shingles. Each (shingle, weight
interval) drives a Poisson process in time whose points fall into one of m
slots; a slot's signature is the identity of its earliest point. Integer
weights are covered by the dyadic intervals [0,1), [1,2), [2,4), ...; in an
interval that the weight covers in part, a point's position inside it comes
from the point's hash, bit by bit, and points beyond the weight don't count.
Two slots agree with a probability equal to the weighted Jaccard similarity.

Bands of r slots give candidates, a bucket's members are compared with its
leader instead of with each other, and the multiset overlap is verified on the
shingles themselves. Equal texts are one node from the start.

What is found: a pair of similarity s shares a band with probability
1 - (1 - s^r)^b; with r = 5 and b = 40 a pair at 0.8 is missed with
probability 1.3e-7. Inside a bucket all members are compared with its leader,
in waves, without those that are connected with it by then. Then every pair of
members that are still in different classes is compared, in a buffer of the
bucket's shingles; a large bucket is dealt in parts and taken by pairs of
parts. Only comparisons that could join what is connected already, or whose
shingle numbers rule the threshold out, are left out, so the classes are those
of all pairs that banding brings together.

Defined results: null and empty texts, and texts without words, have no
shingles and are classed with equal texts only (null with null); a text of one
to four words has one shingle, all of it. Rows that share a doc_id get one
class. Every row gives a row: one without a doc_id takes the class of the rows
with an equal text, and a null class if none of these has an id, since a class
is named by an id. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbisframe.llm.decontaminate import gram_hashes, within, word_hashes
from orbisframe.llm.textvec import Texts, mix, ranges, slices
from orbisframe.session import cut

ROWS, BANDS, SHINGLE = 5, 40, 5
#: Shingles in a part of a bucket whose members are compared with each other.
PART = 200_000
#: Leaders of a document compared in one wave, by their place in its list.
WAVES = ((0, 0), (1, 4), (5, 2**31 - 1))
_ID_BITS = np.uint64(44)


def shingle_bags(t: Texts, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in order: text number, id, count."""
    words, first = word_hashes(t)
    n_words = np.diff(first)
    at = np.flatnonzero(within(first, size, len(words)))
    keys = [gram_hashes(words, size)[at] if len(at) else np.empty(0, np.uint64)]
    texts = [np.searchsorted(first, at, side="right") - 1]
    for k in range(1, size):
        few = np.flatnonzero(n_words == k)
        if len(few):
            keys.append(gram_hashes(words, k)[first[few]])
            texts.append(few)
    key, text = np.concatenate(keys), np.concatenate(texts).astype(np.uint64)
    packed, count = np.unique((text << _ID_BITS) | (key >> np.uint64(64 - 44)), return_counts=True)
    return (packed >> _ID_BITS).astype(np.int64), packed & np.uint64((1 << 44) - 1), count


def _unit(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / 9007199254740992.0


def bag_minhash(text: np.ndarray, ids: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """Signatures, n x m; rows of texts without shingles are zero."""
    sig = np.zeros((n, m), np.uint64)
    total = np.bincount(text, weight, n)
    # intervals: level 0 is [0,1), level k is [2^(k-1), 2^k)
    level_n = np.ceil(np.log2(weight)).astype(np.int64) + 1
    of = np.repeat(np.arange(len(ids)), level_n)
    level = ranges(np.zeros(len(ids), np.int64), level_n)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    span = np.where(level == 0, 1, low).astype(np.float64)
    reach = np.minimum(weight[of] - low, span)
    seed = mix(ids[of] ^ (level.astype(np.uint64) << np.uint64(50)))
    owner = text[of]
    horizon = np.where(total > 0, m * (np.log(m) + 3.0) / np.maximum(total, 1), 0)
    todo = np.flatnonzero(total > 0)
    while len(todo):
        mine = np.zeros(n, bool)
        mine[todo] = True
        entry = np.flatnonzero(mine[owner])
        time = np.zeros(len(entry))
        state = seed[entry]
        best = np.full(n * m, np.inf)
        slots, times, names = [], [], []
        while len(entry):
            state = mix(state + np.uint64(0x9E3779B97F4A7C15))
            time = time - np.log(_unit(state)) / span[entry]
            go = time <= horizon[owner[entry]]
            entry, time, state = entry[go], time[go], state[go]
            extra = mix(state ^ np.uint64(0xD1B54A32D192ED03))
            inside = (extra >> np.uint64(32)).astype(np.float64) / 4294967296.0 * span[entry] < reach[entry]
            slot = owner[entry] * m + ((extra & np.uint64(0xFFFFFFFF)) % np.uint64(m)).astype(np.int64)
            slots.append(slot[inside]), times.append(time[inside]), names.append(state[inside])
        slot, at, name = np.concatenate(slots), np.concatenate(times), np.concatenate(names)
        np.minimum.at(best, slot, at)
        first = best[slot] == at
        flat = np.zeros(n * m, np.uint64)
        np.maximum.at(flat, slot[first], name[first])
        full = np.isfinite(best).reshape(n, m).all(axis=1)
        done = todo[full[todo]]
        sig[done] = flat.reshape(n, m)[done]
        todo = todo[~full[todo]]
        horizon[todo] *= 2
    return sig


def band_keys(sig: np.ndarray, rows: int, bands: int) -> np.ndarray:
    out = np.repeat(np.arange(bands, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15), len(sig), axis=0)
    for k in range(rows):
        out = mix((out ^ sig[:, k::rows][:, :bands]) * np.uint64(0xC2B2AE3D27D4EB4F))
    return out


def _digest(t: Texts, nulls: np.ndarray) -> list[bytes | None]:
    import hashlib

    raw, off = memoryview(t.data.tobytes()), t.off.tolist()
    return [b"null" if nulls[k] else hashlib.blake2b(raw[off[k] : off[k + 1]], digest_size=16).digest() for k in range(t.n)]


def signatures(docs: DataFrame, rows: int = ROWS, bands: int = BANDS, size: int = SHINGLE) -> DataFrame:
    """(doc_id, digest, n_shingles, bands) of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in slices(batches):
            digest = _digest(t, np.asarray(part.column(1).is_null()))
            text, ids, count = shingle_bags(t, size)
            sig = bag_minhash(text, ids, count, t.n, rows * bands)
            total = np.bincount(text, count, t.n).astype(np.int64)
            keys = band_keys(sig, rows, bands).view(np.int64)
            off = np.concatenate(([0], np.cumsum(np.where(total > 0, bands, 0)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(digest, pa.binary()), pa.array(total), pa.ListArray.from_arrays(pa.array(off), pa.array(keys[total > 0].ravel()))],
                ["doc_id", "digest", "n_shingles", "bands"],
            )

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, digest binary, n_shingles long, bands array<long>")


def _bags(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, ids, counts): the shingles of each row, ids in order. 32 bits
    of a shingle's id are enough to compare two documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in slices(batches):
            text, ids, count = shingle_bags(t, size)
            short = (ids >> np.uint64(12)).astype(np.uint32).view(np.int32)
            off = pa.array(np.searchsorted(text, np.arange(t.n + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.ListArray.from_arrays(off, pa.array(short)), pa.ListArray.from_arrays(off, pa.array(np.minimum(count, 2**31 - 1).astype(np.int32)))],
                ["doc_id", "ids", "counts"],
            )

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, ids array<int>, counts array<int>")


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted Jaccard of two bags a row."""

    def flat(part: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
        col = part.column(part.schema.get_field_index(name))
        return np.asarray(col.flatten()), np.concatenate(([0], np.cumsum(np.asarray(pa.compute.list_value_length(col)))))

    for whole in batches:
        for begin in range(0, whole.num_rows, 256):
            part = whole.slice(begin, 256)
            n = part.num_rows
            (xi, xo), (xc, _), (yi, yo), (yc, _) = (flat(part, k) for k in ("x_ids", "x_counts", "y_ids", "y_counts"))
            row = np.concatenate((np.repeat(np.arange(n), np.diff(xo)), np.repeat(np.arange(n), np.diff(yo)))).astype(np.uint64)
            key = (row << np.uint64(32)) | np.concatenate((xi, yi)).view(np.uint32)
            order = np.argsort(key, kind="stable")
            s, c = key[order], np.concatenate((xc, yc)).astype(np.int64)[order]
            both = np.flatnonzero(s[1:] == s[:-1])
            shared = np.bincount((s[both] >> np.uint64(32)).astype(np.int64), np.minimum(c[both], c[both + 1]), n)
            total = np.bincount((key >> np.uint64(32)).astype(np.int64), np.concatenate((xc, yc)), n)
            sim = shared / np.maximum(total - shared, 1)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sim)], ["x", "y", "sim"])


def _verify(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    x = bags.select(F.col("doc_id").alias("x"), F.col("ids").alias("x_ids"), F.col("counts").alias("x_counts"))
    y = bags.select(F.col("doc_id").alias("y"), F.col("ids").alias("y_ids"), F.col("counts").alias("y_counts"))
    return pairs.join(x, "x").join(y, "y").select("x", "y", "x_ids", "x_counts", "y_ids", "y_counts").mapInArrow(_overlap, "x long, y long, sim double")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): smallest node of each connected component, by rounds of
    neighbour minimum and pointer jumping until nothing changes."""
    both = cut(edges.select(F.col("x").alias("u"), F.col("y").alias("v")).union(edges.select("y", "x")).distinct())
    labels = cut(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        step = cut(labels.join(near, F.col("u") == F.col("node")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        up = step.select(F.col("node").alias("at"), F.col("label").alias("up"))
        labels = cut(step.join(up, F.col("label") == F.col("at")).select("node", "old", F.least("label", "up").alias("label")))
        if labels.where("label != old").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")


def _stars(links: DataFrame) -> DataFrame:
    """(node, label): each linked document's smallest leader, followed twice.
    Equal labels mean one component; different ones don't mean two."""
    label = cut(links.groupBy(F.col("y").alias("node")).agg(F.min("x").alias("label")))
    for _ in range(2):
        up = label.select(F.col("node").alias("at"), F.col("label").alias("up"))
        label = cut(label.join(up, F.col("label") == F.col("at"), "left").select("node", F.coalesce("up", "label").alias("label")))
    return label


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The rows whose x and y have different labels; without one, a document
    is its own."""
    for c in ("x", "y"):
        pairs = pairs.join(label.select(F.col("node").alias(c), F.col("label").alias(f"{c}_class")), c, "left").withColumn(f"{c}_class", F.coalesce(f"{c}_class", c))
    return pairs.where("x_class != y_class").drop("x_class", "y_class")


def _mixed(member: DataFrame, widest: bool) -> DataFrame:
    """(key, y, label, parts): members of the buckets with several classes, one
    bucket of each set of members. ``widest`` takes only buckets that are the
    largest one of some member. A bucket is dealt in so many parts that each
    has about PART shingles."""
    one = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "y"))
    seen = member.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n"), F.sum("size").alias("total"), one(1).alias("a"), one(2).alias("b"))
    seen = seen.where("low < high").groupBy("n", "a", "b").agg(F.min("key").alias("key"), F.first("total").alias("total"))
    held = cut(member.join(seen.select("key", "n", F.ceil(F.col("total") / PART).cast("int").alias("parts")), "key"))
    if widest:
        first = held.groupBy("y").agg(F.max(F.struct("n", "key")).alias("top")).select(F.col("top.key").alias("key")).distinct()
        held = held.join(first, "key", "left_semi")
    return held.select("key", "y", "label", "parts")


def cross_links(label: np.ndarray, side: np.ndarray, ids: np.ndarray, counts: np.ndarray, off: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links between members of different classes, as places. Classes that a
    link joins are one from then on; every pair that stays in two classes has
    been compared. Members of one side aren't compared if there are two."""
    n = len(label)
    _, group, n_of = np.unique(label, return_inverse=True, return_counts=True)
    order = np.lexsort((group, n_of[group]))  # small classes first: the last one meets nobody
    group, side, span = group[order].copy(), side[order], np.diff(off)[order]
    at = ranges(off[:-1][order], span)
    ids, counts = np.unique(ids[at], return_inverse=True)[1], counts[at].astype(np.int64)
    off = np.concatenate(([0], np.cumsum(span)))
    total = np.add.reduceat(counts, off[:-1])
    two = len(np.unique(side)) > 1
    table = np.zeros(int(ids.max()) + 1, np.int64)
    xs, ys = [], []
    for k in range(n - 1):
        able = (group[k + 1 :] != group[k]) & (np.minimum(total[k + 1 :], total[k]) >= threshold * np.maximum(total[k + 1 :], total[k]) - 1e-9)
        if two:
            able &= side[k + 1 :] != side[k]
        to = k + 1 + np.flatnonzero(able)
        if not len(to):
            continue
        mine = slice(off[k], off[k + 1])
        table[ids[mine]] = counts[mine]
        at = ranges(off[to], span[to])
        shared = np.add.reduceat(np.minimum(table[ids[at]], counts[at]), np.cumsum(span[to]) - span[to])
        table[ids[mine]] = 0
        for j in to[shared / np.maximum(total[to] + total[k] - shared, 1) >= threshold]:
            if group[j] != group[k]:
                xs.append(k), ys.append(j)
                group[group == group[j]] = group[k]
    return order[np.array(xs, np.int64)], order[np.array(ys, np.int64)]


def _across(member: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """(x, y): links between the classes of each bucket. A bucket of several
    parts is taken by pairs of parts, so no group grows with it."""
    part = F.pmod(F.xxhash64(F.lit(3), "y"), F.col("parts")).cast("int")
    dealt = member.withColumn("part", part).withColumn("to", F.explode(F.expr("sequence(0, parts - 1)")))
    unit = dealt.select("key", F.least("part", "to").alias("i"), F.greatest("part", "to").alias("j"), "part", F.col("y").alias("doc_id"), "label")

    def work(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        doc, label, side = (table.column(c).to_numpy() for c in ("doc_id", "label", "part"))
        bag = table.column("ids").combine_chunks(), table.column("counts").combine_chunks()
        ids, counts = (np.asarray((x.chunk(0) if isinstance(x, pa.ChunkedArray) else x).flatten()) for x in bag)
        off = np.concatenate(([0], np.cumsum(np.asarray(pa.compute.list_value_length(bag[0])))))
        x, y = cross_links(label, side, ids, counts, off, threshold)
        return pa.table({"x": np.minimum(doc[x], doc[y]), "y": np.maximum(doc[x], doc[y])})

    return unit.join(bags, "doc_id").groupBy("key", "i", "j").applyInArrow(work, "x long, y long")


def near_duplicate_classes(docs: DataFrame, threshold: float = 0.8, rows: int = ROWS, bands: int = BANDS, size: int = SHINGLE) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the class) and n_shingles."""
    every = cut(signatures(docs, rows, bands, size))
    sig = every.where("doc_id is not null")
    docs = docs.where("doc_id is not null")
    reps = sig.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    heads = reps.select(F.col("rep").alias("doc_id")).distinct()
    row = sig.join(heads, "doc_id").select("doc_id", F.posexplode("bands").alias("band", "key")).select("doc_id", F.xxhash64("band", "key").alias("key"))
    firsts = row.groupBy("key").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("last")).where("x < last").drop("last")
    member = cut(row.join(firsts, "key").where("doc_id != x").select("key", F.col("doc_id").alias("y"), "x").distinct())
    wanted = member.select(F.col("y").alias("doc_id")).union(member.select("x")).distinct()
    texts = docs.select("doc_id", "text").join(wanted.hint("shuffle_hash"), "doc_id")
    bags = cut(_bags(texts, size))

    # a document meets its smallest leader first, then the next ones, then the
    # rest; leaders that it is connected with by then say nothing new
    ranked = cut(member.groupBy("y").agg(F.array_sort(F.collect_set("x")).alias("xs")).select("y", F.posexplode("xs").alias("turn", "x")))
    seen = None
    for low, high in WAVES:
        pairs = ranked.where(F.col("turn").between(low, high)).select("x", "y")
        if seen is not None:
            pairs = _apart(pairs, _stars(seen.where(F.col("sim") >= threshold)))
        wave = cut(_verify(pairs, bags))
        seen = wave if seen is None else seen.unionByName(wave)
    # every member has met its leaders; a bucket whose other members are of
    # several classes goes on, until all its pairs across classes are judged
    edges = seen.where(F.col("sim") >= threshold).select("x", "y")
    size_of = sig.groupBy(F.col("doc_id").alias("y")).agg(F.max("n_shingles").alias("size"))
    member = cut(member.select("key", "y").join(size_of, "y"))
    for widest in (True, False):
        of = components(edges).withColumnRenamed("node", "y")
        now = cut(member.join(of, "y", "left").select("key", "y", F.coalesce("label", "y").alias("label"), "size"))
        edges = edges.unionByName(cut(_across(_mixed(now, widest), bags, threshold)))
    label = components(edges)
    classes = reps.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("label", "rep").alias("class_id"))
    return every.select("doc_id", "digest", "n_shingles").join(classes, "digest", "left").select("doc_id", "class_id", "n_shingles")


def keep_one(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One document of each class stays: the smallest doc_id. Documents
    without an id stay."""
    gone = near_duplicate_classes(docs, threshold).where("doc_id != class_id").select("doc_id").distinct()
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)
