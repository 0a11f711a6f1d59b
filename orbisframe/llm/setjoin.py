"""Set-similarity join of documents on word shingles, filtered under several
global token orders.

A document is the set of its shingles, each a 64-bit hash. If two sets of n and
m shingles link at threshold t, they share at least c(n) = ceil(t n) and c(m)
of them, and so, under any global order of the shingles, at least
min(l(n), l(m)) among the first n - c(n) + l(n) of the one and the first
m - c(m) + l(m) of the other. This is asked under three orders:

1. Order of the hashes. Prefixes are joined by shingle, and a set stays only if
   at least ``need(n)`` shingles of its prefix are in prefixes of other sets.
2. Rarest first, within these prefixes, by the number of sets that hold a
   shingle there. Candidates share a shingle of the prefix under this order.
3. Order of an independent hash, for each pair of candidates.

What is left is verified on the whole sets, in integers. Sets that are equal
are one node from the start. A shingle's sets are compared with its smallest
one, in waves, without those that are connected with it by then, and at last
every pair of sets that share a shingle and are still in different components
is compared, parts of a group by parts; so the components are those of all
links, and no group emits all its pairs. Nothing is sampled or capped.

The first join is packed: a batch of texts sends, for each range of hashes, its
distinct prefix shingles with one set each. Shingles that several sets of a
batch hold are known to be shared there and go past the join, so a shingle that
a third of all documents hold meets once a batch.

Defined results: null and empty texts, and texts without words, have no
shingles and are their own component; texts with fewer words than a shingle
have one, the whole sequence. Rows with equal sets have one component, and so
have rows that share a doc_id. Every row gives a row; one without a doc_id has
the component of the rows with an equal set, and a null component if none of
these has an id or the set is empty. An empty table gives no rows. Only doc_id
and text are read. Shingles, and sets, are told apart by 64 bits of hashes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbisframe.llm import neardup
from orbisframe.llm.decontaminate import gram_hashes, within
from orbisframe.llm.textvec import Texts, class_table, list_column, mix, ranges, slices
from orbisframe.session import cut

SHINGLE, PERCENT = 5, 80
#: Bytes of text in a batch of the packed join, and to a range of hashes, about.
BATCH_BYTES, RANGE_BYTES = 32 << 20, 8 << 20
#: A set of n shingles has n // EXTRA more of them in its prefix, to be shared.
EXTRA = 4
_ROUNDS = 2
#: Bits of the filter that texts pass before they are dealt, as a power of two: 16 MB as words and their places at most.
FILTER_BITS = 26

_SPACE = class_table(b" \t\n\x0b\x0c\r")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_OTHER = np.uint64(0x8F1BBCDCBFA53E0B)


def shared_least(n, percent: int):
    """c(n), of numbers, arrays or columns."""
    return (percent * n + 99) // 100 if not isinstance(n, Column) else F.floor((percent * n + 99) / 100)


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return np.minimum(n, n - shared_least(n, percent) + 1 + n // EXTRA)


def need(n, percent: int):
    """Shingles that a prefix shares at least with that of any partner: l of
    the smallest partner, which has c(n) shingles."""
    least = shared_least(n, percent)
    return 1 + least // EXTRA if not isinstance(n, Column) else 1 + F.floor(least / EXTRA)


def shingle_sets(t: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text in ascending order, and where each
    text's begin (n + 1 numbers)."""
    t.data, t._prefix = _LOWER[t.data], None
    starts, ends, first = t.runs(~_SPACE[t.data])
    words = t.hashes(starts, ends)
    at = np.flatnonzero(within(first, size, len(words)))
    keys = [gram_hashes(words, size)[at] if len(at) else np.empty(0, np.uint64)]
    texts = [np.searchsorted(first, at, side="right") - 1]
    n_words = np.diff(first)
    for k in range(1, size):
        few = np.flatnonzero(n_words == k)
        if len(few):
            keys.append(gram_hashes(words, k)[first[few]])
            texts.append(few)
    key, text = np.concatenate(keys), np.concatenate(texts)
    order = np.lexsort((key, text))
    key, text = key[order], text[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    return key[new], np.searchsorted(text[new], np.arange(t.n + 1))


def set_nodes(keys: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set; 0 for the empty one."""
    raw, out = memoryview(keys.tobytes()), np.zeros(len(off) - 1, np.int64)
    for k in np.flatnonzero(np.diff(off)):
        out[k] = int.from_bytes(hashlib.blake2b(raw[8 * off[k] : 8 * off[k + 1]], digest_size=8).digest(), "little", signed=True) or 1
    return out


def document_sets(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, node, n_shingles) of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in slices(batches):
            keys, off = shingle_sets(t, size)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(set_nodes(keys, off)), pa.array(np.diff(off))], ["doc_id", "node", "n_shingles"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, node long, n_shingles long")


def _pack(docs: DataFrame, size: int, percent: int, ranges_n: int, batch_bytes: int) -> DataFrame:
    """(bucket, keys, nodes): prefix shingles by ranges of hashes, each with
    one set that holds it; buckets from ``ranges_n`` on hold shingles that are
    known to be shared, with all their sets of a batch."""
    width = np.uint64(2**64 // ranges_n + 1)

    def rows(key: np.ndarray, node: np.ndarray, salt: int) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node = key[new], node[new]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        alone = first & np.append(first[1:], True)
        one, many = (key[first], node[first]), (key[~alone], node[~alone])
        bucket = (one[0] // width).astype(np.int64)
        at = np.flatnonzero(np.diff(bucket, prepend=-1))
        names, offs = bucket[at], np.append(at, len(bucket))
        # what is known to be shared goes to any bucket, in parts
        cuts = np.append(np.arange(0, len(many[0]), 1 << 16), len(many[0])) if len(many[0]) else np.zeros(1, np.int64)
        extra = ranges_n + (salt * 7919 + np.arange(len(cuts) - 1)) % ranges_n
        off = np.concatenate((offs, offs[-1] + cuts[1:]))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate((names, extra)).astype(np.int32)), list_column(np.concatenate((one[0], many[0])).view(np.int64), off, pa.int64()),
                list_column(np.concatenate((one[1], many[1])), off, pa.int64()),
            ],
            ["bucket", "keys", "nodes"],
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, nodes, total, salt = [], set(), 0, 0
        for part, t in slices(batches):
            keys, off = shingle_sets(t, size)
            node = set_nodes(keys, off)
            n = np.diff(off)
            known = part.column(0).is_valid().to_numpy(zero_copy_only=False)
            fresh = np.array([k for k, x in enumerate(node.tolist()) if n[k] and known[k] and x not in nodes], np.int64)
            nodes.update(node[fresh].tolist())
            length = prefix_length(n[fresh], percent)
            held.append((keys[ranges(off[fresh], length)], np.repeat(node[fresh], length)))
            total += len(t.data)
            if total >= batch_bytes:
                yield from rows(*(np.concatenate(x) for x in zip(*held, strict=True)), salt)
                held, nodes, total, salt = [], set(), 0, salt + 1
        if held and sum(len(k) for k, _ in held):
            yield from rows(*(np.concatenate(x) for x in zip(*held, strict=True)), salt)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "bucket int, keys array<long>, nodes array<long>")


def _shared(packed: DataFrame, ranges_n: int) -> DataFrame:
    """(key, node): prefix shingles that several sets hold, with these sets, repeated ones too."""

    def work(table: pa.Table) -> pa.Table:
        key, node = (np.concatenate([np.asarray(c.flatten()) for c in table.column(name).chunks]) for name in ("keys", "nodes"))
        if table.column("bucket")[0].as_py() < ranges_n:
            order = np.lexsort((node, key))
            key, node = key[order], node[order]
            first = np.flatnonzero(np.diff(key, prepend=~key[:1]))
            size = np.diff(np.append(first, len(key)))
            several = np.repeat(node[first] != node[first + size - 1], size)
            key, node = key[several], node[several]
        return pa.table({"key": key, "node": node})

    return packed.groupBy("bucket").applyInArrow(work, "key long, node long")


def _thinned(member: DataFrame, percent: int) -> DataFrame:
    """``member`` (key, node, n) without the shingles of one set and the sets
    that share too few, with the sets of each shingle (df) and the shingles of
    each set (r). Counted in windows, so the rows travel once by shingle and
    once by set, however the planner would have dealt joins with the counts."""
    of = lambda c: F.count("*").over(Window.partitionBy(c))
    held = member.select("key", "node", "n").withColumn("df", of("key")).where("df > 1")
    return held.withColumn("r", of("node")).where(F.col("r") >= need(F.col("n"), percent))


def _likely(docs: DataFrame, wanted: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """The rows of ``docs`` whose doc_id may be one of ``wanted``: all that are,
    and few others, by a bitmap of hashes that is broadcast and doesn't grow
    beyond its bits. So only texts that are asked for travel."""
    place = F.xxhash64(F.col("doc_id").cast("long")).bitwiseAND(F.lit((1 << bits) - 1))
    bit = F.expr("shiftleft(1L, cast(_place & 63 as int))")
    marks = cut(wanted.select(place.alias("_place")).groupBy(F.shiftright("_place", 6).alias("_word")).agg(F.bit_or(bit).alias("_bits")))
    asked = docs.withColumn("_place", place).withColumn("_word", F.shiftright("_place", 6)).join(F.broadcast(marks), "_word")
    return asked.where(F.col("_bits").bitwiseAND(bit) != 0).select(*docs.columns)


def _sets_of(docs: DataFrame, wanted: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, keys, other) of the wanted (doc_id, want): the whole set, and its
    prefix under the third order, both in ascending order."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in slices(batches):
            keys, off = shingle_sets(t, size)
            node = set_nodes(keys, off)
            good = np.flatnonzero(node == np.asarray(part.column(0)))  # a doc_id may have other texts too
            n = np.diff(off)[good]
            text = np.repeat(np.arange(len(good)), n)
            own = keys[ranges(off[good], n)]
            order = np.lexsort((mix(own ^ _OTHER), text))
            rank = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
            short = prefix_length(n, percent)
            chosen = np.sort(order[rank < np.repeat(short, n)])
            offs = lambda size: np.append(0, np.cumsum(size))
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[good]), list_column(own.view(np.int64), offs(n), pa.int64()), list_column(own[chosen].view(np.int64), offs(short), pa.int64())],
                ["node", "keys", "other"],
            )

    return _likely(docs.select("doc_id", "text"), wanted).join(wanted.hint("shuffle_hash"), "doc_id").select("want", "text").mapInArrow(work, "node long, keys array<long>, other array<long>")


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Elements of both ascending arrays."""
    if len(x) > len(y):
        x, y = y, x
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0


def _compare(pairs: DataFrame, sets: DataFrame, column: str, percent: int) -> DataFrame:
    """The pairs (x, y) that pass: under the third order if ``column`` is
    "other", as links if it is "keys"."""

    def side(name: str) -> DataFrame:
        return sets.select(F.col("node").alias(name), F.col(column).alias(f"{name}_keys"), F.size("keys").alias(f"{name}_n"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            (xk, xo), (yk, yo) = ((np.asarray(c.flatten()).view(np.uint64), np.concatenate(([0], np.cumsum(np.asarray(pa.compute.list_value_length(c)))))) for c in (batch.column(2), batch.column(4)))
            for k, (n, m) in enumerate(zip(batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                same = _common(xk[xo[k] : xo[k + 1]], yk[yo[k] : yo[k + 1]])
                good[k] = same >= 1 + min(n, m) // EXTRA if column == "other" else 100 * same >= percent * (n + m - same)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good)) for c in batch.columns[:2]], ["x", "y"])

    told = pairs.join(side("x"), "x").join(side("y"), "y").select("x", "y", "x_keys", "x_n", "y_keys", "y_n")
    return told.mapInArrow(work, "x long, y long")


def _links(sets: DataFrame, member: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """(node, label): components of the links between the ``sets`` that share
    a shingle of ``member`` (key, node, n) under the second order, and of the
    pairs ``known`` (x, y)."""
    first = F.min("node").over(Window.partitionBy("key"))
    sizes = cut(member.groupBy("node").agg(F.first("n").alias("n")))
    grouped = cut(member.withColumn("x", first).where("node != x").select("key", F.col("node").alias("y"), "x", F.col("n").alias("size")))
    ranked = grouped.groupBy("y").agg(F.array_sort(F.collect_set("x")).alias("xs")).select("y", F.posexplode("xs").alias("turn", "x"))
    fit = lambda a, b: F.col(a) * 100 >= percent * F.col(b)
    ranked = ranked.join(sizes.select(F.col("node").alias("x"), F.col("n").alias("x_n")), "x").join(sizes.select(F.col("node").alias("y"), F.col("n").alias("y_n")), "y")
    ranked = cut(ranked.where(fit("x_n", "y_n") & fit("y_n", "x_n")).select("x", "y", "turn"))
    # a set meets the first of its shingles' smallest sets, then the others that it isn't connected with
    judge = lambda pairs: cut(_compare(_compare(pairs, sets, "other", percent), sets, "keys", percent))
    found = judge(ranked.where("turn = 0").select("x", "y"))
    found = found.unionByName(judge(neardup._apart(ranked.where("turn > 0").select("x", "y"), neardup._stars(found)))).unionByName(known)
    # all sets of a shingle have met its first one; those still apart meet each other,
    # in units of sizes: sets that link are of one step of 100 / percent, or of two neighbouring ones
    bags = sets.select(F.col("node").alias("doc_id"), F.col("keys").alias("ids"), F.expr("array_repeat(1, size(keys))").alias("counts"))
    step = F.floor(F.log(F.col("size").cast("double")) / math.log(100 / percent) + 1e-9)
    unit = F.explode(F.array(step, step + 1))
    grouped = grouped.select(F.col("key").alias("_k"), "y", "size", unit.alias("_u")).select(F.xxhash64("_k", "_u").alias("key"), "y", "size")
    return _cross(cut(grouped), neardup.components(found), bags, percent)


def _joined(of: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, label) after further links (x, y): only the labels
    that these connect are looked at again."""
    if links.isEmpty():
        return of
    pairs = links
    for c in ("x", "y"):
        pairs = pairs.join(of.select(F.col("node").alias(c), F.col("label").alias(f"{c}_of")), c, "left").withColumn(f"{c}_of", F.coalesce(f"{c}_of", c))
    top = neardup.components(pairs.select(F.col("x_of").alias("x"), F.col("y_of").alias("y")).where("x != y").distinct())
    new = top.select(F.col("node").alias("label"), F.col("label").alias("_top"))
    lone = links.select(F.col("x").alias("node")).unionByName(links.select(F.col("y").alias("node"))).distinct().join(of, "node", "left_anti").withColumn("label", F.col("node"))
    return cut(of.unionByName(lone).join(new, "label", "left").select("node", F.coalesce("_top", "label").alias("label")))


def _mixed(grouped: DataFrame, of: DataFrame) -> DataFrame:
    """(key, y, label, size, n, total): the groups with sets of several
    components, one of those with the same sets."""
    now = cut(grouped.join(of.withColumnRenamed("node", "y"), "y", "left").select("key", "y", F.coalesce("label", "y").alias("label"), "size"))
    one = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "y"))
    mixed = now.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n"), F.sum("size").alias("total"), one(1).alias("a"), one(2).alias("b"))
    mixed = mixed.where("low < high").groupBy("n", "a", "b").agg(F.min("key").alias("key"), F.first("total").alias("total"))
    return cut(now.join(mixed.select("key", "n", "total"), "key"))


def _widest(held: DataFrame) -> DataFrame:
    """(y, own): the widest group of each set."""
    return cut(held.groupBy("y").agg(F.max(F.struct("n", "key")).alias("top")).select("y", F.col("top.key").alias("own")))


def _parts(total: str) -> Column:
    return F.ceil(F.col(total) / neardup.PART).cast("int")


def _between(member: DataFrame, bags: DataFrame, percent: int) -> DataFrame:
    """(x, y): links between the classes of each group (key, y, label, parts).
    Only the sets that are asked for travel."""
    member = cut(member)
    return cut(neardup._across(member, _likely(bags, member.select(F.col("y").alias("doc_id"))), percent / 100))


def _whole(held: DataFrame, of: DataFrame, blocks: DataFrame, bags: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The components ``of`` after the ``blocks`` of groups (key, block, alone)
    that are compared whole, and the groups of the others. A block is compared
    whole if no more shingles travel so than for those of its groups that would
    be compared by themselves (``alone``), each as often as it has parts."""
    blocked = cut(held.join(blocks, "key"))
    apart = blocked.where("alone").groupBy("block").agg(F.sum(F.col("size") * _parts("total")).alias("apart"))
    member = cut(blocked.select(F.col("block").alias("key"), "y", "label", "size").distinct())
    size = member.groupBy("key").agg(F.sum("size").alias("total")).withColumn("parts", _parts("total"))
    chosen = cut(size.join(apart.withColumnRenamed("block", "key"), "key").where(F.col("total") * F.col("parts") <= F.col("apart")).select("key", "parts"))
    of = _joined(of, _between(member.join(chosen, "key").select("key", "y", "label", "parts"), bags, percent))
    return of, cut(blocked.join(chosen.select(F.col("key").alias("block")), "block", "left_anti").select("key", "y", "size"))


def _cross(grouped: DataFrame, of: DataFrame, bags: DataFrame, percent: int) -> DataFrame:
    """The components ``of`` with the links between sets (key, y, size) of one
    group that are still in different ones. Groups that share sets are a
    family, and a set in many groups of one travels once for each part of it if
    the family is compared whole. Where that is more than its groups take, a
    group joins the one that is the widest of most of its sets, under the same
    condition. Of what is left the widest groups are compared, then those that
    don't lie in one of them."""
    held = _mixed(grouped, of)
    if held.isEmpty():
        return of
    heads = cut(held.groupBy("key").agg(F.min("y").alias("x")))
    family = neardup.components(heads.join(held.select("key", "y"), "key").where("x != y").select("x", "y").distinct())
    widest = _widest(held).select(F.col("own").alias("key")).distinct().withColumn("alone", F.lit(True))
    blocks = heads.join(family.withColumnRenamed("node", "x"), "x").select("key", F.col("label").alias("block")).join(widest, "key", "left")
    of, grouped = _whole(held, of, blocks.select("key", "block", F.coalesce("alone", F.lit(False)).alias("alone")), bags, percent)
    if not grouped.isEmpty():
        held = _mixed(grouped, of)
        tops = held.select("key", "y").join(_widest(held), "y").groupBy("key", "own").count()
        blocks = tops.groupBy("key").agg(F.max(F.struct("count", "own"))["own"].alias("block"), (F.count("*") > 1).alias("several"))
        of, grouped = _whole(held, of, blocks.select("key", "block", (F.col("several") | (F.col("key") == F.col("block"))).alias("alone")), bags, percent)
    for widest in (True, False):
        if grouped.isEmpty():
            break
        chosen = held = _mixed(grouped, of)
        if widest:
            own = _widest(held)
            chosen = cut(held.join(own.select(F.col("own").alias("key")).distinct(), "key", "left_semi"))
        of = _joined(of, _between(chosen.select("key", "y", "label", _parts("total").alias("parts")), bags, percent))
        if widest:
            # a group whose sets all have the same widest one lies in that
            rest = held.join(chosen.select("key").distinct(), "key", "left_anti")
            open_keys = rest.select("key", "y").join(own, "y").groupBy("key").agg(F.min("own").alias("a"), F.max("own").alias("b")).where("a != b").select("key")
            grouped = cut(rest.join(open_keys, "key", "left_semi").select("key", "y", "size"))
    return of


def join_components(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, batch_bytes: int = BATCH_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    every = cut(document_sets(docs, size))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges_n = total // range_bytes + 2
    known = every.where("doc_id is not null and n_shingles > 0")
    reps = cut(known.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n")))

    # distinct by the nodes that the join needs next
    shared = _shared(_pack(docs, size, percent, ranges_n, batch_bytes), ranges_n).repartition("node").distinct()
    member = shared.join(reps.select("node", "n"), "node")
    for _ in range(_ROUNDS):  # sets that go leave shingles that are no longer shared
        member = _thinned(cut(member), percent)
    # under the second order the shingles nobody else holds come first
    rank = F.row_number().over(Window.partitionBy("node").orderBy("df", "key"))
    rare = cut(member.withColumn("rank", rank).where(F.col("rank") <= F.col("r") - need(F.col("n"), percent) + 1).select("key", "node", "n"))
    wanted = cut(rare.select("node").distinct().join(reps, "node").select(F.col("rep").alias("doc_id"), F.col("node").alias("want")))
    sets = _sets_of(docs, wanted, size, percent)
    if not known.groupBy("doc_id", "node").count().where("count > 1").isEmpty():  # whole rows repeat, their sets needn't
        sets = sets.dropDuplicates(["node"])
    sets = cut(sets)
    # sets of one doc_id are connected, too
    several = known.groupBy("doc_id").agg(F.min("node").alias("x"), F.max("node").alias("last")).where("x < last").select("doc_id", "x")
    same_id = known.join(several, "doc_id").select("x", F.col("node").alias("y")).where("x != y").distinct()
    label = cut(reps.join(_links(sets, rare, cut(same_id), percent), "node", "left").select("node", "rep", F.coalesce("label", "node").alias("label")))
    best = label.groupBy("label").agg(F.min("rep").alias("component"))
    of = label.join(best, "label").select("node", "component")
    out = cut(every.join(of, "node", "left"))
    # a row without shingles has no more to say than other rows of its doc_id
    empty = out.where("component is null and doc_id is not null").select("doc_id").distinct()
    beside = out.join(empty, "doc_id", "left_semi").where("component is not null").groupBy("doc_id").agg(F.min("component").alias("_c"))
    return out.join(beside, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "_c", F.when(F.col("n_shingles") == 0, F.col("doc_id"))).alias("component_id"))
