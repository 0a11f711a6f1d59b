"""Benchmark decontamination by winnowing.

Words are hashed, every five-word gram gets a hash, and of each sliding window
of six grams the smallest is kept as a fingerprint. Two spans that share ten
words share all six grams of a window, hence its smallest, so joining training
fingerprints with benchmark fingerprints meets every shared span of ten words.
A joined fingerprint is extended to the ten-word windows around it, and those
that are windows of an item mark their words as hit. Items of fewer than ten
words are one window each and are looked up by their own length.

Defined results: null and empty texts have no words and no hits; an item
without words matches nothing; repeated benchmark rows count once by item_id,
and a null item_id is never listed, though its words count as hit. Every
document row gives a row, also repeated ones and those with a null doc_id; an
empty benchmark hits nothing, an empty table gives no rows. Further columns
don't matter, whatever their names. A text of any length is looked at whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbisframe.llm.textvec import Texts, covered, member, mix, ranges, slices
from orbisframe.session import cut

#: Bytes of benchmark text that are broadcast at most.
BLOCK_BYTES = 32 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def word_hashes(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each lower-cased word, and the first word of each text."""
    low = _LOWER[t.data]
    starts, ends, first = t.runs(_WORD[low])
    t.data, t._prefix = low, None
    return t.hashes(starts, ends), first


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words, across text borders too."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(size))
    for k in range(size):
        out = (out ^ words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return mix(out)


def within(first: np.ndarray, size: int, n: int) -> np.ndarray:
    """True for the gram starts whose gram stays in its text."""
    out = np.zeros(max(n - size + 1, 0), bool)
    lengths = np.maximum(np.diff(first) - size + 1, 0)
    out[ranges(first[:-1], lengths)] = True
    return out


def fingerprints(grams: np.ndarray, usable: np.ndarray, windows: np.ndarray, width: int) -> np.ndarray:
    """Gram positions that are the smallest of some window (the rightmost of
    equal ones); ``windows``: the starts of the windows within a text."""
    if not len(windows):
        return np.empty(0, np.int64)
    best = grams[windows].copy()
    at = windows.copy()
    for k in range(1, width):
        g = grams[windows + k]
        less = g <= best
        best[less] = g[less]
        at[less] = (windows + k)[less]
    flags = np.zeros(len(grams), bool)
    flags[at] = True
    return np.flatnonzero(flags)


class Benchmark:
    """Fingerprints and windows of a block of items."""

    def __init__(self, items: list[tuple], window: int = 10, gram: int = 5):
        self.window, self.gram = window, gram
        t = Texts(pa.array([x[1] for x in items], pa.string()))
        words, first = word_hashes(t)
        # items are numbered by their distinct ids; rows without an id get the number after the last
        self.ids = np.unique(np.array([x[0] for x in items if x[0] is not None], np.int64))
        ids = np.array([len(self.ids) if x[0] is None else np.searchsorted(self.ids, x[0]) for x in items], np.int64)
        n_words = np.diff(first)
        wide = gram_hashes(words, window)
        at = np.flatnonzero(within(first, window, len(words)))
        text = np.searchsorted(first, at, side="right") - 1
        self.windows, self.items_off, self.items = self._lists(wide[at], ids[text])
        grams = gram_hashes(words, gram)
        prints = fingerprints(grams, None, at, window - gram + 1)
        self.prints = np.unique(grams[prints])
        self.filter = np.zeros(1 << 22, bool)
        self.filter[self.prints & np.uint64((1 << 22) - 1)] = True
        self.short = {}
        for size in range(1, window):
            k = np.flatnonzero(n_words == size)
            if len(k):
                self.short[size] = self._lists(gram_hashes(words, size)[first[k]], ids[k])

    @staticmethod
    def _lists(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ordered distinct keys with the distinct ids of each."""
        pairs = np.unique(np.rec.fromarrays([keys, ids], names="k,i")) if len(keys) else np.rec.fromarrays([keys, ids], names="k,i")
        unique, start = np.unique(pairs.k, return_index=True)
        return unique, np.append(start, len(pairs)).astype(np.int64), np.asarray(pairs.i)

    def hits(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flags of hit words; (text, item) pairs that meet, distinct."""
        n = len(words)
        hit = np.zeros(n, bool)
        texts, items = [], []

        def found(at: np.ndarray, keys: np.ndarray, size: int, table: tuple) -> None:
            unique, off, ids = table
            ok = member(keys, unique)
            at, keys = at[ok], keys[ok]
            if not len(at):
                return
            hit[covered(at, at + size, n)] = True
            text = np.searchsorted(first, at, side="right") - 1
            which = np.searchsorted(unique, keys)
            pair = np.unique(np.column_stack((text, which)), axis=0)
            size_of = off[pair[:, 1] + 1] - off[pair[:, 1]]
            texts.append(np.repeat(pair[:, 0], size_of))
            items.append(ids[ranges(off[pair[:, 1]], size_of)])

        if len(self.windows) and n >= self.window:
            width = self.window - self.gram + 1
            grams = gram_hashes(words, self.gram)
            inside = within(first, self.window, n)
            prints = fingerprints(grams, None, np.flatnonzero(inside), width)
            g = grams[prints]
            near = self.filter[g & np.uint64((1 << 22) - 1)]
            prints, g = prints[near], g[near]
            prints = prints[member(g, self.prints)]
            if len(prints):
                around = (prints[:, None] - np.arange(width)).ravel()
                around = np.unique(around[(around >= 0) & (around < len(inside))])
                around = around[inside[around]]
                key = np.full(len(around), np.uint64(self.window))
                for k in range(self.window):
                    key = (key ^ words[around + k]) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(29)
                found(around, mix(key), self.window, (self.windows, self.items_off, self.items))
        for size, table in self.short.items():
            at = np.flatnonzero(within(first, size, n))
            found(at, gram_hashes(words, size)[at] if len(at) else np.empty(0, np.uint64), size, table)
        if not texts:
            return hit, np.empty(0, np.int64), np.empty(0, np.int64)
        pairs = np.unique(np.column_stack((np.concatenate(texts), np.concatenate(items))), axis=0)
        return hit, pairs[:, 0], pairs[:, 1]


def small_benchmark(benchmark: DataFrame, limit: int) -> list[tuple] | None:
    """The items, if their texts have at most ``limit`` bytes together."""
    rows = benchmark.select("item_id", "text").where("text is not null")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return [tuple(r) for r in rows.collect()] if size <= limit else None


def _spans(hit: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hit word numbers within each text, flat, with offsets."""
    at = np.flatnonzero(hit)
    off = np.searchsorted(at, first)
    text = np.searchsorted(first, at, side="right") - 1
    return at - first[text], off


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, gram: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, hit_words (numbers of the hit words) and
    items (ids of the items that occur), in order.

    A benchmark of up to ``block_bytes`` is broadcast, once its size has been
    read. A larger one stays distributed, and its windows are joined with
    those around the documents' fingerprints (``_joined``)."""
    items = small_benchmark(benchmark, block_bytes)
    if items is not None:
        return _against(docs, items, window, gram).drop("key")
    return _joined(docs, benchmark, window, gram).drop("key")


#: Bits of the filter that says which fingerprints a large benchmark may hold:
#: 16 MB, whatever the benchmark's size.
FILTER_BITS = 27


def _bits(hashes: np.ndarray, size: int) -> np.ndarray:
    return (mix(hashes + np.uint64(size)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _bench_windows(benchmark: DataFrame, window: int, gram: int) -> DataFrame:
    """(size, hash, bit, item_id): windows of the items by their size in
    words, and as size 0 the fingerprints of the full windows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in slices(batches):
            words, first = word_hashes(t)
            n_words = np.diff(first)
            full = np.flatnonzero(within(first, window, len(words)))
            grams = gram_hashes(words, gram)
            prints = fingerprints(grams, None, full, window - gram + 1)
            sets = [(0, grams[prints], prints), (window, gram_hashes(words, window)[full] if len(full) else np.empty(0, np.uint64), full)]
            sets += [(k, gram_hashes(words, k)[first[:-1][n_words == k]], first[:-1][n_words == k]) for k in range(1, window) if (n_words == k).any()]
            size = np.concatenate([np.full(len(h), k) for k, h, _ in sets])
            key = np.concatenate([h for _, h, _ in sets])
            text = np.searchsorted(first, np.concatenate([at for _, _, at in sets]), side="right") - 1
            bit = np.concatenate([_bits(h, k) for k, h, _ in sets])
            yield pa.RecordBatch.from_arrays([pa.array(size.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(bit), part.column(0).take(pa.array(text))], ["size", "hash", "bit", "item_id"])

    return benchmark.select("item_id", "text").where("text is not null").mapInArrow(work, "size int, hash long, bit long, item_id long")


def _joined(docs: DataFrame, benchmark: DataFrame, window: int, gram: int) -> DataFrame:
    """Documents against a benchmark of any size, by joins.

    A filter of fixed size holds a bit for each benchmark fingerprint and each
    short item. One pass over the documents emits the windows around those of
    their fingerprints that the filter lets through; joined with the
    benchmark's windows by hash, they are the hits. Only such windows travel,
    and the texts never do."""
    spark = docs.sparkSession
    windows = cut(_bench_windows(benchmark, window, gram))
    filled = windows.where(F.col("size") != window).groupBy(F.shiftright("bit", 6).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("word"))
    table = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    got = filled.toPandas()  # at most one row a word of the filter
    table[got["at"].to_numpy(np.int64)] = got["word"].to_numpy(np.int64).view(np.uint64)
    short = sorted(r.size for r in windows.where(~F.col("size").isin(0, window)).select("size").distinct().collect())
    sent = spark.sparkContext.broadcast(table)

    def held(hashes: np.ndarray, size: int) -> np.ndarray:
        bit = _bits(hashes, size)
        return (sent.value[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) > 0

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in slices(batches):
            words, first = word_hashes(t)
            n = len(words)
            # every document gives a row of size -1, with its number of words
            starts, sizes, keys = [first[:-1]], [np.full(t.n, -1)], [np.diff(first).astype(np.uint64)]
            texts = [np.arange(t.n)]
            if n >= window:
                inside = within(first, window, n)
                grams = gram_hashes(words, gram)
                prints = fingerprints(grams, None, np.flatnonzero(inside), window - gram + 1)
                prints = prints[held(grams[prints], 0)]
                around = (prints[:, None] - np.arange(window - gram + 1)).ravel()
                around = np.unique(around[(around >= 0) & (around < len(inside))])
                around = around[inside[around]]
                starts.append(around), sizes.append(np.full(len(around), window)), keys.append(gram_hashes(words, window)[around])
                texts.append(np.searchsorted(first, around, side="right") - 1)
            for k in short:
                at = np.flatnonzero(within(first, k, n))
                h = gram_hashes(words, k)[at] if len(at) else np.empty(0, np.uint64)
                yes = held(h, k)
                starts.append(at[yes]), sizes.append(np.full(int(yes.sum()), k)), keys.append(h[yes])
                texts.append(np.searchsorted(first, at[yes], side="right") - 1)
            text = np.concatenate(texts)
            place = np.concatenate(starts) - first[text]
            row = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(row), part.column(2).take(row), pa.array(np.concatenate(sizes).astype(np.int32)), pa.array(np.concatenate(keys).view(np.int64)), pa.array(place.astype(np.int32))],
                ["doc_id", "key", "size", "hash", "start"],
            )

    seen = cut(docs.select("doc_id", "text", F.xxhash64("text").alias("key")).mapInArrow(work, "doc_id long, key long, size int, hash long, start int"))
    marks = seen.where("size = -1").groupBy("doc_id", "key").agg(F.first("hash").alias("n_words"), F.count("*").cast("int").alias("times"))
    named = windows.where("size != 0").groupBy("size", "hash").agg(F.collect_set("item_id").alias("ids"))
    hits = seen.where("size > 0").select("doc_id", "key", "size", "hash", "start").join(named, ["size", "hash"])
    hits = hits.groupBy(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.expr("sequence(start, start + size - 1)"))))).alias("hit_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("items"),
    )
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    out = marks.join(hits, marks["doc_id"].eqNullSafe(hits["_d"]) & marks["key"].eqNullSafe(hits["_k"]), "left")
    out = out.select("doc_id", "key", "n_words", none(F.col("hit_words"), "array<int>").alias("hit_words"), none(F.col("items"), "array<bigint>").alias("items"), F.explode(F.sequence(F.lit(1), "times")).alias("_t"))
    return out.drop("_t")


def _against(docs: DataFrame, block: list[tuple], window: int, gram: int) -> DataFrame:
    """One pass over the documents with one block."""
    sent = docs.sparkSession.sparkContext.broadcast(Benchmark(block, window, gram))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in slices(batches):
            words, first = word_hashes(t)
            hit, text, item = sent.value.hits(words, first)
            named = item < len(sent.value.ids)
            text, item = text[named], sent.value.ids[item[named]]
            at, off = _spans(hit, first, t.n)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), part.column(2), pa.array(np.diff(first).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(at.astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(t.n + 1)).astype(np.int32)), pa.array(item.astype(np.int64))),
                ],
                ["doc_id", "key", "n_words", "hit_words", "items"],
            )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("key")).mapInArrow(work, "doc_id long, key long, n_words long, hit_words array<int>, items array<long>")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, gram: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without any hit, with all their columns."""
    items = small_benchmark(benchmark, block_bytes)
    if items is not None:
        return _clean(docs, items, window, gram)
    hit = _joined(docs, benchmark, window, gram).where("size(hit_words) > 0").select(F.col("doc_id").alias("_hit_doc"), F.col("key").alias("_hit_key")).distinct()
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["_hit_doc"]) & (F.xxhash64(docs["text"]) == hit["_hit_key"]), "left_anti")


def _clean(docs: DataFrame, block: list[tuple], window: int, gram: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(Benchmark(block, window, gram))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in slices(batches):
            words, first = word_hashes(t)
            hit = sent.value.hits(words, first)[0]
            clean = np.ones(t.n, bool)
            clean[np.searchsorted(first, np.flatnonzero(hit), side="right") - 1] = False
            yield part.filter(pa.array(clean))

    return docs.mapInArrow(work, docs.schema)


def digest_items(items: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The digest columns: n_hit, n_items, items_sha256, contaminated."""
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return find_contamination(docs, benchmark, window, block_bytes=block_bytes).select(
        "doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"), (F.size("hit_words") > 0).alias("contaminated"),
    )
