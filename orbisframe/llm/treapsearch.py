"""Ranked lexical search over inverted treaps.

Each term's postings form a treap: documents in search order by id, impacts in
heap order. Documents are dealt in shards of bounded size, and a shard's
treaps are walked together, one level of many searches at a time: a node of
the search is an interval of documents with, for each term, the treap node of
highest impact inside it. The sum of these impacts bounds every document of
the interval; an interval whose bound can't reach the top is left out with all
below it. Otherwise the document of the largest weighted impact is scored, and
the treaps are split at it, which gives the two intervals beside it.

One pass reads the texts and writes the postings of the searched terms, term
statistics are sums over it, a second pass reads the postings shard by shard.
What leaves a shard is its best documents for each item. Items are read in
blocks of bounded size; a block's terms are what is broadcast.

A term is a maximal run of ASCII letters (lower-cased), digits and non-ASCII
characters. The score is the integer BM25 of ``weight`` and ``impact``.

Defined results: null and empty texts, and texts without terms, are no
documents, neither ranked nor counted; items without terms have no rows. Equal
scores rank by doc_id, nulls last. Every row with a term is a document, also
repeated ones and those without an id. Item rows with the same item_id and text
are one item; other rows that share an item_id are ranked apart, each from 1.
Empty tables give no rows. Only doc_id, item_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbisframe.llm.decontaminate import word_hashes
from orbisframe.llm.textvec import Texts, list_column, ranges, slices
from orbisframe.session import cut

#: Bytes of item texts in a block, about.
BLOCK_BYTES = 4 << 20
#: Postings of a shard, about; entries (search node, term) handled at once.
SHARD, ENTRIES = 2_000_000, 300_000
#: Items searched together in a shard.
TOGETHER = 64


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def length_norm(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    return 75 + (25 * n * n_docs) // max(n_terms, 1)


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Items:
    """The terms of a block of items, numbered, and each item's terms with
    their repeats."""

    def __init__(self, rows: list[tuple]):
        self.ids = [r[0] for r in rows]
        hashes, first = word_hashes(Texts(pa.array([r[1] for r in rows], pa.string())))
        self.terms, number = np.unique(hashes, return_inverse=True)
        item = np.repeat(np.arange(len(rows)), np.diff(first))
        pair, self.repeats = np.unique((item.astype(np.int64) << 32) | number, return_counts=True)
        self.item, self.term = pair >> 32, pair & 0xFFFFFFFF


def postings(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """One row a slice of texts: its documents that hold a searched term
    (``ids``, ``sizes``), its postings (``term``, ``place`` among the documents,
    ``tf``), and the number of documents and terms it has in all."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for part, t in slices(batches):
            words, first = word_hashes(t)
            n = np.diff(first)
            at = np.searchsorted(known, words)
            at[at == len(known)] = 0
            hit = np.flatnonzero(known[at] == words) if len(known) else np.empty(0, np.int64)
            doc = np.searchsorted(first, hit, side="right") - 1
            pair, tf = np.unique((doc.astype(np.int64) << 32) | at[hit], return_counts=True)
            held, place = np.unique(pair >> 32, return_inverse=True)
            one = lambda x, kind: list_column(x, [0, len(x)], kind)
            ids = part.column(0).take(pa.array(held))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), ids), one(n[held], pa.int64()), one(pair & 0xFFFFFFFF, pa.int32()),
                    one(place, pa.int32()), one(tf, pa.int32()), pa.array([int((n > 0).sum())]), pa.array([len(words)]),
                ],
                ["ids", "sizes", "term", "place", "tf", "n_docs", "n_terms"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "ids array<long>, sizes array<long>, term array<int>, place array<int>, tf array<int>, n_docs long, n_terms long")


def document_frequencies(index: DataFrame, n_terms: int) -> np.ndarray:
    """Documents of each term, summed in each task before they are sent."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            df += np.bincount(np.asarray(batch.column(0).flatten()), minlength=n_terms)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["term", "df"])

    out = np.zeros(n_terms, np.int64)
    got = index.select("term").mapInArrow(work, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()  # a row a searched term
    out[got["term"].to_numpy(np.int64)] = got["df"]
    return out


class Treaps:
    """Treaps of all terms of a shard over flat arrays: ``doc`` and ``impact``
    of each node, its children (-1: none), and each term's root."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, imp: np.ndarray, n_terms: int):
        order = np.lexsort((doc, term))
        term, self.doc, self.impact = term[order], doc[order], imp[order]
        off = np.searchsorted(term, np.arange(n_terms + 1))
        n = len(term)
        before, after = self._greater(term, off, -1), self._greater(term, off, 1)
        # the parent is the lower of the two greater neighbours; of equal impacts the earlier one is higher
        low = np.where(before >= 0, self.impact[before], np.iinfo(np.int64).max)
        high = np.where(after >= 0, self.impact[after], np.iinfo(np.int64).max)
        under = (before >= 0) & ((after < 0) | (low < high))
        self.left, self.right = np.full(n, -1), np.full(n, -1)
        right = np.flatnonzero(under)
        self.right[before[right]] = right
        left = np.flatnonzero(~under & (after >= 0))
        self.left[after[left]] = left
        self.root = np.full(n_terms, -1)
        top = np.flatnonzero((before < 0) & (after < 0))
        self.root[term[top]] = top

    def _greater(self, term: np.ndarray, off: np.ndarray, step: int) -> np.ndarray:
        """The nearest node of the same term that stands higher, on one side.
        Whatever lies between a node and where it points is lower, so it may
        go on from there to where that one points."""
        n = len(term)
        to = np.arange(n) + step
        edge = off[term] if step < 0 else off[term + 1] - 1
        to[np.arange(n) == edge] = -1
        todo = np.flatnonzero(to >= 0)
        while len(todo):
            there, here = self.impact[to[todo]], self.impact[todo]
            todo = todo[there < here] if step < 0 else todo[there <= here]
            to[todo] = to[to[todo]]
            todo = todo[to[todo] >= 0]
        return to

    def split(self, node: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each treap, ``node`` being its highest node between the
        documents ``lo`` and ``hi``: the highest nodes between ``lo`` and
        ``at`` and between ``at`` and ``hi`` (-1: none), and the impact at
        ``at`` (0: not there). Nothing is linked anew, so a way down may pass
        documents outside the interval, which don't count."""
        low, high, hit = np.full(len(node), -1), np.full(len(node), -1), np.zeros(len(node), np.int64)
        todo, now = np.arange(len(node)), node
        while len(todo):
            doc, to = self.doc[now], at[todo]
            less, more = doc < to, doc > to
            k = less & (low[todo] < 0) & (doc > lo[todo])
            low[todo[k]] = now[k]
            k = more & (high[todo] < 0) & (doc < hi[todo])
            high[todo[k]] = now[k]
            same = ~(less | more)
            k, v = todo[same], now[same]
            hit[k] = self.impact[v]
            self._inside(low, k, self.left[v], self.right, lambda doc, k: doc <= lo[k])
            self._inside(high, k, self.right[v], self.left, lambda doc, k: doc >= hi[k])
            now = np.where(less, self.right[now], self.left[now])
            go = ~same & (now >= 0)
            todo, now = todo[go], now[go]
        return low, high, hit

    def _inside(self, found: np.ndarray, k: np.ndarray, node: np.ndarray, child: np.ndarray, out: object) -> None:
        """Fill the places ``k`` of ``found`` that have nothing yet with the
        highest node inside the interval at or below ``node``."""
        go = (found[k] < 0) & (node >= 0)
        k, node = k[go], node[go]
        while len(k):
            beyond = out(self.doc[node], k)
            found[k[~beyond]] = node[~beyond]
            k, node = k[beyond], child[node[beyond]]
            k, node = k[node >= 0], node[node >= 0]


class Best:
    """The best ``k`` documents of each item so far; ``floor`` is what a
    document needs to be among them."""

    def __init__(self, n: int, k: int):
        self.k, self.floor = k, np.ones(n, np.int64)
        self.item = self.score = self.doc = np.empty(0, np.int64)

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        good = score >= self.floor[item]
        if not good.any():
            return
        item, score, doc = (np.concatenate(x) for x in ((self.item, item[good]), (self.score, score[good]), (self.doc, doc[good])))
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        start = np.searchsorted(item, item)
        rank = np.arange(len(item)) - start
        self.item, self.score, self.doc = (x[rank < self.k] for x in (item, score, doc))
        last = rank == self.k - 1
        self.floor[item[last]] = score[last]


def search(treaps: Treaps, n_docs: int, item: np.ndarray, term: np.ndarray, weights: np.ndarray, best: Best) -> None:
    """Walk the treaps of each item's terms together. An entry is a treap node
    and its weight, a search node has consecutive entries and an interval of
    documents. Blocks of search nodes wait on a stack, so memory is bounded by
    the depth, and those with higher bounds go first."""
    root = treaps.root[term]
    has = np.flatnonzero(root >= 0)
    start = np.flatnonzero(np.diff(item[has], prepend=-1))
    stack = [(item[has][start], np.full(len(start), -1), np.full(len(start), n_docs), np.diff(np.append(start, len(has))), root[has], weights[has])]
    while stack:
        of, lo, hi, size, node, w = stack.pop()
        if not len(of):
            continue
        value = w * treaps.impact[node]
        start = np.cumsum(size) - size
        bound = np.add.reduceat(value, start)
        keep = np.flatnonzero(bound >= best.floor[of])
        if not len(keep):
            continue
        if size[keep].sum() > ENTRIES and len(keep) > 1:
            keep = keep[np.argsort(-bound[keep], kind="stable")]
            half = min(int(np.searchsorted(np.cumsum(size[keep]), size[keep].sum() // 2)) + 1, len(keep) - 1)
            for part in (keep[half:], keep[:half]):
                at = ranges(start[part], size[part])
                stack.append((of[part], lo[part], hi[part], size[part], node[at], w[at]))
            continue
        if len(keep) < len(of):
            at = ranges(start[keep], size[keep])
            of, lo, hi, size, node, w, value = of[keep], lo[keep], hi[keep], size[keep], node[at], w[at], value[at]
            start = np.cumsum(size) - size
        which = np.repeat(np.arange(len(of)), size)
        # the document of the largest weighted impact of each search node
        top = np.flatnonzero(value == np.maximum.reduceat(value, start)[which])
        doc = np.empty(len(of), np.int64)
        doc[which[top][::-1]] = treaps.doc[node[top]][::-1]
        low, high, hit = treaps.split(node, doc[which], lo[which], hi[which])
        best.add(of, np.add.reduceat(hit * w, start), doc)
        blocks = []
        for side, a, b in ((low, lo, doc), (high, doc, hi)):
            at = np.flatnonzero(side >= 0)
            size = np.bincount(which[at], minlength=len(of))
            some = size > 0
            blocks.append((of[some], a[some], b[some], size[some], side[at], w[at]))
        stack.append(tuple(np.concatenate(x) for x in zip(*blocks, strict=True)))


def _shard(rows: list[tuple], n_docs: int, n_terms: int, items: Items, weights: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The best documents of a shard: item, doc_id, whether it has one, score.
    ``floor`` holds what earlier shards ask of each item, and is raised."""
    base = np.cumsum([0] + [len(r[1]) for r in rows])
    ids, known, sizes, term, tf = (np.concatenate([r[j] for r in rows]) for j in (0, 5, 1, 2, 4))
    place = np.concatenate([r[3] + b for r, b in zip(rows, base[:-1], strict=True)])
    order = np.lexsort((ids, ~known))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    m = length_norm(sizes, n_docs, n_terms)
    treaps = Treaps(term, rank[place], impact(tf.astype(np.int64), m[place]), len(weights))
    out = []
    for begin in range(0, len(items.ids), TOGETHER):
        a, b = np.searchsorted(items.item, (begin, begin + TOGETHER))
        best = Best(len(items.ids), k)
        best.floor = np.maximum(floor, 1)
        search(treaps, len(order), items.item[a:b], items.term[a:b], (weights[items.term] * items.repeats)[a:b], best)
        floor[:] = best.floor
        out.append((best.item, best.doc, best.score))
    item, doc, score = (np.concatenate(x) for x in zip(*out, strict=True))
    return item, ids[order][doc], known[order][doc], score


def _rank_block(docs: DataFrame, rows: list[tuple], k: int, shard: int) -> DataFrame:
    spark = docs.sparkSession
    items = Items(rows)
    index = cut(postings(docs, items.terms))
    total = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    n_docs, n_terms = total["n"] or 0, total["l"] or 0
    df = document_frequencies(index, len(items.terms))
    weights = np.array([weight(x, n_docs) for x in df.tolist()], np.int64)
    sent = spark.sparkContext.broadcast((items, weights))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = sent.value
        held, size, floor = [], 0, np.zeros(len(items.ids), np.int64)

        def done() -> Iterator[pa.RecordBatch]:
            if size:
                item, doc, known, score = _shard(held, n_docs, n_terms, items, weights, k, floor)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(item.astype(np.int32)), pa.array(items.ids, pa.int64()).take(pa.array(item)), pa.array(doc, mask=~known), pa.array(score)], ["item", "item_id", "doc_id", "score"]
                )

        for batch in batches:
            for j in range(batch.num_rows):
                ids, *flat = (batch.column(c)[j].values for c in range(5))
                known = np.asarray(ids.is_valid())
                held.append((np.asarray(ids.fill_null(0)), *(np.asarray(x) for x in flat), known))
                size += len(flat[1])
                if size >= shard:
                    yield from done()
                    held, size = [], 0
        yield from done()

    found = index.select("ids", "sizes", "term", "place", "tf").mapInArrow(work, "item int, item_id long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20, block_bytes: int = BLOCK_BYTES, shard: int = SHARD) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each item."""
    spark = docs.sparkSession
    items = items.where("text is not null").select(F.col("item_id").cast("long"), "text").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = size // block_bytes + 1
    out = spark.range(0).select(F.col("id").alias("item_id"), F.lit(0).alias("rank"), F.col("id").alias("doc_id"), F.col("id").alias("score"))
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        if rows:
            out = out.unionByName(_rank_block(docs, [tuple(r) for r in rows], k, shard))
    return out
