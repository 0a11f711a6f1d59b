"""Quality rules: gradient-boosted trees over document statistics.

``document_stats`` measures every whole text in numpy on raw bytes.
``fit_boosted_trees`` grows depth-limited trees on logistic loss with
histogram splits and monotonic constraints, and ``FlatTrees`` holds the fitted
model as plain node arrays, scored for a whole batch level by level.

Defined results: a null or empty text has no words, so it fails the base rule
and is not kept. Repeated rows give repeated rows. Further columns of the
input are left alone, whatever their names. Rows that share a doc_id count once
in training; a null doc_id has no label. Without usable labels (none, or of one
class only) the verdict is the base rule alone. Empty tables give no rows. A
text of any length is measured whole, alone if it is longer than a slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbisframe.llm.textvec import Texts, class_table, mix, repeated, slices

#: Names of the model's features and their monotonic direction: -1 means that
#: a larger value may only lower the probability of good quality.
FEATURES = {
    "log_words": 0, "mean_word_chars": 0, "symbols_per_word": -1, "dup_line_share": -1,
    "repeat_word_share": -1, "upper_share": -1, "digit_share": 0, "bang_per_word": -1,
    "stop_per_word": 0, "distinct_word_share": 0, "top_word_share": -1, "words_per_line": 0,
    "symbol_end_share": -1, "non_ascii_share": 0,
}

_SPACE = class_table(b" \t\n\x0b\x0c\r")
_SYMBOL = class_table("#*$%&|<>")
_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def document_stats(t: Texts) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The contract's counts of each text, and the feature matrix."""
    data, off, n = t.data, t.off, t.n
    word = ~_SPACE[data]
    starts, ends, first = t.runs(word)
    n_words = np.diff(first)
    doc = np.repeat(np.arange(n), n_words)
    salt = mix(np.arange(n, dtype=np.uint64) + np.uint64(77))
    h = t.hashes(starts, ends)

    # lines: the text between \n; those without a word don't count
    breaks = np.flatnonzero(data == 10)
    l_start = np.sort(np.concatenate((off[:-1], breaks + 1)))
    l_end = np.sort(np.concatenate((breaks, off[1:])))
    l_doc = np.sort(np.concatenate((np.arange(n), np.searchsorted(off, breaks, side="right") - 1)))
    has = np.searchsorted(starts, l_end) > np.searchsorted(starts, l_start)
    l_start, l_end, l_doc = l_start[has], l_end[has], l_doc[has]
    n_lines = np.bincount(l_doc, minlength=n)
    l_key = mix(t.hashes(l_start, l_end) ^ salt[l_doc])
    _, at = np.unique(l_key, return_index=True)
    n_dup = n_lines - np.bincount(l_doc[at], minlength=n)

    # words inside a three-word window that the text holds twice
    in_doc = h ^ salt[doc]
    rep = np.zeros(len(h), bool)
    if len(h) > 2:
        ok = doc[2:] == doc[:-2]
        key = mix(mix(mix(in_doc[:-2]) + in_doc[1:-1]) + in_doc[2:])
        twice = np.zeros(len(key), bool)
        twice[ok] = repeated(key[ok])
        for k in range(3):
            rep[k : len(key) + k] |= twice
    n_rep = np.bincount(doc[rep], minlength=n)

    letters = ((data | 32) >= 97) & ((data | 32) <= 122)
    stats = {
        "n_words": n_words, "word_chars": t.per_text(word & ((data & 0xC0) != 0x80)),
        "n_symbols": t.per_text(_SYMBOL[data]), "n_dup_lines": n_dup, "n_repeat_words": n_rep,
    }
    words = np.maximum(n_words, 1)
    last = data[ends - 1] if len(ends) else np.empty(0, np.uint8)
    keys = mix(in_doc)
    order = np.argsort(keys)
    run = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1]))) if len(keys) else np.empty(0, np.int64)
    size = np.diff(np.concatenate((run, [len(keys)])))
    of = doc[order][run] if len(keys) else np.empty(0, np.int64)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, of, size)
    f = np.column_stack([
        np.log1p(n_words), stats["word_chars"] / words, stats["n_symbols"] / words, n_dup / np.maximum(n_lines, 1),
        n_rep / words, t.per_text((data >= 65) & (data <= 90)) / np.maximum(t.per_text(letters), 1),
        t.per_text((data >= 48) & (data <= 57)) / np.maximum(stats["word_chars"], 1), t.per_text(data == 33) / words,
        t.per_text(data == 46) / words, np.bincount(of, minlength=n) / words, top / words, n_words / np.maximum(n_lines, 1),
        np.bincount(doc[_SYMBOL[last]], minlength=n) / words, t.per_text(data >= 0xC0) / words,
    ])
    return stats, f


def base_failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


@dataclass
class FlatTrees:
    """A boosted ensemble as node arrays: node ``i`` sends a row to ``child[i]``
    if ``x[feature[i]] <= threshold[i]``, else to ``child[i] + 1``; a leaf
    points to itself through feature -1."""

    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of good quality, all rows and trees at once."""
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[at]
            right = x[rows, np.maximum(f, 0)] > self.threshold[at]
            at = np.where(f < 0, at, self.child[at] + right)
        return self.bias + self.value[at].sum(axis=1)


def fit_boosted_trees(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, least: float = 5.0, l2: float = 2.0) -> FlatTrees:
    """Newton boosting on logistic loss. A split on a constrained feature whose
    children would go against the direction is refused, and the midpoint of
    the children's values bounds both subtrees, so the whole tree is monotone."""
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    code = np.column_stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)])
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    margin = np.full(len(y), bias)
    feature, threshold, child, value, roots = [], [], [], [], []

    def leaf(v: float) -> int:
        feature.append(-1), threshold.append(0.0), child.append(0), value.append(v)
        return len(feature) - 1

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        roots.append(leaf(0.0))
        work = [(roots[-1], np.arange(len(y)), -np.inf, np.inf, 0)]
        while work:
            node, rows, low, high, level = work.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            own = float(np.clip(-gs / (hs + l2), low, high))
            best = (1e-6, None)
            if level < depth and len(rows) >= 2 * least:
                for k, e in enumerate(edges):
                    if not len(e):
                        continue
                    c = code[rows, k]
                    gl = np.cumsum(np.bincount(c, g[rows], len(e) + 1))[:-1]
                    hl = np.cumsum(np.bincount(c, h[rows], len(e) + 1))[:-1]
                    nl = np.cumsum(np.bincount(c, minlength=len(e) + 1))[:-1]
                    vl, vr = np.clip(-gl / (hl + l2), low, high), np.clip(-(gs - gl) / (hs - hl + l2), low, high)
                    gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                    ok = (nl >= least) & (len(rows) - nl >= least)
                    if monotone[k]:
                        ok &= monotone[k] * (vr - vl) >= 0
                    gain = np.where(ok, gain, -1)
                    j = int(gain.argmax())
                    if gain[j] > best[0]:
                        best = (gain[j], (k, j, (vl[j] + vr[j]) / 2))
            if best[1] is None:
                value[node] = own * rate
                margin[rows] += own * rate
                continue
            k, j, mid = best[1]
            left, right = leaf(0.0), leaf(0.0)
            feature[node], threshold[node], child[node] = k, float(edges[k][j]), left
            go = code[rows, k] <= j
            lo, hi = [low, low], [high, high]
            if monotone[k] > 0:
                hi[0], lo[1] = mid, mid
            elif monotone[k] < 0:
                lo[0], hi[1] = mid, mid
            work += [(left, rows[go], lo[0], hi[0], level + 1), (right, rows[~go], lo[1], hi[1], level + 1)]
    return FlatTrees(np.array(feature), np.array(threshold), np.array(child), np.array(value), np.array(roots), depth, bias)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, t in slices(batches):
        _, f = document_stats(t)
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(list(f), pa.list_(pa.float64()))], ["doc_id", "quality", "features"])


def fit_quality_model(docs: DataFrame, labels: DataFrame, max_train_rows: int = 20_000) -> FlatTrees | None:
    """Fit on a bounded sample of labelled documents: the ``max_train_rows``
    labels whose hashed id is smallest, so the sample doesn't depend on
    partitioning. The sample's ids and features are the only rows that reach
    the driver, at most ``max_train_rows`` of each: of rows that share an id
    the one with the smallest features is taken, before they are collected."""
    chosen = (
        labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train_rows)
    )
    spark = docs.sparkSession
    chosen = spark.createDataFrame([tuple(r) for r in chosen.collect()], "doc_id long, quality int")
    rows = (
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
        .mapInArrow(_feature_rows, "doc_id long, quality int, features array<double>")
        .groupBy("doc_id").agg(F.min(F.struct("features", "quality")).alias("r")).select("doc_id", "r.*").collect()
    )
    rows.sort(key=lambda r: r.doc_id)
    y = np.array([r.quality for r in rows], float)
    if not len(y) or y.min() == y.max():
        return None
    return fit_boosted_trees(np.array([r.features for r in rows]), (y > 0).astype(float), list(FEATURES.values()))


def score_quality(docs: DataFrame, model: FlatTrees | None, threshold: float = 0.5) -> DataFrame:
    """One row per document: the counts, ``score`` (probability of good
    quality, null without a model), ``base_failed`` and ``kept``."""
    least = float(np.log(threshold / (1 - threshold)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in slices(batches):
            stats, f = document_stats(t)
            failed = base_failed(stats["n_words"], stats["n_repeat_words"])
            margin = np.zeros(t.n) if model is None else model.score(f)
            score = pa.nulls(t.n, pa.float64()) if model is None else pa.array(1 / (1 + np.exp(-margin)))
            kept = ~failed & ((margin >= least) | (model is None))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(stats[k].astype(np.int64)) for k in _STATS), score, pa.array(failed), pa.array(kept)],
                ["doc_id", *_STATS, "score", "base_failed", "kept"],
            )

    kinds = "doc_id long, " + ", ".join(f"{k} long" for k in _STATS) + ", score double, base_failed boolean, kept boolean"
    return docs.select("doc_id", "text").mapInArrow(work, kinds)


def keep_good(docs: DataFrame, model: FlatTrees | None, threshold: float = 0.5) -> DataFrame:
    """The documents that pass, with all their columns; texts aren't shuffled."""
    least, names = float(np.log(threshold / (1 - threshold))), docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in slices(batches):
            stats, f = document_stats(t)
            kept = ~base_failed(stats["n_words"], stats["n_repeat_words"])
            if model is not None:
                kept &= model.score(f) >= least
            yield part.filter(pa.array(kept))

    return docs.select(*names).mapInArrow(work, docs.schema)
