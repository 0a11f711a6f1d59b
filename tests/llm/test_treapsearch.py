"""Ranked search against scoring every document, and the treaps by their definition."""

import random

import brute
import numpy as np
import pytest

from orbisframe.llm import treapsearch


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(11)
    words = [f"w{k}" for k in range(60)] + ["ÉTÉ", "Été", "x-y", "7"]
    prose = lambda n: " ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=n))
    docs = [(k, prose(rng.randint(1, 60))) for k in range(300)]
    docs += [(400 + k, docs[7][1]) for k in range(40)] + [(5, docs[5][1]), (None, docs[9][1]), (None, None), (500, None), (501, ""), (502, " .,! "), (503, "w1 " * 20000)]
    items = [(k, prose(rng.randint(1, 12))) for k in range(25)] + [(30, None), (31, ""), (32, "unheard of"), (33, docs[7][1]), (1, "w3 W3 w3 w59"), (None, "w2"), (34, "w4"), (34, "w4")]
    return docs, items


@pytest.mark.parametrize("shard,entries,block", [(2_000_000, 300_000, 1 << 22), (500, 40, 400)])
def test_ranking(spark, tables, shard, entries, block, monkeypatch):
    monkeypatch.setattr(treapsearch, "ENTRIES", entries)
    docs, items = tables
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, score int")
    got = treapsearch.rank_documents(d, b, shard=shard, block_bytes=block).collect()
    assert sorted(map(tuple, got), key=repr) == brute.ranked(docs, items)


def test_treaps_have_both_orders():
    rng = np.random.default_rng(2)
    term = rng.integers(0, 5, 400)
    doc = np.concatenate([np.arange(400)])
    imp = rng.integers(1, 30, 400)
    t = treapsearch.Treaps(term, doc, imp, 6)
    assert t.root[5] == -1
    for k in range(5):
        seen = []

        def visit(v, low, high):
            if v < 0:
                return
            assert low < t.doc[v] < high
            visit(t.left[v], low, t.doc[v])
            seen.append(t.doc[v])  # noqa: B023
            visit(t.right[v], t.doc[v], high)
            for c in (t.left[v], t.right[v]):
                assert c < 0 or t.impact[c] <= t.impact[v]

        visit(t.root[k], -1, 400)
        assert seen == sorted(doc[term == k])


def test_split_keeps_intervals():
    rng = np.random.default_rng(4)
    doc = np.sort(rng.choice(200, 80, replace=False))
    imp = rng.integers(1, 50, 80)
    t = treapsearch.Treaps(np.zeros(80, np.int64), doc, imp, 1)
    top = lambda a, b: max([(imp[k], -k) for k in range(80) if a < doc[k] < b], default=(0, 1))
    for _ in range(200):
        lo, at, hi = np.sort(rng.choice(np.arange(-1, 201), 3, replace=False))
        k = -top(lo, hi)[1]
        if k < 0:
            continue
        low, high, hit = t.split(*(np.array([x]) for x in (k, at, lo, hi)))
        assert (low[0], high[0]) == (-top(lo, at)[1], -top(at, hi)[1])
        assert hit[0] == (imp[doc == at][0] if at in doc else 0)


def test_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert treapsearch.rank_documents(docs.limit(0), items).count() == 0
    assert treapsearch.rank_documents(docs, items.limit(0)).count() == 0
    assert [tuple(r)[:3] for r in treapsearch.rank_documents(docs, items).collect()] == [(1, 1, 1)]
