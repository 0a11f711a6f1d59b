"""The similarity join against all pairs, and its filters against their promise."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orbisframe.llm import neardup, setjoin
from orbisframe.llm.textvec import Texts


def _edited(rng, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def _prose(rng, n):
    return " ".join(f"w{rng.randrange(500)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    base = [_prose(rng, rng.randint(5, 200)) for _ in range(30)]
    passage = _prose(rng, 40)
    out = list(enumerate(base))
    out += [(100 + k, _edited(rng, base[k % 30], 1 + k // 30)) for k in range(90)]
    out += [(300 + k, _prose(rng, rng.randint(3, 40)) + " " + passage) for k in range(60)]
    out += [(400 + k, base[2].upper().replace(" ", "\t ")) for k in range(30)]
    out += [(500, None), (501, ""), (502, " \n"), (503, "one"), (504, "ONE"), (505, "a b c d"), (506, "a b c d e"), (507, "x " * 30000)]
    out += [(None, base[4]), (None, "nobody else says this at all"), (None, "nobody else says this at all"), (None, None)]
    out += [(7, base[9]), (8, base[8]), (8, base[8]), (11, ""), (12, "only here and with no one else")]
    return out


def _got(spark, rows, **k):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, node int, keys string")
    return sorted(map(tuple, setjoin.join_components(docs, **k).collect()), key=repr)


@pytest.mark.parametrize("sizes", [{}, {"batch_bytes": 3000, "range_bytes": 5000}])
def test_components(spark, rows, sizes):
    assert _got(spark, rows, **sizes) == sorted(brute.link_components(rows), key=repr)


def test_family(spark, monkeypatch):
    """Chains of edits: links lead through sets that don't link with the first."""
    monkeypatch.setattr(neardup, "PART", 3000)
    rng = random.Random(5)
    text, rows = _prose(rng, 100), []
    for k in range(150):
        rows.append((1000 - k, text if k % 3 else _edited(rng, text, rng.randint(1, 6))))
        if k % 10 == 9:
            text = _edited(rng, text, 2)
    assert _got(spark, rows) == sorted(brute.link_components(rows), key=repr)


def test_filters_lose_no_link():
    """Any two linked sets share what each order's filter asks for."""
    rng = np.random.default_rng(1)
    for _ in range(2000):
        n = int(rng.integers(1, 120))
        x = np.unique(rng.integers(0, 2**62, n).astype(np.uint64))
        y = np.unique(np.concatenate((x[rng.random(len(x)) > rng.random() * 0.25], rng.integers(0, 2**62, int(rng.integers(0, n // 8 + 1))).astype(np.uint64))))
        same = setjoin._common(x, y)
        if not len(y) or 100 * same < 80 * (len(x) + len(y) - same):
            continue
        heads = [a[: setjoin.prefix_length(np.array([len(a)]), 80)[0]] for a in (x, y)]
        shared = setjoin._common(*heads)
        assert shared >= 1 + min(len(x), len(y)) // setjoin.EXTRA
        assert shared >= max(setjoin.need(len(x), 80), setjoin.need(len(y), 80))


def test_sets_of_texts():
    t = Texts(pa.array(["A b  c\td e f", "a b c d e F", None, "x", "a b c d e f a b c d e f"], pa.string()))
    keys, off = setjoin.shingle_sets(t, 5)
    assert np.diff(off).tolist() == [2, 2, 0, 1, 6]
    nodes = setjoin.set_nodes(keys, off)
    assert nodes[0] == nodes[1] != 0 and nodes[2] == 0


def test_no_rows(spark):
    assert setjoin.join_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_counts_take_one_exchange_each(spark):
    rows = [(k, n, 4) for n, keys in ((1, "abcd"), (2, "abcx"), (3, "y"), (4, "ay")) for k in map(ord, keys)]
    got = setjoin._thinned(spark.createDataFrame(rows, "key long, node long, n long"), 80)
    assert {tuple(r) for r in got.select("key", "node", "df", "r").collect()} == {(97, 1, 3, 3), (98, 1, 2, 3), (99, 1, 2, 3), (97, 2, 3, 3), (98, 2, 2, 3), (99, 2, 2, 3), (121, 4, 2, 2), (97, 4, 3, 2)}
    text = got._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 2 and "Join" not in text, text


def test_only_wanted_texts_are_dealt(spark):
    """The filter keeps every wanted row and drops most others."""
    docs = spark.createDataFrame([(k, "text") for k in range(5000)] + [(None, "text"), (30, "other")], "doc_id int, text string")
    wanted = spark.range(0, 5000, 100).select(F.col("id").alias("doc_id"), F.col("id").alias("want"))
    got = setjoin._likely(docs, wanted)
    ids = [r.doc_id for r in got.collect()]
    assert got.columns == ["doc_id", "text"] and {*range(0, 5000, 100)} <= set(ids) and len(ids) < 60
    assert len(setjoin._likely(docs, wanted, 1).collect()) == 5002  # a filter that is full lets all pass
    assert setjoin._likely(docs, wanted.limit(0)).isEmpty()


def _crossed(spark, monkeypatch, groups, sets):
    """Components by _cross, and the rows of sets that it has sent."""
    sent, plain = [], neardup._across
    monkeypatch.setattr(neardup, "PART", 1000)
    monkeypatch.setattr(neardup, "_across", lambda member, *a: sent.append(member.agg(F.sum("parts")).first()[0] or 0) or plain(member, *a))
    grouped = spark.createDataFrame([(k, y, len(sets[y])) for k, g in enumerate(groups) for y in g], "key long, y long, size int")
    bags = spark.createDataFrame([(y, sorted(x), [1] * len(x)) for y, x in sets.items()], "doc_id long, ids array<long>, counts array<int>")
    got = setjoin._cross(grouped, spark.createDataFrame([], "node long, label long"), bags, 80)
    return {frozenset(r.ys) for r in got.groupBy("label").agg(F.collect_set("node").alias("ys")).collect() if len(r.ys) > 1}, sum(sent)


def _linked(groups, sets):
    of = {y: {y} for y in sets}
    for g in groups:
        for x in g:
            for y in g:
                if of[x] is not of[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                    of[x] |= of[y]
                    for z in of[y]:
                        of[z] = of[x]
    return {frozenset(v) for v in of.values() if len(v) > 1}


def _alike(rng, ids, low, shared, apart):
    """Sets with ``shared`` numbers of all; most have ``apart`` own ones, so they don't link, every sixth links with the one before."""
    out = {}
    for k in ids:
        out[k] = out[k - 1] - {min(out[k - 1])} if k % 6 == 5 else {*range(low, low + shared)} | {rng.randrange(10**12, 10**15) for _ in range(apart)}
    return out


def test_family_of_many_groups_is_sent_once_a_part(spark, monkeypatch):
    """40 sets, 4000 numbers and 4 parts, in 30 groups that lack one or two of them each."""
    rng = random.Random(3)
    sets = _alike(rng, range(40), 0, 60, 40)
    groups = [[y for y in sets if y not in (k, k // 2)] for k in range(30)]
    got, sent = _crossed(spark, monkeypatch, groups, sets)
    assert got == _linked(groups, sets) and got
    assert sent == 160, sent


def test_groups_of_a_long_family_join_their_widest(spark, monkeypatch):
    """A chain of 12 places, 8 nearly equal groups in each: too long to be compared whole, but each place is."""
    rng = random.Random(4)
    sets, groups = {}, []
    for k in range(12):
        own = list(range(10 * k, 10 * k + 10))
        sets |= _alike(rng, own, 1000 * k, 60, 39)
        groups += [own] + [[y for y in own if y != own[j]] for j in range(7)]
    groups += [[10 * k + 9, 10 * k + 10] for k in range(11)]
    got, sent = _crossed(spark, monkeypatch, groups, sets)
    assert got == _linked(groups, sets) and len(got) >= 12
    assert sent <= 250, sent


def test_star_of_groups_is_left_to_them(spark, monkeypatch):
    """Groups that each have half of a wide one: no block is cheaper, and no link is lost or made up."""
    rng = random.Random(6)
    sets = _alike(rng, range(60), 0, 50, 40)
    groups = [list(range(11))] + [[*rng.sample(range(11), 6), *range(11 + 4 * k, 15 + 4 * k)] for k in range(12)]
    got, sent = _crossed(spark, monkeypatch, groups, sets)
    least, most = _linked(groups, sets), _linked([list(sets)], sets)
    assert least and all(any(a <= b for b in got) for a in least) and all(any(a <= b for b in most) for a in got)
    assert sent <= sum(map(len, groups)), sent
