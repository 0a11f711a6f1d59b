"""Exact substring dedup with suffix arrays, spread over the cluster.

A byte goes if a string of ``size`` bytes that covers it also starts in a
document with a smaller id. No task can hold the corpus's suffix array, so the
texts are cut into segments that need each other only: every window of
``size`` bytes has an anchor, the smallest-hashed ``gram``-byte string in it,
equal windows have equal anchors, and a segment is a run of windows with one
anchor. Segments are shuffled by anchor, and each anchor's segments get a
suffix array by linear grouping (``suffixes``), in which equal windows are
neighbours.

1. Documents are dealt into batches by hashed id, of a size set by the input.
2. Each batch lists its anchors, four bytes each; anchors in one document only
   are found and go no further.
3. Segments of shared anchors, once per batch with their smallest document,
   meet by anchor; suffix arrays tell which windows start in a smaller one.
4. The answers return to the batch as one bit a window.

An anchor with very many different surroundings is hot: it is split by the
widest anchor there is, the window itself, so that no task gets it all. An
anchor whose segments are long together is split by wider anchors inside its
task. Nothing is dropped: anchors only decide what meets, bytes decide what is
equal. A segment that no other one meets has nothing to be compared with.

Defined results: a null text is empty; a text under ``size`` bytes loses
nothing, however long a text is, it is one row of its batch; rows with a null
doc_id rank as the largest id, 2**63 - 1, which no other row has; rows that
share a doc_id, or have none, don't count against each other, and each gives a
row. An empty table gives no rows. Only doc_id and text are read, so further
columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbisframe.llm.suffixes import equal_run_ids, suffix_arrays
from orbisframe.llm.textvec import Texts, equal_spans, member, mix, prefix_sums, ranges, span_hashes, trim

SIZE, GRAM = 50, 20
#: Text bytes of one batch, and segment bytes of one bucket, in about.
BATCH_BYTES, BUCKET_BYTES = 12 << 20, 6 << 20
#: Text bytes worked on at once inside a batch.
PART_BYTES = 1 << 20
#: Different surroundings (per batch, summed) from which an anchor is hot.
HOT = 3000
#: Rank of rows without an id.
_LAST = 2**63 - 1


def segments(t: Texts, size: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Segments by parts of the batch: key, start byte, number of windows,
    text, hash of the segment's bytes, and the part with its first byte."""
    wide = size - gram + 1
    for first_text, p in t.parts(PART_BYTES):
        n = len(p.data)
        windows = ranges(p.off[:-1], np.maximum(p.lengths - size + 1, 0))
        if not len(windows):
            continue
        h = p.hashes(np.arange(n - gram + 1), np.arange(gram, n + 1))
        best = (h & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(n - gram + 1, dtype=np.uint64))
        span = 1
        while span * 2 <= wide:
            best = np.minimum(best[:-span], best[span:])
            span *= 2
        if span < wide:
            best = np.minimum(best[: n - size + 1], best[wide - span : wide - span + n - size + 1])
        anchor = best[windows] & np.uint64(0xFFFFFFFF)
        head = np.zeros(n, bool)
        head[p.off[:-1][p.lengths > 0]] = True
        new = np.ones(len(windows), bool)
        np.not_equal(anchor[1:], anchor[:-1], out=new[1:])
        new[1:] |= head[windows[1:]]
        b = np.flatnonzero(new)
        key, start = h[(np.uint64(0xFFFFFFFF) - anchor[b]).astype(np.int64)], windows[b]
        count = np.diff(np.append(b, len(windows)))
        text = np.searchsorted(p.off, start, side="right") - 1
        base = int(t.off[first_text])
        yield key, start + base, count, text + first_text, p.hashes(start, start + count + (size - 1)), (p, base)


def _bucket(key: np.ndarray, n: int) -> np.ndarray:
    return ((key >> np.uint64(34)) % np.uint64(n)).astype(np.int64)


def _low(key: np.ndarray) -> np.ndarray:
    return (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _read(table: pa.Table) -> tuple[Texts, np.ndarray, np.ndarray]:
    """A batch in a fixed order, by doc_id, nulls last, then text: the texts,
    their ranks, and which of them have no doc_id."""
    trim()
    table = table.select(["doc_id", "text"]).sort_by([("doc_id", "ascending"), ("text", "ascending")])
    ids = table.column("doc_id").combine_chunks()
    ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) and ids.num_chunks else ids
    return Texts(table.column("text")), np.asarray(pa.compute.fill_null(ids, _LAST)), np.asarray(ids.is_null())


def _code(key: np.ndarray, n_buckets: int) -> np.ndarray:
    return (_bucket(key, n_buckets).astype(np.uint64) << np.uint64(32)) | _low(key)


def _anchor_lists(n_buckets: int, size: int, gram: int):
    def work(key: tuple, table: pa.Table) -> pa.Table:
        t, ids, _ = _read(table)
        rows: dict[str, list] = {"bucket": [], "batch": [], "lows": [], "multi": [], "weights": []}
        got = [(_code(k, n_buckets), seg, ids[text]) for k, _, _, text, seg, _ in segments(t, size, gram)]
        if got:
            code, seg, doc = (np.concatenate(x) for x in zip(*got, strict=True))
            del got
            order = np.argsort(code)
            c, g, d = code[order], seg[order], doc[order]
            head = np.concatenate(([True], c[1:] != c[:-1]))
            b = np.flatnonzero(head)
            size_of = np.diff(np.append(b, len(c)))
            multi = np.zeros(len(b), bool)
            weight = np.ones(len(b), np.uint8)
            many = np.flatnonzero(size_of > 1)
            if len(many):  # anchors that the batch holds more than once: few
                at = ranges(b[many], size_of[many])
                own = np.repeat(np.arange(len(many)), size_of[many])
                f = np.cumsum(size_of[many]) - size_of[many]
                multi[many] = np.minimum.reduceat(d[at], f) != np.maximum.reduceat(d[at], f)
                o = np.lexsort((g[at], own))
                other = np.ones(len(at), np.int64)
                other[1:] = (own[o][1:] != own[o][:-1]) | (g[at][o][1:] != g[at][o][:-1])
                weight[many] = np.minimum(np.add.reduceat(other, f), 255)
            c = c[b]
            of = (c >> np.uint64(32)).astype(np.int64)
            cut = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            low = (c & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            for x, y in zip(cut, np.append(cut[1:], len(c)), strict=True):
                rows["bucket"].append(int(of[x])), rows["batch"].append(key[0].as_py())
                rows["lows"].append(low[x:y].tobytes()), rows["multi"].append(np.packbits(multi[x:y]).tobytes()), rows["weights"].append(weight[x:y].tobytes())
        return pa.table({k: pa.array(v, pa.int64() if k in ("bucket", "batch") else pa.binary()) for k, v in rows.items()})

    return work


def _shared(key: tuple, table: pa.Table) -> pa.Table:
    """Of a bucket's anchors, those in two documents at least; hot ones marked."""
    trim()
    batch = np.asarray(table.column("batch").combine_chunks())
    lows = [np.frombuffer(x, np.uint32) for x in table.column("lows").to_pylist()]
    multi = [np.unpackbits(np.frombuffer(m, np.uint8), count=len(x)).astype(bool) for m, x in zip(table.column("multi").to_pylist(), lows, strict=True)]
    weights = [np.frombuffer(x, np.uint8) for x in table.column("weights").to_pylist()]
    every = np.concatenate(lows)
    order = np.argsort(every, kind="stable")
    v = every[order]
    b = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
    many = np.diff(np.append(b, len(v))) > 1
    yes = many | np.logical_or.reduceat(np.concatenate(multi)[order], b)
    hot = np.add.reduceat(np.concatenate(weights)[order].astype(np.int64), b) > HOT
    keep, is_hot = v[b][yes], hot[yes]
    out = {"batch": [], "bucket": [], "lows": [], "hot": []}
    for k, own in zip(batch.tolist(), lows, strict=True):
        mine = own[member(own, keep)]
        if len(mine):
            out["batch"].append(k), out["bucket"].append(key[0].as_py()), out["lows"].append(mine.tobytes())
            out["hot"].append(np.packbits(is_hot[np.searchsorted(keep, mine)]).tobytes())
    return pa.table({k: pa.array(v, pa.int64() if k in ("bucket", "batch") else pa.binary()) for k, v in out.items()})


class Local:
    """Distinct shared segments of a batch, in an order that depends on the
    batch's texts and shared anchors only; hot anchors give single windows."""

    def __init__(self, t: Texts, ids: np.ndarray, shared: pa.Table, n_buckets: int, size: int, gram: int):
        codes, hots = [np.empty(0, np.uint64)], [np.empty(0, bool)]
        for bucket, lows, hot in zip(*(shared.column(k).to_pylist() for k in ("bucket", "lows", "hot")), strict=True):
            low = np.frombuffer(lows, np.uint32)
            codes.append((np.uint64(bucket) << np.uint64(32)) | low.astype(np.uint64))
            hots.append(np.unpackbits(np.frombuffer(hot, np.uint8), count=len(low)).astype(bool))
        code, hot = np.concatenate(codes), np.concatenate(hots)
        order = np.argsort(code)
        code, hot = code[order], hot[order]
        parts = []
        for key, start, count, text, seg, (p, base) in segments(t, size, gram) if len(code) else ():
            own = _code(key, n_buckets)
            at = np.searchsorted(code, own)
            at[at == len(code)] = 0
            yes = code[at] == own
            is_hot = yes & hot[at]
            some = yes & ~is_hot
            parts.append((key[some], start[some], count[some], text[some], seg[some]))
            if is_hot.any():
                w = ranges(start[is_hot] - base, count[is_hot])
                h = p.hashes(w, w + size)
                parts.append((mix(h), w + base, np.ones(len(w), np.int64), np.repeat(text[is_hot], count[is_hot]), h))
        self.group = self.rep = self.start = self.count = self.doc = np.empty(0, np.int64)
        self.key = np.empty(0, np.uint64)
        if not sum(len(x[0]) for x in parts):
            return
        self.key, self.start, self.count, self.doc, seg = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        order = np.argsort(mix(self.key ^ mix(seg)), kind="stable")  # equal segments stay in the order of their texts
        for k in ("key", "start", "count", "doc"):
            setattr(self, k, getattr(self, k)[order])
        seg = seg[order]
        fresh = np.concatenate(([True], (self.key[1:] != self.key[:-1]) | (seg[1:] != seg[:-1])))
        copy, of = np.flatnonzero(~fresh), np.cumsum(fresh) - 1
        first = np.flatnonzero(fresh)[of[copy]]
        alike = self.count[copy] == self.count[first]
        alike[alike] = equal_spans(t.data, self.start[copy[alike]], self.start[first[alike]], self.count[copy[alike]] + (size - 1))
        if not alike.all():  # a clash of hashes: each of these is a segment of its own
            fresh |= member(of, np.unique(of[copy[~alike]]))
        self.group = np.cumsum(fresh) - 1
        self.rep = np.flatnonzero(fresh)  # texts are in the order of doc_id, so the first has the smallest


def _segment_rows(n_buckets: int, n_groups: int, size: int, gram: int):
    def work(key: tuple, docs: pa.Table, shared: pa.Table) -> pa.Table:
        out: dict[str, list] = {"bucket": [], "batch": [], "idx": [], "key": [], "len": [], "doc": [], "raw": []}
        if docs.num_rows and shared.num_rows:
            t, ids, _ = _read(docs)
            x = Local(t, ids, shared, n_buckets, size, gram)
            if len(x.rep):
                k, start, length, doc = x.key[x.rep], x.start[x.rep], x.count[x.rep] + (size - 1), ids[x.doc[x.rep]]
                bucket = ((k >> np.uint64(20)) % np.uint64(n_groups)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                b = np.flatnonzero(np.concatenate(([True], bucket[order][1:] != bucket[order][:-1])))
                for lo, hi in zip(b, np.append(b[1:], len(order)), strict=True):
                    o = order[lo:hi]
                    out["bucket"].append(int(bucket[o[0]])), out["batch"].append(key[0].as_py())
                    out["idx"].append(o.astype(np.uint32).tobytes()), out["key"].append(k[o].tobytes())
                    out["len"].append(length[o].astype(np.uint16).tobytes()), out["doc"].append(doc[o].tobytes())
                    out["raw"].append(t.data[ranges(start[o], length[o])].tobytes())
        return pa.table({k: pa.array(v, pa.int64() if k in ("bucket", "batch") else pa.binary()) for k, v in out.items()})

    return work


def distinct_segments(key: np.ndarray, seg: np.ndarray, raw: np.ndarray, start: np.ndarray, length: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One segment of each set of equal ones with one key, the one with the
    smallest document, and for each segment its number. ``seg`` (a hash)
    brings equal segments together; bytes decide."""
    order = np.lexsort((doc, seg, key))
    fresh = np.concatenate(([True], (key[order][1:] != key[order][:-1]) | (seg[order][1:] != seg[order][:-1])))
    first = order[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    copy = np.flatnonzero(~fresh)
    a, b = order[copy], first[copy]
    same = length[a] == length[b]
    same[same] = equal_spans(raw, start[a[same]], start[b[same]], length[a[same]])
    rep_of = order.copy()
    rep_of[copy[same]] = first[copy[same]]  # a clash of hashes stays a segment of its own
    rep, of = np.unique(rep_of, return_inverse=True)
    out = np.empty(len(key), np.int64)
    out[order] = of
    return rep, out


def split_segments(raw: np.ndarray, prefix: np.ndarray, start: np.ndarray, length: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, ...]:
    """Each segment's runs of windows with one wider anchor: hash of that
    anchor, parent segment, first window of it, number of windows."""
    count = length - size + 1
    at = ranges(start, count)
    best, where = np.full(len(at), np.uint64(2**64 - 1)), np.zeros(len(at), np.int64)
    for k in range(size - gram + 1):
        h = span_hashes(prefix, at + k, at + k + gram)
        less = h < best
        best[less], where[less] = h[less], (at + k)[less]
    parent = np.repeat(np.arange(len(start)), count)
    new = np.concatenate(([True], (where[1:] != where[:-1]) | (parent[1:] != parent[:-1])))
    b = np.flatnonzero(new)
    parent = parent[b]
    return best[b], parent, at[b] - start[parent], np.diff(np.append(b, len(at)))


def window_owners(key: np.ndarray, raw: np.ndarray, start: np.ndarray, length: np.ndarray, doc: np.ndarray, size: int, wider: tuple[int, ...] = (35, 50), most: int = 1 << 20, long: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """Smallest document of every window of every segment, flat, and offsets.

    Different segments with one key form one text for the suffix array, each
    closed by a separator; one alone has nothing to be compared with. A text
    longer than ``long`` is split by wider anchors, as the corpus was split by
    anchors, into several texts: equal windows have equal wider anchors."""
    n = len(key)
    windows = length - size + 1
    off = np.concatenate(([0], np.cumsum(windows)))
    if not n:
        return np.empty(0, np.int64), off
    prefix = prefix_sums(raw)
    rep, of = distinct_segments(key, span_hashes(prefix, start, start + length), raw, start, length, doc)
    rep = rep[by_key := np.argsort(key[rep], kind="stable")]
    place = np.empty(len(rep), np.int64)
    place[by_key] = np.arange(len(rep))
    k, s, ln, d = key[rep], start[rep], length[rep], doc[rep]
    w = np.cumsum(windows[rep]) - windows[rep]
    owner = np.repeat(d, windows[rep])
    head = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    n_of = np.diff(np.append(head, len(k)))
    text_len = np.add.reduceat(ln + 1, head) + 1
    wide = (text_len > long) & (n_of > 1) & bool(wider)
    if wide.any():
        x = np.flatnonzero(np.repeat(wide, n_of))
        anchor, parent, first, count = split_segments(raw, prefix, s[x], ln[x], size, wider[0])
        parent = x[parent]
        inner, _ = window_owners(mix(anchor ^ mix(k[parent])), raw, s[parent] + first, count + (size - 1), d[parent], size, wider[1:], most, long)
        owner[ranges(w[parent] + first, count)] = inner
    small = np.flatnonzero((n_of > 1) & ~wide)
    rank = small[np.argsort(text_len[small], kind="stable")]
    total = np.cumsum(text_len[rank])
    done = 0
    while done < len(rank):
        base = total[done - 1] if done else 0
        upto = max(done + 1, int(np.searchsorted(total, base + most, side="right")))
        texts = rank[done:upto]
        done = upto
        seg = ranges(head[texts], n_of[texts])
        _one_batch(raw, s[seg], ln[seg], np.repeat(np.arange(len(texts)), n_of[texts]), d[seg], w[seg], size, owner)
    return owner[ranges(w[place[of]], windows)], off


def _one_batch(raw: np.ndarray, start: np.ndarray, length: np.ndarray, text: np.ndarray, doc: np.ndarray, where: np.ndarray, size: int, owner: np.ndarray) -> None:
    last = np.append(text[1:] != text[:-1], True)
    span = length + 1 + last
    end = np.cumsum(span)
    begin = end - span
    sym = np.zeros(int(end[-1]), np.int16)
    sym[ranges(begin, length)] = raw[ranges(start, length)].astype(np.int16) + 2
    sym[begin + length] = 1
    off = np.concatenate(([0], end[last]))
    sa = suffix_arrays(sym, off)
    room = np.zeros(len(sym), np.int64)
    inside = ranges(begin, length)
    room[inside] = np.repeat(begin + length, length) - inside
    of = np.repeat(np.arange(len(off) - 1), np.diff(off))
    at, run = equal_run_ids(sym, sa, of, room, size)
    if not len(at):
        return
    seg = np.searchsorted(begin, at, side="right") - 1
    low = np.full(int(run[-1]) + 1, _LAST)
    np.minimum.at(low, run, doc[seg])
    owner[where[seg] + (at - begin[seg])] = low[run]


def _answers(size: int):
    def work(key: tuple, table: pa.Table) -> pa.Table:
        trim()
        cols = {k: table.column(k).to_pylist() for k in ("batch", "idx", "key", "len", "doc", "raw")}
        idx = [np.frombuffer(x, np.uint32) for x in cols["idx"]]
        k, ln, d = (np.concatenate([np.frombuffer(x, kind) for x in cols[c]]) for c, kind in (("key", np.uint64), ("len", np.uint16), ("doc", np.int64)))
        raw, ln = np.frombuffer(b"".join(cols["raw"]), np.uint8), ln.astype(np.int64)
        start = np.cumsum(ln) - ln
        owner, _ = window_owners(k, raw, start, ln, d, size)
        count = ln - size + 1
        bit = ranges(np.zeros(len(k), np.int64), count).astype(np.uint64)
        later = (owner < np.repeat(d, count)).astype(np.uint64) << bit
        first = np.cumsum(count) - count
        mask = np.bitwise_or.reduceat(later, first)
        out = {"batch": [], "idx": [], "mask": []}
        lo = 0
        for b, i in zip(cols["batch"], idx, strict=True):
            m = mask[lo : lo + len(i)]
            lo += len(i)
            if m.any():
                out["batch"].append(b), out["idx"].append(i[m != 0].tobytes()), out["mask"].append(m[m != 0].tobytes())
        return pa.table({"batch": pa.array(out["batch"], pa.int64()), "idx": pa.array(out["idx"], pa.binary()), "mask": pa.array(out["mask"], pa.binary())})

    return work


def _finish(n_buckets: int, size: int, gram: int):
    def work(key: tuple, docs: pa.Table, told: pa.Table) -> pa.Table:
        t, ids, no_id = _read(docs)
        gone = begins = np.zeros(len(t.data), bool)
        is_answer = told.column("bucket").combine_chunks().is_null()
        shared = told.filter(pa.compute.invert(is_answer))
        x = Local(t, ids, shared, n_buckets, size, gram)
        if len(x.rep):
            mask = np.zeros(len(x.rep), np.uint64)
            answers = told.filter(is_answer)
            for i, m in zip(answers.column("lows").to_pylist(), answers.column("hot").to_pylist(), strict=True):
                mask[np.frombuffer(i, np.uint32)] = np.frombuffer(m, np.uint64)
            doc = ids[x.doc]
            whole = doc > doc[x.rep][x.group]  # a copy of the batch's first: all of its windows go
            m = np.where(whole, np.uint64(2**64 - 1), mask[x.group])
            some = m != 0
            where, step = np.flatnonzero(some), 1 << 17
            for lo in range(0, len(where), step):
                w = where[lo : lo + step]
                at = ranges(x.start[w], x.count[w])
                bit = ranges(np.zeros(len(w), np.int64), x.count[w]).astype(np.uint64)
                begins[at[(np.repeat(m[w], x.count[w]) >> bit) & np.uint64(1) > 0]] = True
            del x
            # a byte goes if a found window begins at it or up to size - 1 bytes before
            gone, span = begins, 1
            while span < size:
                more = min(span, size - span)
                wide = gone.copy()
                wide[more:] |= gone[:-more]
                gone, span = wide, span + more
        starts, ends, first = t.runs(gone)
        n_removed, raw, digest = t.per_text(gone), memoryview(t.data.tobytes()), []
        so, eo = starts.tolist(), ends.tolist()
        for d in range(t.n):
            h, at = hashlib.sha256(), int(t.off[d])
            for r in range(first[d], first[d + 1]):
                h.update(raw[at : so[r]])
                at = eo[r]
            h.update(raw[at : int(t.off[d + 1])])
            digest.append(h.hexdigest())
        base = np.repeat(t.off[:-1], np.diff(first))
        off = pa.array(first.astype(np.int32))
        return pa.table({
            "doc_id": pa.array(ids, mask=no_id), "n_bytes": t.lengths, "n_removed": n_removed,
            "n_spans": np.diff(first).astype(np.int64), "kept_sha256": digest,
            "span_starts": pa.ListArray.from_arrays(off, pa.array((starts - base).astype(np.int64))),
            "span_ends": pa.ListArray.from_arrays(off, pa.array((ends - base).astype(np.int64))),
        })

    return work


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, span_starts array<long>, span_ends array<long>"


def dedup_substrings(docs: DataFrame, size: int = SIZE, gram: int = GRAM, batch_bytes: int = BATCH_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per document with its removed spans (byte offsets)."""
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    n_batches = max(1, -(-total // batch_bytes))
    n_buckets = max(1, -(-total // (6 * batch_bytes)))
    n_groups = max(1, -(-total // bucket_bytes))
    base = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_batches)).alias("batch"))
    by_batch = lambda frame: frame.groupBy("batch")
    anchors = by_batch(base).applyInArrow(_anchor_lists(n_buckets, size, gram), "bucket long, batch long, lows binary, multi binary, weights binary")
    shared = anchors.groupBy("bucket").applyInArrow(_shared, "batch long, bucket long, lows binary, hot binary")
    rows = by_batch(base).cogroup(by_batch(shared)).applyInArrow(
        _segment_rows(n_buckets, n_groups, size, gram), "bucket long, batch long, idx binary, key binary, len binary, doc binary, raw binary"
    )
    answers = rows.groupBy("bucket").applyInArrow(_answers(size), "batch long, idx binary, mask binary")
    told = shared.unionByName(answers.select("batch", F.lit(None).cast("long").alias("bucket"), F.col("idx").alias("lows"), F.col("mask").alias("hot")))
    return by_batch(base).cogroup(by_batch(told)).applyInArrow(_finish(n_buckets, size, gram), RESULT)
