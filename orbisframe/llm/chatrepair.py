"""Conversation structure repair by a bidirectional tight-arc graph.

A conversation's roles are legal if their initials read ``(s?(ua)+)?``. Rows
may be kept, given another role, or deleted, and empty turns inserted. The
repairs of a conversation are the paths of a graph whose nodes are (rows read,
state of the role automaton). Minimum costs from the start and to the end say
which arcs lie on a cheapest path (cost so far + arc + cost to go = optimum);
a walk from the start over these arcs alone, with the set of nodes that the
letters so far can have reached, takes the least edit letter at each step.

No task holds a conversation. Rows are sorted by range, so a long conversation
spans many partitions, and are packed in chunks of bounded size. Each chunk is
a min-plus matrix between automaton states; products of these matrices, taken
inside partitions first, give every chunk its costs from the start and to the
end, and with them the chunk settles its part of the walk for each state that
it can be entered in. Only chunks of conversations that may go on in another
chunk take part in these joins. The repaired text's digest is one stream of
bytes by definition: its pieces pass one task in order, one at a time.

Defined results: a null role or text is one space, and so is a null conv_id or
turn in the damage's key; rows are ordered by turn (nulls first), role, text;
equal rows are all rows. Rows with a null conv_id are one conversation. The
initial of an empty role is none, so such a row is never kept as it is. Null
turns don't count for gaps. Conversations without rows are reported with zeros.
An empty table gives no rows. Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbisframe.session import cut

#: Costs of the edits. A truncated row that stays costs TRUNCATED more.
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
#: Text bytes and rows of a chunk at most, one row at least.
CHUNK_BYTES, CHUNK_ROWS = 1 << 20, 4096

#: States of the role automaton: nothing read, system, user, assistant read last.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after the next user or assistant turn, and what a kept role leads to.
NEXT = (USER, USER, ASSISTANT, USER)
KEEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
NAME = {USER: "user", ASSISTANT: "assistant"}
FINAL = (START, ASSISTANT)
LEGAL = frozenset(("su", "ua", "au"))
NEVER = 1 << 60
_SPACE = " \t\n\x0b\x0c\r"

BLANK, DUPLICATE, CUT_SHORT, SOUND = range(4)


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows spoiled by the checksum of
    ``conv_id:turn`` modulo 20: dropped, emptied, without ends of sentences,
    doubled or given to the user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    return rows.where(fate != 0).select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.when(fate == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"),
        F.when(fate == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def row_kind(text: str, seen: bool) -> int:
    """The first fault of a row."""
    body = text.rstrip(_SPACE)
    if not body:
        return BLANK
    if seen:
        return DUPLICATE
    return SOUND if body[-1] in ".!?" else CUT_SHORT


def _arcs(initial: str, kind: int) -> list[list[tuple[str, int, int]]]:
    """For each state the edits of a row: letter, cost, next state."""
    more = TRUNCATED if kind == CUT_SHORT else 0
    out = []
    for s in range(4):
        arcs = [("D", DELETE, s)]
        if kind in (CUT_SHORT, SOUND):
            if s in KEEP.get(initial, {}):
                arcs.append(("K", more, KEEP[initial][s]))
            arcs.append(("R", REROLE + more, NEXT[s]))
        out.append(arcs)
    return out


ARCS = {(i, k): _arcs(i, k) for i in ("s", "u", "a", "") for k in range(4)}


def arcs_of(role: str, kind: int) -> list[list[tuple[str, int, int]]]:
    return ARCS[role[:1] if role[:1] in KEEP else "", kind]


def _inserted(f: list[int]) -> list[int]:
    """Costs from the start, with any number of insertions behind them."""
    f[USER] = min(f[USER], min(f[START], f[SYSTEM], f[ASSISTANT]) + INSERT)
    f[ASSISTANT] = min(f[ASSISTANT], f[USER] + INSERT)
    return f


def _inserting(b: list[int]) -> list[int]:
    """Costs to the end, with any number of insertions before them."""
    b[USER] = min(b[USER], b[ASSISTANT] + INSERT)
    for s in (START, SYSTEM, ASSISTANT):
        b[s] = min(b[s], b[USER] + INSERT)
    return b


def to_end() -> list[int]:
    return _inserting([0 if s in FINAL else NEVER for s in range(4)])


def from_start() -> list[int]:
    return [0 if s == START else NEVER for s in range(4)]


def _step(f: list[int], arcs: list[list[tuple[str, int, int]]]) -> list[int]:
    out = [NEVER] * 4
    for s in range(4):
        for _, c, t in arcs[s]:
            out[t] = min(out[t], f[s] + c)
    return out


def matrix(rows: list) -> list[int]:
    """Cheapest ways through a chunk from each state to each state, flat."""
    out = []
    for s in range(4):
        f = [NEVER] * 4
        f[s] = 0
        for arcs in rows:
            f = _step(_inserted(f), arcs)
        out += f
    return out


def walk(rows: list, before: list[int], after: list[int], entry: int, last: bool) -> tuple[str, int, int]:
    """Letters of the least cheapest repair of a chunk entered in ``entry``,
    the state it's left in, and the optimum. ``before``: costs from the start
    to its first layer; ``after``: costs to the end from its last layer."""
    f = [_inserted(list(before))]
    for arcs in rows:
        f.append(_inserted(_step(f[-1], arcs)))
    b = [list(after)]
    for arcs in reversed(rows):
        b.append(_inserting([min(c + b[-1][t] for _, c, t in arcs[s]) for s in range(4)]))
    b.reverse()
    best = min(x + y for x, y in zip(before, b[0], strict=True))

    def tight(i: int, s: int) -> Iterator[tuple[str, int, int]]:
        """Arcs of a node that lie on a cheapest path."""
        if i < len(rows):
            for letter, c, t in rows[i][s]:
                if f[i][s] + c + b[i + 1][t] == best:
                    yield letter, i + 1, t
        if (i < len(rows) or last) and f[i][s] + INSERT + b[i][NEXT[s]] == best:
            yield "I", i, NEXT[s]

    letters, layer, frontier = [], 0, {entry}
    while arcs := [x for s in frontier for x in tight(layer, s)]:
        least = min(x[0] for x in arcs)
        letters.append(least)
        frontier = {t for letter, _, t in arcs if letter == least}
        layer += least != "I"
    return "".join(letters), min(frontier), best


def apply_edits(audit: str, state: int, roles: list[str], texts: list[str]) -> tuple[list[str], list[str]]:
    """Roles and texts after the edits, from a state of the automaton."""
    out_roles, out_texts, at = [], [], 0
    for letter in audit:
        if letter == "K":
            out_roles.append(roles[at])
            out_texts.append(texts[at])
            state = KEEP[roles[at][:1]][state]
        elif letter != "D":
            state = NEXT[state]
            out_roles.append(NAME[state])
            out_texts.append("" if letter == "I" else texts[at])
        at += letter != "I"
    return out_roles, out_texts


_NUMBERS = ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high")
_CHUNK = "conv_id {id}, part int, chunk int, open boolean, roles array<string>, texts array<string>, kinds array<int>, ways array<long>, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, first string, last string"


class _Chunk:
    def __init__(self, conv: object, chunk: int):
        self.conv, self.chunk, self.bytes = conv, chunk, 0
        self.roles, self.texts, self.kinds, self.turns = [], [], [], []

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        self.roles.append(role)
        self.texts.append(text)
        self.kinds.append(row_kind(text, seen))
        self.turns.append(turn)
        self.bytes += len(text) + len(role)

    def row(self, part: int, is_open: bool) -> tuple:
        first = [r[:1] for r in self.roles]
        turns = [t for t in self.turns if t is not None]
        faults = [self.kinds.count(k) for k in (BLANK, DUPLICATE, CUT_SHORT)]
        illegal = sum(a + b not in LEGAL for a, b in zip(first, first[1:]))  # noqa: B905
        ways = matrix([arcs_of(r, k) for r, k in zip(self.roles, self.kinds, strict=True)])
        span = (turns[0], turns[-1]) if turns else (None, None)
        return (self.conv, part, self.chunk, is_open, self.roles, self.texts, self.kinds, ways, *faults, illegal, len(set(turns)), *span, first[0], first[-1])


def _arrow_schema(kind: pa.DataType) -> pa.Schema:
    names = {"conv_id": kind, "part": pa.int32(), "chunk": pa.int32(), "open": pa.bool_(), "roles": pa.list_(pa.string()), "texts": pa.list_(pa.string()), "kinds": pa.list_(pa.int32()), "ways": pa.list_(pa.int64())}
    return pa.schema([*names.items(), *((n, pa.int64()) for n in _NUMBERS), ("first", pa.string()), ("last", pa.string())])


def chunks(rows: DataFrame, chunk_bytes: int = CHUNK_BYTES, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Sorted rows (conv_id, turn, role, text, copies) packed in chunks of one
    conversation each. ``open`` says that the conversation may have further
    chunks: it has more than one here, or is a partition's first or last one."""
    one = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    key = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    one = one.withColumn("key", key)
    # the order of structs has nulls first, like the order of rows
    seen = one.groupBy("conv_id", "key").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n")).where("n > 1")
    seen = seen.select(F.col("conv_id").alias("_conv"), F.col("key").alias("_key"), "first")
    one = one.join(seen, one["conv_id"].eqNullSafe(seen["_conv"]) & (one["key"] == seen["_key"]), "left")
    later = F.coalesce(F.struct("turn") != F.col("first"), F.lit(False)).alias("later")
    one = one.select("conv_id", "turn", "role", "text", "copies", later)
    # equal beginnings of texts stay together, so whole texts needn't be sampled for the ranges
    one = one.repartitionByRange("conv_id", "turn", F.substring("role", 1, 64), F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")
    one = one.withColumn("part", F.spark_partition_id())
    kind = one.schema["conv_id"].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, first, part, schema, room = None, [], True, 0, None, 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                held.clear()

        for batch in batches:
            schema = schema or _arrow_schema(batch.schema.field("conv_id").type)
            # a slice at a time, so that a batch of long texts isn't held twice
            for begin in range(0, batch.num_rows, 256):
                for conv, turn, role, text, copies, later, part in zip(*(c.to_pylist() for c in batch.slice(begin, 256).columns), strict=True):  # noqa: B020
                    for k in range(copies):
                        if now is None or now.conv != conv:
                            if now is not None:
                                held.append(now.row(part, first or now.chunk > 0))
                                first = False
                            now = _Chunk(conv, 0)
                        elif now.bytes + len(text) > chunk_bytes or len(now.roles) >= chunk_rows:
                            held.append(now.row(part, True))
                            now = _Chunk(conv, now.chunk + 1)
                        now.add(turn, role, text, later or k > 0)
                        room += len(text)
                    if len(held) >= 512 or room > 4 * chunk_bytes:
                        yield from flush()
                        room = 0
        if now is not None:
            held.append(now.row(part, True))
        yield from flush()

    return one.mapInArrow(work, _CHUNK.format(id=kind.simpleString()))


def _product(x: list[int], y: list[int]) -> list[int]:
    return [min(min(x[4 * s + k] + y[4 * k + t] for k in range(4)), NEVER) for s in range(4) for t in range(4)]


def _through(f: list[int], m: list[int]) -> list[int]:
    return [min(min(f[s] + m[4 * s + t] for s in range(4)), NEVER) for t in range(4)]


def _back(m: list[int], b: list[int]) -> list[int]:
    return [min(min(m[4 * s + t] + b[t] for t in range(4)), NEVER) for s in range(4)]


def _scan(table: DataFrame, kind: str) -> DataFrame:
    """(conv_id, part, chunk, before, after, last): from the ``ways`` of all
    chunks the costs of each one's states from the start and to the end. The
    products are taken inside each part first, so a group holds the chunks of
    a part or the parts of a conversation, sixteen numbers each."""
    vectors = "before array<long>, after array<long>, last boolean"

    def whole(g: pd.DataFrame) -> pd.DataFrame:
        ways = g.sort_values("chunk")["ways"].tolist()
        m = [int(x) for x in ways[0]]
        for y in ways[1:]:
            m = _product(m, [int(x) for x in y])
        return pd.DataFrame({"conv_id": g["conv_id"].iloc[:1], "part": g["part"].iloc[:1], "ways": [m]})

    def spread(g: pd.DataFrame, order: str, f: list[int], b: list[int], last: bool) -> pd.DataFrame:
        g = g.sort_values(order)
        ways = [[int(x) for x in y] for y in g["ways"]]
        before, after = [f], [b]
        for m in ways[:-1]:
            before.append(_through(before[-1], m))
        for m in reversed(ways[1:]):
            after.append(_back(m, after[-1]))
        return g.drop(columns="ways").assign(before=before, after=after[::-1], last=[False] * (len(ways) - 1) + [last])

    def over_parts(g: pd.DataFrame) -> pd.DataFrame:
        return spread(g, "part", from_start(), to_end(), True)

    def over_chunks(g: pd.DataFrame) -> pd.DataFrame:
        top = g.iloc[0]
        vector = [[int(x) for x in top[c]] for c in ("f", "b")]
        return spread(g.drop(columns=["f", "b", "z"]), "chunk", *vector, bool(top["z"]))

    parts = table.groupBy("conv_id", "part").applyInPandas(whole, f"conv_id {kind}, part int, ways array<long>")
    parts = parts.groupBy("conv_id").applyInPandas(over_parts, f"conv_id {kind}, part int, {vectors}")
    parts = parts.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), F.col("before").alias("f"), F.col("after").alias("b"), F.col("last").alias("z"))
    joined = table.join(parts, table["conv_id"].eqNullSafe(parts["_conv"]) & (table["part"] == parts["_part"])).drop("_conv", "_part")
    return joined.groupBy("conv_id", "part").applyInPandas(over_chunks, f"conv_id {kind}, part int, chunk int, {vectors}")


def _beside(table: DataFrame, found: DataFrame) -> DataFrame:
    """Columns of ``found`` beside the chunks they belong to."""
    names = ("conv_id", "part", "chunk")
    on: Column = table["conv_id"].eqNullSafe(found["conv_id"]) & (table["part"] == found["part"]) & (table["chunk"] == found["chunk"])
    return table.join(found, on).select(*(table[c] for c in table.columns), *(found[c] for c in found.columns if c not in names))


def _settle(table: DataFrame, entered: str | None, kind: str) -> DataFrame:
    """Pieces of the repair; without ``entered`` each chunk is a conversation."""
    numbers = ("part", "chunk", *_NUMBERS, "first", "last_of")
    columns = ["conv_id", "roles", "texts", "kinds", *(c for c in numbers if c != "last_of"), F.col("last").alias("last_of")] if entered is None else ["conv_id", "roles", "texts", "kinds", *numbers, "before", "after", "final", entered]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                part = batch.slice(begin, 64)
                out = []
                for x in part.select(["roles", "texts", "kinds", *(("before", "after", "final", entered) if entered else ())]).to_pylist():
                    rows = [arcs_of(r, k) for r, k in zip(x["roles"], x["kinds"], strict=True)]
                    vectors = (x["before"], x["after"], x[entered], x["final"]) if entered else (from_start(), to_end(), START, True)
                    audit, _, cost = walk(rows, *vectors)
                    out.append((audit, cost, *apply_edits(audit, vectors[2], x["roles"], x["texts"])))
                audit, cost, roles, texts = zip(*out, strict=True)
                names = ["conv_id", *numbers]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(part.schema.get_field_index(c)) for c in names), pa.array(audit), pa.array(cost, pa.int64()), pa.array(roles, pa.list_(pa.string())), pa.array(texts, pa.list_(pa.string()))],
                    [*names, "audit", "cost", "roles", "texts"],
                )

    schema = f"conv_id {kind}, part int, chunk int, " + ", ".join(f"{n} long" for n in _NUMBERS) + ", first string, last_of string, audit string, cost long, roles array<string>, texts array<string>"
    return table.select(*columns).mapInArrow(work, schema)


def repair_pieces(rows: DataFrame, chunk_bytes: int = CHUNK_BYTES, chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, DataFrame]:
    """The repair of ``rows`` (conv_id, turn, role, text, copies) in pieces:
    those that are whole conversations, and those of conversations of several
    pieces, in the order of (part, chunk). A piece holds the repaired roles
    and texts, its part of the audit, its counts and the whole cost."""
    packed = cut(chunks(rows, chunk_bytes, chunk_rows))
    kind = packed.schema["conv_id"].dataType.simpleString()
    alone = _settle(packed.where("not open"), None, kind)
    rest = packed.where("open").withColumnRenamed("last", "last_of")
    costs = cut(_scan(rest.select("conv_id", "part", "chunk", "ways"), kind)).withColumnRenamed("last", "final")

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A chunk's walk from each state as ``ways`` that cost nothing."""
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                part, out = batch.slice(begin, 64), []
                for x in part.to_pylist():
                    arcs, ways = [arcs_of(r, k) for r, k in zip(x["roles"], x["kinds"], strict=True)], [NEVER] * 16
                    for s in range(4):
                        ways[4 * s + walk(arcs, x["before"], x["after"], s, x["final"])[1]] = 0
                    out.append(ways)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(out, pa.list_(pa.int64()))], ["conv_id", "part", "chunk", "ways"])

    told = _beside(rest, costs)
    ways = told.select("conv_id", "part", "chunk", "roles", "kinds", "before", "after", "final").mapInArrow(exits, f"conv_id {kind}, part int, chunk int, ways array<long>")
    entry = cut(_scan(cut(ways), kind)).select("conv_id", "part", "chunk", (F.array_position("before", F.lit(0).cast("long")) - 1).cast("int").alias("entry"))
    return alone, _settle(_beside(told, entry), "entry", kind)


def repaired_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, part, chunk, place, role, text): the repaired turns; a
    conversation's order is that of (part, chunk, place)."""
    alone, rest = repair_pieces(rows)
    turns = alone.unionByName(rest).select("conv_id", "part", "chunk", F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "turn"))
    return turns.select("conv_id", "part", "chunk", "place", F.col("turn.roles").alias("role"), F.col("turn.texts").alias("text"))


class _Report:
    """One conversation's report, from its pieces in order."""

    def __init__(self, conv: object):
        self.conv, self.count, self.audit, self.cost = conv, [0] * 5, [], 0
        self.low = self.high = self.end = None
        self.hash, self.any = hashlib.sha256(), False

    def add(self, x: dict) -> None:
        for k, name in enumerate(_NUMBERS[:5]):
            self.count[k] += x[name]
        self.count[3] += self.end is not None and self.end + x["first"] not in LEGAL
        if x["low"] is not None:
            self.count[4] -= self.high == x["low"]
            self.low, self.high = x["low"] if self.low is None else self.low, x["high"]
        self.end, self.cost = x["last_of"], x["cost"]
        self.audit.append(x["audit"])
        for role, text in zip(x["roles"], x["texts"], strict=True):
            self.hash.update(("\n" * self.any + f"{role}:{text}").encode())
            self.any = True

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.count[4]
        return (self.conv, gaps, *self.count[:4], self.cost, "".join(self.audit), self.hash.hexdigest())


_REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _stream(pieces: DataFrame, kind: str) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done, conv_type = None, [], None

        def flush() -> pa.RecordBatch:
            kinds = [conv_type, *[pa.int64()] * 6, pa.string(), pa.string()]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], ["conv_id", *_REPORT, "audit", "repaired_sha256"])
            done.clear()
            return out

        for batch in batches:
            conv_type = batch.schema.field("conv_id").type
            for begin in range(0, batch.num_rows, 64):
                for x in batch.slice(begin, 64).to_pylist():
                    if now is None or now.conv != x["conv_id"]:
                        if now is not None:
                            done.append(now.row())
                        now = _Report(x["conv_id"])
                    now.add(x)
                if len(done) >= 512:
                    yield flush()
        if now is not None:
            done.append(now.row())
            yield flush()

    return pieces.mapInArrow(work, f"conv_id {kind}, " + ", ".join(f"{c} long" for c in _REPORT) + ", audit string, repaired_sha256 string")


def repair_report(original: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for each conv_id of ``original``: faults of its ``rows``, cost
    and letters of the cheapest repair, digest of the repaired text."""
    alone, rest = repair_pieces(rows)
    kind = alone.schema["conv_id"].dataType.simpleString()
    ordered = rest.repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk")
    found = _stream(alone, kind).unionByName(_stream(ordered, kind)).withColumnRenamed("conv_id", "_conv")
    every = original.select("conv_id").distinct()
    out = every.join(found, every["conv_id"].eqNullSafe(found["_conv"]), "left")
    return out.select(
        "conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in _REPORT), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
