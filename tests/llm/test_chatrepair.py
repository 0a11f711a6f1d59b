"""Conversation repair against a search over all edits, and against itself in other chunks."""

import hashlib
import itertools
import random

import brute
import pytest

from orbisframe.llm import chatrepair

SCHEMA = "conv_id long, turn long, role string, text string, copies long"


def _report(rows):
    got = chatrepair.repair_report(rows, rows).collect()
    return {r["conv_id"]: r for r in got}


def _plain(rows):
    """The expected report of one conversation's rows (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, kinds = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        kinds.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    cost, audit, made = brute.cheapest_repair([(r[1][:1], k in ("blank", "duplicate"), k == "truncated") for r, k in zip(rows, kinds, strict=True)])
    left, out, place = iter(rows), [], 0
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(left)[1:]
        if letter != "D":
            out.append(f"{role if letter == 'K' else {'u': 'user', 'a': 'assistant'}[made[place]]}:{text}")
            place += 1
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    first = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(first))
    return (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


@pytest.fixture(scope="module")
def conversations():
    rng = random.Random(3)
    out = {}
    for conv in range(60):
        rows = []
        for turn in range(rng.randint(1, 6)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", ""])
            text = rng.choice(["Yes.", "No!", "cut off", " \n", "", "Well?\t", f"Answer {turn}."])
            rows.append((rng.choice([turn, turn, turn + 3, None]), role, text))
        out[conv] = rows
    return out


@pytest.mark.parametrize("chunk_rows", [4096, 2])
def test_repair_equals_search(spark, conversations, chunk_rows, monkeypatch):
    monkeypatch.setattr(chatrepair.repair_pieces, "__defaults__", (chatrepair.CHUNK_BYTES, chunk_rows))
    df = spark.createDataFrame([(c, *r, 1) for c, rows in conversations.items() for r in rows], SCHEMA)
    got = _report(df)
    assert {c: tuple(r)[1:] for c, r in got.items()} == {c: _plain(rows) for c, rows in conversations.items()}


def test_walk_in_pieces():
    """Any cut of a long conversation gives the letters of the whole."""
    rng = random.Random(1)
    for _ in range(200):
        rows = [chatrepair.arcs_of(rng.choice(["user", "assistant", "system", "x"]), rng.randrange(4)) for _ in range(rng.randint(1, 9))]
        whole, _, cost = chatrepair.walk(rows, chatrepair.from_start(), chatrepair.to_end(), 0, True)
        at = rng.randrange(len(rows) + 1)
        after = chatrepair._back(chatrepair.matrix(rows[at:]), chatrepair.to_end())
        middle = chatrepair._through(chatrepair.from_start(), chatrepair.matrix(rows[:at]))
        head, state, a = chatrepair.walk(rows[:at], chatrepair.from_start(), after, 0, False)
        tail, _, b = chatrepair.walk(rows[at:], middle, chatrepair.to_end(), state, True)
        assert (head + tail, a, b) == (whole, cost, cost)


def test_long_conversation_and_copies(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.", 2 if t == 700 else 1) for t in range(1500)]
    rows += [(2, 0, "user", "Same.", 3), (None, None, "assistant", "x" * 3_000_000, 1), (None, 5, "user", "Hm.", 1)]
    got = _report(spark.createDataFrame(rows, SCHEMA))
    assert (got[1]["cost"], got[1]["duplicate"], got[1]["gaps"], len(got[1]["audit"])) == (4, 1, 0, 1501)
    assert got[1]["audit"].count("D") == 1 and got[1]["audit"][701] == "D"
    assert (got[2]["audit"], got[2]["cost"]) == ("KDDI", 11)
    assert (got[None]["truncated"], got[None]["gaps"]) == (1, 0)


def test_damage(spark):
    rows = spark.createDataFrame([(c, t, "assistant", "One. Two!") for c in range(20) for t in range(20)], "conv_id long, turn long, role string, text string")
    import zlib

    want = {}
    for c, t in itertools.product(range(20), range(20)):
        fate = zlib.crc32(f"{c}:{t}".encode()) % 20
        if fate:
            want[c, t] = ("user" if fate == 4 else "assistant", "" if fate == 1 else "One Two" if fate == 2 else "One. Two!", 2 if fate == 3 else 1)
    got = {(r[0], r[1]): tuple(r)[2:] for r in chatrepair.damage(rows).collect()}
    assert got == want
    nulls = spark.createDataFrame([(None, None, None, None)], rows.schema)
    assert {tuple(r)[2:4] for r in chatrepair.damage(nulls).collect()} <= {(" ", " "), ("user", " "), (" ", "")}


def test_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert chatrepair.repair_report(none, none).count() == 0
    some = spark.createDataFrame([(4, 0, "user", "Hi.", 1)], SCHEMA)
    (row,) = chatrepair.repair_report(some, none).collect()
    assert tuple(row) == (4, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_repaired_rows(spark):
    rows = spark.createDataFrame([(1, 0, "user", "A.", 1), (1, 1, "user", "B.", 1)], SCHEMA)
    got = [(r["role"], r["text"]) for r in chatrepair.repaired_rows(rows).orderBy("conv_id", "part", "chunk", "place").collect()]
    assert got == [("user", "A."), ("assistant", "B.")]
