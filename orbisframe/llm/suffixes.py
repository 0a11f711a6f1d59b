"""Linear suffix grouping, run over many small texts in lockstep.

The construction sorts suffixes into groups by their Lyndon prefix: groups are
taken in descending order; each member's nearest smaller suffix to the left
(its previous-smaller pointer) is the nearest position not yet taken, found in
a linked list from which taken positions are removed; and a pointed-to suffix
moves behind its own group, further the more members of the taken group point
to it. Afterwards the order inside the groups is emitted in one ascending
pass: a suffix that has its place gives the next free place of their groups to
all suffixes whose Lyndon prefix ends where it begins. Nothing is renamed or
sorted again. Both passes are linear; here every step does the current group
of all texts at once in numpy, so the number of Python steps is the length of
the longest text, not the sum.
"""

from __future__ import annotations

import numpy as np

from orbisframe.llm.textvec import ranges


def suffix_arrays(sym: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Suffix arrays of all texts ``sym[off[k]:off[k+1]]``, one after another,
    as positions in ``sym``. Each text must end with a symbol that is its
    smallest and stands nowhere else in it."""
    n, k = len(sym), len(off) - 1
    if not n:
        return np.empty(0, np.int64)
    lengths = np.diff(off)
    text = np.repeat(np.arange(k), lengths)
    # groups by first symbol; a group is named by its first place in the order
    key = text * (int(sym.max()) + 1) + sym
    sa = np.argsort(key.astype(np.int32) if k * 258 < 2**31 else key)
    place = np.empty(n, np.int64)
    place[sa] = np.arange(n)
    head = np.concatenate(([True], key[sa][1:] != key[sa][:-1]))
    start = np.flatnonzero(head)
    group = np.empty(n, np.int64)
    group[sa] = np.repeat(start, np.diff(np.append(start, n)))
    size = np.zeros(n, np.int64)
    size[start] = np.diff(np.append(start, n))

    # the list of positions not yet taken; n and n + 1 stand for "none"
    left, right = np.arange(-1, n + 1), np.arange(1, n + 3)
    left[off[:-1][lengths > 0]] = n
    right[off[1:][lengths > 0] - 1] = n + 1
    ends_at = np.full(n, n + 1)  # where the Lyndon prefix ends
    cur = off[1:].copy()
    live = np.flatnonzero(lengths > 0)
    stop = off[:-1]
    while len(live):
        top = cur[live]
        g = group[sa[top - 1]]
        members = np.sort(sa[ranges(g, top - g)])
        cur[live] = g
        live = live[g > stop[live]]
        ends_at[members] = right[members]
        begin = np.ones(len(members), bool)
        begin[1:] = left[members[1:]] != members[:-1]
        b = np.flatnonzero(begin)
        times = np.diff(np.append(b, len(members)))
        before, after = left[members[b]], right[members[b + times - 1]]
        right[before], left[after] = after, before
        ok = before < n
        p, times = before[ok], times[ok]
        if not len(p):
            continue
        old = group[p]
        order = np.argsort(old * (int(times.max()) + 1) + times)
        p, old, times = p[order], old[order], times[order]
        fresh = np.ones(len(p), bool)
        fresh[1:] = old[1:] != old[:-1]
        f = np.flatnonzero(fresh)
        moved = np.diff(np.append(f, len(p)))
        first = old[f] + size[old[f]] - moved  # first place of the moved part
        size[old[f]] -= moved
        target = np.repeat(first - f, moved) + np.arange(len(p))
        # those that stand in the moved part without being moved change places
        # with the moved ones from before it
        own = place[p]
        away = own < np.repeat(first, moved)
        if away.any():
            taken = np.zeros(len(p), bool)
            inside = own[~away] - np.repeat(first, moved)[~away]
            taken[np.repeat(f, moved)[~away] + inside] = True
            free = sa[target[~taken]]
            holes = own[away]
            sa[holes], place[free] = free, holes
        sa[target], place[p] = p, target
        block = fresh.copy()
        block[1:] |= times[1:] != times[:-1]
        at = np.flatnonzero(block)
        many = np.diff(np.append(at, len(p)))
        group[p] = np.repeat(target[at], many)
        size[target[at]] = many

    # emit: children of j are the suffixes whose Lyndon prefix ends at j
    child = np.argsort(ends_at.astype(np.int32) if n < 2**31 - 2 else ends_at)
    c_off = np.concatenate(([0], np.cumsum(np.bincount(ends_at, minlength=n + 2)[: n + 1])))
    front = np.arange(n)
    out = np.empty(n, np.int64)
    by_length = np.argsort(-lengths, kind="stable")
    by_length = by_length[lengths[by_length] > 0]
    base, size_of = off[:-1][by_length], lengths[by_length]
    out[base] = off[1:][by_length] - 1
    n_live = len(base)
    for t in range(int(size_of[0]) if n_live else 0):
        while n_live and size_of[n_live - 1] <= t:
            n_live -= 1
        j = out[base[:n_live] + t]
        s = child[ranges(c_off[j], c_off[j + 1] - c_off[j])]
        g = group[s]
        out[front[g]] = s
        front[g] += 1
    return out


def equal_run_ids(data: np.ndarray, sa: np.ndarray, text: np.ndarray, room: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the suffixes with at least ``size`` symbols of room, in suffix order:
    their positions and the number of the run of suffixes that agree in their
    first ``size`` symbols. ``text`` and ``room`` are by position."""
    at = sa[room[sa] >= size]
    if not len(at):
        return at, at
    same = text[at[1:]] == text[at[:-1]]
    pair = np.flatnonzero(same)
    for d in range(size):
        if not len(pair):
            break
        pair = pair[data[at[pair] + d] == data[at[pair + 1] + d]]
    fresh = np.ones(len(at), bool)
    fresh[pair + 1] = False
    return at, np.cumsum(fresh) - 1
