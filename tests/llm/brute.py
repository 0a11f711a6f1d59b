"""Plain versions of the operators, written for small inputs only."""

import hashlib
import re
from collections import Counter


def substrings(docs, size=50):
    first = {}
    for i, t in docs:
        b = (t or "").encode()
        for k in range(len(b) - size + 1):
            g = b[k : k + size]
            first[g] = min(first.get(g, i), i)
    out = {}
    for i, t in docs:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - size + 1):
            if first[b[k : k + size]] < i:
                gone[k : k + size] = [True] * size
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    rep = set()
    for k in range(len(words) - 2):
        if grams[tuple(words[k : k + 3])] > 1:
            rep |= {k, k + 1, k + 2}
    n = len(words)
    failed = n < 50 or 100 * len(rep) > 50 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(rep), failed


def _words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def contamination(docs, bench):
    out = {}
    for i, t in docs:
        w = _words(t)
        hit, items = set(), set()
        for j, b in bench:
            x = _words(b)
            size = min(10, len(x))
            grams = {tuple(x[k : k + size]) for k in range(len(x) - size + 1)} if size else set()
            for k in range(len(w) - size + 1 if size else 0):
                if tuple(w[k : k + size]) in grams:
                    hit |= set(range(k, k + size))
                    items.add(j)
        names = ",".join(sorted(map(str, items)))
        out[i] = (len(w), len(hit), len(items), hashlib.sha256(names.encode()).hexdigest(), bool(hit))
    return out


def bag(text, size=5):
    w = _words(text)
    if not w:
        return Counter()
    return Counter(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1)))


def overlap(a, b):
    return sum((a & b).values()) / sum((a | b).values())


def classes(docs, threshold=0.8):
    label = {i: i for i, _ in docs}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    bags = [(i, t, bag(t)) for i, t in docs]
    for k, (i, t, a) in enumerate(bags):
        for j, u, b in bags[:k]:
            if t == u or (a and b and overlap(a, b) >= threshold):
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in docs}


def rule_matches(found, rules, gap):
    """Every rule at every place, each wanted sentence looked for one by one."""
    used, out = set(), []
    for name, rule in rules:
        for i in range(len(found)):
            chain = []
            for want in rule:
                after = [j for j in range(chain[-1] + 1, len(found)) if found[j][0] - found[chain[-1]][0] <= gap + 1] if chain else [i]
                fit = [j for j in after if found[j][1] == want and j not in used]
                if not fit:
                    break
                chain.append(fit[0])
            else:
                used |= set(chain)
                out.append((name, chain))
    return out


def tree_verdict(model, row):
    """Log-odds of one row, one tree and one node at a time."""
    total = model.bias
    for node in model.roots:
        while model.feature[node] >= 0:
            node = model.child[node] + int(row[model.feature[node]] > model.threshold[node])
        total += model.value[node]
    return total


def cheapest_repair(rows):
    """(cost, audit, roles) by a search over edit letters in the order of cost
    and letters; ``rows``: role initial, must go, truncated."""
    import heapq

    heap = [(0, "", 0, "")]
    while True:
        cost, audit, at, made = heapq.heappop(heap)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", made):
            return cost, audit, made
        if not re.fullmatch("s?(ua)*u?", made) or len(made) > len(rows) + 3:
            continue
        for role in "ua":
            heapq.heappush(heap, (cost + 3, audit + "I", at, made + role))
        if at < len(rows):
            role, must_go, truncated = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, made))
            if not must_go:
                heapq.heappush(heap, (cost + 3 * truncated, audit + "K", at + 1, made + (role or "?")))
                for to in "ua":
                    heapq.heappush(heap, (cost + 3 + 3 * truncated, audit + "R", at + 1, made + to))


def ranked(docs, items, k=20):
    """Item, rank, document and score, every document scored for every item."""
    import math

    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(i, Counter(low(t))) for i, t in docs]
    bags = [(i, c, sum(c.values())) for i, c in bags if c]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(w for _, c, _ in bags for w in c)
    out = []
    for item, text in {(i, t) for i, t in items if t is not None}:
        scores = []
        for i, c, n in bags:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 12 * m)) for w in low(text) if c[w])
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def link_components(docs, percent=80, size=5):
    """Number of shingles and smallest reachable id of each row."""
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    label = list(range(len(docs)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for k, a in enumerate(sets):
        for j in range(k):
            b = sets[j]
            same_id = docs[k][0] is not None and docs[k][0] == docs[j][0]
            near = a and b and 100 * len(a & b) >= percent * len(a | b)
            # a row without an id belongs to equal sets and links nothing
            if same_id or (near and (a == b or None not in (docs[k][0], docs[j][0]))):
                label[find(k)] = find(j)
    best = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            best[find(k)] = min(best.get(find(k), i), i)
    return [(i, len(sets[k]), best.get(find(k))) for k, (i, _) in enumerate(docs)]
