"""Plain Python versions of the join operators, for small tables."""

import re
from collections import defaultdict

import duckdb


def distance_within(a, b, most):
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1] <= most


def normal(line):
    return re.sub(r"[\x20\x09\x0b-\x0d]+", " ", line).lower().strip(" ")


def line_removals(rows, edits, least=24, order=lambda d: (d[0] is None, d[0] or 0), short=False):
    """(id, text) -> (exact places, near places), for rows of (id, text).  ``edits`` None: one, and one more for
    every 64 characters of the shorter line, up to 3.  ``short``: shorter lines with a word match exactly."""
    def reach(x, y):
        return edits if edits is not None else min(3, 1 + min(len(x), len(y)) // 64)

    seen = []
    for d in dict.fromkeys(rows):
        for pos, line in enumerate((d[1] or "").split("\n")):
            n = normal(line)
            if len(n) >= least or short and re.search(r"[^\W_]", n):
                seen.append(((*order(d), pos), d, pos, n))
    first = {}
    for at, _, _, n in seen:
        first[n] = min(at, first.get(n, at))
    near = {x for x in first if len(x) >= least and any(
        first[y] < first[x] and y != x and len(y) >= least and distance_within(x, y, reach(x, y)) for y in first)}
    out = defaultdict(lambda: (set(), set()))
    for at, d, pos, n in seen:
        if n in near:
            out[d][1].add(pos)
        elif at != first[n]:
            out[d][0].add(pos)
    return out


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(texts, k, percent):
    """Index of each text's component head (smallest index) under the similarity."""
    sets = [shingles(t, k) for t in texts]
    head = list(range(len(texts)))

    def root(i):
        while head[i] != i:
            i = head[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                head[b] = a
    return [root(i) for i in range(len(sets))], sets


def sql(query, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(f"{name}_df", frame)
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM {name}_df")
    res = con.execute(query)
    return [d[0] for d in res.description], res.fetchall()
