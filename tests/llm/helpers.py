"""Made-up texts and brute-force versions of the operators."""

import random
import re
import zlib
from collections import Counter

DOCS = "doc_id bigint, text string"


def words(n, seed=0, size=4000):
    r = random.Random(seed)
    return [f"w{r.randrange(size)}" for _ in range(n)]


def text(n, seed=0, size=4000):
    return " ".join(words(n, seed, size))


def changed(t, share, seed=0):
    r = random.Random(seed)
    return " ".join(f"z{r.randrange(10**6)}" if r.random() < share else w for w in t.split())


def jaccard(a, b, n=3):
    sets = [{tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} for w in (x.split() for x in (a, b))]
    return len(sets[0] & sets[1]) / max(1, len(sets[0] | sets[1]))


def groups(rows, threshold):
    """Smallest id of each component of pairs that are equal or near, by comparing all pairs."""
    rows = [r for r in rows if r[0] is not None and r[1] is not None]
    to = {i: i for i, _ in rows}

    def find(i):
        while to[i] != i:
            i = to[i]
        return i

    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if a == b or (a.strip() and b.strip() and jaccard(a, b) >= threshold):
                x, y = find(i), find(j)
                to[max(x, y)] = min(x, y)
    return {(i, find(i)) for i in to if find(i) != i}


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for k, y in enumerate(b, 1):
            keep = row[k]
            row[k] = before + 1 if x == y else max(row[k], row[k - 1])
            before = keep
    return row[-1]


def coverage(t, n):
    """Characters inside n-grams seen before, and characters of all words."""
    ws = [w for w in re.split(r"[\t\n\v\f\r ]+", t or "") if w]
    seen, covered = set(), set()
    for i in range(len(ws) - n + 1):
        g = tuple(ws[i : i + n])
        if g in seen:
            covered.update(range(i, i + n))
        seen.add(g)
    return sum(len(ws[i]) for i in covered), sum(map(len, ws))


def repeated_lines(t):
    found = Counter(x for x in (t or "").split("\n") if x.strip("\t\n\v\f\r "))
    return sum(len(x) * n for x, n in found.items()), sum(len(x) * (n - 1) for x, n in found.items())


def spans(rows, n):
    """Maximal spans of repeated words, from a dictionary of all n-grams."""
    count, at = Counter(), {}
    for i, t in rows:
        if i is None or t is None:
            continue
        ws = [w for w in re.split(r"[\t\n\v\f\r ]+", t) if w]
        for k in range(len(ws) - n + 1):
            g = tuple(ws[k : k + n])
            count[g] += 1
            at.setdefault(i, {}).setdefault(k, []).append(g)
    out = set()
    for i, places in at.items():
        hits = sorted((k, max(count[g] for g in gs)) for k, gs in places.items() if max(count[g] for g in gs) > 1)
        run = []
        for k, c in hits:
            if run and k - run[-1][0] > n:
                out.add((i, run[0][0], run[-1][0] - run[0][0] + n, max(x for _, x in run)))
                run = []
            run.append((k, c))
        if run:
            out.add((i, run[0][0], run[-1][0] - run[0][0] + n, max(x for _, x in run)))
    return out


def token(prefix="ghp_", body="A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5", good=True):
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    n, tail = zlib.crc32(body.encode()), ""
    while n:
        n, r = divmod(n, 62)
        tail = digits[r] + tail
    tail = tail.rjust(6, "0")
    return prefix + body + (tail if good else ("a" if tail[0] != "a" else "b") + tail[1:])


def odd(spark, more=()):
    """Rows with nulls, empty and very long texts, repeats, and columns with clashing names."""
    long = text(30_000, 99, 10**6)
    rows = [(1, None), (None, "a text without an id"), (2, ""), (3, " \n "), (4, "one"), (4, "one"), (5, long), *more]
    names = "doc_id bigint, text string, keep string, shard string, n int, count int, `group` string, a int, key string"
    return spark.createDataFrame([(*r, "x", "y", 1, 2, "g", 3, "k") for r in rows], names)


def empty(spark):
    return spark.createDataFrame([], DOCS)
