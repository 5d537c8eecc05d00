"""Rows with nulls in any column, empty, blank and long texts, repeats and columns whose names operators use themselves; and plain versions of the operators."""

import hashlib
import itertools
import re
from collections import defaultdict

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, component_id bigint, n bigint, h string, places string, doc string, s string, `order` bigint, vid bigint, row bigint, piece string, bin int, `a.b` string"
NAMES = 18


def passage(k, n=70):
    return " ".join(f"w{k}x{i}" for i in range(n))


def texts():
    p = passage(1)
    long = " ".join(f"t{i % 997}q{i}" for i in range(30_000))
    shared = "All Rights Reserved"
    out = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "One two"), (6, long), (7, long), (7, long), (None, "no id here"), (None, "no id here"), (None, None)]
    out += [(100 + i, f"{passage(200 + i, 30)}\n{shared if i % 2 else shared.lower()}\t\n{p if i % 3 == 0 else passage(300 + i, 40)}\nend of {i}") for i in range(14)]
    out += [(200 + i, passage(9, 60) + f" tail{i % 3}") for i in range(6)]
    out += [(300, "É ü x \u000bvt"), (301, "\n\n"), (302, shared)]
    return out


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    filled = [(d, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"src{i % 3}", None if t is None else len(t), *[None] * (NAMES - 5)) for i, (d, t) in enumerate(rows)]
    return spark.createDataFrame(filled, SCHEMA)


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def low(t):
    return t.translate({c: c + 32 for c in range(65, 91)})


def _covered(rows, k):
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - k + 1):
            if d is not None:
                first[tuple(w[i : i + k])] = min(d, first.get(tuple(w[i : i + k]), d))
    for d, t in rows:
        w, gone = words(t), set()
        for i in range(len(w) - k + 1):
            if d is not None and first[tuple(w[i : i + k])] < d:
                gone.update(range(i, i + k))
        yield d, w, gone


def windows_covered(rows, k):
    """op2: the words of each document that lie in windows of k words of a smaller one."""
    return {d: gone for d, _, gone in _covered(rows, k)}


def windows_removed(rows, k=13):
    """op5: doc_id, words, removed, hash of each row."""
    out = []
    for d, w, gone in _covered(rows, k):
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def lines_dropped(rows, least=10):
    """op9: kept text, lines, dropped lines of each row."""
    key = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    count = defaultdict(int)
    for _, t in rows:
        for k in {key(x) for x in (t or "").split("\n")} - {""}:
            count[k] += 1
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if count[key(x)] < least]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def near_classes(rows, k, percent):
    """op10: size of the set and smallest reachable doc_id of each row."""
    sets, tops = _linked(rows, k, percent)
    ids = defaultdict(list)
    for (d, _), top in zip(rows, tops, strict=True):
        ids[top] += [d] if d is not None else []
    return [(d, len(s), (min(ids[top], default=None) if s else d)) for (d, _), s, top in zip(rows, sets, tops, strict=True)]


def near_row_classes(rows, k, percent):
    """The class of each row; None for those without words."""
    return [top if s else None for s, top in zip(*_linked(rows, k, percent), strict=True)]


def _linked(rows, k, percent):
    sets = []
    for _, t in rows:
        w = words(low(t or ""))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            up[max(top(i), top(j))] = min(top(i), top(j))
    return sets, [top(i) for i in range(len(rows))]


def plain(found):
    return sorted(map(tuple, found), key=repr)
