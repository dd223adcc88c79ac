"""Small tables and plain-Python versions of the operators."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def low_words(text):
    return ALNUM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def sample(seed=1, n=120, long=30_000):
    """Rows with null keys, null, empty and very long texts, repeated rows, one key with several texts."""
    rnd = random.Random(seed)
    base = [rnd.choice(["der", "Haus", "été", "where", "x1", "Über", "the"]) + rnd.choice("abcdé") for _ in range(500)]
    rows = []
    for i in range(n):
        a = rnd.randint(0, 480)
        text = rnd.choice([" ", "", "\n", "\t\x0b"]).join([""] * 2) + rnd.choice([" ", "  \n", "\t"]).join(base[a : a + rnd.randint(0, 70)] + [rnd.choice("abcé*#") for _ in range(rnd.randint(0, 6))] + base[a : a + rnd.randint(0, 30)])
        if i % 11 == 0:
            text = None
        if i % 17 == 0:
            text = ""
        key = rnd.choice([None, i, i, i, i // 2])
        rows.append((key, text, rnd.choice([None, "en", "de"]), rnd.choice([None, "s1", "s2", "hot", "hot", "hot"]), None))
        if i % 9 == 4:
            rows.append(rows[-1])
    rows.append((n, " ".join(rnd.choice(base) for _ in range(long // 7)), "en", "hot", 1))
    return rows


def clash(df, *names):
    """df with more columns, named like those that an operator makes."""
    from pyspark.sql import functions as F

    for name in (*names, "key", "same", "node", "text2", "_key", "_same", "words", "size", "part", "rows", "bucket"):
        df = df.withColumn(name, F.lit("other"))
    return df


def kept_words(rows, width):
    """op4 by brute force; rows of (key, text)."""
    last, first = 10**18, {}
    for k, t in rows:
        w = words(t)
        for i in range(len(w) - width + 1):
            g = tuple(w[i : i + width])
            first[g] = min(first.get(g, 10**19), last if k is None else k)
    out = []
    for k, t in rows:
        w, gone = words(t), set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < (last if k is None else k):
                gone.update(range(i, i + width))
        out.append((k, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return ordered(out)


def kept_bytes(rows, length):
    """op5 by brute force; rows of (key, text)."""
    raw = [(k, (t or "").encode()) for k, t in rows]
    seen = Counter(b[i : i + length] for _, b in raw for i in range(len(b) - length + 1))
    out = []
    for k, b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((k, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return ordered(out)


def near_groups(rows, size=5, p=4, q=5):
    """op7 by brute force: for each row number its group's smallest row, and its number of links."""
    sets = []
    for _, t in rows:
        w = low_words(t)
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    links = [{j for j, b in enumerate(sets) if j != i and a and b and q * len(a & b) >= p * len(a | b)} for i, a in enumerate(sets)]
    root = list(range(len(rows)))
    for _ in rows:
        root = [min([root[i], *(root[j] for j in links[i])]) for i in range(len(rows))]
    return root, [len(x) for x in links]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]
