"""Spelling variants against a plain comparison of all words with all, and on odd rows."""

import random
import re
import zlib
from collections import Counter

from umbra.llm import variants


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows, every=199):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % every == 0 else w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    out = {}
    for w in n:
        x = sorted((v for v in n if near(w, v)), key=lambda v: (-n[v], v))
        out[w] = [n[w], len(x), x[0] if x and n[x[0]] >= 5 * n[w] else None]
    got = []
    for w, (k, m, form) in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        got.append((w, root, form, k, m, n[form] if form else None))
    return sorted(got, key=repr)


def found(spark, rows, every=199):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n long, word string")
    v = variants.words(d, every=every).where(f"n >= {variants.OCCURRENCES}")
    return sorted(map(tuple, variants.grouped(v).collect()), key=repr)


def test_equals_plain(spark):
    rng = random.Random(12)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(6, 9))) for _ in range(120)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(120):
            w = base[min(rng.randrange(120), rng.randrange(120), rng.randrange(120))]
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abÀé") + w[k:], w[:k] + rng.choice("abc") + w[k + 1 :]])
            text.append(w.upper() if rng.random() < 0.1 and "é" not in w else w)
        rows.append((i, rng.choice([" ", "-", ", "]).join(text)))
    want = plain(rows, every=7)
    assert len(want) > 100 and sum(r[2] is not None for r in want) > 20
    assert found(spark, rows, every=7) == want


def test_edges_of_pairs(spark):
    """Edits at every place, chains of forms, ties, odd rows."""
    w = "abcdefgh"
    forms = [w[:i] + "z" + w[i + 1 :] for i in range(8)] + [w[:i] + w[i + 1 :] for i in range(8)] + [w[:i] + "x" + w[i:] for i in range(9)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa"]
    rows = [(1, " ".join(forms * 5 + [w] * 125)), (2, " ".join(["abcdefyh"] * 25 + ["abcdeyyh"] * 5 + ["kabcdeyyh"] * 5)), (3, None), (None, "nullid " * 6), (4, ""), (5, "longest" * 30_000), (6, "×÷×÷×÷× " * 9), (6, "×÷×÷×÷× " * 9)]
    got = found(spark, rows)
    assert got == plain(rows) and {r[0]: r[1] for r in got}["abcdeyyh"] == w
    assert found(spark, [r for r in rows if r[0] == 99]) == []


def test_split_tries(spark):
    v = spark.createDataFrame([(f"prefix{a}{b}", 5) for a in "abcdefgh" for b in "abcdefgh"], "word string, n long")
    pairs = variants.near_words(v, group=5).collect()
    assert len(pairs) == len({(r[0], r[1]) for r in pairs}) == 64 * 14 and all(near(r[0], r[1]) for r in pairs)
