"""The prefix trie against a plain one, cut into partitions anywhere, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

from umbra.llm import turntrie

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain(rows):
    """The contract's nodes of (conv_id, turn, role, text) rows."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()[:16], role or "", text or ""))
    own = {c: [x[3:] for x in sorted(t, key=lambda x: x[:3])] for c, t in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole = own.get(c - c % 20, [])[:h] + mine[h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append(c)
        ends[tuple(whole)].append(c)
    below = defaultdict(list)
    for p in members:
        if p:
            below[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[x] for x in below[p]) or 1
        saved[p] = (len(members[p]) - 1) * words + sum(saved[x] for x in below[p])
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(below[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


SCHEMA = "conv_id long, turn long, role string, text string"


def found(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def key(rows):
    return sorted(map(repr, rows))


def test_trie_equals_plain(spark):
    rng = random.Random(11)
    rows = []
    for c in rng.sample(range(1000), 300):
        path = [(rng.choice("ab"), rng.choice(["x y", "z", "x  y\tz", ""])) for _ in range(rng.randint(1, 7))]
        path = [("a", "hello there")] * 3 + path if rng.random() < 0.4 else [("a", "same")] * 4 if rng.random() < 0.4 else path
        rows += [(c, i, role, text) for i, (role, text) in enumerate(path)]
    d = turntrie.rebuilt(spark.createDataFrame(rows, SCHEMA))
    want = plain(rows)
    assert len(want) > 300 and max(r[3] for r in want[1:] if r[1] == 4) > 20
    for n in (None, 1, 7, 60, 250):
        assert key(found(turntrie.trie(d, n))) == key(want), n


def test_odd_rows(spark):
    rows = [(None, 0, "a", "no conversation"), (20, None, None, None), (20, 0, "user", "two words"), (20, 0, "user", "two words"), (21, 5, "user", ""), (22, 0, "user", "two words"), (22, 1, "a", "w " * 50_000), (40, 0, "b", "é 日本 x"), (63, 0, "b", "gone"), (7, 0, "c", "x")]
    wide = spark.createDataFrame([(*r, 1, "k") for r in rows], SCHEMA + ", words long, key string")
    assert key(found(turntrie.trie(turntrie.rebuilt(wide), 3))) == key(plain(rows))
    assert turntrie.trie(turntrie.rebuilt(wide.limit(0))).count() == 0


def test_long_and_repeated(spark, monkeypatch):
    monkeypatch.setattr(turntrie, "PIECE", 5)
    rows = [(c, t, "u", f"turn {t}") for c in range(0, 400, 20) for t in range(200)] + [(c, t, "u", f"turn {t}") for c in range(401, 420) for t in range(3)]
    assert key(found(turntrie.trie(turntrie.rebuilt(spark.createDataFrame(rows, SCHEMA)), 9))) == key(plain(rows))
