"""Each operator against a plain version, and on nulls, empty and long texts, ties, repeated rows, no rows, clashing names."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from umbra.llm import bpe, langid, linededup, merkle, minhash, packing, pii, pretokens, repair, sharding, shared, vectors

EXTRA = "text string, lang string, key string, h long, n long, rep long, part int, umbra string"
LONG = "word " * 20000 + "1-2 " * 500


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, blanks, a long one, repeated rows and ids, a null id, columns of clashing names."""
    texts = [(0, None), (1, ""), (2, " \n\t "), (3, LONG), (4, "same text here\nand more of it, twice"), (4, "same text here\nand more of it, twice"), (5, "same text here\nand more of it, twice"), (None, "no id at all"), (5, "another text of id 5"), (6, "é日本 a  b\r\n c")]
    return spark.createDataFrame([(i, t, "en", "k", 1, 2, 3, 4, "x") for i, t in texts], "doc_id long, " + EXTRA)


def none(df):
    return df.limit(0)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# 1
def test_lines(spark, odd):
    shared = "this passage is shared by several of the documents today"
    docs = [(1, f"{shared}\nown line of the first document here"), (2, f"own line of the second one is this\n{shared}"), (3, "user 17 logged in from host a9 at noon"), (4, "user 18 logged in from host b7 at noon"), (5, "short one\n\nshort one"), (6, "short one")]
    docs += [(i, f"the value of the field named {w} was changed by an operator") for i, w in ((7, "red"), (8, "green"), (9, "blue"))]
    got = by_id(linededup.clean(spark.createDataFrame(docs, "doc_id long, text string")))
    assert got[1]["text"] == docs[0][1] and got[2]["text"] == "own line of the second one is this"
    assert got[3]["text"] and got[4]["text"] == "" and got[4]["umbra_dropped"] == 1
    assert got[7]["text"] and got[8]["text"] == got[9]["text"] == ""
    assert got[5]["text"] == docs[4][1] and got[6]["text"] == ""
    rows = linededup.clean(odd).collect()
    assert len(rows) == 10 and {r["doc_id"]: r["text"] for r in rows}[0] is None and set(odd.columns) <= set(rows[0].asDict())
    assert linededup.clean(none(odd)).count() == 0


def test_templates_of_a_leaf(spark):
    """Several templates a leaf, each dropped line like the kept one, against a plain version; the same where leaves are crowded by equal ends."""
    rng = random.Random(15)
    a = ["one two three four", "mm nn oo pp"]
    docs = [(i, "\n".join(" ".join([rng.choice(a), *(rng.choice("xyz" if rng.random() < 0.8 else "klmn789") for _ in range(rng.choice([1, 4, 6])))]) for _ in range(6)) + "\nshort\n日本語の行7") for i in range(80)]
    docs += [(80, "日本語の行7\n日本語の行8\n  short \n \t \n")]
    rows = [(i, n, x.strip(" ")) for i, t in docs for n, x in enumerate(t.split("\n")) if x.strip(" \t")]
    mask = lambda x: x if x.count(" ") < 4 else " ".join("<*>" if any(c.isdigit() for c in w) else w for w in x.split(" "))
    first: dict = {}
    for i, _, x in rows:
        first[mask(x)] = min(i, first.get(mask(x), i))
    leader, leads = {}, []
    for x in sorted(first, key=lambda x: (first[x], x)):
        w = x.split(" ")
        same = [y for y in leads if len(w) > 4 and len(y.split(" ")) == len(w) and y.split(" ")[:4] == w[:4] and sum(p == q for p, q in zip(w, y.split(" "))) >= 0.7 * len(w)]
        leader[x] = same[0] if same else x
        leads += [] if same else [x]
    assert len({leader[x] for x in leader if x.startswith("one two") and x.count(" ") == 9}) > 2
    want = {(i, n) for i, n, x in rows if i > first[leader[mask(x)]]}
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], n) for r in linededup.find(d).collect() for n in r["drop"]}
    assert got == want and len(want) > 300
    # crowded leaves: lines that agree in eight leading tokens still meet
    d = spark.createDataFrame([(i, f"a b c d e f g h {'xy'[i % 2]}{i} k l m") for i in range(30)] + [(i, "a b c d " + " ".join(rng.choice("pqrst") for _ in range(8))) for i in range(30, 60)], "doc_id long, text string")
    drop = {r["doc_id"] for r in linededup.find(d, crowd=9).collect()}
    assert set(range(1, 30)) <= drop


def test_crowded_leaves(spark):
    """A leaf of more lines than a task takes has the templates that it has in one task, those of the plain version."""
    rng = random.Random(23)
    docs = [(i, "a b c d " + " ".join(rng.choice("pqrs" if rng.random() < 0.9 else "tuvw") for _ in range(6))) for i in rng.sample(range(1000), 400)]
    lead: dict = {}
    for _, x in sorted(docs):
        if x not in lead:
            w = x.split(" ")
            lead[x] = next((y for y in lead if lead[y] == y and sum(p == q for p, q in zip(w, y.split(" "))) >= 7), x)
    first: dict = {}
    for i, x in sorted(docs):
        first.setdefault(lead[x], i)
    want = {i for i, x in docs if i > first[lead[x]]}
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert len(set(lead.values())) > 30 and len(want) > 200
    for crowd in (7, 50, 1000):
        assert {r["doc_id"] for r in linededup.find(d, crowd=crowd).collect()} == want


# 2
def test_bpe(spark, odd):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab .,\n\t'sé日1  -") for _ in range(rng.randint(0, 60))) for _ in range(500)] + ["a" * 5000, "it's we'll  x", LONG]
    codec = bpe.codec(path, public_tokenizers.PATTERN)
    for t in texts:
        ids = codec.encode(t)
        assert ids == plain.encode_ordinary(t) and codec.decode(ids) == t.encode()
    rows = bpe.digests(odd, path, public_tokenizers.PATTERN).collect()
    assert len(rows) == 10 and by_id(odd.sparkSession.createDataFrame(rows))[0]["n_tokens"] == 0
    back = bpe.decode(bpe.encode(odd.where("doc_id = 6"), path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN).first()
    assert bytes(back["bytes"]).decode() == "é日本 a  b\r\n c"
    assert bpe.digests(none(odd), path, public_tokenizers.PATTERN).count() == 0


# 3
def test_languages(spark, odd):
    words = {"en": "the of and that with from this have".split(), "de": "der die und nicht mit sich auf für".split(), "es": "que los una por para con del más".split()}
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(30)), k) for i in range(300) for k in [rng.choice("en de es".split())]]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(d.where(~langid.held_out()))
    got = by_id(langid.predict(d, model))
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert len(held) > 20 and np.mean([got[i]["lang_pred"] == k for i, _, k in held]) > 0.98
    # the same with exact sets of n-grams in place of the filters
    def grams(text):
        low = re.sub(r"[^\W\d_]|.", lambda m: m.group() if m.group().isalpha() else " ", f" {text.lower()} ", flags=re.S)
        low = re.sub(" +", " ", low)
        return [c for c in low if c != " "] + [low[i : i + 3] for i in range(len(low) - 2)]

    counts = {k: Counter() for k in words}
    for i, t, k in rows:
        if zlib.crc32(str(i).encode()) % 5:
            counts[k].update(grams(t))
    share = {k: {g: n / c.total() for g, n in c.items() if n / c.total() >= langid.FLOOR} for k, c in counts.items()}
    sets = {k: {g for g, f in share[k].items() if f >= langid.KEEP * max(s.get(g, 0) for s in share.values())} for k in words}
    for i, t, _ in rows:
        hits = {k: sum(g in sets[k] for g in grams(t)) for k in words}
        best = max(sorted(hits), key=hits.get)
        second = sorted(hits.values())[-2]
        assert got[i]["lang_pred"] == best and abs(got[i]["score"] - (1 - second / hits[best])) < 0.02
    rows = langid.predict(odd, model).collect()
    assert len(rows) == 10 and all(0 <= r["score"] <= 1 for r in rows) and {r["doc_id"]: r["lang_pred"] for r in rows}[2] == "und"
    assert {r["lang_pred"] for r in langid.predict(odd, langid.fit(none(odd))).collect()} == {"und"}
    assert langid.predict(none(odd), model).count() == 0
    whole, chunked = model.predict([LONG]), None
    langid.CHUNK, old = 1000, langid.CHUNK
    chunked = model.predict([LONG])
    langid.CHUNK = old
    assert whole[0] == chunked[0]


def test_support_of_many(spark):
    """The least support is that of all labelled rows, however many they are."""
    rng = random.Random(31)
    odd = ["".join(rng.choice("αβγδεζηθικλμ") for _ in range(8)) for _ in range(40)]
    docs = [(i, " ".join(["the dog runs"] * rng.randint(1, 9) + rng.sample(odd, rng.randint(0, 30))), "en") for i in range(5000)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = langid.fit(d.where("doc_id < 50"))
    found = [r["support"] for r in langid.predict(d, model, support=True).collect()]
    assert langid.least_support(d, model) == pytest.approx(langid.SLACK * np.percentile(found, 100 * langid.RARE), rel=1e-12)


def test_support(spark):
    docs = [(i, "the quick brown fox jumps over the lazy dog and runs away", "en") for i in range(60)] + [(100, "ελληνικό κείμενο χωρίς γνωστά γράμματα", None), (101, "中文文本", None), (102, "the dog runs", None), (103, "12", None), (104, "a ελληνικό κείμενο χωρίς γνωστά γράμματα", None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = langid.fit(d.where(~langid.held_out()))
    got = by_id(langid.predict(d, model, support=True))
    assert got[100]["support"] == got[101]["support"] == got[103]["support"] == 0 and got[100]["lang_pred"] == "en" and got[103]["lang_pred"] == "und"
    least = langid.least_support(d.where(langid.held_out()), model)
    assert 0 < got[104]["support"] < least < got[102]["support"] and langid.least_support(none(d), model) == 0
    assert langid.predict(d, model).columns == ["doc_id", "lang_pred", "score"]


# 4
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m.group())
            luhn = sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(digits))) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 13 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_pii(spark, odd):
    rng = random.Random(3)
    texts = ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "4465-7583-8288-9437", "😀 é +44 20 7946 0958", "1 2@ab.c", "a.b@c.d..e", "call me (212) 555-0199", "card 4111 1111 1111 1111 5", "4465758382889437 4465758382889437", "1 " * 4000, "a@" + "b." * 4000, "jo.doe (at) mail (dot) com"]
    texts += ["".join(rng.choice("0123456789012345678901234567890  --..+@()ab%_\n") for _ in range(rng.randint(1, 100))) for _ in range(400)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(pii.find(d).select("doc_id", pii.as_text("umbra_base").alias("base"), pii.as_text("umbra_spans").alias("spans")))
    assert {i: got[i]["base"] for i in got} == {i: base_spans(t) for i, t in enumerate(texts)}
    assert got[6]["spans"] == "phone:8:22" and got[8]["spans"] == "card:0:16,card:17:33" and got[11]["spans"] == "email:0:26"
    assert all(set(filter(None, r["base"].split(","))) <= set(r["spans"].split(",")) for r in got.values())
    assert by_id(pii.redact(d))[8]["text"] == "[CARD] [CARD]"
    clash = odd.withColumn("umbra_text", F.lit("mine")).withColumn("umbra_t", F.lit("too"))
    rows = pii.redact(clash)
    assert rows.columns == clash.columns and rows.first()["umbra_text"] == "mine"
    many = spark.createDataFrame([(1, "mail a.b@c.de now " * 20000)], "doc_id long, text string")
    model = pii.fit(none(odd))
    assert pii.redact(many, model=model).first()["text"] == "mail [EMAIL] now " * 20000
    got = pii.find(many, model=model).first()["umbra_base"]
    assert [(x["start"], x["end"]) for x in got] == [(18 * i + 5, 18 * i + 13) for i in range(20000)]
    assert all(precision >= 0.95 and recall > 0.3 for _, precision, recall in pii.measured(model))
    rows = pii.redact(odd)
    assert rows.columns == odd.columns and rows.count() == 10 and by_id(rows)[0]["text"] is None and pii.find(none(odd)).count() == 0


def test_pii_overlaps(spark):
    """Candidates apart from base spans, and the best of overlapping ones, as a plain loop finds them."""
    rng = random.Random(1)
    hit = lambda x, y: x[0] < y[1] and y[0] < x[1]
    span = lambda: (lambda at: (at, at + rng.randint(1, 9)))(rng.randint(0, 200))
    rows = [(i, sorted({span() for _ in range(rng.choice([0, 1, 5, 150]))}), [(*span(), rng.randint(0, 3), rng.randint(0, 5) / 5) for _ in range(rng.choice([0, 1, 7, 40]))]) for i in range(120)]
    d = spark.createDataFrame(rows, "i int, base array<struct<start: int, end: int>>, more array<struct<start: int, end: int, kind: int, score: double>>")
    for r in d.selectExpr("i", f"{pii._apart('more', 'base')} as apart", f"{pii._best('more')} as best").collect():
        _, base, more = rows[r["i"]]
        assert [tuple(x) for x in r["apart"]] == [x for x in more if not any(hit(x, b) for b in base)]
        kept = []
        for x in sorted(more, key=lambda x: (-x[3], x[0], x[1], x[2])):
            if not any(hit(x, k) for k in kept):
                kept.append(x)
        assert sorted(map(tuple, r["best"])) == sorted(kept)


def test_pii_long_text_of_several_kinds(spark):
    """Contexts are those of the text itself, in a text of thousands of e-mails and numbers, too."""
    text = "\U0001f600é " + " ".join(f"u{k}@mail{k}.com call 555-{100 + k % 900}-{1000 + k % 9000}" for k in range(4000))
    d, names = pii._sources(spark.createDataFrame([(text,)], "text string"), "text")
    found = d.selectExpr(f"{pii._proposed(names)} as x").first()["x"]
    assert len(found) == 4000
    for c in found:
        a, b = c["start"], c["end"]
        assert (c["m"], c["before"], c["after"]) == (text[a:b], text[max(0, a - 32) : a], text[b : b + 1])


# 5
def test_merkle(spark, odd):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abc de\n") for _ in range(rng.randint(0, 400))) for _ in range(60)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(merkle.edited(d, ranges=9))
    for i, t in enumerate(texts):
        n, after = len(t) // 4, texts[(i + 1) % len(texts)]
        new = t[: len(t) - n] + after[:n]
        assert got[i]["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest() and got[i]["fingerprint"] == str(merkle.Tree(t)) and got[i]["edited_fingerprint"] == str(merkle.Tree(new))
        # a plain comparison: all segments, without the tree
        leaves = [Counter(hashlib.blake2b(y.encode(), digest_size=16).hexdigest()[:8] for line in merkle._segments(x) for y in line) for x in (t, new, after)]
        for near, other in (("near_edited", 1), ("near_next", 2)):
            plain = 2 * (leaves[0] & leaves[other]).total() / (leaves[0].total() + leaves[other].total())
            assert got[i][near] == (1.0 if (t, new, after)[other] == t else min(plain, 1 - 1e-9))
        there = {(p, k) for p, line in enumerate(merkle._segments(new)) for k in range(len(line))}
        found = [(int(p), k) for x in filter(None, got[i]["edits"].split(",")) for p, _, ks in [x.partition(":")] for k in range(int(ks.split("-")[0]), int(ks.split("-")[1]) + 1)]
        assert len(set(found)) == len(found) == leaves[1].total() - (leaves[0] & leaves[1]).total() and set(found) <= there
    assert merkle.edits("a b\nc d", "a b\nc d") == [] and merkle.edits("one\ntwo\nthree", "one\n2\nthree") == [("gone", 1, 0), ("new", 1, 0)]
    assert merkle.edited(odd).count() == 10 and merkle.edited(none(odd)).count() == 0 and merkle.edited(d.limit(1)).first()["near_next"] == 1.0


def test_merkle_cuts_any_line():
    rng = random.Random(11)
    for line in ("word " * 1000, "a" * 3000, "一二三四五六七八九十" * 300, "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(3000)), "xyz" * 1000):
        segments = [*merkle._segments(line)]
        assert len(segments) == 1 and "".join(segments[0]) == line
        assert all(merkle.LEAST <= len(x) <= merkle.MOST for x in segments[0][:-1]) and len(segments[0]) >= len(line) / merkle.MOST
        # neither another end nor three characters in front move the cuts of the rest
        mark = str(merkle.Tree(line))
        assert merkle.likeness(mark, str(merkle.Tree(line[:-700] + "another end of it"))) > 0.7 and merkle.likeness(mark, str(merkle.Tree("new" + line))) > 0.9
    text = "ab\n\n" + "some words of a line that is cut, " * 20 + "\n" + "é日" * 200 + "\n"
    assert [x for x in merkle._segments(text)] == [y for line in text.split("\n") for y in merkle._segments(line)]


# 6
def near(texts, words):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = set(zip(*[w[k:] for k in range(words)])) if len(w) >= words else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}
    ids = sorted(sets)
    for _ in ids:
        for a in ids:
            for b in ids:
                if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    return {i: (len(sets[i]), comp[i]) for i in ids}


def test_near_copies(spark, odd):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for g in range(6):
        first = [rng.choice(words) for _ in range(40)]
        for _ in range(10):
            x = list(first)
            for _ in range(rng.randint(0, 6)):
                x[rng.randrange(len(x))] = rng.choice(words)
            texts.append((len(texts), " ".join(x)))
    texts += [(100, "A b"), (101, "a B"), (102, "one"), (103, ""), (104, None)]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    for k in (2, 5):
        got = by_id(minhash.near_copies(d, words=k, tile=4))
        assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == near(texts, k)
    # rows with one id are one document; by text they are several
    a, b, c = ("one two three four five six seven", "alpha beta gamma delta epsilon zeta eta", "completely other words stand here for once")
    few = spark.createDataFrame([(4, a), (5, a), (5, b), (6, b), (7, c), (7, ""), (9, c), (9, c)], "doc_id long, text string")
    got = minhash.near_copies(few).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got) == [(4, 4, True), (5, 4, False), (5, 4, False), (6, 4, False), (7, 7, True), (7, 7, True), (9, 7, False), (9, 7, False)]
    rows = minhash.near_copies(odd).collect()
    assert len(rows) == 10 and [r["component_id"] for r in rows if r["doc_id"] is None] == [None]
    assert minhash.near_copies(none(odd)).count() == 0


def test_unlike_short_texts():
    """Of short texts the registers alone tell that they aren't linked; no linked pair is lost by that."""
    from umbra.llm import minhash

    rng = np.random.default_rng(6)
    for n in (5, 12, 40, 300):
        for common in range(0, n + 1, max(1, n // 20)):
            h = rng.integers(0, 1 << 63, 2 * n - common, np.uint64) << np.uint64(1)
            a, b = np.sort(h[:n]), np.sort(h[n - common :])
            ra, rb = minhash.sketch([a, b])
            linked = 100 * common >= 80 * (2 * n - common)
            ok = bool(minhash.likely(ra, rb, np.array(n), np.array(n), 80))
            assert ok or not linked
            assert not ok or n > 40 or common >= 0.7 * n


# 7
def test_shards(spark, odd):
    d = spark.createDataFrame([(i, "x" * (i % 50)) for i in range(500)], "doc_id long, text string")
    got = sharding.assign(d, limit=300).collect()
    size = {}
    for r in got:
        size[r["shard"]] = size.get(r["shard"], 0) + r["doc_id"] % 50
    assert len(got) == 500 and all(size[r["shard"]] == r["shard_bytes"] <= 300 for r in got)
    assert not any(a != b and b.startswith(a) for a in size for b in size)
    parents = {}
    for s, n in size.items():
        parents[s[:-1]] = parents.get(s[:-1], 0) + n
    assert all(n > 300 or len([s for s in size if s[:-1] == p]) == 1 for p, n in parents.items())
    assert sharding.assign(odd, limit=10).count() == 10 and sharding.assign(none(odd)).count() == 0
    # null keys are spread as well
    nulls = spark.createDataFrame([(None, f"{i:0100}") for i in range(200)], "doc_id long, text string")
    assert {r["shard_bytes"] <= 1000 for r in sharding.assign(nulls, limit=1000).collect()} == {True}


# 8
def test_packing(spark, odd):
    d = spark.createDataFrame([(i, "w " * (i * 7 % 300)) for i in range(400)], "doc_id long, text string")
    lengths = (32, 64, 128)
    rows = packing.assign(d, lengths=lengths, group_tokens=5000).collect()
    total, bins = {}, {}
    for r in rows:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["piece_tokens"]
        bins.setdefault(r["bin"], []).append(r)
    assert total == {i: i * 7 % 300 + 1 for i in range(400)}
    for held in bins.values():
        used, at = sum(r["piece_tokens"] for r in held), 0
        assert {r["bin_length"] for r in held} == {min(x for x in lengths if x >= used)} and {r["bin_tokens"] for r in held} == {used}
        for r in sorted(held, key=lambda r: r["bin_offset"]):
            assert r["bin_offset"] == at
            at += r["piece_tokens"]
    assert sum(total.values()) / sum(held[0]["bin_length"] for held in bins.values()) > 0.9
    # the rows' layout decides nothing
    assert sorted(map(tuple, rows)) == sorted(map(tuple, packing.assign(d.repartition(7), lengths=lengths, group_tokens=5000).collect()))
    got = packing.assign(odd).groupBy("doc_id").agg(F.countDistinct("text_hash", "copy").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in got} == {0: 1, 1: 1, 2: 1, 3: 1, 4: 2, 5: 2, 6: 1, None: 1} and packing.assign(none(odd)).count() == 0


def best_cost(sizes, lengths, price):
    """The least cost of any partition into bins."""
    if not sizes:
        return 0.0
    first, rest = sizes[0], sizes[1:]
    found = math.inf
    for r in range(len(rest) + 1):
        for more in itertools.combinations(range(len(rest)), r):
            used = first + sum(rest[i] for i in more)
            if used <= max(lengths):
                left = [x for i, x in enumerate(rest) if i not in more]
                found = min(found, price(min(c for c in lengths if c >= used)) + best_cost(left, lengths, price))
    return found


def plain_plan(sizes, lengths, price):
    """The bins that the plan asks for, item by item, in the order planned."""
    left, out = sorted(sizes, reverse=True), []
    while left:
        best = None
        for c in sorted(lengths):
            if c >= left[0]:
                rest, held = left[1:], [left[0]]
                while fits := [x for x in rest if x <= c - sum(held)]:
                    held.append(max(fits))
                    rest.remove(max(fits))
                length = min(x for x in lengths if x >= sum(held))
                found = (price(length) / sum(held), length, held, rest)
                if best is None or found[:2] < best[:2]:
                    best = found
        out.append(best[1])
        left = best[3]
    return out


def plain_pack(sizes, lengths, price):
    """Best fit over all open bins, item by item, bins opened by the plan and downsized at the end."""
    plan, bins = plain_plan(sizes, lengths, price), []
    for n in sorted(sizes, reverse=True):
        fits = [b for b in bins if b[0] - sum(b[1]) >= n]
        if fits:
            min(fits, key=lambda b: b[0] - sum(b[1]))[1].append(n)
            continue
        i = next((i for i, c in enumerate(plan) if c >= n), None)
        bins.append((min((c for c in lengths if c >= n), key=price) if i is None else plan.pop(i), [n]))
    return sorted((min(c for c in lengths if c >= sum(held)), sorted(held)) for _, held in bins)


def test_joint_lengths():
    rng = random.Random(12)
    lengths, price = (8, 16, 32), lambda c: c * (1 + c / 64) + 3
    spent = least = 0.0
    for _ in range(60):
        sizes = [rng.randint(1, 32) for _ in range(rng.randint(1, 6))]
        kind, length, used, offset = packing.pack(np.array(sizes), lengths, price)
        bins = {}
        for b, c, n in zip(kind.tolist(), length.tolist(), sizes):
            bins.setdefault(b, (c, []))[1].append(n)
        assert sorted((c, sorted(held)) for c, held in bins.values()) == plain_pack(sizes, lengths, price)
        spent += sum(price(c) for c, _ in bins.values())
        least += best_cost(sizes, lengths, price)
    assert least <= spent <= 1.1 * least
    for many in ([rng.randint(1, 20) for _ in range(500)], [rng.randint(9, 32) for _ in range(300)]):
        kind, length, used, offset = packing.pack(np.array(many), lengths, price)
        bins = {}
        for b, c, u, o, n in zip(kind.tolist(), length.tolist(), used.tolist(), offset.tolist(), many):
            bins.setdefault(b, (c, u, []))[2].append((o, n))
        assert sorted((c, sorted(n for _, n in held)) for c, _, held in bins.values()) == plain_pack(many, lengths, price)
        for _, u, held in bins.values():
            assert all(o + n == end for (o, n), end in zip(sorted(held), [o for o, _ in sorted(held)[1:]] + [u]))
    # short items under attention that costs: small bins; without it, large ones
    small, large = (packing.pack(np.full(64, 4), lengths, p)[1] for p in (price, lambda c: c + 3))
    assert set(small.tolist()) == {16} and set(large.tolist()) == {32}


def test_packed_copies(spark, monkeypatch):
    """Copies of one row, null ids too, are numbered in blocks, each once."""
    monkeypatch.setattr(packing, "COPIES", 7)
    d = spark.range(60).selectExpr("cast(null as long) as doc_id", "if(id < 50, 'a b', cast(null as string)) as text")
    rows = packing.assign(d, lengths=(8, 16), group_tokens=40).groupBy("text_hash").agg(F.sort_array(F.collect_list("copy")).alias("c")).collect()
    assert sorted(r["c"] for r in rows) == [list(range(1, 11)), list(range(1, 51))]


def test_packed_sequences(spark, odd):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    want = sorted([*plain.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in odd.collect() if r["doc_id"] != 3)
    got = []
    for r in packing.sequences(odd.where("coalesce(doc_id, 0) <> 3"), path, 2, lengths=(64, 128)).collect():
        assert len(r["ids"]) <= r["bin_length"]
        got += [r["ids"][i:j] for i, j in zip([0, *r["doc_ends"]], r["doc_ends"])]
    assert sorted(got) == want


# 9
def test_vectors(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(30, 8))
    x = np.vstack([base, base + 0.1 * rng.normal(size=base.shape), base[:5], 2 * base[:3]]).astype(np.float32)
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)] + [(900, None, 1), (901, [], 1), (902, [0.0] * 8, 1), (903, [float("nan")] * 8, 1), (904, [None] + [1.0] * 7, 1), (905, [1.0, 2.0], 1), (None, [1.0] * 8, 1)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rep int")
    got = {r["vec_id"]: r for r in vectors.near_copies(d, block=16).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    hit = u @ u.T >= 0.95
    np.fill_diagonal(hit, False)
    comp = np.arange(len(x))
    for _ in comp:
        comp = np.array([min(comp[i], comp[hit[i]].min(initial=10**6)) for i in range(len(x))])
    assert [(got[i]["n_links"], got[i]["component_id"]) for i in range(len(x))] == list(zip(hit.sum(1).tolist(), comp.tolist()))
    # the lone vector of a repeated id has no links; ids reach each other through one id
    few = [(1, [1.0, 0.0]), (2, [0.99, 0.01]), (1, [0.0, 1.0]), (7, [0.01, 0.99]), (7, None), (8, [-1.0, 0.0]), (8, [-1.0, 0.0])]
    far = vectors.near_copies(spark.createDataFrame(few, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in far) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (7, 0, 1, False), (7, 1, 1, False), (8, 1, 8, True), (8, 1, 8, True)]
    assert len(got) == len(rows) and all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(900, 906)) and vectors.near_copies(none(d)).count() == 0


# 10
def test_token_files(spark, odd):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    rng = random.Random(7)
    texts = ["".join(rng.choice(["the ", "cat", ". ", "\n", "é", "  ", ", "]) for _ in range(rng.randint(0, 200))) for _ in range(50)] + [LONG]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    files, _ = repair.encode_files(d, path, 2, shards=6)
    got, at = by_id(repair.read_files(files)), 0
    for i, t in enumerate(texts):
        ids = [*plain.encode(t, add_special_tokens=False).ids, 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    row = files.orderBy("shard", "block").first().asDict()
    block, ids = repair.Block(row), np.frombuffer(row["doc_ids"], "<i8")
    assert block.document(1).tolist() == [*plain.encode(texts[ids[1]], add_special_tokens=False).ids, 2]
    files, _ = repair.encode_files(odd, path, 2)
    assert repair.read_files(files).count() == 10 and files.agg(F.sum("n_docs")).first()[0] == 10
    files, _ = repair.encode_files(none(odd), path, 2)
    assert repair.read_files(files).count() == 0


def test_components(spark):
    rng = random.Random(9)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2100)]
    want = {x: x for p in pairs if p[0] != p[1] for x in p}
    for _ in range(200):
        for a, b in pairs:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    d = spark.createDataFrame(pairs, "u long, v long")
    # one task sees all links, or seven see some each
    for links in (d.coalesce(1), d.repartition(7)):
        assert {r["node"]: r["component"] for r in shared.components(links).collect()} == want
    assert shared.components(d.limit(0)).count() == 0


def test_grammar():
    rng = np.random.default_rng(8)
    for n, v in ((0, 5), (1, 5), (2, 1), (5000, 3), (20000, 50), (20000, 1)):
        for first in (50257, 70000):
            ids = rng.integers(0, v, n).astype(np.uint32)
            rules, seq = repair.compress(ids, first, least=2)
            kind = "<u2" if first < 1 << 16 else "<u4"
            b = repair.Block({"first_symbol": first, "rules": rules.astype(kind).tobytes(), "sequence": seq.astype(kind).tobytes(), "expansions": repair.expansion_lengths(rules, first).astype("<i4").tobytes(), "doc_ends": b""})
            assert (b.ids() == ids).all()
            for i, j in rng.integers(0, n + 1, (10, 2)):
                assert (b.ids(min(i, j), max(i, j)) == ids[min(i, j) : max(i, j)]).all()


def test_workers_forget_what_another_operator_keeps():
    minhash._WORDS[b"word"] = 1
    shared._RAN[:] = ["umbra.llm.minhash"]
    shared._alone("umbra.llm.minhash")
    assert minhash._WORDS
    shared._alone("umbra.llm.langid")
    assert not minhash._WORDS and shared._RAN == ["umbra.llm.langid"]
    path = public_tokenizers.path("byte_bpe_50k.json")
    first = repair.token_bytes(path)
    shared._RAN[:] = ["umbra.llm.packing"]
    shared._alone("umbra.llm.pii")
    assert repair.token_bytes(path) is not first


def test_pieces_encoded_together():
    """Pieces that are encoded in one string have the ids of the tokenizers library, whatever they hold."""
    path, rng = public_tokenizers.path("byte_bpe_50k.json"), random.Random(10)
    parts = ["ab", "the ", " ", ".", ",", "\n", "\t", "\x0b", "'s", "é", "日", "1", "-", "  ", "\x85", "\u3000", "don't", "<|endoftext|>", "\0", "a\u0301"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["", "\n", LONG]
    encode = repair._Encoder(path)
    assert [len(x) for x in texts] == [len(x) for some in repair._groups(texts) for x in some]
    want = [np.array(x.ids, encode.wide).tobytes() for x in encode.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    handed, real = [], encode.tokenizer

    class Counted:
        def encode(self, text, **more):
            return real.encode(text, **more)

        def encode_batch_fast(self, some, **more):
            handed.extend(some)
            return real.encode_batch_fast(some, **more)

    encode.tokenizer = Counted()
    assert [x for some in repair._groups(texts) for x in encode.many(some)] == want
    before = len(handed)
    words = [f"new{i}word" for i in range(2000)]
    assert encode.many([" ".join(words)])[0] == np.array(real.encode(" ".join(words), add_special_tokens=False).ids, encode.wide).tobytes()
    assert len(handed) - before < 20


def test_texts_encoded_as_one_array(monkeypatch):
    """Texts of any pieces give the library's ids and the end id, whatever the cache holds, and reach the library together."""
    monkeypatch.setattr(repair, "CACHE", 300)
    path, rng = public_tokenizers.path("byte_bpe_50k.json"), random.Random(11)
    encode = repair._Encoder(path)
    real, handed = encode.tokenizer, []

    class Counted:
        def encode(self, text, **more):
            handed.append(text)
            return real.encode(text, **more)

        def encode_batch_fast(self, some, **more):
            handed.extend(some)
            return real.encode_batch_fast(some, **more)

    encode.tokenizer = Counted()
    gaps = ["x".join(" " * k + "\n" * j for k in range(40)) for j in range(20)]
    assert encode.many(gaps) == [np.array(x.ids, encode.wide).tobytes() for x in real.encode_batch_fast(gaps, add_special_tokens=False)]
    assert len(handed) < 5  # hundreds of different runs of white space, each of which had a call's work of its own
    parts = ["word", "Éa", " ", "\n", ".", ",", "\t", "\x0b", "日本", "12", "'ll", "\0", "<|endoftext|>", "  ", "a\u0301", "\u2003"]
    for _ in range(5):
        texts = ["".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 5, 60]))) + str(rng.randrange(500)) * rng.randrange(2) for _ in range(400)]
        ids, sizes = encode.joined(texts, 2)
        want = [[*x.ids, 2] for x in real.encode_batch_fast(texts, add_special_tokens=False)]
        assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == sum(want, [])
        assert len(encode.known) <= 300
    assert [x.tolist() for x in repair.encoded(path, [None, "", "a b"], 2)] == [[2], [2], [*real.encode("a b", add_special_tokens=False).ids, 2]]
    assert [len(x) for x in encode.joined([], 2)] == [0, 0]


def test_texts_cut_at_once():
    """columns() cuts many texts where pieces() cuts each."""
    import regex

    findall, rng = regex.compile(public_tokenizers.PATTERN).findall, random.Random(12)
    parts = ["a", "B", "z9", " ", ".", ",", "\n", "é", "×", "÷", "ÿ", "À", "日", "\u3000", "\u2003", "’", "\x85", "\xa0", "ª", "\t", "\0", "  ", "'s", "𝒳", "ß"]
    for _ in range(1000):
        texts = ["".join(rng.choice(parts[: rng.choice([6, 9, 12, len(parts)])]) for _ in range(rng.choice([0, 1, 2, 5, 20]))) for _ in range(rng.randint(1, 12))]
        got, first = pretokens.columns(texts, findall)
        for text, i, j in zip(texts, first.tolist(), [*first[1:].tolist(), len(got)]):
            mine = got.slice(i, j - i).to_pylist()
            assert "".join(mine) == text and mine in ([x for x in pretokens.pieces(text, findall) if x] or [""], findall(text))
