"""The registered queries themselves, on a small folder of tables: columns, types, rows."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest

from umbra.llm import packing, queries

import test_turntrie  # pytest puts this folder on the path
import test_variants
from test_operators import plain_pack

COLUMNS = {
    "op1_template_lines": "doc_id bigint, n_lines bigint, n_dropped bigint, text_sha256 string",
    "op2_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op3_language_bitmask": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op4_boosted_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op5_merkle": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op6_hyperminhash": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op7_extendible_shards": "doc_id bigint, shard string, shard_depth int, shard_bytes bigint",
    "op8_best_fit_packing": "doc_id bigint, piece int, piece_tokens int, bin string, bin_length int, bin_tokens int, bin_offset int",
    "op9_epsilon_grid": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op10_token_ids": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op11_turn_trie": "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string",
    "op12_spelling_variants": "word string, root string, form string, n bigint, n_near bigint, form_n bigint",
    "op13_wrapper_text": "page_id bigint, url string, text string, n_chars bigint",
}


TURNS = [(c, t, ("user", "assistant")[t % 2], f"words of turn {t * (c % 3)}") for c in range(90) for t in range(c % 6)]
PAGES = [(i, f"http://h{i % 3}.example/{i}", f"<body><nav>menu</nav><article><h1>t{i}</h1><p>text of page {i}</article><footer>end</footer></body>") for i in range(12)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(20)
    words = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(12):
        body = [rng.choice(words) for _ in range(rng.randint(20, 90))]
        for _ in range(rng.randint(1, 4)):
            copy = [x if rng.random() > 0.03 else rng.choice(words) for x in body]
            texts.append(" ".join(copy[: len(copy) // 2]) + "\n" + " ".join(copy[len(copy) // 2 :]))
    texts += ["", None, "mail a.b@c.de or call +1 (555) 555-0100, ip 10.0.0.1, card 4465758382889437", "hi <|endoftext|> there", "x", "x"]
    rows = [(i, t, ("en", "de")[i % 2] if t else None, "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(at + "/documents.parquet")
    g = np.random.default_rng(21)
    base = g.normal(size=(20, 16))
    x = np.vstack([base, base[:8] + 0.05 * g.normal(size=(8, 16)), base[:4] + 0.12 * g.normal(size=(4, 16)), 3 * base[:2]]).astype(np.float32)
    spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(100, None), (101, [0.0] * 16)], "vec_id long, embedding array<float>").coalesce(1).write.parquet(at + "/embeddings.parquet")
    spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(at + "/conversations.parquet")
    spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1).write.parquet(at + "/pages.parquet")
    return at, dict(enumerate(texts))


def test_all(spark, folder):
    import tiktoken
    from tokenizers import Tokenizer

    from umbra.llm import bpe

    at, texts = folder
    got = {}
    for name, run in queries.QUERIES.items():
        df = run(spark, at)
        types = dict(df.dtypes)
        assert all(types.get(c) == t for c, t in (x.split(" ") for x in COLUMNS[name].split(", "))), name
        got[name] = [r.asDict() for r in df.collect()]
        if name not in ("op8_best_fit_packing", "op9_epsilon_grid", "op11_turn_trie", "op12_spelling_variants", "op13_wrapper_text"):
            assert sorted(r["doc_id"] for r in got[name]) == sorted(texts)
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet/*.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        if name == "op1_template_lines":
            sql = f"SELECT * FROM ({sql}) WHERE doc_id IN (SELECT doc_id FROM documents WHERE text IS NOT NULL)"  # SQL has no row for a null text
        c = con.execute(sql)
        names = [x[0] for x in c.description]
        rows = [tuple(r[n] for n in names) for r in got[name] if name != "op1_template_lines" or texts[r["doc_id"]] is not None]
        assert sorted(map(repr, rows)) == sorted(map(repr, c.fetchall())), name
    assert sum(r["n_links"] for r in got["op9_epsilon_grid"]) > 20 and sum(not r["kept"] for r in got["op6_hyperminhash"]) > 5
    values = lambda name: sorted((tuple(r[x.split(" ")[0]] for x in COLUMNS[name].split(", ")) for r in got[name]), key=repr)
    assert values("op11_turn_trie") == sorted(test_turntrie.plain(TURNS), key=repr)
    assert values("op12_spelling_variants") == test_variants.plain(list(texts.items()))
    assert values("op13_wrapper_text") == sorted(((i, u, f"t{i} text of page {i}", len(f"t{i} text of page {i}")) for i, u, _ in PAGES), key=repr)
    rank = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for r in got["op2_byte_bpe"]:
        ids = rank.encode_ordinary(texts[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest())
    plain, start, tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, {}
    for r in sorted(got["op10_token_ids"], key=lambda r: r["doc_id"]):
        ids = [*plain.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start, tokens[r["doc_id"]] = start + len(ids), len(ids)
    packed = {}
    for r in got["op8_best_fit_packing"]:
        packed[r["doc_id"]] = packed.get(r["doc_id"], 0) + r["piece_tokens"]
    assert packed == tokens
    # one group: its bins are those of the plain best fit
    whole, rests = [n // 4096 for n in tokens.values()], [n % 4096 for n in tokens.values() if n % 4096]
    bins = {}
    for r in got["op8_best_fit_packing"]:
        bins.setdefault((r["bin"], r["bin_length"]), []).append(r["piece_tokens"])
    assert sorted((c, sorted(n)) for (_, c), n in bins.items()) == sorted(plain_pack(rests, packing.LENGTHS, packing.cost) + [(4096, [4096])] * sum(whole))
    for r in got["op3_language_bitmask"]:
        text = texts[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, text or ""))) and r["lang_pred"] in ("und", "en", "de")
    found = {r["doc_id"]: r for r in got["op4_boosted_pii"]}[max(texts) - 3]
    assert [found[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [1, 1, 1, 1] and found["spans"].startswith("email:5:13,ip:")
    for r in got["op5_merkle"]:
        text, after = (texts[i % len(texts)] or "" for i in (r["doc_id"], r["doc_id"] + 1))
        new = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest() and 0 <= r["near_next"] <= 1
        assert (r["near_edited"] == 1) == (new == text) == (r["fingerprint"] == r["edited_fingerprint"])
