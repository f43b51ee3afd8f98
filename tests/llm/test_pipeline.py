"""Each stage of the pipeline against a plain version."""

from pyspark.sql import functions as F

import corpus_pipeline as p

NAMES = list(p.COLUMNS)


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en" if i is None or i % 2 else "de", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark):
    body = "the house that jack built stood on the hill for many years and nobody knew why it was left there by its owner after the war"
    rows = [(1, body), (2, body.replace("hill", "dune")), (3, None), (4, "12345 ..."), (5, "mail me at a.b@example.com or +1 (555) 555-0100 please, it is urgent"), (6, "der Hund und die Katze sind nicht im Haus"), (7, body)]
    d = docs(spark, rows)
    a = p.language(spark, d, "")
    assert a.columns == NAMES and {r["doc_id"] for r in a.collect()} == {1, 2, 5, 6, 7}
    b = p.lines(spark, a, "")
    # the template of 1, 2 and 7 recurs: it stays in the first
    assert b.columns == NAMES and {r["doc_id"] for r in b.collect()} == {1, 5, 6}
    # one word of 26 changes five of the shingles: 2 isn't a near copy, 7 is
    c = p.near_copies(spark, a, "")
    assert c.columns == NAMES and {r["doc_id"] for r in c.collect()} == {1, 2, 5, 6}
    e = p.redacted(spark, b, "")
    got = {r["doc_id"]: r["text"] for r in e.collect()}
    assert e.columns == NAMES and got[5] == "mail me at [EMAIL] or [PHONE] please, it is urgent" and got[1] == body
    f = p.packed(spark, e, "").collect()
    assert {r["doc_id"] for r in f} == {1, 5, 6} and len({r["bin"] for r in f}) == 1


def test_no_rows(spark):
    d = docs(spark, [(1, "x")]).limit(0)
    for _, stage in p.STAGES:
        out = stage(spark, d, "")
        assert out.count() == 0
        d = out if out.columns == NAMES else d


def test_short_lines(spark):
    rows = [(1, "Les.\nthe first"), (2, "Les.\n\n12\nthe second"), (3, " 全部没有空格的一行3 \nthe third\n13"), (4, "全部没有空格的一行3\n全部没有空格的一行4\n\nthe fourth"), (5, "Les. \n \t"), (6, "again\nagain")]
    got = {r["doc_id"]: r["text"] for r in p.lines(spark, docs(spark, rows), "").collect()}
    # exact lines alone: other digits are other lines, a document's own repeats and blank lines stay
    assert got == {1: rows[0][1], 2: "\n12\nthe second", 3: rows[2][1], 4: "全部没有空格的一行4\n\nthe fourth", 6: "again\nagain"}


def test_unlearned_language(spark):
    rows = [(i, f"the house that jack built stood on the hill for {w} years") for i, w in enumerate("many ten two some four more all few six most".split() * 3)]
    d = docs(spark, [*rows, (100, "ένα κείμενο σε γλώσσα που δεν έχει διδαχθεί"), (101, "没有学过的语言"), (102, "the hill")]).selectExpr("doc_id", "text", "if(doc_id < 100, 'en', null) as lang", "source", "n_chars")
    assert {r["doc_id"] for r in p.language(spark, d, "").collect()} == {*range(len(rows)), 102}


def test_repeated_ids(spark):
    a, b = "the house that jack built stood on the hill for many years", "nobody knew why the old mill was left there by its owner after the war"
    rows = [(4, a), (5, a), (5, b), (6, b), (7, a + " now"), (8, "x"), (8, "x"), (None, a), (None, a), (9, None), (9, "")]
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in p.near_copies(spark, docs(spark, rows).withColumn("umbra_th", F.lit("mine")), "").collect())
    # a stays in 4, b in 5, equal rows once; null ids, null and empty texts stay
    assert got == sorted([(4, a), (5, b), (8, "x"), (0, a), (0, a), (9, ""), (9, "")])


def test_unlabelled_gets_its_language(spark):
    d = docs(spark, [(i, "the house that jack built stood on the hill for many years") for i in range(30)]).selectExpr("doc_id", "text", "if(doc_id = 3, null, lang) as lang", "source", "n_chars")
    assert {r["lang"] for r in p.language(spark, d, "").collect()} <= {"en", "de"}
