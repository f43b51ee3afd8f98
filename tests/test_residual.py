import os

import duckdb
import pytest

from umbra import release
from umbra.errors import Refused
from umbra.operators import boxes, costs, policy, residual
from umbra.plans import catalogue
from umbra.plans.sql import over

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["verify_locations", "verify_subjects", "leak_scan", "word_boxes", "cost_estimates"])
def test_queries_equal_their_sql(spark, name):
    db = duckdb.connect()
    for t in ("nation", "supplier"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = catalogue.QUERIES[name](spark, DATA)
    want = db.execute(catalogue.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = sorted(map(tuple, got.select(*[f"`{c}`" for c in columns]).collect()))
    assert rows == sorted(want.fetchall())
    assert rows


def test_locations(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 2), (None, "z", 3), (4, "w", 4), (5, "v", 5), (5, "v", 5)], "k int, t string, n int")
    b = spark.createDataFrame([(1, "x", None), (2, "Y", None), (None, "z", 3), (5, "v", 5), (6, "u", 6)], "k int, t string, n int")
    got = {tuple(r) for r in residual.locations(a, b, ["k"], ["t", "n"]).collect()}
    assert got == {(2, "differs:t"), (2, "differs:n"), (4, "missing"), (5, "repeated"), (6, "added")}
    assert residual.locations(a.limit(0), b.limit(0), ["k"], ["t"]).count() == 0
    with pytest.raises(Refused):
        residual.locations(a, b.withColumn("n", b.n.cast("string")), ["k"], ["n"])


def test_leaks(spark):
    d = spark.createDataFrame([(1, "cafe\u0301 INDIANA"), (2, None), (3, ""), (4, "caf\u00e9")], "k int, t string")
    got = sorted(map(tuple, residual.leaks(d, "k", ["t"], ["INDIA", "INDIANA", "caf\u00e9", "cafe\u0301", ""]).collect()))
    assert got == [(1, "t", "INDIA"), (1, "t", "INDIANA"), (1, "t", "cafe\u0301"), (1, "t", "caf\u00e9"), (4, "t", "cafe\u0301"), (4, "t", "caf\u00e9")]
    assert residual.leaks(d, "k", ["t"], []).count() == 0


def test_boxes(spark):
    words = [(1, i, t, 10 * i, i, 8, 5) for i, t in enumerate(["Tessa", "--", "QUIL", "lon!", "Tes", None, "saQuillon"])]
    d = spark.createDataFrame(words, "page int, position int, text string, left int, top int, width int, height int")
    goals = spark.createDataFrame([("a", "Tessa Quillon"), ("b", "tes"), ("c", "--"), ("d", None)], "rule_id string, value string")
    got = sorted(map(tuple, boxes.matching(d, goals).collect()))
    assert got == [(1, "a", 0, 3, 0, 0, 38, 8), (1, "a", 4, 6, 40, 4, 68, 11), (1, "b", 4, 4, 40, 4, 48, 9)]
    assert boxes.matching(d.limit(0), goals).count() == 0


def test_costs_equal_published_ones(spark):
    d = spark.createDataFrame([(1, 1e12), (2, 1e15), (3, None)], "k int, bytes double")
    got = {(r["k"], r["scenario"]): r for r in over(costs.estimate("k"), d).collect()}
    one, most = got[1, "base"], got[2, "base"]
    assert (one["storage_usd"], one["requests_usd"], one["orchestration_usd"], one["compute_usd"], one["total_usd"], one["hours"]) == (69.0, 10.89, 4.44, 1.4, 85.73, 0.14)
    assert (most["total_usd"], most["hours"]) == (85733.9, 141.67)
    assert [got[2, x]["total_usd"] for x in ("half_throughput", "double_throughput", "tenth_file_size")] == [87132.72, 85034.49, 223749.65]
    assert got[3, "base"]["total_usd"] is None


def test_verification_in_tasks(spark, tmp_path):
    p = policy.compiled({"version": 1, "sensitive_values": [{"rule_id": "a", "type": "name", "value": "Tessa"}], "protected_values": [{"value": "Fern"}]})
    token = p.exact["Tessa"]
    for root in ("in", "out"):
        os.makedirs(tmp_path / root / "d e")
    (tmp_path / "in" / "a.txt").write_text("Tessa of Fern\n")
    (tmp_path / "in" / "d e" / "b.txt").write_text("nobody\n")
    (tmp_path / "out" / "d e" / "b.txt").write_text("nobody\n")
    found = lambda: release.verdict(release.verification(spark, tmp_path / "in", tmp_path / "out", p))
    assert found()[0] == ["file-set"]
    (tmp_path / "out" / "a.txt").write_text(f"{token} of Fern\n")
    assert found() == ([], 1)
    (tmp_path / "out" / "a.txt").write_text("someone of F\n")
    assert found()[0] == ["protected-changed", "content-differs", "identity-missing"]
    (tmp_path / "out" / "a.txt").write_text("Tessa of Fern\n")
    assert found()[0] == ["literal-left", "content-differs", "identity-missing"]
