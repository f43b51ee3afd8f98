import json

import pytest

from umbra.__main__ import main
from umbra.operators import discovery, gradients, policy


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "r.csv").write_text("id,zip,age,c\n1,a,20,x\n2,a,20,y\n3,b,30,y\n")
    (tmp_path / "p.csv").write_text("zip,age\n" + "a,20\n" * 4 + "b,30\n" * 2)
    r, p = str(tmp_path / "r.csv"), str(tmp_path / "p.csv")
    qi = ["--qi", "zip", "--qi", "age"]
    assert main(["tabular-risk", r, *qi, "--sensitive", "c"], spark) == 0
    assert json.loads(capsys.readouterr().out)["k_anonymity"] == 1
    assert main(["population-k-map", r, p, *qi, "--k", "2"], spark) == 0
    assert main(["population-k-map", r, p, *qi, "--k", "3"], spark) == 2
    assert main(["singling-out-risk", r, *qi, "--row-id", "id"], spark) in (0, 2)
    assert main(["delta-presence-risk", r, p, *qi], spark) == 0
    assert main(["tabular-suppress", r, str(tmp_path / "o"), *qi, "--k", "2"], spark) == 0
    capsys.readouterr()
    assert main(["tabular-risk", str(tmp_path / "none.csv"), *qi, "--sensitive", "c"], spark) == 1
    assert "none.csv" not in capsys.readouterr().out


def said(capsys):
    return json.loads(capsys.readouterr().out)


def test_tables(spark, tmp_path, capsys):
    at = lambda name: str(tmp_path / name)
    (tmp_path / "r.csv").write_text("zip,age,c\n" + "".join(f"{z},{g},{c}\n" for z, g, c in (("a1", 20, "x"), ("a1", 21, "y"), ("a2", 22, "x"), ("a2", 23, "y"), ("b1", 40, "x"), ("b1", 41, "y"), ("b2", 42, "x"), ("b2", 43, "y"))))
    (tmp_path / "e.csv").write_text("zip,age,c,g\na1,20,x,1\nb2,43,y,1\nb2,42,y,2\n")
    (tmp_path / "h.json").write_text(json.dumps({"zip": {z: [z[0], "*"] for z in ("a1", "a2", "b1", "b2")}}))
    (tmp_path / "bounds.json").write_text(json.dumps({"age": [21, 42]}))
    common = ["--hierarchy", at("h.json"), "--sensitive", "c"]
    assert main(["tabular-generalize", at("r.csv"), at("g"), "--qi", "zip", "--k", "4", *common], spark) == 0
    got = said(capsys)
    assert (got["rows"], got["kept"], got["k_anonymity"]) == (8, 8, 4)
    assert main(["tabular-generalize", at("r.csv"), at("g2"), "--qi", "zip", "--k", "9", *common], spark) == 1
    assert main(["tabular-local", at("r.csv"), at("l"), "--qi", "zip", "--k", "4", *common], spark) == 0
    assert main(["tabular-advanced", at("r.csv"), at("v"), "--qi", "zip", "--k", "4", *common, "--alpha", "0.6", "--recursive-l", "2", "--recursive-c", "1", "--beta", "1", "--t", "0.1"], spark) == 0
    assert main(["tabular-advanced", at("r.csv"), at("v2"), "--qi", "zip", "--k", "4", *common, "--alpha", "0.4", "--recursive-l", "2", "--recursive-c", "1", "--beta", "1", "--t", "0.1"], spark) == 1
    capsys.readouterr()
    assert main(["tabular-microaggregate", at("r.csv"), at("m"), "--qi", "age", "--numeric", "age", "--k", "4", "--bounds", at("bounds.json"), "--sensitive", "c"], spark) == 0
    assert said(capsys)["k_anonymity"] == 4
    assert {r["age"] for r in spark.read.csv(at("m"), header=True).collect()} == {"21.75", "41.25"}
    # the nearest by number and text; the groups' accuracies
    assert main(["attribute-inference-risk", at("r.csv"), at("e.csv"), "--qi", "zip", "--qi", "age", "--sensitive", "c", "--group-by", "g"], spark) == 2
    got = said(capsys)
    assert (got["evaluated"], got["inferred"], got["group_count"], got["minimum_accuracy"], got["maximum_accuracy"]) == (3, 3, 2, 0, 1)
    assert main(["attribute-inference-risk", at("r.csv"), at("e.csv"), "--qi", "zip", "--sensitive", "c", "--predictor", "exact_match"], spark) == 0
    assert said(capsys)["abstained"] == 3
    (tmp_path / "a.csv").write_text("id,zip,age\n1,a1,20\n2,b2,43\n")
    (tmp_path / "b.csv").write_text("id,age\n1,20\n2,43\n")
    views = [at("a.csv"), at("b.csv"), "--subject", "id", "--column-a", "zip", "--column-a", "age", "--column-b", "age"]
    assert main(["two-view-linkability", at("r.csv"), *views], spark) == 2
    assert said(capsys)["links"] == 2
    assert main(["two-view-linkability", at("r.csv"), *views, "--control", at("r.csv")], spark) == 0
    (tmp_path / "b2.csv").write_text("id,age\n1,20\n3,43\n")
    assert main(["two-view-linkability", at("r.csv"), at("a.csv"), at("b2.csv"), *views[2:]], spark) == 1
    capsys.readouterr()
    assert main(["dp-count", at("r.csv"), "--column", "c", "--equals", "x", "--epsilon", "1"], spark) == 0
    assert said(capsys)["count"] >= 0
    (tmp_path / "q.json").write_text(json.dumps({"queries": [{"column": "c", "equals": v, "epsilon": "1"} for v in "xy"]}))
    batch = ["dp-count-batch", at("r.csv"), "--query-plan", at("q.json"), "--maximum-epsilon", "3", "--budget-ledger", at("ledger"), "--budget-id", "me"]
    assert main(batch, spark) == 0 and len(said(capsys)["counts"]) == 2 and main(batch, spark) == 1
    (tmp_path / "d.json").write_text(json.dumps({"c": ["x", "y"]}))
    assert main(["dp-synthesize", at("r.csv"), at("s"), "--domain", at("d.json"), "--epsilon", "1"], spark) == 0


def test_graph_command(spark, tmp_path, capsys):
    clue = lambda *xs: [{"type": "t", "value": x} for x in xs]
    (tmp_path / "notes.txt").write_text("Met at the OLD mill; drives a red van. Milling about.")
    base = {"authorized": True, "auxiliary_identities": [{"identity_id": "i", "clues": clue("old mill", "red van")}, {"identity_id": "j", "clues": clue("mill", "boat")}]}
    by_file = base | {"clue_catalog": clue("old mill", "red van", "boat", "milli"), "subject_sources": [{"subject_id": "s", "files": ["notes.txt"]}]}
    given = base | {"subjects": [{"subject_id": "s", "clues": clue("boat", "x")}, {"subject_id": "r", "clues": clue("y")}]}
    edges = lambda *pairs: {"relationship_edges": [{"from": a, "to": b, "type": "contextual_link"} for a, b in pairs]}
    cases = [
        (by_file, 2, {"inferred": 1, "clear": 0, "maximum_shared": 2}),
        (given, 0, {"clear": 2, "maximum_shared": 1}),
        (given | edges(("subject:r", "a"), ("a", "b"), ("b", "a"), ("b", "identity:j")), 2, {"inferred": 1, "clear": 1}),
        (given | edges(("subject:r", "a"), ("a", "identity:i"), ("a", "identity:j")), 2, {"ambiguous": 1, "clear": 1}),
        (given | edges(("subject:none", "identity:j")), 1, {}), (given | edges(("a", "b"), ("a", "b")), 1, {}), (given | {"authorized": False}, 1, {}),
        (given | {"subjects": given["subjects"] * 2}, 1, {}), (base | {"subjects": [{"subject_id": "s", "clues": []}]}, 1, {}), (by_file | {"subject_sources": [{"subject_id": "s", "files": ["../x.txt"]}]}, 1, {}),
    ]
    for payload, code, want in cases:
        (tmp_path / "graph.json").write_text(json.dumps(payload))
        assert main(["contextual-graph-risk", str(tmp_path / "graph.json")], spark) == code
        got = said(capsys)
        assert want.items() <= got.items(), (want, got)


def test_discovery(spark):
    p = policy.compiled({"version": 1, "sensitive_values": [{"rule_id": r, "type": "name", "value": r} for r in ("Alice", "Alina", "Alisa")], "protected_values": [{"value": "Northwind"}]})
    d = spark.createDataFrame([(v,) for v in ("Alicee", "Alicee", "Alita", "Alice", "Northwind", "x1")], "value string")
    got = {r["value"]: (r["status"], r["occurrences"]) for r in discovery.propose(d, p, 80, 5).collect()}
    assert got["Alicee"] == ("proposed", 2) and got["Alita"][0] == "ambiguous" and got["Alice"][0] == "known" and got["Northwind"][0] == "protected" and got["x1"][0] == "noise"
    assert discovery.indel_ratio("Alicee", "Alice") == pytest.approx(90.909, abs=1e-3)


def test_gradients(spark):
    x, b = [1.0, -2.0, 3.0], [0.5, 0.0, 2.0]
    w = spark.createDataFrame([(i, j, bi * xj) for i, bi in enumerate(b) for j, xj in enumerate(x)], "i int, j int, g double")
    got = {r["j"]: (r["value"], r["agree"], r["evidence"]) for r in gradients.invert(w, spark.createDataFrame(list(enumerate(b)), "i int, g double")).collect()}
    assert got == {j: (pytest.approx(v), True, 2) for j, v in enumerate(x)}
    assert gradients.applicability("file_only") == {"verdict": "not_applicable"}
