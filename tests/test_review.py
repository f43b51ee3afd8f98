"""Discovery, review and approval of a bundle; the commands around a release."""

import json
import sqlite3
import stat

import pytest

from umbra import review
from umbra.__main__ import main
from umbra.errors import Refused

POLICY = {"version": 1, "sensitive_values": [{"rule_id": r, "subject_id": f"s-{r}", "type": "name", "value": r} for r in ("Alice", "Alina", "Alisa")], "protected_values": [{"value": "Northwind"}]}


@pytest.fixture
def bundle(tmp_path):
    root = tmp_path / "in"
    (root / "corpus").mkdir(parents=True)
    (root / "policy.json").write_text(json.dumps(POLICY))
    (root / "corpus" / "a.csv").write_text('Alicee,b\nAlicee,Northwind Inc\nAlice,"x, 1"\n')
    (root / "corpus" / "b.json").write_text('{"Alicee": ["Alicee", 5, {"k": "Alita"}]}')
    (root / "corpus" / "c.txt").write_text("Alicee\nnothing like it\n")
    db = sqlite3.connect(root / "corpus" / "d.sqlite")
    db.execute("CREATE TABLE t (a TEXT, b INTEGER)")
    db.execute("INSERT INTO t VALUES ('Alicee', 3)")
    db.commit()
    db.close()
    return root


def test_review_and_approval(spark, bundle, tmp_path):
    rows = {tuple(r) for r in review.intake(spark, bundle / "corpus").collect()}
    assert ("a.csv", "0/Alicee", "Alicee", None) in rows and ("b.json", "/Alicee/2/k", "Alita", None) in rows and ("d.sqlite", "t/1/a", "Alicee", None) in rows and ("c.txt", "0", "Alicee", None) in rows and len(rows) == 9
    found = review.discover(spark, str(bundle), 80, 5)
    assert [(p["value"], p["rule_id"], p["subject_id"], p["occurrences"]) for p in found["proposals"]] == [("Alicee", "Alice", "s-Alice", 4)]
    assert found["counts"] == {"proposed": 1, "known": 1, "protected": 1, "noise": 1, "low_score": 1, "ambiguous": 1} and found == review.discover(spark, str(bundle), 80, 5)
    at, out = tmp_path / "review.json", tmp_path / "policy.json"
    at.write_text(json.dumps(found))
    one = found["proposals"][0]["id"]
    for ids, code in (([], "approval-rejected"), ([one, one], "approval-rejected"), (["x"], "approval-rejected")):
        with pytest.raises(Refused, match=code):
            review.approve(spark, str(bundle), str(at), ids, str(out))
    with pytest.raises(Refused, match="nested-roots"):
        review.approve(spark, str(bundle), str(at), [one], str(bundle / "p.json"))
    (tmp_path / "forged.json").write_text(json.dumps(found | {"counts": {}}))
    with pytest.raises(Refused, match="review-invalid"):
        review.approve(spark, str(bundle), str(tmp_path / "forged.json"), [one], str(out))
    receipt = review.approve(spark, str(bundle), str(at), [one], str(out))
    assert receipt == json.loads((tmp_path / "policy.json.approval.json").read_text()) and stat.S_IMODE(out.stat().st_mode) == 0o600
    more = json.loads(out.read_text())["sensitive_values"][-1]
    assert (more["rule_id"], more["subject_id"], more["value"]) == (f"fuzzy-{one}", "s-Alice", "Alicee")
    with pytest.raises(Refused, match="output-exists"):
        review.approve(spark, str(bundle), str(at), [one], str(out))
    (bundle / "corpus" / "c.txt").write_text("Alicee\n")
    with pytest.raises(Refused, match="discovery-stale"):
        review.approve(spark, str(bundle), str(at), [one], str(tmp_path / "other.json"))
    (bundle / "corpus" / "e.json").write_text('{"a": 1, "a": 2}')
    with pytest.raises(Refused, match="duplicate-key"):
        review.discover(spark, str(bundle))


def test_commands(spark, tmp_path, capsys):
    def said(code, *arguments):
        assert main([str(a) for a in arguments], spark) == code
        return json.loads(capsys.readouterr().out.splitlines()[-1])

    demo = said(0, "demo", tmp_path / "demo", "--records", 12)
    assert (demo["files"], demo["records"]) == (4, 12 + 12 + 12 + 14) and b"Mara" not in (tmp_path / "demo" / "corpus" / "customers.csv").read_bytes()
    assert said(0, "bench-once", "--records", 5)["records"] == 22
    assert said(0, "explain")["not_claimed"]
    (tmp_path / "p.json").write_text(json.dumps(POLICY))
    (tmp_path / "one.txt").write_text("by Alice of Northwind")
    assert said(0, "anonymize", tmp_path / "one.txt", tmp_path / "anon", "--policy", tmp_path / "p.json")["replacements"] == 1
    assert (tmp_path / "anon" / "corpus" / "one.txt").read_text().startswith("by Person-")
    assert said(1, "anonymize", tmp_path, tmp_path / "x", "--policy", tmp_path / "p.json") == {"error": "nested-roots"}
    (tmp_path / "in" / "corpus").mkdir(parents=True)
    (tmp_path / "in" / "policy.json").write_text(json.dumps(POLICY))
    (tmp_path / "in" / "corpus" / "a.txt").write_text("Alicee\n")
    assert said(0, "discover", tmp_path / "in", tmp_path / "r.json")["counts"]["proposed"] == 1
    one = json.loads((tmp_path / "r.json").read_text())["proposals"][0]["id"]
    assert said(0, "approve-discovery", tmp_path / "in", tmp_path / "r.json", tmp_path / "p2.json", "--id", one)["ids"] == [one]
    assert said(0, "model-privacy-applicability", "--release-kind", "learned_model")["verdict"] == "adapter_required"
    (tmp_path / "w.csv").write_text("i,j,g\n0,0,2\n0,1,-4\n1,0,3\n1,1,-6\n")
    (tmp_path / "b.csv").write_text("i,g\n0,2\n1,3\n")
    assert said(2, "model-gradient-inversion", tmp_path / "w.csv", tmp_path / "b.csv") == {"inputs": 2, "agreeing": 2, "verdict": "reconstructed"}
    (tmp_path / "w.csv").write_text("i,j,g\n0,0,2\n1,0,9\n")
    assert said(0, "model-gradient-inversion", tmp_path / "w.csv", tmp_path / "b.csv")["verdict"] == "clear"
    (tmp_path / "x.pdf").write_bytes(b"%PDF")
    assert said(1, "redact-document", tmp_path / "x.pdf", tmp_path / "y.pdf", "--policy", tmp_path / "p.json", "--receipt", tmp_path / "z.json") == {"error": "document-kind"}
