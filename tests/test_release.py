import json
import sqlite3

import pytest

from umbra import release
from umbra.errors import Refused
from umbra.operators import policy
from umbra.sources import formats, tables

RULES = {"version": 1, "sensitive_values": [{"rule_id": "a", "subject_id": "p1", "type": "name", "value": "Tessa Quillon"}, {"rule_id": "b", "subject_id": "p1", "type": "email", "value": "tessa@x.test", "case_sensitive": False}, {"rule_id": "c", "subject_id": "p1", "type": "phone", "value": "555-246-1357"}], "protected_values": [{"value": "Fernhill"}]}


@pytest.fixture
def bundle(tmp_path):
    root = tmp_path / "in"
    (root / "corpus" / "d").mkdir(parents=True)
    (root / "policy.json").write_text(json.dumps(RULES))
    (root / "corpus" / "a.csv").write_text('id,name\r\n1,"Tessa Quillon, Fernhill"\r\n2,x\r\n', newline="")
    (root / "corpus" / "b.json").write_text('[{"n": "TESSA@X.TEST", "p": 5552461357, "k": 1.5}]')
    (root / "corpus" / "d" / "c.txt").write_text("Tessa Quillon\nnobody\n")
    db = sqlite3.connect(root / "corpus" / "e.sqlite")
    db.execute("CREATE TABLE u (id INTEGER PRIMARY KEY, name TEXT NOT NULL, phone INTEGER)")
    db.execute("INSERT INTO u VALUES (1, 'Tessa Quillon', 5552461357), (2, 'x', NULL)")
    db.commit()
    db.close()
    return root


def test_release(spark, bundle, tmp_path):
    report = release.run(spark, str(bundle), str(tmp_path / "out"))
    out = tmp_path / "out" / "corpus"
    assert report["files"] == 4 and report["replacements"] == 6 and report["records"] == 7
    assert b"Fernhill" in (out / "a.csv").read_bytes() and b"\r\n" in (out / "a.csv").read_bytes()
    value = json.loads((out / "b.json").read_text())[0]
    assert value["p"].startswith("+1-555-") and value["k"] == 1.5
    assert sqlite3.connect(out / "e.sqlite").execute("SELECT name FROM u WHERE id = 1").fetchone()[0].startswith("Person-")
    assert json.loads((tmp_path / "out" / "report.json").read_text()) == report


def test_refusals(spark, bundle, tmp_path):
    (bundle / "corpus" / "bad.csv").write_text("a;b\n1;2\n")
    with pytest.raises(Refused, match="csv-dialect"):
        release.run(spark, str(bundle), str(tmp_path / "out"))
    assert not (tmp_path / "out" / "report.json").exists()


def test_verifier_sees_tampering(bundle):
    p = policy.compiled(RULES)
    source = {"c.txt": b"Tessa Quillon of Fernhill"}
    good, _, _ = formats.text_file(source["c.txt"], formats.Matcher(p))
    assert release.verified(source, {"c.txt": good}, p) == []
    assert "literal-left" in release.verified(source, {"c.txt": source["c.txt"]}, p)
    assert "protected-changed" in release.verified(source, {"c.txt": good.replace(b"Fernhill", b"N")}, p)


@pytest.mark.parametrize("data, code", [(b'{"a": 1, "a": 2}', "duplicate-key"), (b'{"a": NaN}', "not-a-number"), (b'{"a": 1e400}', "inexact-number"), (b'{"Tessa Quillon": 1}', "sensitive-key"), (b"\xff", "not-utf-8"), (b"{", "json")])
def test_json(data, code):
    with pytest.raises(Refused) as e:
        formats.json_file(data, formats.Matcher(policy.compiled(RULES)))
    assert e.value.code == code


def test_csv_table(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,\n"a ""q""",3\n')
    assert sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "a.csv")).collect())) == [("1", ""), ('a "q"', "3")]
    (tmp_path / "b.csv").write_text("x,x\n1,2\n")
    with pytest.raises(Refused):
        tables.read_csv(spark, str(tmp_path / "b.csv"))


@pytest.mark.parametrize("change", ["UPDATE u SET phone = 7 WHERE id = 2", "UPDATE u SET name = 'y' WHERE id = 2", "UPDATE u SET phone = '3' WHERE id = 3", "DELETE FROM u WHERE id = 2", "INSERT INTO u VALUES (9, 'z', 1)", "UPDATE u SET id = 8 WHERE id = 2", "ALTER TABLE u ADD COLUMN more", "CREATE INDEX i ON u (name)"])
def test_verifier_sees_sqlite_changes(change):
    p, db = policy.compiled(RULES), sqlite3.connect(":memory:")
    db.executescript("CREATE TABLE u (id INTEGER PRIMARY KEY, name TEXT NOT NULL, phone); INSERT INTO u VALUES (1, 'Tessa Quillon, Fernhill', 5552461357), (2, 'x', NULL), (3, 'w', 3);")
    source = {"e.sqlite": db.serialize()}
    good, _, _ = formats.sqlite_file(source["e.sqlite"], formats.Matcher(p))
    assert release.verified(source, {"e.sqlite": good}, p) == []
    db.deserialize(good)
    db.executescript(change)
    assert "content-differs" in release.verified(source, {"e.sqlite": db.serialize()}, p)
    db.deserialize(good)
    db.executescript("UPDATE u SET name = replace(name, 'Fernhill', 'N')")
    assert "protected-changed" in release.verified(source, {"e.sqlite": db.serialize()}, p)


def test_graph_gate(spark, bundle, tmp_path):
    (bundle / "policy.json").write_text(json.dumps(RULES | {"release_risk": {"contextual_graph_min_shared_clues": 2}}))
    clue = lambda *xs: [{"type": "t", "value": x} for x in xs]
    graph = {"authorized": True, "subjects": [{"subject_id": "s", "clues": clue("a", "b")}], "auxiliary_identities": [{"identity_id": "i", "clues": clue("a", "b")}]}
    with pytest.raises(Refused, match="contextual-graph-missing"):
        release.run(spark, str(bundle), str(tmp_path / "out"))
    (bundle / "contextual_graph.json").write_text(json.dumps(graph))
    with pytest.raises(Refused, match="contextual-graph-risk"):
        release.run(spark, str(bundle), str(tmp_path / "out"))
    assert not (tmp_path / "out" / "report.json").exists()
    graph["subjects"][0]["clues"] = clue("a", "x")
    (bundle / "contextual_graph.json").write_text(json.dumps(graph))
    assert release.run(spark, str(bundle), str(tmp_path / "out"))["status"] == "ready"


def test_killed_anywhere_a_release_is_whole(spark, bundle, tmp_path, monkeypatch):
    """Killed at any system call of the publication, the target shows the old release or the new one, whole."""
    import os

    out = tmp_path / "out"
    old = release.run(spark, str(bundle), str(out))
    assert release.reverified(spark, str(bundle), str(out)) == [] and release.most_frequent_token(spark, str(out)) > 0
    (bundle / "corpus" / "d" / "c.txt").write_text("Tessa Quillon\nnobody\nand more\n")

    class Killed(BaseException):
        pass

    calls, seen, new = ("rename", "replace", "symlink", "fsync", "unlink"), set(), None
    for step in range(60):
        left = [step]
        for name in calls:
            real = getattr(os, name)

            def counted(*a, real=real, **b):
                # calls on the target, not those of adapters' own folders
                if any(str(out) in str(x) for x in a) or real.__name__ == "fsync":
                    if left[0] == 0:
                        raise Killed
                    left[0] -= 1
                return real(*a, **b)

            monkeypatch.setattr(os, name, counted)
        monkeypatch.setattr(release.shutil, "rmtree", lambda *a, **b: None)  # a killed run clears nothing
        try:
            new = release.run(spark, str(bundle), str(out))
        except Killed:
            new = None
        monkeypatch.undo()
        report = json.loads((out / "report.json").read_text())
        files = {}
        for p in (out / "corpus").resolve().rglob("*"):
            if p.is_file():
                files[str(p.relative_to((out / "corpus").resolve()))] = release.hashlib.sha256(p.read_bytes()).hexdigest()
        assert release.manifest(files) == report["release_manifest"]
        seen.add(report["release_manifest"])
        if new:
            break
    assert new and new["release_manifest"] in seen and old["release_manifest"] in seen and len(new) == 22
    release.run(spark, str(bundle), str(out))
    assert sorted(p.name for p in out.iterdir() if p.name.startswith(".")) == [os.readlink(out / "current")]


def test_tables_that_fail_their_check_leave_nothing(spark, tmp_path):
    d = spark.createDataFrame([("a", "x, \"y\"\nz"), ("b", "")], "k string, v string")

    def refuse(kept):
        assert sorted(map(tuple, kept.collect())) == [("a", "x, \"y\"\nz"), ("b", "")]
        raise ValueError("no")

    with pytest.raises(ValueError, match="no"):
        tables.committed(d, str(tmp_path / "out"), refuse)
    assert list(tmp_path.iterdir()) == []
    tables.committed(d.limit(0), str(tmp_path / "out"), lambda kept: None)
    with pytest.raises(Refused, match="output-exists"):
        tables.committed(d, str(tmp_path / "out"), lambda kept: None)
