"""SQLite: what schemas are refused, what is rewritten, and tables read by rowid ranges."""

import sqlite3

import pytest

from umbra.errors import Refused
from umbra.operators import policy
from umbra.sources import formats, sqlite

POLICY = policy.compiled({"version": 1, "sensitive_values": [{"rule_id": "n", "type": "name", "value": "Mara Ellison"}, {"rule_id": "p", "type": "phone", "value": "5551234567"}, {"rule_id": "s", "type": "secret", "value": "424242"}], "protected_values": []})


def made(*statements):
    db = sqlite3.connect(":memory:")
    for x in statements:
        db.execute(x)
    db.commit()
    return db.serialize()


def code(*statements):
    try:
        formats.sqlite_file(made(*statements), formats.Matcher(POLICY))
    except Refused as e:
        return e.code
    return "accepted"


T = "CREATE TABLE t (id INTEGER PRIMARY KEY, a TEXT, b)"


@pytest.mark.parametrize("statements, want", [
    ([T], "accepted"),
    ([T, "CREATE INDEX i ON t (a COLLATE NOCASE DESC, \"b\")"], "accepted"),
    ([T, "CREATE INDEX i ON t (char(83, 84))"], "sqlite-executable-schema"),
    ([T, "CREATE INDEX i ON t (a || b)"], "sqlite-executable-schema"),
    ([T, "CREATE INDEX i ON t (a) /* x */ where b > 1"], "sqlite-executable-schema"),
    ([T, "CREATE INDEX i ON t (a) -- where\n"], "accepted"),
    (["CREATE TABLE t (a TEXT DEFAULT 'x''(y)', b REAL DEFAULT -1.5e3, c DEFAULT (7), d DEFAULT x'00', e DEFAULT NULL, f DEFAULT CURRENT_DATE)"], "accepted"),
    (["CREATE TABLE t (a TEXT DEFAULT (char(65)))"], "sqlite-executable-schema"),
    (["CREATE TABLE t (a TEXT DEFAULT ('a' || 'b'))"], "sqlite-executable-schema"),
    ([T, "CREATE VIEW v AS SELECT a FROM t"], "accepted"),
    ([T, "CREATE VIEW v AS SELECT 'random()' AS \"date\" FROM t"], "accepted"),
    ([T, "CREATE VIEW v AS SELECT random /* ( */ () FROM t"], "sqlite-executable-schema"),
    ([T, "CREATE VIEW v AS SELECT current_timestamp"], "sqlite-executable-schema"),
    ([T, "CREATE VIEW v AS SELECT 'Mara Ellison'"], "sensitive-schema"),
    (["CREATE TABLE t (a TEXT CHECK (a <> 'Mara Ellison'))"], "sensitive-schema"),
    (["CREATE TABLE t (\"Mara Ellison\" TEXT)"], "sensitive-schema"),
    (["CREATE TABLE t (a TEXT PRIMARY KEY) WITHOUT ROWID"], "sqlite-schema"),
    (["CREATE TABLE t (a TEXT) -- without rowid\n"], "accepted"),
    ([T, "CREATE TRIGGER g AFTER INSERT ON t BEGIN SELECT 1; END"], "sqlite-schema"),
    (["CREATE TABLE t (rowid TEXT, a TEXT)"], "sqlite-columns"),
    (["CREATE TABLE t (rowid INTEGER PRIMARY KEY, a TEXT)"], "accepted"),
    (["CREATE TABLE t (a TEXT, b TEXT GENERATED ALWAYS AS (a || 'x') STORED)"], "sqlite-columns"),
    ([T, "INSERT INTO t VALUES (1, x'00', 2)"], "blob"),
    ([T, "PRAGMA user_version = 424242"], "sensitive-header"),
    ([T, "PRAGMA application_id = 424242"], "sensitive-header"),
])
def test_gates(statements, want):
    assert code(*statements) == want


def test_rewritten(tmp_path):
    data = made("CREATE TABLE u (id INTEGER PRIMARY KEY, n TEXT)", "CREATE TABLE a (id INTEGER PRIMARY KEY, u INTEGER REFERENCES u (id), phone INTEGER)", "INSERT INTO u VALUES (-5, 'Mara Ellison'), (9223372036854775807, 'other')", "INSERT INTO a VALUES (1, -5, 5551234567), (2, 9223372036854775807, 7)")
    out, records, n = formats.sqlite_file(data, formats.Matcher(POLICY))
    db = sqlite3.connect(":memory:")
    db.deserialize(out)
    assert (records, n) == (4, 2) and b"Mara Ellison" not in out
    assert db.execute("SELECT n FROM u ORDER BY id").fetchall()[0][0].startswith("Person-") and db.execute("SELECT u, typeof(phone) FROM a ORDER BY id").fetchall() == [(-5, "text"), (9223372036854775807, "integer")]
    with pytest.raises(Refused, match="sqlite"):
        formats.sqlite_file(data[:3000] + bytes(1000) + data[4000:], formats.Matcher(POLICY))
    with pytest.raises(Refused, match="sqlite"):
        formats.sqlite_file(b"not a database", formats.Matcher(POLICY))


def test_read_in_ranges(spark, tmp_path):
    path = str(tmp_path / "big file.sqlite")
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE t (a TEXT, b)")
    db.execute("CREATE TABLE empty (x)")
    db.executemany("INSERT INTO t VALUES (?, ?)", ((f"v{i % 7}", [i, None, i / 2][i % 3]) for i in range(200_000)))
    db.execute("CREATE TABLE other (x)")
    db.execute("INSERT INTO other VALUES ('only')")
    db.commit()
    db.close()
    spark.dataSource.register(sqlite.SqliteSource)
    d = spark.read.format("umbra_sqlite").option("path", path).option("rows", 30_000).load()
    assert d.rdd.getNumPartitions() == 8
    got = {(r["table"], r["column"], r["kind"]): r["count"] for r in d.groupBy("table", "column", "kind").count().collect()}
    assert got == {("t", "a", "text"): 200_000, ("t", "b", "integer"): 66_667, ("t", "b", "null"): 66_667, ("t", "b", "real"): 66_666, ("other", "x", "text"): 1}
    assert d.where("table = 't' and rowid = 3 and column = 'b'").first()["value"] == "1.0"
    one = spark.read.format("umbra_sqlite").option("path", path).option("table", "empty").load()
    assert one.count() == 0
    db = sqlite3.connect(path)
    db.execute("CREATE INDEX i ON t (lower(a))")
    db.close()
    with pytest.raises(Exception, match="sqlite-executable-schema"):
        spark.read.format("umbra_sqlite").option("path", path).load().count()
