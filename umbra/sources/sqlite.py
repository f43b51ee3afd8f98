"""SQLite databases: a hardened read-only snapshot, gates for what its schema could compute or hide, and a partitioned source.

    spark.dataSource.register(SqliteSource)
    spark.read.format("umbra_sqlite").option("path", "/shared/x.sqlite").load()

gives (table, rowid, column, kind, value), a row a cell: kind is null, integer, real or text, value its text.  Each partition reads
one table's rowid range on a connection of its own, so tables of any size are read by several tasks and never held.  The file must
lie where executors can open it; option `rows` is about how many rows a partition reads, `table` names one table.
"""

from __future__ import annotations

import re
import sqlite3
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import Refused

#: Rows that a partition reads, cells of a batch.
ROWS, BATCH = 100_000, 16_384

# fixed values: big-endian integers of the file's header, by offset and width
HEADER = ((16, 2), (18, 1), (19, 1), (20, 1), (21, 1), (22, 1), (23, 1), (24, 4), (28, 4), (32, 4), (36, 4), (40, 4), (44, 4), (48, 4), (52, 4), (56, 4), (60, 4), (64, 4), (68, 4), (92, 4), (96, 4))
# fixed values: functions and words whose value changes from one evaluation to the next
CHANGING = frozenset("random randomblob date time datetime julianday unixepoch timediff strftime changes total_changes last_insert_rowid sqlite_version sqlite_source_id current_timestamp current_time current_date".split())
NOW = frozenset("current_timestamp current_time current_date".split())


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def header_integers(data: bytes) -> list[int]:
    """The integers of a file's first 100 bytes; a page size of 1 stands for 65536."""
    found = {(at, n): int.from_bytes(data[at : at + n], "big") for at, n in HEADER if at + n <= min(100, len(data))}
    if found.get((16, 2)) == 1:
        found[16, 2] = 65_536
    return list(found.values())


_DDL = re.compile(r"""(?P<space>\s+|--[^\n]*|/\*.*?(?:\*/|\Z))|(?P<blob>[xX]'[^']*')|(?P<text>'(?:[^']|'')*')|(?P<name>"(?:[^"]|"")*"|`(?:[^`]|``)*`|\[[^\]]*\])|(?P<number>(?:0[xX][0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?))|(?P<word>[^\W\d][\w$]*)|(?P<sign>.)""", re.S)


@dataclass(frozen=True)
class Token:
    kind: str
    text: str

    def says(self, *words: str) -> bool:
        return self.kind in ("word", "sign") and self.text.lower() in words


def tokens(sql: str) -> list[Token]:
    return [Token(m.lastgroup, m.group()) for m in _DDL.finditer(sql) if m.lastgroup != "space"]


def _closing(t: list[Token], at: int) -> int:
    """The place after the parenthesis that closes the one at `at`."""
    depth = 0
    for i in range(at, len(t)):
        depth += t[i].says("(") - t[i].says(")")
        if not depth:
            return i + 1
    return len(t)


def _constant(t: list[Token]) -> bool:
    """Whether tokens are one literal, in whatever parentheses and with whatever sign."""
    while len(t) > 1 and t[0].says("(") and _closing(t, 0) == len(t):
        t = t[1:-1]
    while len(t) > 1 and t[0].says("+", "-"):
        t = t[1:]
        if t[0].kind != "number":
            return False
    return len(t) == 1 and (t[0].kind in ("text", "blob", "number", "name") or t[0].says("null", "true", "false", *NOW))


def computed_default(sql: str) -> bool:
    """Whether a CREATE TABLE has a DEFAULT that is more than a literal."""
    t = tokens(sql)
    for i, x in enumerate(t[:-1]):
        if x.says("default"):
            end = _closing(t, i + 1) if t[i + 1].says("(") else i + 2 + t[i + 1].says("+", "-")
            if not _constant(t[i + 1 : end]):
                return True
    return False


def computed_index(sql: str) -> bool:
    """Whether a CREATE INDEX has a condition, or a term that isn't a column with its collation and direction."""
    t = tokens(sql)
    start = next((i for i, x in enumerate(t) if x.says("(")), len(t))
    end = _closing(t, start)
    if end < len(t):
        return True
    term: list[Token] = []
    for x in [*t[start + 1 : end - 1], Token("sign", ",")]:
        if not x.says(","):
            term.append(x)
            continue
        rest = term[1:]
        if rest and rest[0].says("collate"):
            rest = rest[2:]
        if rest and rest[0].says("asc", "desc"):
            rest = rest[1:]
        if rest or not term or term[0].kind not in ("word", "name"):
            return True
        term = []
    return False


def changing_view(sql: str) -> bool:
    """Whether a view calls a function, or names a word, that gives another value each time."""
    t = tokens(sql)
    return any(x.kind == "word" and x.text.lower() in CHANGING and (x.text.lower() in NOW or i + 1 < len(t) and t[i + 1].says("(")) for i, x in enumerate(t))


def gated(db: sqlite3.Connection, header: bytes = b"", holds: Callable[[str], bool] = lambda text: False, numbers: Callable[[int], list[str]] = lambda n: [str(n)]) -> list[tuple[str, list[str]]]:
    """Tables and their columns.  Refuses what a rewrite by rowid can't keep or reach: triggers, virtual tables, tables without
    rowid or that hide it, generated columns, indexes of expressions or with a condition, computed defaults, changing views,
    and literals in names, schema text or the header's integers."""
    if any(holds(x) for n in header_integers(header) for x in numbers(n)):
        raise Refused("sensitive-header")
    out = []
    for kind, name, owner, sql in db.execute("SELECT type, name, tbl_name, coalesce(sql, '') FROM sqlite_master ORDER BY name").fetchall():
        if holds(name) or holds(owner) or holds(sql):
            raise Refused("sensitive-schema")
        t = tokens(sql)
        if kind == "trigger" or len(t) > 1 and t[1].says("virtual"):
            raise Refused("sqlite-schema")
        if kind == "index" and sql and computed_index(sql) or kind == "view" and changing_view(sql) or kind == "table" and computed_default(sql):
            raise Refused("sqlite-executable-schema")
        if kind != "table" or name.startswith("sqlite_"):
            continue
        body = _closing(t, next((i for i, x in enumerate(t) if x.says("(")), len(t)))
        if any(x.says("without") for x in t[body:]):
            raise Refused("sqlite-schema")
        columns = db.execute(f"PRAGMA table_xinfo({quoted(name)})").fetchall()
        if any(holds(c[1]) for c in columns):
            raise Refused("sensitive-schema")
        own = {c[1].lower() for c in columns if not (c[5] and (c[2] or "").upper() == "INTEGER")}
        if any(c[6] for c in columns) or own & {"rowid", "oid", "_rowid_"}:
            raise Refused("sqlite-columns")
        out.append((name, [c[1] for c in columns]))
    return out


def hardened(db: sqlite3.Connection) -> sqlite3.Connection:
    db.execute("PRAGMA trusted_schema = OFF")
    db.execute("PRAGMA cell_size_check = ON")
    return db


def read_only(path: str) -> sqlite3.Connection:
    """A hardened connection that can't write."""
    from urllib.parse import quote

    try:
        db = hardened(sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True))
        db.execute("SELECT 1 FROM sqlite_master LIMIT 1").fetchone()
        return db
    except sqlite3.Error:
        raise Refused("sqlite") from None


def snapshot(path: str, to: str) -> sqlite3.Connection:
    """A consistent copy of a database, made by the backup interface after its integrity was checked; a connection to it."""
    source = read_only(path)
    try:
        if source.execute("PRAGMA integrity_check").fetchone()[0] != "ok":
            raise Refused("sqlite-integrity")
        copy = sqlite3.connect(to, isolation_level=None)
        source.backup(copy)
        return hardened(copy)
    except sqlite3.Error:
        raise Refused("sqlite") from None
    finally:
        source.close()


@dataclass
class Range(InputPartition):
    table: str
    columns: list[str]
    first: int
    last: int


KINDS = {type(None): "null", int: "integer", float: "real", str: "text"}


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict):
        if "path" not in options:
            raise Refused("sqlite-path")
        self.path = options["path"].removeprefix("file://")
        self.rows = int(options.get("rows", ROWS))
        self.table = options.get("table")

    def partitions(self) -> list[Range]:
        """Of each table ranges of rowids, as many as its rows call for."""
        out = []
        db = read_only(self.path)
        try:
            with open(self.path, "rb") as f:
                header = f.read(100)
            for table, columns in gated(db, header):
                if self.table not in (None, table):
                    continue
                n, low, high = db.execute(f"SELECT count(*), min(rowid), max(rowid) FROM {quoted(table)}").fetchone()
                if n:
                    step = max(1, -(-(high - low + 1) // -(-n // self.rows)))
                    out += [Range(table, columns, a, min(a + step - 1, high)) for a in range(low, high + 1, step)]
        finally:
            db.close()
        return out or [Range("", [], 0, -1)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.table:
            return
        db = read_only(self.path)
        try:
            held: list[tuple] = []
            select = f"SELECT rowid, {', '.join(map(quoted, partition.columns))} FROM {quoted(partition.table)} WHERE rowid BETWEEN ? AND ?"
            for rowid, *values in db.execute(select, (partition.first, partition.last)):
                for c, v in zip(partition.columns, values):
                    if isinstance(v, bytes):
                        raise Refused("blob")
                    held.append((partition.table, rowid, c, KINDS[type(v)], None if v is None else repr(v) if isinstance(v, float) else str(v)))
                if len(held) >= BATCH:
                    yield _batch(held)
                    held = []
            if held:
                yield _batch(held)
        finally:
            db.close()


_CELLS = pa.schema([("table", pa.string()), ("rowid", pa.int64()), ("column", pa.string()), ("kind", pa.string()), ("value", pa.string())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_CELLS)], schema=_CELLS)


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "umbra_sqlite"

    def schema(self) -> str:
        return "`table` string, rowid long, `column` string, kind string, value string"

    def reader(self, schema) -> SqliteReader:
        return SqliteReader(dict(self.options))
