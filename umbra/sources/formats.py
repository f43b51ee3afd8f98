"""Files that are rewritten in their own format: CSV, JSON, text, SQLite.

Each adapter takes a file's bytes and gives bytes, records and replacements, or refuses: what it can't
read exactly it doesn't release.  Whole files are the unit, as dialects, keys and pages are file-wide.
"""

from __future__ import annotations

import csv
import io
import json
import math
import os
import re
import sqlite3
import tempfile
from decimal import Decimal

from . import sqlite
from ..errors import Refused
from ..operators.matching import expression
from ..operators.policy import Policy, ascii_lower

DEEPEST, LONGEST = 200, 1_000_000


class Matcher:
    """The policy's pattern for use on one machine; it matches as the plan of `matching` does."""

    def __init__(self, policy: Policy):
        found = expression(policy)
        self.pattern = re.compile(found) if found else None
        self.policy = policy
        #: literals that a number can't show as written, by the number's digits
        self.padded = {x.lstrip("0") for x in (*policy.exact, *policy.folded) if len(x) >= 7 and x.isdigit() and x.startswith("0")}

    def replace(self, text: str) -> tuple[str, int]:
        if self.pattern is None:
            return text, 0
        exact, folded = self.policy.exact, self.policy.folded
        return self.pattern.subn(lambda m: exact.get(m.group()) or folded[ascii_lower(m.group())], text)

    def holds(self, text: str) -> bool:
        return self.pattern is not None and self.pattern.search(text) is not None


def decoded(data: bytes) -> tuple[str, bool]:
    """Strict UTF-8, and whether a byte order mark came first."""
    mark = data.startswith(b"\xef\xbb\xbf")
    try:
        text = data[3 * mark :].decode("utf-8")
    except UnicodeDecodeError:
        raise Refused("not-utf-8") from None
    if "\0" in text:
        raise Refused("nul")
    return text, mark


def encoded(text: str, mark: bool) -> bytes:
    return (b"\xef\xbb\xbf" if mark else b"") + text.encode()


def text_file(data: bytes, m: Matcher) -> tuple[bytes, int, int]:
    text, mark = decoded(data)
    new, n = m.replace(text)
    return encoded(new, mark), len(text.splitlines()), n


#: A comma-separated file: quoted cells, or cells without quotes, other separators and line ends.
_CELL = r'(?:"(?:[^"]|"")*"|[^",;\t|\r\n]*)'
_CSV = re.compile(rf"{_CELL}(?:,{_CELL})*(?:\r?\n{_CELL}(?:,{_CELL})*)*(?:\r?\n)?")


def csv_file(data: bytes, m: Matcher) -> tuple[bytes, int, int]:
    text, mark = decoded(data)
    if not _CSV.fullmatch(text):
        raise Refused("csv-dialect")
    try:
        rows = list(csv.reader(io.StringIO(text, newline=""), strict=True))
    except csv.Error:
        raise Refused("csv") from None
    if not rows or len(set(rows[0])) < len(rows[0]) or any(not x for x in rows[0]) or any(len(r) != len(rows[0]) for r in rows[1:]):
        raise Refused("csv-shape")
    if any(map(m.holds, rows[0])):
        raise Refused("sensitive-header")
    out, n = io.StringIO(), 0
    to = csv.writer(out, lineterminator="\r\n" if "\r\n" in text else "\n")
    to.writerow(rows[0])
    for row in rows[1:]:
        cells = [m.replace(c) for c in row]
        n += sum(k for _, k in cells)
        to.writerow([c for c, _ in cells])
    return encoded(out.getvalue(), mark), len(rows) - 1, n


class _Number(str):
    """A number as it is written."""


def _unique(pairs: list) -> dict:
    if len({k for k, _ in pairs}) < len(pairs):
        raise Refused("duplicate-key")
    return dict(pairs)


def _float(token: str) -> float:
    value = float(token)
    if not math.isfinite(value) or Decimal(token) != Decimal(repr(value)):
        raise Refused("inexact-number")
    return value


def _constant(token: str) -> None:
    raise Refused("not-a-number")


def number_tokens(value: int | float) -> list[str]:
    """How a number may be written: as it is, as a whole number, in full."""
    if isinstance(value, int):
        return [str(value)]
    forms = [repr(value), *([str(int(value))] if value.is_integer() else []), format(Decimal(value), "f")]
    return list(dict.fromkeys(forms))


def replaced_number(value: int | float, m: Matcher):
    """(value, 0), or its first form that changes, as text."""
    for token in number_tokens(value):
        if (new := m.replace(token))[1]:
            return new
    if not m.padded.isdisjoint(number_tokens(value)):
        raise Refused("lossy-number")
    return value, 0


def _walk(x, m: Matcher, depth: int = 0):
    if depth > DEEPEST:
        raise Refused("too-deep")
    if isinstance(x, dict):
        if any(map(m.holds, x)):
            raise Refused("sensitive-key")
        parts = {k: _walk(v, m, depth + 1) for k, v in x.items()}
        return {k: v for k, (v, _) in parts.items()}, sum(n for _, n in parts.values())
    if isinstance(x, list):
        parts = [_walk(v, m, depth + 1) for v in x]
        return [v for v, _ in parts], sum(n for _, n in parts)
    if isinstance(x, str):
        if len(x) > LONGEST:
            raise Refused("too-long")
        return m.replace(x)
    if isinstance(x, bool) or x is None:
        return x, 0
    return replaced_number(x, m)


def json_value(text: str):
    try:
        return json.loads(text, object_pairs_hook=_unique, parse_float=_float, parse_constant=_constant)
    except (ValueError, RecursionError) as e:
        raise e if isinstance(e, Refused) else Refused("json") from None


def json_file(data: bytes, m: Matcher) -> tuple[bytes, int, int]:
    text, mark = decoded(data)
    x = json_value(text)
    new, n = _walk(x, m)
    return encoded(json.dumps(new, indent=2, ensure_ascii=False) + "\n", mark), len(x) if isinstance(x, list) else 1, n


def sqlite_file(data: bytes, m: Matcher) -> tuple[bytes, int, int]:
    """Cells are rewritten in place, by rowid, in a snapshot; rows are read a batch at a time."""
    with tempfile.TemporaryDirectory() as folder:  # this task's own; the bytes go back to Spark
        path = os.path.join(folder, "db")
        with open(path + "-in", "wb") as f:
            f.write(data)
        db = sqlite.snapshot(path + "-in", path)
        try:
            db.execute("PRAGMA secure_delete = ON")
            db.execute("PRAGMA foreign_keys = ON")
            records = n = 0
            db.execute("BEGIN")
            for table, columns in sqlite.gated(db, data[:100], m.holds, number_tokens):
                select = f"SELECT rowid, {', '.join(map(sqlite.quoted, columns))} FROM {sqlite.quoted(table)} WHERE rowid >= ? ORDER BY rowid LIMIT 10000"
                start = db.execute(f"SELECT min(rowid) FROM {sqlite.quoted(table)}").fetchone()[0]
                while start is not None and (rows := db.execute(select, (start,)).fetchall()):
                    start = rows[-1][0] + 1 if rows[-1][0] < (1 << 63) - 1 else None
                    records += len(rows)
                    for rowid, *values in rows:
                        new = {}
                        for c, v in zip(columns, values):
                            if isinstance(v, bytes):
                                raise Refused("blob")
                            got, k = m.replace(v) if isinstance(v, str) else ((v, 0) if v is None else replaced_number(v, m))
                            if k:
                                new[c] = got
                                n += k
                        if new:
                            db.execute(f"UPDATE {sqlite.quoted(table)} SET {', '.join(f'{sqlite.quoted(c)} = ?' for c in new)} WHERE rowid = ?", [*new.values(), rowid])
            if db.execute("PRAGMA foreign_key_check").fetchone():
                raise Refused("foreign-key")
            db.execute("COMMIT")
            if db.execute("PRAGMA integrity_check").fetchone()[0] != "ok":
                raise Refused("sqlite-integrity")
            db.execute("VACUUM")
            db.execute("PRAGMA journal_mode = DELETE")
        except sqlite3.Error:
            raise Refused("sqlite") from None
        finally:
            db.close()
        if any(os.path.exists(path + x) for x in ("-wal", "-shm", "-journal")):
            raise Refused("sqlite-sidecar")
        with open(path, "rb") as f:
            out = f.read()
        # VACUUM counts up the schema's version: what is released is looked at again
        if any(m.holds(x) for v in sqlite.header_integers(out) for x in number_tokens(v)):
            raise Refused("sensitive-header")
        return out, records, n


ADAPTERS = {".csv": csv_file, ".json": json_file, ".txt": text_file, ".sqlite": sqlite_file}


def strings(data: bytes, suffix: str) -> list[str]:
    """All text that a reader of the file could see, for a search."""
    if suffix == ".sqlite":
        return [data.decode("latin-1"), *_cells(data)]
    text, _ = decoded(data)
    if suffix != ".json":
        return [text]
    out: list[str] = []
    todo = [json_value(text)]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            todo += [*x, *x.values()]
        elif isinstance(x, list):
            todo += x
        elif isinstance(x, str):
            out.append(x)
        elif x is not None and not isinstance(x, bool):
            out += number_tokens(x)
    return out


def _cells(data: bytes) -> list[str]:
    db = sqlite3.connect(":memory:")
    db.deserialize(data)
    names = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view')")]
    return [str(v) for t in names for row in db.execute(f'SELECT * FROM "{t.replace(chr(34), chr(34) * 2)}"') for v in row if v is not None]
