"""Discovery of misspelled values in a bundle, its review by a person, and the policy that comes of it.

A review is addressed by its content: policy and corpus by their digests, each proposal by an id of these, its rule and its value.  An
approval computes the review anew and goes on only if nothing differs.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import release
from .documents import private
from .errors import Refused
from .operators import discovery, locations
from .operators import policy as policies
from .sources import formats, sqlite
from .sources.formats import Matcher

#: Proposals that a review may hold: a person reads it.
MOST = 10_000


def held_values(data: bytes, suffix: str) -> Iterator[tuple[str, str]]:
    """(location, value) of whole values: cells below a header, strings of JSON that aren't keys, text cells of SQLite, lines."""
    if suffix == ".sqlite":
        import sqlite3

        db = sqlite.hardened(sqlite3.connect(":memory:"))
        try:
            db.deserialize(data)
            for table, columns in sqlite.gated(db, data[:100]):
                for rowid, *row in db.execute(f"SELECT rowid, {', '.join(map(sqlite.quoted, columns))} FROM {sqlite.quoted(table)}"):
                    yield from ((f"{table}/{rowid}/{c}", v) for c, v in zip(columns, row) if isinstance(v, str))
        except sqlite3.Error:
            raise Refused("sqlite") from None
        finally:
            db.close()
        return
    text, _ = formats.decoded(data)
    if suffix == ".json":
        formats.json_value(text)
        yield from ((at, v) for at, kind, v in locations.located(text) if kind == "string")
    elif suffix == ".csv":
        formats.csv_file(data, Matcher(policies.compiled({"version": 1, "sensitive_values": [], "protected_values": []})))
        rows = csv.reader(io.StringIO(text, newline=""), strict=True)
        header = next(rows)
        yield from ((f"{i}/{c}", v) for i, row in enumerate(rows) for c, v in zip(header, row))
    else:
        yield from ((str(i), line) for i, line in enumerate(text.splitlines()))


def intake(spark: SparkSession, corpus: Path) -> DataFrame:
    """(path, location, value, code) of a corpus; a file that can't be read has one row with the reason as code."""
    root = str(corpus.resolve())
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(corpus.resolve().as_uri()).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], names=["path", "location", "value", "code"])

        for b in batches:
            for path, content in zip(b.column(0), b.column(1)):
                at = path.as_py().removeprefix("file://").removeprefix("file:")
                name, rows = at.removeprefix(root + "/"), []
                try:
                    for place, value in held_values(content.as_py(), os.path.splitext(at)[1]):
                        rows.append((name, place, value, None))
                        if len(rows) == 16_384:
                            yield batch(rows)
                            rows = []
                except Refused as e:
                    rows.append((name, "", None, e.code))
                if rows:
                    yield batch(rows)

    return files.mapInArrow(run, "path string, location string, value string, code string")


def _digest(x: dict) -> str:
    return hashlib.sha256(json.dumps(x, sort_keys=True, ensure_ascii=True).encode()).hexdigest()


def discover(spark: SparkSession, bundle: str, threshold: float = 90, margin: float = 5) -> dict:
    """The review of a bundle: how many values there are of each status, and the proposals."""
    root = Path(bundle)
    source = json.loads((root / "policy.json").read_text())
    policy = policies.load(str(root / "policy.json"))
    release.preflight(root, root.parent / f".{root.name}-none", Matcher(policy))
    corpus = release._streamed(release.digests(spark, root / "corpus"), "sha256")
    values = intake(spark, root / "corpus")
    bad = values.where("code is not null").agg(F.min("code")).first()[0]
    if bad:
        raise Refused(bad)
    found = discovery.propose(values.select("value"), policy, threshold, margin)
    from .plans.held import held

    found = held(found)
    counts = {r["status"]: r["n"] for r in found.groupBy("status").agg(F.count("*").alias("n")).collect()}
    if counts.get("proposed", 0) > MOST:
        raise Refused("too-many-proposals")
    subjects = {r.rule_id: r.identity[1] for r in policy.rules}
    rows = found.where("status = 'proposed'").orderBy("value").collect()
    proposals = [{"id": discovery.proposal_id(source, corpus, r["rule_id"], r["value"]), "value": r["value"], "rule_id": r["rule_id"], "subject_id": subjects[r["rule_id"]], "score": round(r["score"], 6), "occurrences": r["occurrences"]} for r in rows]
    if release._streamed(release.digests(spark, root / "corpus"), "sha256") != corpus:
        raise Refused("discovery-stale")
    names = ("proposed", "known", "protected", "noise", "low_score", "ambiguous")
    review = {"schema": "umbra.review.v1", "policy_sha256": hashlib.sha256((root / "policy.json").read_bytes()).hexdigest(), "corpus_sha256": corpus, "threshold": threshold, "margin": margin, "counts": {n: counts.get(n, 0) for n in names}, "proposals": proposals}
    return review | {"review_sha256": _digest(review)}


def approve(spark: SparkSession, bundle: str, review: str, ids: list[str], output: str) -> dict:
    """The bundle's policy with a rule for each of the review's proposals named, at `output`, and a receipt beside it; both are new files
    for their owner alone, outside the bundle."""
    root, to = Path(bundle).resolve(), Path(output).absolute()
    receipt = to.with_name(to.name + ".approval.json")
    if root in to.resolve().parents or to.resolve() == Path(review).resolve():
        raise Refused("nested-roots")
    if to.exists() or receipt.exists():
        raise Refused("output-exists")
    try:
        given = json.loads(Path(review).read_text(), object_pairs_hook=formats._unique)
        threshold, margin = given["threshold"], given["margin"]
        own = given["review_sha256"] == _digest({k: v for k, v in given.items() if k != "review_sha256"})
    except (ValueError, KeyError, TypeError, RecursionError):
        raise Refused("review-invalid") from None
    if not own or isinstance(threshold, bool) or not isinstance(threshold, (int, float)) or isinstance(margin, bool) or not isinstance(margin, (int, float)):
        raise Refused("review-invalid")
    fresh = discover(spark, bundle, threshold, margin)
    if fresh != given:
        raise Refused("discovery-stale")
    by_id = {p["id"]: p for p in fresh["proposals"]}
    if not ids or len(set(ids)) < len(ids) or not set(ids) <= set(by_id):
        raise Refused("approval-rejected")
    policy = discovery.approved(json.loads((root / "policy.json").read_text()), [(i, by_id[i]["rule_id"], by_id[i]["value"]) for i in sorted(ids)])
    private(to, policy)
    try:
        said = {"schema": "umbra.approval.v1", "ids": sorted(ids), "review_sha256": fresh["review_sha256"], "policy_sha256": fresh["policy_sha256"], "corpus_sha256": fresh["corpus_sha256"], "approved_policy_sha256": hashlib.sha256(to.read_bytes()).hexdigest()}
        private(receipt, said)
    except BaseException:
        to.unlink(missing_ok=True)
        raise
    return said
