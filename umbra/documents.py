"""Redacting documents: one of them to a place of its own with a private receipt, or a folder of them as rows."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .errors import Refused
from .operators import policy as policies
from .sources import dicom, office
from .sources.formats import Matcher

#: By suffix: the adapter and what its output must pass.
KINDS = {".docx": (office.docx_file, office.verified), ".dcm": (dicom.dicom_file, dicom.verified)}
NOT_CLAIMED = ("values that the policy doesn't name", "a profile of medical de-identification", "what pixels or drawings show")


def redacted(data: bytes, suffix: str, m: Matcher) -> tuple[bytes, int, dict[str, int]]:
    """(bytes, replacements, what the verifier looked at); images and PDF, for which there is no tool here, refuse."""
    if suffix.lower() not in KINDS:
        raise Refused("document-kind")
    adapter, verified = KINDS[suffix.lower()]
    out, n = adapter(data, m)
    return out, n, verified(out, m)


def private(path: Path, payload: dict) -> None:
    """A new file for its owner alone; one that is there stays and refuses."""
    if path.name == "report.json":
        raise Refused("receipt-name")
    try:
        handle = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY | os.O_NOFOLLOW, 0o600)
    except FileExistsError:
        raise Refused("output-exists") from None
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(payload, f, indent=2, sort_keys=True)
            f.flush()
            os.fsync(f.fileno())
    except BaseException:
        path.unlink(missing_ok=True)
        raise


def redact(source: str, policy_path: str, output: str, receipt: str) -> dict:
    """Redacts one document; neither output nor receipt may be there, and neither stays if anything fails."""
    a, b, c = (Path(x).absolute() for x in (source, output, receipt))
    if not a.is_file() or a.is_symlink():
        raise Refused("document-missing")
    if b.exists() or c.exists() or len({a, b, c}) < 3:
        raise Refused("output-exists")
    if a.suffix.lower() != b.suffix.lower():
        raise Refused("document-kind")
    policy = policies.load(policy_path)
    out, n, seen = redacted(a.read_bytes(), a.suffix, Matcher(policy))
    b.parent.mkdir(parents=True, exist_ok=True)
    handle, beside = tempfile.mkstemp(prefix=".redacted-", dir=b.parent)
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(out)
            f.flush()
            os.fsync(f.fileno())
        report = {"schema": "umbra.document.v1", "status": "ready", "kind": a.suffix.lower().lstrip("."), "replacements": n, "output_sha256": hashlib.sha256(out).hexdigest(), "verification_passed": True, "verified": seen, "not_claimed": list(NOT_CLAIMED)}
        private(c, report)
        try:
            os.link(beside, b)  # refuses where a file came meanwhile
        except FileExistsError:
            c.unlink()
            raise Refused("output-exists") from None
        return report
    finally:
        os.unlink(beside)


def folder(spark: SparkSession, path: str, policy: policies.Policy) -> DataFrame:
    """(path, content, replacements, code) of all documents below a folder; code: why one was refused, its content then being null."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")

    def run(batches):
        import pandas as pd

        m = Matcher(policy)
        for pdf in batches:
            rows = []
            for at, data in zip(pdf["path"], pdf["content"]):
                try:
                    out, n, _ = redacted(bytes(data), os.path.splitext(at)[1], m)
                    rows.append((at, out, n, None))
                except Refused as e:
                    rows.append((at, None, 0, e.code))
            yield pd.DataFrame(rows, columns=["path", "content", "replacements", "code"])

    return files.mapInPandas(run, "path string, content binary, replacements long, code string")
