"""Releases: preflight, transform, verify, publish.

Tasks write the rewritten files to a private stage, each under a name of its own attempt and then by an atomic rename, so
that a retried or doubled task leaves the same file; tasks also verify and seal what was staged, file by file.  The driver sees
paths, digests and counts, in sorted order as a stream.  Source and target must lie where driver and executors can open them.

A target holds `.release-<run>` folders with corpus and report, and `current`, a link to one of them; `corpus` and `report.json` lead
through it.  Publication is one rename of that link: whenever a run is killed, the old release or the new one is whole.
Stages and releases that nothing points to are cleared by the next run.
"""

from __future__ import annotations

import filecmp
import hashlib
import json
import os
import re
import shutil
import sqlite3
import tempfile
import time
import uuid
from collections import Counter
from itertools import zip_longest
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import Refused, reference
from .operators import graph
from .operators import policy as policies
from .functions.pseudonyms import LOOKALIKES, PREFIX
from .plans.held import held
from .sources import sqlite
from .sources.formats import ADAPTERS, Matcher, replaced_number, strings


def preflight(source: Path, target: Path, m: Matcher) -> list[str]:
    """Relative paths of the corpus, sorted; refuses links, special files, unknown suffixes, literals in paths."""
    a, b = source.resolve(), target.resolve()
    if a == b or a in b.parents or b in a.parents:
        raise Refused("nested-roots")
    out = []
    for p in sorted((source / "corpus").rglob("*")):
        if p.is_symlink() or not (p.is_file() or p.is_dir()):
            raise Refused("special-file")
        if m.holds(str(p.relative_to(source))):
            raise Refused("sensitive-path")
        if p.is_file():
            if p.suffix not in ADAPTERS:
                raise Refused("suffix", reference(p.suffix))
            out.append(str(p.relative_to(source / "corpus")))
    if not out:
        raise Refused("no-files")
    return out


def manifest(digests: dict[str, str]) -> str:
    """The digest of sorted paths and digests."""
    return hashlib.sha256("".join(f"{p}\0{d}\0" for p, d in sorted(digests.items())).encode()).hexdigest()


def transformed(spark: SparkSession, corpus: Path, policy: policies.Policy, stage: Path | None = None) -> DataFrame:
    """(path, records, replacements, read, written, source_sha256, sha256, code, content) of all files below corpus; code: why a
    file was refused.  With a stage, files are written there, and content is null."""
    root = corpus.resolve()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root.as_uri()).select("path", "content")
    to = str(stage) if stage else None

    def run(batches):
        import pandas as pd

        m = Matcher(policy)
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                data = bytes(content)
                name = path.removeprefix("file://").removeprefix("file:").removeprefix(str(root) + "/")
                try:
                    new, records, n = ADAPTERS[os.path.splitext(path)[1]](data, m)
                except Refused as e:
                    rows.append((name, 0, 0, len(data), 0, "", "", e.code, None))
                    continue
                if to:
                    _placed(os.path.join(to, name), new)
                rows.append((name, records, n, len(data), len(new), hashlib.sha256(data).hexdigest(), hashlib.sha256(new).hexdigest(), None, None if to else new))
            yield pd.DataFrame(rows, columns=["path", "records", "replacements", "read", "written", "source_sha256", "sha256", "code", "content"])

    return files.mapInPandas(run, "path string, records long, replacements long, read long, written long, source_sha256 string, sha256 string, code string, content binary")


def _placed(path: str, data: bytes) -> None:
    """Writes a file under a name of this attempt's own and renames it, so it is whole or absent."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    handle, attempt = tempfile.mkstemp(prefix=".attempt-", dir=os.path.dirname(path))
    with os.fdopen(handle, "wb") as f:
        f.write(data)
    os.replace(attempt, path)


def _streamed(rows: DataFrame, digest: str) -> str:
    """manifest() of (path, `digest`) rows, as a stream in sorted order."""
    whole = hashlib.sha256()
    for path, d in rows.select("path", digest).orderBy("path").toLocalIterator():
        whole.update(f"{path}\0{d}\0".encode())
    return whole.hexdigest()


def digests(spark: SparkSession, root: Path) -> DataFrame:
    """(path, sha256) of the files below a folder, as they are now."""
    at = root.resolve()
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(at.as_uri())
    return d.select(F.substring("path", len(f"file:{at}/") + 1, 1 << 20).alias("path"), F.sha2("content", 256).alias("sha256"))


def sqlite_differs(source: bytes, out: bytes, m: Matcher) -> bool:
    """Whether schema, row ids or typed cells are anything but the source's with its literals replaced."""
    a, b = sqlite3.connect(":memory:"), sqlite3.connect(":memory:")
    quoted = lambda x: '"' + x.replace('"', '""') + '"'
    typed = lambda row: [(type(x), repr(x)) for x in row]
    try:
        a.deserialize(source)
        b.deserialize(out)
        same = ["SELECT type, name, tbl_name, sql FROM sqlite_master ORDER BY type, name, tbl_name"]
        tables = [t for t, _ in sqlite.gated(a)]
        same += [f"PRAGMA {p}({quoted(t)})" for t in tables for p in ("table_xinfo", "foreign_key_list")]
        if any(a.execute(x).fetchall() != b.execute(x).fetchall() for x in same):
            return True
        for t in tables:
            rows = f"SELECT rowid, * FROM {quoted(t)} ORDER BY rowid"
            for x, y in zip_longest(a.execute(rows), b.execute(rows)):
                if x is None or y is None:
                    return True
                new = [m.replace(v)[0] if isinstance(v, str) else v if v is None or isinstance(v, bytes) else replaced_number(v, m)[0] for v in x[1:]]
                if typed([x[0], *new]) != typed(y):
                    return True
        return False
    except sqlite3.Error:
        return True
    finally:
        a.close()
        b.close()


#: Codes of a verification, the first of them that is found being the one reported.
CODES = ("file-set", "literal-left", "protected-changed", "content-differs", "identity-missing")


def _judged(suffix: str, source: bytes, out: bytes, policy: policies.Policy, m: Matcher) -> tuple[set[str], set[str], set[str]]:
    """Codes of one staged file, the tokens that its source calls for and those that it holds."""
    wrong: set[str] = set()
    given: set[str] = set()
    before, after = strings(source, suffix), strings(out, suffix)
    if any(map(m.holds, after)):
        wrong.add("literal-left")
    cells = 1 if suffix == ".sqlite" else 0  # the first of its strings is the file, which is laid out anew
    if any(sum(x.count(p) for x in before[cells:]) != sum(x.count(p) for x in after[cells:]) for p in policy.protected):
        wrong.add("protected-changed")
    if sqlite_differs(source, out, m) if suffix == ".sqlite" else ADAPTERS[suffix](source, m)[0] != out:
        wrong.add("content-differs")
    if m.pattern is not None:
        for x in before:
            given |= {policy.exact.get(t) or policy.folded[policies.ascii_lower(t)] for t in m.pattern.findall(x)}
    whole = "\0".join(after)
    return wrong, given, {t for t in set(policy.replacements.values()) if t in whole}


def verified(source: dict[str, bytes], out: dict[str, bytes], policy: policies.Policy) -> list[str]:
    """Codes of what is wrong with a corpus of a few files: files, literals left, protected values lost, tokens missing."""
    if set(source) != set(out):
        return ["file-set"]
    m, found = Matcher(policy), [set(), set(), set()]
    for path, data in out.items():
        for x, y in zip(found, _judged(os.path.splitext(path)[1], source[path], data, policy, m)):
            x |= y
    wrong, given, seen = found
    if given - seen:
        wrong.add("identity-missing")
    return sorted(wrong, key=CODES.index)


def verification(spark: SparkSession, corpus: Path, stage: Path, policy: policies.Policy) -> DataFrame:
    """(kind, value, n): what the tasks that compare a corpus with its staged copy, file by file, found.

    Kinds are code, given and seen (tokens that the sources call for, that the copies hold; at most as many as
    the policy has) and look (what looks like a pseudonym in the copies, n times)."""

    root, staged = str(corpus.resolve()), str(stage.resolve())

    def run(batches):
        import pandas as pd

        m = Matcher(policy)
        for pdf in batches:
            found: Counter = Counter()
            for path, source in zip(pdf["path"], pdf["content"]):
                suffix = os.path.splitext(path)[1]
                name = path.removeprefix("file://").removeprefix("file:").removeprefix(root + "/")
                try:
                    with open(os.path.join(staged, name), "rb") as f:
                        out = f.read()
                except FileNotFoundError:
                    found["code", "file-set"] += 1
                    continue
                for kind, values in zip(("code", "given", "seen"), _judged(suffix, bytes(source), out, policy, m)):
                    found.update((kind, v) for v in values)
                for x in strings(out, suffix):
                    found.update(("look", t) for p in LOOKALIKES for t in re.findall(p, x))
            yield pd.DataFrame([(*k, n) for k, n in found.items()], columns=["kind", "value", "n"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(corpus.resolve().as_uri()).select("path", "content")
    return files.mapInPandas(run, "kind string, value string, n long").groupBy("kind", "value").agg(F.sum("n").alias("n"))


def verdict(facts: DataFrame) -> tuple[list[str], int]:
    """Codes of a verification() and how often the most frequent pseudonym, or what looks like one, occurs."""
    facts = facts.persist()
    try:
        of: dict[str, set[str]] = {"code": set(), "given": set(), "seen": set()}
        for r in facts.where("kind <> 'look'").collect():
            of[r["kind"]].add(r["value"])
        most = facts.where("kind = 'look'").agg(F.max("n")).first()[0] or 0
    finally:
        facts.unpersist()
    missing = {"identity-missing"} if of["given"] - of["seen"] else set()
    return sorted(of["code"] | missing, key=CODES.index), most


def token_frequency(texts: list[str]) -> int:
    """How often the most frequent pseudonym, or what looks like one, occurs."""
    counts = Counter(t for p in LOOKALIKES for x in texts for t in re.findall(p, x))
    return max(counts.values(), default=0)


#: What a report doesn't claim.
NOT_CLAIMED = ("legal anonymity", "absence of values that the policy doesn't name", "resistance to background knowledge", "secrecy of the pseudonyms' derivation")


def _cleared(to: Path) -> None:
    """Removes stages and releases of a target that nothing points to."""
    live = os.path.basename(os.readlink(to / "current")) if (to / "current").is_symlink() else None
    for p in to.iterdir():
        if p.name.startswith((".stage-", ".release-", ".next-")) and p.name != live:
            if p.is_dir() and not p.is_symlink():
                shutil.rmtree(p, ignore_errors=True)
            else:
                p.unlink(missing_ok=True)


def _durable(folder: Path) -> None:
    handle = os.open(folder, os.O_RDONLY)
    try:
        os.fsync(handle)
    finally:
        os.close(handle)


def published(stage: Path, to: Path, report: dict) -> None:
    """Makes a verified stage (with corpus/) the release of the target: its report is written into it, it gets its name, and the link
    `current` is renamed over the old one, which is all that a reader can see."""
    with open(stage / "report.json", "w") as f:
        json.dump(report, f, indent=2)
        f.flush()
        os.fsync(f.fileno())
    _durable(stage)
    release = to / f".release-{report['run_id']}"
    os.rename(stage, release)
    for name in ("corpus", "report.json"):
        if not (to / name).is_symlink():
            if (to / name).is_dir():  # a target of before there were links
                os.rename(to / name, to / f".stage-old-{report['run_id']}")
            else:
                (to / name).unlink(missing_ok=True)
            os.symlink(f"current/{name}", to / name)
    os.symlink(release.name, to / f".next-{report['run_id']}")
    os.replace(to / f".next-{report['run_id']}", to / "current")
    _durable(to)
    _cleared(to)


def run(spark: SparkSession, source: str, target: str) -> dict:
    """Releases the bundle `source` (policy.json, corpus/, contextual_graph.json where the policy asks for it) to `target`."""
    root = Path(source)
    return released(spark, root, root / "policy.json", Path(target).absolute())


def anonymized(spark: SparkSession, source: str, policy_path: str, target: str) -> dict:
    """Releases a file or a folder by a policy that lies elsewhere: as a bundle of links' targets copied beside the target, whose files
    must be the source's when the copy is done."""
    origin, rules, to = Path(source).absolute(), Path(policy_path).absolute(), Path(target).absolute()
    if rules.is_symlink() or not rules.is_file() or origin.is_symlink() or not (origin.is_file() or origin.is_dir()):
        raise Refused("special-file")
    if origin in rules.parents or origin == to or origin in to.parents or to in origin.parents or to in rules.parents:
        raise Refused("nested-roots")
    policies.load(str(rules))
    if any(p.is_symlink() or not (p.is_file() or p.is_dir()) for p in origin.rglob("*")):
        raise Refused("special-file")
    to.parent.mkdir(parents=True, exist_ok=True)
    bundle = Path(tempfile.mkdtemp(prefix=".bundle-", dir=to.parent))
    try:
        shutil.copyfile(rules, bundle / "policy.json")
        if origin.is_dir():
            shutil.copytree(origin, bundle / "corpus")
        else:
            (bundle / "corpus").mkdir()
            shutil.copyfile(origin, bundle / "corpus" / origin.name)
        for p in (bundle / "corpus").rglob("*"):
            if p.is_file() and not filecmp.cmp(p, origin / p.relative_to(bundle / "corpus") if origin.is_dir() else origin, shallow=False):
                raise Refused("source-changed")
        return run(spark, str(bundle), str(to))
    finally:
        shutil.rmtree(bundle, ignore_errors=True)


def released(spark: SparkSession, root: Path, policy_file: Path, to: Path) -> dict:
    began = time.monotonic()
    policy = policies.load(str(policy_file))
    policy_digest = hashlib.sha256(policy_file.read_bytes()).hexdigest()
    graph_file = root / "contextual_graph.json"
    gated = policy.risk.get("contextual_graph_min_shared_clues")
    if gated:
        if graph_file.is_symlink() or not graph_file.is_file():
            raise Refused("contextual-graph-missing")
        graph_digest = hashlib.sha256(graph_file.read_bytes()).hexdigest()
    names = preflight(root, to, Matcher(policy))
    corpus = root / "corpus"
    to.mkdir(parents=True, exist_ok=True)
    _cleared(to)
    stage = Path(tempfile.mkdtemp(prefix=".stage-", dir=to))  # for its owner alone
    try:
        (stage / "corpus").mkdir()
        facts = held(transformed(spark, corpus, policy, stage / "corpus").drop("content"))
        total = facts.agg(F.count("*").alias("files"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("records", "replacements", "read", "written")], F.min(F.when(F.col("code").isNotNull(), F.struct("path", "code"))).alias("refused")).first()
        if total["refused"]:
            raise Refused(total["refused"]["code"], reference(total["refused"]["path"]))
        # Spark's reader skips names that begin with a dot or an underscore: such a file was not staged
        if total["files"] != len(names):
            raise Refused("file-set")
        seen = verification(spark, corpus, stage / "corpus", policy)
        wrong, tokens = verdict(seen)
        if wrong:
            raise Refused(wrong[0])
        most = policy.risk.get("max_pseudonym_frequency")
        if most and tokens > most:
            raise Refused("pseudonym-frequency")
        risk = {"verdict": "not_requested"}
        if gated:
            risk = graph.summary(graph.attack(spark, str(graph_file), gated))
            if hashlib.sha256(graph_file.read_bytes()).hexdigest() != graph_digest:
                raise Refused("contextual-graph-changed")
            if risk["verdict"] != "clear":
                raise Refused("contextual-graph-risk")
        # what is released is what was verified, and what was read is still there
        before, after = _streamed(facts, "source_sha256"), _streamed(facts, "sha256")
        if _streamed(digests(spark, corpus), "sha256") != before:
            raise Refused("source-changed")
        if _streamed(digests(spark, stage / "corpus"), "sha256") != after:
            raise Refused("stage-changed")
        report = {
            "schema": "umbra.report.v2", "status": "ready", "run_id": uuid.uuid4().hex, "files": len(names), "records": total["records"], "replacements": total["replacements"],
            "bytes_read": total["read"], "bytes_written": total["written"], "policy_sha256": policy_digest, "source_manifest": before, "release_manifest": after,
            "verification_passed": True, "verification_sha256": hashlib.sha256(json.dumps([before, after, policy_digest, tokens]).encode()).hexdigest(), "max_pseudonym_frequency": tokens,
            "pseudonyms": PREFIX, "key_mode": "public", "graph_verdict": risk["verdict"], "graph_inferred": risk.get("inferred", 0), "graph_ambiguous": risk.get("ambiguous", 0),
            "not_claimed": list(NOT_CLAIMED), "elapsed_seconds": round(time.monotonic() - began, 3), "target": "corpus",
        }
        published(stage, to, report)
        return report
    finally:
        shutil.rmtree(stage, ignore_errors=True)


def counts_by_type(source: str) -> dict[str, int]:
    """How many files of each kind a bundle holds, after the checks that run() makes before it writes."""
    root = Path(source)
    names = preflight(root, root.parent / f".{root.name}-none", Matcher(policies.load(str(root / "policy.json"))))
    return dict(sorted(Counter(os.path.splitext(n)[1] for n in names).items()))


def reverified(spark: SparkSession, source: str, target: str) -> list[str]:
    """Codes of what is wrong with a published release, read anew by tasks; its report's digests as well."""
    root, to = Path(source), Path(target)
    report = json.loads((to / "report.json").read_text())
    policy = policies.load(str(root / "policy.json"))
    corpus, released = root / "corpus", (to / "corpus").resolve()
    names = {str(p.relative_to(x)) for x in (corpus, released) for p in x.rglob("*") if p.is_file()}
    both = [sum(p.is_file() for p in x.rglob("*")) for x in (corpus, released)]
    wrong = ["file-set"] if both != [len(names)] * 2 else verdict(verification(spark, corpus, released, policy))[0]
    for key, at in (("source_manifest", corpus), ("release_manifest", released)):
        if report[key] != _streamed(digests(spark, at), "sha256"):
            wrong.append(key.replace("_", "-"))
    return wrong


def most_frequent_token(spark: SparkSession, target: str) -> int:
    """How often the most frequent pseudonym, or what looks like one, occurs in a published release, whose corpus must be the one
    that its report names."""
    to = Path(target)
    report = json.loads((to / "report.json").read_text())
    released = (to / "corpus").resolve()
    if report["status"] != "ready" or report["release_manifest"] != _streamed(digests(spark, released), "sha256"):
        raise Refused("release-manifest")

    def run(batches):
        import pandas as pd

        for pdf in batches:
            found: Counter = Counter()
            for path, data in zip(pdf["path"], pdf["content"]):
                found.update(t for x in strings(bytes(data), os.path.splitext(path)[1]) for p in LOOKALIKES for t in re.findall(p, x))
            yield pd.DataFrame(list(found.items()), columns=["token", "n"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(released.as_uri()).select("path", "content")
    return files.mapInPandas(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
