"""Command line: `python -m umbra COMMAND`.  Exit 0: done, 1: refused, 2: a risk was found."""

from __future__ import annotations

import argparse
import json
import sys
import tempfile
from decimal import Decimal
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import documents, release, review
from .errors import Refused
from .functions.pseudonyms import PREFIX
from .operators import attacks, dp, gradients, graph, metrics, policy, population, transforms
from .plans.sql import over
from .sources import fixture
from .sources.tables import committed, read_csv


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="umbra")
    s = p.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: str, qis: bool = True) -> argparse.ArgumentParser:
        c = s.add_parser(name)
        for a in arguments:
            c.add_argument(a)
        if qis:
            c.add_argument("--qi", action="append", required=True)
        return c

    def optional(c: argparse.ArgumentParser, **kinds: type) -> argparse.ArgumentParser:
        for name, kind in kinds.items():
            c.add_argument("--" + name.replace("_", "-"), type=kind)
        return c

    def required(c: argparse.ArgumentParser, **kinds: type) -> argparse.ArgumentParser:
        for name, kind in kinds.items():
            c.add_argument("--" + name.replace("_", "-"), type=kind, required=True)
        return c

    command("run", "input", "output", qis=False)
    command("anonymize", "source", "output", qis=False).add_argument("--policy", required=True)
    command("demo", "output", qis=False).add_argument("--records", type=int, default=100)
    command("bench-once", qis=False).add_argument("--records", type=int, default=1000)
    command("explain", qis=False)
    c = command("discover", "input", "review", qis=False)
    c.add_argument("--threshold", type=float, default=90.0)
    c.add_argument("--margin", type=float, default=5.0)
    command("approve-discovery", "input", "review", "output", qis=False).add_argument("--id", action="append", required=True)
    required(command("redact-document", "source", "output", qis=False), policy=str, receipt=str)
    c = command("model-privacy-applicability", qis=False)
    c.add_argument("--release-kind", choices=("file_only", "learned_model"), required=True)
    c.add_argument("--model", action="store_true")
    c.add_argument("--gradients", action="store_true")
    command("model-gradient-inversion", "weights", "biases", qis=False)
    command("preflight", "input", qis=False)
    command("verify", "input", "output", qis=False)
    command("inspect", "policy", qis=False)
    required(command("risk-audit", "output", qis=False)).add_argument("--min-frequency", type=int, default=2)
    command("contextual-graph-risk", "input", qis=False).add_argument("--min-shared-clues", type=int, default=2)
    required(command("tabular-risk", "table"), sensitive=str)
    required(command("tabular-suppress", "table", "output"), k=int)
    optional(required(command("tabular-generalize", "table", "output"), hierarchy=str, sensitive=str, k=int), max_suppression=float)
    required(command("tabular-local", "table", "output"), hierarchy=str, sensitive=str, k=int)
    c = required(command("tabular-advanced", "table", "output"), hierarchy=str, sensitive=str, k=int, alpha=float, recursive_l=int, recursive_c=float, beta=float, t=float)
    optional(c, numeric_emd=float, entropy_l=float, delta=float, max_suppression=float)
    required(command("tabular-microaggregate", "table", "output"), bounds=str, sensitive=str, k=int).add_argument("--numeric", action="append", required=True)
    command("delta-presence-risk", "table", "population")
    command("population-reidentification-risk", "table", "population")
    required(command("population-k-map", "table", "population"), k=int)
    optional(required(command("singling-out-risk", "table"), row_id=str), size=int, control=str)
    c = optional(required(command("attribute-inference-risk", "table", "evaluation"), sensitive=str), group_by=str)
    c.add_argument("--predictor", choices=("nearest_neighbor", "exact_match"), default="nearest_neighbor")
    c = optional(required(command("two-view-linkability", "table", "view_a", "view_b", qis=False), subject=str), control=str)
    c.add_argument("--column-a", action="append", required=True)
    c.add_argument("--column-b", action="append", required=True)
    optional(required(command("dp-count", "table", qis=False), column=str, epsilon=str), equals=str, equals_sha256=str)
    optional(required(command("dp-count-batch", "table", qis=False), query_plan=str, maximum_epsilon=str), budget_ledger=str, budget_id=str)
    optional(required(command("dp-synthesize", "table", "output", qis=False), domain=str, epsilon=str), budget_ledger=str, budget_id=str, maximum_epsilon=str)
    return p


def _loaded(path: str):
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def _columns(t: DataFrame, *names: str | None) -> None:
    if set(filter(None, names)) - set(t.columns):
        raise Refused("column-missing")


def numeric_columns(names: list[str], *tables: DataFrame) -> list[str]:
    """Of the columns, those in which every value of all tables is a number."""
    other = set()
    for t in tables:
        row = t.agg(*[F.count_if(F.expr(f"{metrics.number(c)} is null")).alias(c) for c in names]).first()
        other |= {c for c in names if row[c]}
    return [c for c in names if c not in other]


def _numbers(t: DataFrame, numeric: list[str]) -> DataFrame:
    return t.select(*[F.col(f"`{c}`").cast("double").alias(c) if c in numeric else F.col(f"`{c}`") for c in t.columns])


def _written(out: DataFrame, t: DataFrame, a: argparse.Namespace) -> tuple[dict, bool]:
    """Writes a transformed table beside its place, reads it back and states its metrics; it gets its place if its classes hold."""
    receipt = {"rows": t.count()}

    def checked(kept: DataFrame | None) -> None:
        receipt["kept"] = kept.count() if kept is not None else 0
        if kept is not None and getattr(a, "sensitive", None):
            receipt.update(over(metrics.metrics(a.qi, a.sensitive), kept).first().asDict())
            if receipt["k_anonymity"] < a.k:
                raise transforms.PrivacyViolation("classes below k remain")

    committed(out, a.output, checked)
    return receipt, False


def _budgeted(a: argparse.Namespace, epsilon, produce):
    """produce(), charged to the ledger if one is named."""
    if a.budget_ledger is None:
        return produce()
    if a.budget_id is None or a.maximum_epsilon is None:
        raise Refused("budget-incomplete")
    return dp.spend(a.budget_ledger, a.budget_id, a.maximum_epsilon, epsilon, produce)


def answer(spark: SparkSession, a: argparse.Namespace) -> tuple[dict, bool]:
    """(receipt, whether a risk was found)."""
    if a.command == "run":
        return release.run(spark, a.input, a.output), False
    if a.command == "anonymize":
        return release.anonymized(spark, a.source, a.policy, a.output), False
    if a.command in ("demo", "bench-once"):
        with tempfile.TemporaryDirectory(prefix="umbra-demo-") as at:
            bundle = str(fixture.written(f"{at}/bundle", a.records))
            report = release.run(spark, bundle, a.output if a.command == "demo" else f"{at}/out")
        if a.command == "demo":
            return report, False
        seconds = report["elapsed_seconds"]
        return {"records": report["records"], "bytes": report["bytes_read"], "seconds": seconds, "records_per_second": round(report["records"] / seconds, 2), "bytes_per_second": round(report["bytes_read"] / seconds, 2)}, False
    if a.command == "explain":
        return {"mechanism": "literals of a policy, longest first, give way to pseudonyms derived from their identity; every file is rewritten in its own format, read again and compared before one rename publishes all of them", "refuses": "what it can't read exactly, what it can't verify, what changed meanwhile", "pseudonyms": PREFIX, "not_claimed": list(release.NOT_CLAIMED)}, False
    if a.command == "discover":
        found = review.discover(spark, a.input, a.threshold, a.margin)
        documents.private(Path(a.review).absolute(), found)
        return {"counts": found["counts"], "review_sha256": found["review_sha256"]}, False
    if a.command == "approve-discovery":
        return review.approve(spark, a.input, a.review, a.id, a.output), False
    if a.command == "redact-document":
        return documents.redact(a.source, a.policy, a.output, a.receipt), False
    if a.command == "model-privacy-applicability":
        return gradients.applicability(a.release_kind, a.model, a.gradients), False
    if a.command == "model-gradient-inversion":
        w, b = read_csv(spark, a.weights), read_csv(spark, a.biases)
        _columns(w, "i", "j", "g")
        _columns(b, "i", "g")
        w, b = w.selectExpr("cast(i as long) as i", "cast(j as long) as j", "cast(g as double) as g"), b.selectExpr("cast(i as long) as i", "cast(g as double) as g")
        found = gradients.invert(w, b).agg(F.count("*").alias("inputs"), F.count_if("agree").alias("agreeing")).first()
        risk = found["inputs"] > 0 and found["agreeing"] == found["inputs"]
        return {"inputs": found["inputs"], "agreeing": found["agreeing"], "verdict": "reconstructed" if risk else "clear"}, risk
    if a.command == "preflight":
        return {"files": release.counts_by_type(a.input)}, False
    if a.command == "verify":
        wrong = release.reverified(spark, a.input, a.output)
        if wrong:
            raise Refused(wrong[0])
        return {"status": "verified"}, False
    if a.command == "inspect":
        p = policy.load(a.policy)
        return {"rules": len(p.rules), "identities": len(p.replacements), "protected": len(p.protected)}, False
    if a.command == "risk-audit":
        most = release.most_frequent_token(spark, a.output)
        return {"max_pseudonym_frequency": most, "verdict": "linkage_risk" if most >= a.min_frequency else "clear"}, most >= a.min_frequency
    if a.command == "contextual-graph-risk":
        found = graph.summary(graph.attack(spark, a.input, a.min_shared_clues))
        return found, found["verdict"] == "block"
    t = read_csv(spark, a.table)
    if a.command == "dp-count":
        _columns(t, a.column)
        query = {"column": a.column, "epsilon": a.epsilon} | {k: v for k, v in (("equals", a.equals), ("equals_sha256", a.equals_sha256)) if v is not None}
        return {"count": dp.counts(t, [query], a.epsilon)[0], "epsilon": a.epsilon}, False
    if a.command == "dp-count-batch":
        queries = _loaded(a.query_plan)["queries"]
        _columns(t, *(q["column"] for q in queries))
        spent = str(sum((Decimal(str(q["epsilon"])) for q in queries), Decimal(0)))
        return {"counts": _budgeted(a, spent, lambda: dp.counts(t, queries, a.maximum_epsilon)), "epsilon": spent}, False
    if a.command == "dp-synthesize":
        domains = _loaded(a.domain)
        _columns(t, *domains)
        rows = _budgeted(a, a.epsilon, lambda: dp.histogram(t, domains, a.epsilon))
        counted = {}
        committed(rows, a.output, lambda kept: counted.update(rows=0 if kept is None else kept.count()))
        return {"dimensions": list(domains), "epsilon": a.epsilon, **counted}, False
    if a.command == "two-view-linkability":
        va, vb = read_csv(spark, a.view_a), read_csv(spark, a.view_b)
        released = [t] + ([read_csv(spark, a.control)] if a.control else [])
        if any(a.subject in x.columns for x in released):
            raise Refused("subject-in-release")
        _columns(va, a.subject, *a.column_a)
        _columns(vb, a.subject, *a.column_b)
        for x in released:
            _columns(x, *a.column_a, *a.column_b)
        ids = [v.groupBy(a.subject).agg(F.count("*").alias("n")) for v in (va, vb)]
        if any(not i.where("n > 1").isEmpty() for i in ids) or not ids[0].join(ids[1], a.subject, "full").where(ids[0]["n"].isNull() | ids[1]["n"].isNull()).isEmpty():
            raise Refused("subjects-differ")

        def linked(x: DataFrame) -> dict:
            na, nb = numeric_columns(a.column_a, x, va), numeric_columns(a.column_b, x, vb)
            rows = _numbers(x.withColumn("umbra_row", F.monotonically_increasing_id()), sorted({*na, *nb}))
            return attacks.linkability(rows, _numbers(va, na), _numbers(vb, nb), a.subject, na, [c for c in a.column_a if c not in na], nb, [c for c in a.column_b if c not in nb], "umbra_row").first().asDict()

        return _against(linked, released)
    _columns(t, *a.qi, getattr(a, "sensitive", None))
    if a.command == "tabular-risk":
        return over(metrics.metrics(a.qi, a.sensitive), t).first().asDict(), False
    if a.command == "tabular-suppress":
        return _written(over(transforms.suppress_small_classes(a.qi, a.k), t), t, a)
    if a.command == "tabular-generalize":
        return _written(transforms.generalize(t, a.qi, _loaded(a.hierarchy), a.k, a.max_suppression or 0.0), t, a)
    if a.command == "tabular-local":
        return _written(transforms.generalize_locally(t, a.qi, _loaded(a.hierarchy), a.k), t, a)
    if a.command == "tabular-advanced":
        bounds = {"alpha": a.alpha, "recursive_cl": (a.recursive_c, a.recursive_l), "beta": a.beta, "t": a.t, "numeric_emd": a.numeric_emd, "entropy_l": a.entropy_l, "delta": a.delta}
        return _written(transforms.enforce(t, a.qi, a.sensitive, _loaded(a.hierarchy), a.k, {k: v for k, v in bounds.items() if v is not None}, a.max_suppression or 0.0), t, a)
    if a.command == "tabular-microaggregate":
        bounds = {c: tuple(x) for c, x in _loaded(a.bounds).items()}
        return _written(transforms.microaggregated(t, a.qi, a.numeric, a.k, bounds), t, a)
    if a.command == "singling-out-risk":
        _columns(t, a.row_id)
        released = [t] + ([read_csv(spark, a.control)] if a.control else [])
        return _against(lambda x: over(attacks.singling_out(a.qi, a.row_id, a.size), x).first().asDict(), released)
    if a.command == "attribute-inference-risk":
        known = read_csv(spark, a.evaluation)
        _columns(known, *a.qi, a.sensitive, a.group_by)
        numeric = numeric_columns(a.qi, t, known) if a.predictor == "nearest_neighbor" else []
        nominal = [c for c in a.qi if c not in numeric]
        t, known = _numbers(t, numeric), _numbers(known, numeric)
        if a.predictor == "exact_match":
            row = over(attacks.infer_exact(a.qi, a.sensitive), t, evaluation=known).first().asDict()
            groups = lambda: over(attacks.exact_groups(a.qi, a.sensitive, a.group_by), t, evaluation=known)
        else:
            row = attacks.infer_nearest(t, known, numeric, nominal, a.sensitive).first().asDict()
            groups = lambda: attacks.inference_groups(t, known, numeric, nominal, a.sensitive, a.group_by)
        if a.group_by:
            row |= groups().first().asDict()
        return row, row["risk"]
    people = read_csv(spark, a.population)
    if a.command == "population-k-map":
        row = over(population.k_map(a.qi, a.k), t, population=people).first().asDict()
        return row, not row["satisfied"]
    text = population.delta_presence(a.qi) if a.command == "delta-presence-risk" else population.reidentification(a.qi)
    return over(text, t, population=people).first().asDict(), False


def _against(attack, released: list[DataFrame]) -> tuple[dict, bool]:
    """An attack's row on a release and, if there is one, its rate on a control; a risk if above that or chance."""
    row, *control = [attack(x) for x in released]
    limit = control[0]["rate"] if control else row["baseline"]
    more = {"control_rate": limit, "excess": round(row["rate"] - limit, 9)} if control else {}
    return row | more, row["rate"] > limit


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(arguments)
    try:
        receipt, risk = answer(spark or SparkSession.builder.appName("umbra").getOrCreate(), a)
    except (Refused, policy.PolicyError, transforms.PrivacyViolation) as e:
        print(json.dumps({"error": getattr(e, "code", type(e).__name__)}))
        return 1
    except Exception as e:  # messages of engines may hold values: the class alone is shown
        print(json.dumps({"error": type(e).__name__}))
        return 1
    print(json.dumps(receipt))
    return 2 if risk else 0


if __name__ == "__main__":
    sys.exit(main())
