"""Proposals of misspelled values: which strings of a corpus are close to a policy's names.

Closeness is 200 * longest common subsequence / both lengths.  Values and names meet in a similarity join with filters: a pair
of fewer than ten letters in all can differ by one letter only, so it shares a form with at most one letter deleted; any other
shares so many pairs of neighbouring letters, counted with repeats.  What passes the count is measured by a bit-parallel
longest common subsequence.  A value with a close name is then held against all other names whose length lets them come within the margin.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.held import held
from .policy import Policy, PolicyError, ascii_lower, compiled


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a machine word's worth of letters of a at a time."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for c in b:
        met = row & at.get(c, 0)
        row = (row + met | row - met) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """200 * longest common subsequence / both lengths."""
    return 200 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def is_name(value: Column) -> Column:
    """3 to 128 letters, blanks, apostrophes, hyphens and stops, of which three letters at least."""
    return (F.char_length(value).between(3, 128)) & value.rlike(r"^[\p{L} '.-]*$") & (F.char_length(F.regexp_replace(value, r"[^\p{L}]", "")) >= 3)


def _grams(value: str) -> list[str]:
    """Forms with one letter deleted at most, and neighbouring pairs numbered where they repeat; the first letter says which."""
    out = {"d" + value, *("d" + value[:i] + value[i + 1 :] for i in range(len(value)))} if len(value) <= 9 else set()
    seen: Counter[str] = Counter()
    for i in range(len(value) - 1):
        pair = value[i : i + 2]
        seen[pair] += 1
        out.add(f"p{pair}{seen[pair]}")
    return sorted(out)


def _rows(df: DataFrame, f: Callable[..., Iterator[tuple]], schema: str, kinds: list[pa.DataType]) -> DataFrame:
    """f of each row's columns, rows of the schema."""
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        for b in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                out += f(*row)
                if len(out) >= 50_000:
                    yield batch(out)
                    out = []
            if out:
                yield batch(out)

    return df.mapInArrow(run, schema)


def similar(values: DataFrame, names: DataFrame, threshold: float) -> DataFrame:
    """(value, name, score) of all pairs of distinct `value` and distinct `name` of at least the threshold, which is at least 80."""
    if threshold < 80:
        raise ValueError("the filters hold from 80 on")
    text, number = pa.string(), pa.float64()
    v = _rows(values.select("value"), lambda x: ((x, g) for g in _grams(x)), "value string, gram string", [text, text])
    n = _rows(names.select("name"), lambda x: ((x, g) for g in _grams(x)), "name string, gram string", [text, text])
    both = v.join(n, "gram").groupBy("value", "name").agg(F.count_if(F.expr("gram like 'p%'")).alias("pairs"), F.count_if(F.expr("gram like 'd%'")).alias("forms"))
    a, b = F.char_length("value"), F.char_length("name")
    least = F.ceil((a + b) * F.lit(threshold / 200) - F.lit(1e-9))  # of the common subsequence
    few = a + b < 10
    enough = (least <= F.least(a, b)) & F.when(few, F.col("forms") > 0).otherwise(F.col("pairs") >= (a - 1) - 2 * (a - least) - (b - least))
    return _scored(both.where(enough).select("value", "name"), threshold)


def _scored(pairs: DataFrame, threshold: float) -> DataFrame:
    def f(value: str, name: str) -> Iterator[tuple]:
        score = indel_ratio(value, name)
        if score >= threshold:
            yield value, name, score

    return _rows(pairs.select("value", "name"), f, "value string, name string, score double", [pa.string(), pa.string(), pa.float64()])


def propose(values: DataFrame, policy: Policy, threshold: float = 90, margin: float = 5) -> DataFrame:
    """(value, occurrences, status, rule_id, score) for each distinct value: protected (holds a protected value), known, noise (no
    name's shape), low_score, ambiguous (another identity is as close, or within the margin) or proposed.  Score and rule_id, of the
    closest name, where that reaches the threshold.  A-Z count as a-z; nulls are no values."""
    if not 80 <= threshold <= 100 or not 0 <= margin <= 20:
        raise PolicyError("threshold or margin out of range")
    spark = values.sparkSession
    lower = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counted = values.where("value is not null").groupBy("value").agg(F.count("*").alias("occurrences")).withColumn("low", lower("value"))
    protected = spark.createDataFrame([(p,) for p in sorted(policy.protected)], "p string")
    exact = spark.createDataFrame(sorted({(r.value,) for r in policy.rules}), "known string")
    folded = spark.createDataFrame(sorted({(ascii_lower(r.value),) for r in policy.rules if not r.case_sensitive}), "known_low string")
    named = [(r.rule_id, "\0".join(r.identity), r.value, ascii_lower(r.value)) for r in policy.rules if r.kind == "name"]
    rules = spark.createDataFrame(named, "rule_id string, identity string, literal string, name string").where(is_name(F.col("literal")))
    # of each name and identity the first rule
    rules = rules.groupBy("name", "identity").agg(F.min("rule_id").alias("rule_id"))
    holds = F.lit(False)
    for p in protected.collect():  # a policy's own list
        holds = holds | F.contains("value", F.lit(p["p"]))
    d = counted.join(exact, F.col("value") == F.col("known"), "left").join(folded, F.col("low") == F.col("known_low"), "left")
    d = held(d.select("value", "low", "occurrences", F.when(holds, "protected").when(F.col("known").isNotNull() | F.col("known_low").isNotNull(), "known").when(~is_name(F.col("value")), "noise").alias("status")))
    open_ = d.where("status is null").select(F.col("low").alias("value")).distinct()
    close = held(similar(open_, rules.select("name").distinct(), threshold))
    # all that could come within the margin of a close one
    least = max(0.0, threshold - margin)
    wide = close.select("value").distinct().join(rules.select("name").distinct().withColumn("n", F.char_length("name")), F.expr(f"200 * least(char_length(value), n) >= {least!r} * (char_length(value) + n)")).select("value", "name")
    scores = _scored(wide, least).join(rules, "name").groupBy("value", "identity").agg(F.max(F.struct("score", "rule_id")).alias("best"))
    ranked = scores.withColumn("place", F.expr("row_number() over (partition by value order by best.score desc, identity)")).where("place <= 2")
    ranked = ranked.groupBy("value").agg(F.max(F.when(F.col("place") == 1, F.col("best"))).alias("best"), F.max(F.when(F.col("place") == 2, F.col("best.score"))).alias("second"))
    found = d.join(ranked.withColumnRenamed("value", "low"), "low", "left")
    near = F.expr(f"second is not null and (second = best.score or best.score - second < {margin!r})")
    status = F.coalesce("status", F.when(F.col("best").isNull(), "low_score").when(near, "ambiguous").otherwise("proposed"))
    shown = F.col("status").isNull()
    return found.select("value", "occurrences", status.alias("status"), F.when(shown, F.col("best.rule_id")).alias("rule_id"), F.when(shown, F.col("best.score")).alias("score"))


def proposal_id(policy: dict, corpus: str, rule_id: str, value: str) -> str:
    """Stable for a policy, a corpus (its manifest's digest), a rule and a value."""
    own = hashlib.sha256(json.dumps(policy, sort_keys=True).encode()).hexdigest()
    return hashlib.sha256(json.dumps([own, corpus, rule_id, value]).encode()).hexdigest()[:24]


def approved(policy: dict, values: list[tuple[str, str, str]]) -> dict:
    """The policy with a literal rule `fuzzy-<id>` for each (id, rule_id, value); it must still compile."""
    if len({i for i, _, _ in values}) < len(values):
        raise PolicyError("an id is given twice")
    by_id = {r["rule_id"]: r for r in policy["sensitive_values"]}
    more = [{"rule_id": f"fuzzy-{i}", "subject_id": by_id[r].get("subject_id", r), "type": by_id[r]["type"], "value": v} for i, r, v in values]
    out = policy | {"sensitive_values": [*policy["sensitive_values"], *more]}
    compiled(out)
    return out
