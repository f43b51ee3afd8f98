"""Transforms that reduce disclosure: suppression, recoding by hierarchies, microaggregation, coding."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.held import held
from ..plans.sql import over
from . import metrics
from .metrics import _list, _same


class PrivacyViolation(ValueError):
    """A table misses the bounds asked for."""


def suppress_small_classes(qis: Sequence[str], k: int, t: str = "{t}") -> str:
    """The rows whose class has at least k."""
    return f"SELECT x.* FROM {t} x JOIN (SELECT {_list(qis)} FROM {t} GROUP BY {_list(qis)} HAVING count(*) >= {k}) c ON {_same('x', 'c', qis)}"


def top_bottom_code(columns: Mapping[str, tuple[float, float]], keep: Sequence[str], t: str = "{t}") -> str:
    """Numbers clamped to bounds."""
    return f"SELECT {_list(keep)}, " + ", ".join(f"greatest({lo!r}, least({hi!r}, {c})) AS {c}" for c, (lo, hi) in columns.items()) + f" FROM {t}"


def microaggregate(column: str | Sequence[str], order: Sequence[str], k: int, bounds: tuple[float, float] | Sequence[tuple[float, float]], keep: Sequence[str], t: str = "{t}", places: int = 6) -> str:
    """Clamped numbers in clusters of k in sorted order (of all the columns), the last one up to 2k - 1, each
    value its cluster's mean, rounded.

    Places in the order are counted by stretches of the first column's range and then within each, so that no
    task sorts all rows (unless all values are alike); a cluster may cross stretches."""
    columns = [column] if isinstance(column, str) else list(column)
    limits = [bounds] if isinstance(column, str) else list(bounds)
    xs = [f"umbra_x{i}" for i in range(len(columns))]
    coded = ", ".join(f"CAST(greatest({lo!r}, least({hi!r}, {c})) AS DOUBLE) AS {x}" for c, (lo, hi), x in zip(columns, limits, xs))
    return f"""
WITH coded AS (SELECT {_list(dict.fromkeys([*keep, *order]))}, {coded} FROM {t}),
s AS (SELECT min({xs[0]}) AS base, max({xs[0]}) - min({xs[0]}) AS span, count(*) AS umbra_n FROM coded),
cut AS (SELECT coded.*, s.umbra_n, CAST(CASE WHEN s.span > 0 THEN least(1023, floor(({xs[0]} - s.base) / s.span * 1024)) ELSE 0 END AS INT) AS umbra_cut FROM coded CROSS JOIN s),
before AS (SELECT umbra_cut, sum(m) OVER (ORDER BY umbra_cut) - m AS rows_before FROM (SELECT umbra_cut, count(*) AS m FROM cut GROUP BY umbra_cut)),
placed AS (SELECT cut.*, rows_before + row_number() OVER (PARTITION BY cut.umbra_cut ORDER BY {_list(xs)}, {_list(order)}) AS umbra_r FROM cut JOIN before ON cut.umbra_cut = before.umbra_cut),
cluster AS (SELECT *, least(floor((umbra_r - 1) / {k}), greatest(floor(umbra_n / {k}) - 1, 0)) AS umbra_c FROM placed)
SELECT {_list(keep)}, {", ".join(f"round(avg({x}) OVER (PARTITION BY umbra_c), {places}) AS {c}" for x, c in zip(xs, columns))} FROM cluster
"""


def microaggregate_plain(column: str, order: Sequence[str], k: int, bounds: tuple[float, float], keep: Sequence[str], t: str = "{t}") -> str:
    """microaggregate() of one column by a single window over all rows, to test by."""
    lo, hi = bounds
    return f"""
WITH coded AS (SELECT {_list(keep)}, greatest({lo!r}, least({hi!r}, {column})) AS x FROM {t}),
placed AS (SELECT *, row_number() OVER (ORDER BY x, {_list(order)}) AS r, count(*) OVER () AS n FROM coded),
cluster AS (SELECT *, least(floor((r - 1) / {k}), greatest(floor(n / {k}) - 1, 0)) AS c FROM placed)
SELECT {_list(keep)}, round(avg(x) OVER (PARTITION BY c), 6) AS {column} FROM cluster
"""


def twelve_digits(column: str) -> str:
    """SQL: a number as text with 12 significant digits, no trailing zeros (as %.12g does from 1e-4 up to 1e12)."""
    return f"regexp_replace(regexp_replace(CAST(CAST(CAST(format_string('%.11e', CAST({column} AS DOUBLE)) AS DOUBLE) AS DECIMAL(38, 15)) AS STRING), '([.][0-9]*?)0+$', '$1'), '[.]$', '')"


def microaggregated(df: DataFrame, qis: Sequence[str], numeric: Sequence[str], k: int, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """df with the numeric quasi-identifiers coded and averaged; refused if its classes stay below k."""
    if k < 2 or not numeric or not set(numeric) <= set(qis):
        raise ValueError("numeric columns are quasi-identifiers, k at least 2")
    rest = [c for c in df.columns if c not in numeric]
    wide = [bounds.get(c, (-1.7976931348623157e308, 1.7976931348623157e308)) for c in numeric]
    numbers = df.select(*[F.col(c).cast("double").alias(c) if c in numeric else F.col(c) for c in df.columns])
    if numbers.where(" or ".join(f"{c} is null" for c in numeric)).limit(1).count() or df.count() < k:
        raise PrivacyViolation("a value isn't a number, or there are fewer rows than k")
    out = over(microaggregate(numeric, rest or numeric, k, wide, rest, places=15), numbers)
    out = out.select(*[F.expr(twelve_digits(c)).alias(c) if c in numeric else F.col(c) for c in df.columns])
    if over(f"SELECT min(class_size) FROM ({metrics.classes(qis)})", out).first()[0] < k:
        raise PrivacyViolation("classes below k remain")
    return out


def _leveled(df: DataFrame, hierarchies: Mapping[str, Mapping[str, Sequence[str]]]) -> tuple[DataFrame, dict[str, int]]:
    """df with, for each column of the hierarchies, an array of the raw value and its generalisations."""
    depth = {}
    for c, h in hierarchies.items():
        sizes = {len(v) for v in h.values()}
        if len(sizes) != 1:
            raise ValueError(f"{c}: a hierarchy has one depth")
        depth[c] = sizes.pop()
        levels = df.sparkSession.createDataFrame([(k, [k, *v]) for k, v in h.items()], f"value string, `umbra_{c}` array<string>")
        df = df.join(levels, df[c].cast("string") == levels["value"], "left").drop("value")
        df = df.withColumn(f"umbra_{c}", F.coalesce(f"umbra_{c}", F.array(F.raise_error(F.lit(f"{c}: a value has no hierarchy")).cast("string"))))
    return df, depth


def global_levels(df: DataFrame, qis: Sequence[str], hierarchies: Mapping[str, Mapping[str, Sequence[str]]], k: int, max_suppression: float = 0.0) -> DataFrame:
    """One row: the level of each column (0: as it is) that suppresses fewest rows, then generalises
    least, of all that leave classes of k within the share of suppressed rows; no row if none does.

    All of the lattice is evaluated in one plan, over distinct tuples with their counts."""
    tuples, depth = _leveled(df.groupBy(*qis).agg(F.count("*").alias("n")), hierarchies)
    for c in hierarchies:
        tuples = tuples.withColumn(f"level_{c}", F.explode(F.sequence(F.lit(0), F.lit(depth[c])))).withColumn(c, F.expr(f"umbra_{c}[level_{c}]"))
    levels = [f"level_{c}" for c in hierarchies]
    sizes = tuples.groupBy(*levels, *qis).agg(F.sum("n").alias("n"))
    found = sizes.groupBy(*levels).agg(F.sum(F.when(F.col("n") < k, F.col("n")).otherwise(0)).alias("suppressed"), F.sum("n").alias("rows_n"))
    found = found.where((F.col("suppressed") < F.col("rows_n")) & (F.col("suppressed") <= F.lit(max_suppression) * F.col("rows_n")))
    best = found.agg(F.min(F.struct("suppressed", F.expr(" + ".join(levels)).alias("total"), *levels)).alias("best")).where("best is not null")
    return best.select("best.suppressed", *[f"best.{x}" for x in levels])


def generalize(df: DataFrame, qis: Sequence[str], hierarchies: Mapping[str, Mapping[str, Sequence[str]]], k: int, max_suppression: float = 0.0) -> DataFrame:
    """df at the levels of global_levels(), without the rows of classes below k."""
    best = global_levels(df, qis, hierarchies, k, max_suppression).first()
    if best is None:
        raise PrivacyViolation("no level vector reaches k")
    out, _ = _leveled(df, hierarchies)
    for c in hierarchies:
        out = out.withColumn(c, F.expr(f"umbra_{c}[{best[f'level_{c}']}]"))
    return over(suppress_small_classes(qis, k), out.select(*df.columns))


def generalize_locally(df: DataFrame, qis: Sequence[str], hierarchies: Mapping[str, Mapping[str, Sequence[str]]], k: int) -> DataFrame:
    """Raises one column by one level on all rows that are still in classes below k, whichever leaves
    fewest of them, then generalises least, until none is left.

    Equal tuples always move together, so there is one row for each distinct tuple.  Classes of at least k are a table of keys and
    sizes that only grows; a step looks at the tuples below k alone, for all columns at once, adds up where they would go and what is
    there already, and moves on those that stay below.  A few numbers a column reach the driver."""
    tuples, depth = _leveled(df.groupBy(*qis).agg(F.count("*").alias("n")), hierarchies)
    names = list(hierarchies)
    shown = lambda q: F.element_at(f"path_{names.index(q)}", F.col(f"level_{names.index(q)}") + 1) if q in hierarchies else F.col("raw")[q].cast("string")
    key = lambda d: d.withColumn("key", F.concat_ws("\0", *[F.coalesce(F.concat(F.lit("v"), F.base64(shown(q).cast("binary"))), F.lit("n")) for q in qis]))
    paths, levels = [f"path_{i}" for i in range(len(names))], [f"level_{i}" for i in range(len(names))]
    left = tuples.select(F.struct(*[F.col(q) for q in qis]).alias("raw"), "n", *[F.col(f"umbra_{c}").alias(p) for c, p in zip(names, paths)], *[F.lit(0).alias(x) for x in levels])
    left = held(key(left))
    done = []

    def settled(here: DataFrame, sizes: DataFrame) -> DataFrame:
        """Tuples that stay below k; the others are done.  sizes: (key, total) of their classes."""
        here = held(here.join(sizes, "key"))
        done.append(here.where(f"total >= {k}").select("raw", *[shown(q).alias(f"new_{i}") for i, q in enumerate(qis)]))
        return here.where(f"total < {k}").drop("total")

    sizes = left.groupBy("key").agg(F.sum("n").alias("total"))
    classes = held(sizes.where(f"total >= {k}"))
    left = settled(left, sizes)
    while not left.isEmpty():  # each step raises levels, so it ends at the latest when the hierarchies are exhausted
        raised = None
        for i, c in enumerate(names):
            one = left.drop("key").withColumn("moves", F.col(f"level_{i}") < depth[c]).withColumn(f"level_{i}", F.least(F.col(f"level_{i}") + 1, F.lit(depth[c]))).withColumn("option", F.lit(i))
            raised = one if raised is None else raised.unionByName(one)
        raised = held(key(raised))
        met = raised.groupBy("option", "key").agg(F.sum("n").alias("m"), F.max("moves").alias("moves"), F.sum(F.expr(" + ".join(levels)) * F.col("n")).alias("cost"))
        met = held(met.join(classes, "key", "left").withColumn("total", F.col("m") + F.coalesce("total", F.lit(0))))
        options = met.groupBy("option").agg(F.sum(F.when(F.col("total") < k, F.col("m")).otherwise(0)).alias("below"), F.sum("cost").alias("cost"), F.max("moves").alias("moves")).where("moves").collect()
        if not options:
            raise PrivacyViolation("the hierarchies are exhausted")
        best = min((r["below"], r["cost"], r["option"]) for r in options)[2]
        chosen = met.where(f"option = {best}")
        classes = held(classes.union(chosen.where(f"total >= {k}").select("key", "m")).groupBy("key").agg(F.sum("total").alias("total")))
        left = settled(raised.where(f"option = {best}").drop("moves", "option"), chosen.select("key", "total"))
    final = done[0]
    for d in done[1:]:
        final = final.union(d)
    final = final.select(*[F.col("raw")[q].alias(f"umbra_raw_{q}") for q in qis], *[F.col(f"new_{i}").alias(f"umbra_new_{q}") for i, q in enumerate(qis)])
    out = over("SELECT x.*, " + ", ".join(f"m.umbra_new_{q}" for q in qis) + " FROM {t} x JOIN {m} m ON " + " AND ".join(f"x.{q} IS NOT DISTINCT FROM m.umbra_raw_{q}" for q in qis), df, m=final)
    return out.select(*[F.col(f"umbra_new_{c}").alias(c) if c in qis else F.col(c) for c in df.columns])


#: Bounds that a table can be held to: the metric's column, and whether it is a lower bound.  Besides these:
#: beta (each increase up to min(beta, -ln share)), recursive_cl (the pair c, l) and numeric_emd.
BOUNDS = {"k": ("k_anonymity", True), "alpha": ("alpha", False), "t": ("t_closeness", False), "entropy_l": ("entropy_effective_l", True), "delta": ("delta_disclosure", False)}


def _missed(df: DataFrame, qis: Sequence[str], sensitive: str, bound: str, limit) -> bool:
    if bound == "beta":
        return over(metrics.beta_excess(qis, sensitive, limit), df).first()[0] > 1e-9
    if bound == "numeric_emd":
        found = metrics.numeric_emd(df, qis, sensitive)
        return found is None or found > limit + 1e-9
    c, least = limit
    if least < 2:
        raise ValueError("recursive_cl: l is at least 2")
    found = next((r["recursive_c"] for r in over(metrics.recursive_cl(qis, sensitive), df).where(F.col("l") == least).collect()), None)
    return found is None or found > c + 1e-9


def violations(df: DataFrame, qis: Sequence[str], sensitive: str, bounds: Mapping[str, float | tuple[float, int]]) -> list[str]:
    """Names of the bounds that df misses."""
    row = over(metrics.metrics(qis, sensitive), df).first()
    other = ("beta", "recursive_cl", "numeric_emd")
    return [b for b, limit in bounds.items() if (_missed(df, qis, sensitive, b, limit) if b in other else row[BOUNDS[b][0]] < limit - 1e-9 if BOUNDS[b][1] else row[BOUNDS[b][0]] > limit + 1e-9)]


def enforce(df: DataFrame, qis: Sequence[str], sensitive: str, hierarchies: Mapping[str, Mapping[str, Sequence[str]]], k: int, bounds: Mapping[str, float | tuple[float, int]], max_suppression: float = 0.0) -> DataFrame:
    """generalize(), but only if the result keeps all bounds."""
    out = generalize(df, qis, hierarchies, k, max_suppression)
    missed = violations(out, qis, sensitive, {"k": k, **bounds})
    if missed:
        raise PrivacyViolation("bounds missed: " + ", ".join(missed))
    return out
