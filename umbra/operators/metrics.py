"""Disclosure metrics of a table: equivalence classes of quasi-identifiers and what they reveal.

Every function but numeric_emd() returns SQL text over a relation named in braces; `umbra.plans.sql.over` binds it to a
DataFrame.  Rows are first counted by (class, sensitive value), so what follows works on cells, not
rows; NULL groups with NULL.  Values that a class lacks need no rows: their part of each sum is known.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.held import held


def _list(columns: Sequence[str], prefix: str = "") -> str:
    return ", ".join(prefix + c for c in columns)


def _same(a: str, b: str, columns: Sequence[str]) -> str:
    return " AND ".join(f"{a}.{c} IS NOT DISTINCT FROM {b}.{c}" for c in columns)


def number(column: str) -> str:
    """SQL (Spark): the column as a finite number, NULL where it is none; suffixes and names of numbers don't count."""
    text = f"CAST({column} AS STRING)"
    return f"CASE WHEN {text} RLIKE '^ *[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)? *$' AND abs(TRY_CAST({column} AS DOUBLE)) < double('infinity') THEN TRY_CAST({column} AS DOUBLE) END"


def plain_number(column: str) -> str:
    return f"TRY_CAST({column} AS DOUBLE)"


def classes(qis: Sequence[str], t: str = "{t}") -> str:
    """A row a class with its size."""
    return f"SELECT {_list(qis)}, count(*) AS class_size FROM {t} GROUP BY {_list(qis)}"


def class_stats(qis: Sequence[str], t: str = "{t}") -> str:
    return (
        f"SELECT count(*) AS classes, min(class_size) AS min_size, max(class_size) AS max_size, round(avg(class_size), 9) AS mean_size, "
        f"round(median(class_size), 9) AS median_size FROM ({classes(qis, t)})"
    )


def residual_singletons(qis: Sequence[str], t: str = "{t}") -> str:
    return f"SELECT count(*) AS classes, count(CASE WHEN class_size = 1 THEN 1 END) AS singletons FROM ({classes(qis, t)})"


def metrics(qis: Sequence[str], sensitive: str, t: str = "{t}") -> str:
    """One row: k, l, entropy l, alpha, beta, enhanced beta, t (total variation), delta disclosure,
    sizes, re-identification risk, discernibility, classification loss, sensitive entropy."""
    q = _list(qis)
    return f"""
WITH cell AS (SELECT {q}, {sensitive} AS v, count(*) AS n FROM {t} GROUP BY {q}, {sensitive}),
total AS (SELECT sum(n) AS rows_n FROM cell),
share AS (SELECT v, sum(n) / max(rows_n) AS q FROM cell CROSS JOIN total GROUP BY v),
class AS (SELECT {q}, sum(n) AS m, count(*) AS l, max(n) AS top, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS entropy FROM cell GROUP BY {q}),
near AS (SELECT {_list(qis, "c.")}, c.v, c.n / k.m AS p, s.q AS q FROM cell c JOIN class k ON {_same("c", "k", qis)} JOIN share s ON c.v IS NOT DISTINCT FROM s.v),
far AS (SELECT max(tv) AS tv, max(beta) AS beta, max(enhanced) AS enhanced, max(delta) AS delta
        FROM (SELECT 0.5 * (1 + sum(abs(p - q) - q)) AS tv, max(greatest(0, p / q - 1)) AS beta, max(least(greatest(0, p / q - 1), -ln(q))) AS enhanced, max(abs(ln(p / q))) AS delta FROM near GROUP BY {q})),
spread AS (SELECT -sum(q * ln(q)) AS sensitive_entropy FROM share),
summary AS (SELECT count(*) AS classes, min(m) AS k, min(l) AS l, min(entropy) AS entropy, max(top / m) AS alpha, sum(m * m) AS discernibility,
                   sum(m - top) AS minority, avg(1.0 / m) AS mean_risk, max(1.0 / m) AS max_risk, sum(m) AS rows_n FROM class)
SELECT CAST(classes AS BIGINT) AS classes, CAST(k AS BIGINT) AS k_anonymity, CAST(l AS BIGINT) AS l_diversity,
       round(CAST(entropy AS DOUBLE), 9) AS minimum_entropy_nats, round(exp(entropy), 9) AS entropy_effective_l, CAST(floor(exp(entropy) + 1e-12) AS BIGINT) AS entropy_l_diversity,
       round(CAST(alpha AS DOUBLE), 9) AS alpha, round(CAST(beta AS DOUBLE), 9) AS basic_beta, round(CAST(enhanced AS DOUBLE), 9) AS enhanced_beta,
       round(CAST(tv AS DOUBLE), 9) AS t_closeness, round(CAST(delta AS DOUBLE), 9) AS delta_disclosure, round(CAST(sensitive_entropy AS DOUBLE), 9) AS sensitive_entropy,
       round(CAST(rows_n / (classes * k) AS DOUBLE), 9) AS average_class_size, CAST(discernibility AS BIGINT) AS discernibility,
       round(CAST(minority / rows_n AS DOUBLE), 9) AS classification_metric, round(CAST(mean_risk AS DOUBLE), 9) AS average_reid_risk, round(CAST(max_risk AS DOUBLE), 9) AS maximum_reid_risk
FROM summary CROSS JOIN far CROSS JOIN spread
"""


def beta_excess(qis: Sequence[str], sensitive: str, beta: float, t: str = "{t}") -> str:
    """By how much a value's relative increase in a class exceeds min(beta, -ln of its share), at most; not rounded."""
    q = _list(qis)
    return f"""
WITH cell AS (SELECT {q}, {sensitive} AS v, count(*) AS n FROM {t} GROUP BY {q}, {sensitive}),
total AS (SELECT sum(n) AS rows_n FROM cell),
share AS (SELECT v, sum(n) / max(rows_n) AS q FROM cell CROSS JOIN total GROUP BY v),
class AS (SELECT {q}, sum(n) AS m FROM cell GROUP BY {q})
SELECT max(greatest(0, c.n / k.m / s.q - 1) - least({float(beta)!r}D, -ln(s.q))) AS excess
FROM cell c JOIN class k ON {_same("c", "k", qis)} JOIN share s ON c.v IS NOT DISTINCT FROM s.v
"""


def only(columns: Sequence[str], text: str) -> str:
    return f"SELECT {_list(columns)} FROM ({text})"


def utility(qis: Sequence[str], sensitive: str, raw: str = "{raw}", t: str = "{t}") -> str:
    """Loss of a suppressed table against the raw one: rows, discernibility, classification."""
    q = _list(qis)
    return f"""
WITH cell AS (SELECT {q}, {sensitive} AS v, count(*) AS n FROM {t} GROUP BY {q}, {sensitive}),
class AS (SELECT sum(n) AS m, max(n) AS top FROM cell GROUP BY {q}),
a AS (SELECT coalesce(sum(m), 0) AS kept, coalesce(sum(m * m), 0) AS squares, coalesce(sum(m - top), 0) AS minority FROM class),
r AS (SELECT count(*) AS rows_n FROM {raw})
SELECT CAST(rows_n - kept AS BIGINT) AS suppressed, CAST(squares + (rows_n - kept) * rows_n AS BIGINT) AS discernibility,
       round(CAST((rows_n - kept + minority) / rows_n AS DOUBLE), 9) AS classification_metric FROM a CROSS JOIN r
"""


def recursive_cl(qis: Sequence[str], sensitive: str, t: str = "{t}") -> str:
    """For each l from 2: the largest r1 / (r_l + ...) over classes; NULL where a class has fewer values."""
    q = _list(qis)
    return f"""
WITH cell AS (SELECT {q}, {sensitive} AS v, count(*) AS n FROM {t} GROUP BY {q}, {sensitive}),
ranked AS (SELECT {q}, n, row_number() OVER (PARTITION BY {q} ORDER BY n DESC, v) AS rank,
                  max(n) OVER (PARTITION BY {q}) AS top,
                  sum(n) OVER (PARTITION BY {q} ORDER BY n DESC, v ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tail FROM cell),
classes AS (SELECT count(*) AS n FROM (SELECT {q} FROM cell GROUP BY {q}))
SELECT CAST(rank AS BIGINT) AS l, CASE WHEN count(*) = max(c.n) THEN round(CAST(max(top / tail) AS DOUBLE), 9) END AS recursive_c
FROM ranked CROSS JOIN classes c WHERE rank >= 2 GROUP BY rank
"""


#: Stretches that the distinct values of a numeric sensitive column are cut into, about as many to each.
STRETCHES = 64


def _among(column: Column, cuts: Sequence[float]) -> Column:
    """How many of the sorted cuts are at most the column, by bisection."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(column < F.lit(cuts[mid]), tree(low, mid)).otherwise(tree(mid + 1, high))

    return tree(0, len(cuts))


def numeric_emd(df: DataFrame, qis: Sequence[str], sensitive: str) -> float | None:
    """Largest earth mover's distance of a class to the whole on sorted support, over its span; None where a value isn't
    a number, or there are no rows.

    With F the share of rows up to a value and G a class's, the distance is the integral of |F - G|.  G is constant, g,
    between neighbouring values a, b of the class, and F never falls, so a piece is told by the integral of F up
    to a, to b and to where F reaches g, which is the value of a known rank.  A class thus takes as many rows as
    it has values.  Sums in sorted order are made within stretches of values and then over the stretches, of which
    five numbers each reach the driver.  Ranks that many classes ask for are looked up once."""
    q = list(qis)
    names = [f"umbra_q{i}" for i in range(len(q))]
    cells = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(q, names)], F.expr(number(f"`{sensitive}`")).alias("v")).groupBy(*names, "v").agg(F.count("*").alias("n"))
    cells = held(cells)
    if not cells.where("v is null").isEmpty():
        return None
    support = held(cells.groupBy("v").agg(F.sum("n").alias("n")))
    whole = support.agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.percentile_approx("v", [i / STRETCHES for i in range(1, STRETCHES)], 10_000).alias("cuts")).first()
    if whole["n"] is None:
        return None
    total, span = whole["n"], whole["hi"] - whole["lo"]
    if not span:
        return 0.0
    cuts = sorted(set(whole["cuts"]))
    local = support.withColumn("stretch", _among(F.col("v"), cuts))
    local = local.withColumn("cum", F.expr("sum(n) over (partition by stretch order by v rows between unbounded preceding and current row)")).withColumn("gap", F.expr("lead(v) over (partition by stretch order by v) - v"))
    local = local.withColumn("area", F.expr("coalesce(sum(cum * gap) over (partition by stretch order by v rows between unbounded preceding and 1 preceding), 0)"))
    parts = sorted(local.groupBy("stretch").agg(F.max("cum").alias("n"), F.min("v").alias("first"), F.max("v").alias("last"), F.max("area").alias("area")).collect())
    count, first, areas, ends, n, area = [0] * (len(cuts) + 1), [0.0] * (len(cuts) + 1), [0.0] * (len(cuts) + 1), [], 0, 0.0
    for k, p in enumerate(parts):
        count[p["stretch"]], first[p["stretch"]], areas[p["stretch"]] = n, p["first"], area
        to = parts[k + 1]["first"] if k + 1 < len(parts) else p["last"]
        area += n * (to - p["first"]) + p["area"] + p["n"] * (to - p["last"])
        n += p["n"]
        ends.append(n)
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("stretch") + 1)
    curve = local.select("v", "stretch", (of(count) + F.col("cum")).alias("upto"), (of(areas) + of(count) * (F.col("v") - of(first)) + F.col("area")).alias("area"))
    own = held(cells.join(curve, "v"))
    key = ", ".join(names)
    within = f"over (partition by {key}, stretch order by v"
    pieces = own.groupBy(*names, "stretch").agg(F.sum("n").alias("m"), F.min_by(F.struct("v", "area"), "v").alias("start"))
    along = f"over (partition by {key} order by stretch"
    pieces = pieces.select(*[F.col(c).alias(f"{c}_") for c in names], F.col("stretch").alias("s"), F.expr(f"coalesce(sum(m) {along} rows between unbounded preceding and 1 preceding), 0)").alias("m_before"), F.expr(f"sum(m) over (partition by {key})").alias("m"), F.expr(f"lead(start) {along})").alias("after"), F.expr(f"row_number() {along}) = 1").alias("leads"))
    same = F.expr(" and ".join([f"{c} <=> {c}_" for c in names] + ["stretch = s"]))
    walk = own.withColumn("g", F.expr(f"sum(n) {within} rows between unbounded preceding and current row)")).withColumn("next", F.expr(f"lead(struct(v, area)) {within})")).withColumn("leads_in", F.expr(f"row_number() {within}) = 1"))
    walk = walk.join(pieces, same).withColumn("g", F.expr("g + m_before")).withColumn("next", F.coalesce("next", "after", F.struct(F.lit(whole["hi"]).alias("v"), F.lit(float(area)).alias("area"))))
    rank = F.expr(f"cast((cast(g as decimal(19, 0)) * {total} + m - 1) div m as bigint)")
    walk = walk.select(*names, F.expr("g / m").alias("g"), F.col("v").alias("a"), F.col("next.v").alias("b"), F.col("area").alias("area_a"), F.col("next.area").alias("area_b"), F.expr("leads and leads_in").alias("front"), "upto", rank.alias("rank"))
    walk = held(walk.withColumn("rank", F.when(F.col("upto") < F.col("rank"), F.col("rank"))))  # else F has reached g at a
    asked = walk.where("rank is not null").select("rank").distinct().withColumn("stretch", F.element_at(F.array(*[F.lit(p["stretch"]) for p in parts]), _among(F.col("rank") - 1, ends) + 1))
    both = curve.select("stretch", F.col("upto").alias("at"), F.struct("v", "area").alias("met"), F.lit(None).cast("long").alias("ask")).union(asked.select("stretch", "rank", F.lit(None).cast("struct<v: double, area: double>"), "rank"))
    met = both.withColumn("met", F.expr("last_value(met, true) over (partition by stretch order by at desc, ask is null desc rows between unbounded preceding and current row)")).where("ask is not null").select(F.col("ask").alias("rank"), "met")
    walk = walk.join(met, "rank", "left").withColumn("met", F.expr("if(met.v < b, met, struct(b as v, area_b as area))"))
    piece = F.expr(f"if(rank is null, (area_b - area_a) / {total} - g * (b - a), g * (met.v - a) - (met.area - area_a) / {total} + (area_b - met.area) / {total} - g * (b - met.v))")
    far = walk.select(*names, (piece + F.when(F.col("front"), F.col("area_a") / total).otherwise(0.0)).alias("d")).groupBy(*names).agg(F.sum("d").alias("d")).agg(F.max("d")).first()[0]
    return round(far / span, 9)


def numeric_emd_plain(qis: Sequence[str], sensitive: str, t: str = "{t}", as_number: Callable[[str], str] = plain_number) -> str:
    """numeric_emd() as SQL with a row for each class and value, to test by."""
    q = _list(qis)
    return f"""
WITH cell AS (SELECT {q}, {as_number(sensitive)} AS v, count(*) AS n FROM {t} GROUP BY {q}, {as_number(sensitive)}),
support AS (SELECT v, sum(n) AS n FROM cell GROUP BY v),
curve AS (SELECT v, lead(v) OVER (ORDER BY v) - v AS gap, sum(n) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(n) OVER () AS umbra_cdf,
                 max(v) OVER () - min(v) OVER () AS span, count(CASE WHEN v IS NULL THEN 1 END) OVER () AS bad FROM support),
class AS (SELECT {q}, sum(n) AS m FROM cell GROUP BY {q}),
grid AS (SELECT {_list(qis, "k.")}, k.m, u.v, u.gap, u.umbra_cdf, u.span, u.bad, coalesce(c.n, 0) AS n FROM class k CROSS JOIN curve u LEFT JOIN cell c ON {_same("k", "c", qis)} AND c.v = u.v),
run AS (SELECT {q}, gap, umbra_cdf, span, bad, sum(n) OVER (PARTITION BY {q} ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / m AS local FROM grid),
dist AS (SELECT sum(abs(umbra_cdf - local) * coalesce(gap, 0)) / CASE WHEN max(span) > 0 THEN max(span) ELSE 1 END AS d, max(bad) AS bad FROM run GROUP BY {q})
SELECT CASE WHEN max(bad) = 0 THEN round(CAST(max(d) AS DOUBLE), 9) END AS numeric_emd FROM dist
"""


def column_stats(column: str, t: str = "{t}", as_number: Callable[[str], str] = number) -> str:
    """Of a quasi-identifier: distinct values, frequencies, and mean, median and variance of numbers."""
    return f"""SELECT * FROM (
WITH f AS (SELECT {column} AS v, count(*) AS n FROM {t} GROUP BY {column}),
a AS (SELECT count(*) AS distinct_values, min(n) AS min_frequency, max(n) AS max_frequency FROM f),
b AS (SELECT round(avg({as_number(column)}), 9) AS mean, round(median({as_number(column)}), 9) AS median, round(var_pop({as_number(column)}), 6) AS variance FROM {t})
SELECT '{column}' AS name, distinct_values, min_frequency, max_frequency, mean, median, variance FROM a CROSS JOIN b)
"""


def multi_sensitive(qis: Sequence[str], sensitive: Sequence[str], conditioned: bool = False, t: str = "{t}") -> str:
    """A row a sensitive column; conditioned: the other ones count as quasi-identifiers."""
    return " UNION ALL ".join(
        f"SELECT '{s}' AS sensitive, k_anonymity, l_diversity, classes, t_closeness FROM ({metrics([*qis, *(x for x in sensitive if conditioned and x != s)], s, t)})" for s in sensitive
    )
