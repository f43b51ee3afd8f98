"""Attacks on a release: singling out, attribute inference, linkage of two views."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.sql import over
from . import nearest
from .metrics import _list, _same

#: Quantile of the normal distribution behind the 95 % intervals.
Z = 1.96


def wilson(successes: str, trials: str, z: float = Z) -> tuple[str, str]:
    """SQL of the interval's ends."""
    mid = f"(({successes}) / ({trials}) + {z * z} / (2 * ({trials})))"
    half = f"{z} * sqrt(({successes}) / ({trials}) * (1 - ({successes}) / ({trials})) / ({trials}) + {z * z} / (4 * ({trials}) * ({trials})))"
    scale = f"(1 + {z * z} / ({trials}))"
    return f"greatest(0, ({mid} - {half}) / {scale})", f"least(1, ({mid} + {half}) / {scale})"


def singling_out(qis: Sequence[str], row_id: str, size: int | None = None, t: str = "{t}") -> str:
    """All predicates on up to `size` quasi-identifiers at once, by GROUPING SETS: how many there are,
    how many hold for one row alone, how many rows such a predicate exposes, and their share."""
    sets = [c for n in range(1, (size or len(qis)) + 1) for c in combinations(qis, n)]
    low, high = wilson("exposed", "rows_n")
    return f"""
WITH g AS (SELECT count(*) AS n, min({row_id}) AS first FROM {t} GROUP BY GROUPING SETS ({", ".join("(" + _list(s) + ")" for s in sets)})),
a AS (SELECT count(*) AS predicates, count(CASE WHEN n = 1 THEN 1 END) AS successes, count(DISTINCT CASE WHEN n = 1 THEN first END) AS exposed FROM g),
r AS (SELECT count(*) AS rows_n FROM {t})
SELECT predicates, successes, exposed, round(CAST(exposed / rows_n AS DOUBLE), 9) AS rate, round(CAST(1.0 / rows_n AS DOUBLE), 9) AS baseline,
       round(CAST({low} AS DOUBLE), 9) AS low, round(CAST({high} AS DOUBLE), 9) AS high FROM a CROSS JOIN r
"""


def _gower(numeric: Sequence[str], nominal: Sequence[str], a: str, b: str) -> str:
    """Mean distance: numbers by their share of the span (column span_x), others 0 or 1."""
    parts = [f"CASE WHEN s.span_{c} > 0 THEN abs({a}.{c} - {b}.{c}) / s.span_{c} ELSE 0 END" for c in numeric]
    parts += [f"CASE WHEN {a}.{c} = {b}.{c} THEN 0.0 ELSE 1.0 END" for c in nominal]
    return f"({' + '.join(parts)}) / {len(parts)}"


def _spans(numeric: Sequence[str], *tables: str) -> str:
    if not numeric:
        return "SELECT 0 AS none"
    return "SELECT " + ", ".join(f"max({c}) - min({c}) AS span_{c}" for c in numeric) + " FROM (" + " UNION ALL ".join(f"SELECT {_list(numeric)} FROM {x}" for x in tables) + ")"


def infer_nearest_plain(numeric: Sequence[str], nominal: Sequence[str], sensitive: str, t: str = "{t}", evaluation: str = "{evaluation}") -> str:
    """infer_nearest() as SQL that compares all distinct tuples with all, to test by."""
    return f"WITH {_labels_plain(numeric, nominal, sensitive, t, evaluation)},\n{_scored([*numeric, *nominal], sensitive, t, evaluation)}"


def _labels_plain(numeric: Sequence[str], nominal: Sequence[str], sensitive: str, t: str, evaluation: str) -> str:
    q = [*numeric, *nominal]
    return f"""umbra_s AS ({_spans(numeric, t, evaluation)}),
umbra_r AS (SELECT {_list(q)}, min({sensitive}) AS umbra_lo, max({sensitive}) AS umbra_hi FROM {t} GROUP BY {_list(q)}),
umbra_p AS (SELECT DISTINCT {_list(q)} FROM {evaluation}),
umbra_d AS (SELECT {_list(q, "e.")}, r.umbra_lo, r.umbra_hi, {_gower(numeric, nominal, "e", "r")} AS umbra_d FROM umbra_p e CROSS JOIN umbra_r r CROSS JOIN umbra_s s),
umbra_m AS (SELECT {_list(q)}, min(umbra_d) AS umbra_d FROM umbra_d GROUP BY {_list(q)}),
umbra_labels AS (SELECT {_list(q, "d.")}, min(d.umbra_lo) AS umbra_lo, max(d.umbra_hi) AS umbra_hi FROM umbra_d d JOIN umbra_m m ON {_same("d", "m", q)}
                 WHERE abs(d.umbra_d - m.umbra_d) <= 1e-9 * greatest(abs(d.umbra_d), abs(m.umbra_d)) GROUP BY {_list(q, "d.")})"""


def _labels_exact(qis: Sequence[str], sensitive: str, t: str) -> str:
    return f"umbra_labels AS (SELECT {_list(qis)}, min({sensitive}) AS umbra_lo, max({sensitive}) AS umbra_hi FROM {t} GROUP BY {_list(qis)})"


def _nearest_labels(t: DataFrame, points: DataFrame, numeric: Sequence[str], nominal: Sequence[str], low: str, high: str) -> DataFrame:
    near = nearest.nearest(t, points, numeric, nominal, low, high)
    return near.select(*[F.col("pid")[c].alias(c) for c in (*numeric, *nominal)], "umbra_lo", "umbra_hi", "umbra_rows")


def infer_nearest(t: DataFrame, evaluation: DataFrame, numeric: Sequence[str], nominal: Sequence[str], sensitive: str) -> DataFrame:
    """Labels of all nearest released rows; a guess only if they agree.  One row: rows evaluated, inferred and abstained, the
    guesses' accuracy, that of the most frequent label, and whether guessing beats it.  Nulls as in nearest()."""
    q = [*numeric, *nominal]
    labels = _nearest_labels(t, evaluation, numeric, nominal, sensitive, sensitive)
    return over(f"WITH umbra_labels AS (SELECT * FROM {{labels}}),\n{_scored(q, sensitive, '{t}', '{evaluation}')}", t, evaluation=evaluation, labels=labels)


def inference_groups(t: DataFrame, evaluation: DataFrame, numeric: Sequence[str], nominal: Sequence[str], sensitive: str, group: str) -> DataFrame:
    """Least and largest accuracy of infer_nearest() over the groups of evaluated rows."""
    labels = _nearest_labels(t, evaluation, numeric, nominal, sensitive, sensitive)
    return over(f"WITH umbra_labels AS (SELECT * FROM {{labels}}),\n{_grouped([*numeric, *nominal], sensitive, group, '{evaluation}')}", t, evaluation=evaluation, labels=labels)


def inference_groups_plain(numeric: Sequence[str], nominal: Sequence[str], sensitive: str, group: str, t: str = "{t}", evaluation: str = "{evaluation}") -> str:
    """inference_groups() as SQL that compares all with all."""
    return f"WITH {_labels_plain(numeric, nominal, sensitive, t, evaluation)},\n{_grouped([*numeric, *nominal], sensitive, group, evaluation)}"


def exact_groups(qis: Sequence[str], sensitive: str, group: str, t: str = "{t}", evaluation: str = "{evaluation}") -> str:
    """Least and largest accuracy of infer_exact() over the groups of evaluated rows."""
    return f"WITH {_labels_exact(qis, sensitive, t)},\n{_grouped(qis, sensitive, group, evaluation)}"


def infer_exact(qis: Sequence[str], sensitive: str, t: str = "{t}", evaluation: str = "{evaluation}") -> str:
    """Labels of released rows with the same quasi-identifiers; a guess only if they agree."""
    return f"WITH {_labels_exact(qis, sensitive, t)},\n{_scored(qis, sensitive, t, evaluation)}"


def _grouped(qis: Sequence[str], sensitive: str, group: str, evaluation: str) -> str:
    return f"""umbra_e AS (SELECT {_list(qis)}, {sensitive} AS umbra_truth, {group} AS umbra_group, count(*) AS umbra_n FROM {evaluation} GROUP BY {_list(dict.fromkeys([*qis, sensitive, group]))}),
umbra_g AS (SELECT e.umbra_group, sum(CASE WHEN l.umbra_lo = l.umbra_hi AND l.umbra_lo = e.umbra_truth THEN e.umbra_n ELSE 0 END) / sum(e.umbra_n) AS umbra_accuracy
            FROM umbra_e e LEFT JOIN umbra_labels l ON {_same("e", "l", qis)} GROUP BY e.umbra_group)
SELECT count(*) AS group_count, round(CAST(min(umbra_accuracy) AS DOUBLE), 9) AS minimum_accuracy, round(CAST(max(umbra_accuracy) AS DOUBLE), 9) AS maximum_accuracy FROM umbra_g
"""


def _scored(qis: Sequence[str], sensitive: str, t: str, evaluation: str) -> str:
    return f"""umbra_e AS (SELECT {_list(qis)}, {sensitive} AS umbra_truth, count(*) AS umbra_n FROM {evaluation} GROUP BY {_list(qis)}, {sensitive}),
umbra_top AS (SELECT {sensitive} AS umbra_label FROM {t} GROUP BY {sensitive} ORDER BY count(*) DESC, {sensitive} LIMIT 1),
umbra_g AS (SELECT e.umbra_n AS n, e.umbra_truth AS truth, CASE WHEN l.umbra_lo = l.umbra_hi THEN l.umbra_lo END AS guess, m.umbra_label AS label
            FROM umbra_e e LEFT JOIN umbra_labels l ON {_same("e", "l", qis)} CROSS JOIN umbra_top m)
SELECT CAST(sum(n) AS BIGINT) AS evaluated, CAST(coalesce(sum(CASE WHEN guess IS NOT NULL THEN n END), 0) AS BIGINT) AS inferred,
       CAST(coalesce(sum(CASE WHEN guess IS NULL THEN n END), 0) AS BIGINT) AS abstained,
       round(CAST(coalesce(sum(CASE WHEN guess = truth THEN n END), 0) / sum(n) AS DOUBLE), 9) AS accuracy,
       round(CAST(coalesce(sum(CASE WHEN label = truth THEN n END), 0) / sum(n) AS DOUBLE), 9) AS baseline,
       coalesce(sum(CASE WHEN guess = truth THEN n END), 0) > coalesce(sum(CASE WHEN label = truth THEN n END), 0) AS risk FROM umbra_g"""


def linkability_plain(subject: str, numeric_a: Sequence[str], nominal_a: Sequence[str], numeric_b: Sequence[str], nominal_b: Sequence[str], row_id: str, t: str = "{t}", a: str = "{a}", b: str = "{b}") -> str:
    """linkability() as SQL that compares all subjects with all rows, to test by."""

    def near(name: str, numeric: Sequence[str], nominal: Sequence[str], x: str) -> str:
        q = list(dict.fromkeys([*numeric, *nominal]))
        held = ", ".join(f"{c} AS {c}" for c in q if c != subject)
        return f"""
umbra_s_{name} AS ({_spans(numeric, t, x)}),
umbra_d_{name} AS (SELECT v.umbra_subject, r.{row_id} AS umbra_row, {_gower(numeric, nominal, "v", "r")} AS umbra_d
             FROM (SELECT {subject} AS umbra_subject, {held or "1"} FROM {x}) v CROSS JOIN {t} r CROSS JOIN umbra_s_{name} s),
umbra_m_{name} AS (SELECT umbra_subject, min(umbra_d) AS umbra_d FROM umbra_d_{name} GROUP BY umbra_subject),
umbra_n_{name} AS (SELECT d.umbra_subject, CASE WHEN count(*) = 1 THEN min(d.umbra_row) END AS umbra_row FROM umbra_d_{name} d JOIN umbra_m_{name} m ON d.umbra_subject = m.umbra_subject
             WHERE abs(d.umbra_d - m.umbra_d) <= 1e-9 * greatest(abs(d.umbra_d), abs(m.umbra_d)) GROUP BY d.umbra_subject)"""

    return f"""
WITH {near("a", numeric_a, nominal_a, a)}, {near("b", numeric_b, nominal_b, b)},
{_linked(t, a, b, subject)}
"""


def _linked(t: str, a: str, b: str, subject: str) -> str:
    low, high = wilson("links", "subjects")
    return f"""umbra_z AS (SELECT count(*) AS subjects, count(CASE WHEN x.umbra_row = y.umbra_row THEN 1 END) AS links
            FROM (SELECT DISTINCT {subject} AS umbra_subject FROM {a}) i JOIN (SELECT DISTINCT {subject} AS umbra_subject FROM {b}) k ON i.umbra_subject = k.umbra_subject
            LEFT JOIN umbra_n_a x ON i.umbra_subject = x.umbra_subject LEFT JOIN umbra_n_b y ON i.umbra_subject = y.umbra_subject),
umbra_all AS (SELECT count(*) AS rows_n FROM {t})
SELECT subjects, links, round(CAST(links / subjects AS DOUBLE), 9) AS rate, round(CAST(1.0 / rows_n AS DOUBLE), 9) AS baseline,
       round(CAST({low} AS DOUBLE), 9) AS low, round(CAST({high} AS DOUBLE), 9) AS high FROM umbra_z CROSS JOIN umbra_all"""


def linkability(t: DataFrame, a: DataFrame, b: DataFrame, subject: str, numeric_a: Sequence[str], nominal_a: Sequence[str], numeric_b: Sequence[str], nominal_b: Sequence[str], row_id: str) -> DataFrame:
    """Each view's subjects are matched to their nearest released row, if it is the only one; a link succeeds where both
    views lead to the same row.  One row: subjects of both views, links, their rate, that of chance, and an interval.
    A subject without a nearest row (a null number) is one that isn't linked."""
    views, frames = [], {}
    for name, numeric, nominal, x in (("a", numeric_a, nominal_a, a), ("b", numeric_b, nominal_b, b)):
        q = [*numeric, *nominal]
        frames[f"near_{name}"] = _nearest_labels(t, x, numeric, nominal, row_id, row_id)
        views.append(f"umbra_n_{name} AS (SELECT v.{subject} AS umbra_subject, CASE WHEN n.umbra_rows = 1 THEN n.umbra_lo END AS umbra_row FROM {{{name}}} v JOIN {{near_{name}}} n ON {_same('v', 'n', q)})")
    return over(f"WITH {', '.join(views)},\n{_linked('{t}', '{a}', '{b}', subject)}", t, a=a, b=b, **frames)


def against_control(attack: str, control: str) -> str:
    """An attack's rate against that of the same attack on a control that holds none of its subjects; a
    risk if it is higher."""
    return f"SELECT a.rate AS rate, c.rate AS control_rate, round(CAST(a.rate - c.rate AS DOUBLE), 9) AS excess, a.rate > c.rate AS risk FROM ({attack}) a CROSS JOIN ({control}) c"


def against_control_rows(attack: DataFrame, control: DataFrame) -> DataFrame:
    """against_control() of an attack's row and that on a control."""
    return over(against_control("SELECT * FROM {t}", "SELECT * FROM {control}"), attack, control=control)
