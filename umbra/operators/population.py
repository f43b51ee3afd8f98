"""A released table against the population that it was drawn from; both are counted by class first."""

from __future__ import annotations

from collections.abc import Sequence

from .metrics import _list, _same


def _joined(qis: Sequence[str], t: str, population: str) -> str:
    q = _list(qis)
    return f"""
rel AS (SELECT {q}, count(*) AS f FROM {t} GROUP BY {q}),
pop AS (SELECT {q}, count(*) AS big FROM {population} GROUP BY {q}),
j AS (SELECT r.f, coalesce(p.big, 0) AS big FROM rel r LEFT JOIN pop p ON {_same("r", "p", qis)})"""


def delta_presence(qis: Sequence[str], t: str = "{t}", population: str = "{population}") -> str:
    """Least and largest chance that a member of the population's class is in the release; `inside`:
    whether the release is part of the population at all."""
    q = _list(qis)
    return f"""
WITH rel AS (SELECT {q}, count(*) AS f FROM {t} GROUP BY {q}),
pop AS (SELECT {q}, count(*) AS big FROM {population} GROUP BY {q}),
j AS (SELECT coalesce(r.f, 0) AS f, p.big FROM pop p LEFT JOIN rel r ON {_same("r", "p", qis)}),
outside AS (SELECT count(*) AS n FROM rel r LEFT JOIN pop p ON {_same("r", "p", qis)} WHERE r.f > coalesce(p.big, 0))
SELECT round(CAST(min(f / big) AS DOUBLE), 9) AS minimum_presence, round(CAST(max(f / big) AS DOUBLE), 9) AS maximum_presence, max(n) = 0 AS inside FROM j CROSS JOIN outside
"""


def k_map(qis: Sequence[str], k: int, t: str = "{t}", population: str = "{population}") -> str:
    """Whether each released class is that of at least k people; how many aren't, how many are of nobody."""
    return f"""
WITH {_joined(qis, t, population)}
SELECT min(big) >= {k} AS satisfied, count(CASE WHEN big < {k} THEN 1 END) AS violating, count(CASE WHEN big = 0 THEN 1 END) AS absent,
       CAST(min(big) AS BIGINT) AS minimum_size, CAST(max(big) AS BIGINT) AS maximum_size FROM j
"""


def reidentification(qis: Sequence[str], t: str = "{t}", population: str = "{population}") -> str:
    """Prosecutor, journalist and marketer risk; shares of rows unique in the sample and in the population."""
    return f"""
WITH {_joined(qis, t, population)}
SELECT round(CAST(max(1.0 / f) AS DOUBLE), 9) AS prosecutor, round(CAST(max(1.0 / big) AS DOUBLE), 9) AS journalist, round(CAST(sum(f / big) / sum(f) AS DOUBLE), 9) AS marketer,
       round(CAST(coalesce(sum(CASE WHEN f = 1 THEN f END), 0) / sum(f) AS DOUBLE), 9) AS sample_unique,
       round(CAST(coalesce(sum(CASE WHEN big = 1 THEN f END), 0) / sum(f) AS DOUBLE), 9) AS population_unique FROM j WHERE big > 0
"""
