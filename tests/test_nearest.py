"""Nearest rows by space partition against a comparison of all with all."""

import math
import random

import pytest

from umbra.operators import attacks, nearest
from umbra.plans.sql import over


def plain(release, points, n_x, label):
    """Per point, the labels of all nearest rows; rows: numbers, nominal values, label."""
    spans = []
    for i in range(n_x):
        v = [r[i] for r in (*release, *points) if r[i] is not None]
        spans.append(max(v) - min(v) if v else 0)
    width = len(release[0]) - 1 if release else 0
    out = {}
    for p in points:
        if any(p[i] is None for i in range(n_x)):
            continue
        d = []
        for r in release:
            if any(r[i] is None for i in range(n_x)):
                continue
            total = 0.0
            for i in range(width):
                total += (abs(p[i] - r[i]) / spans[i] if spans[i] else 0.0) if i < n_x else float(p[i] is None or p[i] != r[i])
            d.append((total / width, r[label]))
        if d:
            best = min(x for x, _ in d)
            near = [v for x, v in d if math.isclose(x, best)]
            out[p[:width]] = (min(near), max(near), len(near))
    return out


def got(spark, release, points, numeric, nominal, **options):
    kinds = ", ".join([f"`{c}` double" for c in numeric] + [f"`{c}` string" for c in nominal] + ["label string"])
    r, p = spark.createDataFrame(release, kinds), spark.createDataFrame(points, kinds)
    rows = nearest.nearest(r, p, numeric, nominal, "label", "label", **options).collect()
    found = {tuple(x["pid"]): (x["umbra_lo"], x["umbra_hi"], x["umbra_rows"]) for x in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("n_x, n_c, values, sample, block", [(1, 1, 3, 65_536, 8192), (3, 2, 4, 65_536, 8192), (2, 6, 2, 64, 7), (0, 3, 3, 200, 5), (2, 0, 0, 100, 9), (1, 8, 12, 300, 50)])
def test_equals_plain(spark, n_x, n_c, values, sample, block):
    rng = random.Random(n_x * 10 + n_c)
    number = lambda: None if rng.random() < 0.05 else rng.choice([rng.randrange(20) / 2, rng.gauss(5, 2), 3.0, 3.0 + 1e-10])
    value = lambda: None if rng.random() < 0.05 else rng.choice("abcdefghijkl"[:values]) + ("\0" if rng.random() < 0.1 else "")
    row = lambda: (*[number() for _ in range(n_x)], *[value() for _ in range(n_c)], rng.choice("xyz"))
    release, points = [row() for _ in range(400)], [row() for _ in range(250)]
    names = ["x", "n", "lo", "row", "cut", "mask", "pid", "d", "cell"]
    numeric, nominal = names[:n_x], [*names[n_x:], "bound", "e"][:n_c]
    want = plain(release, points, n_x, n_x + n_c)
    assert got(spark, release, points, numeric, nominal, sample=sample, block=block) == want


def test_null_rows_hide_nobody_and_ties_stay(spark):
    """A null number is nobody's neighbour; of two rows as near within the tolerance neither wins."""
    t = spark.createDataFrame([(0.0, "p"), (90.0, "q"), (None, "p")], "x double, s string")
    assert attacks.infer_nearest(t, spark.createDataFrame([(100.0, "q")], "x double, s string"), ["x"], [], "s").first()["accuracy"] == 1.0
    t = spark.createDataFrame([(10.0, "q"), (10.0 + 1e-10, "p")], "x double, s string")
    e = spark.createDataFrame([(20.0, "q")], "x double, s string")
    row = attacks.infer_nearest(t, e, ["x"], [], "s").first()
    assert (row["inferred"], row["abstained"]) == (0, 1) and row.asDict() == over(attacks.infer_nearest_plain(["x"], [], "s"), t, evaluation=e).first().asDict()


def test_slices_and_empty(spark, monkeypatch):
    monkeypatch.setattr(nearest, "SLICE", 10)
    release, points = [(float(i), "a", "xy"[i % 2]) for i in range(60)], [(i / 7, "a", "x") for i in range(300)]
    assert got(spark, release, points, ["x"], ["c"], block=20) == plain(release, points, 1, 2)
    assert got(spark, [], points, ["x"], ["c"]) == {} and got(spark, release, [], ["x"], ["c"]) == {}


def test_queries_equal_their_sql(spark):
    """Inference, groups and linkage against the SQL that compares all with all, on a table with nulls, ties and telling names."""
    rng = random.Random(5)
    row = lambda i: (i, rng.choice([None, 1.0, 2.0, 3.5]), rng.choice([None, *map(float, range(9))]), rng.choice(["u", "v", None]), rng.choice("ab"), rng.choice("st"))
    kinds = "id long, x double, n double, lo string, label string, truth string"
    t, e = (spark.createDataFrame([row(i) for i in range(120)], kinds) for _ in range(2))
    for numeric, nominal in ((["x"], ["lo"]), (["x", "n"], ["lo", "label"]), ([], ["lo", "label"])):
        a = attacks.infer_nearest(t, e, numeric, nominal, "truth").first().asDict()
        assert a == over(attacks.infer_nearest_plain(numeric, nominal, "truth"), t, evaluation=e).first().asDict() and a["abstained"] > 0
        g = attacks.inference_groups(t, e, numeric, nominal, "truth", "label").first().asDict()
        assert g == over(attacks.inference_groups_plain(numeric, nominal, "truth", "label"), t, evaluation=e).first().asDict()
        k = attacks.linkability(t, e, e, "id", numeric, nominal, ["n"], ["label"], "id").first().asDict()
        assert k == over(attacks.linkability_plain("id", numeric, nominal, ["n"], ["label"], "id"), t, a=e, b=e).first().asDict()
