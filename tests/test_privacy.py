"""Goldens of the metrics, transforms and attacks on small tables."""

import random

import pytest

from umbra.operators import attacks, dp, graph, metrics, population, transforms
from umbra.plans.sql import over


def frame(spark, columns, rows):
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns.split()))


def one(spark, text, df, **more):
    return over(text, df, **more).first().asDict()


@pytest.fixture(scope="module")
def people(spark):
    return frame(spark, "zip age condition", [("10001", "30", "A"), ("10001", "30", "B"), ("20002", "40", "A"), ("20002", "40", "A")])


def test_people(spark, people):
    got = one(spark, metrics.metrics(["zip", "age"], "condition"), people)
    assert (got["k_anonymity"], got["l_diversity"], got["classes"], got["discernibility"]) == (2, 1, 2, 8)
    assert (got["classification_metric"], got["average_reid_risk"]) == (0.25, 0.5)


def test_advanced(spark):
    d = frame(spark, "g condition", [(g, c) for g, cs in (("a", "AABC"), ("b", "ABCC")) for c in cs])
    got = one(spark, metrics.metrics(["g"], "condition"), d)
    assert got["alpha"] == 0.5 and got["k_anonymity"] == 4 and got["entropy_l_diversity"] == 2 and got["t_closeness"] == 0.125
    assert got["entropy_effective_l"] == pytest.approx(2.828427124746) and got["basic_beta"] == pytest.approx(1 / 3) and got["enhanced_beta"] == pytest.approx(1 / 3)
    assert {r["l"]: r["recursive_c"] for r in over(metrics.recursive_cl(["g"], "condition"), d).collect()} == {2: 1.0, 3: 2.0}


def test_numeric_distance(spark):
    d = frame(spark, "g income", [("a", "0"), ("a", "0"), ("b", "10"), ("b", "10")])
    assert metrics.numeric_emd(d, ["g"], "income") == 0.5
    bad = frame(spark, "g income", [("a", "0"), ("b", "x")])
    assert metrics.numeric_emd(bad, ["g"], "income") is None and metrics.numeric_emd(d.limit(0), ["g"], "income") is None
    assert metrics.numeric_emd(d.where("income = '10'"), ["g"], "income") == 0.0


def test_numeric_distance_equals_plain(spark, monkeypatch):
    import random

    monkeypatch.setattr(metrics, "STRETCHES", 7)
    rng = random.Random(3)
    for values, classes in ((5, 4), (60, 30), (400, 3)):
        rows = [(rng.choice([None, *range(classes)]), rng.randrange(2), rng.choice([1.0, rng.randrange(values) ** 2 / 7])) for _ in range(500)]
        d = spark.createDataFrame(rows, "a int, b int, x double")
        assert metrics.numeric_emd(d, ["a", "b"], "x") == pytest.approx(one(spark, metrics.numeric_emd_plain(["a", "b"], "x"), d)["numeric_emd"], abs=2e-9)


def test_conditioned(spark):
    d = frame(spark, "g condition income", [("a", "A", "10"), ("a", "B", "20"), ("b", "A", "10"), ("b", "B", "20")])
    assert [r["k_anonymity"] for r in over(metrics.multi_sensitive(["g"], ["condition", "income"]), d).collect()] == [2, 2]
    got = over(metrics.multi_sensitive(["g"], ["condition", "income"], True), d).collect()
    assert [(r["k_anonymity"], r["classes"], r["t_closeness"]) for r in got] == [(1, 4, 0.5)] * 2


def test_suppression_utility(spark):
    raw = frame(spark, "g condition", [("a", "A"), ("a", "B"), ("b", "A"), ("c", "B")])
    kept = over(transforms.suppress_small_classes(["g"], 2), raw)
    assert kept.count() == 2
    assert one(spark, metrics.utility(["g"], "condition"), kept, raw=raw) == {"suppressed": 2, "discernibility": 12, "classification_metric": 0.75}


def test_population(spark):
    rel = frame(spark, "zip age", [("a", "20"), ("a", "20"), ("b", "30")])
    pop = frame(spark, "zip age", [("a", "20")] * 4 + [("b", "30")] * 2)
    got = one(spark, population.delta_presence(["zip", "age"]), rel, population=pop)
    assert got == {"minimum_presence": 0.5, "maximum_presence": 0.5, "inside": True}
    got = one(spark, population.k_map(["zip", "age"], 2), rel, population=pop)
    assert got["satisfied"] and (got["minimum_size"], got["maximum_size"]) == (2, 4)
    small = frame(spark, "zip age", [("a", "20")])
    got = one(spark, population.k_map(["zip", "age"], 2), frame(spark, "zip age", [("a", "20"), ("b", "30")]), population=small)
    assert not got["satisfied"] and (got["violating"], got["absent"]) == (2, 1)
    pop = frame(spark, "zip age", [("a", "20")] * 4 + [("b", "30"), ("c", "40")])
    got = one(spark, population.reidentification(["zip", "age"]), rel, population=pop)
    assert got == {"prosecutor": 1.0, "journalist": 1.0, "marketer": 0.5, "sample_unique": 0.333333333, "population_unique": 0.333333333}


def test_global_recoding(spark):
    d = frame(spark, "zip age condition", [("10001", "30", "A"), ("10002", "31", "B"), ("20001", "40", "A"), ("20002", "41", "B")])
    h = {"zip": {z: [z[:4] + "*", "*"] for z in ("10001", "10002", "20001", "20002")}, "age": {a: [f"{a[0]}0-{a[0]}9", "*"] for a in ("30", "31", "40", "41")}}
    assert transforms.global_levels(d, ["zip", "age"], h, 2).first().asDict() == {"suppressed": 0, "level_zip": 1, "level_age": 1}
    assert ("1000*", "30-39", "A") in [tuple(r) for r in transforms.generalize(d, ["zip", "age"], h, 2).collect()]
    with pytest.raises(transforms.PrivacyViolation):
        transforms.enforce(d, ["zip", "age"], "condition", h, 2, {"alpha": 0.4})


def test_more_bounds(spark):
    rows = [("a", "1")] * 3 + [("a", "9")] + [("b", "1")] * 4
    d = frame(spark, "zip v", rows)
    h = {"zip": {z: ["*"] for z in "ab"}}
    # 9: share 1/8, in class a 1/4, increase 1 <= -ln(1/8); 1: increase 1/7 in b, but -ln(7/8) = 0.1335
    for bounds in ({"beta": 50}, {"recursive_cl": (2.9, 2)}, {"recursive_cl": (100, 3)}, {"numeric_emd": 0.1}):
        with pytest.raises(transforms.PrivacyViolation, match=next(iter(bounds))):
            transforms.enforce(d, ["zip"], "v", h, 4, bounds)
    x = d.where("zip = 'a'")
    assert transforms.violations(x, ["zip"], "v", {"recursive_cl": (3, 2), "numeric_emd": 0.0, "beta": 0.5}) == []
    assert transforms.violations(x, ["zip"], "v", {"recursive_cl": (2.9, 2)}) == ["recursive_cl"]
    assert transforms.violations(frame(spark, "zip v", [("a", "x")]), ["zip"], "v", {"numeric_emd": 1.0}) == ["numeric_emd"]


def test_local_recoding(spark):
    d = frame(spark, "zip condition", [("10001", "A"), ("10001", "B"), ("20001", "A"), ("20002", "B")])
    h = {"zip": {z: [z[:3] + "**"] for z in ("10001", "20001", "20002")}}
    assert sorted(r["zip"] for r in transforms.generalize_locally(d, ["zip"], h, 2).collect()) == ["10001", "10001", "200**", "200**"]


def test_local_recoding_equals_plain(spark):
    """Against a plain loop over rows, on tables of several columns, one without a hierarchy and with nulls."""
    import random
    from collections import Counter

    for seed in range(3):
        rng = random.Random(seed)
        k = 2 + seed
        h = {"a": {f"{i:02}": [f"{i:02}"[:1] + "*", "**"] for i in range(30)}, "b": {x: [y, "*"] for x, y in zip("pqrstu", "PPQQRR")}}
        rows = [(f"{min(rng.randrange(30), rng.randrange(30)):02}", rng.choice("pqrstu"), rng.choice(["u", "v", None]), i) for i in range(150)]
        level = {r[:3]: [0, 0] for r in rows}
        show = lambda r, at: tuple(([v, *h[c][v]])[n] for c, v, n in zip("ab", r, at)) + (r[2],)
        count = lambda lv: Counter(show(r[:3], lv[r[:3]]) for r in rows)
        failed = False
        while True:
            sizes = count(level)
            unsafe = [t for t in level if sizes[show(t, level[t])] < k]
            if not unsafe:
                break
            options = []
            for i in range(2):
                if any(level[t][i] < 2 for t in unsafe):
                    new = {t: list(x) for t, x in level.items()}
                    for t in unsafe:
                        new[t][i] = min(2, new[t][i] + 1)
                    options.append((sum(n for n in count(new).values() if n < k), sum(sum(new[r[:3]]) for r in rows), i, new))
            if not options:
                failed = True
                break
            level = min(options, key=lambda x: x[:3])[3]
        d = spark.createDataFrame(rows, "a string, b string, c string, n int")
        if failed:
            with pytest.raises(transforms.PrivacyViolation):
                transforms.generalize_locally(d, ["a", "b", "c"], h, k)
        else:
            assert {r["n"]: (r["a"], r["b"], r["c"]) for r in transforms.generalize_locally(d, ["a", "b", "c"], h, k).collect()} == {r[3]: show(r[:3], level[r[:3]]) for r in rows}


def test_microaggregation(spark):
    d = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 90.0), (4, 100.0)], "id long, age double")
    got = over(transforms.microaggregate("age", ["id"], 2, (15.0, 95.0), ["id"]), d)
    assert [r["age"] for r in got.orderBy("id").collect()] == [17.5, 17.5, 92.5, 92.5]


def test_inference(spark):
    rel = spark.createDataFrame([(20, "A", "x"), (40, "B", "y"), (60, "C", "y")], "age int, city string, condition string")
    ev = spark.createDataFrame([(21, "A", "x"), (39, "B", "y")], "age int, city string, condition string")
    got = attacks.infer_nearest(rel, ev, ["age"], ["city"], "condition").first().asDict()
    assert got["accuracy"] == 1.0 and got["baseline"] == 0.5 and got["risk"]
    got = one(spark, attacks.infer_exact(["age"], "condition"), rel, evaluation=spark.createDataFrame([(20, "x"), (41, "y")], "age int, condition string"))
    assert (got["inferred"], got["abstained"]) == (1, 1)


def test_singling_out(spark):
    d = spark.createDataFrame([(1, "10001", "30"), (2, "10002", "31")], "id long, zip string, age string")
    got = one(spark, attacks.singling_out(["zip", "age"], "id"), d)
    assert (got["predicates"], got["successes"], got["exposed"]) == (6, 6, 2)
    assert one(spark, attacks.singling_out(["zip", "age"], "id", 1), d)["predicates"] == 4


def test_linkability(spark):
    d = spark.createDataFrame([(1, 20, "A", 10), (2, 40, "B", 30), (3, 60, "C", 50)], "id long, age int, city string, income int")
    got = attacks.linkability(d, d, d, "id", ["age"], ["city"], ["income"], [], "id").first().asDict()
    assert got["links"] == 3 and got["rate"] == 1.0 and got["baseline"] == pytest.approx(1 / 3)


def test_graph_verdicts_of_common_clues(spark):
    """Equal sets, common clues, null ids, types and values: as by all pairs."""
    rng = random.Random(4)
    for size in (0, 6, 40):
        clues = [(rng.choice([None, *range(12)]), rng.choice([None, "a", "b"]), rng.choice([None, 0, 0, 0, 1, 2, 3])) for _ in range(2 * size)]
        s, i = (spark.createDataFrame(x, "id int, type string, value int") for x in (clues[:size], clues[size:]))
        same = [(x, "a", 9) for x in range(20, 50)] + [(x, "b", 9) for x in range(20, 40)] + [(20, "c", 1)]
        s, i = s.union(spark.createDataFrame(same, s.schema)), i.union(spark.createDataFrame([(x + 100, t, v) for x, t, v in same], s.schema))
        for least in (1, 2):
            got, want = (sorted(map(repr, d.collect())) for d in (graph.best_matches(s, i, least), over(graph.verdicts(least), s, identities=i)))
            assert got == want
    assert graph.best_matches(s, i, 2).where("subject = 20").first()["winners"] == 1


def moved_rows(spark):
    """Rows that stages so far have written for others."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_graph_pairs_are_not_moved(spark, monkeypatch):
    """Many ids that share many clues: rows are moved for clues and blocks, not for pairs; also with small blocks."""
    rng = random.Random(5)
    clues = [(x, t, rng.choice([0, 1, 2, 3, rng.randrange(200)])) for x in range(500) for t in "abcd" for _ in range(3)]
    s, i = (spark.createDataFrame([c for c in clues if c[0] % 2 == k], "id int, type string, value int") for k in (0, 1))
    pairs, best = ({tuple(r) for r in over(text, s, identities=i).collect()} for text in (graph.shared_clues(), graph.verdicts(2)))
    for block, most in ((2048, 30_000), (60, 60_000)):
        monkeypatch.setattr(graph, "BLOCK", block)
        for run, want in ((lambda: graph.all_shared_clues(s, i), pairs), (lambda: graph.best_matches(s, i, 2), best)):
            before = moved_rows(spark)
            got = run().collect()
            assert len(got) == len(want) and {tuple(r) for r in got} == want
            assert moved_rows(spark) - before < most < len(pairs)


def test_graph_in_blocks(spark, monkeypatch):
    """Null and repeated ids, unlike types of values, an empty side, ids in parts: as in SQL."""
    monkeypatch.setattr(graph, "CROWDED", -1)
    monkeypatch.setattr(graph, "BLOCK", 7)
    rng = random.Random(6)
    for size, part in ((0, 10), (1, 10), (40, 1000), (150, 10)):
        monkeypatch.setattr(graph, "PART", part)
        s = spark.createDataFrame([(rng.choice([None, *range(20)]), rng.choice([None, *"abc"]), rng.choice([None, 0, 0, 1, 2, 3])) for _ in range(size)], "id int, type string, value int")
        i = spark.createDataFrame([(rng.choice([None, *"tuvwxyz"]), rng.choice([None, *"abc"]), rng.choice([None, "0", "00", "1", "2"])) for _ in range(size)], "id string, type string, value string")
        for got, text in ((graph.all_shared_clues(s, i), graph.shared_clues()), (graph.best_matches(s, i, 1), graph.verdicts(1))):
            want = over(text, s, identities=i)
            assert got.columns == want.columns and [t for _, t in got.dtypes] == [t for _, t in want.dtypes]
            assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_graph_queries_in_blocks(spark, tmp_path, monkeypatch):
    """Both registered lists of pairs are made in blocks, and both lists of verdicts."""
    from umbra.plans.catalogue import QUERIES

    clues = [(i % 13, "tu"[i % 2], i * 7 % 11 + 0.5) for i in range(90)]
    spark.createDataFrame(clues, "user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(graph, "CROWDED", -1)
    asked = []
    monkeypatch.setattr(graph, "_in_blocks", lambda *a, of=graph._in_blocks: asked.append(1) or of(*a))
    for k, name in enumerate(("graph_shared_clues", "graph_verdicts")):
        one, other = (sorted(map(tuple, QUERIES[name + end](spark, str(tmp_path)).collect())) for end in ("", "_all"))
        assert one == other and one and len(asked) == 2 + 2 * k


def test_common_codes(monkeypatch):
    """Products and pairs of rare codes, each also cut, repeated codes of one side and codes of one side alone."""
    import numpy as np

    rng = np.random.default_rng(7)
    for columns, common, at_once in ((1024, 512, 1 << 19), (2, 5, 3), (3, 0, 7), (1024, 10**6, 1 << 19)):
        for name, value in (("COLUMNS", columns), ("COMMON", common), ("AT_ONCE", at_once)):
            monkeypatch.setattr(graph, name, value)
        for n in (0, 1, 300):
            s_code, i_code = (rng.geometric(0.2, n) * 10**12 + k for k in (0, rng.integers(2, size=n)))
            s_row, i_row = rng.integers(20, size=n), rng.integers(30, size=n)
            want = np.zeros((20, 30), np.int32)
            np.add.at(want, (s_row[:, None].repeat(n, 1), i_row[None].repeat(n, 0)), s_code[:, None] == i_code)
            assert (graph._common(s_row, s_code, i_row, i_code, (20, 30)) == want).all()


def test_graph(spark):
    s = spark.createDataFrame([("s1", "t", "1"), ("s1", "t", "2"), ("s2", "t", "3")], "id string, type string, value string")
    i = spark.createDataFrame([("i1", "t", "1"), ("i1", "t", "2"), ("i2", "t", "1")], "id string, type string, value string")
    got = {r["subject"]: (r["best_shared"], r["verdict"]) for r in over(graph.verdicts(2), s, identities=i).collect()}
    assert got == {"s1": (2, "inferred"), "s2": (0, "clear")}
    e = spark.createDataFrame([("s", "b1"), ("b1", "b2"), ("b2", "i"), ("b2", "b1")], "src string, dst string")
    got = {r["node"]: r["hops"] for r in graph.reachability(e, spark.createDataFrame([("s",)], "start string"), 5).collect()}
    assert got == {"b1": 1, "b2": 2, "i": 3}


def test_noise():
    draws = iter([3, 1, 0, 1])
    assert dp.noise(lambda n: next(draws)) == 2
    assert dp.noise(lambda n: 0) == 0
    for bad in (0.5, 101, True, float("nan")):
        with pytest.raises(Exception):
            dp.checked_epsilon(bad)


def test_counts_and_ledger(spark, tmp_path):
    d = frame(spark, "condition", [("A",), ("A",), ("B",)])
    q = [{"column": "condition", "equals": "A", "epsilon": 0.7}, {"column": "condition", "equals": "B", "epsilon": 0.7}]
    draws = iter([1, -3])
    assert dp.counts(d, q, 1.4, draw=lambda: next(draws)) == [3, 0]
    with pytest.raises(ValueError):
        dp.counts(d, q, 1.0)
    path = str(tmp_path / "ledger.json")
    assert dp.spend(path, "x", 1.4, 0.7, lambda: 1) == 1
    with pytest.raises(ZeroDivisionError):
        dp.spend(path, "x", 1.4, 0.7, lambda: 1 // 0)
    with pytest.raises(ValueError, match="exhausted"):
        dp.spend(path, "x", 1.4, 0.7, lambda: 1)


def test_histogram(spark):
    d = frame(spark, "region condition", [("urban", "A"), ("urban", "A"), ("rural", "B")])
    got = dp.histogram(d, {"region": ["urban", "rural"], "condition": ["A", "B"]}, 1, draw=lambda: 0)
    assert sorted(map(tuple, got.collect())) == [("rural", "B"), ("urban", "A"), ("urban", "A")]
    with pytest.raises(ValueError):
        dp.histogram(d, {"region": ["urban"], "condition": ["A", "B"]}, 1)


def test_queries_of_all_rows(spark, tmp_path):
    from collections import Counter

    from umbra.plans.catalogue import QUERIES

    people = [(i, float(i * 37 % 50), i % 3, "AB"[i % 2] if i else "C") for i in range(60)]
    spark.createDataFrame(people, "c_custkey long, c_acctbal double, c_nationkey int, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    clues = [(i % 13, "tu"[i % 2], i * 7 % 11 + 0.5) for i in range(90)]
    spark.createDataFrame(clues, "user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = QUERIES["linkability_all"](spark, str(tmp_path)).first()
    # the nearest row is a subject's own, unless another one is equal
    a, b = Counter(p[1:3] for p in people), Counter(p[2:] for p in people)
    assert (got["subjects"], got["links"]) == (60, sum(a[p[1:3]] == b[p[2:]] == 1 for p in people))
    held = {u: {(t, int(v)) for w, t, v in clues if w == u} for u in range(13)}
    pairs = {(s, i): len(held[s] & held[i]) for s in range(0, 13, 2) for i in range(1, 13, 2) if held[s] & held[i]}
    assert {(r["subject"], r["identity"]): r["shared"] for r in QUERIES["graph_shared_clues_all"](spark, str(tmp_path)).collect()} == pairs
    best = {s: max((n for (x, _), n in pairs.items() if x == s), default=0) for s in range(0, 13, 2)}
    assert {r["subject"]: r["best_shared"] for r in QUERIES["graph_verdicts_all"](spark, str(tmp_path)).collect()} == best


def test_histogram_of_large_cells(spark, monkeypatch):
    """A cell's rows come in stretches: counts, order of cells and empty cells are kept, no array holds a cell."""
    monkeypatch.setattr(dp, "ROWS", 1000)
    d = frame(spark, "a b", [("x", "1")] * 3 + [("y", "2")])
    draws = iter([25_000, 0, -5, 0, 12_345, 7])
    got = dp.histogram(d, {"a": ["x", "y"], "b": ["1", "2", "3"]}, 1, draw=lambda: next(draws))
    assert {(r["a"], r["b"]): r["count"] for r in got.groupBy("a", "b").count().collect()} == {("x", "1"): 25_003, ("y", "2"): 12_346, ("y", "3"): 7}
    assert dp.histogram(d.limit(0), {"a": ["x"]}, 1, draw=lambda: -1).count() == 0
