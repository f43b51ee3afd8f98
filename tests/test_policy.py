import random

import pytest
from pyspark.sql import functions as F

from umbra.functions import pseudonyms
from umbra.operators import matching, policy


def make(*rules, protected=()):
    return policy.compiled({"version": 1, "sensitive_values": [{"rule_id": f"r{i:04d}", "type": "name", "value": v, "case_sensitive": cs} for i, (v, cs) in enumerate(rules)], "protected_values": [{"value": p} for p in protected]})


def test_golden(spark):
    assert pseudonyms.allocated([("name", "person-a"), ("name", "person-b")], 1) == {("name", "person-a"): "Person-390cb11ced", ("name", "person-b"): "Person-7583e1fc7d"}
    got = spark.range(1).select(pseudonyms.pseudonym(F.lit("name"), F.lit("person-a"), 1).alias("x")).first()[0]
    assert got == "Person-390cb11ced"
    with pytest.raises(pseudonyms.NamespaceExhausted):
        pseudonyms.allocated([("ip_address", str(i)) for i in range(254)], 1)


def test_rejects():
    with pytest.raises(policy.PolicyError):
        make(("Bob", True), protected=["Bobby"])
    with pytest.raises(policy.PolicyError):
        make(("ada", False), ("ADA", False))
    with pytest.raises(policy.PolicyError):
        policy.compiled({"version": True, "sensitive_values": [], "protected_values": []})


def plain(text, p):
    words = sorted([(w, False, r) for w, r in p.exact.items()] + [(w, True, r) for w, r in p.folded.items()], key=lambda x: (-len(x[0]), x[1]))
    out, i, n = [], 0, 0
    while i < len(text):
        for w, fold, r in words:
            part = text[i : i + len(w)]
            if (policy.ascii_lower(part) if fold else part) == w:
                out.append(r)
                i += len(w)
                n += 1
                break
        else:
            out.append(text[i])
            i += 1
    return "".join(out), n


def test_longest_first_without_cascade(spark):
    p = make(("ab", True), ("abc", True), ("bcd", True), ("Cd", False), ("a.b*", True))
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdABCD.* é") for _ in range(rng.randint(0, 30))) for _ in range(400)]
    text, n = matching.replaced(F.col("t"), p)
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", text.alias("x"), n.alias("n")).collect()
    assert {r["i"]: (r["x"], r["n"]) for r in got} == {i: plain(t, p) for i, t in enumerate(texts)}


def test_many_literals(spark):
    p = make(*[(f"name {i} x", True) for i in range(2000)])
    text, n = matching.replaced(F.lit("a name 17 x and name 1999 x"), p)
    got = spark.range(1).select(text.alias("x"), n.alias("n")).first()
    assert got["n"] == 2 and "name" not in got["x"]


def test_numeric_alias(spark):
    p = make(("555-123-4567", True))
    text, n = matching.replaced(F.lit("5551234567 and 555-123-4567"), p)
    assert spark.range(1).select(n).first()[0] == 2
