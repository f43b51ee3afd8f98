"""Typed values by location and where documents differ."""

from umbra.operators import locations


def test_located():
    text = '{"a": [1, "1", true, 1.0, {}], "b/c~d": null, "e": {"f": []}, "": 12345678901234567890123}'
    assert list(locations.located(text)) == [
        ("", "object", None), ("/a", "array", None), ("/a/0", "integer", "1"), ("/a/1", "string", "1"), ("/a/2", "boolean", "true"), ("/a/3", "real", "1.0"), ("/a/4", "object", None),
        ("/b~1c~0d", "null", None), ("/e", "object", None), ("/e/f", "array", None), ("/", "integer", "12345678901234567890123")]
    for bad in ("", "{", '{"a": 1, "a": 1}', "NaN", "1e999", "[" * 100_000):
        assert list(locations.located(bad)) == [("", "unreadable", None)]


def test_differences(spark):
    kinds = "location long, code string, text string"
    a = spark.createDataFrame([(1, "x", '{"a": 1, "b": [1, 2]}'), (2, None, '{"a": true}'), (3, "x", None), (4, "x", '"s"'), (5, "x", "[1]")], kinds)
    b = spark.createDataFrame([(1, "x", '{"b": [1, "2", 3], "a": 1.0}'), (2, None, '{"a": true}'), (3, "x", "null"), (4, "x", '"t"'), (5, "x", "[1")], kinds)
    keys = ["location", "code"]
    d = locations.differences(a, b, keys, "text").toDF("k", "l", "at", "what", "before", "after")
    assert sorted(map(tuple, d.collect()), key=repr) == sorted([
        (1, "x", "/a", "type", "integer", "real"), (1, "x", "/b/1", "type", "integer", "string"), (1, "x", "/b/2", "extra", None, "integer"), (3, "x", "", "extra", None, "null"),
        (4, "x", "", "value", "string", "string"), (5, "x", "", "type", "array", "unreadable"), (5, "x", "/0", "missing", "integer", None)], key=repr)
    assert locations.differences(a.limit(0), b.limit(0), keys, "text").count() == 0
