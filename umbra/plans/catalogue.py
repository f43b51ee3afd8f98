"""The query catalogue of the library's own operators, with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pseudonyms
from ..operators import attacks, boxes, costs, discovery, dp, graph, locations, matching, metrics, policy, population, residual, transforms
from .sql import over

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

QIS, SENSITIVE = ("c_nationkey", "c_mktsegment"), "c_mktsegment"
LINE = ("l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_discount", "l_tax")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(name: str, text: str, t: str, *, sql: str | None = None, **more: str) -> None:
    """A query whose text runs in both engines, unless DuckDB has its own (sql); t and more: relations as SQL
    over the tables."""
    relations = {"t": t} | more

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frames = {}
        for key, relation in relations.items():
            words = relation.replace("(", " ").replace(")", " ").split()
            tables = {x for x in words if x in _TABLES}
            frames[key] = over(f"SELECT * FROM {_spark_names(relation, tables)}", *[table(spark, sf_dir, x) for x in sorted(tables)[:1]], **{x: table(spark, sf_dir, x) for x in tables})
        return over(text, frames["t"], **{k: v for k, v in frames.items() if k != "t"})

    QUERIES[name] = run
    if name not in ORACLE_SQL:
        ORACLE_SQL[name] = (sql or text).format(**{k: v if " " not in v else f"{v}" for k, v in relations.items()})


_TABLES = {"region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"}


def _spark_names(relation: str, tables: set[str]) -> str:
    import re

    return re.sub(r"\b(" + "|".join(sorted(tables)) + r")\b(?!\.)", r"{\1} \1", relation)


# equivalence classes and metrics
_M = metrics.metrics(QIS[:1], SENSITIVE)
_sql("class_sizes", metrics.classes(QIS), "customer")
_sql("class_stats", metrics.class_stats(QIS), "customer")
_sql("residual_singletons", metrics.residual_singletons([*QIS, "c_acctbal"]), "customer")
_sql("privacy_metrics", metrics.metrics(QIS[:1], SENSITIVE), "customer")
_sql("privacy_metrics_lineitem", metrics.metrics(["l_linestatus", "l_linenumber"], "l_returnflag"), "lineitem")
for _name, _columns in {
    "k_anonymity": ["k_anonymity", "classes"],
    "l_diversity": ["l_diversity"],
    "entropy_l": ["minimum_entropy_nats", "entropy_effective_l", "entropy_l_diversity"],
    "alpha_k": ["alpha", "k_anonymity"],
    "beta_likeness": ["basic_beta"],
    "enhanced_beta": ["enhanced_beta"],
    "t_closeness_tv": ["t_closeness"],
    "delta_disclosure": ["delta_disclosure"],
    "sensitive_entropy": ["sensitive_entropy"],
    "avg_class_size": ["average_class_size"],
    "discernibility": ["discernibility"],
    "classification_metric": ["classification_metric"],
    "reid_risk": ["average_reid_risk", "maximum_reid_risk"],
}.items():
    _sql(_name, metrics.only(_columns, _M), "customer")
_sql("recursive_cl", metrics.recursive_cl(QIS[:1], SENSITIVE), "customer")
_plain = metrics.plain_number


def _emd(name: str, relation: str, qis: list[str], sensitive: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        source = relation.split(" FROM ")[-1].rstrip(")")
        df = over(f"SELECT * FROM {_spark_names(relation, {source})}", table(spark, sf_dir, source), **{source: table(spark, sf_dir, source)})
        return spark.createDataFrame([(metrics.numeric_emd(df, qis, sensitive),)], "numeric_emd double")

    QUERIES[name] = run
    ORACLE_SQL[name] = metrics.numeric_emd_plain(qis, sensitive, relation)


_emd("t_closeness_emd", "customer", ["c_mktsegment"], "c_acctbal")
_emd("t_closeness_emd_events", "(SELECT event_type, floor(value) AS value FROM events)", ["event_type"], "value")
_emd("t_closeness_emd_lineitem", "lineitem", ["l_suppkey", "l_linestatus"], "l_extendedprice")
_sql("qi_numeric_stats", metrics.column_stats("c_acctbal") + " UNION ALL " + metrics.column_stats("c_nationkey"), "customer",
     sql=metrics.column_stats("c_acctbal", as_number=_plain) + " UNION ALL " + metrics.column_stats("c_nationkey", as_number=_plain))
_ORDERS = "(SELECT c_nationkey, o_orderstatus, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey)"
_sql("multi_sensitive", metrics.multi_sensitive(["c_nationkey"], ["o_orderstatus", "o_orderpriority"]), _ORDERS)
_sql("multi_sensitive_conditioned", metrics.multi_sensitive(["c_nationkey"], ["o_orderstatus", "o_orderpriority"], True), _ORDERS)
_sql("suppression_utility", metrics.utility(["c_nationkey"], "c_mktsegment"), "(SELECT * FROM customer WHERE c_nationkey % 5 <> 0)", raw="customer")
# release and population
_RELEASE = "(SELECT * FROM customer WHERE c_custkey % 3 = 0)"
_sql("delta_presence", population.delta_presence(QIS), _RELEASE, population="customer")
_sql("k_map", population.k_map(QIS, 5), _RELEASE, population="customer")
_sql("population_reid", population.reidentification(QIS), _RELEASE, population="customer")
# transforms
_sql("suppress_small_classes", transforms.suppress_small_classes([*QIS], 12), "customer")
_sql("top_bottom_code", transforms.top_bottom_code({"c_acctbal": (0.0, 5000.0)}, ["c_custkey"]), "customer")
_MICRO = ("c_acctbal", ["c_custkey"], 5, (-500.0, 9000.0), ["c_custkey"])
_sql("microaggregate", transforms.microaggregate(*_MICRO), "customer", sql=transforms.microaggregate_plain(*_MICRO))
# attacks
_sql("singling_out", attacks.singling_out(LINE, "id"), "(SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag, l_linestatus, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem)")
_sql("singling_out_small", attacks.singling_out(QIS, "c_custkey", 1), "customer")
_EVEN, _ODD = "(SELECT * FROM customer WHERE c_custkey % 2 = 0)", "(SELECT * FROM customer WHERE c_custkey % 2 = 1)"
_sql("singling_out_control", attacks.against_control(attacks.singling_out(QIS, "c_custkey", t="{t}"), attacks.singling_out(QIS, "c_custkey", t="{control}")), _EVEN, control=_ODD)
# the nearest by space partition, in SQL by comparing all with all
_NN = (["c_acctbal"], ["c_nationkey"], "c_mktsegment")


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "customer")
    return d.where("c_custkey % 2 = 0"), d.where("c_custkey % 2 = 1")


def attr_inference_nn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attacks.infer_nearest(*_halves(spark, sf_dir), *_NN)


def attr_inference_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attacks.inference_groups(*_halves(spark, sf_dir), *_NN, "c_nationkey")


#: Parts by eight columns, two of them numbers.
_PARTS = "(SELECT p_partkey, p_size, p_retailprice, p_brand, p_type, p_partkey % 7 AS a, p_partkey % 11 AS b, substr(p_name, 1, 1) AS c, substr(p_type, 1, 3) AS d, p_brand || p_size AS label FROM part WHERE p_partkey % 2 = {})"
_WIDE = (["p_size", "p_retailprice"], ["p_brand", "p_type", "a", "b", "c", "d"], "label")


def attr_inference_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    halves = [over(f"SELECT * FROM {_spark_names(_PARTS.format(i), {'part'})}", table(spark, sf_dir, "part"), part=table(spark, sf_dir, "part")) for i in (0, 1)]
    return attacks.infer_nearest(*halves, *_WIDE)


QUERIES |= {f.__name__: f for f in (attr_inference_nn, attr_inference_groups, attr_inference_wide)}
ORACLE_SQL["attr_inference_nn"] = attacks.infer_nearest_plain(*_NN, t=_EVEN, evaluation=_ODD)
ORACLE_SQL["attr_inference_groups"] = attacks.inference_groups_plain(*_NN, "c_nationkey", t=_EVEN, evaluation=_ODD)
ORACLE_SQL["attr_inference_wide"] = attacks.infer_nearest_plain(*_WIDE, t=_PARTS.format(0), evaluation=_PARTS.format(1))
_BANDED = "(SELECT c_nationkey, floor(c_acctbal / 100) AS band, c_mktsegment FROM customer WHERE c_custkey % 2 = {})"
_sql("attr_inference_exact", attacks.infer_exact(["c_nationkey", "band"], "c_mktsegment"), _BANDED.format(0), evaluation=_BANDED.format(1))
# every customer in both views, and released: all of them, or the even ones against the odd ones as control
_VIEWS = ("c_custkey", ["c_acctbal"], ["c_nationkey"], [], ["c_mktsegment", "c_nationkey"], "c_custkey")


def linkability(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "customer")
    return attacks.linkability(d, d, d, *_VIEWS)


def linkability_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "customer")
    return attacks.against_control_rows(*[attacks.linkability(x, d, d, *_VIEWS) for x in _halves(spark, sf_dir)])


QUERIES |= {"linkability": linkability, "linkability_all": linkability, "linkability_control": linkability_control}
for _name in ("linkability", "linkability_all"):
    ORACLE_SQL[_name] = attacks.linkability_plain(*_VIEWS, t="customer", a="customer", b="customer")
ORACLE_SQL["linkability_control"] = attacks.against_control(*[attacks.linkability_plain(*_VIEWS, t=x, a="customer", b="customer") for x in (_EVEN, _ODD)])
# graph: every user a subject or an identity
_SUBJECTS, _IDENTITIES = (f"(SELECT user_id AS id, event_type AS type, cast(floor(value) AS BIGINT) AS value FROM events WHERE coalesce(user_id % 2, 0) {x} 0)" for x in ("=", "<>"))
for _end in ("", "_all"):
    _sql("graph_shared_clues" + _end, graph.shared_clues(), _SUBJECTS, identities=_IDENTITIES)
    _sql("graph_verdicts" + _end, graph.verdicts(2), _SUBJECTS, identities=_IDENTITIES)


def _clues(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    e = table(spark, sf_dir, "events")
    return [over(f"SELECT * FROM {_spark_names(x, {'events'})}", e, events=e) for x in (_SUBJECTS, _IDENTITIES)]


def graph_shared_clues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.all_shared_clues(*_clues(spark, sf_dir))


def graph_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.best_matches(*_clues(spark, sf_dir), 2)


# in SQL by all pairs
for _end in ("", "_all"):
    QUERIES |= {"graph_shared_clues" + _end: graph_shared_clues, "graph_verdicts" + _end: graph_verdicts}
_sql("wilson_calibration", graph.calibrated(3), "(SELECT l_linenumber AS shared, l_returnflag = 'R' AS reidentified FROM lineitem)")


def graph_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    edges = s.select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("n"), "s_nationkey").alias("dst")).union(n.select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey")))
    return graph.reachability(edges, s.select(F.concat(F.lit("s"), "s_suppkey").alias("start")), 3)


QUERIES["graph_reachability"] = graph_reachability
ORACLE_SQL["graph_reachability"] = """
WITH RECURSIVE e AS (SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
r AS (SELECT 's' || s_suppkey AS start, 's' || s_suppkey AS node, 0 AS hops FROM supplier
      UNION ALL SELECT r.start, e.dst, r.hops + 1 FROM r JOIN e ON r.node = e.src WHERE r.hops < 3)
SELECT start, node, CAST(min(hops) AS INT) AS hops FROM r WHERE hops > 0 GROUP BY start, node"""


# hierarchies: a nation, its region's number, everything
def _hierarchies(spark: SparkSession, sf_dir: str) -> dict:
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").collect()
    return {"nation": {str(r[0]): [f"region {r[1]}", "*"] for r in rows}, "segment": {s: ["*"] for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")}}


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("nation"), F.col("c_mktsegment").alias("segment"))


GLOBAL_K, GLOBAL_SHARE, LOCAL_K = 40, 0.05, 6


def generalize_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.global_levels(_people(spark, sf_dir), ["nation", "segment"], _hierarchies(spark, sf_dir), GLOBAL_K, GLOBAL_SHARE)


def generalize_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.generalize(_people(spark, sf_dir), ["nation", "segment"], _hierarchies(spark, sf_dir), GLOBAL_K, GLOBAL_SHARE)


def generalize_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.generalize_locally(_people(spark, sf_dir), ["nation", "segment"], _hierarchies(spark, sf_dir), LOCAL_K)


_LATTICE = f"""
WITH x AS (SELECT c_custkey, a, b, CASE a WHEN 0 THEN CAST(c_nationkey AS VARCHAR) WHEN 1 THEN 'region ' || n_regionkey ELSE '*' END AS nation,
                  CASE b WHEN 0 THEN c_mktsegment ELSE '*' END AS segment
           FROM customer JOIN nation ON c_nationkey = n_nationkey, range(0, 3) u(a), range(0, 2) w(b)),
c AS (SELECT a, b, nation, segment, count(*) AS n FROM x GROUP BY ALL),
l AS (SELECT a, b, sum(CASE WHEN n < {GLOBAL_K} THEN n ELSE 0 END) AS suppressed, sum(n) AS rows_n FROM c GROUP BY a, b),
best AS (SELECT * FROM l WHERE suppressed < rows_n AND suppressed <= {GLOBAL_SHARE} * rows_n ORDER BY suppressed, a + b, a, b LIMIT 1)
"""
QUERIES |= {f.__name__: f for f in (generalize_global, generalize_applied, generalize_local)}
ORACLE_SQL["generalize_global"] = _LATTICE + "SELECT CAST(suppressed AS BIGINT) AS suppressed, CAST(a AS INT) AS level_nation, CAST(b AS INT) AS level_segment FROM best"
ORACLE_SQL["generalize_applied"] = _LATTICE + f"SELECT c_custkey, x.nation, x.segment FROM x JOIN best USING (a, b) JOIN c ON c.a = x.a AND c.b = x.b AND c.nation = x.nation AND c.segment = x.segment WHERE c.n >= {GLOBAL_K}"


# literals
def _policy(spark: SparkSession, sf_dir: str, case_sensitive: bool = True) -> policy.Policy:
    names = [r[0] for r in table(spark, sf_dir, "nation").select("n_name").orderBy("n_name").collect()]
    return policy.compiled({"version": 1, "sensitive_values": [{"rule_id": f"nation-{n}", "type": "name", "value": n, "case_sensitive": case_sensitive} for n in names], "protected_values": []})


def mask_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, n = matching.replaced(F.col("note"), _policy(spark, sf_dir))
    return _notes(spark, sf_dir).select("s_suppkey", text.alias("masked"), n.cast("long").alias("replacements"))


def mask_case_insensitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, n = matching.replaced(F.lower("note"), _policy(spark, sf_dir, False))
    return _notes(spark, sf_dir).select("s_suppkey", text.alias("masked"), n.cast("long").alias("replacements"))


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.expr("s_nationkey = n_nationkey")).select("s_suppkey", F.format_string("from <%s> to <%s>, %s", "n_name", "n_name", "s_name").alias("note"))


def pseudonym_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    kinds = ("name", "email", "secret", "city")
    return n.select("n_nationkey", *[pseudonyms.pseudonym(F.lit(k), F.col("n_name"), 1).alias(f"as_{k}") for k in kinds])


def pseudonym_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mask_nations(spark, sf_dir)
    found = F.flatten(F.array(*[F.regexp_extract_all("masked", F.lit(p), F.lit(0)) for p in pseudonyms.LOOKALIKES]))
    return d.select(F.explode(found).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def residual_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _policy(spark, sf_dir)
    d = mask_nations(spark, sf_dir)
    return d.agg(F.coalesce(F.sum(F.size(matching.matches(F.col("masked"), p))), F.lit(0)).cast("long").alias("residual"))


def protected_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _notes(spark, sf_dir).select("note", matching.replaced(F.col("note"), _policy(spark, sf_dir))[0].alias("masked"))
    return d.agg(F.sum(matching.occurrences(F.col("note"), "from <")).alias("before"), F.sum(matching.occurrences(F.col("masked"), "from <")).alias("after"))


_NOTES = "(SELECT s_suppkey, n_name, s_name, 'from <' || n_name || '> to <' || n_name || '>, ' || s_name AS note, 'Person-' || substr(sha256('pseudonym-v1:trial-v1:1:name:nation-' || n_name || ':0'), 1, 10) AS token FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
QUERIES |= {f.__name__: f for f in (mask_nations, mask_case_insensitive, pseudonym_map, pseudonym_frequency, residual_literals, protected_parity)}
ORACLE_SQL |= {
    "mask_nations": f"SELECT s_suppkey, replace(note, n_name, token) AS masked, CAST(2 AS BIGINT) AS replacements FROM {_NOTES}",
    "mask_case_insensitive": f"SELECT s_suppkey, replace(lower(note), lower(n_name), token) AS masked, CAST(2 AS BIGINT) AS replacements FROM {_NOTES}",
    "pseudonym_map": "SELECT n_nationkey, " + ", ".join(f"'{a}' || substr(sha256('pseudonym-v1:trial-v1:1:{k}:' || n_name || ':0'), 1, 10) || '{b}' AS as_{k}" for k, a, b in (("name", "Person-", ""), ("email", "user-", "@example.invalid"), ("secret", "[REDACTED-", "]"), ("city", "anon-city-", ""))) + " FROM nation",
    "pseudonym_frequency": f"SELECT token, CAST(2 * count(*) AS BIGINT) AS n FROM {_NOTES} GROUP BY token",
    "residual_literals": "SELECT CAST(0 AS BIGINT) AS residual",
    "protected_parity": "SELECT count(*) AS before, count(*) AS after FROM supplier",
}


# what is left or lost where suppliers of a balance under 2,000 were not masked
def verify_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _half_masked(spark, sf_dir)
    return residual.locations(d.select("s_suppkey", F.col("masked").alias("note")), d.select("s_suppkey", "note"), ["s_suppkey"], ["note"])


def verify_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudonyms are cut to eight characters here, so that some nations share theirs."""
    p = _policy(spark, sf_dir)
    tokens = spark.createDataFrame([("name", value, token[:8]) for value, token in sorted(p.exact.items())], "type string, identity string, token string")
    d = _half_masked(spark, sf_dir)
    source = d.select(F.lit("name").alias("type"), F.explode(matching.matches(F.col("original"), p)).alias("identity"))
    output = d.select(F.explode(F.regexp_extract_all("note", F.lit(r"Person-[0-9a-f]"), F.lit(0))).alias("token"))
    return residual.subjects(tokens, source, output)


def leak_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [r[0] for r in table(spark, sf_dir, "nation").select("n_name").collect()]
    return residual.leaks(_half_masked(spark, sf_dir), "s_suppkey", ["note", "s_acctbal"], names)


def word_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each note as a page of words, ten units a character in one line."""
    w = _notes(spark, sf_dir).select(F.col("s_suppkey").alias("page"), F.posexplode(F.split("note", " ")).alias("position", "text"))
    w = w.withColumns({"left": F.col("position") * 100, "top": F.col("position") % 3, "width": F.length("text") * 10, "height": F.lit(12)})
    return boxes.matching(w, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("rule_id"), F.col("n_name").alias("value")))


def _half_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _notes(spark, sf_dir).join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), "s_suppkey")
    d = d.withColumn("masked", matching.replaced(F.col("note"), _policy(spark, sf_dir))[0])
    return d.select("s_suppkey", "s_acctbal", F.col("note").alias("original"), "masked", F.expr("if(s_acctbal < 2000, note, masked)").alias("note"))


QUERIES |= {f.__name__: f for f in (verify_locations, verify_subjects, leak_scan, word_boxes)}
_HALF = f"(SELECT x.*, s_acctbal, CASE WHEN s_acctbal < 2000 THEN note ELSE replace(note, n_name, token) END AS released FROM {_NOTES} x JOIN supplier USING (s_suppkey))"
ORACLE_SQL |= {
    "verify_locations": f"SELECT s_suppkey, 'differs:note' AS code FROM {_HALF} WHERE released <> replace(note, n_name, token)",
    "verify_subjects": """
WITH k AS (SELECT n_name, 'Person-' || substr(sha256('pseudonym-v1:trial-v1:1:name:nation-' || n_name || ':0'), 1, 1) AS token FROM nation),
shown AS (SELECT DISTINCT k.token FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN k USING (n_name) WHERE s_acctbal >= 2000)
SELECT 'name' AS type, n_name AS identity, 'shared-token' AS code FROM k WHERE token IN (SELECT token FROM k GROUP BY token HAVING count(*) > 1)
UNION SELECT 'name', n_name, 'token-missing' FROM k WHERE n_name IN (SELECT n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey) AND token NOT IN (SELECT token FROM shown)""",
    "leak_scan": f"SELECT s_suppkey, 'note' AS \"column\", n.n_name AS value FROM {_HALF} h JOIN nation n ON contains(h.released, n.n_name)",
    "word_boxes": f"""
WITH w AS (SELECT s_suppkey AS page, unnest(string_split(note, ' ')) AS word, generate_subscripts(string_split(note, ' '), 1) - 1 AS position FROM {_NOTES}),
b AS (SELECT page, position, lower(regexp_replace(word, '[^A-Za-z0-9]', '', 'g')) AS word, position * 100 AS l, position % 3 AS t, position * 100 + len(word) * 10 AS r, position % 3 + 12 AS u FROM w),
runs AS (SELECT x.page, x.position AS first, y.position AS last, string_agg(z.word, '' ORDER BY z.position) AS run, min(z.l) AS "left", min(z.t) AS top, max(z.r) AS "right", max(z.u) AS bottom
         FROM b x JOIN b y ON x.page = y.page AND x.position <= y.position JOIN b z ON z.page = x.page AND z.position BETWEEN x.position AND y.position GROUP BY ALL),
met AS (SELECT *, row_number() OVER (PARTITION BY page, first, n_nationkey ORDER BY last) AS k FROM runs JOIN nation ON run = lower(regexp_replace(n_name, '[^A-Za-z0-9]', '', 'g')))
SELECT page, n_nationkey AS rule_id, CAST(first AS INT) AS first, CAST(last AS INT) AS last, CAST("left" AS INT) AS "left", CAST(top AS INT) AS top, CAST("right" AS INT) AS "right", CAST(bottom AS INT) AS bottom FROM met WHERE k = 1""",
}


# values of JSON by location, and what three kinds of changes do to them
_CHANGED = "CASE event_id % 5 WHEN 0 THEN replace(props, '\"k\"', '\"m\"') WHEN 1 THEN regexp_replace(props, '([0-9]+)', '\"{}1\"') WHEN 2 THEN regexp_replace(props, '[0-9]+', '7') ELSE props END"


def json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locations.values(table(spark, sf_dir, "events"), ["event_id"], "props")


def json_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events")
    return locations.differences(d, d.withColumn("props", F.expr(_CHANGED.format("$"))), ["event_id"], "props")


def alias_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as suppliers' notes may misspell them: whole, without a letter, or with two letters swapped."""
    values = _notes_nations(spark, sf_dir).select(F.expr("CASE s_suppkey % 3 WHEN 0 THEN n_name WHEN 1 THEN concat(left(n_name, p), substr(n_name, p + 2)) ELSE concat(left(n_name, p), substr(n_name, p + 2, 1), substr(n_name, p + 1, 1), substr(n_name, p + 3)) END").alias("value"))
    return discovery.propose(values, _policy(spark, sf_dir, False), 85, 3)


def _notes_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.expr("s_nationkey = n_nationkey"))
    return d.withColumn("p", F.expr("cast(s_suppkey % char_length(n_name) as int)"))


QUERIES |= {f.__name__: f for f in (json_values, json_differences, alias_proposals)}
_EVENTS_JSON = "(SELECT event_id, p.key AS k, json_type(p.value) AS t, CAST(p.value AS VARCHAR) AS v FROM (SELECT event_id, unnest(json_keys(j)) AS key, j FROM (SELECT event_id, CAST({} AS JSON) AS j FROM events)) q, LATERAL (SELECT q.key AS key, json_extract(q.j, '$.' || q.key) AS value) p)"
_KIND = "CASE WHEN t IN ('UBIGINT', 'BIGINT') THEN 'integer' WHEN t = 'VARCHAR' THEN 'string' WHEN t = 'DOUBLE' THEN 'real' ELSE lower(t) END"
_ROWS = f"(SELECT event_id, '/' || k AS location, {_KIND} AS kind, trim(v, '\"') AS value FROM {_EVENTS_JSON})"
ORACLE_SQL["json_values"] = f"SELECT event_id, '' AS location, 'object' AS kind, NULL AS value FROM events UNION ALL SELECT event_id, location, kind, value FROM {_ROWS.format('props')}"
ORACLE_SQL["json_differences"] = f"""
SELECT coalesce(a.event_id, b.event_id) AS event_id, coalesce(a.location, b.location) AS location,
       CASE WHEN b.kind IS NULL THEN 'missing' WHEN a.kind IS NULL THEN 'extra' WHEN a.kind <> b.kind THEN 'type' ELSE 'value' END AS code, a.kind AS kind_before, b.kind AS kind_after
FROM {_ROWS.format('props')} a FULL JOIN {_ROWS.format(_CHANGED.format(chr(92)))} b ON a.event_id = b.event_id AND a.location = b.location
WHERE a.kind IS DISTINCT FROM b.kind OR a.value IS DISTINCT FROM b.value"""


# inventory of documents as files
def source_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.format_string("corpus/%08d.txt", "doc_id").alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"))


def manifest_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the sorted inventory, in two levels so that no task holds all of it: of each hundredth, then of these."""
    d = source_inventory(spark, sf_dir).withColumn("part", F.substring("path", 8, 6))
    entry = F.expr("array_join(transform(array_sort(collect_list(struct(path, sha256))), x -> concat(x.path, char(0), x.sha256, char(0))), '')")
    parts = d.groupBy("part").agg(F.sha2(entry, 256).alias("sha256"))
    return parts.agg(F.sha2(F.expr("array_join(transform(array_sort(collect_list(struct(part, sha256))), x -> concat(x.part, char(0), x.sha256, char(0))), '')"), 256).alias("digest"))


QUERIES |= {f.__name__: f for f in (source_inventory, manifest_digest)}
_INVENTORY = "(SELECT printf('corpus/%08d.txt', doc_id) AS path, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS bytes FROM documents)"
ORACLE_SQL["source_inventory"] = f"SELECT * FROM {_INVENTORY}"
ORACLE_SQL["manifest_digest"] = f"SELECT sha256(string_agg(part || chr(0) || d || chr(0), '' ORDER BY part)) AS digest FROM (SELECT substr(path, 8, 6) AS part, sha256(string_agg(path || chr(0) || sha256 || chr(0), '' ORDER BY path)) AS d FROM {_INVENTORY} GROUP BY part)"


# differential privacy, with noise 0 so that rows can be compared
def dp_counts_zero_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = [{"column": "o_orderstatus", "equals": s, "epsilon": 1} for s in ("F", "O", "P")]
    got = dp.counts(table(spark, sf_dir, "orders"), queries, 3, draw=lambda: 0)
    return spark.createDataFrame([(q["equals"], n) for q, n in zip(queries, got)], "status string, n long")


def dp_histogram_zero_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    domains = {"o_orderstatus": ["F", "O", "P"], "o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]}
    return dp.histogram(table(spark, sf_dir, "orders"), domains, 1, draw=lambda: 0)


QUERIES |= {f.__name__: f for f in (dp_counts_zero_noise, dp_histogram_zero_noise)}
ORACLE_SQL["dp_counts_zero_noise"] = "SELECT s AS status, (SELECT count(*) FROM orders WHERE o_orderstatus = s) AS n FROM (VALUES ('F'), ('O'), ('P')) v(s)"
ORACLE_SQL["dp_histogram_zero_noise"] = "SELECT o_orderstatus, o_orderpriority FROM orders"
_sql("cost_model", "SELECT n_nationkey, round(bytes / 2e7 / 200 / 3600 * 2 * 1.02, 9) AS hours FROM {t}", "(SELECT n_nationkey, (n_nationkey + 1) * 1e12 AS bytes FROM nation)")

_sql("cost_estimates", costs.estimate("n_nationkey"), "(SELECT n_nationkey, n_nationkey * 1e12 + 3.7e11 AS bytes FROM nation)")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["privacy_metrics"](spark, sf_dir)
