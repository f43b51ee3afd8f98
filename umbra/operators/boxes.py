"""Where literals stand on a page of recognised words: runs of words that spell a literal, and their box."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical(text: Column) -> Column:
    """Letters and digits alone, lower-cased."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))


def matching(words: DataFrame, literals: DataFrame, page: str = "page") -> DataFrame:
    """(page, rule_id, first, last, left, top, right, bottom): for each word that begins a literal, the shortest
    run of following words that spells it, whatever separates them, and the box around the run.

    words: page, position, text, left, top, width, height; literals: rule_id, value.  A run is found by where its
    words begin and end in the page's letters: literals join words by length and first letters, not each with each.
    Words without letters belong to a run if they stand before or within it.  Literals without letters and null
    texts match nothing; a page is one group, as large as what a page holds."""
    at = Window.partitionBy(page).orderBy("position")
    w = words.select(page, "position", canonical(F.coalesce("text", F.lit(""))).alias("word"), "left", "top", (F.col("left") + F.col("width")).alias("right"), (F.col("top") + F.col("height")).alias("bottom"))
    w = w.withColumn("ends", F.sum(F.length("word")).over(at).cast("int"))
    goals = literals.select("rule_id", canonical(F.col("value")).alias("goal")).where("goal <> ''").distinct()
    goals = goals.groupBy(F.substring("goal", 1, 1).alias("initial")).agg(F.collect_list(F.struct("rule_id", "goal")).alias("goals"))
    pages = w.groupBy(page).agg(F.array_sort(F.collect_list(F.struct("position", "word", "ends", "left", "top", "right", "bottom"))).alias("words"))
    pages = pages.withColumn("letters", F.array_join(F.col("words.word"), ""))
    starts = pages.select(page, "words", "letters", F.posexplode("words").alias("i", "first"))
    starts = starts.withColumn("begins", F.expr("first.ends - length(first.word)")).withColumn("initial", F.expr("substring(letters, begins + 1, 1)"))
    met = starts.join(goals, "initial").withColumn("goal", F.explode("goals")).where("startswith(substring(letters, begins + 1, length(goal.goal)), goal.goal)")
    met = met.withColumn("run", F.expr("filter(slice(words, i + 1, size(words)), x -> x.ends <= begins + length(goal.goal))"))
    met = met.withColumn("run", F.expr("slice(run, 1, array_position(transform(run, x -> x.ends), begins + length(goal.goal)))")).where("size(run) > 0")
    box = [f"{f}(run.{x}) as {x}" for f, x in (("array_min", "left"), ("array_min", "top"), ("array_max", "right"), ("array_max", "bottom"))]
    return met.selectExpr(page, "goal.rule_id as rule_id", "run[0].position as first", "run[size(run) - 1].position as last", *box)
