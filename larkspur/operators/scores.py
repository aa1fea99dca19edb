"""Answers compared with independently computed truth, as sets per question."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

#: Items shown of those missed and those in excess.
SHOWN = 6


def set_scores(system: DataFrame, truth: DataFrame, questions: DataFrame) -> DataFrame:
    """Per question: sizes, precision, recall, exact match, and the first missed and extra items in order.

    system and truth: ``question, item``; repeated rows count once. Rows without question or item don't count. An empty
    answer has precision 1 if the truth is empty too, else 0; an empty truth has recall 1. Every row of ``questions`` gets
    a result.
    """
    side = lambda df, s, t: df.select("question", "item", F.lit(s).alias("s"), F.lit(t).alias("t"))
    marks = side(system, True, False).unionByName(side(truth, False, True)).where("question is not null and item is not null")
    return marked_scores(marks.groupBy("question", "item").agg(F.max("s").alias("s"), F.max("t").alias("t")), questions)


def marked_scores(marks: DataFrame, questions: DataFrame) -> DataFrame:
    """``set_scores`` from ``(question, item, s, t)``: one row per item, with whether the system names it and whether it is true.

    Counts and the items shown are two small aggregates of ``marks``: per task, a row of sums and the ``SHOWN`` smallest
    items of each kind are all that is shuffled, so that an item list never grows with the sets.
    """
    sums = marks.groupBy("question").agg(F.count_if("s").alias("answered"), F.count_if("t").alias("wanted"), F.count_if(F.col("s") & F.col("t")).alias("hits"))
    wrong = marks.where(F.col("s") != F.col("t")).select("question", F.when(F.col("t"), "missed").otherwise("extra").alias("kind"), "item")
    few = wrong.withColumn("n", F.row_number().over(W.partitionBy("question", "kind").orderBy("item"))).where(F.col("n") <= SHOWN)
    lists = few.groupBy("question").agg(*[F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("item")))), ",").alias(k) for k in ("missed", "extra")])
    per = questions.select("question").distinct().join(sums, "question", "left").join(lists, "question", "left")
    per = per.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("answered", "wanted", "hits")} | {c: F.coalesce(c, F.lit("")) for c in ("missed", "extra")})
    precision = F.when(F.col("answered") == 0, (F.col("wanted") == 0).cast("double")).otherwise(F.try_divide(F.col("hits").cast("double"), F.col("answered")))
    recall = F.when(F.col("wanted") == 0, 1.0).otherwise(F.try_divide(F.col("hits").cast("double"), F.col("wanted")))
    exact = (F.col("answered") == F.col("wanted")) & (F.col("hits") == F.col("wanted"))
    return per.select("question", "answered", "wanted", "hits", precision.alias("precision"), recall.alias("recall"), exact.alias("exact"), "missed", "extra")


def mean_scores(scores: DataFrame) -> DataFrame:
    """Means over questions of precision, recall and exact match."""
    return scores.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg(F.col("exact").cast("double")).alias("exact"))


def refusal_rate(plans: DataFrame) -> DataFrame:
    """Share of plans whose intent is ``refuse``; null intents count as other."""
    return plans.agg(F.avg((F.coalesce("intent", F.lit("")) == "refuse").cast("double")).alias("rate"))
