"""Spellings of names typed by people that mean the same sponsor, by trie joins over the names' own words.

Names are taken apart first (kind of house, own word, legal form; a person's names). The own words are joined within a
bounded number of edits per kind. Each spelling group then points to the best group it can be a misspelling of; groups
that end at the same root are the same sponsor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from larkspur.llm.names import GIVEN, INITIALS, KINDS, parsed
from larkspur.llm.tries import edit_join
from larkspur.session import checkpoint_ready

KEY = ["class", "core", "legal", "given", "middle"]


def _called(given: Column) -> Column:
    """What a person's given name may be matched by: the full name, and the initials that may stand for it."""
    usual = F.create_map(*[F.lit(x) for k in GIVEN for x in (k, ",".join(sorted(INITIALS[k])))])
    initials = F.split(F.coalesce(F.try_element_at(usual, given), F.substring(given, 1, 1)), ",")
    return F.when(F.length(given) > 1, F.concat(F.array(given), F.transform(initials, lambda x: F.concat(F.lit("i:"), x)))).otherwise(F.array(F.concat(F.lit("i:"), given)))


def spellings(names: DataFrame, column: str) -> DataFrame:
    """``(name, n, class, core, legal, given, middle, clean, careful, group_id)`` of each distinct name with a word of its own."""
    distinct = names.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("name")).agg(F.count("*").alias("n"))
    # Few long strings and costly to parse: spread over all tasks, whatever the size of the scan.
    spread = distinct.repartition(F.xxhash64("name"))
    return spread.withColumn("p", parsed("name")).select("name", "n", "p.*").where("core is not null").withColumn("group_id", F.xxhash64(*KEY))


def candidates(groups: DataFrame) -> DataFrame:
    """Pairs of groups whose own words are within the edit bound and whose other parts don't contradict each other.

    A name without a kind may be any business, but no house or person. Legal forms and middle initials agree if equal or
    missing; given names also if one is a fitting initial.
    """
    index = groups.select(F.col("class").alias("shard"), F.col("core").alias("key"))
    bare = groups.where("class = ''").select(F.explode(F.array(*map(F.lit, KINDS))).alias("shard"), F.col("core").alias("query"))
    near = edit_join(index, index.withColumnRenamed("key", "query").unionByName(bare))
    named = groups.select(*[F.col(c) for c in (*KEY, "group_id", "clean", "careful", "n")])
    named = named.withColumn("called", F.explode(F.when(F.col("class") == "person", _called(F.col("given"))).otherwise(F.array(F.lit("")))))
    a, b = (named.select(*[F.col(c).alias(f"{s}_{c}") for c in named.columns]) for s in "ab")
    # People of one surname meet by what they may be called, so that a common surname is no group of all its pairs.
    same = near.join(b, (F.col("shard") == F.col("b_class")) & (F.col("key") == F.col("b_core")))
    same = same.join(a, (F.col("query") == F.col("a_core")) & (F.col("a_called") == F.col("b_called")) & ((F.col("shard") == F.col("a_class")) | (F.col("a_class") == "")))
    free = lambda x: (F.col(f"a_{x}") == F.col(f"b_{x}")) | (F.col(f"a_{x}") == "") | (F.col(f"b_{x}") == "")
    fits = same.where("a_group_id <> b_group_id").where((F.col("a_class") == F.col("b_class")) | F.col("a_class").eqNullSafe(""))
    # Two full given names must be equal; an initial only stands where one side has no more.
    full = (F.length("a_given") > 1) & (F.length("b_given") > 1)
    fits = fits.where(free("legal") & free("middle")).where(~full | (F.col("a_given") == F.col("b_given")))
    return fits.drop("a_called", "b_called").dropDuplicates(["a_group_id", "b_group_id"])


def parents(pairs: DataFrame) -> DataFrame:
    """``(group_id, parent)``: the best group that each group can be a misspelling of.

    A parent ranks higher: well written and complete, more of its parts named, more rows. Two organisations that are both well
    written, with as many parts, are mostly different sponsors: they only join by one edit that isn't a plain
    substitution; in words of nine letters or more by any one edit, or two that aren't. A name that lacks a part (kind, given or middle name) gets no parent where equally good ones differ.
    """
    full = lambda s: (F.col(f"{s}_class") != "").cast("int") + (F.col(f"{s}_legal") != "").cast("int") + (F.length(f"{s}_given") > 1).cast("int") + (F.col(f"{s}_middle") != "").cast("int")
    rank = lambda s: F.struct(F.col(f"{s}_clean"), full(s), F.col(f"{s}_n"), F.col(f"{s}_group_id"))
    above = pairs.where(rank("b") > rank("a"))
    swapped = (F.length("a_core") == F.length("b_core")) & (F.array_sort(F.split("a_core", "")) == F.array_sort(F.split("b_core", "")))
    # Long words are rarely close by chance: they may have two such edits, or one of any kind.
    long = F.least(F.length("a_core"), F.length("b_core")) >= 9
    moved = (F.length("a_core") != F.length("b_core")) | swapped
    typo = ((F.col("edits") == 1) & (moved | long)) | (long & moved)
    alike = (F.col("a_class") == F.col("b_class")) & ((F.col("a_legal") == "") == (F.col("b_legal") == ""))
    careful = F.col("a_careful") & F.col("b_careful") & alike
    above = above.where((F.col("b_class") == "person") | (F.col("edits") == 0) | ~careful | typo)
    lacking = (F.col("a_class") == "") | ((F.col("b_class") == "person") & ((F.col("a_middle") == "") | (F.length("a_given") <= 1)))
    goodness = F.struct(F.col("b_clean").cast("int").alias("c"), (-F.col("edits")).alias("e"), (F.col("a_legal") == F.col("b_legal")).cast("int").alias("l"))
    who = F.struct("b_class", F.when(F.col("b_class") == "person", F.struct("b_given", "b_middle")))
    w = W.partitionBy("a_group_id").orderBy(goodness.desc(), F.desc("b_n"), "b_group_id")
    best = above.select("a_group_id", "b_group_id", lacking.alias("lacking"), goodness.alias("g"), who.alias("who"), F.row_number().over(w).alias("place"))
    first = best.where("place = 1").select("a_group_id", "b_group_id", "lacking", F.col("g").alias("g1"), F.col("who").alias("who1"))
    rivals = best.join(first.where("lacking").select("a_group_id", "g1", "who1"), "a_group_id").where((F.col("g") == F.col("g1")) & (F.col("who") != F.col("who1")))
    return first.join(rivals.select("a_group_id").distinct(), "a_group_id", "left_anti").select(F.col("a_group_id").alias("group_id"), F.col("b_group_id").alias("parent"))


def roots(groups: DataFrame, parent: DataFrame) -> DataFrame:
    """``(group_id, root)``: parents of parents, doubled until no root changes, so that chains of any length are followed.

    A parent ranks above its child, so there are no cycles. Each round is checkpointed; their number is the logarithm of
    the longest chain.
    """
    at = groups.select("group_id").join(parent, "group_id", "left").select("group_id", F.coalesce("parent", "group_id").alias("root")).checkpoint()
    while True:
        up = at.select(F.col("group_id").alias("root"), F.col("root").alias("up"))
        moved = at.join(up, "root").select("group_id", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved")).checkpoint()
        at = moved.drop("moved")
        if not moved.where("moved").limit(1).count():
            return at


def clusters(names: DataFrame, column: str) -> DataFrame:
    """``(name, cluster)`` for each distinct name with a word of its own; null and blank names have none.

    Repeated rows only count as evidence of how usual a spelling is. The parsed names, the candidate pairs and the
    parents are checkpointed, since the later steps use them several times.
    """
    checkpoint_ready(names.sparkSession)
    spelled = spellings(names, column).checkpoint()
    groups = spelled.groupBy("group_id", *KEY).agg(F.sum("n").alias("n"), F.max("clean").alias("clean"), F.max("careful").alias("careful"))
    at = roots(groups.select("group_id").checkpoint(), parents(candidates(groups).checkpoint()).checkpoint())
    return spelled.select("name", "group_id").join(at, "group_id").select("name", F.col("root").alias("cluster"))


def variant_pairs(names: DataFrame, column: str) -> DataFrame:
    """``(name_a, name_b)``, ``name_a < name_b`` by code point: different strings, as stored, that mean the same sponsor.

    Every pair of spellings of one sponsor is a row; their number follows from how many spellings a sponsor has, not from
    how many rows bear them.
    """
    c = clusters(names, column)
    a, b = c.withColumnRenamed("name", "name_a"), c.withColumnRenamed("name", "name_b")
    return a.join(b, "cluster").where("name_a < name_b").select("name_a", "name_b")
