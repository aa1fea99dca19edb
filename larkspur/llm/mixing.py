"""Mixing sources to target shares of tokens, with a soft membership of documents in sources.

A classifier fitted on the documents whose source is known gives every other document a posterior over the sources.
Nonnegative drawing rates per document are then fitted by projected-gradient least squares, so that the expected tokens of
each source meet its target. Documents of a known source share a rate, so they are summed up first and are one row per
source then. Rates are a column; each step of the descent is one aggregation of as many sums as there are sources, until
the sums meet their targets.
"""

from __future__ import annotations

import base64
import os
import warnings
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F, types as T

from larkspur.session import checkpoint_ready, spread

#: Where the vocabulary file is on the driver's machine; it is sent to the tasks from there.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The splitting pattern that belongs to that vocabulary; a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The classifier is fitted on at most about this many labelled documents, chosen per class by a hash of their id.
FIT_ROWS = 20_000
HASH_PLACES = 10**15
HASHED_WORDS = 4_096
#: The part of the total that every miss must stay below. After so many steps without that the total is lowered to the next
#: part of itself, since documents between two sources can rule the largest one out; and rounds of this at most.
TOLERANCE, STEPS, LOWER, ROUNDS = 1e-4, 16, 0.95, 40
#: Draws are thrown into so many equal slots per source, and cut where the wanted tokens are reached.
SLOTS = 4_096


def source_key(c: Column) -> Column:
    """A source in one way of writing: lower case, runs of other characters one underscore; blank is null."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit(""))


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(doc_id, source, text, tokens)`` with the tokens of the whole text under a public vocabulary."""

    documents.sparkSession.sparkContext.addFile(tokenizer)
    file = os.path.basename(tokenizer)

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoding(SparkFiles.get(file))
        for texts in batches:
            yield texts.map(lambda t: len(encoding.encode_ordinary(t))).astype("int64")

    counter = F.pandas_udf(count, T.LongType())
    named = spread(documents.select("doc_id", "source", "text")).where("doc_id is not null and text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), source_key(F.col("source")).alias("source"), "text")
    return named.withColumn("tokens", counter("text"))


def memberships(counted: DataFrame, names: list[str]) -> DataFrame:
    """``(doc_id, source, tokens, p)``: p is the share of the document that each of ``names`` owns, in their order.

    A document whose source is known belongs to it wholly (to none of ``names``, if it is another source). For the others
    a multinomial logistic model over hashed words, fitted on documents with a known source, gives the posterior. Its
    classes are ``names`` and one for all other sources; what it gives to that one is lost to them. The fit takes all
    documents of small classes and a sample of large ones, weighted to the number of documents it stands for.
    """
    known = counted.where("source is not null")
    at = F.array_position(F.array(*map(F.lit, names)).cast("array<string>"), F.col("source")).cast("int")
    number = F.when(at > 0, at - 1).otherwise(F.lit(len(names)))
    # One row per wanted source and one for the rest.
    sizes = {r["c"]: r["n"] for r in known.groupBy(number.alias("c")).agg(F.count("*").alias("n")).collect()}
    classes = sorted(sizes)
    one_hot = F.array(*[(F.col("source") == n).cast("double") for n in names])
    own = known.select("doc_id", "source", "tokens", one_hot.alias("p"))
    unknown = counted.where("source is null")
    if len(classes) < 2:
        share = [float(classes == [i]) for i in range(len(names))]
        return own.unionByName(unknown.select("doc_id", "source", "tokens", F.array(*map(F.lit, share)).alias("p")))
    parts = _fit_parts(sizes)
    of = lambda value: F.get(F.array(*[F.lit(value(c) if c in classes else None) for c in range(len(names) + 1)]), F.col("class"))
    place = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(HASH_PLACES))
    some = known.withColumn("class", number).where(place < of(lambda c: int(parts[c] * HASH_PLACES)))
    some = some.withColumns({"label": of(lambda c: float(classes.index(c))), "weight": of(lambda c: 1.0 / parts[c])})
    split = RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[^\p{L}]+")
    hashed = HashingTF(inputCol="words", outputCol="features", numFeatures=HASHED_WORDS, binary=True)
    featured = lambda df: hashed.transform(split.transform(df))
    training = featured(some).select("label", "weight", "features").persist()
    model = LogisticRegression(maxIter=20, regParam=0.001, elasticNetParam=0.0, family="multinomial", weightCol="weight").fit(training)
    training.unpersist()
    guessed = model.transform(featured(unknown))
    probability = vector_to_array("probability")
    # The model may have seen fewer classes than there are sources.
    at = {c: i for i, c in enumerate(classes) if i < model.numClasses}
    places = F.array(*[F.lit(at.get(i, -1)) for i in range(len(names))]).cast("array<int>")
    p = F.transform(places, lambda k: F.when(k >= 0, F.get("probabilities", k)).otherwise(0.0))
    return own.unionByName(guessed.withColumn("probabilities", probability).select("doc_id", "source", "tokens", p.alias("p")))


def _fit_parts(sizes: dict[int, int]) -> dict[int, float]:
    """The share of each class that the fit takes: small classes wholly, the rest of ``FIT_ROWS`` evenly by large ones."""
    parts, left = {}, FIT_ROWS
    for k, (c, n) in enumerate(sorted(sizes.items(), key=lambda x: x[1])):
        take = min(n, max(1, left // (len(sizes) - k)))
        parts[c], left = take / n, left - take
    return parts


@dataclass
class Mix:
    """``residual``: the largest miss of a source's expected tokens under the fitted rates, as a part of all tokens wanted;
    ``steps``: how many steps the descent took."""

    draws: DataFrame
    targets: list[dict]
    residual: float = 0.0
    steps: int = 0

    def shares(self) -> DataFrame:
        """One row per wanted source: tokens there are and tokens drawn (by label, and expected under the posteriors),
        actual shares, and the highest number of copies of a document of that source."""
        names = [t["source"] for t in self.targets]
        spark = self.draws.sparkSession
        sums = [F.sum(F.col("p")[i] * F.col("tokens") * F.col("copies")).alias(f"e{i}") for i in range(len(names))]
        expected = self.draws.agg(*sums, F.sum(F.col("tokens") * F.col("copies")).alias("total"))
        rows = spark.createDataFrame([(i, t["source"], float(t["weight"]), float(t["aim"])) for i, t in enumerate(self.targets)], "i int, source string, target_weight double, aimed_share double")
        by = self.draws.groupBy("source").agg(F.sum("tokens").alias("available"), F.sum(F.col("tokens") * F.col("copies")).alias("drawn"), F.max("copies").alias("most_copies"))
        both = rows.join(by, "source", "left").withColumn("all", expected.select(F.struct("*")).scalar()).select("*", "all.*")
        mine = F.coalesce(*[F.when(F.col("i") == i, F.col(f"e{i}")) for i in range(len(names))]) if names else F.lit(0.0)
        ratio = lambda x: F.round(F.coalesce(F.try_divide(x, F.col("total")), F.lit(0.0)), 6)
        return both.select(
            "source", "target_weight", F.round("aimed_share", 6).alias("aimed_share"), F.coalesce("available", F.lit(0)).alias("tokens_available"),
            F.coalesce("drawn", F.lit(0)).alias("tokens_drawn"), ratio(F.coalesce("drawn", F.lit(0))).alias("labelled_share"), ratio(mine).alias("expected_share"),
            F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        )


def mix(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, seed: int = 0) -> Mix:
    """Draw documents so that each wanted source gets its share of all tokens drawn.

    ``draws`` has one row per document with a text: ``(doc_id, source, tokens, p, rate, copies)``. A document's rate lies
    between 0 and the repeats that its sources allow, on the average of its posterior (part of a copy, too) and at most
    those of its most probable wanted source; its copies are the whole part of the rate plus, for the
    share of documents that the rest asks for, one more, decided by a hash of the id. The total is the largest at which every source can still meet
    its share under its cap, in steps of ``LOWER`` where documents between sources rule the largest one out. Wanted sources without any document get nothing and the others share their weight; sources
    that are not wanted are never drawn. Sources written differently are one; of repeated target rows the largest weight
    counts; targets without source, or without a positive weight, don't count. Null ids, null and empty texts give no row.
    """
    checkpoint_ready(documents.sparkSession)
    wanted = targets.select(source_key(F.col("source")).alias("source"), "target_weight", "max_repeats").where("source is not null and target_weight > 0 and max_repeats > 0")
    # One row per source: a few, by the nature of a mixture.
    rows = wanted.groupBy("source").agg(F.max("target_weight").alias("weight"), F.max("max_repeats").alias("cap")).orderBy("source").collect()
    names = [r["source"] for r in rows]
    caps = np.array([float(r["cap"]) for r in rows])
    docs = memberships(token_counts(documents, tokenizer), names)
    most = sum((F.col("p")[i] * float(c) for i, c in enumerate(caps)), F.lit(0.0))
    # A rate of at most so many whole copies, so that no draw exceeds them.
    likely = [F.when(F.col("p")[i] == F.array_max("p"), F.lit(float(c))) for i, c in enumerate(caps)]
    docs = docs.withColumn("cap", F.least(most, F.coalesce(*likely, F.lit(0.0)))).checkpoint()
    weight = np.array([r["weight"] for r in rows], float)
    # All documents of a known source have one membership and cap, so they are one row here.
    shared = docs.where("source is not null").groupBy("p", "cap").agg(F.sum("tokens").alias("tokens"))
    fitted = shared.unionByName(docs.where("source is null").select("p", "cap", "tokens")).withColumn("rate", F.least(F.lit(1.0), F.col("cap"))).withColumn("last", F.col("rate")).checkpoint()
    each = lambda of, n: [F.sum(F.col("p")[i] * F.col("tokens") * of).alias(f"{n}{i}") for i in range(len(names))]
    sums = lambda df, *of: np.array([x or 0.0 for x in df.agg(*[c for k, o in enumerate(of) for c in each(o, f"s{k}_")]).first()]).reshape(len(of), -1) if names else np.zeros((len(of), 0))
    mass, reach = sums(fitted, F.lit(1.0), F.col("cap"))
    there = reach > 0
    aim = np.where(there, weight, 0.0) / max(weight[there].sum(), 1e-12) if len(rows) else weight
    total = float((reach[there] / aim[there]).min()) if there.any() else 0.0
    steps: list[tuple[float, list[float]]] = []
    residual, beta, speed = 0.0, 0.0, 1.0
    while names:
        fitted = fitted.withColumn("ahead", _ahead(F.col("rate"), F.col("last"), beta))
        drawn = sums(fitted, F.col("ahead"))[0]
        residual = float(np.abs(drawn - aim * total).max()) / max(total, 1.0)
        if residual <= TOLERANCE or len(steps) == STEPS * ROUNDS:
            break
        if len(steps) % STEPS == STEPS - 1:
            total, speed, fitted = total * LOWER, 1.0, fitted.checkpoint()
        steps.append((beta, [float(x) for x in np.where(mass > 0, (drawn - aim * total) / np.maximum(mass, 1e-12), 0.0)]))
        fitted = fitted.select("p", "cap", "tokens", _stepped("ahead", F.array(*map(F.lit, steps[-1][1]))).alias("rate"), F.col("rate").alias("last"))
        # A step that follows a lowered total starts without a last move; others go on along it, further each time.
        before, speed = speed, (1 + (1 + 4 * speed * speed) ** 0.5) / 2
        beta = (before - 1) / speed
    if residual > TOLERANCE:
        warnings.warn(f"rates miss a source's target by {residual:.2g} of all tokens after {len(steps)} steps", stacklevel=2)
    rate = _rate(steps, beta) if names else F.lit(0.0)
    slot = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(SLOTS)).cast("int")
    rated = docs.withColumn("rate", rate).withColumns({"slot": slot, "rest": F.col("rate") - F.floor("rate")})
    cut = _cuts(rated.where(F.col("source").isin(names)))
    copies = F.floor("rate") + (F.col("slot") < F.coalesce(cut, F.col("rest") * SLOTS)).cast("long")
    draws = rated.select("doc_id", "source", "tokens", "p", F.round("rate", 9).alias("rate"), copies.cast("int").alias("copies"))
    return Mix(draws, [{"source": r["source"], "weight": r["weight"], "aim": a} for r, a in zip(rows, aim, strict=True)], residual, len(steps))


def _cuts(rated: DataFrame) -> Column:
    """Per source, the number of slots whose documents together come closest to the tokens that the rates' rests ask for;
    null for documents of unknown source, whose own rest decides. All documents of a known source have one rate.

    Only token sums per source and slot reach the driver: ``SLOTS`` rows for each wanted source at most.
    """
    slots: dict[str, np.ndarray] = {}
    asked: dict[str, float] = {}
    for r in rated.groupBy("source", "slot").agg(F.sum("tokens").alias("t"), F.sum(F.col("tokens") * F.col("rest")).alias("a")).collect():
        slots.setdefault(r["source"], np.zeros(SLOTS))[r["slot"]] = r["t"]
        asked[r["source"]] = asked.get(r["source"], 0.0) + r["a"]
    best = {s: int(np.argmin(np.abs(np.r_[0.0, np.cumsum(t)] - asked[s]))) for s, t in slots.items()}
    return F.coalesce(*[F.when(F.col("source") == s, F.lit(float(c))) for s, c in best.items()], F.lit(None).cast("double"))


def _ahead(rate: Column, last: Column, beta: Column | float) -> Column:
    """Where a rate is looked at next: a part of its last move further on, between 0 and the cap."""
    return F.greatest(F.lit(0.0), F.least(F.col("cap"), rate + (rate - last) * beta))


def _stepped(at: Column | str, gradient: Column) -> Column:
    """A rate moved from ``at`` against a gradient per source and projected back between 0 and the cap."""
    dot = F.aggregate(F.zip_with("p", gradient, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return F.greatest(F.lit(0.0), F.least(F.col("cap"), (F.col(at) if isinstance(at, str) else at) - dot))


def _rate(steps: list[tuple[float, list[float]]], beta: float) -> Column:
    """A document's rate after all steps: it starts at its cap or 1, takes the steps one after the other, and looks ahead
    once more, to where the misses were found small enough."""
    start = F.least(F.lit(1.0), F.col("cap"))
    if not steps:
        return start
    taken = F.array(*[F.struct(F.lit(b).alias("beta"), F.array(*map(F.lit, g)).alias("g")) for b, g in steps])
    both = F.struct(start.alias("rate"), start.alias("last"))
    step = lambda x, s: F.struct(_stepped(_ahead(x["rate"], x["last"], s["beta"]), s["g"]).alias("rate"), x["rate"].alias("last"))
    end = F.aggregate(taken, both, step)
    return _ahead(end["rate"], end["last"], beta)
