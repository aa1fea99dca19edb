"""Reading level of each document: how large a frequency-ranked vocabulary covers a fixed share of its words, and how
complex its sentences are, calibrated against documents rated by people.

The ranks come from the word counts of all documents. The calibration is a linear discriminant over the measures and their
products: its sums over the rated documents are aggregated in Spark, and only its last small equation is solved outside.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from larkspur.llm.words import portions
from larkspur.session import checkpoint_ready, shared_folder, spread

#: Shares of a document's words that the vocabulary must cover.
SHARES = (0.5, 0.7, 0.8, 0.9, 0.95)
FEATURES = (*(f"cover_{int(s * 100)}" for s in SHARES), "sentence", "spread", "letters", "long", "short")
#: Up to this many of the most frequent words are sent to the tasks; rarer ones are joined by a shuffle.
HEAD_WORDS = 500_000
#: Endings that mark telegraphic English; fixed values.
ENGLISH_ENDING = "(?:tion|ing|ed|ity|ology|ible|able|ly|ment|ness|ous|ive)s?$"
_WORD = regex.compile(r"\p{L}+(?:['’]\p{L}+)*")
#: The same where all letters are plain.
_PLAIN_WORD = re.compile(r"[A-Za-z]+(?:'[A-Za-z]+)*")
_STOPS = re.compile(r"[.!?\n]+")
_TAG, _ENTITY = regex.compile(r"<[/!?]?\p{L}[^<>]*>"), re.compile(r"&(?:[a-zA-Z]+|#\d+);")
#: Common function words by language; fixed values. Words that English uses as much (a, as, do, no, in, is, per, met) only
#: count for English, or not at all.
FUNCTION_WORDS = {
    "en": "the of and to in is that for with was on are be this by or not as it at from have has an were which will you they we can if who their about all no".split(),
    "fr": "le la les des du une et est dans pour que qui sur par avec au aux pas ce cette son ses ont été sont à été l d".split(),
    "de": "der die das und ist den dem des ein eine nicht mit für auf von zu im sich nach bei wurden werden ob wird haben".split(),
    "es": "el la los las de del que y en un una por con para se su al es fue durante este son cada han".split(),
    "it": "il lo gli di che è e con una del della dei nel sono non si da al alla".split(),
    "pt": "o os de da dos das que e em um uma para com por não se ao na foi são".split(),
    "nl": "de het een en van dat op te voor niet zijn aan door werd bij ook".split(),
}
_FUNCTION_SETS = {k: frozenset(v) for k, v in FUNCTION_WORDS.items()}
_ENDING = re.compile(ENGLISH_ENDING)


WORDED = "doc_id long, words array<string>, n_tokens int, sentence double, spread double"
MEASURED = ", ".join(["doc_id long", "n_words int", *[f"{c} double" for c in FEATURES], "english boolean", "tail array<string>", "wanted array<int>"])


def _taken_apart(text: str) -> tuple[list[str], int, float, float]:
    """Words, number of pieces, and log mean and deviation of words per sentence of one text."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = _ENTITY.sub(" ", text)
    word = _PLAIN_WORD if text.isascii() else _WORD
    words, lengths, start = [], [], 0
    # A sentence ends at a line's end, or at stops before white space.
    ends = [m.end() for m in _STOPS.finditer(text) if text[m.end() : m.end() + 1].isspace() or m.end() == len(text) or "\n" in m.group()]
    for end in [*ends, len(text)]:
        own = word.findall(text, start, end)
        start = end
        words += own
        if len(own) >= 2:
            lengths.append(len(own))
    lengths = lengths or [max(1, len(words))]
    mean = sum(lengths) / len(lengths)
    spread = (max(0.0, sum(x * x for x in lengths) / len(lengths) - mean * mean)) ** 0.5 / 10
    pieces = sum(p[0].isalnum() or any(map(str.isalnum, p)) for p in text.split())
    return [w.lower() for w in words], pieces, float(np.log(mean)), spread


def with_words(documents: DataFrame) -> DataFrame:
    """``(doc_id, words, n_tokens, sentence, spread)`` of each document with words.

    words: runs of letters in lower case, without tags and the common entities. n_tokens: pieces between white space that
    hold a letter or digit. sentence and spread: log mean and deviation (in tens) of words per sentence, over sentences of
    two words or more.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (part for batch in batches for part in portions(batch)):
            rows = [(i, *_taken_apart(t)) for i, t in zip(pdf["doc_id"], pdf["text"], strict=True)]
            yield pd.DataFrame([r for r in rows if r[1]], columns=["doc_id", "words", "n_tokens", "sentence", "spread"])

    text = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return text.mapInPandas(run, WORDED)


def word_ranks(worded: DataFrame) -> DataFrame:
    """``(word, rank)``: the size of the smallest vocabulary of most frequent words that holds the word; words of equal
    frequency share a rank.

    The window runs over distinct frequencies: with N words in all documents there are fewer than the root of 2 N.
    """
    counts = worded.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    levels = counts.groupBy("n").agg(F.count("*").alias("m"))
    levels = levels.select("n", F.sum("m").over(W.orderBy(F.desc("n"))).alias("rank"))
    return counts.join(levels, "n").select("word", "rank")


def features(worded: DataFrame, ranks: DataFrame) -> DataFrame:
    """``(doc_id, n_words, <FEATURES>)`` of the English documents.

    cover_*: log of the rank that so large a share of a document's words reaches. letters, long and short: mean length,
    share of words of ten letters or more and of four or fewer. English: no other known language has more function words,
    and they are 8 % of the words, or else 15 % of the words have an English ending (telegraphic texts). Where 30 % have
    one, another language must have 8 % to win. Of rows with one id the one with most words counts.

    A document's words stay in its row. The most frequent words, at most ``HEAD_WORDS``, are sent to the tasks with their
    ranks. Only documents whose coverage reaches beyond these go on to a shuffle, with their rarer words alone; these are
    rare everywhere, so none is a hot key.
    """
    spark = worded.sparkSession
    head = ranks.where(F.col("rank") <= HEAD_WORDS).toArrow()
    sent = spark.sparkContext.broadcast((head["word"].to_pylist(), head["rank"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, rank = sent.value
        rank_of = dict(zip(words, rank.tolist(), strict=True))
        for batch in batches:
            if batch.num_rows:
                yield _measured(batch, rank_of)

    measured = worded.mapInArrow(run, MEASURED).where("english").drop("english")
    best = F.max_by(F.struct(*[c for c in measured.columns if c != "doc_id"]), F.struct("n_words", *FEATURES))
    covers = FEATURES[: len(SHARES)]
    if ranks.where(F.col("rank") > HEAD_WORDS).limit(1).count():
        one = measured.groupBy("doc_id").agg(best.alias("m")).select("doc_id", "m.*")
        ranked = one.where(F.size("tail") > 0).select("doc_id", F.explode("tail").alias("word")).join(ranks.where(F.col("rank") > HEAD_WORDS), "word")
        lists = ranked.groupBy("doc_id").agg(F.sort_array(F.collect_list("rank")).alias("r"))
        both = one.join(lists, "doc_id", "left")
        at = lambda k: F.log(F.try_element_at("r", F.get("wanted", F.lit(k))).cast("double"))
        filled = {c: F.when(F.get("wanted", F.lit(k)) > 0, at(k)).otherwise(F.col(c)) for k, c in enumerate(covers)}
        return both.withColumns(filled).select("doc_id", "n_words", *FEATURES)
    return measured.groupBy("doc_id").agg(best.alias("m")).select("doc_id", "m.n_words", *[f"m.{c}" for c in FEATURES])


def _measured(batch: pa.RecordBatch, rank_of: dict[str, int]) -> pa.RecordBatch:
    """The figures of each document of a batch; ``wanted`` has, per share, which of the ``tail`` words in order of rank it
    asks for, or 0 where the share is covered by words with a known rank."""
    lists = batch.column("words")
    n = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    flat = lists.flatten().dictionary_encode()
    known, code = flat.dictionary.to_pylist(), flat.indices.to_numpy()
    length = np.array([len(w) for w in known], float)
    ranks = np.array([rank_of.get(w, 0) for w in known], np.int64)
    flags = np.column_stack([length, length >= 10, length <= 4, [bool(_ENDING.search(w)) for w in known], *[[w in s for w in known] for s in _FUNCTION_SETS.values()]])
    starts = np.r_[0, np.cumsum(n)[:-1]]
    sums = np.add.reduceat(flags[code], starts, axis=0)
    letters, long, short, ending = (sums[:, :4] / n[:, None]).T
    spoken = dict(zip(_FUNCTION_SETS, sums[:, 4:].T, strict=True))
    most = np.max([v for k, v in spoken.items() if k != "en"], axis=0)
    english = (spoken["en"] >= most) & ((spoken["en"] >= 0.08 * n) | (ending >= 0.15)) | (ending >= 0.3) & (most < 0.08 * n)
    # Known ranks in order within each document, unknown ones last.
    token_rank = np.where(ranks[code] == 0, np.iinfo(np.int64).max, ranks[code])
    owner = np.repeat(np.arange(len(n)), n)
    ordered = token_rank[np.lexsort((token_rank, owner))]
    known_n = np.add.reduceat((ranks[code] > 0).astype(np.int64), starts)
    place = np.maximum(1, np.ceil(np.round(n[:, None] * np.array(SHARES), 9)).astype(np.int64))
    covered = np.log(ordered[starts[:, None] + place - 1].astype(float))
    wanted = np.maximum(0, place - known_n[:, None])
    rare = [[known[c] for c in code[s : s + k] if ranks[c] == 0] if w.any() and e else [] for s, k, w, e in zip(starts, n, wanted, english, strict=True)]
    columns = [batch.column("doc_id"), pa.array(n.astype(np.int32)), *[pa.array(c) for c in covered.T], batch.column("sentence"), batch.column("spread")]
    columns += [pa.array(x) for x in (letters, long, short)] + [pa.array(english), pa.array(rare, pa.list_(pa.string()))]
    columns.append(pa.array(list(wanted.astype(np.int32)), pa.list_(pa.int32())))
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", *FEATURES, "english", "tail", "wanted"])


#: Which measures are multiplied for the terms of the discriminant: each with each, and with itself.
PAIRS = tuple((i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES)))


def _terms(rows: np.ndarray) -> np.ndarray:
    """The measures of each row and all their products of two."""
    return np.column_stack([rows, *[rows[:, i] * rows[:, j] for i, j in PAIRS]])


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per level: the number of rows, the sums of their terms, and the sums of products of two terms."""
    held: dict[int, np.ndarray] = {}
    for pdf in batches:
        for level, part in pdf.groupby("level"):
            t = _terms(part[list(FEATURES)].to_numpy())
            held[level] = held.get(level, 0) + np.r_[len(t), t.sum(axis=0), (t.T @ t)[np.triu_indices(t.shape[1])]]
    yield pd.DataFrame([(level, list(v)) for level, v in held.items()], columns=["level", "sums"])


@dataclass
class Model:
    """A score per level: a constant and one weight per term."""

    levels: list[int]
    constants: np.ndarray
    weights: np.ndarray


def calibrate(features: DataFrame, ratings: DataFrame) -> Model | None:
    """A linear discriminant with a shared covariance, over the measures and their products.

    features: ``doc_id`` and ``FEATURES``. ratings: ``doc_id, reading_level``; null ratings and documents whose ratings
    disagree are left out, repeated ones count once. The counts, sums and products are partial sums of the tasks, added up
    in SQL; only they, a few thousand numbers, reach the driver. Without any rating there is no model.
    """
    agreed = ratings.where("reading_level is not null").groupBy("doc_id").agg(F.min("reading_level").alias("level"), F.max("reading_level").alias("hi"))
    rated = features.join(agreed.where("level = hi"), "doc_id").select(F.col("level").cast("int").alias("level"), *FEATURES)
    parts = rated.mapInPandas(_sums, "level int, sums array<double>").select("level", F.posexplode("sums").alias("at", "v"))
    rows = parts.groupBy("level", "at").agg(F.sum("v").alias("v")).toPandas()
    if rows.empty:
        return None
    table = rows.pivot(index="level", columns="at", values="v").sort_index()
    p = len(FEATURES) + len(PAIRS)
    n, sums, products = table.iloc[:, 0].to_numpy(), table.iloc[:, 1 : p + 1].to_numpy(), table.iloc[:, p + 1 :].to_numpy().sum(axis=0)
    means, total = sums / n[:, None], n.sum()
    within = np.zeros((p, p))
    within[np.triu_indices(p)] = products
    within = within + np.triu(within, 1).T - (means * n[:, None]).T @ means
    within /= total
    # Shrunk toward its diagonal by as many ratings' worth as there are terms, so that few ratings still give a solvable equation.
    within += np.diag(np.diag(within) * p / (total + p) + 1e-9)
    weights = np.linalg.solve(within, means.T)
    return Model([int(x) for x in table.index], np.log(n / total) - 0.5 * (means.T * weights).sum(axis=0), weights)


def score(model: Model | None) -> Column:
    """The level with the highest score; equal scores go to the lower level. Null without a model."""
    if model is None:
        return F.lit(None).cast("int")
    levels = np.array(model.levels, np.int32)

    @F.pandas_udf(T.IntegerType())
    def best(*columns: pd.Series) -> pd.Series:
        value = _terms(np.column_stack(columns)) @ model.weights + model.constants
        return pd.Series(levels[np.argmax(value, axis=1)] if len(value) else np.empty(0, np.int32))

    return best(*FEATURES)


def reading_levels(documents: DataFrame, ratings: DataFrame, min_tokens: int = 40) -> DataFrame:
    """``(doc_id, reading_level, n_words, <FEATURES>)`` of every English document with at least ``min_tokens`` words.

    The language is judged by the text alone. Null and empty texts and null ids give no row. Of rows with one id the one
    with most words counts. Word counts cover all documents. The texts are taken apart once, into a table in the shared
    folder; the rank table, one row per distinct word, and the figures, one row per document, are checkpointed.
    """
    documents = spread(documents.select("doc_id", "text"))
    spark = documents.sparkSession
    checkpoint_ready(spark)
    folder = shared_folder(spark, "words")
    with_words(documents).write.parquet(folder)
    worded = spark.read.schema(WORDED).parquet(folder)
    ranks = word_ranks(worded).checkpoint()
    ratings = ratings.select(F.col("doc_id").cast("long").alias("doc_id"), "reading_level")
    measured = features(worded.where(F.col("n_tokens") >= min_tokens), ranks).checkpoint()
    return measured.select("doc_id", score(calibrate(measured, ratings)).cast("int").alias("reading_level"), "n_words", *FEATURES)
