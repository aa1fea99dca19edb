"""Evaluation texts inside corpus texts, by spaced-seed hashing.

A seed is a fixed mask over ``min_words`` successive words; positions with a 0 are ignored. The hashes of all windows of
the test items are joined with those of all windows of the corpus. Every run of ``min_words`` equal words hits every
seed, and windows with other words at ignored positions hit too, so overlaps with substitutions are found as well: every
stretch of eight or more equal words, apart from single substitutions, whose score (see ``laid_over``) rises to its end
hits at least one seed. Around each hit the two texts are laid over each other and compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from larkspur.llm.words import portions, words, words_of
from larkspur.session import checkpoint_ready, spread

#: Masks over eight words; fixed values.
SEEDS = ("11011011", "11101011", "11101101", "01110111", "01011111")
#: Any one of them finds all runs of equal words.
RUN_SEEDS = SEEDS[:1]
#: Up to this many window hashes of items are sent to the tasks that read the corpus; of more a map of bits is sent.
SEED_TABLE_ROWS = 2_000_000
#: The map has two to this power bits, whatever the number of hashes: 32 MB.
MAP_BITS = 28
#: Where an item has more words than this, the whole text of a hit document is kept, else as many words around a hit.
LONG_ITEM = 1_000
#: Hits of one hash beyond this are split into parts of that size for the join with the items.
HOT_HITS = 50_000

REGION = "doc_id long, start int, words array<string>, hits array<struct<pos:int,seed:int,hash:long>>"
WINDOW = "doc_id long, pos int, seed int, hash long"


def window_hashes(codes: np.ndarray, seed: str) -> np.ndarray:
    """One 64-bit hash for each window of a sequence of word codes."""
    n = len(codes) - len(seed) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in (i for i, c in enumerate(seed) if c == "1"):
        out = (out ^ codes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _coded(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all words one after the other, and where each text begins."""
    at = np.cumsum([0, *map(len, texts)])
    flat = np.fromiter((w for t in texts for w in t), dtype=object, count=int(at[-1]))
    return (pd.util.hash_array(flat, categorize=True) if len(flat) else np.empty(0, np.uint64)), at


def _windows(texts: list[list[str]], seeds: tuple[str, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each seed: text number, position and hash of every window that lies within one text."""
    codes, at = _coded(texts)
    for number, seed in enumerate(seeds):
        span = len(seed)
        hashes = window_hashes(codes, seed)
        owner = np.searchsorted(at, np.arange(len(hashes)), side="right") - 1
        whole = np.arange(len(hashes)) + span <= at[owner + 1] if len(hashes) else np.empty(0, bool)
        yield number, owner[whole], (np.arange(len(hashes)) - at[owner])[whole] if len(hashes) else owner, hashes[whole]


def seed_table(texts: DataFrame, seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """``(doc_id, pos, seed, hash)`` of every window of every text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (part for batch in batches for part in portions(batch)):
            ids = pdf["doc_id"].to_numpy()
            for number, owner, pos, hashes in _windows([words_of(t) for t in pdf["text"]], seeds):
                yield pd.DataFrame({"doc_id": ids[owner], "pos": pos.astype("int32"), "seed": np.int32(number), "hash": hashes.view(np.int64)})

    return texts.select("doc_id", "text").mapInPandas(run, WINDOW)


@dataclass
class Known:
    """Which hashes may be an item's: sorted hashes per seed, or a map of bits that lets some others through."""

    hashes: list[np.ndarray] | None
    bits: np.ndarray | None

    def may_be(self, seed: int, hashes: np.ndarray) -> np.ndarray:
        """Places in ``hashes`` of those that are known."""
        if self.bits is not None:
            slot = hashes >> np.uint64(64 - MAP_BITS)
            return np.flatnonzero((self.bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1))
        own = self.hashes[seed]
        if not len(own):
            return np.empty(0, int)
        return np.flatnonzero(own[np.minimum(np.searchsorted(own, hashes), len(own) - 1)] == hashes)


def known_hashes(table: DataFrame, seeds: tuple[str, ...]) -> Known:
    """All hashes of a seed table up to ``SEED_TABLE_ROWS``; of a larger one a map of bits, gathered by one aggregation."""
    small = table.select("seed", "hash").distinct().limit(SEED_TABLE_ROWS + 1).toArrow()
    if small.num_rows <= SEED_TABLE_ROWS:
        number, code = small["seed"].to_numpy(), small["hash"].to_numpy()
        return Known([np.sort(code[number == s].view(np.uint64)) for s in range(len(seeds))], None)
    slot = F.shiftrightunsigned("hash", 64 - MAP_BITS)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(slot, F.lit(64)).cast("int"))
    words = table.groupBy(F.shiftrightunsigned(slot, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return Known(None, bits)


def _regions(corpus: DataFrame, known: Known, seeds: tuple[str, ...], around: int | None) -> DataFrame:
    """The parts of corpus texts, ``around`` words each way (None: whole texts), around windows whose hash may be known,
    with those hits."""
    span = len(seeds[0])
    sent = corpus.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (part for batch in batches for part in portions(batch)):
            ids, texts = pdf["doc_id"].to_numpy(), [words_of(t) for t in pdf["text"]]
            hits: dict[int, list[tuple[int, int, int]]] = {}
            for number, owner, pos, hashes in _windows(texts, seeds):
                for k in sent.value.may_be(number, hashes):
                    hits.setdefault(int(owner[k]), []).append((int(pos[k]), number, int(hashes[k].view(np.int64))))
            rows = []
            for o, found in hits.items():
                found.sort()
                reach = len(texts[o]) if around is None else around
                group: list[tuple[int, int, int]] = []
                for h in [*found, (1 << 60, 0, 0)]:
                    if group and h[0] > group[-1][0] + span + 2 * reach:
                        lo = max(0, group[0][0] - reach)
                        rows.append((ids[o], lo, texts[o][lo : group[-1][0] + span + reach], [{"pos": p, "seed": s, "hash": x} for p, s, x in group]))
                        group = []
                    group.append(h)
            yield pd.DataFrame(rows, columns=["doc_id", "start", "words", "hits"])

    return corpus.select("doc_id", "text").mapInPandas(run, REGION)


@F.pandas_udf(T.StructType([T.StructField(n, T.IntegerType()) for n in ("run", "matched", "span")]))
def laid_over(doc: pd.Series, item: pd.Series, shift: pd.Series) -> pd.DataFrame:
    """Two word lists laid over each other (``item[i]`` at ``doc[i + shift]``): the longest run of equal words, and the
    equal words and length of the best stretch that loses no more to substitutions than it gains."""
    return pd.DataFrame([_best_stretch(d, t, s) for d, t, s in zip(doc, item, shift, strict=True)], columns=["run", "matched", "span"])


def _best_stretch(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int]:
    """``laid_over`` of one pair. A stretch scores one for an equal word and minus two for another; it begins anew where its
    score is not above zero, and the first of the highest scores wins."""
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    if hi <= lo:
        return 0, 0, 0
    same = np.asarray(doc[lo + shift : hi + shift], object) == np.asarray(item[lo:hi], object)
    edges = np.flatnonzero(np.diff(np.r_[False, same, False].astype(np.int8)))
    run = int((edges[1::2] - edges[::2]).max()) if len(edges) else 0
    sums = np.r_[0, np.cumsum(np.where(same, 1, -2))]
    lowest = np.minimum.accumulate(sums[:-1])
    gain = sums[1:] - lowest
    end = int(np.argmax(gain))
    if gain[end] <= 0:
        return run, 0, 0
    begin = int(np.flatnonzero(sums[: end + 1] == lowest[end])[-1])
    return run, int(same[begin : end + 1].sum()), end - begin + 1


def _matched(hits: DataFrame, keyed: DataFrame) -> DataFrame:
    """``(region, item_id, shift)``, each once, of the hits ``(region, pos, seed, hash)`` whose hash is an item's.

    A hash that very many texts have (a common phrase in an item) is split: its hits go to parts of ``HOT_HITS`` and its
    rows of the item side to each part.
    """
    hot = hits.groupBy("seed", "hash").agg(F.ceil(F.count("*") / HOT_HITS).cast("int").alias("parts")).where("parts > 1")
    part = lambda c: F.coalesce(c, F.lit(0)).alias("part")
    left = hits.join(hot, ["seed", "hash"], "left").select("region", "pos", "seed", "hash", part(F.pmod(F.xxhash64("region", "pos"), "parts").cast("int")))
    right = keyed.join(hot, ["seed", "hash"], "left").select("item_id", "item_pos", "seed", "hash", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    both = left.join(right, ["seed", "hash", "part"])
    return both.select("region", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct()


def overlaps(corpus: DataFrame, items: DataFrame, seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """``(doc_id, item_id, run, matched, span)``: for each corpus text and test item with a common seed hash, the longest
    run of equal words and the best substitution-tolerant stretch.

    Rows with a null id or text give nothing, nor do texts of fewer words than a seed. Several rows with one id count as
    parts of one text. Only the named columns are read. The corpus is read once: the tasks that read it know which hashes
    may be an item's (exactly, or by a map of bits of fixed size) and pass on only the parts of texts around such hits,
    as many words each way as the longest item has. Hits and items are then joined by hash.
    """
    corpus = spread(corpus.select("doc_id", "text")).select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    items = items.select(F.col("item_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    table = seed_table(items, seeds)
    keyed = table.select(F.col("doc_id").alias("item_id"), F.col("pos").alias("item_pos"), "seed", "hash")
    item_words = items.select(F.col("doc_id").alias("item_id"), words("text").alias("item_words"))
    longest = item_words.agg(F.max(F.size("item_words"))).first()[0] or 0
    regions = _regions(corpus, known_hashes(table, seeds), seeds, longest if longest <= LONG_ITEM else None)
    # Parts of texts around hits, used twice below; positions are counted within the part.
    checkpoint_ready(corpus.sparkSession)
    kept = regions.withColumn("region", F.xxhash64("doc_id", "start", "words")).checkpoint()
    hits = kept.select("region", "start", F.explode("hits").alias("hit")).select("region", (F.col("hit.pos") - F.col("start")).alias("pos"), "hit.seed", "hit.hash")
    pairs = _matched(hits, keyed).join(kept.select("region", "doc_id", F.col("words").alias("doc_words")), "region")
    found = pairs.join(item_words, "item_id").withColumn("o", laid_over("doc_words", "item_words", "shift"))
    best = F.max(F.struct("o.matched", "o.span"))
    return found.groupBy("doc_id", "item_id").agg(F.max("o.run").alias("run"), best.alias("b")).select(
        "doc_id", "item_id", "run", F.col("b.matched").alias("matched"), F.col("b.span").alias("span")
    )


def leaks(corpus: DataFrame, items: DataFrame, min_words: int = len(SEEDS[0])) -> DataFrame:
    """``(doc_id, item_id)``: the text holds at least ``min_words`` successive words of the item.

    ``min_words`` may not be smaller than a seed, else shorter runs could miss every seed.
    """
    if min_words < len(SEEDS[0]):
        raise ValueError(f"min_words must be at least {len(SEEDS[0])}")
    return overlaps(corpus, items, RUN_SEEDS).where(F.col("run") >= min_words).select("doc_id", "item_id")
