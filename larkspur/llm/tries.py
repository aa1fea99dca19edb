"""Strings within a bounded number of edits of each other, by tries.

The indexed strings are sharded by a class and their length; in each shard they form a trie, and all queries that could
match walk it together: one automaton state (the edit-distance row) per query, advanced letter by letter, and dropped as
soon as no ending can be within its bound. Words in another order are matched by asking for each order of a query's words;
of longer names, where these are many, by the words that both have, and the few others one by one.
"""

from __future__ import annotations

from collections import Counter
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from larkspur.session import checkpoint_ready

#: Strings per trie and queries per task aimed at; larger shards are split, each query then visits every part.
TRIE_ROWS, QUERY_ROWS = 20_000, 40_000
MOST_EDITS = 2
#: Where a class and length would fill more tries than this, its strings are sharded by their first letters instead.
MOST_TRIES = 16
#: Letters of such a prefix.
PREFIX = 4
#: Names with more spaces than one less than this (five words or more) are matched by common words, not by all orders.
MANY_WORDS = 4


def bound(length: Column) -> Column:
    """Edits allowed for a string of this length: none up to 3 letters, one up to 5, two beyond."""
    return F.when(length <= 3, 0).when(length <= 5, 1).otherwise(MOST_EDITS)


def walk(index: list[str], queries: list[str], bounds: np.ndarray, heads: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query number, index number, edits)`` for all pairs within the query's bound. Index strings have one length.

    Edits are insertions, deletions, substitutions and swaps of neighbours. heads: index strings are the heads of longer
    ones; all that some head of the query comes within its bound of are found.
    """
    order = sorted(range(len(index)), key=index.__getitem__)
    keys = [index[i] for i in order]
    width = max(map(len, queries), default=0)
    letters = np.zeros((len(queries), width), np.uint32)
    for i, q in enumerate(queries):
        letters[i, : len(q)] = np.frombuffer(q.encode("utf-32-le"), np.uint32)
    ends = np.array([len(q) for q in queries])
    steps = np.arange(width + 1, dtype=np.int16)
    hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def go(lo: int, hi: int, depth: int, alive: np.ndarray, before: np.ndarray | None, row: np.ndarray, came: int) -> None:
        if depth == len(keys[lo]):
            d = row.min(axis=1) if heads else row[np.arange(len(alive)), ends[alive]]
            near = d <= bounds[alive]
            for k in range(lo, hi):
                hits.append((alive[near], np.full(int(near.sum()), order[k]), d[near]))
            return
        text = letters[alive]
        while lo < hi:
            c = keys[lo][depth]
            end = lo + 1
            while end < hi and keys[end][depth] == c:
                end += 1
            same = text == ord(c)
            now = np.empty_like(row)
            now[:, 0] = depth + 1
            now[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + ~same)
            if before is not None and width > 1:
                swap = same[:, :-1] & (text[:, 1:] == came)
                now[:, 2:] = np.where(swap, np.minimum(now[:, 2:], before[:, :-2] + 1), now[:, 2:])
            now = np.minimum.accumulate(now - steps, axis=1) + steps
            # A swap may still come back from the row before, one edit dearer.
            keep = np.minimum(now.min(axis=1), row.min(axis=1) + 1) <= bounds[alive]
            if keep.any():
                go(lo, end, depth + 1, alive[keep], row[keep], now[keep], ord(c))
            lo = end

    if keys and queries:
        go(0, len(keys), 0, np.arange(len(queries)), None, np.tile(steps, (len(queries), 1)), 0)
    if not hits:
        return (np.empty(0, int),) * 3
    return tuple(np.concatenate(x) for x in zip(*hits, strict=True))  # type: ignore[return-value]


def _edits(a: str, b: str) -> int:
    """Edits from a to b, as ``walk`` counts them, up to ``MOST_EDITS``; one more if there are more."""
    _, _, d = walk([b], [a], np.array([MOST_EDITS]))
    return int(d[0]) if len(d) else MOST_EDITS + 1


def any_order(index: list[str], queries: list[str], bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query number, index number, edits)`` of names with as many words, whatever their order.

    Names within e edits have all but e words in common, so the index is asked by words; the words that are left over on
    either side are tried in each assignment, at most e of them.
    """
    holders: dict[str, list[int]] = {}
    split = [x.split(" ") for x in index]
    for i, words in enumerate(split):
        for w in set(words):
            holders.setdefault(w, []).append(i)
    hits = []
    for n, query in enumerate(queries):
        asked, most = Counter(query.split(" ")), int(bounds[n])
        size = sum(asked.values())
        # A key that has all but e words has one of any e + 1; the rarest ones are looked up.
        rarest = sorted(asked.elements(), key=lambda w: len(holders.get(w, ())))[: most + 1]
        for i in sorted({i for w in rarest for i in holders.get(w, ())}):
            own = Counter(split[i])
            left, right = list((asked - own).elements()), list((own - asked).elements())
            if sum(own.values()) == size and len(left) <= most:
                d = min(sum(map(_edits, left, p)) for p in permutations(right))
                if d <= most:
                    hits.append((n, i, d))
    return tuple(np.array(c, int) for c in zip(*hits, strict=True)) if hits else (np.empty(0, int),) * 3  # type: ignore[return-value]


def _match(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    many = queries["query"].str.count(" ").to_numpy() >= MANY_WORDS
    asked, owner_of = _orders(queries["query"])
    bounds = queries["bound"].to_numpy()
    a, b, d = walk(list(index["key"]), asked, bounds[owner_of] if len(owner_of) else np.empty(0, int))
    a = owner_of[a]
    if many.any():
        long_keys, long_queries = np.flatnonzero(index["key"].str.count(" ").to_numpy() >= MANY_WORDS), np.flatnonzero(many)
        a2, b2, d2 = any_order(list(index["key"].iloc[long_keys]), list(queries["query"].iloc[long_queries]), bounds[long_queries])
        a, b, d = np.r_[a, long_queries[a2]], np.r_[b, long_keys[b2]], np.r_[d, d2]
    found = pd.DataFrame({"query": queries["query"].to_numpy()[a], "key": index["key"].to_numpy()[b], "edits": d.astype("int32")})
    found.insert(0, "shard", index["i_shard"].iloc[0] if len(index) else None)
    return found.groupby(["shard", "query", "key"], as_index=False)["edits"].min() if len(found) else found


def _orders(queries: pd.Series) -> tuple[list[str], np.ndarray]:
    """The strings to ask for, each order of few words and the own order of many, and whose they are."""
    asked: list[str] = []
    owner: list[int] = []
    for i, q in enumerate(queries):
        words = q.split(" ")
        orders = {q} if len(words) > MANY_WORDS else {" ".join(p) for p in permutations(words)}
        asked += orders
        owner += [i] * len(orders)
    return asked, np.array(owner, int)


def _reached(heads: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    """The heads of indexed strings that each query may match below, by a walk over the trie's upper part alone."""
    asked, owner = _orders(queries["query"])
    if not asked or heads.empty:
        return pd.DataFrame(columns=["shard", "len", "query", "bound", "bucket"])
    found = []
    for _, part in heads.groupby(heads["head"].str.len()):
        a, b, _ = walk(list(part["head"]), asked, queries["bound"].to_numpy()[owner], heads=True)
        found.append(pd.DataFrame({"at": owner[a], "bucket": part["head"].to_numpy()[b]}))
    at = pd.concat(found).drop_duplicates()
    return queries.iloc[at["at"]][["shard", "len", "query", "bound"]].assign(bucket=at["bucket"].to_numpy())


def _bucketed(keys: DataFrame, asked: DataFrame, large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with a ``bucket``: none in small shards; in large ones the first letters, which a query's automata reach
    from the upper part of the trie. How many buckets a query visits depends on its bound, not on the number of strings.

    Strings of many words are in a bucket of each of their words as well, and asked for in those of any words more than
    may differ.
    """
    by, many = ["shard", "len"], lambda c: F.size(F.split(c, " ")) > MANY_WORDS
    none = F.lit("").alias("bucket")
    small = lambda df: df.join(large, by, "left_anti").withColumn("bucket", none)
    big_keys, big_asked = keys.join(large, by, "left_semi"), asked.join(large, by, "left_semi")
    headed = big_keys.withColumn("bucket", F.substring("key", 1, PREFIX))
    tasks = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The heads of a shard, a few letters each, go to all tasks that hold its queries.
    left = headed.select("shard", "len", F.col("bucket").alias("head")).distinct().select(
        F.col("shard").alias("h_shard"), F.col("len").alias("h_len"), "head", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("h_task")
    )
    right = big_asked.withColumn("task", F.pmod(F.xxhash64("query"), F.lit(tasks)).cast("int"))
    reach = left.groupBy("h_shard", "h_len", "h_task").cogroup(right.groupBy("shard", "len", "task")).applyInPandas(_reached, "shard string, len int, query string, bound int, bucket string")
    words = lambda c, n: F.explode(F.transform(F.array_distinct(F.slice(F.split(c, " "), 1, n)), lambda w: F.concat(F.lit(" "), w))).alias("bucket")
    all_keys = small(keys).unionByName(headed).unionByName(big_keys.where(many("key")).select("*", words("key", 1 << 20)))
    all_asked = small(asked).unionByName(reach).unionByName(big_asked.where(many("query")).select("*", words("query", MOST_EDITS + 1)))
    return all_keys, all_asked


def edit_join(index: DataFrame, queries: DataFrame) -> DataFrame:
    """``(shard, query, key, edits)``: for each query (shard, query) the index strings (shard, key) within its bound.

    Null and empty strings match nothing; repeated rows count once. A string's bound follows from the shorter of the two.
    Shards of more than ``TRIE_ROWS`` strings become several tries, and more than ``QUERY_ROWS`` queries several tasks;
    shards of more than ``MOST_TRIES`` tries are parted by first letters, so that copies don't grow with the strings.
    """
    checkpoint_ready(index.sparkSession)
    keys = index.where("shard is not null and key <> ''").select("shard", "key").distinct().withColumn("len", F.length("key"))
    asked = queries.where("shard is not null and query <> ''").select("shard", "query").distinct().withColumn("bound", bound(F.length("query")))
    asked = asked.withColumn("len", F.explode(F.sequence(F.greatest(F.lit(1), F.length("query") - F.col("bound")), F.length("query") + F.col("bound"))))
    sizes = keys.groupBy("shard", "len").agg(F.ceil(F.count("*") / TRIE_ROWS).cast("int").alias("tries")).checkpoint()
    large = sizes.where(F.col("tries") > MOST_TRIES).select("shard", "len")
    parted = large.limit(1).count() > 0
    keys, asked = _bucketed(keys, asked, large) if parted else (keys.withColumn("bucket", F.lit("")), asked.withColumn("bucket", F.lit("")))
    group = ["shard", "len", "bucket"]
    tries = keys.groupBy(*group).agg(F.ceil(F.count("*") / TRIE_ROWS).cast("int").alias("tries"))
    tasks = asked.groupBy(*group).agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("tasks"))
    plan = tries.join(tasks, group)
    left = keys.join(plan, group).select(
        *group, "key", F.pmod(F.xxhash64("key"), "tries").cast("int").alias("trie"), F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task")
    )
    right = asked.join(plan, group).select(
        *group, "query", "bound", F.explode(F.sequence(F.lit(0), F.col("tries") - 1)).alias("trie"), F.pmod(F.xxhash64("query"), "tasks").cast("int").alias("task")
    )
    by = [*group, "trie", "task"]
    # The rows are few and the work on them is much, so the number of tasks must not follow their bytes. Both sides come
    # from one plan; new names keep their columns apart.
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = left.select("key", *[F.col(c).alias(f"i_{c}") for c in by]).repartition(tasks, *[f"i_{c}" for c in by])
    right = right.repartition(tasks, *by)
    found = left.groupBy(*[f"i_{c}" for c in by]).cogroup(right.groupBy(*by)).applyInPandas(_match, "shard string, query string, key string, edits int")
    found = found.where(F.col("edits") <= bound(F.length("key")))
    return found.groupBy("shard", "query", "key").agg(F.min("edits").alias("edits")) if parted else found
