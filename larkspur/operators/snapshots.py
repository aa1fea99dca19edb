"""Full snapshots: which load a row belongs to, the state of every key in every load, and what changed between loads.

Loads form a calendar (``load_id``, ``started_at``). A source table keeps the rows of all loads; a row belongs to the
load with the latest ``started_at`` not after its own time stamp, and a key's state in a load is its newest row there.
Where a log says that a fetch failed, the state of the load before stands.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

#: Calendars of up to this many loads are read once and broadcast; larger ones stay distributed.
CALENDAR_BROADCAST_ROWS = 10_000
#: Calendars of up to this many loads become a search tree of comparisons; rows are joined by day with larger ones.
SEARCHED_LOADS = 256


CALENDAR = T.StructType(
    [T.StructField("load_id", T.IntegerType()), T.StructField("seq", T.IntegerType()), T.StructField("started_at", T.TimestampNTZType()),
     T.StructField("ends_at", T.TimestampNTZType()), T.StructField("next_load_id", T.IntegerType())]
)


@dataclass(frozen=True)
class Calendar:
    """``rows``: ``(load_id, seq, started_at, ends_at, next_load_id)``; ``starts``: all start times in order, or None
    where there are too many loads to read."""

    rows: DataFrame
    starts: list[datetime] | None

    def __iter__(self) -> Iterator:
        return iter((self.rows, self.starts is not None))

    def last_seq(self) -> Column | None:
        return None if self.starts is None else F.lit(len(self.starts))


def load_calendar(loads: DataFrame | Calendar) -> Calendar:
    """One row per start time, ``seq`` from 1 in time order.

    Loads without a start time are left out; of several loads with one start time the largest ``load_id`` stays. The
    calendar has one row per delivery, not per record: up to ``CALENDAR_BROADCAST_ROWS`` loads are read once, here, and
    become a broadcast local relation in every plan that uses them. Beyond that it stays a distributed table. A calendar
    is handed through, so that a query reads it once.
    """
    if isinstance(loads, Calendar):
        return loads
    one = (
        loads.select(F.col("load_id").cast("int").alias("load_id"), F.col("started_at").cast("timestamp_ntz").alias("started_at"))
        .where("started_at is not null and load_id is not null")
        .groupBy("started_at")
        .agg(F.max("load_id").alias("load_id"))
    )
    rows = one.limit(CALENDAR_BROADCAST_ROWS + 1).collect()
    if len(rows) <= CALENDAR_BROADCAST_ROWS:
        rows = sorted((r["started_at"], r["load_id"]) for r in rows)
        after = [*rows[1:], (None, None)]
        columns = zip(*[(i, k + 1, t, t2, i2) for k, ((t, i), (t2, i2)) in enumerate(zip(rows, after, strict=True))], strict=True) if rows else [[]] * 5
        kinds = [pa.int32(), pa.int32(), pa.timestamp("us"), pa.timestamp("us"), pa.int32()]
        arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
        local = loads.sparkSession.createDataFrame(pa.table(arrays, CALENDAR.fieldNames()), CALENDAR)
        return Calendar(F.broadcast(local), [t for t, _ in rows])
    w = W.orderBy("started_at")
    large = one.select(
        "load_id",
        F.row_number().over(w).alias("seq"),
        "started_at",
        F.lead("started_at").over(w).alias("ends_at"),
        F.lead("load_id").over(w).alias("next_load_id"),
    )
    return Calendar(large, None)


def assign_load(rows: DataFrame, loads: DataFrame | Calendar, at: str = "fetched_at", seq_col: str = "load_seq") -> DataFrame:
    """Add ``seq_col``: the calendar position of the load each row belongs to (an as-of join).

    Rows without a time, or before the first load, are dropped. Repeated rows stay repeated. Up to ``SEARCHED_LOADS``
    start times are searched by comparisons within the row, without a join; with more, both sides are joined by day,
    where a day's rows also see the last load that began before the day.
    """
    calendar = load_calendar(loads)
    if calendar.starts is not None and len(calendar.starts) <= SEARCHED_LOADS:
        return rows.withColumn(seq_col, _searched(F.col(at), calendar.starts, 0, len(calendar.starts))).where(F.col(seq_col) > 0)
    cal = calendar.rows.select(F.col("seq").alias(seq_col), F.col("started_at").alias("__from"))
    day = rows.withColumn("__day", F.to_date(at))
    starts = cal.select(seq_col, F.to_date("__from").alias("__day"), "__from")
    # The last load that began before each day: one row per day, so the window stays small.
    days = day.select("__day").distinct().join(starts.groupBy("__day").agg(F.max(seq_col).alias("__last")), "__day", "full_outer")
    before = days.select("__day", F.max("__last").over(W.orderBy("__day").rowsBetween(W.unboundedPreceding, -1)).alias(seq_col))
    before = before.where(F.col(seq_col).isNotNull()).withColumn("__from", F.lit(None).cast("timestamp_ntz"))
    spans = starts.select("__day", seq_col, "__from").unionByName(before)
    spans = spans.groupBy("__day").agg(F.sort_array(F.collect_list(F.struct(seq_col, "__from"))).alias("__spans"))
    begun = F.filter("__spans", lambda s: s["__from"].isNull() | (s["__from"] <= F.col(at)))
    found = day.join(spans, "__day").withColumn("__spans", begun).where(F.size("__spans") > 0)
    return found.withColumn(seq_col, F.element_at("__spans", -1)[seq_col]).drop("__day", "__spans")


def _searched(at: Column, starts: list[datetime], lo: int, hi: int) -> Column:
    """How many of ``starts`` are not after ``at``, known to be from lo to hi: a balanced tree of comparisons."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi + 1) // 2
    return F.when(at >= F.lit(starts[mid - 1]).cast("timestamp_ntz"), _searched(at, starts, mid, hi)).when(at.isNotNull(), _searched(at, starts, lo, mid - 1))


def served_loads(fetch_log: DataFrame, calendar: DataFrame, feed: str) -> DataFrame:
    """``(entity, load_seq, serves)``: only the loads that don't simply serve themselves.

    A failed load serves nothing; the last good load before a run of failed ones serves itself and the whole run. A run
    that starts with the first load has nothing to stand for it. Repeated log rows count once; rows without company or
    load count for nothing.
    """
    failed = (
        fetch_log.where((F.col("feed") == feed) & (F.col("outcome") == "failed") & F.col("company_ticker").isNotNull())
        .select(F.col("company_ticker").alias("entity"), "load_id")
        .distinct()
        .join(calendar.select("load_id", "seq"), "load_id")
        .select("entity", "seq")
    )
    run = F.col("seq") - F.row_number().over(W.partitionBy("entity").orderBy("seq"))
    runs = failed.select("entity", "seq", run.alias("run"))
    carried = (
        runs.groupBy("entity", "run")
        .agg((F.min("seq") - 1).alias("load_seq"), F.array_sort(F.collect_list("seq")).alias("failed"))
        .where("load_seq >= 1")
        .select("entity", "load_seq", F.concat(F.array("load_seq"), "failed").alias("serves"))
    )
    return carried.unionByName(failed.select("entity", F.col("seq").alias("load_seq"), F.array().cast("array<int>").alias("serves")))


def states(
    rows: DataFrame,
    loads: DataFrame | Calendar,
    fetch_log: DataFrame | None,
    feed: str,
    item: Column,
    payload: list[Column],
    entity: str = "company_ticker",
    at: str = "fetched_at",
    order: str = "id",
    by_key: bool = False,
) -> DataFrame:
    """``(entity, item, load_seq, <payload>)``: one row per key and load, failed loads filled from the load before.

    Rows without entity or item don't count. Equal time stamps are decided by the larger ``order``; wholly repeated rows
    by the larger payload (they are equal then). Only the named columns are read, so other columns may have any names.
    Rows are reduced before they are shuffled, so that a key repeated very often is no hot key.

    by_key: the states, one row per key and load by then, are partitioned by (entity, item), for consumers that go on by key.
    """
    base, names = _base(rows, entity, item, at, order, payload)
    calendar = load_calendar(loads)
    tagged = assign_load(base, calendar, "__at", "load_seq")
    if fetch_log is not None:
        tagged = tagged.join(served_loads(fetch_log, calendar.rows, feed), ["entity", "load_seq"], "left")
        tagged = tagged.withColumn("load_seq", F.explode(F.coalesce("serves", F.array("load_seq")))).drop("serves")
    newest = _newest(tagged, names)
    return newest.repartition("entity", "item") if by_key else newest


def _base(rows: DataFrame, entity: str, item: Column, at: str, order: str, payload: list[Column]) -> tuple[DataFrame, list[str]]:
    base = rows.select(
        F.col(entity).alias("entity"), item.alias("item"), F.col(at).alias("__at"), F.col(order).alias("__order"), *payload
    ).where("entity is not null and item is not null")
    return base, [c for c in base.columns if c not in ("entity", "item", "__at", "__order")]


def _newest(tagged: DataFrame, names: list[str]) -> DataFrame:
    newest = tagged.groupBy("entity", "item", "load_seq").agg(F.max(F.struct("__at", "__order", *names)).alias("__s"))
    return newest.select("entity", "item", "load_seq", *[F.col(f"__s.{n}").alias(n) for n in names])


def newest_states(
    rows: DataFrame,
    loads: DataFrame | Calendar,
    fetch_log: DataFrame | None,
    feed: str,
    item: Column,
    payload: list[Column],
    entity: str = "company_ticker",
    at: str = "fetched_at",
    order: str = "id",
) -> DataFrame:
    """The rows of ``states`` that hold in the last load, without the states of the loads before.

    The load that serves each entity is found first, from the log alone. Entities whose last fetch was good are read from
    the last load's start on; those that failed from the earliest load that still serves one of them. Both bounds are
    times of the rows, so they reach the scan, and only rows of a serving load are shuffled.
    """
    calendar = load_calendar(loads)
    if calendar.starts is None:
        last = calendar.rows.agg(F.max("seq").alias("load_seq"))
        return states(rows, calendar, fetch_log, feed, item, payload, entity, at, order).join(F.broadcast(last), "load_seq", "left_semi")
    base, names = _base(rows, entity, item, at, order, payload)
    if not calendar.starts:
        return _newest(base.where(F.lit(False)).withColumn("load_seq", F.lit(0)), names)
    last = len(calendar.starts)
    start = lambda seq: F.lit(calendar.starts[seq - 1]).cast("timestamp_ntz")
    fresh = base.where(F.col("__at") >= start(last))
    if fetch_log is None:
        return _newest(fresh.withColumn("load_seq", F.lit(last)), names)
    served = served_loads(fetch_log, calendar.rows, feed)
    failed = served.where((F.col("load_seq") == last) & (F.size("serves") == 0)).select("entity")
    carried = served.where((F.col("load_seq") < last) & F.array_contains("serves", last)).select("entity", "load_seq")
    earliest = carried.agg(F.min("load_seq")).first()[0]
    tagged = fresh.join(failed, "entity", "left_anti").withColumn("load_seq", F.lit(last))
    if earliest is not None:
        older = assign_load(base.where((F.col("__at") >= start(earliest)) & (F.col("__at") < start(last))), calendar, "__at", "load_seq")
        tagged = tagged.unionByName(older.join(carried, ["entity", "load_seq"], "left_semi").withColumn("load_seq", F.lit(last)))
    return _newest(tagged, names)


def row_hash(*cols: Column) -> Column:
    """Canonical 64-bit hash of a row's compared columns; a null differs from every value and from a null elsewhere."""
    return F.xxhash64(*[x for c in cols for x in (c.isNull(), c)])


def changes(state: DataFrame, loads: DataFrame | Calendar, payload: list[str]) -> DataFrame:
    """``(load_id, entity, item, change_type)`` between each two consecutive loads.

    ``state`` has one row per (entity, item, load_seq). A full outer join on the key compares row hashes: a missing left
    side gives ``removed``, a missing right side ``added``, unequal hashes ``changed``; equal rows give nothing.
    """
    calendar = load_calendar(loads)
    hashed = state.select("entity", "item", "load_seq", row_hash(*[F.col(c) for c in payload]).alias("h"))
    now = hashed.where("load_seq > 1").withColumnRenamed("h", "h_now")
    if calendar.starts is not None:
        earlier = hashed.where(F.col("load_seq") < calendar.last_seq())
    else:
        earlier = hashed.join(F.broadcast(calendar.rows.agg(F.max("seq").alias("last_seq"))), F.col("load_seq") < F.col("last_seq"))
    before = earlier.select("entity", "item", (F.col("load_seq") + 1).alias("load_seq"), F.col("h").alias("h_before"))
    kind = F.when(F.col("h_before").isNull(), "added").when(F.col("h_now").isNull(), "removed").otherwise("changed")
    both = now.join(before, ["entity", "item", "load_seq"], "full_outer").where(~F.col("h_now").eqNullSafe(F.col("h_before")))
    ids = calendar.rows.select(F.col("seq").alias("load_seq"), "load_id")
    return both.join(ids, "load_seq").select("load_id", "entity", "item", kind.alias("change_type"))


def versions(state: DataFrame, loads: DataFrame | Calendar, payload: list[str]) -> DataFrame:
    """``(entity, item, from_load, to_load, <payload>)``: one row per longest run of consecutive loads with equal payload.

    The snapshots are co-partitioned by key (``states(by_key=True)``) and each partition is one merge of their rows sorted
    by key and load, which Spark's sort yields from its sorted runs. A task reads the merge as a stream of Arrow batches
    and holds one open version, the newest, whatever the length of a history: a row with another key or payload, or after
    a gap, closes it and opens the next. Nulls equal only nulls; a key that leaves and returns begins a new version.
    """
    calendar = load_calendar(loads)
    # One text that is equal where the payload is; nulls are written out, so they differ from empty texts.
    same = F.to_json(F.struct(*[F.struct(F.col(c).alias("v")).alias(c) for c in payload]), {"ignoreNullFields": "false"})
    merged = state.select("entity", "item", F.col("load_seq").cast("int").alias("load_seq"), same.alias("__same"), *payload)
    merged = merged.repartition("entity", "item").sortWithinPartitions("entity", "item", "load_seq")
    kinds = {f.name: f.dataType for f in merged.schema.fields}
    out = T.StructType([T.StructField(n, kinds[k]) for n, k in (("entity", "entity"), ("item", "item"), ("__from", "load_seq"), ("__to", "load_seq"), *[(c, c) for c in payload])])
    spans = merged.mapInArrow(lambda batches: closed_versions(batches, payload), out)
    first = calendar.rows.select(F.col("seq").alias("__from"), F.col("load_id").alias("from_load"))
    last = calendar.rows.select(F.col("seq").alias("__to"), F.col("load_id").alias("to_load"))
    return spans.join(first, "__from").join(last, "__to").select("entity", "item", "from_load", "to_load", *payload)


def closed_versions(batches: Iterator[pa.RecordBatch], payload: list[str]) -> Iterator[pa.RecordBatch]:
    """Closed versions of a stream of rows sorted by key and load; one open version is carried from batch to batch."""
    names = ["entity", "item", "__from", "__to", *payload]
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch]).append_column("__from", batch.column("load_seq"))
        if held is not None:
            rows = pa.concat_tables([held, rows])
        n = rows.num_rows
        seq = rows["load_seq"].to_numpy()
        breaks = seq[1:] != seq[:-1] + 1
        for c in ("entity", "item", "__same") if n > 1 else ():
            column = rows[c].combine_chunks()
            breaks |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        opens = np.r_[0, np.flatnonzero(breaks) + 1]
        closes = np.r_[opens[1:] - 1, n - 1]
        found = rows.take(pa.array(opens)).append_column("__to", pa.array(seq[closes]))
        done = found.slice(0, len(opens) - 1).select(names)
        held = found.slice(len(opens) - 1)
        held = held.set_column(held.column_names.index("load_seq"), "load_seq", held["__to"]).drop_columns(["__to"])
        yield from done.combine_chunks().to_batches()
    if held is not None:
        yield from held.append_column("__to", held["load_seq"]).select(names).combine_chunks().to_batches()
