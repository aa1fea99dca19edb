"""A structured request, as a planner hands it over, applied to the company summary.

The plan is plain data: which companies, in which order, how many. Turning a question into a plan, and an answer into
prose, is left to callables outside the library.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, Window as W, functions as F

from larkspur.operators.companies import CompanyFilter, ranked
from larkspur.operators.vectors import topk

#: Rows handed out where a plan names no limit.
DEFAULT_LIMIT = 25
#: Rows of a search without a limit, and the least cosine of a hit.
SEARCH_LIMIT, SEARCH_FLOOR = 8, 0.40


@dataclass(frozen=True)
class Plan:
    intent: str
    ticker: str | None = None
    filters: CompanyFilter = field(default_factory=CompanyFilter)
    sort_by: str | None = None
    limit: int | None = None
    query: str | None = None

    @classmethod
    def from_json(cls, text: str) -> Plan:
        """Unknown keys are ignored, missing ones mean no bound."""
        raw = json.loads(text)
        names = {f.name for f in fields(CompanyFilter)}
        flt = CompanyFilter(**{k: v for k, v in (raw.get("filters") or {}).items() if k in names})
        return cls(raw.get("intent") or "", raw.get("ticker"), flt, raw.get("sort_by"), raw.get("limit"), raw.get("query"))


def run_plan(plan: Plan, summary: DataFrame, vectors: DataFrame | None = None, embed: Callable[[str], list[float]] | None = None) -> DataFrame:
    """The rows a plan asks for, with ``matches``, the number before the limit.

    ``filter``: summary rows by bounds, order, limit (25 if none or 0). ``company``: the one with the ticker in upper case;
    a name in its place finds nothing. ``search``: the rows of ``vectors (id, v, ...)`` most similar to the embedded query
    (8 if no limit), not below the floor; ``matches`` is then the number of rows found. Any other intent gives no rows.
    """
    if plan.intent == "search" and plan.query and vectors is not None and embed is not None:
        hits = topk(vectors, embed(plan.query), plan.limit or SEARCH_LIMIT, SEARCH_FLOOR).drop("v")
        return hits.withColumn("matches", F.count("*").over(W.partitionBy()))
    if plan.intent == "company":
        hits, limit = summary.where(F.col("ticker") == F.upper(F.lit(plan.ticker or ""))), None
    elif plan.intent == "filter":
        hits, limit = plan.filters.apply(summary), plan.limit or DEFAULT_LIMIT
    else:
        hits, limit = summary.where(F.lit(False)), None
    total = hits.agg(F.count("*").alias("matches"))
    return ranked(hits, plan.sort_by, limit).withColumn("matches", total.scalar())
