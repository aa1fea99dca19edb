"""larkspur: company research data as Spark DataFrames.

Every operator takes and returns ``DataFrame`` or ``Column`` objects; nothing is executed before the caller's action,
except where a docstring says that a bounded statistic is fetched to choose a plan.
"""
