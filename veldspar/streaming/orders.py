"""Streams of order steps: windowed spending with late rows, and orders' states kept by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = "status string, since timestamp"
OUT = "id string, status string, since timestamp"


def spending(steps: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """(start, status, n, spent) of steps (id, status, at, amount) in tumbling windows; rows later than `late` are dropped."""
    rows = steps.withWatermark("at", late).groupBy(F.window("at", width).alias("w"), "status").agg(F.count("*").alias("n"), F.sum(F.col("amount").cast("decimal(18,2)")).alias("spent"))
    return rows.select(F.col("w.start").alias("start"), "status", "n", "spent")


def _advance(key, batches, state):
    """Keep the latest step of an order; a step no later than the kept one changes nothing."""
    import pandas as pd

    status, since = state.get if state.exists else (None, None)
    before = status, since
    for pdf in batches:
        for s, at in sorted(zip(pdf.status, pdf["at"]), key=lambda x: (x[1], x[0])):
            if since is None or at > since:
                status, since = s, at
    if (status, since) != before:
        state.update((status, since))
        yield pd.DataFrame({"id": [key[0]], "status": [status], "since": [since]})


def states(steps: DataFrame) -> DataFrame:
    """(id, status, since): a row each time an order's state changes."""
    return steps.groupBy("id").applyInPandasWithState(_advance, OUT, STATE, "append", "NoTimeout")
