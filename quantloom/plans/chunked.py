"""Features of long series in parallel: a series is cut into chunks of time, each with the rows before (and after) that it needs.

A window over a series is one task, however long the series is. An operator that looks back (or ahead) a known number of rows
needs no more than that: it runs on every chunk together with as many neighbouring rows, and only the chunk's own rows are
kept. Which neighbours a chunk needs is worked out on counts per chunk, a table of symbols times chunks; rows are copied only
to the chunks that need them. So one symbol with a third of all rows is spread like all others.

Exponential means look back without end, but rows further back than about ``40 / -ln(1 - alpha)`` have no weight that a double
can show: that many rows (``ewm_lookback``) are enough. Cumulative operators (obv, vwap, drawdown) can't be cut.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import SYMBOL, TIMESTAMP, check_window


def ewm_lookback(span: int) -> int:
    """Rows after which the start of an exponential mean of this span has no weight left."""
    return math.ceil(40 / -math.log(1 - 2 / (span + 1))) + 1 if span > 1 else 1


def _needs(counts: DataFrame, lookback: int, lookahead: int) -> DataFrame:
    """symbol, chunk, target: rows of ``chunk`` are needed by ``target``; decided by the rows that lie between the two."""
    w = Window.partitionBy(SYMBOL).orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.select(SYMBOL, "chunk", F.sum("n").over(w).alias("last"), (F.sum("n").over(w) - F.col("n") + 1).alias("first"))
    a, b = upto.alias("a"), upto.alias("b")
    before = (F.col("a.chunk") < F.col("b.chunk")) & (F.col("a.last") >= F.col("b.first") - lookback)
    after = (F.col("a.chunk") > F.col("b.chunk")) & (F.col("a.first") <= F.col("b.last") + lookahead)
    same = F.col("a.chunk") == F.col("b.chunk")
    return a.join(b, F.col(f"a.{SYMBOL}").eqNullSafe(F.col(f"b.{SYMBOL}")) & (same | before | after)).select(F.col(f"a.{SYMBOL}").alias("__s"), F.col("a.chunk").alias("__c"), F.col("b.chunk").alias("__t"))


def by_chunks(df: DataFrame, transform: Callable[[DataFrame], DataFrame], lookback: int, lookahead: int = 0, every: str | Column = "year") -> DataFrame:
    """``transform(df)`` for an operator whose rows depend on ``lookback`` rows before and ``lookahead`` rows after them, by chunks.

    ``every`` is a unit of ``date_trunc``, or an expression that never falls as time goes on. Columns keep their order.
    """
    if SYMBOL not in df.columns:
        return by_chunks(df.withColumn(SYMBOL, F.lit("")), transform, lookback, lookahead, every).drop(SYMBOL)
    if lookback < 0 or lookahead < 0:
        raise ValueError("lookback and lookahead are numbers of rows")
    check_window(lookback + lookahead + 1)
    chunk = F.date_trunc(every, TIMESTAMP) if isinstance(every, str) else every
    cut = df.withColumn("__chunk", chunk)
    needs = _needs(cut.groupBy(SYMBOL, F.col("__chunk").alias("chunk")).agg(F.count(F.lit(1)).alias("n")), lookback, lookahead)
    given = cut.join(needs, cut[SYMBOL].eqNullSafe(needs["__s"]) & (cut["__chunk"] == needs["__c"]))
    kind = df.schema[SYMBOL].dataType
    marked = given.select(
        *[F.col(f"`{c}`") for c in df.columns if c != SYMBOL], F.concat_ws("\x1f", F.coalesce(F.col(SYMBOL).cast("string"), F.lit("\x00")), F.col("__t").cast("string")).alias(SYMBOL),
        F.col(SYMBOL).alias("__symbol"), (F.col("__chunk") == F.col("__t")).alias("__own"),
    )
    made = transform(marked).filter("__own")
    names = [c for c in made.columns if c not in ("__symbol", "__own")]
    out = made.select(*[F.col("__symbol").cast(kind).alias(SYMBOL) if c == SYMBOL else F.col(f"`{c}`") for c in names])
    return out.select(*df.columns, *[c for c in names if c not in df.columns])
