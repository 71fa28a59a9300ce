"""Expression builders shared by all operators: window specs, warm-up guards, null-safe division, exponential means.

Every operator orders explicitly by timestamp within a symbol, so all windows of a chain of operators hash by symbol and one
exchange serves them all. NULL is the only encoding of missing data: no operator makes NaN or infinity, except where a formula
has a defined limit.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SYMBOL, TIMESTAMP = "symbol", "timestamp"
TRADING_DAYS = 252


def as_column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def keys(df: DataFrame) -> list[str]:
    """The partitioning of series: by symbol where the column exists, else the whole frame is one series."""
    return [SYMBOL] if SYMBOL in df.columns else []


def series(df: DataFrame) -> WindowSpec:
    """Rows of a series in time."""
    return Window.partitionBy(*(keys(df) or [F.lit(0)])).orderBy(TIMESTAMP)


def whole(df: DataFrame) -> WindowSpec:
    """All rows of a series, in no order."""
    return Window.partitionBy(*(keys(df) or [F.lit(0)]))


def trailing(df: DataFrame, window: int) -> WindowSpec:
    return series(df).rowsBetween(-(window - 1), 0)


def upto(df: DataFrame) -> WindowSpec:
    return series(df).rowsBetween(Window.unboundedPreceding, 0)


def div(a: Column | float, b: Column) -> Column:
    """``a / b``, NULL where ``b`` is zero."""
    return (a if isinstance(a, Column) else F.lit(float(a))) / F.nullif(b, F.lit(0.0))


def full(agg: Column, of: Column | str, over: WindowSpec, window: int) -> Column:
    """``agg`` once the frame holds ``window`` values of ``of``, NULL before."""
    return F.when(F.count(as_column(of)).over(over) == window, agg.over(over))


def change(df: DataFrame, column: str = "close", periods: int = 1) -> Column:
    """Simple return over ``periods`` rows."""
    return div(F.col(column), F.lag(column, periods).over(series(df))) - 1


def positive_log(x: Column) -> Column:
    """Natural logarithm, NULL where it isn't finite."""
    return F.when(x > 0, F.ln(x))


def check_window(window: int, least: int = 1, name: str = "window") -> int:
    if isinstance(window, bool) or not isinstance(window, int) or window < least:
        raise ValueError(f"{name} must be an integer of {least} at least, not {window!r}")
    return window


def require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def many(x: int | Sequence[int]) -> list[int]:
    return [x] if isinstance(x, int) else list(x)


def add(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.withColumns(columns)


def with_series_stats(df: DataFrame, stats: dict[str, Column]) -> DataFrame:
    """Adds aggregates of each row's whole series. They come from partial aggregates and a join, so a long series isn't gathered in one task as a window would."""
    on = keys(df)
    found = df.groupBy(*[F.col(k).alias(f"__key_{k}") for k in on]).agg(*[c.alias(n) for n, c in stats.items()])
    if not on:
        return df.crossJoin(F.broadcast(found))  # one row
    match = F.col(on[0]).eqNullSafe(F.col(f"__key_{on[0]}"))
    return df.join(found, match, "left").drop(*[f"__key_{k}" for k in on])


#: Exponent up to which a block of an exponential mean is summed: powers stay finite, what is cut off is below e ** -40.
_REACH = 40.0


#: Greatest exponent of a weight within a block, for means that share the block of a longer one.
_SPREAD = 600.0


def _block(alpha: float) -> int:
    """Rows after which the weight of a first value is below e ** -_REACH."""
    return max(1, math.ceil(_REACH / -math.log(1 - alpha)))


def ewm(df: DataFrame, columns: dict[str, tuple[Column | str, int]], alike: Sequence[Sequence[str]] = ()) -> DataFrame:
    """Adds exponential means: name -> (input, span); alpha = 2 / (span + 1), each starting with its first value.

    A null input is skipped: the mean there is NULL and goes on with the next value. The recursion is unrolled in blocks of
    rows whose weights stay finite: within a block it is one cumulative sum, and only the end of the block before still
    counts. So a mean costs window sums over the exchange that the series needs anyway, and no row-by-row loop.

    ``alike``: groups of names whose inputs are null in the same rows. They share ranks and blocks, so one sort serves a group.
    """
    names = list(columns)
    alpha = {n: 2.0 / (check_window(span, 1, "span") + 1.0) for n, (_, span) in columns.items()}
    slow = [n for n in names if alpha[n] < 1]
    size = {n: _block(alpha[n]) for n in slow}
    first = {n: n for n in slow}  # whose ranks and blocks a mean uses
    for group in alike:
        group = [n for n in group if n in size]
        longest = max((size[n] for n in group), default=1)
        if all(longest * -math.log(1 - alpha[n]) <= _SPREAD for n in group):
            first |= {n: group[0] for n in group}
            size |= dict.fromkeys(group, longest)
    tmp = lambda kind, n: f"__{kind}_{n}"
    kept = [c for c in df.columns if c not in names]
    leads = list(dict.fromkeys(first.values()))
    df = df.withColumns({tmp("x", n): as_column(x).cast("double") for n, (x, _) in columns.items()})
    if leads:
        df = df.withColumns({tmp("r", n): F.count(tmp("x", n)).over(upto(df)) - 1 for n in leads})
        block = {n: F.floor(F.greatest(F.col(tmp("r", n)), F.lit(0)) / size[n]).cast("long") for n in leads}
        df = df.withColumns({tmp("b", n): b for n, b in block.items()} | {tmp("p", n): F.col(tmp("r", n)) - b * size[n] for n, b in block.items()})
        local = {}
        for n in slow:
            q, p = 1 - alpha[n], F.col(tmp("p", first[n]))
            weight = F.when(F.col(tmp("r", first[n])) == 0, 1.0).otherwise(alpha[n])
            over = Window.partitionBy(*keys(df), tmp("b", first[n])).orderBy(TIMESTAMP).rowsBetween(Window.unboundedPreceding, 0)
            local[tmp("l", n)] = F.pow(F.lit(q), p) * F.sum(weight * F.col(tmp("x", n)) * F.pow(F.lit(q), -p)).over(over)
        df = df.withColumns(local)
    before = series(df).rowsBetween(Window.unboundedPreceding, -1)
    out = {}
    for n in names:
        x = F.col(tmp("x", n))
        if n not in slow:
            out[n] = x
            continue
        p = F.col(tmp("p", first[n]))
        end = F.last(F.when(x.isNotNull() & (p == size[n] - 1), F.col(tmp("l", n))), ignorenulls=True).over(before)
        out[n] = F.when(x.isNotNull(), F.col(tmp("l", n)) + F.pow(F.lit(1 - alpha[n]), p + 1) * F.coalesce(end, F.lit(0.0)))
    return df.withColumns(out).select(*[F.col(f"`{c}`") for c in kept], *names)
