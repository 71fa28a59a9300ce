"""Short texts about a bar table. Only aggregates, a few names and a bounded number of rows reach the driver."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from datetime import date, datetime
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions.windows import SYMBOL, TIMESTAMP, TRADING_DAYS, change
from ..operators import profiler

#: Characters that a token is taken to have.
_PER_TOKEN = 4
#: Names that a text lists, and rows that a question for everything gets at most.
MOST_NAMES, MOST_ROWS = 10, 10_000


def last_rows(df: DataFrame, n: int) -> list[Row]:
    """The last ``n`` rows in time, in order; a top-n, not a sort of everything."""
    by = [c for c in (TIMESTAMP, SYMBOL) if c in df.columns]
    return df.orderBy(*[F.col(c).desc() for c in by]).limit(n).collect()[::-1] if by else df.limit(n).collect()


def first_rows(df: DataFrame, n: int) -> list[Row]:
    by = [c for c in (TIMESTAMP, SYMBOL) if c in df.columns]
    return (df.orderBy(*by) if by else df).limit(n).collect()


def _names(df: DataFrame, n: int) -> str:
    """Of ``n`` symbols, the first few in order."""
    found = [str(r[0]) for r in df.select(SYMBOL).distinct().orderBy(SYMBOL).limit(MOST_NAMES).collect()]
    return ", ".join(found) + (f" and {n - len(found)} more" if n > len(found) else "")


def _newest(rows: list[Row], column: str) -> Any:
    return next((r[column] for r in reversed(rows) if r[column] is not None), None)


def _readings(df: DataFrame, rows: list[Row], price: float | None) -> list[str]:
    """What the newest values of indicators say, for those that the table has."""
    at = {c: _newest(rows, c) for c in ("rsi_14", "sma_50", "macd_line", "macd_signal") if c in df.columns}
    out = []
    if (x := at.get("rsi_14")) is not None:
        zone = "high" if x >= 70 else "low" if x <= 30 else "mid-range"
        out.append(f"rsi_14 {x:.1f}, {zone}")
    if price is not None and (x := at.get("sma_50")):
        out.append(f"{abs(price / x - 1):.1%} {'over' if price >= x else 'under'} sma_50")
    if at.get("macd_line") is not None and at.get("macd_signal") is not None:
        gap = at["macd_line"] - at["macd_signal"]
        out.append(f"macd {abs(gap):.4f} {'over' if gap >= 0 else 'under'} its signal")
    return out


def summarize(df: DataFrame, max_tokens: int | None = None, include_profile: bool = False) -> str:
    """Span, prices, changes over 1, 5 and 21 rows, volatility, indicators that are there, volume; one aggregate and the last 22 rows."""
    has = set(df.columns)
    stats = {"n": F.count(F.lit(1))}
    if TIMESTAMP in has:
        stats |= {"start": F.min(TIMESTAMP), "end": F.max(TIMESTAMP)}
    if SYMBOL in has:
        stats["symbols"] = F.count_distinct(SYMBOL)
    if "close" in has:
        stats |= {"low": F.min("close"), "high": F.max("close")}
        if TIMESTAMP in has:
            stats["dev"] = F.stddev_samp("__ret")
    if "volume" in has:
        stats["volume"] = F.avg("volume")
    given = df.withColumn("__ret", change(df, "close")) if "dev" in stats else df
    x = given.agg(*[c.alias(k) for k, c in stats.items()]).first().asDict()
    rows = last_rows(df, 22)
    title = _names(df, x["symbols"]) if SYMBOL in has else "Unnamed series"
    span = f" from {x['start']} to {x['end']}" if TIMESTAMP in has else ""
    text = [f"{title}: {x['n']} rows{span}"]
    price = rows[-1]["close"] if "close" in has and rows else None
    if price is not None:
        text.append(f"close {price:.2f}, between {x['low']:.2f} and {x['high']:.2f}")
        moves = [f"{(price / then - 1):+.2%} over {k}" for k in (1, 5, 21) if len(rows) > k and (then := rows[-1 - k]["close"])]
        if moves:
            text.append("change in rows: " + ", ".join(moves))
        if x["n"] > 20 and x.get("dev") is not None:
            text.append(f"volatility {x['dev'] * TRADING_DAYS**0.5:.1%} a year")
    text += _readings(df, rows, price)
    if x.get("volume") and rows and rows[-1]["volume"] is not None:
        text.append(f"volume {rows[-1]['volume']:,.0f}, {rows[-1]['volume'] / x['volume']:.2f} of its mean")
    if include_profile:
        text.append(profiler.profile_summary(df))
    whole = "\n".join(text)
    if max_tokens is not None and len(whole) > max_tokens * _PER_TOKEN:
        return whole[: max_tokens * _PER_TOKEN] + "..."
    return whole


class _Topic:
    """What a question may be about: beginnings of words that show it, how many of the last rows answer it (None: no say), and which columns."""

    def __init__(self, stems: str, rows: int | None = None, columns: str = ""):
        self.stems, self.rows, self.columns = tuple(stems.split()), rows, re.compile(columns) if columns else None

    def asked(self, words: Iterable[str]) -> bool:
        return any(w.startswith(self.stems) for w in words)


#: The first topic of a question that says how many rows settles it; the columns of all of its topics are shown.
_TOPICS = [
    _Topic("everything whole complete histor entire", MOST_ROWS),
    _Topic("newest latest recent last today now current", 10),
    _Topic("against compar relative versus vs correlat", 21),
    _Topic("trend direction moving momentum uptrend downtrend", 30, r"^(sma|ema|momentum|roc|macd|rsi)_"),
    _Topic("risk volatil swing drawdown loss", 60, r"^(atr_|drawdown|max_drawdown|rolling_std|rolling_vol)"),
    _Topic("volume liquid turnover trading", None, r"^(volume|obv|vwap|mfi_)"),
    _Topic("rsi overbought oversold", None, r"^rsi_"),
    _Topic("macd crossover cross", None, r"^macd_"),
    _Topic("bollinger band squeez", None, r"^bb_"),
    _Topic("return gain perform profit", None, r"returns"),
]
#: Rows for a question of no such topic.
_ROWS = 20


def _plain(v: Any) -> Any:
    return v.isoformat() if isinstance(v, (date, datetime)) else v


def _markdown(columns: list[str], rows: list[Row], most: int) -> str:
    """A table of as many rows as ``most`` characters hold, with a note on the others."""
    line = lambda cells: "| " + " | ".join(cells) + " |"
    shown = lambda v: "" if v is None else format(v, ".4f") if isinstance(v, float) else str(v)
    out, left = [line(columns), line(["---"] * len(columns))], most
    left -= sum(len(x) + 1 for x in out)
    for k, r in enumerate(rows):
        text = line(map(shown, r))
        left -= len(text) + 1
        if left < 0:
            return "\n".join([*out, f"({len(rows) - k} more rows)"])
        out.append(text)
    return "\n".join(out)


def context(df: DataFrame, query: str, max_tokens: int = 500, format: str = "markdown") -> str:
    """The rows and columns that a question asks for, as a markdown table, JSON or plain text. A question for everything gets the first ``MOST_ROWS`` rows at most."""
    words = re.findall(r"[a-z]+", query.lower())
    topics = [t for t in _TOPICS if t.asked(words)]
    n = next((t.rows for t in topics if t.rows is not None), _ROWS)
    base = [c for c in (TIMESTAMP, SYMBOL, "close") if c in df.columns]
    more = [c for c in df.columns if c not in base and any(t.columns is not None and t.columns.search(c) for t in topics)]
    if not more and len(base) < 3:
        more = [c for c in ("open", "high", "low", "volume") if c in df.columns]
    columns = base + more or df.columns
    few = df.select(*[F.col(f"`{c}`") for c in columns])
    rows = first_rows(few, n) if n == MOST_ROWS else last_rows(few, n)
    if format == "json":
        return json.dumps([{c: _plain(r[c]) for c in columns} for r in rows], indent=2)
    if format == "markdown":
        return _markdown(columns, rows, max_tokens * _PER_TOKEN)
    return "\n".join(["\t".join(columns), *("\t".join(str(_plain(v)) for v in r) for r in rows)])


def schema(df: DataFrame) -> str:
    """Rows, span, symbols, and a line for each column with its type and its nulls; one aggregate."""
    stats = {"n": F.count(F.lit(1))} | {f"null_{c}": F.count(F.when(F.col(f"`{c}`").isNull(), 1)) for c in df.columns}
    if TIMESTAMP in df.columns:
        stats |= {"start": F.min(TIMESTAMP), "end": F.max(TIMESTAMP)}
    if SYMBOL in df.columns:
        stats["symbols"] = F.count_distinct(SYMBOL)
    x = df.agg(*[c.alias(k) for k, c in stats.items()]).first().asDict()
    text = [f"table of {x['n']:,} rows, {len(df.columns)} columns"]
    if TIMESTAMP in df.columns:
        text.append(f"{TIMESTAMP}: {x['start']} to {x['end']}")
    if SYMBOL in df.columns:
        text.append(f"{x['symbols']} symbols: {_names(df, x['symbols'])}")
    for f in df.schema:
        holes = x[f"null_{f.name}"]
        text.append(f"- {f.name}: {f.dataType.simpleString()}" + (f", {holes} null ({holes / x['n']:.0%})" if holes else ""))
    return "\n".join(text)
