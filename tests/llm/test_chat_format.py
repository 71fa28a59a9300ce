import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quantloom.llm import chat_format as cf

from .conftest import SF

SCHEMA = "conv_id long, turn long, role string, text string"


def digest(turns):
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1] or "", (t[2] or "").encode()))
    loss = "".join(t[2] or "" for t in turns if t[1] == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha("".join(f"{t[1] or ''}\n{t[2] or ''}\n" for t in turns)), len(loss), sha(loss)


def random_rows(seed):
    rng = random.Random(seed)
    bits = ["<s>", "</s>", "&", "&lt;", "&amp;", "&nl;", "amp;", "<", "s>", "/s>", "\n", "a", "é😀", " ", "[INST]", ""]
    text = lambda: None if rng.random() < 0.1 else "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
    return [(c if c else None, rng.choice([t, t, 0, None]), rng.choice(["user", "assistant", "system", None, "to</s>ol\nx", "assistant"]), text()) for c in range(25) for t in range(rng.randint(1, 7))]


@pytest.mark.parametrize("seed", range(5))
def test_round_trip(spark, seed):
    rows = random_rows(seed)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"formatted": F.lit("x"), "example": F.lit(1)})
    found = cf.digests(cf.format_conversations(df)).collect()
    got = {r.conv_id: tuple(r)[1:5] for r in found if r.conv_id is not None}
    assert got == {c: digest([r[1:] for r in rows if r[0] == c]) for c in {r[0] for r in rows} - {None}}
    # rows without an id are conversations of their own
    assert sorted(tuple(r)[1:5] for r in found if r.conv_id is None) == sorted(digest([r[1:]]) for r in rows if r[0] is None)


def test_long_conversation_and_rows_without_an_id(spark):
    """A third of the rows in one conversation, a third without an id: the first is one conversation, the others are as many as they are rows."""
    rows = [(7, t, "assistant" if t % 50 == 0 else "user", f"turn {t} </s>") for t in range(1500)] + [(None, t, "assistant", f"lost {t}") for t in range(1500)] + [(100 + t, 0, "user", "x") for t in range(1500)]
    found = cf.digests(cf.format_conversations(spark.createDataFrame(rows, SCHEMA).repartition(8))).collect()
    assert len(found) == 1 + 1500 + 1500 and sum(r.conv_id is None for r in found) == 1500
    long = next(r for r in found if r.conv_id == 7)
    assert tuple(long)[1:5] == digest([r[1:] for r in rows[:1500]])
    c = duckdb.connect()
    c.register("conversations", __import__("pandas").DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64"}))
    want = c.sql(f"SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars FROM ({cf.ORACLE_SQL}) q WHERE conv_id IS DISTINCT FROM -1").fetchall()
    key = lambda t: tuple((x is not None, x) if x is not None else (False, 0) for x in t)
    assert sorted(map(tuple, found), key=key) == sorted(want, key=key)


def test_examples(spark):
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", "hi"), (1, 2, "assistant", "yo </s>"), (1, 3, "user", "more"), (1, 4, "assistant", "ok"), (1, 5, "user", "bye"), (2, 0, "user", "alone")]
    ex = cf.targets(cf.format_conversations(spark.createDataFrame(rows, SCHEMA))).orderBy("conv_id", "example").collect()
    assert [(e.conv_id, e.example, e.n_turns, e.target, e.complete) for e in ex] == [(1, 0, 3, "yo </s>", False), (1, 1, 5, "ok", False), (1, 2, 6, "", True), (2, 0, 1, "", True)]
    assert ex[1].formatted.startswith(ex[0].formatted) and ex[1].formatted[ex[1].loss_start : ex[1].loss_end] == "ok"
    assert ex[0].formatted.count("</s>") == 3


def test_whole_table_equals_its_sql(spark):
    given = spark.read.parquet(f"{SF}/conversations.parquet").unionByName(spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], SCHEMA))
    got = cf.digests(cf.format_conversations(given)).collect()
    c = duckdb.connect()
    c.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = c.sql(f"SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars FROM ({cf.ORACLE_SQL}) q").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 10


def test_only_native_plans(spark):
    df = spark.createDataFrame([(1, 0, "user", "a")], SCHEMA)
    plan = cf.digests(cf.format_conversations(df))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    assert cf.digests(cf.format_conversations(df.filter("conv_id > 5"))).count() == 0
