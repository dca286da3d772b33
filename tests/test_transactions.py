"""Commits, ledgers and their streams: atomicity, conflicts, failures, restarts."""

from __future__ import annotations

import random
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quarryline.sources import ledger
from quarryline.sources.commits import Commits, Conflict

SCHEMA = "k long, a string, n long"


def test_one_writer_gets_a_number(tmp_path):
    """Of many writers at one number one wins; append gives each a number of its own, without gaps."""
    log, won = Commits(str(tmp_path)), []

    def attempt(i):
        try:
            Commits(str(tmp_path)).create(1, {"writer": i})
            won.append(i)
        except Conflict:
            pass

    threads = [threading.Thread(target=attempt, args=(i,)) for i in range(12)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and log.read(1) == {"writer": won[0]}
    threads = [threading.Thread(target=lambda i=i: log.append(lambda n: {"writer": i, "n": n})) for i in range(12)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert log.numbers() == list(range(1, 14)) and all(log.read(n)["n"] == n for n in range(2, 14))
    assert {log.read(n)["writer"] for n in range(2, 14)} == set(range(12))
    assert not list(Path(tmp_path, "_commits").glob(".*")), "no temporary file is left"


def replayed(rounds):
    """What rows of keys become, one by one."""
    rows = {}
    for op, changes in rounds:
        before = dict(rows)
        for k, a, n in changes:
            if op == "replace":
                best = max((r for r in changes if r[0] == k), key=lambda r: (r[1] is not None, r[1] or "", r[2] is not None, r[2] or 0))
                rows[k] = best[1:]
            elif k in before and op == "update":
                rows[k] = (rows[k][0] if a is None else a, rows[k][1] if n is None else n)
            elif k in before and op == "add" and n is not None:
                rows[k] = (rows[k][0], (rows[k][1] or 0) + n)
    return {(k, *v) for k, v in rows.items()}


@pytest.mark.parametrize("seed", range(3))
def test_random_rounds(spark, tmp_path, seed):
    rng = random.Random(seed)
    rounds = []
    for i in range(7):
        op = "replace" if i == 0 else rng.choice(["replace", "update", "add", "add"])
        keys = [rng.randint(0, 15) for _ in range(8)]
        keys = keys if op != "update" else list(set(keys))
        rounds.append((op, [(k, rng.choice([None, "x", "y", f"v{i}"]), rng.choice([None, 0, 5, 100 * i])) for k in keys]))
    root = f"file://{tmp_path}/l"
    for i, (op, changes) in enumerate(rounds):
        ledger.write(spark.createDataFrame(changes, SCHEMA).repartition(3), root, op, ["k"])
        assert {tuple(r) for r in ledger.state(spark, root, SCHEMA, ["k"]).collect()} == replayed(rounds[: i + 1]), (i, op)
    for version in (1, 4):
        assert {tuple(r) for r in ledger.state(spark, root, SCHEMA, ["k"], version).collect()} == replayed(rounds[:version])


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/l"
    ledger.write(spark.createDataFrame([(1, "a", 1)], SCHEMA), root, "replace", ["k"])
    files = sorted(p.name for p in Path(tmp_path, "l/data").iterdir())
    rows = spark.range(4000).repartition(8).select(F.col("id").alias("k"), F.lit("b").alias("a"), F.when(F.col("id") < 3999, 2).otherwise(F.raise_error(F.lit("on purpose"))).cast("long").alias("n"))
    with pytest.raises(Exception, match="on purpose"):
        ledger.write(rows, root, "replace", ["k"])
    assert [tuple(r) for r in ledger.state(spark, root, SCHEMA, ["k"]).collect()] == [(1, "a", 1)]
    assert Commits(root).numbers() == [1] and sorted(p.name for p in Path(tmp_path, "l/data").iterdir()) == files
    # What a lost task would leave belongs to no commit.
    spark.createDataFrame([(2, "orphan", 0)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/data")
    assert ledger.state(spark, root, SCHEMA, ["k"]).count() == 1


def test_wrong_writes(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 1)], SCHEMA)
    for op, key in (("upsert", ["k"]), ("update", [])):
        with pytest.raises(Exception, match="op is one of"):
            ledger.write(rows, f"file://{tmp_path}/l", op, key)
    with pytest.raises(Exception, match="never overwritten"):
        rows.write.format(ledger.NAME).mode("overwrite").option("path", f"file://{tmp_path}/l").option("op", "append").save()


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    """Appends of several files each, a sink that fails once, a restart: every row once, in the log's order."""
    root, at = f"file://{tmp_path}/log", f"file://{tmp_path}/checkpoint"
    seen: list[list[int]] = []
    failing = [2]

    def sink(batch, number):
        rows = sorted((r.row_number, r.v) for r in batch.collect())
        if number == failing[0]:
            failing[0] = -1
            raise RuntimeError("stopped half way")
        seen.append(rows)

    for i in range(4):
        ledger.write(spark.range(100 * i, 100 * (i + 1), 1, 3).selectExpr("id AS v"), root, "append")
        start = lambda: ledger.replay(spark, root, 30).writeStream.foreachBatch(sink).option("checkpointLocation", at).trigger(availableNow=True).start()
        try:
            start().awaitTermination()
        except Exception as e:
            assert "stopped half way" in str(e)
            start().awaitTermination()
    flat = [r for batch in seen for r in batch]
    assert flat == [(v, v) for v in range(30, 400)] and len(seen) >= 4


def test_empty_append(spark, tmp_path):
    root = f"file://{tmp_path}/log"
    rows = spark.range(5).selectExpr("id AS v")
    ledger.write(rows, root, "append")
    ledger.write(rows.limit(0), root, "append")
    ledger.write(rows, root, "append")
    log = Commits(root)
    assert [(log.read(n)["start"], log.read(n)["end"]) for n in log.numbers()] == [(0, 5), (5, 5), (5, 10)]


def test_replay_takes_every_turn(spark, tmp_path):
    """Turns without a conversation's number or their own come last, and none is lost between the two halves."""
    import duckdb

    from quarryline.plans import catalog

    rows = [(c, t, "user", f"w{c} x{t} y\t z") for c in (*range(40), None) for t in (0, 1, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = [tuple(r) for r in catalog.QUERIES["x2_log_replay"](spark, str(tmp_path)).collect()]
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = duck.execute(catalog.ORACLES["x2_log_replay"]).fetchall()
    assert len(got) == 41 * 3 * 4 - 100
    assert sorted(got, key=repr) == sorted(want, key=repr)
