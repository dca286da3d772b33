"""Burst limits and substring joins against brute force."""

from __future__ import annotations

import random

import pytest

from quarryline.operators import limits, substrings
from quarryline.plans import limits as plans

SF = "/root/testdata/sf0.001"
ZONES = {"a": limits.Zone(1_000_000, 2), "b": limits.Zone(300_000, 0)}


def brute(rows):
    """One bucket per zone and key, request by request, its level in requests as a fraction."""
    from fractions import Fraction

    state, out = {}, {}
    for i, key, at, zone in sorted((r for r in rows if None not in r and r[3] in ZONES), key=lambda r: (r[2], r[0])):
        z = ZONES[zone]
        level, last = state.get((zone, key), (Fraction(0), at))
        level = max(Fraction(0), level - Fraction(at - last, z.period_us))
        fits = level <= z.burst
        if fits:
            level += 1
        state[zone, key] = (level, at)
        out[i] = (fits, int(level * z.period_us))
    return {r[0]: out.get(r[0], (True, None)) for r in rows}


def requests(seed):
    rng = random.Random(seed)
    rows, at = [], 0
    for i in range(900):
        at += rng.choice([0] * 30 + [1, 50_000, 200_000, 299_999, 300_000] * 2 + [3_000_000, 9_000_000])
        rows.append((i, rng.choice([1, 1, 1, 2, 3, None]), rng.choice([at] * 30 + [None]), rng.choice(["a", "a", "b", "c", None])))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_buckets(spark, seed):
    rows = requests(seed)
    frame = spark.createDataFrame(rows, "id long, key long, us long, zone string").selectExpr("id", "key", "timestamp_micros(us) AS at", "zone", "'own' AS _run_of").repartition(5)
    got = {r.id: (r.allowed, r.level_us) for r in limits.burst_limited(frame, ZONES, "zone", "key", "at", "id").collect()}
    want = brute(rows)
    assert got == want and 30 < sum(not ok for ok, _ in want.values())


def test_runs_split_a_busy_key(spark):
    """A key's time line is cut at its pauses and nowhere else."""
    frame = spark.createDataFrame([(i, 1, i // 3 * 3_000_000 + i % 3, "a") for i in range(60)], "id long, _key long, _at long, _zone string")
    runs = {r._run for r in limits.with_runs(frame, ZONES).collect()}
    assert len(runs) == 1
    frame = spark.createDataFrame([(i, 1, i // 3 * 3_000_003 + i % 3, "a") for i in range(60)], "id long, _key long, _at long, _zone string")
    assert len({r._run for r in limits.with_runs(frame, ZONES).collect()}) == 20


def test_no_requests(spark):
    frame = spark.createDataFrame([], "id long, key long, at timestamp, zone string")
    assert limits.burst_limited(frame, ZONES, "zone", "key", "at", "id").count() == 0


def test_some_events_are_refused(spark):
    rows = plans.burst_limit(spark, SF).collect()
    assert {r.zone for r in rows if not r.allowed} == {"api", "chat"} and len(rows) == spark.read.parquet(f"{SF}/events.parquet").count()


@pytest.mark.parametrize("q", [1, 2, 4, 7])
def test_substrings(spark, q):
    rng = random.Random(q)
    letters = "aab\n é漢😀"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    texts = [(i, text(rng.randint(0, 60))) for i in range(120)] + [(900, None), (None, "aab"), (901, ""), (902, text(4000))]
    patterns = [text(rng.randint(0, 9)) for _ in range(150)] + [None, "", "nowhere at all", "aab", "aab"]
    got = substrings.containing(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(p,) for p in patterns], "p string"), ["id"], pattern="p", q=q)
    want = {(i, p) for i, t in texts for p in patterns if t is not None and p is not None and p in t}
    rows = [(r.id, r.pattern) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


@pytest.mark.parametrize("few", [0, 100_000])
def test_substrings_of_few_and_many_patterns(spark, monkeypatch, few):
    """Both ways give the same, also for characters beyond the first plane; with few patterns no gram becomes a row."""
    monkeypatch.setattr(substrings, "FEW", few)
    texts = [(1, "a😀bcde"), (2, "bcd"), (3, "e酒后驾驶"), (4, None), (5, ""), (6, "abcabcabcd" * 9), (7, "xa")]
    patterns = ["😀b", "bcde", "bcd", "cdea", "酒后驾驶", "驾", "", "abcabcd", "dabca", None, "de", "ex", "abcabcabcdabcabcabcdab"]
    got = substrings.containing(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(p,) for p in patterns], "pattern string"), ["id"])
    want = sorted((i, p) for i, t in texts for p in patterns if t is not None and p is not None and p in t)
    assert sorted((r.id, r.pattern) for r in got.collect()) == want
    assert ("Generate" in got._jdf.queryExecution().executedPlan().toString()) == (few == 0)


def test_no_nested_loop(spark):
    """The audit's plan has no join that compares all with all, whatever Spark may broadcast."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for size in ("-1", "10m"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
            plan = plans.conversation_audit(spark, SF)._jdf.queryExecution().executedPlan().toString()
            assert "NestedLoop" not in plan and "Cartesian" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
