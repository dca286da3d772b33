"""Repair of conversations against a search through all cheap edits."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from quarryline.llm import conversations

SF = "/root/testdata/sf0.001"
GOOD = re.compile(r"(s?(ua)+)?\Z")


def brute_damage(rows):
    """(conv_id, turn, role, text) after damage."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if harm == 0:
            continue
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        out += [(conv, turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    return out


def brute_faults(rows):
    seen, out = set(), []
    for role, text in rows:
        full = text.strip(" \t\n\r\x0b\x0c")
        fault = "blank" if not full else "duplicate" if (role, text) in seen else "truncated" if full[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(fault)
    return out


def prefix_is_good(initials):
    return re.fullmatch(r"s?(ua)*u?", initials) is not None


def brute_repair(rows, found):
    """The cheapest edits, and the least audit of them: all partial repairs by cost, then audit."""
    heap, seen = [(0, "", 0, ())], set()
    while heap:
        cost, audit, at, out = heapq.heappop(heap)
        initials = "".join(r[0][:1] or "?" for r in out)
        # The first to come here is the cheapest and least; what may follow depends on the last initial alone.
        if (at, initials[-1:]) in seen:
            continue
        seen.add((at, initials[-1:]))
        if at == len(rows) and GOOD.match(initials):
            return cost, audit, out
        options = [(2, "I", at, (*out, (r, ""))) for r in ("user", "assistant")]
        if at < len(rows):
            role, text = rows[at]
            cut = found[at] == "truncated"
            options.append((3, "D", at + 1, out))
            if found[at] not in ("blank", "duplicate"):
                options.append((cut, "K", at + 1, (*out, (role, text))))
                options += [(2 + cut, "R", at + 1, (*out, (r, text))) for r in ("user", "assistant")]
        for price, edit, after, made in options:
            if prefix_is_good("".join(r[0][:1] or "?" for r in made)):
                heapq.heappush(heap, (cost + price, audit + edit, after, made))


def brute(rows):
    """All columns of the query, by conv_id."""
    out = []
    kept = brute_damage(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in kept if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns = {r[1] for r in own if r[1] is not None}
        pairs = [(r[2], r[3]) for r in own]
        found = brute_faults(pairs)
        initials = [r[:1] for r, _ in pairs]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        cost, audit, repaired = brute_repair(pairs, found)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(out, key=repr)


def made(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def got(rows):
    table = conversations.digests(conversations.damaged(rows))
    assert table.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted(map(tuple, table.collect()), key=repr)


def varied(seed):
    """Short conversations of all kinds of rows, ties and repeats among them."""
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(rng.randint(1, 7)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "usher", "User"])
            text = rng.choice(["Yes.", "No!", "So?", "cut", "cut .\n", " ", None, "\t\x0b", "Ü. ", "a\u0085", "a.\u2028"])
            rows.append((conv, rng.choice([turn, turn, turn, 2 * turn, None, 1]), role, text))
    return rows + rows[:5]


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(conversations, "DEEP", [300, 0, 3][seed])
    monkeypatch.setattr(conversations, "STRETCH", [1_000_000, 60, 1][seed])
    rows = varied(seed)
    assert got(made(spark, rows).repartition(3)) == brute(rows)


def test_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    have = got(made(spark, rows))
    assert have == brute(rows) and len({r[7] for r in have}) > 5


def test_one_long_conversation(spark):
    """It spans all ranges, has the same text at many turns, and a turn on both sides of a border."""
    rows = [(7, t // 3, ("user", "assistant", "system")[t % 3], f"Line {t % 50}.") for t in range(3000)]
    rows += [(8, t, "user" if t % 2 else "assistant", f"Own {t}.") for t in range(40)]
    have = {r[0]: r for r in got(made(spark, rows).repartition(8))}
    kept = brute_damage(rows)
    own = sorted((r for r in kept if r[0] == 7), key=lambda r: (r[1], r[2], r[3]))
    found = brute_faults([(r[2], r[3]) for r in own])
    turns = {r[1] for r in own}
    assert have[7][1:5] == (max(turns) - min(turns) + 1 - len(turns), *(found.count(f) for f in ("blank", "duplicate", "truncated")))
    letters = "".join(conversations.LETTERS[{"": 0, "truncated": 4, "blank": 8, "duplicate": 12}[f] + "sua".index(r[2][0])] for r, f in zip(own, found, strict=True))
    assert (have[7][6], have[7][7]) == conversations.Solver().solve(letters)
    lines = list(conversations.replayed(iter([(r[2], r[3]) for r in own]), have[7][7]))
    assert GOOD.match("".join(r[0] for r, _ in lines))
    assert have[7][8] == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()


def test_recursion_and_places_agree(monkeypatch):
    rng = random.Random(4)
    for _ in range(200):
        signature = "".join(rng.choice(conversations.LETTERS) for _ in range(rng.randint(0, 40)))
        solver = conversations.Solver()
        assert solver.solve(signature) == solver._long(signature)


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Again."), (2, 5, None, None)]
    table = conversations.repaired(conversations.damaged(made(spark, rows))).collect()
    assert {r.conv_id for r in table if r.place is None} == {1, 2}
    pairs = [(r[2], r[3]) for r in sorted(r for r in brute_damage(rows) if r[0] == 1)]
    want = list(brute_repair(pairs, brute_faults(pairs))[2])
    assert sorted((r.place, r.role, r.text) for r in table if r.conv_id == 1 and r.place is not None) == [(i, *p) for i, p in enumerate(want)]


def test_clashing_columns_and_empty_table(spark):
    rows = made(spark, [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yo.")])
    odd = rows.selectExpr("*", "1 AS part", "2 AS letter", "3 AS audit", "4 AS prefix", "5 AS gone")
    assert got(odd) == got(rows)
    assert got(rows.limit(0)) == []
