"""Conversation structure repair: faults as signatures, each distinct signature solved once, its edits replayed.

A conversation is its rows by turn (null first); rows of one turn go by role, then by the first 32 characters of the
text, then by a hash of it. Each row is one letter of the conversation's signature: its role's initial (s, u, a or
another) and its first fault. Blank: no character besides white space. Duplicate: role and text came earlier in the
conversation. Truncated: the last such character is none of ``.!?``.

Repair makes the role initials follow ``(s?(ua)+)?`` at the least cost: Keep 0, Rerole to user or assistant 2, Delete 3
(blank and duplicate rows must go), Insert an empty row of user or assistant 2; a truncated row that stays adds 1. Of
equal costs the audit, the edits' initials in order, is the least in ASCII. Given the rows, the audit says all: after
the optional s, users and assistants alternate, so a reroled or inserted row has the one role that may follow.

Nothing gathers a conversation's texts. Rows are dealt by ranges of (conversation, turn), so a long conversation spans
several tasks, each of which packs its stretch: letters, figures of turns, and the texts as one cell. Only the letters
meet by conversation, one byte a row, as the audit has as well. Distinct signatures meet once each; conversations get
their audits back by signature and one of ``SALTS`` numbers, so a signature that most of them share is dealt out, too.
The replay then streams the packed stretches of each conversation in order. What remains in one task for a
conversation is what its digest asks for, as a sha256 takes its bytes one after another, without holding them.

Duplicates are found by (conversation, role, 128 bits of hashes of the text): the few that occur at two turns at least
mark the later rows; rows equal in all are neighbours.

A null conv_id is a conversation of its own, a null turn comes first, a null role or text counts as one space (as do
null numbers in the damage's key). A conversation whose rows were all dropped keeps its row in the result, with zeros.
An empty table gives none. Other columns aren't looked at, whatever their names. Texts may have any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import shuffle_width

WHITE = r"[\x20\x09-\x0D]"
#: Rows by role initial: fine, truncated, blank, duplicate.
FINE, CUT, BLANK, DOUBLE = "suao", "SUAO", "1234", "5678"
LETTERS = FINE + CUT + BLANK + DOUBLE
#: Where a repaired conversation stands: at its start, behind s, behind u (a must follow), behind a (it may end).
START, LEAD, ASKED, DONE = range(4)
STEP = {START: {"s": LEAD, "u": ASKED}, LEAD: {"u": ASKED}, ASKED: {"a": DONE}, DONE: {"u": ASKED}}
#: The role that a reroled or inserted row takes, and where that leads.
NEW = {START: ("user", ASKED), LEAD: ("user", ASKED), ASKED: ("assistant", DONE), DONE: ("user", ASKED)}
NO_WAY = 1 << 40
#: Bytes of texts that one packed stretch holds, unless one row has more; numbers that a signature is dealt over.
STRETCH = 1_000_000
SALTS = 64
#: Rows up to which the recursion goes through a signature's tails.
DEEP = 300
#: Costs of tails that a worker remembers at most.
MEMO = 200_000


class Solver:
    """Costs of signatures' tails by memoised recursion, shared among signatures; audits from them."""

    def __init__(self):
        self.memo: dict[tuple[str, int], int] = {}

    def ahead(self, tail: str, state: int) -> int:
        """Least cost from ``state`` on, when the next edit isn't an Insert."""
        if not tail:
            return 0 if state in (START, DONE) else NO_WAY
        letter, rest = tail[0], tail[1:]
        best = 3 + self.cost(rest, state)
        if letter in FINE or letter in CUT:
            cut = letter in CUT
            best = min(best, 2 + cut + self.cost(rest, NEW[state][1]))
            after = STEP[state].get(letter.lower())
            if after is not None:
                best = min(best, cut + self.cost(rest, after))
        return best

    def cost(self, tail: str, state: int) -> int:
        found = self.memo.get((tail, state))
        if found is None:
            # Two Inserts in a row reach every state that any number of them does.
            one = NEW[state][1]
            two = NEW[one][1]
            found = min(self.ahead(tail, state), 2 + self.ahead(tail, one), 4 + self.ahead(tail, two))
            self.memo[tail, state] = found
        return found

    def solve(self, signature: str) -> tuple[int, str]:
        """Least cost and the least audit of that cost."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        if len(signature) > DEEP:
            return self._long(signature)
        state, at, audit = START, 0, []
        left = total = self.cost(signature, START)
        while at < len(signature) or left:
            for edit, price, step, after in moves(signature[at : at + 1], state):
                if price + self.cost(signature[at + step :], after) == left:
                    audit.append(edit)
                    left, at, state = left - price, at + step, after
                    break
        return total, "".join(audit)

    def _long(self, signature: str) -> tuple[int, str]:
        """The same recursion over places instead of tails, from the end on, so that it never goes deep."""
        n = len(signature)
        costs = [[0] * 4 for _ in range(n + 1)]
        for at in range(n, -1, -1):
            if at == n:
                ahead = [0 if s in (START, DONE) else NO_WAY for s in range(4)]
            else:
                ahead = [min(price + costs[at + 1][after] for _, price, step, after in moves(signature[at], s) if step) for s in range(4)]
            for s in range(4):
                one = NEW[s][1]
                costs[at][s] = min(ahead[s], 2 + ahead[one], 4 + ahead[NEW[one][1]])
        state, at, audit = START, 0, []
        left = total = costs[0][START]
        while at < n or left:
            for edit, price, step, after in moves(signature[at : at + 1], state):
                if price + costs[at + step][after] == left:
                    audit.append(edit)
                    left, at, state = left - price, at + step, after
                    break
        return total, "".join(audit)


def moves(letter: str, state: int) -> Iterator[tuple[str, int, int, int]]:
    """(initial, price, rows consumed, state after) of the edits that may come next, by initial."""
    if letter:
        yield "D", 3, 1, state
    yield "I", 2, 0, NEW[state][1]
    if letter and (letter in FINE or letter in CUT):
        cut = int(letter in CUT)
        after = STEP[state].get(letter.lower())
        if after is not None:
            yield "K", cut, 1, after
        yield "R", 2 + cut, 1, NEW[state][1]


def faults(signature: str) -> tuple[int, int, int, int]:
    """Blank, duplicate and truncated rows, and neighbours whose initials aren't su, ua or au."""
    kind = [LETTERS.index(c) for c in signature]
    pairs = zip(kind, kind[1:], strict=False)
    illegal = sum((a % 4, b % 4) not in ((0, 1), (1, 2), (2, 1)) for a, b in pairs)
    counts = [sum(k // 4 == f for k in kind) for f in (2, 3, 1)]
    return counts[0], counts[1], counts[2], illegal


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``gone`` of the rows after damage; a dropped row stays as one that is gone, so
    that its conversation is known. By crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2
    removes its ``.!?``, 3 repeats it, 4 makes its role user."""
    space = F.lit(" ")
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text"),
    )
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = rows.withColumn("harm", F.crc32(key.cast("binary")) % 20).withColumn("gone", F.col("harm") == 0)
    text = F.when(F.col("harm") < 2, "").when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text).withColumn("role", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("harm") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", "role", "text", "gone", copies.alias("copy")).drop("copy")


#: What rows go by within a conversation: null turns first.
ORDER = ["conv_id", "has_turn", "turn", "role", "prefix", "one", "two", "is_mark"]


def keyed(rows: DataFrame) -> DataFrame:
    """Rows with the columns that order them, and their letter without duplicates: 0 to 11 in LETTERS, or -1 if gone."""
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    full = F.regexp_replace("text", rf"{WHITE}+\z", "")
    kind = F.when(full == "", 8).when(F.substring(full, -1, 1).isin(".", "!", "?"), 0).otherwise(4)
    return rows.select(
        "conv_id",
        F.col("turn").isNotNull().alias("has_turn"),
        F.coalesce("turn", F.lit(0)).alias("turn"),
        "role",
        F.substring("text", 1, 32).alias("prefix"),
        F.xxhash64("text").alias("one"),
        F.xxhash64(F.lit("second"), "text").alias("two"),
        F.lit(False).alias("is_mark"),
        F.when(F.col("gone"), -1).otherwise(kind + initial).cast("int").alias("letter"),
        "text",
    )


def marks(rows: DataFrame) -> DataFrame:
    """One row without text for each place where a row's role and text came at an earlier turn."""
    narrow = rows.filter("letter BETWEEN 0 AND 7").drop("text", "is_mark", "letter")
    same = ["conv_id", "role", "one", "two"]
    turn = F.struct("has_turn", "turn")
    firsts = narrow.groupBy(*same).agg(F.min(turn).alias("first"), F.max(turn).alias("last")).filter(F.col("first") < F.col("last")).drop("last")
    met = F.struct("n.has_turn", "n.turn") > F.col("f.first")
    for c in same:
        met = met & F.col(f"n.{c}").eqNullSafe(F.col(f"f.{c}"))
    later = narrow.alias("n").join(firsts.alias("f"), met).select("n.*").distinct()
    return later.select(*ORDER[:-1], F.lit(True).alias("is_mark"), F.lit(-2).alias("letter"), F.lit("").alias("text"))


STRETCHES = "conv_id long, part long, number long, letters string, low long, high long, first long, last long, turns long, roles array<string>, texts array<string>"


def stretches(rows: DataFrame) -> DataFrame:
    """Packed stretches of consecutive rows of one conversation: (part, number) orders them; the rows' letters; least,
    greatest, first and last turn that isn't null, and how many distinct ones; roles and texts."""
    rows = keyed(rows)
    dealt = rows.unionByName(marks(rows))
    order = [F.col(c).asc_nulls_first() if c != "is_mark" else F.col(c).desc() for c in ORDER]
    dealt = dealt.repartitionByRange(shuffle_width(rows.sparkSession), *order[:-1]).sortWithinPartitions(*order)
    names = [f.split()[0] for f in STRETCHES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        conv: int | None = None
        begun, held = False, 0
        letters: list[str] = []
        turns: list[int] = []
        roles: list[str] = []
        texts: list[str] = []
        marked = row_before = None

        def packed() -> pa.RecordBatch:
            distinct = [t for i, t in enumerate(turns) if i == 0 or t != turns[i - 1]]
            ends = (distinct[0], distinct[-1]) if distinct else (None, None)
            row = (conv, part, number, "".join(letters), *ends, *ends, len(distinct), roles, texts)
            kinds = [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 5 + [pa.list_(pa.string())] * 2
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

        for batch in batches:
            for c, has, turn, role, prefix, one, two, mark, letter, text in zip(*(batch.column(x).to_pylist() for x in [*ORDER, "letter", "text"]), strict=True):
                if begun and (c != conv or held >= STRETCH):
                    yield packed()
                    number += 1
                    letters, turns, roles, texts, held = [], [], [], [], 0
                if not begun or c != conv:
                    row_before = marked = None
                begun, conv = True, c
                key = (has, turn, role, prefix, one, two)
                if mark:
                    marked = key
                    continue
                if letter < 0:
                    continue
                if letter < 8 and key in (marked, row_before):
                    letter = 12 + letter % 4
                row_before = key
                letters.append(LETTERS[letter])
                if has:
                    turns.append(turn)
                roles.append(role)
                texts.append(text)
                held += len(text) + len(role) + 16
        if begun:
            yield packed()

    return dealt.mapInArrow(run, STRETCHES)


def signatures(packed: DataFrame) -> DataFrame:
    """conv_id, signature, gaps of each conversation."""
    own = F.struct("part", "number", "letters", "first", "last", "turns")
    rows = packed.groupBy("conv_id").agg(F.sort_array(F.collect_list(own)).alias("s"), F.min("low").alias("low"), F.max("high").alias("high"))
    timed = F.filter("s", lambda x: x["turns"] > 0)
    # A turn that goes on in the next stretch was counted in both.
    shared = F.expr("aggregate(zip_with(slice(timed, 1, size(timed) - 1), slice(timed, 2, size(timed)), (a, b) -> if(a.last = b.first, 1L, 0L)), 0L, (n, x) -> n + x)")
    turns = F.aggregate("timed", F.lit(0).cast("long"), lambda n, x: n + x["turns"]) - F.when(F.size("timed") > 1, shared).otherwise(0)
    rows = rows.withColumn("timed", timed)
    gaps = F.when(F.col("low").isNull(), 0).otherwise(F.col("high") - F.col("low") + 1 - turns).cast("long")
    return rows.select("conv_id", F.array_join(F.transform("s", lambda x: x["letters"]), "").alias("signature"), gaps.alias("gaps"))


SOLVED = "signature string, salts array<int>, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def solved(found: DataFrame) -> DataFrame:
    """Figures and audit of each conversation, by way of its signature."""
    found = found.withColumn("salt", F.pmod(F.hash("conv_id"), F.lit(SALTS)))
    distinct = found.select("signature", "salt").distinct().groupBy("signature").agg(F.collect_list("salt").alias("salts"))
    names = [f.split()[0] for f in SOLVED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solver = Solver()
        for batch in batches:
            signature = batch.column("signature").to_pylist()
            rows = [(*faults(s), *solver.solve(s)) for s in signature]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 5 + [pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("signature"), batch.column("salts"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    answers = distinct.mapInArrow(run, SOLVED).withColumn("salt", F.explode("salts")).drop("salts")
    return found.join(answers, ["signature", "salt"]).drop("salt")


def replayed(roles: Iterator[tuple[str, str]], audit: str) -> Iterator[tuple[str, str]]:
    """Role and text of the repaired rows; ``roles`` gives the damaged ones."""
    state = START
    for edit in audit:
        if edit == "I":
            role, state = NEW[state]
            yield role, ""
            continue
        role, text = next(roles)
        if edit == "D":
            continue
        if edit == "R":
            role, state = NEW[state]
        else:
            state = STEP[state][role[0]]
        yield role, text


REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
REPAIRED = f"conv_id long, place long, role string, text string, {', '.join(f'{c} {"string" if c == "audit" else "long"}' for c in REPORT)}"


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired rows, each conversation's together and in order of ``place``; its last row, with place null, has
    its figures and its audit."""
    packed = stretches(rows)
    answers = solved(signatures(packed)).drop("signature")
    # A conversation's answer comes before its stretches.
    texts = packed.select("conv_id", "part", "number", "roles", "texts")
    for c in REPORT:
        texts = texts.withColumn(c, F.lit(None).cast(answers.schema[c].dataType))
    head = answers.withColumns({"part": F.lit(-1).cast("long"), "number": F.lit(0).cast("long"), "roles": F.lit(None).cast("array<string>"), "texts": F.lit(None).cast("array<string>")})
    met = texts.unionByName(head.select(*texts.columns))
    met = met.repartition(shuffle_width(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part", "number")
    names = [f.split()[0] for f in REPAIRED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.string() if c == "audit" else pa.int64() for c in REPORT]

    def incoming(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield batch.slice(i, 1).to_pylist()[0]

    def by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        rows = incoming(batches)
        head = next(rows, None)
        while head is not None:
            following: list[dict | None] = [None]

            def own(following: list = following) -> Iterator[tuple[str, str]]:
                for row in rows:
                    if row["part"] < 0:
                        following[0] = row
                        return
                    yield from zip(row["roles"], row["texts"], strict=True)

            pairs = own()
            place = 0
            for place, (role, text) in enumerate(replayed(pairs, head["audit"]), 1):
                yield head["conv_id"], place - 1, role, text, *(None,) * len(REPORT)
            for _ in pairs:  # rows behind the last edit: there are none, but this reads on to the next conversation
                raise ValueError("an audit must cover all rows")
            yield head["conv_id"], None, None, None, *(head[c] for c in REPORT)
            head = following[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for row in by_conversation(batches):
            out.append(row)
            size += len(row[3] or "") + 64
            if size >= STRETCH:
                yield flush()
                out, size = [], 0
        if out:
            yield flush()

    return met.mapInArrow(run, REPAIRED)


DIGEST = f"conv_id long, {', '.join(f'{c} {"string" if c == "audit" else "long"}' for c in REPORT)}, repaired_sha256 string"


def digests(rows: DataFrame) -> DataFrame:
    """One row per conversation: its figures, its audit, and the sha256 of its repaired ``role:text`` lines, which
    ``repaired`` hands over in order."""
    names = [f.split()[0] for f in DIGEST.split(", ")]
    kinds = [pa.int64()] + [pa.string() if c == "audit" else pa.int64() for c in REPORT] + [pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = hashlib.sha256()
        for batch in batches:
            out = []
            for place, role, text, conv, *figures in zip(*(batch.column(c).to_pylist() for c in ["place", "role", "text", "conv_id", *REPORT]), strict=True):
                if place is None:
                    out.append((conv, *figures, state.hexdigest()))
                    state = hashlib.sha256()
                else:
                    state.update((f"\n{role}:{text}" if place else f"{role}:{text}").encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    return repaired(rows).mapInArrow(run, DIGEST)
