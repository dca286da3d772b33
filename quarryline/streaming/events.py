"""Event streams: merging of small text events, counts per window and day, replay."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

#: Characters, and milliseconds since the last flush, at which a buffer is flushed.
MERGE_CHARS, MERGE_MS = 6, 16
TEXT_KINDS = ("delta", "reasoning")
MERGED = "array<struct<kind:string,content:string>>"


def merged_events(events: Column, chars: int = MERGE_CHARS, wait_ms: int = MERGE_MS) -> Column:
    """A session's events, an array of (at_ms, kind, content) in order, with neighbouring texts of one kind merged:
    a buffer goes out when it is long enough, when time has passed since the last flush, when another kind comes,
    and at the end. Order and concatenated text stay."""
    start = F.struct(F.array().cast(MERGED).alias("out"), F.lit(None).cast("string").alias("kind"), F.lit("").alias("text"), F.lit(None).cast("long").alias("flushed"))

    def emit(out: Column, kind: Column, text: Column) -> Column:
        return F.when(kind.isNull(), out).otherwise(F.concat(out, F.array(F.struct(kind.alias("kind"), text.alias("content")))))

    def step(s: Column, e: Column) -> Column:
        at = e["at_ms"]
        flushed = F.coalesce(s["flushed"], at)
        content = F.coalesce(e["content"], F.lit(""))
        is_text = e["kind"].isin(*TEXT_KINDS)
        switch = s["kind"].isNotNull() & (s["kind"] != e["kind"])
        base = F.when(switch | ~is_text, emit(s["out"], s["kind"], s["text"])).otherwise(s["out"])
        text = F.when(switch | s["kind"].isNull(), content).otherwise(F.concat(s["text"], content))
        since = at - F.when(switch, at).otherwise(flushed)
        full = (F.char_length(text) >= chars) | ((F.char_length(text) >= 1) & (since >= wait_ms))
        none = F.lit(None).cast("string")
        after_text = F.struct(
            F.when(full, emit(base, e["kind"], text)).otherwise(base).alias("out"), F.when(full, none).otherwise(e["kind"]).alias("kind"),
            F.when(full, "").otherwise(text).alias("text"), F.when(full | switch, at).otherwise(flushed).alias("flushed"),
        )
        after_other = F.struct(emit(base, e["kind"], content).alias("out"), none.alias("kind"), F.lit("").alias("text"), at.alias("flushed"))
        return F.when(is_text, after_text).otherwise(after_other)

    return F.aggregate(events, start, step, lambda s: emit(s["out"], s["kind"], s["text"]))


#: Kind and text of the open buffer (None and "" if there is none), and the time of the last flush.
Buffer = tuple[str | None, str, int | None]


def taken_in(buffer: Buffer, at: int, kind: str, content: str, chars: int = MERGE_CHARS, wait_ms: int = MERGE_MS) -> tuple[Buffer, list[tuple[str, str]]]:
    """The buffer after an event, and what went out. A text of the buffer's kind is added to it; anything else closes
    it first. What is no text goes out at once; a buffer goes out when it is long or old enough."""
    held, text, flushed = buffer
    flushed = at if flushed is None else flushed
    fits = kind in TEXT_KINDS and held in (None, kind)
    out = [] if fits or held is None else [(held, text)]
    if kind not in TEXT_KINDS:
        return (None, "", at), [*out, (kind, content)]
    text, flushed = (text + content, flushed) if fits else (content, at)
    due = len(text) >= chars or (text != "" and at - flushed >= wait_ms)
    return ((None, "", at), [*out, (kind, text)]) if due else ((kind, text, flushed), out)


def merged_sessions(events: DataFrame, session: str, order: list[str], chars: int = MERGE_CHARS, wait_ms: int = MERGE_MS) -> DataFrame:
    """The same over rows (session, order columns, at_ms, kind, content), to (session, pos, kind, content). Rows pass
    in order with one buffer as the state, so a session of any length takes linear time and no array holds it."""
    kind_of = events.schema[session].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, buffer, pos = (), (None, "", None), 0
        out: list[tuple] = []

        def emit(rows: list[tuple[str, str]]) -> None:
            nonlocal pos
            for kind, content in rows:
                out.append((now[0], pos, kind, content))
                pos += 1

        def batch(types: pa.Schema) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * 4
            made = [types.field(session).type, pa.int64(), pa.string(), pa.string()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, made, strict=True)], names=[session, "pos", "kind", "content"])

        types = None
        for rows in batches:
            types = rows.schema
            for own, at, kind, content in zip(*(rows.column(c).to_pylist() for c in (session, "at_ms", "kind", "content")), strict=True):
                if now != (own,):
                    emit([buffer[:2]] if buffer[0] is not None else [])
                    now, buffer, pos = (own,), (None, "", None), 0
                buffer, gone = taken_in(buffer, at, kind, content or "", chars, wait_ms)
                emit(gone)
            yield batch(types)
        if buffer[0] is not None:
            emit([buffer[:2]])
            yield batch(types)

    rows = events.repartition(session).sortWithinPartitions(session, *order, "at_ms", "kind", "content")
    return rows.select(session, "at_ms", "kind", "content").mapInArrow(run, f"`{session}` {kind_of}, pos long, kind string, content string")


class Merger(StatefulProcessor):
    """Holds a session's buffer between batches. A timer ``idle_ms`` behind the session's last event flushes it by
    event time, so a stream that ends with a later event leaves no buffer behind."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("buffer", "kind string, text string, flushed long, timer long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kind, text, flushed, timer = self.state.get() if self.state.exists() else (None, "", None, None)
        buffer: Buffer = (kind, text, flushed)
        frame = pd.concat(list(rows)).sort_values(["ts", "seq"])
        out, at = [], 0
        for ts, new, content in zip(frame["ts"], frame["kind"], frame["content"].fillna(""), strict=True):
            at = int(ts.timestamp() * 1000)
            buffer, gone = taken_in(buffer, at, new, content)
            out += gone
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = at + self.idle_ms if buffer[0] is not None else None
        if timer is not None:
            self.handle.registerTimer(timer)
        self.state.update((*buffer, timer))
        yield self._rows(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kind, text, *_ = self.state.get()
        self.state.clear()
        yield self._rows(key, [(kind, text)] if kind is not None else [])

    def close(self) -> None:
        pass

    @staticmethod
    def _rows(key: tuple, out: list[tuple[str, str]]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *o) for o in out], columns=["session_id", "kind", "content"])


def merged_stream(events: DataFrame, delay: str = "1 minute", idle_ms: int = 60_000) -> DataFrame:
    """The same over a stream (session_id, ts, seq, kind, content) with ``delay`` as its watermark. Needs the RocksDB
    state store (spark.sql.streaming.stateStore.providerClass)."""
    rows = events.withWatermark("ts", delay).groupBy("session_id")
    return rows.transformWithStateInPandas(Merger(idle_ms), "session_id string, kind string, content string", "append", "EventTime")


def windowed_counts(events: DataFrame, window: str = "60 seconds", delay: str = "10 minutes") -> DataFrame:
    """Requests per user and window; late rows count up to the delay."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(F.window("ts", window), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("window.start").alias("start"), "n")


def daily_counts(events: DataFrame, delay: str = "1 day") -> DataFrame:
    return windowed_counts(events, "1 day", delay)


def replay(spark: SparkSession, path: str, schema: str, plan, checkpoint: str, out: str, mode: str = "append", files_a_batch: int = 1000) -> DataFrame:
    """Runs a streaming plan over all files of a folder, once, into Parquet, and reads the result."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)
    running = plan(source).writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.parquet(out)


def replayed_updates(spark: SparkSession, path: str, schema: str, plan, key: list[str], at: str, files_a_batch: int = 2) -> DataFrame:
    """Runs a streaming aggregate in update mode over all files of a folder, a few a batch, and keeps the last update
    of each key. A batch overwrites its own folder, so one that is run again leaves no trace."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{at}/updates/batch={batch}")

    running = plan(source).writeStream.outputMode("update").option("checkpointLocation", f"{at}/checkpoint").foreachBatch(write).trigger(availableNow=True).start()
    running.awaitTermination()
    updates = spark.read.parquet(f"{at}/updates")
    others = [c for c in updates.columns if c not in (*key, "batch")]
    last = updates.groupBy(*key).agg(F.max_by(F.struct(*others), "batch").alias("_last"))
    return last.select(*key, "_last.*")


def ndjson(events: DataFrame) -> DataFrame:
    """(session_id, seq, line): each event as a JSON line, in order of the cursor."""
    return events.select("session_id", "seq", F.to_json(F.struct("kind", "content")).alias("line"))


def read_from(events: DataFrame, cursors: DataFrame) -> DataFrame:
    """Events at and after each session's cursor (session_id, cursor)."""
    return events.join(cursors, "session_id").filter(F.col("seq") >= F.col("cursor")).drop("cursor")
