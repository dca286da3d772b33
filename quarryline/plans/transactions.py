"""Queries over what transactions have written: traces by keyed writes, a log read from a cursor as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import operations as ops
from quarryline.plans import fixtures as fx
from quarryline.plans.operational import token_spans
from quarryline.registry import query
from quarryline.sources import files, ledger
from quarryline.staging import new_path

TRACES = "trace_id string, kind string, user_id long, status string, started_at timestamp_ntz, ended_at timestamp_ntz, llm_tokens long, embedding_tokens long, rerank_tokens long, total_tokens long"
TOKENS = ["llm_tokens", "embedding_tokens", "rerank_tokens", "total_tokens"]


def write_traces(events: DataFrame, root: str) -> None:
    """A trace per user and day: it starts with the day's first event, gathers the tokens of the morning's and of the
    afternoon's, and ends with the last. Then users divisible by three ask once more: their traces start anew, and
    gather the afternoon's tokens again."""
    trace = F.concat_ws("-", "user_id", F.date_format("ts", "yyyyMMdd"))
    rows = events.withColumn("trace_id", trace)
    first = rows.groupBy("trace_id", "user_id").agg(F.min(F.struct("ts", "event_id", "event_type")).alias("f"))
    begun = first.select("trace_id", F.col("f.event_type").alias("kind"), "user_id", F.lit("ok").alias("status"), F.col("f.ts").alias("started_at"), *[F.lit(0).cast("long").alias(c) for c in TOKENS])
    late = F.hour("ts") >= 12
    ended = rows.groupBy("trace_id").agg(F.max("ts").alias("ended_at"), F.max((F.col("event_type") == "error").cast("int")).alias("bad"))
    ended = ended.select("trace_id", F.when(F.col("bad") == 1, "error").alias("status"), "ended_at")
    tokens = lambda own: ops.token_accounting(token_spans(own)).select("trace_id", *TOKENS)
    again = F.col("user_id") % 3 == 0
    for rows_of, op in (
        (begun, "replace"),
        (tokens(events.filter(~late)), "add"),
        (tokens(events.filter(late)), "add"),
        (ended, "update"),
        (begun.filter(again).withColumn("kind", F.lit("again")), "replace"),
        (tokens(events.filter(late & again)), "add"),
    ):
        ledger.write(rows_of, root, op, ["trace_id"])


_NAMES = {"llm_tokens": "view", "embedding_tokens": "click", "rerank_tokens": "purchase"}
_SUMS = ", ".join(f"coalesce(sum(CAST(floor(value) AS BIGINT)) FILTER (WHERE event_type = '{e}' AND (hour(ts) >= 12 OR user_id % 3 > 0)), 0)::BIGINT AS {c}" for c, e in _NAMES.items())


@query("s14_trace_sink", f"""WITH e AS (SELECT *, user_id || '-' || strftime(ts, '%Y%m%d') AS trace_id FROM events)
SELECT trace_id, CASE WHEN any_value(user_id) % 3 = 0 THEN 'again' ELSE arg_min(event_type, (ts, event_id)) END AS kind, any_value(user_id) AS user_id,
  CASE WHEN any_value(user_id) % 3 > 0 AND count(*) FILTER (WHERE event_type = 'error') > 0 THEN 'error' ELSE 'ok' END AS status, min(ts) AS started_at,
  CASE WHEN any_value(user_id) % 3 > 0 THEN max(ts) END AS ended_at, {_SUMS},
  coalesce(sum(CAST(floor(value) AS BIGINT)) FILTER (WHERE event_type IN ('view', 'click', 'purchase') AND (hour(ts) >= 12 OR user_id % 3 > 0)), 0)::BIGINT AS total_tokens
FROM e GROUP BY trace_id""")  # fmt: skip
def trace_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six transactions of traces, and what then stands."""
    root = new_path(spark, "traces")
    write_traces(fx.table(spark, sf_dir, "events"), root)
    return ledger.state(spark, root, TRACES, ["trace_id"])


_SESSIONS = """m AS (SELECT conv_id AS session_id, turn AS message_idx, role, text AS content FROM conversations)"""


@query("s15_session_sink", f"""WITH {_SESSIONS} SELECT session_id, message_idx, CASE WHEN session_id % 4 = 0 THEN 'edited' ELSE md5(content) END AS content, CASE WHEN session_id % 4 = 0 AND message_idx = 0 THEN 'pinned' ELSE role END AS role FROM m""")
def session_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages are saved; some sessions are saved again with other contents, and of those the first message's
    role is changed in place."""
    root = new_path(spark, "sessions")
    m = fx.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("message_idx"), F.md5("text").alias("content"), "role")
    again = m.filter("session_id % 4 = 0")
    key = ["session_id", "message_idx"]
    ledger.write(m, root, "replace", key)
    ledger.write(again.withColumn("content", F.lit("edited")), root, "replace", key)
    ledger.write(again.filter("message_idx = 0").select(*key, F.lit("pinned").alias("role")), root, "update", key)
    return ledger.state(spark, root, "session_id long, message_idx long, content string, role string", key)


#: The reader of the log joins at this word.
CURSOR = 100


def log_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all turns as events of a log."""
    turns = fx.table(spark, sf_dir, "conversations")
    words = F.filter(F.split("text", r"[ \t\n\r\f\x0B]+"), lambda w: w != "")
    return turns.select("conv_id", "turn", F.posexplode(words).alias("pos", "word"))


@query("x2_log_replay", f"""WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS words FROM conversations),
e AS (SELECT conv_id, turn, unnest(range(len(words))) AS pos, unnest(words) AS word FROM w)
SELECT * FROM (SELECT conv_id, turn, pos::INTEGER AS pos, word, row_number() OVER (ORDER BY conv_id, turn, pos) - 1 AS row_number FROM e) WHERE row_number >= {CURSOR}""")  # fmt: skip
def log_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log grows while a stream reads it from a cursor on, and the stream stops and starts again."""
    root = new_path(spark, "log")
    words = log_words(spark, sf_dir)
    # One number for both halves: an approximate one may come out otherwise each time that it is computed.
    low, high = fx.table(spark, sf_dir, "conversations").agg(F.min("conv_id"), F.max("conv_id")).first()
    first = F.coalesce(F.col("conv_id") <= ((low or 0) + (high or 0)) // 2, F.lit(False))
    for half in (first, ~first):
        # As SQL sorts: what has no number comes last.
        ordered = words.filter(half).orderBy(*[F.col(c).asc_nulls_last() for c in ("conv_id", "turn", "pos")])
        ledger.write(ordered, f"{root}/events", "append")
        stream = ledger.replay(spark, f"{root}/events", CURSOR)
        run = stream.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint").option("path", f"{root}/out").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.schema("conv_id long, turn long, pos int, word string, row_number long").parquet(f"{root}/out")


def write_records(events: DataFrame, path: str) -> None:
    """Events as trace records, in two appends. Their attributes nest, and ``value`` is a number, or of errors a text."""
    value = F.when(F.col("event_type") == "error", F.concat(F.lit('"failed at '), F.col("value").cast("string"), F.lit('"'))).otherwise(F.col("value").cast("string"))
    parts = ['{"props": ', F.col("props"), ', "user": {"id": ', F.col("user_id"), ', "tags": ["', F.col("event_type"), '", ', F.col("event_id"), ']}, "value": ', value, F.when(F.col("event_id") % 2 == 0, ', "even": true').otherwise(""), "}"]
    rows = events.select(
        F.lit("event").alias("kind"),
        F.col("user_id").cast("string").alias("trace_id"),
        F.col("event_id").cast("string").alias("span_id"),
        F.lit(None).cast("string").alias("parent_id"),
        F.col("event_type").alias("name"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("start"),
        F.lit(None).cast("double").alias("duration_ms"),
        F.lit("ok").alias("status"),
        F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]).alias("attributes"),
    )
    for half in ("span_id % 3 = 0", "span_id % 3 > 0"):
        files.append_records(rows.filter(half), path)


@query("s13_trace_attributes", """SELECT CAST(event_id AS VARCHAR) AS span_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, user_id, event_type AS tag, event_id AS second_tag,
  CASE WHEN event_type <> 'error' THEN round(value, 6) END AS value, CASE WHEN event_id % 2 = 0 THEN TRUE END AS even FROM events""")  # fmt: skip
def trace_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines appended and read back, attributes by path."""
    path = new_path(spark, "records")
    write_records(fx.table(spark, sf_dir, "events"), path)
    found = files.records(spark, path)
    wanted = {"k": ("$.props.k", "bigint"), "user_id": ("$.user.id", "bigint"), "tag": ("$.user.tags[0]", "string"), "second_tag": ("$.user.tags[1]", "bigint"), "even": ("$.even", "boolean")}
    number = F.when(~F.schema_of_variant(F.try_variant_get("attributes", "$.value", "variant")).isin("STRING"), F.round(files.attribute("$.value", "double"), 6))
    return found.select("span_id", *[files.attribute(*at).alias(c) for c, at in wanted.items()], number.alias("value"))


@query("c32_attribute_kinds", """SELECT attribute, count(*) AS n FROM (
  SELECT unnest(['props', 'user', CASE WHEN event_type = 'error' THEN 'value as text' ELSE 'value as number' END] || CASE WHEN event_id % 2 = 0 THEN ['even'] ELSE [] END) AS attribute FROM events) GROUP BY attribute""")  # fmt: skip
def attribute_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which attributes there are, and of which kind."""
    path = new_path(spark, "records")
    write_records(fx.table(spark, sf_dir, "events"), path)
    found = files.attribute_kinds(files.records(spark, path))
    named = F.when(F.col("attribute") != "value", F.col("attribute")).when(F.col("kind") == "STRING", "value as text").otherwise("value as number")
    return found.groupBy(named.alias("attribute")).agg(F.sum("n").alias("n"))
