"""Queries of sessions, traces, tokens, usage and limits, and of index maintenance."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryline.functions import ids, vectors
from quarryline.operators import index_maintenance as index
from quarryline.operators import ingest
from quarryline.operators import operations as ops
from quarryline.plans import fixtures as fx
from quarryline.registry import literal, query
from quarryline.sources import providers
from quarryline.staging import new_path
from quarryline.streaming import events as stream


@query("a1_trace_rollup", f"WITH {fx.TRACES} SELECT count(*) AS n_traces, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(CASE WHEN cache_hit THEN 1 ELSE 0 END) AS BIGINT) AS cache_hits, round(avg(duration_ms), 2) AS mean_ms FROM traces")
def trace_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1."""
    return ops.trace_rollup(fx.traces(spark, sf_dir))


_TOKENS = """spans AS (
  SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS trace_id, CAST(floor(value) AS BIGINT) AS total, CAST(floor(value / 4) AS BIGINT) AS prompt,
    CASE event_type WHEN 'view' THEN 'llm.tokens' WHEN 'click' THEN 'embedding.tokens' WHEN 'purchase' THEN 'rerank.tokens' ELSE 'other' END AS name FROM events
), sums AS (
  SELECT trace_id, name, sum(total) AS total, sum(prompt) AS prompt FROM spans GROUP BY trace_id, name
) SELECT trace_id, """ + ", ".join(f"coalesce(sum(total) FILTER (WHERE name = '{e}'), 0)::BIGINT AS {c}" for c, e in ops.TOKEN_EVENTS.items()) + """,
  coalesce(sum(prompt) FILTER (WHERE name <> 'other'), 0)::BIGINT AS prompt_tokens, coalesce(sum(total - prompt) FILTER (WHERE name <> 'other'), 0)::BIGINT AS completion_tokens,
  coalesce(sum(total) FILTER (WHERE name <> 'other'), 0)::BIGINT AS total_tokens FROM sums GROUP BY trace_id"""


def token_spans(events: DataFrame) -> DataFrame:
    """Events as token counts of model calls: a trace per user and day, a quarter of an event's value as prompt."""
    kind = F.create_map(*map(F.lit, ("view", "llm.tokens", "click", "embedding.tokens", "purchase", "rerank.tokens")))[F.col("event_type")]
    total, prompt = F.floor("value").cast("long"), F.floor(F.col("value") / 4).cast("long")
    trace = F.concat_ws("-", "user_id", F.date_format("ts", "yyyyMMdd")).alias("trace_id")
    return events.select(trace, F.coalesce(kind, F.lit("other")).alias("name"), prompt.alias("prompt"), (total - prompt).alias("completion"), total.alias("total"))


@query("a2_token_accounting", f"WITH {_TOKENS}")
def token_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2."""
    return ops.token_accounting(token_spans(fx.table(spark, sf_dir, "events")))


@query("x6_stream_tokens", f"WITH {_TOKENS}")
def stream_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sums as a stream in update mode, over files of which a few come at a time; the last update counts."""
    at = new_path(spark, "token-stream")
    fx.table(spark, sf_dir, "events").select("ts", "user_id", "event_type", "value").repartition(6).write.parquet(f"{at}/in")
    plan = lambda source: ops.token_accounting(token_spans(source))
    return stream.replayed_updates(spark, f"{at}/in", "ts timestamp_ntz, user_id long, event_type string, value double", plan, ["trace_id"], at)


@query("a3_daily_usage", "SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY ALL")
def daily_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3."""
    return ops.usage(fx.table(spark, sf_dir, "events")).withColumn("day", F.col("day").cast("string"))


@query("a4_user_seen", "SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n FROM events GROUP BY user_id")
def user_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4."""
    return ops.seen(fx.table(spark, sf_dir, "events"))


@query("o6_trace_page", f"WITH {fx.TRACES} SELECT trace_id, span_id, name, tokens FROM traces ORDER BY ts DESC, span_id LIMIT 50 OFFSET 20")
def trace_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page is the feature."""
    rows = fx.traces(spark, sf_dir).select("trace_id", "span_id", "name", "tokens", "ts")
    return ops.page(rows, [F.col("ts").desc(), F.col("span_id")], 50, 20).drop("ts")


@query("s14_latest_trace", f"WITH {fx.TRACES} SELECT trace_id, span_id, name FROM traces QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY ts DESC, span_id DESC) = 1")
def latest_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S14."""
    return ops.latest(fx.traces(spark, sf_dir), "trace_id", ["ts", "span_id"]).select("trace_id", "span_id", "name")


@query("x4_daily_quota", "SELECT event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) <= 2 AS allowed FROM events")
def daily_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X4 (batch form)."""
    return ops.over_quota(fx.table(spark, sf_dir, "events"), 2).select("event_id", "allowed")


@query("x3_sliding_limit", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts)) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS n FROM events")
def sliding_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's window, as the fixture's events are sparse."""
    return ops.in_window(fx.table(spark, sf_dir, "events"), 86_400).select("event_id", "n")


def _closed(size: str, delay: str) -> str:
    """Counts of the windows that end by the watermark, the last event's time less the delay."""
    return f"""WITH w AS (SELECT user_id, date_trunc('{size}', ts) AS start, count(*) AS n FROM events GROUP BY 1, 2)
SELECT * FROM w WHERE start + INTERVAL 1 {size} <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL {delay} FROM events)"""


@query("x3_stream_windows", _closed("minute", "10 minutes"))
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X3, X7 as a stream: events replayed from files through a watermarked window; closed windows come out."""
    return _stream(spark, sf_dir, stream.windowed_counts)


@query("x4_stream_days", _closed("day", "1 day"))
def stream_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X4 as a stream."""
    return _stream(spark, sf_dir, stream.daily_counts)


def _stream(spark: SparkSession, sf_dir: str, plan) -> DataFrame:
    at = new_path(spark, "stream")
    fx.table(spark, sf_dir, "events").select("ts", "user_id").write.parquet(f"{at}/in")
    return stream.replay(spark, f"{at}/in", "ts timestamp_ntz, user_id long", plan, f"{at}/checkpoint", f"{at}/out")


_SESSION = "conv AS (SELECT conv_id AS session_id, turn AS message_idx, role, text AS content FROM conversations)"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("message_idx"), "role", F.col("text").alias("content"))


@query("j14_session_view", f"""WITH {_SESSION} SELECT session_id, count(*) AS n_messages, string_agg(role, ',' ORDER BY message_idx, role, content) AS roles,
  sum(CASE WHEN message_idx = 1 THEN 2 ELSE 0 END) AS n_files FROM conv GROUP BY session_id""")  # fmt: skip
def session_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two attachments at place 1 of each session, and one at a place that doesn't exist."""
    m = messages(spark, sf_dir)
    sessions = m.select("session_id").distinct()
    urls = literal(spark, "(VALUES (1, '/uploads/a.png'), (1, '/uploads/b.pdf'), (9999, '/uploads/c.pdf')) AS t(message_idx, url)")
    files = sessions.join(F.broadcast(urls)).select("session_id", F.col("message_idx").cast("long").alias("message_idx"), ops.attachment_name(F.col("url")).alias("name"), ops.attachment_kind(F.col("url")).alias("kind"))
    view = ops.with_messages(sessions, m, files)
    return view.select(
        "session_id", F.size("messages").cast("long").alias("n_messages"), F.array_join(F.transform("messages", lambda x: x["role"]), ",").alias("roles"),
        F.aggregate("messages", F.lit(0).cast("long"), lambda s, x: s + F.size(x["files"])).alias("n_files"),
    )


@query("w15_history", f"""WITH {_SESSION}, last AS (SELECT * FROM conv QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY message_idx DESC) <= 3)
SELECT session_id, message_idx FROM last WHERE coalesce(content, '') <> ''""")  # fmt: skip
def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cut comes before the filter."""
    return ops.history(messages(spark, sf_dir), 3).select("session_id", "message_idx")


@query("s15_session_overwrite", f"WITH {_SESSION} SELECT session_id, message_idx, CASE WHEN session_id % 3 = 0 THEN 'new' ELSE content END AS content FROM conv WHERE session_id % 3 > 0 OR message_idx = 0")
def session_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions divisible by three are saved anew with their first message."""
    m = messages(spark, sf_dir).select("session_id", "message_idx", "content")
    new = m.filter("session_id % 3 = 0 AND message_idx = 0").withColumn("content", F.lit("new"))
    drop = m.filter("session_id % 3 = 0").select("session_id").distinct()
    return index.replaced(m.join(drop, "session_id", "left_anti"), new, ["session_id"])


@query("f14_visible_sessions", f"WITH {_SESSION} SELECT session_id, count(*) AS n FROM conv WHERE session_id IN (SELECT user_id FROM events) GROUP BY session_id")
def visible_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F14, F15."""
    allowed = fx.table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"))
    return messages(spark, sf_dir).join(allowed, "session_id", "left_semi").groupBy("session_id").agg(F.count("*").alias("n"))


@query("c30_titles", f"""WITH {_SESSION} SELECT session_id, CASE WHEN length(trim(coalesce(content, ''))) <= 2 AND session_id % 2 = 0 THEN 'image' WHEN length(trim(coalesce(content, ''))) <= 2 AND session_id % 5 = 0 THEN 'file'
  WHEN trim(coalesce(content, '')) = '' THEN 'untitled' ELSE substr(trim(content), 1, 18) END AS title FROM conv WHERE message_idx = 0""")  # fmt: skip
def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C30, K7."""
    first = messages(spark, sf_dir).filter("message_idx = 0")
    title = ops.title(F.col("content"), F.when(F.col("session_id") % 2 == 0, 1).otherwise(0), F.when(F.col("session_id") % 5 == 0, 1).otherwise(0))
    return first.select("session_id", title.alias("title"))


@query("c32_json_round_trip", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C32."""
    packed = F.to_json(F.from_json("props", "k long"))
    return fx.table(spark, sf_dir, "events").select("event_id", F.get_json_object(packed, "$.k").cast("long").alias("k"))


@query("s18_ndjson_replay", f"WITH {_SESSION} SELECT session_id, message_idx AS seq, md5('{{\"kind\":\"' || role || '\",\"n\":' || length(content) || '}}') AS line_md5 FROM conv WHERE message_idx >= session_id % 3")
def ndjson_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines from each session's cursor on."""
    m = messages(spark, sf_dir).withColumnRenamed("message_idx", "seq")
    cursors = m.select("session_id", (F.col("session_id") % 3).alias("cursor")).distinct()
    rows = stream.read_from(m, cursors)
    return rows.select("session_id", "seq", F.md5(F.to_json(F.struct(F.col("role").alias("kind"), F.char_length("content").alias("n")))).alias("line_md5"))


#: When tokens are looked at.
NOW = "2024-01-15 00:00:00"


@query("f13_valid_tokens", f"SELECT event_id AS id FROM events WHERE event_type <> 'error' AND CASE event_id % 5 WHEN 0 THEN TRUE WHEN 1 THEN FALSE ELSE date_trunc('second', ts) >= TIMESTAMP '{NOW}' END")
def valid_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as tokens: errors are revoked, some never expire, some have a date that can't be read."""
    k = F.col("event_id") % 5
    expires = F.when(k == 1, "never").when(k > 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    tokens = fx.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), expires.alias("expires_at"), (F.col("event_type") == "error").cast("int").alias("revoked"))
    return ops.valid_tokens(tokens, NOW).select("id")


@query("c31_token_expiry", "SELECT event_id, sha256(CAST(user_id AS VARCHAR)) AS hash, CASE WHEN event_id % 3 > 0 THEN ts + to_days(CAST(event_id % 3 AS INTEGER)) END AS expires FROM events")
def token_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C31, O8."""
    days = (F.col("event_id") % 3).cast("int")
    return fx.table(spark, sf_dir, "events").select("event_id", ops.token_hash(F.col("user_id").cast("string")).alias("hash"), ops.expiry(F.col("ts"), days).alias("expires"))


@query("j18_span_depth", """WITH RECURSIVE s AS (SELECT event_id AS span_id, event_id // 64 AS trace_id, CASE WHEN event_id % 64 > 0 THEN event_id // 64 * 64 + CASE WHEN event_id // 64 % 2 = 0 THEN (event_id % 64) // 2 ELSE event_id % 64 - 1 END END AS parent_id FROM events),
tree AS (SELECT trace_id, span_id, 0 AS depth FROM s WHERE parent_id IS NULL UNION ALL SELECT s.trace_id, s.span_id, t.depth + 1 FROM s JOIN tree t ON s.trace_id = t.trace_id AND s.parent_id = t.span_id)
SELECT * FROM tree""")  # fmt: skip
def span_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans in trees of 64, every other one a chain."""
    e = fx.table(spark, sf_dir, "events").select(F.col("event_id").alias("span_id"))
    trace, place = F.floor(F.col("span_id") / 64), F.col("span_id") % 64
    return ops.span_depths(e.select("span_id", trace.alias("trace_id"), F.when(place > 0, trace * 64 + F.when(trace % 2 == 0, F.floor(place / 2)).otherwise(place - 1)).alias("parent_id")))


_SIDES = """olds AS (SELECT doc_id AS chunk_id, source, sha256(text) AS h FROM documents WHERE doc_id % 10 < 8), news AS (
  SELECT doc_id AS chunk_id, source, sha256(text || CASE WHEN doc_id % 7 = 0 THEN '!' ELSE '' END) AS h FROM documents WHERE doc_id % 10 > 1)"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "source", "text")
    changed = F.when(F.col("chunk_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return d.filter("chunk_id % 10 < 8"), d.filter("chunk_id % 10 > 1").withColumn("text", changed)


def _manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A file per chunk, of one to three articles."""
    as_files = lambda d: d.select(F.col("source").alias("category"), F.col("chunk_id").cast("string").alias("source"), F.encode("text", "utf-8").alias("content"), (1 + F.col("chunk_id") % 3).alias("article_count"))
    return tuple(index.manifest(as_files(d)) for d in _sides(spark, sf_dir))


_DIFF = f"""{_SIDES}, changes AS (
  SELECT coalesce(o.source, n.source) AS category, CAST(coalesce(o.chunk_id, n.chunk_id) AS VARCHAR) AS source,
    CASE WHEN o.chunk_id IS NULL THEN 'added' WHEN n.chunk_id IS NULL THEN 'removed' WHEN o.h = n.h THEN 'skipped' ELSE 'updated' END AS change
  FROM olds o FULL JOIN news n ON o.chunk_id = n.chunk_id)"""


@query("j13_manifest_diff", f"WITH {_DIFF} SELECT * FROM changes")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J13, C12, S12, U3, Q16."""
    return index.diff(*_manifests(spark, sf_dir))


def _articles(condition: str, name: str) -> str:
    return f"coalesce(sum(1 + CAST(source AS BIGINT) % 3) FILTER (WHERE change {condition}), 0)::BIGINT AS {name}"


_COUNTED = ", ".join(_articles(f"= '{c}'", c) for c in ("added", "updated", "removed", "skipped"))


@query("a13_ingest_counters", f"WITH {_DIFF} SELECT {_articles("<> 'removed'", 'total')}, {_COUNTED} FROM changes")
def ingest_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles, not files; of removed files the chunks that are stored."""
    old, new = _manifests(spark, sf_dir)
    stored = lambda m: m.select("category", "source", F.explode(F.sequence(F.lit(1), "article_count")).alias("chunk_id"))
    out = index.counters(index.diff(old, new), old, new, stored(old), stored(new))
    return out.select(*[F.col(c).cast("long").alias(c) for c in out.columns])


@query("s9_upsert", f"WITH {_SIDES} SELECT chunk_id, h FROM olds WHERE chunk_id NOT IN (SELECT chunk_id FROM news) UNION ALL SELECT chunk_id, h FROM news")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S9."""
    old, new = _sides(spark, sf_dir)
    return index.upserted(old, new).select("chunk_id", F.sha2("text", 256).alias("h"))


@query("s10_delete", f"WITH {_SIDES} SELECT chunk_id, source FROM olds WHERE chunk_id NOT IN (SELECT chunk_id FROM news WHERE chunk_id % 7 = 0)")
def delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S10."""
    old, new = _sides(spark, sf_dir)
    return index.purged(old, new.filter("chunk_id % 7 = 0")).select("chunk_id", "source")


@query("u2_stale_ids", f"WITH {_SIDES} SELECT chunk_id FROM olds EXCEPT SELECT chunk_id FROM news")
def stale_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source is touched here."""
    old, new = _sides(spark, sf_dir)
    changes = old.select("source", F.lit("updated").alias("change")).distinct()
    return index.stale(old, new, changes)


@query("c10_chunk_ids", f"""WITH {fx.CHUNKS}, b AS (SELECT chunk_id AS doc_id, text, sha256(source || '|' || section_header || '|' || parent_article_no) AS base FROM chunks),
n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY doc_id) AS n, substr(sha256(text), 1, 12) AS d FROM b),
m AS (SELECT *, row_number() OVER (PARTITION BY base, n = 1, d ORDER BY doc_id) AS m FROM n)
SELECT doc_id, CASE WHEN n = 1 THEN base WHEN m = 1 THEN sha256(base || '|' || d) ELSE sha256(base || '|' || d || '|' || m) END AS chunk_id FROM m""")  # fmt: skip
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parents' numbers repeat, so ids must be made unique."""
    rows = fx.chunks(spark, sf_dir).select(F.col("chunk_id").alias("doc_id"), "source", "section_header", F.col("parent_article_no").alias("article_no"), "text")
    return ids.unique_ids(rows, ["doc_id"]).select("doc_id", "chunk_id")


@query("c35_dimension_check", "SELECT max(len(embedding)) AS high, min(len(embedding)) AS low, count(*) AS n FROM embeddings")
def dimension_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C35, A17, S7."""
    return fx.table(spark, sf_dir, "embeddings").agg(F.max(F.size("embedding")).cast("long").alias("high"), F.min(F.size("embedding")).cast("long").alias("low"), F.count("*").alias("n"))


@query("c14_normalized_vectors", """SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: (x::DOUBLE * 3) * (x::DOUBLE * 3)))), 5) AS norm,
  round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS first FROM embeddings""")  # fmt: skip
def normalized_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C14."""
    tripled = F.transform("embedding", lambda x: x.cast("double") * 3)
    rows = fx.table(spark, sf_dir, "embeddings").select("vec_id", tripled.alias("v"))
    return rows.select("vec_id", F.round(vectors.norm(F.col("v")), 5).alias("norm"), F.round(vectors.normalized(F.col("v"))[0], 5).alias("first"))


@query("f16_metadata_projection", f"WITH {fx.CHUNKS} SELECT chunk_id, source, section_header, article_no, parent_article_no, chunk_type, role, penalty_context FROM chunks")
def metadata_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16."""
    return fx.chunks(spark, sf_dir).drop("text")


@query("c17_lexical_text", "SELECT doc_id, md5(concat_ws(' ', nullif(source, ''), nullif(lang, ''), nullif(text, ''))) AS text_md5 FROM documents")
def lexical_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C17."""
    from quarryline.functions.text import lexical_text as joined

    return fx.table(spark, sf_dir, "documents").select("doc_id", F.md5(joined(F.col("source"), F.col("lang"), F.col("text"))).alias("text_md5"))


@query("c39_effective_question", "SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN 'Summarise the document.' ELSE text END AS text FROM benchmark")
def effective_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A blank question that comes with a document."""
    q = fx.table(spark, sf_dir, "benchmark").withColumn("text", F.when(F.col("item_id") % 2 == 0, "  ").otherwise(F.col("text")))
    return q.select(F.col("item_id").alias("query_id"), F.when(F.trim("text") == "", "Summarise the document.").otherwise(F.col("text")).alias("text"))


@query("x5_running_jobs", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) > 1 AS conflict FROM events")
def running_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job of a user conflicts with one that began before it on its day."""
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    return fx.table(spark, sf_dir, "events").select("user_id", "event_id", (F.row_number().over(w) > 1).alias("conflict"))


def _statutes(rows: DataFrame) -> DataFrame:
    """Five chunks a file, each an article of one line; the reader is told that such text is a document's."""
    digits = F.translate(F.col("chunk_id").cast("string"), "0123456789", "零一二三四五六七八九")
    line = F.concat(F.lit("第"), digits, F.lit("条 "), F.trim(F.regexp_replace("text", r"\s+", " ")))
    name = F.concat(F.lit("f"), F.floor(F.col("chunk_id") / 5))
    found = rows.select(name.alias("source"), "chunk_id", line.alias("line")).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "line"))).alias("lines"))
    content = F.encode(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), "utf-8")
    return found.select(F.concat(F.lit("law/"), "source", F.lit(".docx")).alias("path"), F.lit("law").alias("category"), "source", F.sha2(content, 256).alias("file_hash"), content.alias("content"))


def _ingested(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """The counters of a second run, and where the index is."""
    root = new_path(spark, "index")
    lines = lambda content: content.decode().split("\n")
    for side in _sides(spark, sf_dir):
        counts = ingest.ingest(spark, _statutes(side), root, F.lit("法律"), {}, docx=lines)
    return counts, root


_FILES = """texts AS (
  SELECT doc_id, 'f' || (doc_id // 5) AS source, '第' || translate(CAST(doc_id AS VARCHAR), '0123456789', '零一二三四五六七八九') || '条' AS article_no, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS old_text,
    trim(regexp_replace(text || CASE WHEN doc_id % 7 = 0 THEN '!' ELSE '' END, '\\s+', ' ', 'g')) AS new_text FROM documents
), old_files AS (SELECT source, string_agg(article_no || old_text, chr(10) ORDER BY doc_id) AS body, count(*) FILTER (WHERE old_text <> '') AS n FROM texts WHERE doc_id % 10 < 8 GROUP BY source
), new_files AS (SELECT source, string_agg(article_no || new_text, chr(10) ORDER BY doc_id) AS body, count(*) FILTER (WHERE new_text <> '') AS n FROM texts WHERE doc_id % 10 > 1 GROUP BY source)"""


@query("p8_incremental_ingest", f"WITH {_FILES} SELECT sha256(source || '||' || article_no) AS chunk_id, source, article_no, md5(new_text) AS text_md5 FROM texts WHERE doc_id % 10 > 1 AND new_text <> ''")
def incremental_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is published after two runs with files added, changed and removed in between."""
    _, root = _ingested(spark, sf_dir)
    return index.current(spark, root).select("chunk_id", "source", "article_no", F.md5("text").alias("text_md5"))


@query("p8_ingest_counters", f"""WITH {_FILES} SELECT (SELECT sum(n) FROM new_files)::BIGINT AS total, coalesce(sum(n.n) FILTER (WHERE o.source IS NULL), 0)::BIGINT AS added, coalesce(sum(n.n) FILTER (WHERE o.body <> n.body), 0)::BIGINT AS updated,
  coalesce(sum(o.n) FILTER (WHERE n.source IS NULL), 0)::BIGINT AS removed, coalesce(sum(o.n) FILTER (WHERE o.body = n.body), 0)::BIGINT AS skipped FROM old_files o FULL JOIN new_files n ON o.source = n.source""")  # fmt: skip
def ingest_run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of the second run."""
    out, _ = _ingested(spark, sf_dir)
    return out.select(*[F.col(c).cast("long").alias(c) for c in out.columns])


@query("p8_index_versions", f"""WITH {_FILES} SELECT 1 AS version, sha256(source || '||' || article_no) AS chunk_id, md5(old_text) AS text_md5 FROM texts WHERE doc_id % 10 < 8 AND old_text <> ''
UNION ALL SELECT 2, sha256(source || '||' || article_no), md5(new_text) FROM texts WHERE doc_id % 10 > 1 AND new_text <> ''""")  # fmt: skip
def index_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both versions stay readable; the second is a segment beside the first."""
    _, root = _ingested(spark, sf_dir)
    read = lambda n: index.current(spark, root, at=n).select(F.lit(n).alias("version"), "chunk_id", F.md5("text").alias("text_md5"))
    return read(1).unionByName(read(2))


@query("p8_two_writers", f"WITH {_FILES} SELECT sha256(source || '||' || article_no) AS chunk_id, CASE WHEN doc_id // 5 % 2 = 0 THEN 'even' ELSE 'odd' END AS category, md5(new_text) AS text_md5 FROM texts WHERE doc_id % 10 > 1 AND new_text <> ''")
def two_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs at once, each for half of the files; whoever comes second goes by the other's version."""
    root = new_path(spark, "index")
    lines = lambda content: content.decode().split("\n")
    half = F.when(F.substring("source", 2, 20).cast("long") % 2 == 0, "even").otherwise("odd")
    files = _statutes(_sides(spark, sf_dir)[1]).withColumn("category", half)

    def run(name: str) -> None:
        ingest.ingest(spark, files.filter(F.col("category") == name), root, F.lit("法律"), {}, docx=lines, within=F.col("category") == name)

    with ThreadPoolExecutor(2) as pool:
        list(pool.map(run, ["even", "odd"]))
    return index.current(spark, root).select("chunk_id", "category", F.md5("text").alias("text_md5"))


@query("s11_rebuilt_index", f"WITH {_FILES} SELECT sha256(source || '||' || article_no) AS chunk_id, 16::BIGINT AS size, md5(old_text) AS text_md5 FROM texts WHERE doc_id % 10 < 8 AND old_text <> ''")
def rebuilt_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files again, with vectors of another length."""
    root = new_path(spark, "index")
    lines = lambda content: content.decode().split("\n")
    for size in (8, 16):
        ingest.ingest(spark, _statutes(_sides(spark, sf_dir)[0]), root, F.lit("法律"), {}, docx=lines, embedder=lambda texts, size=size: providers.hashed_embedder(texts, size))
    return index.current(spark, root).select("chunk_id", F.size("embedding").cast("long").alias("size"), F.md5("text").alias("text_md5"))
