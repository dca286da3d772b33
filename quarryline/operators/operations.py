"""Operational tables: sessions, traces, tokens, usage, rate limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryline.staging import stage


def trace_rollup(traces: DataFrame) -> DataFrame:
    """One row: count, sums and mean duration; zero where there is nothing."""
    zero = lambda c, name: F.coalesce(c, F.lit(0)).alias(name)
    return traces.agg(
        F.count("*").alias("n_traces"), zero(F.sum("tokens"), "tokens"), zero(F.sum(F.col("cache_hit").cast("long")), "cache_hits"),
        F.round(F.coalesce(F.avg("duration_ms"), F.lit(0.0)), 2).alias("mean_ms"),
    )


#: The events that count tokens, and the column of each.
TOKEN_EVENTS = {"llm_tokens": "llm.tokens", "embedding_tokens": "embedding.tokens", "rerank_tokens": "rerank.tokens"}


def token_accounting(spans: DataFrame, kinds: dict[str, str] = TOKEN_EVENTS) -> DataFrame:
    """(trace_id, one column per kind, prompt_tokens, completion_tokens, total_tokens): sums over the events (name,
    prompt, completion, total) that count for a column; others count for none."""
    zero = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    counted = F.col("name").isin(*kinds.values())
    sums = [zero(F.when(F.col("name") == event, F.col("total")), column) for column, event in kinds.items()]
    return spans.groupBy("trace_id").agg(*sums, *[zero(F.when(counted, F.col(c)), f"{c}_tokens") for c in ("prompt", "completion", "total")])


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of the rows of each key the last."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def page(rows: DataFrame, order: list[Column], limit: int, offset: int, most: int = 1000) -> DataFrame:
    """One page of a sorted list; the limit is held to 1 .. most and the offset to 0 and up."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(max(1, min(most, limit)))


def usage(requests: DataFrame) -> DataFrame:
    """(user_id, day, n): requests per user and day."""
    return requests.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


def over_quota(requests: DataFrame, quota: int) -> DataFrame:
    """Adds allowed: the first ``quota`` requests of a user's day; all of them if the quota is 0."""
    if quota == 0:
        return requests.withColumn("allowed", F.lit(True))
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    return requests.withColumn("allowed", F.row_number().over(w) <= quota)


def seen(requests: DataFrame) -> DataFrame:
    return requests.groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("n"))


def in_window(requests: DataFrame, seconds: int) -> DataFrame:
    """Adds n: the user's requests in the seconds up to each, itself included."""
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("_at").rangeBetween(-seconds, 0)
    return requests.withColumn("_at", at).withColumn("n", F.count("*").over(w)).drop("_at")


def valid_tokens(tokens: DataFrame, now: str) -> DataFrame:
    """Known, not revoked, not expired; a date that can't be read is expired, none never expires."""
    expires = F.try_to_timestamp("expires_at")
    fine = F.col("expires_at").isNull() | (expires >= F.lit(now).cast("timestamp"))
    return tokens.filter((F.col("revoked") == 0) & F.coalesce(fine, F.lit(False)))


def expiry(created: Column, days: Column) -> Column:
    """Null for no days or fewer."""
    return F.when(days > 0, created + F.make_dt_interval(days))


def token_hash(token: Column) -> Column:
    return F.sha2(token, 256)


def attachment_kind(url: Column) -> Column:
    suffix = F.lower(F.regexp_extract(url, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(suffix.isin("png", "jpg", "jpeg", "gif", "webp", "bmp"), "image").otherwise("document")


def attachment_name(url: Column) -> Column:
    return F.regexp_extract(url, r"([^/]*)$", 1)


def with_messages(sessions: DataFrame, messages: DataFrame, attachments: DataFrame) -> DataFrame:
    """Sessions with their messages in order, each with the attachments that name its place. Attachments of places
    that don't exist have no message to stand in."""
    files = attachments.groupBy("session_id", "message_idx").agg(F.array_sort(F.collect_list(F.struct("name", "kind"))).alias("files"))
    rows = messages.join(files, ["session_id", "message_idx"], "left")
    item = F.struct("message_idx", "role", "content", F.coalesce("files", F.array().cast("array<struct<name:string,kind:string>>")).alias("files"))
    listed = rows.groupBy("session_id").agg(F.array_sort(F.collect_list(item)).alias("messages"))
    return sessions.join(listed, "session_id", "left")


def title(first: Column, n_images: Column, n_files: Column, longest: int = 18) -> Column:
    """The head of the first message; for messages that say next to nothing a word for what is attached."""
    text = F.trim(F.coalesce(first, F.lit("")))
    return F.when((F.char_length(text) <= 2) & (n_images > 0), "image").when((F.char_length(text) <= 2) & (n_files > 0), "file").when(text == "", "untitled").otherwise(F.substring(text, 1, longest))


def history(messages: DataFrame, n: int = 6) -> DataFrame:
    """The last n messages of a session, then those of them that have content."""
    w = Window.partitionBy("session_id").orderBy(F.col("message_idx").desc())
    return messages.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n").filter("coalesce(content, '') <> ''")


def span_depths(spans: DataFrame) -> DataFrame:
    """(trace_id, span_id, depth) down the parents' tree, however deep: each round every span looks at the ancestor
    of its ancestor, so the distances double and a tree of depth d takes log d joins. Spans that no root leads to
    (a parent is missing) have no row; a cycle is an error that names its trace."""
    start = spans.select("trace_id", "span_id", F.col("parent_id").alias("up"), F.col("parent_id").isNotNull().cast("long").alias("depth"))
    state = stage(start, "span-depths")
    longest = state.groupBy("trace_id").count().agg(F.max("count")).first()[0] or 0
    reach = 1
    while True:
        climbing = state.filter("up IS NOT NULL")
        if climbing.isEmpty():
            return state.select("trace_id", "span_id", F.col("depth").cast("int").alias("depth"))
        if reach > longest:
            raise ValueError(f"spans of trace {climbing.first().trace_id} are their own ancestors")
        above = state.select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_more"))
        moved = climbing.join(above, ["trace_id", "up"]).select("trace_id", "span_id", F.col("_up").alias("up"), (F.col("depth") + F.col("_more")).alias("depth"))
        state = stage(state.filter("up IS NULL").unionByName(moved), "span-depths")
        reach *= 2
