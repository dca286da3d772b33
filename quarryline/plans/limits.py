"""Queries of burst limits and of substring joins over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import limits, substrings
from quarryline.plans import fixtures as fx
from quarryline.registry import query

#: The limits of the two zones, 10 requests a second with 20 more at once, and 2 with 5.
PERIOD_US = {"api": 100_000, "chat": 500_000}
BURST = {"api": 20, "chat": 5}
#: The fixture's events of a user are hours apart, so its clocks go slower by this factor; some requests are refused.
SLOWER = 1_152_000
ZONES = {name: limits.Zone(PERIOD_US[name] * SLOWER, BURST[name]) for name in PERIOD_US}

_ZONE_ROWS = ", ".join(f"('{name}', {z.period_us}::BIGINT, {z.burst}::BIGINT)" for name, z in ZONES.items())


@query("x3_burst_limit", f"""WITH RECURSIVE z(zone, period, burst) AS (VALUES {_ZONE_ROWS}), r AS (
  SELECT event_id, user_id, CASE WHEN event_type = 'purchase' THEN 'chat' ELSE 'api' END AS zone, epoch_us(ts) AS at_us,
    row_number() OVER (PARTITION BY user_id, event_type = 'purchase' ORDER BY ts, event_id) AS n FROM events
), walk AS (
  SELECT r.event_id, r.user_id, r.zone, r.n, r.at_us, r.at_us + z.period AS due, TRUE AS allowed FROM r JOIN z ON z.zone = r.zone WHERE r.n = 1
  UNION ALL
  SELECT r.event_id, r.user_id, r.zone, r.n, r.at_us,
    CASE WHEN greatest(w.due, r.at_us) - r.at_us <= z.burst * z.period THEN greatest(w.due, r.at_us) + z.period ELSE w.due END,
    greatest(w.due, r.at_us) - r.at_us <= z.burst * z.period
  FROM walk w JOIN r ON r.user_id = w.user_id AND r.zone = w.zone AND r.n = w.n + 1 JOIN z ON z.zone = r.zone
) SELECT event_id, zone, allowed, greatest(due - at_us, 0)::BIGINT AS level_us FROM walk""")  # fmt: skip
def burst_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event passes its zone's bucket; purchases stand for chats."""
    events = fx.table(spark, sf_dir, "events")
    zone = F.when(F.col("event_type") == "purchase", "chat").otherwise("api")
    rows = events.select("event_id", "user_id", "ts", zone.alias("zone"))
    return limits.burst_limited(rows, ZONES, "zone", "user_id", "ts", "event_id").select("event_id", "zone", "allowed", "level_us")


#: Two neighbouring words of a benchmark item are a phrase; so are the sources' names.
_PHRASES = r"""w AS (SELECT item_id, list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda x: x <> '') AS words FROM benchmark),
phrases AS (SELECT DISTINCT unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS pattern FROM w WHERE len(words) > 1
  UNION SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)"""


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(F.split("text", r"[ \t\n\r\f\x0B]+"), lambda w: w != "")
    rows = fx.table(spark, sf_dir, "benchmark").select(words.alias("words")).filter(F.size("words") > 1)
    pairs = F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda i: F.concat_ws(" ", F.element_at("words", i), F.element_at("words", i + 1)))
    names = fx.table(spark, sf_dir, "documents").select(F.col("source").alias("pattern")).filter("pattern IS NOT NULL")
    return rows.select(F.explode(pairs).alias("pattern")).unionByName(names).distinct()


@query("j16_conversation_audit", rf"""WITH {_PHRASES}, m AS (
  SELECT c.conv_id, p.pattern, max(CASE WHEN c.role = 'assistant' THEN 1 ELSE 0 END) AS cited, max(CASE WHEN c.role <> 'assistant' THEN 1 ELSE 0 END) AS given
  FROM conversations c JOIN phrases p ON contains(c.text, p.pattern) GROUP BY ALL
) SELECT conv_id, count(*) FILTER (WHERE cited = 1) AS n_cited, count(*) FILTER (WHERE cited = 1 AND given = 0) AS n_unsupported, min(CASE WHEN cited = 1 AND given = 0 THEN pattern END) AS first_unsupported
FROM m GROUP BY conv_id""")  # fmt: skip
def conversation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and source names that a conversation's answers hold, and those of them that its other turns don't."""
    turns = fx.table(spark, sf_dir, "conversations")
    found = substrings.containing(turns, phrases(spark, sf_dir), ["conv_id", "turn", "role"])
    answer = F.col("role") == "assistant"
    held = found.groupBy("conv_id", "pattern").agg(F.max(answer.cast("int")).alias("cited"), F.max((~answer).cast("int")).alias("given"))
    missing = (F.col("cited") == 1) & (F.col("given") == 0)
    return held.groupBy("conv_id").agg(F.sum("cited").cast("long").alias("n_cited"), F.sum(missing.cast("long")).alias("n_unsupported"), F.min(F.when(missing, F.col("pattern"))).alias("first_unsupported"))


@query("j12_phrase_sources", rf"""WITH {_PHRASES} SELECT p.pattern, count(*) AS n_documents, count(DISTINCT d.source) AS n_sources FROM documents d JOIN phrases p ON contains(d.text, p.pattern) GROUP BY p.pattern""")
def phrase_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many documents, and of how many sources, each phrase stands."""
    docs = fx.table(spark, sf_dir, "documents")
    found = substrings.containing(docs, phrases(spark, sf_dir), ["doc_id", "source"])
    return found.groupBy("pattern").agg(F.count("*").alias("n_documents"), F.count_distinct("source").alias("n_sources"))
