"""Stable identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def chunk_id(source: Column, section: Column, article: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in (source, section, article)]), 256)


def unique_ids(chunks: DataFrame, order: list) -> DataFrame:
    """Adds chunk_id: the first chunk of equal source, section and article keeps the plain id; further ones add a
    digest of their text, and equal texts a count."""
    base = chunks.withColumn("_base", chunk_id(F.col("source"), F.col("section_header"), F.col("article_no")))
    base = base.withColumn("_n", F.row_number().over(Window.partitionBy("_base").orderBy(*order)))
    base = base.withColumn("_digest", F.substring(F.sha2("text", 256), 1, 12))
    # Equal texts count on among the rows that aren't first.
    base = base.withColumn("_m", F.row_number().over(Window.partitionBy("_base", F.col("_n") == 1, "_digest").orderBy(*order)))
    further = F.when(F.col("_m") == 1, F.sha2(F.concat_ws("|", "_base", "_digest"), 256)).otherwise(F.sha2(F.concat_ws("|", "_base", "_digest", F.col("_m").cast("string")), 256))
    return base.withColumn("chunk_id", F.when(F.col("_n") == 1, F.col("_base")).otherwise(further)).drop("_base", "_n", "_digest", "_m")
