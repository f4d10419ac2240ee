"""O1 / O2: result rows as the text and JSON the front ends show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.functions.text import path_display


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def format_result(score: Column | str, file: Column | str) -> Column:
    """O1: ``Score: 0.74  | File: x`` (2 decimals, left-aligned to width 5)."""
    return F.format_string("Score: %-5s | File: %s", F.format_string("%.2f", _col(score)), _col(file))


def results_json(queries: DataFrame, results: DataFrame, elapsed_ms: int | Column = 0) -> DataFrame:
    """O2: ``(query_id, json)`` with ``{"videos":[{file,score}],"duration":{count,unit}}``.

    Best first, scores to 6 decimals, slashes in file names, and ``[]`` for
    a query without results (queries are left-joined, so every one answers).
    ``results`` holds at most k rows per query, so each collected list is
    bounded by k.
    """
    entry = F.struct(
        F.col("rank"),
        path_display("file").alias("file"),
        F.round("score", 6).cast("decimal(38,6)").alias("score"))
    per_query = results.groupBy("query_id").agg(F.sort_array(F.collect_list(entry)).alias("hits"))
    empty = F.array().cast("array<struct<rank:int,file:string,score:decimal(38,6)>>")
    joined = queries.select("query_id").distinct().join(per_query, "query_id", "left")
    videos = F.transform(F.coalesce("hits", empty), lambda e: F.struct(e["file"].alias("file"), e["score"].alias("score")))
    ms = elapsed_ms if isinstance(elapsed_ms, Column) else F.lit(elapsed_ms)
    doc = F.struct(videos.alias("videos"),
                   F.struct(ms.cast("bigint").alias("count"), F.lit("ms").alias("unit")).alias("duration"))
    return joined.select("query_id", F.to_json(doc).alias("json"))


def format_results(results: DataFrame) -> DataFrame:
    """O1 over a result table: adds ``line`` to each ``(…, file, score)`` row."""
    return results.withColumn("line", format_result("score", "file"))
