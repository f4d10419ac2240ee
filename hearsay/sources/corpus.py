"""Where transcripts come from.

A corpus is a DataFrame ``(file STRING, transcript STRING)``: the file path
is the document's identity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearsay.session import default_parallelism


def spread(df: DataFrame, min_partitions: int | None) -> DataFrame:
    """Round-robin ``df`` over ``min_partitions`` tasks if the scan gives fewer.

    Tokenising is CPU-bound per row; a corpus stored as one large row group
    would otherwise run in one task. A scan that already has enough splits
    (the normal case for a large corpus) is left alone: no extra shuffle.
    """
    if not min_partitions:
        return df
    try:
        n = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001  (no RDD view, e.g. a Spark Connect session): leave the scan as is
        return df
    return df.repartition(min_partitions) if n < min_partitions else df


def _decoded(path):
    """``_metadata.file_path`` is URL-encoded, but a plus sign stands for itself."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def read_corpus(spark: SparkSession, path: str, file_col: str = "file", text_col: str = "transcript",
                fmt: str = "parquet", min_partitions: int | None = None) -> DataFrame:
    """S3: ready transcripts from Parquet / JSON / CSV / ORC, renamed to the corpus schema.

    ``fmt="text"`` reads whole files (``wholetext``), the path being the file.
    """
    if fmt == "text":
        df = spark.read.option("wholetext", "true").text(path).select(
            _decoded(F.regexp_replace(F.col("_metadata.file_path"), r"^file:(//)?", "")).alias("file"),
            F.col("value").alias("transcript"))
    else:
        reader = spark.read.format(fmt)
        if fmt == "csv":
            reader = reader.option("header", "true").option("multiLine", "true")
        df = reader.load(path).select(
            F.col(file_col).cast("string").alias("file"), F.col(text_col).cast("string").alias("transcript"))
    return spread(df, min_partitions)


def documents_corpus(spark: SparkSession, sf_dir: str, min_partitions: int | None = None) -> DataFrame:
    """The driver's ``documents`` table as a corpus: file = doc_id as text."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").cast("string").alias("file"), F.col("text").alias("transcript"))
    return spread(df, min_partitions if min_partitions is not None else default_parallelism(spark))


def conversations_corpus(spark: SparkSession, sf_dir: str, min_partitions: int | None = None) -> DataFrame:
    """The driver's ``conversations`` table: one document per turn, file = conv_id/turn."""
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("file"),
        F.col("text").alias("transcript"))
    return spread(df, min_partitions if min_partitions is not None else default_parallelism(spark))


def benchmark_queries(spark: SparkSession, sf_dir: str, max_terms: int | None = None) -> DataFrame:
    """A query table from the driver's ``benchmark`` texts: one query per line.

    query_id = ``item_id:line``; terms = the line normalised like the index
    (an explicit choice for this table; the search itself never normalises).
    Columns ``(query_id, line, terms, status)``.
    """
    from hearsay.operators.scoring import parse_query

    lines = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(
        "item_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    parsed = lines.select(
        F.concat_ws(":", F.col("item_id").cast("string"), F.col("line_no").cast("string")).alias("query_id"),
        "line", parse_query("line", max_terms=max_terms, normalize_terms=True).alias("q"))
    return parsed.select("query_id", "line", "q.terms", "q.status")
