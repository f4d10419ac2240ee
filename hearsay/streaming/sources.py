"""Streaming reads of Parquet tables (a folder, or one file picked by name)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table_stream(spark: SparkSession, folder: str, schema: T.StructType, file_glob: str | None = None,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """A file-source stream over ``folder`` (new files become new micro-batches).

    ``file_glob`` picks a table by name: a file of the folder, or a folder of part files.
    """
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    if not file_glob:
        return reader.parquet(folder)
    named = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{file_glob}")
    found = named.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(named)
    if any(f.isDirectory() for f in found or []):
        return reader.parquet(f"{folder}/{file_glob}")      # the filter below is for names of files alone
    return reader.option("pathGlobFilter", file_glob).parquet(folder)


def media_stream(spark: SparkSession, directory: str, fmt: str = "mp4", max_files_per_trigger: int | None = None) -> DataFrame:
    """``(file)`` of the recordings in ``directory``; their contents are not read.

    Of a local folder, each time that its names have changed, all of them: a task
    reads them off the folder, and the driver keeps their number and a hash, not a
    row for each. A folder elsewhere, or with a limit of files to a micro-batch, is
    left to Spark's file source, which brings each name once and keeps it on the driver.
    """
    from hearsay.sources.media import folder_pattern, listed_sources

    local = local_folder(spark, directory)
    if local and not max_files_per_trigger:
        spark.dataSource.register(_folder_source())
        names = spark.sparkContext._jvm.org.apache.hadoop.fs.GlobPattern(f"*.{fmt}").compiled().pattern()
        return spark.readStream.format("recordings").options(folder=local, names=names).load()
    reader = (spark.readStream.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter=f"*.{fmt}")
              .schema("path string, modificationTime timestamp, length long, content binary"))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return listed_sources(reader.load(folder_pattern(directory)), directory)


def local_folder(spark: SparkSession, directory: str) -> str | None:
    """The plain path of an existing local folder."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(directory)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    own = files.makeQualified(folder).toUri()
    return own.getPath() if own.getScheme() == "file" and files.exists(folder) else None


def _folder_source() -> type:
    """The recordings of one folder, direct children alone, as a streaming source. Made here, so that workers get it by value."""
    import hashlib
    import os
    import re
    from collections.abc import Iterator

    from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

    def hidden(name: str) -> bool:
        """What Spark's file sources leave out."""
        own = name.startswith("_") and "=" not in name and not name.startswith(("_metadata", "_common_metadata"))
        return own or name.startswith(".") or name.endswith("._COPYING_")

    def listed(folder: str, names: str) -> Iterator[str]:
        wanted = re.compile(names, re.DOTALL)
        try:
            entries = os.scandir(folder)
        except FileNotFoundError:
            return
        with entries:
            for entry in entries:
                if hidden(entry.name) or not wanted.fullmatch(entry.name):
                    continue
                try:
                    if entry.is_file() and entry.stat().st_size > 0:
                        yield os.fsencode(entry.name).decode("utf-8", "replace")
                except FileNotFoundError:      # gone meanwhile
                    continue

    class Reader(DataSourceStreamReader):
        def __init__(self, folder: str, names: str):
            self.folder, self.names = folder, names

        def initialOffset(self) -> dict:
            return {"files": 0, "hash": "0"}

        def latestOffset(self) -> dict:
            """The hash is a sum over the names, in any order."""
            n, total = 0, 0
            for name in listed(self.folder, self.names):
                n, total = n + 1, total + int.from_bytes(hashlib.blake2b(name.encode(), digest_size=16).digest(), "big")
            return {"files": n, "hash": f"{total % (1 << 128):x}"}

        def partitions(self, start: dict, end: dict) -> list:
            return [] if start == end else [InputPartition((self.folder, self.names))]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            folder, names = partition.value
            for name in listed(folder, names):
                yield (f"{folder.rstrip('/')}/{name}",)

    class Recordings(DataSource):
        @classmethod
        def name(cls) -> str:
            return "recordings"

        def schema(self) -> str:
            return "file string"

        def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
            return Reader(self.options["folder"], self.options["names"])

    return Recordings


DOCUMENTS_TABLE_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])

CONVERSATIONS_TABLE_SCHEMA = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
])

BENCHMARK_TABLE_SCHEMA = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])


def documents_corpus_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table_stream(spark, sf_dir, DOCUMENTS_TABLE_SCHEMA, "documents.parquet")
    return docs.select(F.col("doc_id").cast("string").alias("file"), F.col("text").alias("transcript"))


def conversations_corpus_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table_stream(spark, sf_dir, CONVERSATIONS_TABLE_SCHEMA, "conversations.parquet")
    return turns.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("file"),
                        F.col("text").alias("transcript"))


def benchmark_query_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(query_id, terms)`` per benchmark line, as ``benchmark_queries`` but streaming."""
    from hearsay.operators.scoring import parse_query

    bench = table_stream(spark, sf_dir, BENCHMARK_TABLE_SCHEMA, "benchmark.parquet")
    lines = bench.select("item_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    parsed = lines.select(
        F.concat_ws(":", F.col("item_id").cast("string"), F.col("line_no").cast("string")).alias("query_id"),
        parse_query("line", max_terms=None, normalize_terms=True).alias("q"))
    return parsed.where(F.col("q.status") == "ok").select("query_id", F.col("q.terms").alias("terms"))
