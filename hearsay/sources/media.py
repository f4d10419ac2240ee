"""Media files in a folder, and their transcripts.

Decoding audio and running a speech model are per-file library calls, not
Spark work: the user passes an extractor and Spark runs it inside tasks
(``mapInPandas``), one instance per task.
"""

from __future__ import annotations

import math
import re
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearsay.session import default_parallelism, scratch_path, ship_package


FILES_PER_TASK = 8
TASKS_PER_CORE = 32         # at most: very many files make longer tasks, not ever more of them
ROWS_AT_ONCE, CHARS_AT_ONCE = 256, 1 << 20


def list_sources(spark: SparkSession, directory: str, fmt: str = "mp4") -> DataFrame:
    """``(file)`` for ``directory/*.fmt``, not recursive, absolute local paths.

    Only the ``path`` column is selected, so file contents are never read, and
    only direct children stay.
    """
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder_pattern(directory))
    if not pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern):
        return spark.createDataFrame([], "file string")
    # The folder is listed at once: a pattern for its files would make each of them a folder to list.
    # Lookup is recursive so that no folder name is taken for a partition (k=v);
    # a folder that matches the pattern is left out with all that it holds.
    listed = spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter=f"*.{fmt}")
    return listed_sources(listed.load(folder_pattern(directory)), directory)


def folder_pattern(directory: str) -> str:
    """A pattern for the folder; the exact parent of what it finds is checked afterwards.

    Pattern characters in the folder's own path match any character.
    """
    return re.sub(r"[\\*?\[\]{}]", "?", directory.rstrip("/"))


def listed_sources(listed: DataFrame, directory: str) -> DataFrame:
    """``(file)`` of the ``path`` rows that lie in ``directory`` itself."""
    spark = listed.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(directory)
    own = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(folder).toString()
    plain = lambda c: F.regexp_replace(c, r"^file:(//)?", "")
    # Hadoop paths are not URL-encoded here: only the scheme is removed.
    files = listed.select(plain(F.col("path")).alias("file"))
    return files.where(F.regexp_replace("file", "/[^/]*$", "") == F.regexp_replace(plain(F.lit(own)), "/$", ""))


def _extracted(sources: DataFrame, make_extractor: Callable[[], Callable[[str], str]], num_tasks: int | None,
               keep_errors: bool) -> DataFrame:
    """``(file, transcript, message)`` of each path, over ``num_tasks`` tasks."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extract = make_extractor()
        done, chars = [], 0
        for pdf in batches:
            for file in pdf["file"].tolist():
                try:
                    done.append((file, extract(file), None))
                except Exception as failed:  # noqa: BLE001  (any error of the user's extractor concerns this file alone)
                    if not keep_errors:
                        raise
                    done.append((file, None, f"{type(failed).__name__}: {failed}"))
                chars += len(done[-1][1] or "")
                if len(done) >= ROWS_AT_ONCE or chars >= CHARS_AT_ONCE:
                    yield pd.DataFrame(done, columns=["file", "transcript", "message"], dtype=object)
                    done, chars = [], 0
        if done:
            yield pd.DataFrame(done, columns=["file", "transcript", "message"], dtype=object)

    ship_package(sources.sparkSession)
    paths = sources.select("file")
    most = TASKS_PER_CORE * default_parallelism(sources.sparkSession)
    count = num_tasks or max(1, min(most, math.ceil(paths.count() / FILES_PER_TASK)))
    return paths.repartition(count).mapInPandas(run, "file string, transcript string, message string")


def extract_transcripts(sources: DataFrame, make_extractor: Callable[[], Callable[[str], str]],
                        num_tasks: int | None = None) -> DataFrame:
    """``(file, transcript)`` for each path, by a user extractor.

    The files, few and slow, are spread over ``num_tasks`` tasks, by default
    one for every ``FILES_PER_TASK`` of them up to ``TASKS_PER_CORE`` for each core. Nothing is kept, and an extractor
    error fails the job that asks for the rows; ``TranscriptStage`` keeps what
    was extracted.
    """
    return _extracted(sources, make_extractor, num_tasks, keep_errors=False).select("file", "transcript")


class TranscriptStage:
    """S2, durable: transcripts and errors by path, kept under one folder.

    Each run of ``extract`` writes a folder ``run=<time>-<id>`` of
    ``(file, transcript, message)``. A file whose extractor raises gets a
    message in place of a transcript, and the others go on. Tasks hand in their
    files one by one, not when the run ends: should the run fail, what finished
    tasks extracted stays, and the next run only takes the rest.
    """

    SCHEMA = "file string, transcript string, message string, run string"

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _folder(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _rows(self) -> DataFrame:
        files, path = self._folder()
        if not files.exists(path):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).option("basePath", self.root).parquet(self.root)

    def transcripts(self) -> DataFrame:
        """``(file, transcript)``; a file that two runs took at once has a row of each."""
        return self._rows().where(F.col("transcript").isNotNull()).select("file", "transcript")

    def errors(self) -> DataFrame:
        """``(file, message, tries)`` of the files without a transcript, with the last message."""
        tried = self._rows().select("file", F.col("transcript").isNotNull().alias("done"), "message", "run")
        return (tried.groupBy("file").agg(F.bool_or("done").alias("done"), F.max_by("message", "run").alias("message"),
                                          F.count(F.lit(1)).alias("tries"))
                .where(~F.col("done")).select("file", "message", "tries"))

    def extract(self, sources: DataFrame, make_extractor: Callable[[], Callable[[str], str]],
                num_tasks: int | None = None) -> None:
        """Extract the distinct paths of ``sources`` that have no transcript here yet."""
        left = sources.select("file").distinct().join(self.transcripts().select("file"), "file", "left_anti")
        to_do = scratch_path(self.spark, "extract")
        left.write.parquet(to_do)
        left = self.spark.read.schema("file string").parquet(to_do)
        if left.isEmpty():
            return
        run = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        # With this committer a task's files are in place as soon as it ends.
        (_extracted(left, make_extractor, num_tasks, keep_errors=True).write
         .option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(f"{self.root}/run={run}"))

    def vacuum(self, indexed: DataFrame) -> list[str]:
        """Delete the runs whose transcripts are all of paths in ``indexed``; returns them.

        Their errors go, too: files that still fail are tried again as new ones.
        """
        files, path = self._folder()
        rows = self._rows()
        runs = {r["run"] for r in rows.select("run").distinct().collect()}
        needed = rows.where(F.col("transcript").isNotNull()).join(indexed.select("file"), "file", "left_anti")
        gone = sorted(runs - {r["run"] for r in needed.select("run").distinct().collect()})
        for run in gone:
            files.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, f"run={run}"), True)
        return gone


def text_file_extractor(encoding: str = "utf-8") -> Callable[[str], str]:
    """An extractor for plain-text 'recordings' (tests, pre-made transcripts)."""
    def extract(path: str) -> str:
        with open(path, encoding=encoding) as fh:
            return fh.read()
    return extract
