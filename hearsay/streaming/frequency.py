"""R2: running document frequency per term as documents arrive.

State: the seen paths (``dropDuplicates`` on file, so a re-sent file counts
once) and one count per term. Neither has a time column, so neither can be
bounded by a watermark: state grows with the collection, which is why the
session defaults pick the RocksDB state store (state on local disk,
checkpointed to the shared folder, not on the JVM heap).

``frequency_from_index`` starts from what an index has counted already, so the
state holds only what came since, and a lost checkpoint costs no count that the
index has. ``FrequencyTable`` keeps the result and folds old epochs.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hearsay.operators.indexing import LEXICON_SCHEMA, analyze
from hearsay.session import drop_folder
from hearsay.sources.store import IndexStore


def document_frequency_stream(corpus_stream: DataFrame, stop_words: Iterable[str] | None = None,
                              known: DataFrame | None = None) -> DataFrame:
    """Streaming ``(term, df)``; use update mode (``write_frequency_updates``).

    Documents whose ``file`` is in ``known`` are not counted.
    """
    # Only a file's distinct terms are shuffled to the seen paths, not its transcript.
    runs = analyze(corpus_stream, stop_words).select("file", F.col("runs.term").alias("terms"))
    if known is not None:
        runs = runs.join(known.select("file"), "file", "left_anti")     # on the key that the seen paths shuffle by
    terms = runs.dropDuplicates(["file"]).select(F.explode_outer("terms").alias("term")).where(F.col("term").isNotNull())
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def write_frequency_updates(df_stream: DataFrame, path: str, checkpoint: str, name: str = "document_frequency",
                            available_now: bool = True, interval: str = "1 minute") -> StreamingQuery:
    """Append each epoch's changed ``(term, df)`` rows under ``epoch=<n>``.

    A replayed epoch overwrites its own folder, so the table never double counts; ``read_frequency_state`` keeps the latest.
    """
    def each(batch: DataFrame, epoch_id: int) -> None:
        # The folder itself is overwritten, so a replay that has no rows leaves none.
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch_id}")

    writer = (df_stream.writeStream.queryName(name).outputMode("update").foreachBatch(each)
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()


def read_frequency_state(spark: SparkSession, path: str) -> DataFrame:
    """Current ``(term, df)``: the value from each term's latest epoch."""
    updates = spark.read.schema("term string, df bigint, epoch bigint").parquet(path)
    return updates.groupBy("term").agg(F.max_by("df", "epoch").cast("bigint").alias("df"))


class FrequencyTable:
    """Running ``(term, df)`` in a folder: runs that each start from an index, with folded updates.

    Layout under ``root``::

        run=<number>-<id>/lexicon/                  (term, df) of the index when the run began
        run=<number>-<id>/paths/                    (file) that this lexicon counts
        run=<number>-<id>/updates/<first>-<last>/   (term, df) of the terms that changed in these epochs

    A checkpoint names its run; a new checkpoint begins a new one. The table is
    the newest run's: a term's df is the greatest it has there, as df only grows
    within a run. Folders appear by a rename once they are whole. ``fan_in``
    neighbouring updates of like length are folded into one, so that after n
    epochs at most ``fan_in - 1`` for each power of ``fan_in`` up to n stand for
    all, and a row is rewritten once for each. What was folded is deleted an epoch
    later, for readers that had listed it.
    """

    def __init__(self, spark: SparkSession, root: str, fan_in: int = 4):
        if fan_in < 2:
            raise ValueError("fan_in must be 2 or more")
        self.spark, self.root, self.fan_in = spark, root.rstrip("/"), fan_in

    def _fs(self, path: str):
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), folder

    def _names(self, path: str) -> list[str]:
        """Names in a folder, but for those of unfinished writes."""
        fs, folder = self._fs(path)
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(n for n in names if n[0] not in "._")

    def _rename(self, draft: str, path: str) -> None:
        fs, source = self._fs(draft)
        if not fs.rename(source, self._fs(path)[1]):
            raise OSError(f"cannot rename {draft} to {path}")

    # ---- runs -------------------------------------------------------------
    def runs(self) -> list[str]:
        return [n for n in self._names(self.root) if n.startswith("run=")]

    def begin(self, store: IndexStore, checkpoint: str) -> str:
        """The run of a checkpoint; a checkpoint without one gets a new run from one snapshot of the index."""
        pointer = f"{checkpoint.rstrip('/')}/frequency-run"
        fs, folder = self._fs(pointer)
        if fs.exists(folder):
            return self.spark.read.text(pointer).first()[0]
        run = f"run={max((int(r[4:14]) for r in self.runs()), default=0) + 1:010d}-{uuid.uuid4().hex[:12]}"
        lexicon, paths = store.counted()
        lexicon.write.parquet(f"{self.root}/_{run}/lexicon")
        paths.select("file").write.parquet(f"{self.root}/_{run}/paths")
        fs.mkdirs(self._fs(f"{self.root}/_{run}/updates")[1])
        self._rename(f"{self.root}/_{run}", f"{self.root}/{run}")
        draft = f"{checkpoint.rstrip('/')}/_frequency-run-{uuid.uuid4().hex}"
        self.spark.createDataFrame([(run,)], "value string").coalesce(1).write.text(draft)
        self._rename(draft, pointer)
        return run

    def known(self, run: str) -> DataFrame:
        """``(file)`` that the run's lexicon counts."""
        return self.spark.read.schema("file string").parquet(f"{self.root}/{run}/paths")

    def lexicon(self, run: str) -> DataFrame:
        return self.spark.read.schema(LEXICON_SCHEMA).parquet(f"{self.root}/{run}/lexicon")

    # ---- updates ------------------------------------------------------------
    def _updates(self, run: str) -> list[tuple[int, int]]:
        return sorted(tuple(map(int, n.split("-"))) for n in self._names(f"{self.root}/{run}/updates"))

    def updates(self, run: str) -> list[tuple[int, int]]:
        """First and last epoch of the updates that stand for all."""
        every = self._updates(run)
        return [r for r in every if not any(a <= r[0] and r[1] <= b for a, b in every if (a, b) != r)]

    def _path(self, run: str, update: tuple[int, int]) -> str:
        return f"{self.root}/{run}/updates/{update[0]}-{update[1]}"

    def _put(self, rows: DataFrame, run: str, update: tuple[int, int]) -> None:
        draft = f"{self.root}/{run}/updates/_{uuid.uuid4().hex}"
        rows.select("term", "df").write.parquet(draft)
        self._rename(draft, self._path(run, update))

    def _tier(self, update: tuple[int, int]) -> int:
        tier, length = 0, update[1] - update[0] + 1
        while length >= self.fan_in ** (tier + 1):
            tier += 1
        return tier

    def add(self, run: str, since: DataFrame, epoch: int) -> None:
        """Take an epoch's ``(term, df)``, counted since the run began; a replayed epoch changes nothing."""
        kept = self.updates(run)
        for old in self._updates(run):
            if old not in kept:
                drop_folder(self.spark, self._path(run, old))
        if not any(a <= epoch <= b for a, b in kept):
            begun = self.lexicon(run).withColumnRenamed("df", "begun")
            df = (F.col("df") + F.coalesce("begun", F.lit(0))).alias("df")
            self._put(since.join(begun, "term", "left").select("term", df), run, (epoch, epoch))
            kept.append((epoch, epoch))
        while len(kept) >= self.fan_in and self._tier(kept[-self.fan_in]) <= self._tier(kept[-1]):
            some = kept[-self.fan_in:]
            whole = (some[0][0], some[-1][1])
            self._put(self._greatest([self._path(run, u) for u in some]), run, whole)
            kept[-self.fan_in:] = [whole]

    def _greatest(self, paths: list[str]) -> DataFrame:
        rows = self.spark.read.schema(LEXICON_SCHEMA).parquet(*paths)
        return rows.groupBy("term").agg(F.max("df").alias("df"))

    def read(self) -> DataFrame:
        """Current ``(term, df)``; empty before the first run."""
        runs = self.runs()
        if not runs:
            return self.spark.createDataFrame([], LEXICON_SCHEMA)
        updates = [self._path(runs[-1], u) for u in self.updates(runs[-1])]
        return self._greatest([f"{self.root}/{runs[-1]}/lexicon", *updates])


def frequency_from_index(corpus_stream: DataFrame, store: IndexStore, table: FrequencyTable, checkpoint: str,
                         name: str = "document_frequency", available_now: bool = True,
                         interval: str = "1 minute") -> StreamingQuery:
    """R2 from an index: ``table`` begins with its df, and the stream adds documents that it has not.

    The snapshot is fixed when a checkpoint is first used and is not read anew
    after restarts, so documents that are indexed later count once. If the
    checkpoint is lost, the stream begins a new run from the index as it is then
    and counts again only what the index has not; what neither the index nor the
    stream's source holds any more is no longer counted. A null transcript counts
    nothing; a file that comes again counts once.
    """
    run = table.begin(store, checkpoint)
    df_stream = document_frequency_stream(corpus_stream, store.settings_stop_words(), table.known(run))

    def each(batch: DataFrame, epoch_id: int) -> None:
        table.add(run, batch, epoch_id)

    writer = (df_stream.writeStream.queryName(name).outputMode("update").foreachBatch(each)
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()
