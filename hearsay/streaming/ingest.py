"""Index new transcripts, or recordings, as they arrive."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hearsay.plans.ingest import ingest_sources, transcript_stage
from hearsay.sources.media import TranscriptStage
from hearsay.sources.store import IndexStore
from hearsay.streaming.sources import media_stream


def _epochs(spark: SparkSession, name: str, checkpoint: str) -> Callable[[int], str]:
    """Batch ids by epoch. A new checkpoint counts from 0 again, so its own id goes in, too."""
    def batch_id(epoch: int) -> str:
        own = json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        return f"{name}-{own}-{epoch}"
    return batch_id


def _tidy(store: IndexStore, compact_after: int | None, vacuum: bool) -> None:
    if compact_after:
        store.compact_tiers(compact_after)
        if vacuum:
            store.vacuum()


def ingest_stream(corpus_stream: DataFrame, store: IndexStore, checkpoint: str, name: str = "ingest",
                  available_now: bool = True, interval: str = "1 minute",
                  compact_after: int | None = None, vacuum: bool = False) -> StreamingQuery:
    """Each micro-batch of ``(file, transcript)`` becomes index batch ``name-<query>-<epoch>``.

    ``foreachBatch`` is at-least-once; ``IndexStore.append`` makes a replayed
    epoch a no-op once committed and a clean rewrite otherwise, and its
    anti-join skips files any committed batch already holds (the file source
    remembers files per checkpoint; the index remembers them for good).

    ``compact_after``: merge batches of like size once there are that many
    (``IndexStore.compact_tiers``), so a long-running stream neither leaves a
    folder of small files per trigger nor rewrites the index each time.
    ``vacuum``: delete what was merged, where no reader holds an old snapshot.
    """
    batch_id = _epochs(store.spark, name, checkpoint)

    def each(batch: DataFrame, epoch_id: int) -> None:
        store.append(batch, batch_id(epoch_id))
        _tidy(store, compact_after, vacuum)

    writer = corpus_stream.writeStream.queryName(name).foreachBatch(each).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()


def ingest_media_stream(spark: SparkSession, directory: str, store: IndexStore, make_extractor: Callable[[], Callable[[str], str]],
                        checkpoint: str, fmt: str = "mp4", name: str = "media", available_now: bool = True,
                        interval: str = "1 minute", compact_after: int | None = None, vacuum: bool = False,
                        num_tasks: int | None = None, max_files: int | None = None, tries: int = 3,
                        stage: TranscriptStage | None = None) -> StreamingQuery:
    """Poll ``directory/*.fmt`` and index each new recording: S1, J2, S2 and S5 per epoch.

    Paths that the index has are not extracted, whatever the checkpoint says.
    Transcripts are kept as they come (``ingest_sources``), so an epoch that is
    replayed extracts only what it had not. A file whose extractor raises is
    tried again with later epochs, ``tries`` times in all; ``stage.errors()``
    lists it. Only the first epoch of a new checkpoint tries those again that
    had as many. The driver holds no list of the files (``media_stream``).
    """
    stage = stage or transcript_stage(store)
    batch_id = _epochs(spark, name, checkpoint)

    def each(batch: DataFrame, epoch_id: int) -> None:
        failed, files = stage.errors(), batch.select("file")
        if epoch_id > 0 and not max_files:      # an epoch brings all files of the folder
            files = files.join(failed.where(F.col("tries") >= tries).select("file"), "file", "left_anti")
        again = failed.where(F.col("tries") < tries).select("file")
        ingest_sources(store, files.union(again), make_extractor, batch_id(epoch_id), num_tasks, stage)
        _tidy(store, compact_after, vacuum)

    stream = media_stream(spark, directory, fmt, max_files)
    writer = stream.writeStream.queryName(name).foreachBatch(each).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()
