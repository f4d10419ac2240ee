"""Ingest: sources → new ones only → transcripts → index batch → commit."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame

from hearsay.operators import indexing as ix
from hearsay.session import scratch_path
from hearsay.sources.media import TranscriptStage
from hearsay.sources.store import IndexStore


def new_batch_id() -> str:
    return uuid.uuid4().hex


def ingest_corpus(store: IndexStore, corpus: DataFrame, batch_id: str | None = None) -> int:
    """Index ready transcripts ``(file, transcript)``; returns the number new."""
    return store.append(corpus, batch_id or new_batch_id())


def ingest_sources(store: IndexStore, sources: DataFrame, make_extractor: Callable[[], Callable[[str], str]],
                   batch_id: str | None = None, num_tasks: int | None = None, stage: TranscriptStage | None = None) -> int:
    """A8 from media paths ``(file)``: known paths are skipped *before* extraction.

    ``make_extractor`` builds the path → transcript function once per task
    (a speech model loads once per task, not per file). Transcripts are kept in
    ``stage`` (by default a folder of the index) as they come: what a failed run
    extracted is not extracted again. Files whose extractor raises are left out
    of the batch and listed in ``stage.errors()``; a later call tries them again.
    """
    batch_id = batch_id or new_batch_id()
    if store.is_committed(batch_id):
        return 0
    stage = stage or transcript_stage(store)
    fresh = scratch_path(store.spark, "fresh")
    ix.new_sources(sources.select("file"), store.known_files(store.visible_batches())).write.parquet(fresh)
    fresh = store.spark.read.schema("file string").parquet(fresh)
    stage.extract(fresh, make_extractor, num_tasks)
    return store.append(stage.transcripts().join(fresh, "file", "left_semi"), batch_id)


def transcript_stage(store: IndexStore) -> TranscriptStage:
    """The folder of an index where transcripts wait to be indexed."""
    return TranscriptStage(store.spark, store.path("transcripts"))
