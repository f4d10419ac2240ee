"""Answer each arriving query with its top k."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from hearsay.plans.index import TfIdfIndex
from hearsay.plans.search import search_batch
from hearsay.session import drop_folder, scratch_path


def search_stream(query_stream: DataFrame, index: TfIdfIndex | Callable[[], TfIdfIndex], results_path: str,
                  checkpoint: str, k: int = 3, name: str = "search", round_to: int | None = None,
                  available_now: bool = True, interval: str = "1 second") -> StreamingQuery:
    """Each micro-batch of ``(query_id, terms)`` is one ``search_batch`` job.

    Pass a callable (e.g. ``store.index``) to search a fresh committed
    snapshot per micro-batch, so documents ingested meanwhile are found.
    Over a stored index an epoch reads the buckets of its terms and the blocks
    that can hold a result (``search_batch``). Any number of terms per query, as
    the socket front end accepts. Results
    ``(query_id, rank, file, score)`` go under ``epoch=<n>``; a replayed
    epoch overwrites its own folder.
    """
    def each(batch: DataFrame, epoch_id: int) -> None:
        snapshot = index() if callable(index) else index
        spark = batch.sparkSession
        scratch = scratch_path(spark, name)
        res = search_batch(snapshot, batch, k, round_to=round_to, scratch=scratch)
        # The folder itself is overwritten, so a replay that has no rows leaves none.
        res.write.mode("overwrite").parquet(f"{results_path}/epoch={epoch_id}")
        drop_folder(spark, scratch)

    writer = query_stream.writeStream.queryName(name).foreachBatch(each).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()
