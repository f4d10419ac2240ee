"""Headline timings; prints ONE JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

  index_build      documents table → committed Parquet index (documents, postings, lexicon)
  search_one       one search, k = 3, over the committed index
  search_batch     every benchmark line as a query, top 3 each, one job
  ingest_more      the conversations table as a second batch (incremental ingest)
  search_after     the batch search again over both batches
  search_one_term  a one-term search (no aggregation, no shuffle)
  compact          both batches rewritten as one sorted batch
  search_compacted the batch search over the compacted index
A warm-up ingest + search on sf0.001 runs first, untimed; searches report the median of 3 runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from pyspark.sql import functions as F

    from hearsay.plans.ingest import ingest_corpus
    from hearsay.plans.search import search, search_batch
    from hearsay.session import get_spark, scratch_path
    from hearsay.sources.corpus import benchmark_queries, conversations_corpus, documents_corpus
    from hearsay.sources.store import IndexStore

    spark = get_spark(f"local[{cpus}]", spark_sql_shuffle_partitions=str(cpus), spark_driver_memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    info: dict[str, int] = {}

    def timed(name, fn):
        t0 = time.perf_counter()
        out = fn()
        times[name] = round(time.perf_counter() - t0, 3)
        return out

    def median_of(name, fn, runs=3):
        samples = []
        for _ in range(runs):
            t0 = time.perf_counter()
            fn()
            samples.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(samples), 3)

    # Warm-up on the smallest tables (JIT, Python workers); not timed.
    warm_dir = os.path.join(os.path.dirname(sf_dir), "sf0.001")
    if os.path.isdir(warm_dir):
        warm = IndexStore(spark, scratch_path(spark, "bench-warmup")).create()
        ingest_corpus(warm, documents_corpus(spark, warm_dir), "warmup")
        search_batch(warm.index(), benchmark_queries(spark, warm_dir).select("query_id", "terms"), 3).collect()

    store = IndexStore(spark, scratch_path(spark, "bench-index")).create()
    info["documents"] = timed("index_build", lambda: ingest_corpus(store, documents_corpus(spark, sf_dir), "documents"))

    median_of("search_one", lambda: search(store.index(), ["tion", "ed", "the", "zzzz", "ed"], 3).collect())
    median_of("search_one_term", lambda: search(store.index(), ["tion"], 3).collect())

    queries = benchmark_queries(spark, sf_dir).where(F.col("status") == "ok").select("query_id", "terms")
    info["queries"] = queries.count()
    median_of("search_batch", lambda: search_batch(store.index(), queries, 3).collect())

    info["ingested_more"] = timed(
        "ingest_more", lambda: ingest_corpus(store, conversations_corpus(spark, sf_dir), "conversations"))
    median_of("search_after", lambda: search_batch(store.index(), queries, 3).collect())
    timed("compact", store.compact)
    median_of("search_compacted", lambda: search_batch(store.index(), queries, 3).collect())

    print(json.dumps({
        "metric": "total_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir).replace("sf", ""),
        "cpus": int(cpus),
        "counts": info,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
