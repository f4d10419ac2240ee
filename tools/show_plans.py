"""Write docs/PLANS.md: the physical plans of the main jobs, after execution.

    python tools/show_plans.py [sf_dir]
"""

from __future__ import annotations

import contextlib
import io
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def tree(df, run: bool = True) -> str:
    if run:
        df.collect()
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    cut = text.find("\n\n(1)")
    head = (text[:cut] if cut > 0 else text).rstrip()
    scans = []
    for block in text[cut:].split("\n\n"):
        lines = block.strip().split("\n")
        if lines and "Scan parquet" in lines[0]:
            keep = [ln for ln in lines[1:] if ln.split(":")[0] in ("Location", "PartitionFilters", "PushedFilters",
                                                                   "ReadSchema")]
            scans.append("\n".join([lines[0]] + [ln[:200] for ln in keep]))
    return head + ("\n\n" + "\n\n".join(scans) if scans else "")


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    from pyspark.sql import functions as F

    from hearsay.operators import indexing as ix
    from hearsay.plans.ingest import ingest_corpus
    from hearsay.plans.search import search, search_batch
    from hearsay.session import get_spark, scratch_path
    from hearsay.sources.corpus import benchmark_queries, documents_corpus
    from hearsay.sources.store import IndexStore

    spark = get_spark("local[8]", spark_sql_shuffle_partitions="8")
    spark.sparkContext.setLogLevel("ERROR")
    store = IndexStore(spark, scratch_path(spark, "plans")).create()
    ingest_corpus(store, documents_corpus(spark, sf_dir), "documents")
    queries = benchmark_queries(spark, sf_dir).where(F.col("status") == "ok").select("query_id", "terms")
    batch_docs = store._committed("documents", store.visible_batches())
    sections = [
        ("Index build: documents (tokenise + count in the row; the only exchange spreads a one-row-group input)",
         tree(ix.build_documents(documents_corpus(spark, sf_dir)), run=False)),
        ("Index build: postings written range-partitioned on (term, file) and sorted",
         tree(ix.postings_from_documents(batch_docs).repartitionByRange("term", "file")
              .sortWithinPartitions("term", "file"), run=False)),
        ("One search (Q2), after execution", tree(search(store.index(), ["tion", "ed", "the", "zzzz", "ed"], 3))),
        ("One-term search (Q2), after execution: no aggregation, no shuffle of postings",
         tree(search(store.index(), ["tion"], 3))),
        ("Query table (Q3), after execution", tree(search_batch(store.index(), queries, 3))),
    ]
    out = ["# Physical plans", "", f"Generated by `tools/show_plans.py {sf_dir}` on local[8]. Node details omitted.", ""]
    for title, text in sections:
        out += [f"## {title}", "", "```", text, "```", ""]
    os.makedirs("docs", exist_ok=True)
    with open("docs/PLANS.md", "w") as fh:
        fh.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
