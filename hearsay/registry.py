"""Every operator of the inventory as a query over the driver's tables.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame with flat,
aliased columns; ``hearsay.oracle`` holds the DuckDB SQL for the same
result. The corpus is the whole ``documents`` table (file = doc_id as text),
the queries are every line of every ``benchmark`` text.

Scores are rounded to 6 decimals and ranked on the rounded value, so that
summation order cannot change a tie.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearsay.functions import text as tx
from hearsay.operators import indexing as ix
from hearsay.operators import output as out
from hearsay.operators import scoring as sc
from hearsay.plans.index import TfIdfIndex, build_index, merge_indexes
from hearsay.plans.search import scored_candidates, search, search_batch
from hearsay.sources import interchange
from hearsay.sources.corpus import benchmark_queries, conversations_corpus, documents_corpus

ROUND = 6
FLAGSHIP_TERMS = ["tion", "ed", "the", "zzzz", "ed"]   # repeated, stop word, absent term
K1_TERMS = ["oureon", "èierou", "tion"]
LOOKUP_TERM = "tion"
K = 3


def _index(spark: SparkSession, sf_dir: str) -> TfIdfIndex:
    return build_index(documents_corpus(spark, sf_dir))


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_queries(spark, sf_dir).where(F.col("status") == "ok").select("query_id", "terms")


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` from a new folder: transcripts are tokenised once, however often it is used."""
    from hearsay.session import scratch_path

    folder = scratch_path(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _tf_map_text(c: str = "term_frequencies"):
    """A term map as ``term:count`` pairs in term order (comparable text)."""
    return F.array_join(
        F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))),
        " ")


def _round(c: str = "score"):
    return F.round(F.col(c), ROUND).alias(c)


# ---- sources / text -------------------------------------------------------

def s3_read_corpus(spark, sf_dir):
    from hearsay.sources.corpus import read_corpus

    return read_corpus(spark, f"{sf_dir}/documents.parquet", file_col="doc_id", text_col="text")


def t1_strip_punctuation(spark, sf_dir):
    return documents_corpus(spark, sf_dir).select("file", tx.strip_punctuation("transcript").alias("stripped"))


def t2_normalize(spark, sf_dir):
    return documents_corpus(spark, sf_dir).select("file", tx.normalize("transcript").alias("transcription"))


def t3_tokenize(spark, sf_dir):
    toks = documents_corpus(spark, sf_dir).select("file", tx.tokenize(tx.normalize("transcript")).alias("t"))
    return toks.select("file", F.size("t").cast("bigint").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


def t4_remove_stop_words(spark, sf_dir):
    toks = documents_corpus(spark, sf_dir).select(
        "file", tx.remove_stop_words(tx.tokenize(tx.normalize("transcript"))).alias("t"))
    return toks.select("file", F.size("t").cast("bigint").alias("n_kept"), F.array_join("t", " ").alias("kept"))


def t5_document_terms(spark, sf_dir):
    return ix.document_terms(documents_corpus(spark, sf_dir)).select(
        "file", F.col("pos").cast("bigint").alias("pos"), "term")


def t6_path_display(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    windows_path = F.concat_ws("\\", "source", F.col("doc_id").cast("string"))
    return docs.select(F.col("doc_id").cast("string").alias("file"), tx.path_display(windows_path).alias("display"))


# ---- aggregations ---------------------------------------------------------

def a1_term_counts(spark, sf_dir):
    return ix.term_counts(_index(spark, sf_dir).postings)


def a2_num_terms(spark, sf_dir):
    return ix.num_terms(_index(spark, sf_dir).documents)


def a3_term_frequency_map(spark, sf_dir):
    return ix.term_frequency_map(_index(spark, sf_dir).documents).select("file", _tf_map_text().alias("tf_map"))


def a4_inverted_index(spark, sf_dir):
    view = ix.inverted_index(_index(spark, sf_dir).postings, chunk_size=100)
    return view.select("term", F.explode("documents").alias("file"))


def a5_corpus_size(spark, sf_dir):
    return ix.corpus_size(_index(spark, sf_dir).documents)


def a6_document_frequency(spark, sf_dir):
    return ix.document_frequency(_index(spark, sf_dir).postings)


def a7_score_documents(spark, sf_dir):
    scores = scored_candidates(_index(spark, sf_dir), _queries(spark, sf_dir))
    return scores.select("query_id", "file", _round())


# ---- filters, look-ups, joins ---------------------------------------------

def _sources(spark, sf_dir):
    return documents_corpus(spark, sf_dir).select("file").unionByName(
        conversations_corpus(spark, sf_dir).select("file"))


def j1_is_indexed(spark, sf_dir):
    return ix.is_indexed(_sources(spark, sf_dir), _index(spark, sf_dir).documents)


def j2_new_sources(spark, sf_dir):
    return ix.new_sources(_sources(spark, sf_dir), _index(spark, sf_dir).documents).select("file")


def j3_lookup_term(spark, sf_dir):
    return ix.lookup_term(_index(spark, sf_dir).postings, LOOKUP_TERM)


def _matched(spark, sf_dir):
    idx = _index(spark, sf_dir)
    return idx, sc.query_terms(_queries(spark, sf_dir))


def j4_match_terms(spark, sf_dir):
    idx, qterms = _matched(spark, sf_dir)
    return sc.match_terms(qterms, idx.postings)


def j5_lookup_documents(spark, sf_dir):
    idx, qterms = _matched(spark, sf_dir)
    cands = sc.candidate_documents(sc.match_terms(qterms, idx.postings))
    return ix.lookup_documents(idx.documents, cands).select("file", "num_terms", _tf_map_text().alias("tf_map"))


def j6_query_term_frequencies(spark, sf_dir):
    idx, qterms = _matched(spark, sf_dir)
    matched = _written(sc.match_terms(qterms, idx.postings), "j6")       # used twice
    return sc.query_term_frequencies(matched, sc.candidate_documents(matched), qterms)


# ---- set operations -------------------------------------------------------

def u1_candidate_documents(spark, sf_dir):
    idx, qterms = _matched(spark, sf_dir)
    return sc.candidate_documents(sc.match_terms(qterms, idx.postings))


def _merged(spark, sf_dir):
    return merge_indexes(_index(spark, sf_dir), build_index(conversations_corpus(spark, sf_dir)))


def u2_merge_postings(spark, sf_dir):
    return _merged(spark, sf_dir).postings


def u2_merged_document_frequency(spark, sf_dir):
    return _merged(spark, sf_dir).lexicon


# ---- TF-IDF math ----------------------------------------------------------

def m1_idf(spark, sf_dir):
    idx = _index(spark, sf_dir)
    from hearsay.functions.tfidf import idf
    return idx.lexicon.select("term", "df", F.round(idf(idx.n_documents(), F.col("df")), ROUND).alias("idf"))


def m2_query_idf(spark, sf_dir):
    idx, qterms = _matched(spark, sf_dir)
    return sc.query_idf(qterms, idx.lexicon, idx.n_documents()).select(
        "query_id", "term", "df", _round("idf"))


def m3_tf(spark, sf_dir):
    from hearsay.functions.tfidf import tf
    p = _index(spark, sf_dir).postings
    return p.select("file", "term", F.round(tf(F.col("tf_count"), F.col("num_terms")), 9).alias("tf"))


def m4_tf_idf(spark, sf_dir):
    idx, qterms = _matched(spark, sf_dir)
    matched = sc.match_terms(qterms, idx.postings)
    idfs = sc.query_idf(qterms, idx.lexicon, idx.n_documents())
    return sc.term_tf_idf(matched, idfs).select("query_id", "file", "term", _round("tf_idf"))


# ---- top-k, search --------------------------------------------------------

def k1_top_k(spark, sf_dir):
    return search(_index(spark, sf_dir), K1_TERMS, K, round_to=ROUND).select("rank", "file", _round())


def k2_top_k_per_query(spark, sf_dir):
    scores = scored_candidates(_index(spark, sf_dir), _queries(spark, sf_dir))
    return sc.top_k_per_query(scores, K, round_to=ROUND).select("query_id", "rank", "file", _round())


def q1_parse_query(spark, sf_dir):
    lines = benchmark_queries(spark, sf_dir).select("query_id", "line")
    parsed = lines.select("query_id", sc.parse_query("line", max_terms=5).alias("q"))
    return parsed.select("query_id", "q.status", F.size("q.terms").cast("bigint").alias("n_terms"),
                         F.array_join("q.terms", " ").alias("terms"))


def q2_search(spark, sf_dir):
    return search(_index(spark, sf_dir), FLAGSHIP_TERMS, K, round_to=ROUND).select("rank", "file", _round())


def q2_search_one_term(spark, sf_dir):
    return search(_index(spark, sf_dir), [LOOKUP_TERM], K, round_to=ROUND).select("rank", "file", _round())


def q3_search_batch(spark, sf_dir):
    res = search_batch(_index(spark, sf_dir), _queries(spark, sf_dir), K, round_to=ROUND)
    return res.select("query_id", "rank", "file", _round())


def q2_search_stored(spark, sf_dir):
    idx = _two_batch_store(spark, sf_dir, "q2s").index()
    return search(idx, FLAGSHIP_TERMS, K, round_to=ROUND).select("rank", "file", _round())


def q3_search_stored(spark, sf_dir):
    """Bounds by block over both batches of a store; the same rows as a search of everything."""
    idx = _two_batch_store(spark, sf_dir, "q3s").index()
    return search_batch(idx, _queries(spark, sf_dir), K, round_to=ROUND).select("query_id", "rank", "file", _round())


def a7_score_stored_documents(spark, sf_dir):
    scores = scored_candidates(_two_batch_store(spark, sf_dir, "a7s").index(), _queries(spark, sf_dir))
    return scores.select("query_id", "file", _round())


# ---- output shaping -------------------------------------------------------

def o1_format_results(spark, sf_dir):
    res = q3_search_batch(spark, sf_dir)
    return res.select("query_id", "rank", out.format_result("score", "file").alias("line"))


def o2_results_json(spark, sf_dir):
    queries = benchmark_queries(spark, sf_dir).select("query_id")
    res = q3_search_batch(spark, sf_dir)
    return out.results_json(queries, res, elapsed_ms=0)


# ---- interchange ----------------------------------------------------------

def s8_export_index(spark, sf_dir):
    return interchange.export_documents(_index(spark, sf_dir).documents)


def s7_import_index(spark, sf_dir):
    docs = interchange.import_documents(interchange.export_documents(_index(spark, sf_dir).documents))
    return docs.select("file", "num_terms", _tf_map_text().alias("tf_map"))


def s8_export_terms(spark, sf_dir):
    _, terms = interchange.export_index(_index(spark, sf_dir))
    return terms.select("term", F.explode(F.from_json("documents", "array<string>")).alias("file"))


def s7_import_terms(spark, sf_dir):
    return interchange.import_terms(interchange.export_terms(_index(spark, sf_dir).postings))


def s7_import_whole_index(spark, sf_dir):
    from hearsay.session import scratch_path

    # Three tables are made from the documents.
    index = build_index(documents_corpus(spark, sf_dir), scratch=scratch_path(spark, "s7"))
    idx = interchange.import_index(*interchange.export_index(index))
    return idx.postings.join(idx.lexicon, "term").select("term", "file", "tf_count", "num_terms", "df")


# ---- the Parquet index store (S4–S6, A8) -----------------------------------

def _store(spark: SparkSession, name: str):
    from hearsay.session import scratch_path
    from hearsay.sources.store import IndexStore

    return IndexStore(spark, scratch_path(spark, name)).create()


def s5_append_documents(spark, sf_dir):
    from hearsay.plans.ingest import ingest_corpus

    store = _store(spark, "s5")
    ingest_corpus(store, documents_corpus(spark, sf_dir), batch_id="documents")
    return store.documents().select("file", "transcription", "num_terms", _tf_map_text().alias("tf_map"))


def _two_batch_store(spark, sf_dir, name):
    from hearsay.plans.ingest import ingest_corpus

    store = _store(spark, name)
    ingest_corpus(store, documents_corpus(spark, sf_dir), batch_id="documents")
    ingest_corpus(store, conversations_corpus(spark, sf_dir), batch_id="conversations")
    return store


def s6_scan_terms(spark, sf_dir):
    return _two_batch_store(spark, sf_dir, "s6").postings()


def s6_scan_lexicon(spark, sf_dir):
    return _two_batch_store(spark, sf_dir, "s6").lexicon()


def s6_scan_document_lists(spark, sf_dir):
    from hearsay.sources.store import scan_terms

    return scan_terms(_two_batch_store(spark, sf_dir, "s6")).select("term", F.explode("documents").alias("file"))


def s6_scan_documents(spark, sf_dir):
    from hearsay.sources.store import scan_documents

    docs = scan_documents(_two_batch_store(spark, sf_dir, "s6"))
    return docs.select("file", "transcription", "num_terms", _tf_map_text().alias("tf_map"))


def u2_compacted_postings(spark, sf_dir):
    store = _two_batch_store(spark, sf_dir, "u2c")
    store.compact()
    store.vacuum()
    return store.postings()


def u2_tiered_postings(spark, sf_dir):
    """Four batches, merged by size in tiers of two while they come; what was merged goes before the next comes."""
    from hearsay.plans.ingest import ingest_corpus

    store = _store(spark, "u2t")
    corpus = documents_corpus(spark, sf_dir)
    for part in range(4):
        ingest_corpus(store, corpus.where(F.pmod(F.xxhash64("file"), F.lit(4)) == part), batch_id=f"part-{part}")
        store.compact_tiers(2)
        store.vacuum()
    return store.postings()


def a8_ingest_count(spark, sf_dir):
    from hearsay.plans.ingest import ingest_corpus

    store = _store(spark, "a8")
    first = ingest_corpus(store, documents_corpus(spark, sf_dir), batch_id="b1")
    again = ingest_corpus(store, documents_corpus(spark, sf_dir), batch_id="b2")
    second = ingest_corpus(store, conversations_corpus(spark, sf_dir), batch_id="b3")
    counts = store.commits().select(F.col("batch_id"), F.col("n_documents"))
    return counts.select(F.when(F.col("batch_id") == "b1", first).when(F.col("batch_id") == "b2", again)
                         .otherwise(second).cast("bigint").alias("returned"), "batch_id", "n_documents")


# ---- recordings (S1, S2, R1) -------------------------------------------------

MEDIA = "txt"


def _recordings(spark, sf_dir, name):
    """A folder with one plain-text recording per document; a recording ends with a line feed.

    Extractors open local paths, so tasks write them plainly. Spark's writer
    takes many milliseconds for each file, and the driver then moves them one by one.
    """
    import os

    from hearsay.session import local_path, scratch_path

    folder = scratch_path(spark, name)
    docs = documents_corpus(spark, sf_dir).where(F.col("transcript").isNotNull())
    local = local_path(folder)
    os.makedirs(local)

    def write(batches):
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for pdf in batches:
            for transcript in pdf["transcript"]:
                # A task that runs again writes the same names.
                with open(f"{local}/part-{part:05d}-{n:09d}.txt", "wb") as recording:
                    recording.write(transcript.encode() + b"\n")
                n += 1
            yield pdf[:0]

    docs.select("transcript").mapInPandas(write, "transcript string").write.format("noop").mode("overwrite").save()
    return folder


def _exact_text():
    """An extractor that changes no line end."""
    def extract(path: str) -> str:
        with open(path, encoding="utf-8", newline="") as recording:
            return recording.read()
    return extract


def s2_staged_transcripts(spark, sf_dir):
    from hearsay.session import scratch_path
    from hearsay.sources.media import TranscriptStage, list_sources

    stage = TranscriptStage(spark, scratch_path(spark, "s2-stage"))
    stage.extract(list_sources(spark, _recordings(spark, sf_dir, "s2"), MEDIA), _exact_text)
    return stage.transcripts().select("transcript")


def r1_ingest_media_stream(spark, sf_dir):
    from hearsay.session import scratch_path
    from hearsay.streaming.ingest import ingest_media_stream

    store = _store(spark, "r1m")
    q = ingest_media_stream(spark, _recordings(spark, sf_dir, "r1m-media"), store, _exact_text,
                            scratch_path(spark, "r1m-ckpt"), fmt=MEDIA, name="r1_media")
    q.awaitTermination()
    return store.documents().select("transcription", "num_terms", _tf_map_text().alias("tf_map"))


# ---- streaming (R1–R3) ------------------------------------------------------

def r1_ingest_stream(spark, sf_dir):
    from hearsay.session import scratch_path
    from hearsay.streaming.ingest import ingest_stream
    from hearsay.streaming.sources import documents_corpus_stream

    store = _store(spark, "r1")
    q = ingest_stream(documents_corpus_stream(spark, sf_dir), store, scratch_path(spark, "r1-ckpt"), name="r1_ingest")
    q.awaitTermination()
    return store.documents().select("file", "num_terms")


def r2_document_frequency_stream(spark, sf_dir):
    from hearsay.session import scratch_path
    from hearsay.streaming.frequency import (document_frequency_stream, read_frequency_state,
                                             write_frequency_updates)
    from hearsay.streaming.sources import documents_corpus_stream

    out_path = scratch_path(spark, "r2-state")
    q = write_frequency_updates(document_frequency_stream(documents_corpus_stream(spark, sf_dir)), out_path,
                                scratch_path(spark, "r2-ckpt"), name="r2_document_frequency")
    q.awaitTermination()
    return read_frequency_state(spark, out_path)


def r2_frequency_from_index(spark, sf_dir):
    """The documents are indexed; a stream brings them again, and the conversations."""
    from hearsay.plans.ingest import ingest_corpus
    from hearsay.session import scratch_path
    from hearsay.streaming.frequency import FrequencyTable, frequency_from_index
    from hearsay.streaming.sources import conversations_corpus_stream, documents_corpus_stream

    store = _store(spark, "r2i")
    ingest_corpus(store, documents_corpus(spark, sf_dir), batch_id="documents")
    table = FrequencyTable(spark, scratch_path(spark, "r2i-table"))
    stream = documents_corpus_stream(spark, sf_dir).union(conversations_corpus_stream(spark, sf_dir))
    frequency_from_index(stream, store, table, scratch_path(spark, "r2i-ckpt"), name="r2_from_index").awaitTermination()
    return table.read()


def r3_search_stream(spark, sf_dir):
    from hearsay.plans.ingest import ingest_corpus
    from hearsay.session import scratch_path
    from hearsay.streaming.search import search_stream
    from hearsay.streaming.sources import benchmark_query_stream

    store = _store(spark, "r3")
    ingest_corpus(store, documents_corpus(spark, sf_dir), batch_id="documents")
    out_path = scratch_path(spark, "r3-results")
    q = search_stream(benchmark_query_stream(spark, sf_dir), store.index, out_path, scratch_path(spark, "r3-ckpt"),
                      k=K, name="r3_search", round_to=ROUND)
    q.awaitTermination()
    res = spark.read.schema("query_id string, rank int, file string, score double, epoch bigint").parquet(out_path)
    return res.select("query_id", "rank", "file", _round())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "s3_read_corpus": s3_read_corpus,
    "t1_strip_punctuation": t1_strip_punctuation,
    "t2_normalize": t2_normalize,
    "t3_tokenize": t3_tokenize,
    "t4_remove_stop_words": t4_remove_stop_words,
    "t5_document_terms": t5_document_terms,
    "t6_path_display": t6_path_display,
    "a1_term_counts": a1_term_counts,
    "a2_num_terms": a2_num_terms,
    "a3_term_frequency_map": a3_term_frequency_map,
    "a4_inverted_index": a4_inverted_index,
    "a5_corpus_size": a5_corpus_size,
    "a6_document_frequency": a6_document_frequency,
    "a7_score_documents": a7_score_documents,
    "j1_is_indexed": j1_is_indexed,
    "j2_new_sources": j2_new_sources,
    "j3_lookup_term": j3_lookup_term,
    "j4_match_terms": j4_match_terms,
    "j5_lookup_documents": j5_lookup_documents,
    "j6_query_term_frequencies": j6_query_term_frequencies,
    "u1_candidate_documents": u1_candidate_documents,
    "u2_merge_postings": u2_merge_postings,
    "u2_merged_document_frequency": u2_merged_document_frequency,
    "m1_idf": m1_idf,
    "m2_query_idf": m2_query_idf,
    "m3_tf": m3_tf,
    "m4_tf_idf": m4_tf_idf,
    "k1_top_k": k1_top_k,
    "k2_top_k_per_query": k2_top_k_per_query,
    "q1_parse_query": q1_parse_query,
    "q2_search": q2_search,
    "q2_search_one_term": q2_search_one_term,
    "q3_search_batch": q3_search_batch,
    "q2_search_stored": q2_search_stored,
    "q3_search_stored": q3_search_stored,
    "a7_score_stored_documents": a7_score_stored_documents,
    "o1_format_results": o1_format_results,
    "o2_results_json": o2_results_json,
    "s7_import_index": s7_import_index,
    "s8_export_index": s8_export_index,
    "s8_export_terms": s8_export_terms,
    "s7_import_terms": s7_import_terms,
    "s7_import_whole_index": s7_import_whole_index,
    "s5_append_documents": s5_append_documents,
    "s6_scan_terms": s6_scan_terms,
    "s6_scan_lexicon": s6_scan_lexicon,
    "s6_scan_document_lists": s6_scan_document_lists,
    "s6_scan_documents": s6_scan_documents,
    "u2_compacted_postings": u2_compacted_postings,
    "u2_tiered_postings": u2_tiered_postings,
    "a8_ingest_count": a8_ingest_count,
    "s2_staged_transcripts": s2_staged_transcripts,
    "r1_ingest_media_stream": r1_ingest_media_stream,
    "r1_ingest_stream": r1_ingest_stream,
    "r2_document_frequency_stream": r2_document_frequency_stream,
    "r2_frequency_from_index": r2_frequency_from_index,
    "r3_search_stream": r3_search_stream,
}
