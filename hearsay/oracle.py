"""DuckDB SQL computing, from the raw tables, what each registry query returns.

Used as the correctness oracle: the same tables are views in DuckDB. The
SQL is written from the semantics (SURVEY §0, G1–G19), independently of
the Spark plans; shared pieces are CTEs below.
"""

from __future__ import annotations

from hearsay.functions.stopwords import ENGLISH_STOP_WORDS
from hearsay.functions.text import PUNCTUATION, WHITESPACE_REGEX_RE2
from hearsay.registry import FLAGSHIP_TERMS, K, K1_TERMS, LOOKUP_TERM, ROUND


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


P = _lit(PUNCTUATION)
WS = _lit(WHITESPACE_REGEX_RE2)
STOP = "[" + ", ".join(_lit(w) for w in ENGLISH_STOP_WORDS) + "]"


def _norm(x: str) -> str:
    return f"lower(translate({x}, {P}, ''))"


def _tokens(x: str) -> str:
    return f"list_filter(string_split_regex({x}, {WS}), lambda t: t <> '')"


def _kept(x: str) -> str:
    return f"list_filter(string_split_regex({x}, {WS}), lambda t: t <> '' AND NOT list_contains({STOP}, t))"


def _index_ctes(corpus_sql: str, prefix: str = "") -> str:
    p = prefix
    return f"""
{p}corpus AS ({corpus_sql}),
{p}norm AS (SELECT file, {_norm('transcript')} AS transcription FROM {p}corpus WHERE transcript IS NOT NULL),
{p}kept AS (SELECT file, transcription, {_kept('transcription')} AS terms FROM {p}norm),
{p}tf AS (SELECT file, term, count(*)::BIGINT AS tf_count FROM (SELECT file, unnest(terms) AS term FROM {p}kept) GROUP BY file, term),
{p}nd AS (SELECT k.file, count(tf.term)::BIGINT AS num_terms FROM {p}kept k LEFT JOIN {p}tf tf ON k.file = tf.file GROUP BY k.file),
{p}postings AS MATERIALIZED (SELECT tf.term, tf.file, tf.tf_count, nd.num_terms FROM {p}tf tf JOIN {p}nd nd ON tf.file = nd.file),
{p}lex AS (SELECT term, count(*)::BIGINT AS df FROM {p}postings GROUP BY term),
{p}n AS (SELECT count(*)::BIGINT AS n FROM {p}norm)"""


DOCS_CORPUS = "SELECT CAST(doc_id AS VARCHAR) AS file, text AS transcript FROM documents"
CONV_CORPUS = "SELECT CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) AS file, text AS transcript FROM conversations"

INDEX = _index_ctes(DOCS_CORPUS)
BOTH = _index_ctes(f"{DOCS_CORPUS} UNION ALL {CONV_CORPUS}")

LINES = f"""
bq_lines AS (SELECT item_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS line_no
             FROM (SELECT item_id, string_split(text, chr(10)) AS l FROM benchmark)),
bq AS (SELECT CAST(item_id AS VARCHAR) || ':' || CAST(line_no AS VARCHAR) AS query_id, line,
              {_tokens(_norm('line'))} AS terms FROM bq_lines)"""

QUERY_SIDE = f"""{LINES},
qt AS (SELECT DISTINCT query_id, unnest(terms) AS term FROM bq),
matched AS (SELECT qt.query_id, p.term, p.file, p.tf_count, p.num_terms FROM postings p JOIN qt ON p.term = qt.term),
qidf AS (SELECT qt.query_id, qt.term, coalesce(lex.df, 0)::BIGINT AS df,
                CASE WHEN lex.df IS NULL THEN 0.0 ELSE log2((1.0 + n.n) / (1.0 + lex.df)) END AS idf
         FROM qt LEFT JOIN lex ON qt.term = lex.term CROSS JOIN n),
tt AS (SELECT m.query_id, m.file, m.term, m.tf_count::DOUBLE / m.num_terms AS tf, q.idf,
              (m.tf_count::DOUBLE / m.num_terms) * q.idf AS tf_idf
       FROM matched m JOIN qidf q ON m.query_id = q.query_id AND m.term = q.term),
scores AS (SELECT query_id, file, sum(tf_idf) AS score FROM tt GROUP BY query_id, file),
ranked AS (SELECT query_id, file, score,
                  row_number() OVER (PARTITION BY query_id ORDER BY round(score, {ROUND}) DESC, file ASC) AS rank
           FROM scores),
top AS (SELECT query_id, CAST(rank AS INTEGER) AS rank, file, round(score, {ROUND}) AS score FROM ranked WHERE rank <= {K})"""


def _one_query(terms: list[str], index: str = INDEX) -> str:
    values = ", ".join(f"({_lit(t)})" for t in terms)
    return f"""WITH {index},
qt AS (SELECT DISTINCT term FROM (VALUES {values}) v(term)),
qidf AS (SELECT qt.term, CASE WHEN lex.df IS NULL THEN 0.0 ELSE log2((1.0 + n.n) / (1.0 + lex.df)) END AS idf
         FROM qt LEFT JOIN lex ON qt.term = lex.term CROSS JOIN n),
scores AS (SELECT p.file, sum((p.tf_count::DOUBLE / p.num_terms) * q.idf) AS score
           FROM postings p JOIN qidf q ON p.term = q.term GROUP BY p.file),
ranked AS (SELECT file, score, row_number() OVER (ORDER BY round(score, {ROUND}) DESC, file ASC) AS rank FROM scores)
SELECT CAST(rank AS INTEGER) AS rank, file, round(score, {ROUND}) AS score FROM ranked WHERE rank <= {K}"""


def _tf_map_text(alias: str = "tf_map") -> str:
    return f"coalesce(string_agg(tf.term || ':' || CAST(tf.tf_count AS VARCHAR), ' ' ORDER BY tf.term), '') AS {alias}"


SQL: dict[str, str] = {
    "s3_read_corpus": DOCS_CORPUS,
    "t1_strip_punctuation": f"SELECT CAST(doc_id AS VARCHAR) AS file, translate(text, {P}, '') AS stripped FROM documents",
    "t2_normalize": f"SELECT CAST(doc_id AS VARCHAR) AS file, {_norm('text')} AS transcription FROM documents",
    "t3_tokenize": f"""SELECT file, len(t)::BIGINT AS n_tokens, array_to_string(t, ' ') AS tokens
        FROM (SELECT CAST(doc_id AS VARCHAR) AS file, {_tokens(_norm('text'))} AS t FROM documents)""",
    "t4_remove_stop_words": f"""SELECT file, len(t)::BIGINT AS n_kept, array_to_string(t, ' ') AS kept
        FROM (SELECT CAST(doc_id AS VARCHAR) AS file, {_kept(_norm('text'))} AS t FROM documents)""",
    "t5_document_terms": f"""SELECT file, (generate_subscripts(t, 1) - 1)::BIGINT AS pos, unnest(t) AS term
        FROM (SELECT CAST(doc_id AS VARCHAR) AS file, {_kept(_norm('text'))} AS t FROM documents)""",
    "t6_path_display": """SELECT CAST(doc_id AS VARCHAR) AS file,
        replace(concat_ws('\\', source, CAST(doc_id AS VARCHAR)), '\\', '/') AS display FROM documents""",
    "a1_term_counts": f"WITH {INDEX} SELECT file, term, tf_count FROM tf",
    "a2_num_terms": f"WITH {INDEX} SELECT file, num_terms FROM nd",
    "a3_term_frequency_map": f"""WITH {INDEX}
        SELECT k.file, {_tf_map_text()} FROM kept k LEFT JOIN tf ON k.file = tf.file GROUP BY k.file""",
    "a4_inverted_index": f"WITH {INDEX} SELECT term, file FROM postings",
    "a5_corpus_size": f"WITH {INDEX} SELECT n AS n_documents FROM n",
    "a6_document_frequency": f"WITH {INDEX} SELECT term, df FROM lex",
    "a7_score_documents": f"WITH {INDEX}, {QUERY_SIDE} SELECT query_id, file, round(score, {ROUND}) AS score FROM scores",
    "j1_is_indexed": f"""WITH {INDEX},
        sources AS (SELECT file FROM corpus UNION SELECT file FROM ({CONV_CORPUS}))
        SELECT s.file, (d.file IS NOT NULL) AS indexed FROM sources s LEFT JOIN nd d ON s.file = d.file""",
    "j2_new_sources": f"""WITH {INDEX},
        sources AS (SELECT file FROM corpus UNION SELECT file FROM ({CONV_CORPUS}))
        SELECT s.file FROM sources s WHERE NOT EXISTS (SELECT 1 FROM nd d WHERE d.file = s.file)""",
    "j3_lookup_term": f"WITH {INDEX} SELECT term, file, tf_count, num_terms FROM postings WHERE term = {_lit(LOOKUP_TERM)}",
    "j4_match_terms": f"WITH {INDEX}, {QUERY_SIDE} SELECT query_id, term, file, tf_count, num_terms FROM matched",
    "j5_lookup_documents": f"""WITH {INDEX}, {QUERY_SIDE},
        cands AS (SELECT DISTINCT file FROM matched)
        SELECT c.file, nd.num_terms, {_tf_map_text()}
        FROM cands c JOIN nd ON c.file = nd.file LEFT JOIN tf ON c.file = tf.file GROUP BY c.file, nd.num_terms""",
    "j6_query_term_frequencies": f"""WITH {INDEX}, {QUERY_SIDE},
        cands AS (SELECT DISTINCT query_id, file FROM matched)
        SELECT c.query_id, c.file, qt.term, coalesce(tf.tf_count, 0)::BIGINT AS tf_count
        FROM cands c JOIN qt ON c.query_id = qt.query_id
             LEFT JOIN matched tf ON tf.query_id = c.query_id AND tf.file = c.file AND tf.term = qt.term""",
    "u1_candidate_documents": f"WITH {INDEX}, {QUERY_SIDE} SELECT DISTINCT query_id, file FROM matched",
    "u2_merge_postings": f"""WITH {INDEX}, {_index_ctes(CONV_CORPUS, 'c_')}
        SELECT term, file, tf_count, num_terms FROM postings
        UNION ALL SELECT term, file, tf_count, num_terms FROM c_postings""",
    "u2_merged_document_frequency": f"""WITH {INDEX}, {_index_ctes(CONV_CORPUS, 'c_')}
        SELECT term, count(*)::BIGINT AS df FROM (SELECT term FROM postings UNION ALL SELECT term FROM c_postings)
        GROUP BY term""",
    "m1_idf": f"""WITH {INDEX} SELECT term, df, round(log2((1.0 + n.n) / (1.0 + df)), {ROUND}) AS idf
        FROM lex CROSS JOIN n""",
    "m2_query_idf": f"WITH {INDEX}, {QUERY_SIDE} SELECT query_id, term, df, round(idf, {ROUND}) AS idf FROM qidf",
    "m3_tf": f"WITH {INDEX} SELECT file, term, round(tf_count::DOUBLE / num_terms, 9) AS tf FROM postings",
    "m4_tf_idf": f"WITH {INDEX}, {QUERY_SIDE} SELECT query_id, file, term, round(tf_idf, {ROUND}) AS tf_idf FROM tt",
    "k1_top_k": _one_query(K1_TERMS),
    "k2_top_k_per_query": f"WITH {INDEX}, {QUERY_SIDE} SELECT query_id, rank, file, score FROM top",
    "q1_parse_query": f"""WITH {LINES},
        p AS (SELECT query_id, list_filter(string_split_regex(line, '[ \\t\\n\\x0B\\f\\r]+'), lambda t: t <> '') AS t FROM bq)
        SELECT query_id, CASE WHEN len(t) = 0 THEN 'empty' WHEN len(t) > 5 THEN 'too_many' ELSE 'ok' END AS status,
               len(t)::BIGINT AS n_terms, array_to_string(t, ' ') AS terms FROM p""",
    "q2_search": _one_query(FLAGSHIP_TERMS),
    "q2_search_one_term": _one_query([LOOKUP_TERM]),
    "q3_search_batch": f"WITH {INDEX}, {QUERY_SIDE} SELECT query_id, rank, file, score FROM top",
    "q2_search_stored": _one_query(FLAGSHIP_TERMS, BOTH),
    "q3_search_stored": f"WITH {BOTH}, {QUERY_SIDE} SELECT query_id, rank, file, score FROM top",
    "a7_score_stored_documents": f"WITH {BOTH}, {QUERY_SIDE} SELECT query_id, file, round(score, {ROUND}) AS score FROM scores",
    "u2_tiered_postings": f"WITH {INDEX} SELECT term, file, tf_count, num_terms FROM postings",
    "s2_staged_transcripts": "SELECT text || chr(10) AS transcript FROM documents WHERE text IS NOT NULL",
    "r1_ingest_media_stream": f"""WITH {_index_ctes("SELECT CAST(doc_id AS VARCHAR) AS file, text || chr(10) AS transcript FROM documents")}
        SELECT k.transcription, count(tf.term)::BIGINT AS num_terms, {_tf_map_text()}
        FROM kept k LEFT JOIN tf ON k.file = tf.file GROUP BY k.file, k.transcription""",
    "o1_format_results": f"""WITH {INDEX}, {QUERY_SIDE}
        SELECT query_id, rank, printf('Score: %-5s | File: %s', printf('%.2f', score), file) AS line FROM top""",
    "o2_results_json": f"""WITH {INDEX}, {QUERY_SIDE},
        agg AS (SELECT query_id, list({{'file': replace(file, '\\', '/'), 'score': score::DECIMAL(38,6)}} ORDER BY rank) AS v
                FROM top GROUP BY query_id)
        SELECT q.query_id, CAST(to_json({{'videos': coalesce(agg.v, []::STRUCT(file VARCHAR, score DECIMAL(38,6))[]),
                                           'duration': {{'count': 0::BIGINT, 'unit': 'ms'}}}}) AS VARCHAR) AS json
        FROM (SELECT DISTINCT query_id FROM bq) q LEFT JOIN agg ON q.query_id = agg.query_id""",
    "s8_export_index": f"""WITH {INDEX}
        SELECT k.file, k.transcription,
               CAST(to_json(map_from_entries(coalesce(list({{'k': tf.term, 'v': tf.tf_count}} ORDER BY tf.term)
                       FILTER (WHERE tf.term IS NOT NULL), []))) AS VARCHAR) AS termFrequencies,
               count(tf.term)::BIGINT AS numTerms
        FROM kept k LEFT JOIN tf ON k.file = tf.file GROUP BY k.file, k.transcription""",
    "s8_export_terms": f"WITH {INDEX} SELECT term, file FROM postings",
    "s7_import_terms": f"WITH {INDEX} SELECT term, file FROM postings",
    "s7_import_whole_index": f"""WITH {INDEX}
        SELECT p.term, p.file, p.tf_count, p.num_terms, lex.df FROM postings p JOIN lex ON p.term = lex.term""",
    "s6_scan_document_lists": f"""WITH {INDEX}, {_index_ctes(CONV_CORPUS, 'c_')}
        SELECT term, file FROM postings UNION ALL SELECT term, file FROM c_postings""",
    "s6_scan_documents": f"""WITH {INDEX}, {_index_ctes(CONV_CORPUS, 'c_')},
        both_kept AS (SELECT * FROM kept UNION ALL SELECT * FROM c_kept),
        both_tf AS (SELECT * FROM tf UNION ALL SELECT * FROM c_tf)
        SELECT k.file, k.transcription, count(tf.term)::BIGINT AS num_terms, {_tf_map_text()}
        FROM both_kept k LEFT JOIN both_tf tf ON k.file = tf.file GROUP BY k.file, k.transcription""",
    "s5_append_documents": f"""WITH {INDEX}
        SELECT k.file, k.transcription, count(tf.term)::BIGINT AS num_terms, {_tf_map_text()}
        FROM kept k LEFT JOIN tf ON k.file = tf.file GROUP BY k.file, k.transcription""",
    "s6_scan_terms": f"""WITH {INDEX}, {_index_ctes(CONV_CORPUS, 'c_')}
        SELECT term, file, tf_count, num_terms FROM postings
        UNION ALL SELECT term, file, tf_count, num_terms FROM c_postings""",
    "s6_scan_lexicon": f"""WITH {INDEX}, {_index_ctes(CONV_CORPUS, 'c_')}
        SELECT term, count(*)::BIGINT AS df FROM (SELECT term FROM postings UNION ALL SELECT term FROM c_postings)
        GROUP BY term""",
    "u2_compacted_postings": f"""WITH {INDEX}, {_index_ctes(CONV_CORPUS, 'c_')}
        SELECT term, file, tf_count, num_terms FROM postings
        UNION ALL SELECT term, file, tf_count, num_terms FROM c_postings""",
    "a8_ingest_count": f"""WITH {INDEX}, {_index_ctes(CONV_CORPUS, 'c_')}
        SELECT (SELECT count(*) FROM norm)::BIGINT AS returned, 'b1' AS batch_id, (SELECT count(*) FROM norm)::BIGINT AS n_documents
        UNION ALL SELECT 0::BIGINT, 'b2', 0::BIGINT
        UNION ALL SELECT (SELECT count(*) FROM c_norm)::BIGINT, 'b3', (SELECT count(*) FROM c_norm)::BIGINT""",
    "r1_ingest_stream": f"WITH {INDEX} SELECT file, num_terms FROM nd",
    "r2_document_frequency_stream": f"WITH {INDEX} SELECT term, df FROM lex",
    "r2_frequency_from_index": f"""WITH {INDEX}, {_index_ctes(CONV_CORPUS, 'c_')}
        SELECT term, count(*)::BIGINT AS df FROM (SELECT term FROM postings UNION ALL SELECT term FROM c_postings)
        GROUP BY term""",
    "r3_search_stream": f"WITH {INDEX}, {QUERY_SIDE} SELECT query_id, rank, file, score FROM top",
    "s7_import_index": f"""WITH {INDEX}
        SELECT k.file, count(tf.term)::BIGINT AS num_terms, {_tf_map_text()}
        FROM kept k LEFT JOIN tf ON k.file = tf.file GROUP BY k.file""",
}
