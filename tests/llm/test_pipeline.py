"""The pipeline against plain Python, and the queries against their SQL."""

import os
import sys

import duckdb
import public_tokenizers
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from hearsay.llm import langid, queries, rules, sql  # noqa: E402
from llm import test_minhash, test_rules, test_substrings  # noqa: E402
from tools.check_oracle import digest, types_match  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(sql.SQL))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    rel = con.sql(sql.SQL[name])
    assert sorted(df.columns) == sorted(rel.columns) and types_match(df, rel) == []
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(rel.columns, rel.fetchall())[0]


def test_stages_return_the_columns_of_documents(spark, empty_documents):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty_documents, SF)
        assert out.columns == empty_documents.columns, name
        assert out.count() == 0


def test_pipeline_matches_brute_force(spark, small):
    from tokenizers import Tokenizer

    docs, texts = small
    kept = {}
    for i, t in texts.items():
        m = test_rules.brute(t)
        failed = [m["n_words"] < 50, 100 * m["n_repeat_words"] > 50 * m["n_words"], 100 * m["n_symbols"] > 20 * m["n_words"],
                  100 * m["n_dup_lines"] > 60 * m["n_lines"], 100 * m["n_capitals"] > 40 * m["word_chars"],
                  m["word_chars"] < 2 * m["n_words"] or m["word_chars"] > 20 * m["n_words"]]
        if not any(failed):
            kept[i] = t
    left = docs.where(docs["doc_id"].isin(list(kept)))
    judge = langid._compressors(tuple(sorted(langid.fit(left.where(~langid.held_out())).items())))
    kept = {i: t for i, t in kept.items() if not langid.judge(t, judge)[3]}
    found = test_minhash.brute(kept, 5)
    kept = {i: t for i, t in kept.items() if found[i][1] == i}
    kept = {i: (t if n == 0 else cut) for (i, words, n, cut), t in
            ((row, kept[row[0]]) for row in test_substrings.brute(sorted(kept.items()), 50)) if n == 0 or n < words}
    library = Tokenizer.from_file(public_tokenizers.path(queries.WORD_TOKENIZER))
    want = set()
    for i, t in kept.items():
        n = len(library.encode(t, add_special_tokens=False).ids) + 1
        want |= {(i, k, at, min(4096, n - at)) for k, at in enumerate(range(0, n, 4096))}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {(r["doc_id"], r["piece"], r["start"], r["length"]) for r in rows} == want and len(rows) == len(want)
    assert len({r["sequence_id"] for r in rows}) <= -(-sum(r["length"] for r in rows) // 4096) + 1
    assert rules.CURRENT.version == "v1"
