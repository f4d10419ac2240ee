"""The golden mini-corpus of FIXTURES.md §2, end to end."""

import pytest

from hearsay.operators import indexing as ix
from hearsay.operators import scoring as sc
from hearsay.plans.index import build_index
from hearsay.plans.search import query_frame, search, search_batch

from conftest import GOLDEN_STOP_WORDS


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def result(df):
    return [(r["file"][-5:-4], round(r["score"], 6)) for r in df.orderBy("rank").collect()]


def test_documents(golden_index):
    docs = {r["file"]: r for r in golden_index.documents.collect()}
    assert docs["/v/a.mp4"]["transcription"] == "ice hockey the puck the stick score"
    assert docs["/v/a.mp4"]["term_frequencies"] == {"ice": 1, "hockey": 1, "puck": 1, "stick": 1, "score": 1}
    assert docs["/v/b.mp4"]["term_frequencies"] == {"ice": 2, "baby": 1}
    assert docs["/v/c.mp4"]["term_frequencies"] == {} and docs["/v/c.mp4"]["num_terms"] == 0
    assert docs["/v/d.mp4"]["transcription"] == "dont score"
    assert {f: r["num_terms"] for f, r in docs.items()} == {"/v/a.mp4": 5, "/v/b.mp4": 2, "/v/c.mp4": 0, "/v/d.mp4": 2}


def test_inverted_index_and_df(golden_index):
    view = ix.inverted_index(golden_index.postings, chunk_size=1)
    files = {}
    for r in view.collect():
        files.setdefault(r["term"], []).extend(r["documents"])
    assert {t: sorted(f[-5] for f in fs) for t, fs in files.items()} == {
        "ice": ["a", "b"], "score": ["a", "d"], "hockey": ["a"], "puck": ["a"], "stick": ["a"],
        "baby": ["b"], "dont": ["d"]}
    assert dict(rows(golden_index.lexicon, "term", "df"))["ice"] == 2
    assert golden_index.documents.count() == 4


@pytest.mark.parametrize("terms, expected", [
    (["ice"], [("b", 0.736966), ("a", 0.147393)]),
    (["ice", "ice"], [("b", 0.736966), ("a", 0.147393)]),
    (["Ice"], []),
    (["the"], []),
    (["score", "zzz"], [("d", 0.368483), ("a", 0.147393)]),
    (["hockey", "ice"], [("b", 0.736966), ("a", 0.411779)]),
    (["hockey", "ice", "score"], [("b", 0.736966), ("a", 0.559172), ("d", 0.368483)]),
    (["dont"], [("d", 0.660964)]),
])
def test_search_golden(golden_index, terms, expected):
    assert result(search(golden_index, terms, 3)) == expected


def test_idf_values(golden_index, spark):
    q = query_frame(spark, ["hockey", "ice", "score", "zzz"])
    idfs = sc.query_idf(sc.query_terms(q), golden_index.lexicon, golden_index.n_documents(), True)
    got = {r["term"]: round(r["idf"], 6) for r in idfs.collect()}
    assert got == {"hockey": 1.321928, "ice": 0.736966, "score": 0.736966, "zzz": 0.0}


def test_refusals_at_the_prompt(golden_index):
    with pytest.raises(ValueError, match="empty"):
        search(golden_index, [], 3)
    with pytest.raises(ValueError, match="too_many"):
        search(golden_index, ["a", "b", "c", "d", "e", "f"], 3)
    assert search(golden_index, ["ice"] * 6, 3, max_terms=None).count() == 2


def test_k_zero_and_fewer_than_k(golden_index):
    assert search(golden_index, ["ice"], 0).count() == 0
    assert search(golden_index, ["baby"], 3).count() == 1


def test_single_document_zero_score_kept(spark):
    idx = build_index(spark.createDataFrame([("/v/a.mp4", "Ice hockey! The puck, the stick; score.")],
                                            "file string, transcript string"), GOLDEN_STOP_WORDS)
    assert result(search(idx, ["ice"], 3)) == [("a", 0.0)]


def test_ties_ordered_by_file(spark):
    idx = build_index(spark.createDataFrame([("/v/z.mp4", "alike words"), ("/v/m.mp4", "alike words"),
                                             ("/v/q.mp4", "other")], "file string, transcript string"))
    assert [r["file"] for r in search(idx, ["alike"], 3).orderBy("rank").collect()] == ["/v/m.mp4", "/v/z.mp4"]


def test_batch_equals_loop_of_singles(golden_index, spark):
    cases = {"q1": ["ice"], "q2": ["hockey", "ice", "score"], "q3": ["zzz"], "q4": ["score", "zzz", "score"]}
    queries = spark.createDataFrame(list(cases.items()), "query_id string, terms array<string>")
    batch = search_batch(golden_index, queries, 3)
    for qid, terms in cases.items():
        single = [(r["rank"], r["file"], r["score"]) for r in search(golden_index, terms, 3).collect()]
        got = [(r["rank"], r["file"], r["score"]) for r in batch.where(f"query_id = '{qid}'").collect()]
        assert sorted(got) == sorted(single)


def test_parse_query(spark):
    lines = spark.createDataFrame([("ice hockey",), ("  ",), ("a b c d e f",), ("Ice\thockey",)], "line string")
    got = [(r["q"]["status"], r["q"]["terms"]) for r in lines.select(sc.parse_query("line").alias("q")).collect()]
    assert got == [("ok", ["ice", "hockey"]), ("empty", []), ("too_many", ["a", "b", "c", "d", "e", "f"]),
                   ("ok", ["Ice", "hockey"])]


def test_query_term_frequencies_dense(golden_index, spark):
    q = sc.query_terms(query_frame(spark, ["ice", "baby"]))
    matched = sc.match_terms(q, golden_index.postings)
    got = rows(sc.query_term_frequencies(matched, sc.candidate_documents(matched), q), "file", "term", "tf_count")

    assert got == [("/v/a.mp4", "baby", 0), ("/v/a.mp4", "ice", 1), ("/v/b.mp4", "baby", 1), ("/v/b.mp4", "ice", 2)]


def test_output_shaping(golden_index, spark):
    from hearsay.operators.output import format_result, results_json

    queries = spark.createDataFrame([("q1", ["ice"]), ("q2", ["zzz"])], "query_id string, terms array<string>")
    res = search_batch(golden_index, queries, 3)
    lines = [r["o"] for r in res.orderBy("query_id", "rank").select(format_result("score", "file").alias("o")).collect()]
    assert lines == ["Score: 0.74  | File: /v/b.mp4", "Score: 0.15  | File: /v/a.mp4"]
    js = dict(rows(results_json(queries, res, elapsed_ms=7), "query_id", "json"))
    assert js["q1"] == ('{"videos":[{"file":"/v/b.mp4","score":0.736966},{"file":"/v/a.mp4","score":0.147393}],'
                        '"duration":{"count":7,"unit":"ms"}}')
    assert js["q2"] == '{"videos":[],"duration":{"count":7,"unit":"ms"}}'


def test_results_json_escapes_file_names(spark):
    import json

    from hearsay.operators.output import results_json

    idx = build_index(spark.createDataFrame([('C:\\v\\say "hi".mp4', "ice")], "file string, transcript string"))
    queries = spark.createDataFrame([("q1", ["ice"])], "query_id string, terms array<string>")
    js = results_json(queries, search_batch(idx, queries, 3), elapsed_ms=1).first()["json"]
    assert json.loads(js) == {"videos": [{"file": 'C:/v/say "hi".mp4', "score": 0.0}],
                              "duration": {"count": 1, "unit": "ms"}}


def test_group_of_copies_keeps_k_rows_in_file_order(spark):
    # A third of the corpus is one text: every copy ties on score.
    rows = [(f"/v/copy{i:03d}.mp4", "alike words zebra") for i in range(60)]
    rows += [(f"/v/other{i:03d}.mp4", f"word{i} alike{i}") for i in range(120)]
    idx = build_index(spark.createDataFrame(rows, "file string, transcript string"))
    single = [r["file"] for r in search(idx, ["alike", "words"], 3).orderBy("rank").collect()]
    assert single == ["/v/copy000.mp4", "/v/copy001.mp4", "/v/copy002.mp4"]
    queries = spark.createDataFrame([("q1", ["alike"]), ("q2", ["zebra", "word7"])], "query_id string, terms array<string>")
    got = {}
    for r in search_batch(idx, queries, 3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["file"]))
    assert sorted(got["q1"]) == [(1, "/v/copy000.mp4"), (2, "/v/copy001.mp4"), (3, "/v/copy002.mp4")]
    assert sorted(got["q2"]) == [(1, "/v/other007.mp4"), (2, "/v/copy000.mp4"), (3, "/v/copy001.mp4")]


def test_dense_frequencies_are_made_last(golden_index, spark):
    """No join meets a row for each query term, and repeated rows count as in a join."""
    q = spark.createDataFrame([("q", "ice"), ("q", "zzzz"), ("r", "puck")], "query_id string, term string")
    matched = sc.match_terms(q, golden_index.postings)
    dense = sc.query_term_frequencies(matched.union(matched), sc.candidate_documents(matched), q)
    plan = dense._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join" in line and "file#" in line]
    got = sorted(map(tuple, dense.collect()))
    assert got == sorted([("q", "/v/a.mp4", "ice", 1)] * 2 + [("q", "/v/b.mp4", "ice", 2)] * 2
                         + [("q", f"/v/{f}.mp4", "zzzz", 0) for f in "ab"] + [("r", "/v/a.mp4", "puck", 1)] * 2)


def test_dense_frequencies_without_collected_rows(spark):
    """Zeros fill the places between found terms; repeats on every side count as in a join."""
    counts = "query_id string, term string, file string, tf_count long, num_terms long"
    matched = spark.createDataFrame([("q", "b", "f", 2, 9), ("q", "b", "f", 3, 9), ("q", "d", "f", 4, 9), ("q", "other", "f", 5, 9),
                                     ("q", "a", "not asked", 6, 9), ("q", "a", None, 7, 9)], counts)
    asked = spark.createDataFrame([("q", "f"), ("q", "nothing"), ("r", "f"), ("r", "f"), ("no terms", "f"), (None, "f"), ("r", None)],
                                  "query_id string, file string")
    q = spark.createDataFrame([("q", "a"), ("q", "b"), ("q", "c"), ("q", "d"), ("q", "d"), ("r", "b"), ("r", None)],
                              "query_id string, term string")
    dense = sc.query_term_frequencies(matched, asked, q)
    plan = dense._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(found" not in plan and "filter(found" not in plan
    got = sorted(map(str, map(tuple, dense.collect())))
    assert got == sorted(map(str, [
        ("q", "f", "a", 0), ("q", "f", "b", 2), ("q", "f", "b", 3), ("q", "f", "c", 0), ("q", "f", "d", 4), ("q", "f", "d", 4),
        *[("q", "nothing", t, 0) for t in "abcdd"], *[("r", "f", t, 0) for t in ("b", None)] * 2, *[("r", None, t, 0) for t in ("b", None)]]))


def test_query_frequencies_tokenise_once(spark, workdir):
    from hearsay import registry

    spark.createDataFrame([(1, "ice hockey"), (2, "puck ice ice")], "doc_id long, text string").write.parquet(workdir + "/documents.parquet")
    spark.createDataFrame([(7, "Ice puck")], "item_id long, text string").write.parquet(workdir + "/benchmark.parquet")
    dense = registry.j6_query_term_frequencies(spark, workdir)
    assert "regexp_replace(transcript" not in dense._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, dense.collect())) == [("7:0", "1", "ice", 1), ("7:0", "1", "puck", 0), ("7:0", "2", "ice", 2), ("7:0", "2", "puck", 1)]


def test_runs_are_found_once():
    from hearsay.functions.text import term_runs

    assert str(term_runs("sorted_tokens")).count("arrays_zip") == 1
