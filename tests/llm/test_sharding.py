import zlib
from collections import Counter, defaultdict

import pytest

from hearsay.llm import sharding
from hearsay.llm.queries import op6_kd_sharding


def check(docs, shards, slack):
    rows = sharding.with_slots(sharding.kd_shards(docs, shards)).collect()
    texts = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    want = Counter((i, len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in texts)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    sizes, slots = Counter(), defaultdict(list)
    for r in rows:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(sizes) <= set(range(shards))
    if slack is not None:
        mean = sum(sizes.values()) / shards
        assert max(abs(sizes[k] - mean) for k in range(shards)) <= slack * mean
    return rows


def test_shards_are_nearly_equal_in_bytes(spark):
    check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), 7, 0.03)


def test_equal_texts_stay_together_in_the_query(spark):
    rows = op6_kd_sharding(spark, "/root/testdata/sf0.01").collect()
    places, weight, sizes = defaultdict(set), Counter(), Counter()
    for r in rows:
        places[r["text_crc32"], r["size"]].add(r["shard"])
        weight[r["text_crc32"], r["size"]] += r["size"]
        sizes[r["shard"]] += r["size"]
    share = sum(sizes.values()) / 40
    assert max(weight.values()) < share and all(len(p) == 1 for p in places.values())
    # As near as whole groups of equal texts allow.
    assert max(abs(sizes[k] - share) for k in range(40)) <= max(0.05 * share, max(weight.values()) / 2)


def test_a_group_beyond_a_shard_fills_neighbouring_ones(spark):
    rows = [(i, "the same text in every row") for i in range(3000)] + [(5000 + i, f"text {i} " * 4) for i in range(1000)]
    docs = spark.createDataFrame([(i, t, "s", "en") for i, t in rows], "doc_id long, text string, source string, lang string")
    placed = sharding.kd_shards(docs, 10).collect()
    own = {r["shard"] for r in placed if r["doc_id"] < 5000}
    weight, total = (sum(r["size"] for r in placed if r["doc_id"] < limit) for limit in (5000, 10**9))
    assert len(own) <= weight / (total / 10) + 2


def test_odd_rows(odd_documents, empty_documents):
    check(odd_documents, 3, None)
    assert sharding.with_slots(sharding.kd_shards(empty_documents, 3)).count() == 0
    with pytest.raises(ValueError):
        sharding.kd_shards(odd_documents, 0)


def test_one_text_that_many_rows_share_is_spread(spark):
    rows = [(i, "the same text in every row") for i in range(400)] + [(400 + i, f"text {i} " * 4) for i in range(200)]
    check(spark.createDataFrame([(i, t, "s", "en") for i, t in rows], "doc_id long, text string, source string, lang string"), 4, 0.1)


def test_target_bytes_choose_the_number(spark, small):
    docs = small[0]
    total = sum(len((t or "").encode()) + 16 for t in small[1].values())
    rows = sharding.kd_shards(docs, target_bytes=total // 5 + 1).collect()
    assert {r["shard"] for r in rows} == set(range(5))
