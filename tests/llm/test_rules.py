import re

from hearsay.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    places = {}
    for i in range(len(w) - 2):
        places.setdefault(tuple(w[i:i + 3]), []).append(i)
    covered = {i + k for p in places.values() if len(p) > 1 for i in p for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in rules.SYMBOLS for c in text),
            "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
            "n_capitals": sum(c.isupper() for c in text)}


def check(docs):
    rows = rules.ledger(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        want = brute(texts[r["doc_id"]])
        assert {m: r[m] for m in rules.MEASURES} == want
        assert bool(r["fail_bits"] & 1) == (want["n_words"] < 50)
        assert bool(r["fail_bits"] & 2) == (100 * want["n_repeat_words"] > 50 * want["n_words"])


def test_measurements_match_brute_force(small, odd_documents):
    check(small[0])
    check(odd_documents)


def test_places_beyond_the_packed_bits_give_the_same(small, monkeypatch):
    monkeypatch.setattr(rules, "PLACE_BITS", 5)        # texts of 32 windows or more take the other way
    check(small[0])


def test_policies_and_ablation(small, empty_documents):
    rows = rules.ledger(small[0])
    bits = [r["fail_bits"] for r in rows.collect()]
    for policy in rules.POLICIES:
        kept = rules.apply_policy(rows, policy).where("kept").count()
        assert kept == sum(b & policy.bits == 0 for b in bits)
    for r in rules.ablation(rows).collect():
        bit = rules.mask(r["rule"])
        assert r["failed"] == sum(b & bit != 0 for b in bits)
        assert r["failed_alone"] == sum(b & rules.CURRENT.bits == bit for b in bits)
        assert r["kept_without"] == sum(b & rules.CURRENT.bits & ~bit == 0 for b in bits)
    assert rules.ledger(empty_documents).count() == 0 and rules.ablation(rules.ledger(empty_documents)).count() == 0


def test_kept_documents_keep_their_columns(small, odd_documents):
    docs = small[0]
    kept = rules.keep_documents(docs)
    assert kept.columns == docs.columns
    want = {r["doc_id"] for r in rules.apply_policy(rules.ledger(docs)).where("kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} == want
    assert rules.keep_documents(odd_documents).columns == odd_documents.columns


def test_clean_documents_are_kept(spark, small):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").where("quality = 1")
    rows = rules.apply_policy(rules.ledger(small[0])).join(labels, "doc_id").where("n_words >= 50")
    assert rows.where("NOT kept").count() <= 0.02 * rows.count()


def test_packed_hashes_are_wide_enough():
    """The chance that two different windows of a packed text have equal hashes, n^2 / 2 pairs of 64 - PLACE_BITS bits."""
    assert (1 << rules.PLACE_BITS) ** 2 / 2 / 2 ** (64 - rules.PLACE_BITS) < 1e-8
