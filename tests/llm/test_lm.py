import math

import numpy as np

from hearsay.llm import lm


def lexicon(n=lm.VOCABULARY):
    return lm.Lexicon(np.arange(1, n + 1, dtype=np.uint64), np.arange(1, n + 1), np.full(n + 1, 3.0), 10)


def test_probabilities_sum_to_one():
    net = lm.Network(lexicon())
    context = np.tile([[1, 2, 3, net.pad]], (lm.VOCABULARY + 1, 1))
    p = np.exp(net.log_probabilities(context, np.arange(lm.VOCABULARY + 1)))
    assert abs(p.sum() - 1) < 1e-4


def test_gradient_matches_differences():
    rng = np.random.default_rng(1)
    net = lm.Network(lexicon())
    context, target = rng.integers(0, 1024, (6, 4)), rng.integers(0, 1024, 6)
    gradient = net.gradient(context, target)
    direction = rng.normal(size=len(net.flat)).astype(np.float32)
    step = 1e-2
    sides = []
    for sign in (1, -1):
        moved = lm.Network(lexicon(), net.flat + sign * step * direction / np.linalg.norm(direction))
        sides.append(-moved.log_probabilities(context, target).sum())
    want = (sides[0] - sides[1]) / (2 * step)
    assert abs(want - gradient @ (direction / np.linalg.norm(direction))) < 0.05 * max(1.0, abs(want))


def test_scores_beat_the_start_and_order_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = lm.count_words(docs)
    trained = lm.train(docs, known)
    total = lambda flat, d: d.sparkSession.createDataFrame(lm.score(d, known, flat).toPandas()).agg({"log_likelihood": "sum"}).first()[0]
    assert total(trained, docs) > total(lm.Network(known).flat, docs)
    rows = lm.score(docs, known, trained).collect()
    assert len(rows) == docs.count() and all(r["log_likelihood"] <= 0 for r in rows)
    assert all(math.isclose(r["mean_log_likelihood"] * r["n_words"], r["log_likelihood"], rel_tol=1e-9) for r in rows if r["n_words"])


def test_counts_cover_all_words(small):
    known = lm.count_words(small[0])
    words = [w for t in small[1].values() for w in (t or "").encode().lower().split()]
    assert known.counts.sum() == len(words)
    assert known.others == max(1, len(set(words)) - len(known.hashes))


def test_odd_rows(odd_documents, empty_documents):
    known = lm.count_words(odd_documents)
    rows = lm.score(odd_documents, known, lm.train(odd_documents, known, rounds=1)).collect()
    assert len(rows) == odd_documents.count()
    for r in rows:
        if not r["n_words"]:
            assert r["log_likelihood"] == 0.0 and r["mean_log_likelihood"] is None
    nothing = lm.count_words(empty_documents)
    assert lm.score(empty_documents, nothing, lm.train(empty_documents, nothing)).count() == 0


def test_words_outside_the_softmax_keep_their_own_frequency(spark):
    """Each scores by its own count, sent to the tasks or joined, and differs from the others in a context."""
    head = [f"w{i}" for i in range(lm.CLASSES - 1)]
    text = " ".join(head * 50 + ["often"] * 30 + ["seldom"] * 3 + ["once"])
    docs = spark.createDataFrame([(0, text)], "doc_id long, text string")
    asked = dict(enumerate(["often", "seldom", "once", "never", "w0 often", "w0 seldom", "often often once", None]))
    asked_docs = spark.createDataFrame(list(asked.items()), "doc_id long, text string")
    scores = []
    for common in (0, 1, 2, 9):
        known = lm.count_words(docs, vocabulary=lm.CLASSES - 1, common=common)
        assert len(known.common) == min(common, 3) and known.others == 3
        got = {r["doc_id"]: r["log_likelihood"] for r in lm.score(asked_docs, known, lm.Network(known).flat).collect()}
        assert abs(got[0] - got[1] - math.log(10)) < 1e-4 and abs(got[1] - got[2] - math.log(3)) < 1e-4
        assert abs(got[2] - got[3]) < 1e-4 and got[7] == 0
        assert abs(got[4] - got[5] - math.log(10)) > 1e-4
        scores.append([got[i] for i in range(len(asked))])
    assert np.allclose(scores, scores[0], atol=1e-9)


def test_lexicon_grows_with_the_corpus(spark):
    """Every word is held in the table, and the hashed embeddings grow with their number."""
    few, many = (spark.createDataFrame([(i, f"word{i}") for i in range(n)], "doc_id long, text string") for n in (1500, 6000))
    few, many = lm.count_words(few), lm.count_words(many)
    assert few.table.count() == 1500 and many.table.count() == 6000
    assert len(lm.Network(many).flat) > len(lm.Network(few).flat)


def test_gradient_of_hashed_words_matches_differences():
    rng = np.random.default_rng(2)
    net = lm.Network(lexicon())
    context, target = rng.integers(0, 2, (40, 4)), rng.integers(0, 1024, 40)
    rare = rng.integers(0, lexicon().buckets, (2, 40, 4))
    gradient = net.gradient(context, target, rare)
    size = net.views["rare"].size
    direction = np.zeros(len(net.flat), np.float32)
    direction[-size:] = rng.normal(size=size)
    direction /= np.linalg.norm(direction)
    sides = [-lm.Network(lexicon(), net.flat + sign * 0.1 * direction).log_probabilities(context, target, rare).sum(dtype=np.float64) for sign in (1, -1)]
    want = (sides[0] - sides[1]) / 0.2
    assert abs(want) > 0.05 and abs(want - gradient @ direction) < 0.05 * abs(want) + 0.01


def test_every_position_is_a_target_once(spark, monkeypatch):
    """Over the rounds, all words of all shards are targets once, pads never."""
    texts = ["one two three four five six seven eight", "", "nine ten " * 40, "one two three four five six seven eight"]
    hashes, _ = lm.words(texts, lower=True)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = lm.count_words(docs)
    for shard_words in (8, 30, 1000):
        rows = [np.frombuffer(r["codes"], np.uint32) for r in lm.shards(docs, known, shard_words=shard_words).collect()]
        codes = np.concatenate(rows)
        assert sorted(codes[codes != lm.PAD].tolist()) == sorted(known.codes(hashes).tolist())
        turns = [lm._turns(row, 3) for row in rows]
        assert all(((t >= 0) == (row != lm.PAD)).all() for t, row in zip(turns, rows))
        assert max(t.max() for t in turns) == 2

    seen = []
    monkeypatch.setattr(lm, "_round", lambda dealt, lexicon, begun, turn, rounds, old=lm._round: seen.append(sum(
        lm.train_shard(lexicon, begun, np.frombuffer(r["codes"], np.uint32), turn, rounds)[1] for r in dealt.collect())) or old(dealt, lexicon, begun, turn, rounds))
    lm.train(docs, known)
    assert len(seen) == lm.ROUNDS and sum(seen) == len(hashes)


def test_the_model_does_not_follow_the_partitions(spark, small):
    """Several shards, and tables of 1, 3 and 8 partitions in another order: equal parameters and scores."""
    known = lm.count_words(small[0], tails=lm.TAILS)
    known.table = None
    trained = [lm.train(small[0].repartition(n), known, shard_words=5000) for n in (1, 3, 8)]
    assert (trained[0] == trained[1]).all() and (trained[0] == trained[2]).all()
    order = ("doc_id", "log_likelihood")
    first, last = ([r["log_likelihood"] for r in lm.score(small[0].repartition(n), known, trained[0]).orderBy(*order).collect()] for n in (1, 8))
    assert np.allclose(first, last, rtol=1e-6, atol=1e-6)


def plain_score(words, network, known):
    """A text's words one at a time, in plain Python over the parameters."""
    v, total = network.views, 0.0
    hashes = lm.words([b" ".join(words).decode()], lower=True)[0] if words else []
    ids = {int(h): int(i) for h, i in zip(known.hashes, known.ids)}
    counts = {int(h): int(n) for h, n in zip(known.common, known.common_counts)}
    hashes = [int(h) for h in hashes]

    def tail(h):
        t = (h >> 33) % known.tails
        return known.vocabulary + t if t else 0

    for at, h in enumerate(hashes):
        summed = v["bias"].astype(float)
        for k, step in enumerate((-2, -1, 1, 2)):
            if not 0 <= at + step < len(hashes):
                summed = summed + v["embed"][k][network.pad]
                continue
            near = hashes[at + step]
            summed = summed + v["embed"][k][ids.get(near, 0)]
            if near not in ids:
                mixed = int(lm.mix(np.array([near >> 33], np.uint64), 59)[0])
                summed = summed + v["rare"][mixed % known.buckets] + v["rare"][(mixed >> 32) % known.buckets]
        hidden, entry = [math.tanh(x) for x in summed], ids.get(h, None)
        target = tail(h) if entry is None else entry
        for weights, bias, which in ((v["to_class"], v["class_bias"], target % lm.CLASSES),
                                     (v["to_word"][target % lm.CLASSES], v["word_bias"][target % lm.CLASSES], target // lm.CLASSES)):
            logits = [sum(x * float(w) for x, w in zip(hidden, weights[:, j])) + float(bias[j]) for j in range(weights.shape[1])]
            total += logits[which] - math.log(sum(map(math.exp, logits)))
        if entry is None:
            total += math.log(max(1, counts.get(h, 1)) / max(1, known.counts[target]))
    return total


def test_scores_equal_plain_python(spark, small):
    known = lm.count_words(small[0], tails=lm.TAILS)
    network = lm.Network(known, lm.train(small[0], known, shard_words=20_000))
    texts = {i: t for i, t in enumerate(sorted({(t or "")[:200] for t in small[1].values()})[:12])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in lm.score(docs, known, network.flat).collect():
        want = plain_score(texts[r["doc_id"]].encode().lower().split(), network, known)
        assert abs(r["log_likelihood"] - want) < 1e-3 * max(1.0, abs(want))


def test_words_of_the_tails_share_their_tails(spark):
    """Given a context, the probabilities of all words that the corpus has add up to one."""
    text = " ".join(f"w{i % 97} w{i % 61}" for i in range(3000))
    docs = spark.createDataFrame([(0, text)], "doc_id long, text string")
    known = lm.count_words(docs, vocabulary=lm.CLASSES - 1, tails=lm.CLASSES + 1)
    asked = spark.createDataFrame([(i, f"w{i}") for i in range(97)], "doc_id long, text string")
    found = lm.score(asked, known, lm.train(docs, known)).collect()
    unseen = np.exp([n for n in ()]).sum()
    assert abs(sum(math.exp(r["log_likelihood"]) for r in found) + unseen - 1) < 0.05
    assert known.counts.sum() == 6000


def test_a_hashed_word_moves_its_embeddings_once_a_batch(monkeypatch):
    """Not once for each place that it is near."""
    known, added = lexicon(), []
    codes = lm.OTHER | np.arange(3000, dtype=np.uint32)
    row, place = lm._padded(codes, np.array([1000, 3000]))
    monkeypatch.setattr(lm, "_add_rows", lambda to, at, rows, old=lm._add_rows: added.append((len(to), len(at))) or old(to, at, rows))
    lm.train_shard(known, lm.Network(known).flat, row, 0, 1)
    assert sum(n for entries, n in added if entries == known.buckets) == 2 * len(codes)
    monkeypatch.undo()
    net, (context, target, pairs) = lm.Network(known), known.spread(row)
    around = place[:, None] + lm.OFFSETS
    at_once, by_context = net.gradient_at(context, pairs, place, target[place]), net.gradient(context[around], target[place], pairs[:, around])
    assert np.allclose(at_once, by_context, rtol=1e-3, atol=1e-2)


def test_large_logits_neither_overflow_nor_vanish():
    net = lm.Network(lexicon())
    net.flat *= 2000
    assert net._output()[2] and not lm.Network(lexicon())._output()[2]
    context = np.tile([[1, 2, 3, net.pad]], (lm.VOCABULARY + 1, 1))
    p = np.exp(net.log_probabilities(context, np.arange(lm.VOCABULARY + 1)))
    assert abs(p.sum() - 1) < 1e-3
    assert np.isfinite(net.gradient(context, np.arange(lm.VOCABULARY + 1))).all()


def test_hashes_of_words_across_blocks_and_longer_than_one():
    from hearsay.llm import wordhash

    rng = np.random.default_rng(3)
    sizes = [*rng.integers(1, 4000, 60).tolist(), wordhash.BLOCK - 1, wordhash.BLOCK, wordhash.BLOCK + 1, 3 * wordhash.BLOCK, 2]
    plain = ["".join(chr(c) for c in rng.choice([65, 90, 97, 122, 48, 233, 8364, 128512], n // 3 + 1)) for n in sizes]
    texts = [" \t".join(plain[:20]), "", " ", "\n".join(plain[20:]) + " "]
    want = []
    for word in plain:
        total, power = 0, 1
        for b in word.encode().lower():
            total, power = (total + (b + 1) * power) % 2**64, power * int(wordhash.BASE) % 2**64
        want.append((total + len(word.encode()) * int(wordhash.BASE)) % 2**64)
    hashes, ends = lm.words(texts, lower=True)
    assert ends.tolist() == [20, 20, 20, len(plain)]
    assert hashes.tolist() == lm.mix(np.array(want, np.uint64)).tolist()
