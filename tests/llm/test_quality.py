import numpy as np

from hearsay.llm import langid, quality


def test_isotonic_pools_violators():
    edges, shares = quality.isotonic(np.array([0.0, 1.0, 2.0, 3.0]), np.array([0.0, 3.0, 1.0, 4.0]), np.array([4.0, 4.0, 4.0, 4.0]))
    assert edges.tolist() == [0.0, 1.5, 3.0] and shares.tolist() == [0.0, 0.5, 1.0]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "quality")
    held_out = langid.held_out(folds=5, fold=0)
    described = quality.statistics(docs.join(labels.select("doc_id"), "doc_id", "left_semi"))
    model = quality.fit(described.where(~held_out).join(labels, "doc_id"))
    rows = quality.score(described, model).where(held_out).join(labels, "doc_id").collect()
    good = [r["score"] for r in rows if r["quality"] == 1]
    bad = [r["score"] for r in rows if r["quality"] == 0]
    assert sum(s >= 0.3 for s in good) >= 0.97 * len(good) and sum(s < 0.3 for s in bad) >= 0.85 * len(bad)
    assert all(0 <= s <= 1 for s in good + bad)


def test_summed_equations_equal_one_system(spark):
    rng = np.random.default_rng(3)
    stats = rng.normal(size=(300, len(quality.STATISTICS)))
    labels = (stats[:, 0] > 0).astype(float)
    rows = spark.createDataFrame([(s.tolist(), float(y)) for s, y in zip(stats, labels)], "stats array<double>, quality double").repartition(5)
    model = quality.fit(rows)
    z = model.features(stats)
    ridge = quality.RIDGE * np.eye(z.shape[1])
    ridge[-1, -1] = 1e-9
    want = np.linalg.solve(z.T @ z + ridge, z.T @ labels)
    assert np.allclose(z @ want, z @ model.weights, atol=1e-5)


def test_features_approximate_the_kernel():
    model = quality.Model(np.zeros(14), np.ones(14), np.zeros(0), np.zeros(0), np.zeros(0))
    x = np.random.default_rng(4).normal(size=(40, 14)) * 0.3
    z = model.features(x)[:, :-1]
    kernel = np.exp(-quality.GAMMA * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(z @ z.T - kernel).max() < 0.3


def test_odd_rows(odd_documents, empty_documents):
    described = quality.statistics(odd_documents)
    rows = described.collect()
    assert len(rows) == odd_documents.count() and all(np.isfinite(r["stats"]).all() for r in rows)
    nothing = quality.fit(described.selectExpr("stats", "cast(null as int) AS quality"))
    assert {r["score"] for r in quality.score(described, nothing).collect()} == {0.5}
    assert quality.statistics(empty_documents).count() == 0
