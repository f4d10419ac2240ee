import math

import numpy as np
import pytest

from hearsay.llm import negatives
from hearsay.llm.queries import op11_hard_negatives

SCHEMA = "vec_id long, label int, embedding array<double>, score long, anchor string"


def brute(rows, is_anchor, positives=5, k=3):
    """All pairs in plain Python."""
    usable = [(i, lab, tuple(math.floor(256 * x) for x in v)) for i, lab, v in rows
              if None not in (i, lab, v) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, own, av in {r for r in usable if is_anchor(r[0])}:
        scored = {(i, lab, sum(x * y for x, y in zip(av, v))) for i, lab, v in usable}
        order = lambda r: (-r[2], r[0])
        for p, _, ps in sorted((r for r in scored if r[1] == own and r[0] != a), key=order)[:positives]:
            fits = sorted((r for r in scored if r[1] != own and 50 * ps <= 100 * r[2] <= 95 * ps), key=order)
            out += [(a, p, n, r[0], ps, r[2]) for n, r in enumerate(fits[:k], 1)]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame([(*r, 7, "clash") for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in negatives.hard_negatives(df, df.where("vec_id % 10 = 0"), **more).collect())


def random_rows(seed, n, dims, labels=3, top=0.5):
    rng = np.random.default_rng(seed)
    # Coarse values, so that many scores tie.
    return [(i, int(rng.integers(labels)), (rng.integers(-4, 5, dims) / 8 * top).tolist()) for i in range(n)]


@pytest.mark.parametrize("dims,top", [(1, 0.5), (8, 0.5), (13, 1.0), (64, 40.0)])
def test_equal_to_all_pairs(spark, dims, top):
    rows = random_rows(dims, 300, dims, top=top)
    assert mined(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_slices_of_anchors_change_nothing(spark, monkeypatch):
    rows = random_rows(5, 200, 9)
    monkeypatch.setattr(negatives, "COMPONENTS", 64)
    assert mined(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_nulls_odd_lengths_and_repeated_rows(spark):
    rows = random_rows(6, 60, 9) + [
        (None, 1, [0.5] * 9), (70, None, [0.5] * 9), (80, 1, None), (90, 1, [0.5, None]), (100, 1, [float("nan")]),
        (110, 1, [float("inf"), 1.0]), (120, 1, []), (130, 2, [0.5]), (140, 2, [0.5] * 20), (-10, 1, [0.25] * 9)]
    rows += rows[:25] + [(0, 1, [0.5] * 9), (0, 2, [0.25] * 9)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_empty_tables_and_no_anchors(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert negatives.hard_negatives(df, df).count() == 0
    some = spark.createDataFrame([(1, 1, [0.5], 1, "x")], SCHEMA)
    assert negatives.hard_negatives(some, some.where("vec_id = 0")).count() == 0


def test_too_large_components_are_refused(spark):
    df = spark.createDataFrame([(10, 1, [1e300], 1, "x")], SCHEMA)
    with pytest.raises(Exception, match="too large"):
        negatives.hard_negatives(df, df)


def test_scores_are_inner_products():
    rng = np.random.default_rng(1)
    for top in (1, 130, 40000, 2**30):
        rows, anchors = rng.integers(-top, top + 1, (50, 24)), rng.integers(-top, top + 1, (7, 24))
        width = int(negatives.widths(rows).max())
        planes = negatives.pack(rows, width)
        assert (negatives.unpack(planes) == rows).all()
        assert (negatives.scores(negatives.subset_sums(anchors, 3), planes) == rows @ anchors.T).all()


def test_query_against_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], r["embedding"])
            for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in op11_hard_negatives(spark, sf).collect()) == brute(rows, lambda i: i % 50 == 0)
