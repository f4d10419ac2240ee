"""Quality scores from document statistics (operator 3).

``statistics`` turns every whole text into a few numbers. Random Fourier
features of the standardised numbers approximate a Gaussian kernel; each task
sums its part of the normal equations of ridge regression on the labels, Spark
adds the parts up, and the driver solves one small system. Isotonic calibration
then makes the fitted value a probability: fitted values are counted in
``STEPS`` steps with their labels, and the pool-adjacent-violators rule runs
over those counts. All labelled rows take part; nothing is sampled, and what
reaches the driver does not grow with them.

Rows: a null text counts as the empty text, which has statistics and a score
like any other. Null labels are left out; repeated labelled rows count each.
Without any labelled row the score is 0.5. Very long texts are read whole. An
empty table gives an empty result. Columns other than those named are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.llm.tasks import map_arrow, text_slices
from hearsay.llm.wordhash import windows, words

FEATURES = 256
GAMMA = 0.15                # width of the kernel over standardised statistics
RIDGE = 1e-2
STEPS = 2048
SEED = 17
CLIP = 6.0

STATISTICS = ["log_words", "word_bytes", "capitals", "symbols", "exclamations", "digits", "stops", "beyond_ascii",
              "distinct_words", "distinct_pairs", "distinct_triples", "common_word", "log_lines", "repeated_lines"]

_KIND = np.zeros(256, np.int64)
for _i, _set in enumerate((range(65, 91), b"#*$%&|<>", b"!", b"0123456789", b".,;:?", range(128, 256)), 1):
    _KIND[list(_set)] = _i


def describe(texts: list[str]) -> np.ndarray:
    """A row of ``STATISTICS`` for each text."""
    hashes, ends = words(texts)
    out, start = np.zeros((len(texts), len(STATISTICS))), 0
    for i, (text, end) in enumerate(zip(texts, ends.tolist())):
        own, start = hashes[start:end], end
        data = np.frombuffer(text.encode(), np.uint8)
        kinds = np.bincount(_KIND[data], minlength=7)
        n, size = max(len(own), 1), max(len(data), 1)
        _, times = np.unique(own, return_counts=True)
        lines = [line for line in text.split("\n") if line.strip()]
        spread = [len(np.unique(w)) / max(len(w), 1) for w in (windows(own, 2), windows(own, 3))]
        out[i] = [np.log1p(len(own)), size / n, kinds[1] / size, kinds[2] / n, kinds[3] / n, kinds[4] / size, kinds[5] / n, kinds[6] / size,
                  len(times) / n, *spread, times.max(initial=0) / n, np.log1p(len(lines)), 1 - len(set(lines)) / max(len(lines), 1)]
    return out


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, stats)`` per row."""
    chosen = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))

    def run(batches):
        for part in text_slices(batches):
            found = describe([t or "" for t in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(found), pa.list_(pa.float64()))], names=["key", "stats"])

    return map_arrow(chosen, run, f"key {docs.schema[key].dataType.simpleString()}, stats array<double>").withColumnRenamed("key", key)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray         # of the features and a constant
    edges: np.ndarray           # fitted values and the share of good labels there, rising
    shares: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        turn = rng.normal(0.0, np.sqrt(2 * GAMMA), (len(STATISTICS), FEATURES))
        shift = rng.uniform(0.0, 2 * np.pi, FEATURES)
        x = np.clip((stats - self.mean) / self.scale, -CLIP, CLIP)
        z = np.sqrt(2.0 / FEATURES) * np.cos(x @ turn + shift)
        return np.hstack([z, np.ones((len(z), 1))])

    def fitted(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.edges):
            return np.full(len(stats), 0.5)
        return np.clip(np.interp(self.fitted(stats), self.edges, self.shares), 0.0, 1.0)


def isotonic(values: np.ndarray, good: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: block means of ``values`` (rising) and their shares of good labels."""
    blocks: list[list[float]] = []
    for v, g, n in zip(values.tolist(), good.tolist(), count.tolist()):
        blocks.append([v * n, g, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    table = np.array(blocks).reshape(-1, 3)
    return table[:, 0] / table[:, 2], table[:, 1] / table[:, 2]


def fit(labelled: DataFrame, stats: str = "stats", label: str = "quality") -> Model:
    """A model from rows of statistics and labels 0 or 1."""
    width = len(STATISTICS)
    rows = labelled.select(F.col(stats).alias("stats"), F.col(label).cast("double").alias("label")).where(
        F.col("label").isNotNull() & F.col("stats").isNotNull())
    moments = rows.agg(*(f(F.col("stats")[i]).alias(f"{n}{i}") for i in range(width) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    mean = np.array([moments[f"m{i}"] or 0.0 for i in range(width)])
    scale = np.array([moments[f"s{i}"] or 1.0 for i in range(width)])
    model = Model(mean, scale, np.zeros(FEATURES + 1), np.zeros(0), np.zeros(0))

    def sums(batches):
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            z = model.features(_matrix(batch.column(0), width))
            total += z.T @ np.hstack([z, batch.column(1).to_numpy()[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    parts = map_arrow(rows, sums, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    system = np.zeros((FEATURES + 1, FEATURES + 2))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():      # 257 x 258 numbers
        system[r["i"], r["j"]] = r["v"]
    count = system[FEATURES, FEATURES]
    if not count:
        return model
    ridge = RIDGE * np.eye(FEATURES + 1)
    ridge[FEATURES, FEATURES] = 1e-9
    model.weights = np.linalg.solve(system[:, :-1] + ridge, system[:, -1])

    def steps(batches):
        for batch in batches:
            fitted = np.clip(model.fitted(_matrix(batch.column(0), width)), -0.5, 1.5)
            yield pa.RecordBatch.from_arrays([pa.array(np.round((fitted + 0.5) / 2 * STEPS).astype(np.int32)), batch.column(1)], names=["step", "label"])

    counted = map_arrow(rows, steps, "step int, label double").groupBy("step").agg(F.sum("label").alias("good"), F.count("*").alias("n"))
    table = np.array([tuple(r) for r in counted.orderBy("step").collect()], float).reshape(-1, 3)   # at most STEPS + 1 rows
    model.edges, model.shares = isotonic(table[:, 0] / STEPS * 2 - 0.5, table[:, 1], table[:, 2])
    return model


def score(described: DataFrame, model: Model, key: str = "doc_id", stats: str = "stats") -> DataFrame:
    """``(key, score)`` per row of statistics."""
    width = len(STATISTICS)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_matrix(batch.column(1), width)))], names=["key", "score"])

    chosen = described.select(F.col(key).alias("key"), F.col(stats).alias("stats"))
    return map_arrow(chosen, run, f"key {described.schema[key].dataType.simpleString()}, score double").withColumnRenamed("key", key)
