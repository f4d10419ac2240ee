"""Spelling variants by a trie of letter counts (operator 12).

Words are near if they differ by exactly one inserted, deleted or replaced code
point. A word's letters fall into ``GROUPS`` groups (code point mod ``GROUPS``);
their counts, group by group, are its path in a trie. A replaced letter is at
most one letter too many in one group and one too few in another; an inserted
letter is one too many.

1. Spark counts the words below each node of a length's trie, level by level,
   until no node has more than ``NODE_WORDS``. Nodes of that level, the same for
   all words, are the cells; words are sent to their cell, and asked for in each
   cell that the budget of one surplus and one deficit lets them reach. If a
   full path still has more words, cells are split by a hash and asked in each
   part.
2. Within a cell the trie goes on: a depth-first search carries many askers
   down at once, with the part of the budget that each has left, until a node
   has at most ``LEAF`` words or its path ends.
3. Leaf words are verified: by their letters' parities, then letter by letter.

Each near pair is found once: words of one length only from the one whose path
comes first (equal paths: whose letters do), others from the shorter. A task
holds one cell's words and a bounded number of askers.

Rows: null texts have no runs. An empty table gives an empty result. Repeated
rows count as often as they come. Very long words are words like others. Other
columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.llm.tasks import map_arrow, stored

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GROUPS = 13
NODE_WORDS = 1 << 16
LEAF = 32
ASKERS = 1 << 15            # searched at once
PAIR_LETTERS = 1 << 21      # compared at once
TARGET, PLAIN, SURPLUS, SPENT = -1, 0, 1, 2     # a target; what an asker has spent


# ---- words ---------------------------------------------------------------

def letter_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = 1) -> DataFrame:
    """``(id, run)``: each maximal run of letters of at least ``shortest``, A-Z in lower case."""
    found = F.regexp_extract_all(docs[text].cast("string"), F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))
    runs = docs.select(docs[key].alias("id"), F.explode(found).alias("run"))
    return runs.select("id", F.translate("run", UPPER, LOWER).alias("run"))


def word_counts(words: DataFrame, shortest: int = 7, least: int = 2) -> DataFrame:
    """``(word, n)`` for the words of at least ``shortest`` code points that occur ``least`` times."""
    long_enough = words.where(F.char_length("word") >= shortest)
    return long_enough.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


# ---- near words ------------------------------------------------------------

def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All letters, one after another, and the number of them in each word."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32), sizes


def letter_counts(letters: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    row = np.repeat(np.arange(len(sizes)), sizes)
    return np.bincount(row * GROUPS + letters % GROUPS, minlength=len(sizes) * GROUPS).reshape(-1, GROUPS).astype(np.int32)


def paths(words: DataFrame) -> DataFrame:
    """``(word, n, path)``: the length and the counts, as 32-bit integers."""
    def run(batches):
        for batch in batches:
            letters, sizes = code_points(batch.column(0).to_pylist())
            path = np.concatenate([sizes[:, None].astype(np.int32), letter_counts(letters, sizes)], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _binary(path)], names=["word", "n", "path"])

    return map_arrow(words.select("word", "n"), run, "word string, n long, path binary")


def _binary(rows: np.ndarray) -> pa.Array:
    """One binary of equal length for each row of integers."""
    width = rows.shape[1] * 4
    offsets = pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets, pa.py_buffer(np.ascontiguousarray(rows, np.int32))])


def _integers(column: pa.Array) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.int32).reshape(len(column), -1)


def depth_of_cells(placed: DataFrame) -> tuple[int, int]:
    """How many groups a cell's path has, and into how many parts cells are split."""
    for depth in range(GROUPS + 1):
        below = placed.groupBy(F.substring("path", 1, 4 * (1 + depth)).alias("node")).count()
        most = below.agg(F.max("count")).first()[0] or 0
        if most <= NODE_WORDS:
            return depth, 1
    return GROUPS, -(-most // NODE_WORDS)


def sent(placed: DataFrame, depth: int, parts: int) -> DataFrame:
    """``(cell, state, word, n)``: each word as a target of its cell, and as an asker of every cell it can reach."""
    steps = []      # what changes in the path, and what is spent then
    for longer in (0, 1):
        plain = np.zeros(1 + depth, np.int32)
        plain[0] = longer
        steps.append((plain, PLAIN))
        for i in range(depth):
            more = plain.copy()
            more[1 + i] += 1
            steps.append((more, SPENT if longer else SURPLUS))
            for j in range(i + 1, depth) if not longer else ():
                both = more.copy()
                both[1 + j] -= 1
                steps.append((both, SPENT))

    def run(batches):
        for batch in batches:
            path = _integers(batch.column(2))
            own = path[:, :1 + depth]
            part = batch.column(3).to_numpy()
            yield _rows(batch, np.arange(len(own)), own, part, TARGET)
            for step, state in steps:
                reached = own + step
                rows = np.flatnonzero((reached >= 0).all(axis=1))
                for p in range(parts):
                    yield _rows(batch, rows, reached[rows], np.full(len(rows), p, np.int32), state)

    dealt = placed.withColumn("part", F.pmod(F.xxhash64("word"), F.lit(parts)).cast("int"))
    return map_arrow(dealt.select("word", "n", "path", "part"), run, "cell binary, state byte, word string, n long")


def _rows(batch, rows, path, part, state) -> pa.RecordBatch:
    cell = np.concatenate([path, part[:, None]], axis=1)
    at = pa.array(rows)
    return pa.RecordBatch.from_arrays(
        [_binary(cell), pa.array(np.full(len(rows), state, np.int8)), batch.column(0).take(at), batch.column(1).take(at)],
        names=["cell", "state", "word", "n"])


class Words:
    """Some words of one cell, as arrays."""

    def __init__(self, parts: list[pa.RecordBatch]):
        table = pa.Table.from_batches(parts)
        self.words, self.n = table.column("word").to_pylist(), table.column("n").to_numpy()
        self.state = table.column("state").to_numpy()
        letters, self.sizes = code_points(self.words)
        self.counts = letter_counts(letters, self.sizes)
        self.letters, self.starts = letters, np.cumsum(self.sizes) - self.sizes
        self.parity = np.bitwise_xor.reduceat(np.uint64(1) << (letters % 64).astype(np.uint64), self.starts)

    def row(self, i: np.ndarray, size: int) -> np.ndarray:
        """The letters of words of one size, a row each."""
        return self.letters[self.starts[i][:, None] + np.arange(size)]


class Cell:
    """The words of one cell as a trie over their counts, below the cell's own path."""

    def __init__(self, parts: list[pa.RecordBatch], depth: int):
        self.words, self.depth = Words(parts), depth
        # Words below a node are neighbours in this order.
        below = self.words.counts[:, depth:]
        self.order = np.lexsort(below.T[::-1]) if depth < GROUPS else np.arange(len(below))
        self.counts = self.words.counts[self.order]
        self.parity = self.words.parity[self.order]

    def near(self, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        """The near pairs of these askers."""
        self.askers = Words(parts)
        self.found = []
        self._descend(0, len(self.order), self.depth, np.arange(len(self.askers.words)), self.askers.state)
        a = np.concatenate([f[0] for f in self.found] or [np.zeros(0, np.int64)])
        b = np.concatenate([f[1] for f in self.found] or [np.zeros(0, np.int64)])
        return pa.RecordBatch.from_arrays(
            [pa.array([self.askers.words[i] for i in a.tolist()], pa.string()), pa.array(self.askers.n[a]),
             pa.array([self.words.words[i] for i in b.tolist()], pa.string()), pa.array(self.words.n[b])], names=["a", "a_n", "b", "b_n"])

    def _descend(self, low: int, high: int, level: int, askers: np.ndarray, state: np.ndarray) -> None:
        """Depth first: the askers that reach the node of the words ``low`` to ``high``, and what they have spent."""
        if not len(askers) or low == high:
            return
        if high - low <= LEAF or level == GROUPS:
            self._leaf(low, high, askers)
            return
        counts = self.counts[low:high, level]
        edges = np.concatenate([[0], np.flatnonzero(np.diff(counts)) + 1, [high - low]])
        own = self.askers.counts[askers, level]
        shorter = self.askers.sizes[askers] < self.words.sizes[0]
        for start, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
            off = counts[start] - own
            same = off == 0
            surplus = (off == 1) & (state == PLAIN)
            deficit = (off == -1) & (state == SURPLUS)
            go = same | surplus | deficit
            spent = np.where(same, state, np.where(surplus & ~shorter, SURPLUS, SPENT)).astype(np.int8)
            self._descend(low + start, low + end, level + 1, askers[go], spent[go])

    def _leaf(self, low: int, high: int, askers: np.ndarray) -> None:
        size = int(self.words.sizes[0])
        width = high - low
        step = max(1, PAIR_LETTERS // width)
        for at in range(0, len(askers), step):
            part = askers[at:at + step]
            a, b = np.nonzero(np.bitwise_count(self.askers.parity[part][:, None] ^ self.parity[None, low:high]) <= 2)
            few = max(1, PAIR_LETTERS // size)
            for k in range(0, len(a), few):
                self._verify(part[a[k:k + few]], self.order[low + b[k:k + few]], size)

    def _verify(self, a: np.ndarray, b: np.ndarray, size: int) -> None:
        shorter = self.askers.sizes[a] < size
        for grown in (False, True):
            q, t = a[shorter == grown], b[shorter == grown]
            if not len(q):
                continue
            target = self.words.row(t, size)
            if grown:
                own = self.askers.row(q, size - 1)
                # One letter more: equal up to a place, and shifted by one from there on.
                left, right = own != target[:, :-1], own != target[:, 1:]
                first = np.where(left.any(axis=1), left.argmax(axis=1), size - 1)
                last = np.where(right.any(axis=1), size - 2 - right[:, ::-1].argmax(axis=1), -1)
                near = last < first
            else:
                own = self.askers.row(q, size)
                differ = own != target
                near = differ.sum(axis=1) == 1
                # Only from the word whose path, or else whose letter, comes first.
                path = self.words.counts[t] - self.askers.counts[q]
                moved = path.any(axis=1)
                first = path[np.arange(len(q)), (path != 0).argmax(axis=1)]
                place = differ.argmax(axis=1)
                later = target[np.arange(len(q)), place] > own[np.arange(len(q)), place]
                near &= np.where(moved, first > 0, later)
            self.found.append((q[near], t[near]))


def near_pairs(words: DataFrame) -> DataFrame:
    """``(a, a_n, b, b_n)``: each pair of near words once, from ``(word, n)`` of distinct words.

    Null and empty words are near none.
    """
    placed = stored(paths(words.where(F.col("word") != "")), "paths")
    depth, parts = depth_of_cells(placed)

    def run(batches):
        cell = trie = None
        targets, askers, many = [], [], 0
        for batch in batches:
            keys = _integers(batch.column(0))
            states = batch.column(1).to_numpy()
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]).any(axis=1) | ((states[1:] == TARGET) != (states[:-1] == TARGET))
            edges = np.append(np.flatnonzero(new), len(keys)).tolist()
            for start, end in zip(edges[:-1], edges[1:]):
                if cell != keys[start].tobytes():
                    if askers:
                        yield trie.near(askers)
                    cell, trie, targets, askers, many = keys[start].tobytes(), None, [], [], 0
                part = batch.slice(start, end - start)
                if states[start] == TARGET:
                    targets.append(part)
                elif targets:       # a cell's targets come before its askers
                    trie = trie or Cell(targets, depth)
                    askers.append(part)
                    many += part.num_rows
                    if many >= ASKERS:
                        yield trie.near(askers)
                        askers, many = [], 0
        if askers:
            yield trie.near(askers)

    dealt = sent(placed, depth, parts).repartition("cell").sortWithinPartitions("cell", "state")
    return map_arrow(dealt, run, "a string, a_n long, b string, b_n long")


# ---- forms -------------------------------------------------------------------

def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` from ``(word, form)``: each word's last form, by doubling the steps until none changes."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        doubled = now.join(onward, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        found = stored(doubled, "roots")
        now = found.select("word", "root")
        if not found.where("moved").limit(1).count():
            return now


def spelling_variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for distinct words ``(word, n)``.

    ``form`` is the near word of largest n (ties: smallest in code-point order)
    if that n is at least ``ratio`` times the word's; ``root`` is found by
    following forms to the last.
    """
    words = stored(words, "words")
    pairs = stored(near_pairs(words), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).union(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    joined = words.join(best, "word", "left")
    has_form = -F.col("best.n") >= ratio * F.col("n")
    known = stored(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                                 F.when(has_form, F.col("best.near")).alias("form"),
                                 F.when(has_form, -F.col("best.n")).alias("form_n")), "forms")
    last = roots(known.where(F.col("form").isNotNull()).select("word", "form"))
    return known.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
