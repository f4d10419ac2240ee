"""Masked pseudo-likelihood scores of documents (operator 2).

A window network in numpy predicts every word from ``REACH`` words on both
sides: an embedding for each place and word, summed, a tanh, and a softmax in
two steps, class and word within class. A document's score is the sum of its
words' conditional log-probabilities.

The lexicon holds every word of the corpus with its count, in a stored table that
grows with the corpus. The softmax covers the ``VOCABULARY`` most frequent words
and ``TAILS`` entries among which all other words are dealt by a hash. So every
word is predicted from both sides: by its own entry, or by its tail's entry and
then its share of the tail's count. Of the words in the tails, at most ``COMMON``
are sent to the tasks with their counts; the rest are looked up by a join with
the table. In a context, a word outside the vocabulary adds the sum of two hashed
embeddings to the one that all such words have; their number grows with the root
of the number of words, so that few words share both. A word that the lexicon
does not have counts as if seen once.

Training goes over the whole corpus in ``ROUNDS`` rounds. Texts are dealt to
shards by a hash of key and words, ``SHARD_WORDS`` words to a shard on average,
and ordered by it within; a shard is stored as one row of words, and cut where it
holds twice as many. Each shard trains a copy of the model from where the round
began, Spark sums the changes weighted by positions, and the mean is the next
round's start. The places of a shard are dealt to the rounds by a hash, so that
each is a target once. Sums are of whole numbers. Thus the model depends on the
rows alone, not on how the table is split or which task ends first. What is
gathered grows with the corpus: one model for each task, added up in groups; the
driver gets one model.

Rows: null and empty texts have no words and score 0, with a null mean. Texts of
any length are read whole. Repeated rows train and score each; rows that are equal
in key and words pass through one task as a stream. An empty table
gives an empty result. Columns other than key and text are left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.llm.tasks import map_arrow, stored, text_slices
from hearsay.llm.wordhash import mix, words

NONE = np.zeros(0, np.uint64)

CLASSES = 32
VOCABULARY = CLASSES * 32 - 1
TAILS = CLASSES * 64 - VOCABULARY   # entries for all other words
COMMON = 1 << 18                    # at most so many other words are sent to the tasks
REACH = 2
WIDTH = 24
ROUNDS = 2
SHARD_WORDS = 2_000_000
MOST_TASKS = 10_000                 # tasks that write shards; each may hold several
OTHER = np.uint32(1 << 31)          # codes from here on are words outside the vocabulary, by 31 bits of their hash
PAD = OTHER - np.uint32(1)
FRACTION = 4096.0                   # changes are summed in these parts of a position
CHUNK = 1024
GROUPS = 64
BATCH = 4096
RATE = 0.1
SEED = 5
LARGE = 60.0                        # below it, sums of exponentials of 32-bit numbers neither overflow nor vanish
OFFSETS = np.array([*range(-REACH, 0), *range(1, REACH + 1)])


@dataclass
class Lexicon:
    """Words by the hash of their lower-case form: those of the softmax, and the others with their counts."""

    hashes: np.ndarray          # sorted
    ids: np.ndarray             # entry of each; 0 is any other word
    counts: np.ndarray          # by entry; entry 0 and the last ``tails - 1`` are the other words'
    others: int
    common: np.ndarray = field(default_factory=NONE.copy)           # the most frequent others, sorted
    common_counts: np.ndarray = field(default_factory=NONE.copy)
    table: DataFrame | None = None                                  # stored (word, n) of all words
    tails: int = 1

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        return _find(self.hashes, self.ids, hashes)

    def common_count(self, hashes: np.ndarray) -> np.ndarray:
        """The counts of words outside the softmax; 0 for those that are not sent to the tasks."""
        return _find(self.common, self.common_counts.astype(np.int64), hashes)

    @property
    def vocabulary(self) -> int:
        return len(self.counts) - self.tails

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """Words in 32 bits: the entry, or beyond ``OTHER`` 31 bits of the hash."""
        ids = self.lookup(hashes)
        return np.where(ids > 0, ids.astype(np.uint32), OTHER | (hashes >> np.uint64(33)).astype(np.uint32))

    def spread(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each code: its entry in a context, in the softmax, and its two buckets of hashed embeddings."""
        context, target = codes.astype(np.int64), codes.astype(np.int64)
        pairs, other = np.zeros((2, len(codes)), np.int32), np.flatnonzero(codes >= OTHER)
        rest = (codes[other] ^ OTHER).astype(np.uint64)
        tail, mixed = (rest % np.uint64(self.tails)).astype(np.int64), mix(rest, 59)
        context[other], target[other] = 0, np.where(tail > 0, self.vocabulary + tail, 0)
        pairs[0, other], pairs[1, other] = mixed % np.uint64(self.buckets), (mixed >> np.uint64(32)) % np.uint64(self.buckets)
        context[codes == PAD] = self.vocabulary + 1
        return context, target, pairs

    @property
    def buckets(self) -> int:
        return 1 << math.ceil(2 + math.log2(self.others) / 2)

    def without_table(self) -> Lexicon:
        return replace(self, table=None)


def _find(known: np.ndarray, values: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, values[at], 0)


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))


def _hashes(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return words([t or "" for t in part.column(1).to_pylist()], lower=True)


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: int = VOCABULARY,
                common: int = COMMON, tails: int = 1) -> Lexicon:
    """All words of all documents. Ties for the vocabulary go to the smaller hash."""

    def run(batches):
        for part in text_slices(batches, max_bytes=8 << 20):
            found, times = np.unique(_hashes(part)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(times.astype(np.int64))], names=["word", "n"])

    counted = stored(map_arrow(_texts(docs, key, text), run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    ranked = counted.orderBy(F.desc("n"), "word").limit(vocabulary)
    table = np.array([(r["word"], r["n"]) for r in ranked.collect()], np.int64).reshape(-1, 2)      # at most ``vocabulary`` rows
    totals = counted.agg(F.count("*").alias("types"), F.sum("n").alias("n")).first()
    order = np.argsort(table[:, 0].view(np.uint64))
    by_tail = np.zeros(tails, np.int64)
    for r in counted.groupBy((F.shiftrightunsigned("word", 33) % tails).alias("tail")).agg(F.sum("n").alias("n")).collect():     # ``tails`` rows
        by_tail[r["tail"]] = r["n"]
    np.subtract.at(by_tail, ((table[:, 0].view(np.uint64) >> np.uint64(33)) % np.uint64(tails)).astype(np.int64), table[:, 1])
    counts = np.zeros(vocabulary + tails)
    counts[1:len(table) + 1] = table[:, 1]
    counts[0], counts[vocabulary + 1:] = by_tail[0], by_tail[1:]
    # The others from the count on at which no more than ``common`` words are left.
    least, left = math.inf, common + len(table)
    for r in counted.groupBy("n").count().orderBy(F.desc("n")).toPandas().itertuples(index=False):     # distinct counts, few
        left -= r[1]
        if left < 0:
            break
        least = r[0]
    sent = counted.where(F.col("n") >= least).toPandas().to_numpy(np.int64) if least < math.inf else np.zeros((0, 2), np.int64)
    sent = sent[~np.isin(sent[:, 0], table[:, 0])]
    sent = sent[np.argsort(sent[:, 0].view(np.uint64))]
    return Lexicon(np.ascontiguousarray(table[order, 0]).view(np.uint64), order + 1, counts, max(1, totals["types"] - len(table)),
                   np.ascontiguousarray(sent[:, 0]).view(np.uint64), sent[:, 1], counted, tails)


class Network:
    """Parameters as one flat vector with views into it. ``size`` entries are predicted, two steps of classes and words."""

    def __init__(self, lexicon: Lexicon, flat: np.ndarray | None = None):
        size, self.pad = len(lexicon.counts), lexicon.vocabulary + 1
        self.within = size // CLASSES
        shapes = {"embed": (2 * REACH, self.pad + 1, WIDTH), "bias": (WIDTH,), "to_class": (WIDTH, CLASSES), "class_bias": (CLASSES,),
                  "to_word": (CLASSES, WIDTH, self.within), "word_bias": (CLASSES, self.within),
                  "rare": (lexicon.buckets, WIDTH)}
        total = sum(math.prod(s) for s in shapes.values())
        fresh = flat is None
        self.flat = np.random.default_rng(SEED).normal(0, 0.1, total).astype(np.float32) if fresh else flat.astype(np.float32)
        self.views, at = {}, 0
        for name, shape in shapes.items():
            self.views[name] = self.flat[at:at + math.prod(shape)].reshape(shape)
            at += math.prod(shape)
        # Entries are dealt to classes in turn by frequency, so that classes weigh alike.
        if fresh:
            share = (lexicon.counts + 1) / (lexicon.counts + 1).sum()
            by_class = share.reshape(self.within, CLASSES).T
            self.views["class_bias"][:] = np.log(by_class.sum(axis=1))
            self.views["word_bias"][:] = np.log(by_class / by_class.sum(axis=1, keepdims=True))

    def hidden(self, context: np.ndarray, pairs: np.ndarray | None, at: np.ndarray) -> np.ndarray:
        """Of the places ``at``, in rising order, of a row of words whose ``context`` and ``pairs`` ``Lexicon.spread`` gave."""
        v, low, n = self.views, at[0] - REACH, at[-1] - at[0] + 1
        if pairs is None:
            total = np.repeat(v["bias"][None, :], len(at), axis=0)
        else:
            # A hashed word is looked up once, and added to all places that it is near.
            rare = np.zeros((n + 2 * REACH, WIDTH), np.float32)
            some = np.flatnonzero(context[low:low + len(rare)] == 0)
            rare[some] = v["rare"].take(pairs[0, low + some], axis=0) + v["rare"].take(pairs[1, low + some], axis=0)
            summed = rare[:n] + v["bias"]
            for k in OFFSETS[1:] + REACH:
                summed += rare[k:k + n]
            total = summed.take(at - at[0], axis=0)
        for embed, k in zip(v["embed"], OFFSETS):
            total += embed.take(context[at + k], axis=0)
        return np.tanh(total, out=total)

    def _output(self) -> tuple[np.ndarray, np.ndarray, bool]:
        """Weights of classes and words with their biases as one input more, and whether any of their logits may be large."""
        v = self.views
        classes = np.concatenate([v["to_class"], v["class_bias"][None, :]])
        within = np.concatenate([v["to_word"], v["word_bias"][:, None, :]], axis=1)
        # The hidden layer lies between -1 and 1.
        return classes, within, not max(np.abs(classes).sum(axis=0).max(), np.abs(within).sum(axis=1).max()) < LARGE

    def _within(self, within: np.ndarray, h: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Logits of the words of each row's class; rows are sorted by class."""
        logits = np.empty((len(h), self.within), np.float32)
        for c, (a, b) in enumerate(zip(edges, edges[1:])):
            if a < b:
                np.matmul(h[a:b], within[c], out=logits[a:b])
        return logits

    def log_probabilities(self, context: np.ndarray, target: np.ndarray, rare: np.ndarray | None = None) -> np.ndarray:
        """``rare``: for each place of a context, the two buckets of the word if it is one of the others."""
        return self.log_probabilities_at(*_as_row(context, rare), target)

    def log_probabilities_at(self, context: np.ndarray, pairs: np.ndarray | None, at: np.ndarray, target: np.ndarray) -> np.ndarray:
        order, cls, edges = _by_class(target)
        h, word = _with_one(self.hidden(context, pairs, at).take(order, axis=0)), target[order] // CLASSES
        classes, within, large = self._output()
        every, out = np.arange(len(h)), np.empty(len(h), np.float32)
        logits, inner = h @ classes, self._within(within, h, edges)
        found = logits[every, cls] + inner[every, word]
        out[order] = found - _log_sum(logits, large) - _log_sum(inner, large)
        return out

    def gradient(self, context: np.ndarray, target: np.ndarray, rare: np.ndarray | None = None) -> np.ndarray:
        """Gradient of the summed negative log-probability."""
        return self.gradient_at(*_as_row(context, rare), target)

    def gradient_at(self, context: np.ndarray, pairs: np.ndarray | None, at: np.ndarray, target: np.ndarray) -> np.ndarray:
        order, cls, edges = _by_class(target)
        word, v = target[order] // CLASSES, self.views
        h = _with_one(self.hidden(context, pairs, at).take(order, axis=0))
        classes, within, large = self._output()
        grown = np.zeros_like(self.flat)
        g, first = {}, 0
        for name, view in v.items():
            g[name] = grown[first:first + view.size].reshape(view.shape)
            first += view.size
        every = np.arange(len(h))
        error = _softmax(h @ classes, large)
        error[every, cls] -= 1
        moved = h.T @ error
        g["to_class"][:], g["class_bias"][:] = moved[:WIDTH], moved[WIDTH]
        back = error @ v["to_class"].T
        error = _softmax(self._within(within, h, edges), large)
        error[every, word] -= 1
        moved, inner = np.zeros_like(within), np.empty_like(back)
        for c, (a, b) in enumerate(zip(edges, edges[1:])):
            if a < b:
                np.matmul(h[a:b].T, error[a:b], out=moved[c])
                np.matmul(error[a:b], v["to_word"][c].T, out=inner[a:b])
        g["to_word"][:], g["word_bias"][:] = moved[:, :WIDTH], moved[:, WIDTH]
        back += inner
        back *= 1 - h[:, :WIDTH] ** 2
        at = at[order]
        g["bias"][:] = back.sum(axis=0)
        for embed, k in zip(g["embed"], OFFSETS):
            near = context[at + k]
            known = np.flatnonzero(near)
            _add_rows(embed, near.take(known), back.take(known, axis=0))
            embed[0] += (near == 0).astype(np.float32) @ back
        if pairs is not None:
            # What all places near a hashed word move it by is summed first.
            low, n = at.min() - REACH, at.max() - at.min() + 1 + 2 * REACH
            placed = np.zeros((n + 2 * REACH, WIDTH), np.float32)
            placed[at - low + REACH] = back
            some = np.flatnonzero(context[low:low + n] == 0)
            moved = placed[REACH - OFFSETS[0]:REACH - OFFSETS[0] + n].copy()
            for k in REACH - OFFSETS[1:]:
                moved += placed[k:k + n]
            moved = moved.take(some, axis=0)
            for each in pairs:
                _add_rows(g["rare"], each[low + some], moved)
        return grown


def _as_row(context: np.ndarray, rare: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Contexts, a row of words on both sides for each, as one row, with the places they are the contexts of."""
    at = np.arange(len(context)) * (2 * REACH + 1) + REACH
    row, around = np.ones((2 * REACH + 1) * len(context), np.int64), at[:, None] + OFFSETS
    row[around] = context
    if rare is None:
        return row, None, at
    pairs = np.zeros((2, len(row)), np.int64)
    pairs[:, around] = rare
    return row, pairs, at


def _with_one(h: np.ndarray) -> np.ndarray:
    return np.concatenate([h, np.ones((len(h), 1), np.float32)], axis=1)


def _add_rows(to: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """``to[at] += rows``, where places may repeat."""
    # In one dimension, and two numbers at a time as the halves of a complex one: many times faster.
    places = at.astype(np.int64)[:, None] * (WIDTH // 2) + np.arange(WIDTH // 2)
    np.add.at(to.reshape(-1).view(np.complex64), places.ravel(), rows.reshape(-1).view(np.complex64))


def _by_class(target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by class, the classes in that order, and where each begins."""
    cls = (target % CLASSES).astype(np.uint8)
    order = np.argsort(cls, kind="stable")
    cls = cls[order]
    return order, cls, np.searchsorted(cls, np.arange(CLASSES + 1))


def _exp(logits: np.ndarray, large: bool) -> tuple[np.ndarray | None, np.ndarray]:
    """Exponentials in place, of what is left of each row above its greatest, if ``large``; returns that and the rows' sums."""
    top = logits.max(axis=1) if large else None
    if large:
        logits -= top[:, None]
    np.exp(logits, out=logits)
    return top, logits @ np.ones(logits.shape[1], np.float32)


def _log_sum(logits: np.ndarray, large: bool) -> np.ndarray:
    """Of each row; overwrites them."""
    top, total = _exp(logits, large)
    return np.log(total) + top if large else np.log(total)


def _softmax(logits: np.ndarray, large: bool) -> np.ndarray:
    logits *= (1 / _exp(logits, large)[1])[:, None]
    return logits


def _padded(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all texts in one row with ``REACH`` pads between, and the places of the words."""
    counts = np.diff(ends, prepend=0)
    place = np.arange(len(codes)) + REACH * (1 + np.repeat(np.arange(len(counts)), counts))
    row = np.full(len(codes) + REACH * (len(counts) + 1), PAD, np.uint32)
    row[place] = codes
    return row, place


def _turns(row: np.ndarray, rounds: int) -> np.ndarray:
    """The round in which each place of a shard is a target; pads are none's."""
    turns = (mix(np.arange(len(row), dtype=np.uint64), 60) % np.uint64(rounds)).astype(np.int64)
    turns[row == PAD] = -1
    return turns


def shards(docs: DataFrame, lexicon: Lexicon, key: str = "doc_id", text: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """Stored ``(shard, codes)``: the words of each shard in one row of 32-bit codes, with pads around each text."""
    number = max(1, round(lexicon.counts.sum() / shard_words))
    lexicon = lexicon.without_table()
    tasks = min(number, MOST_TASKS)
    rows = docs.select(F.xxhash64(docs[key]).alias("key"), docs[text].cast("string").alias("text"))

    def deal(batches):
        for part in text_slices(batches):
            hashes, ends = _hashes(part)
            codes, begins = lexicon.codes(hashes), np.append(0, ends)
            summed = np.append(np.uint64(0), np.cumsum(mix(hashes + np.arange(len(hashes), dtype=np.uint64) - np.repeat(
                begins[:-1].astype(np.uint64), np.diff(begins)), 61), dtype=np.uint64))
            place = mix(np.diff(summed[begins]) + mix(part.column(0).to_numpy().view(np.uint64), 62))       # modulo 2**64
            some = np.flatnonzero(np.diff(begins))
            shard = ((place[some] >> np.uint64(8)) % np.uint64(number)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(place[some].view(np.int64)), pa.array(
                [codes[begins[i]:begins[i + 1]].tobytes() for i in some.tolist()], pa.binary())], names=["shard", "place", "codes"])

    dealt = map_arrow(rows, deal, "shard long, place long, codes binary")
    dealt = dealt.repartitionById(tasks, (F.col("shard") % tasks).cast("int")).sortWithinPartitions("shard", "place", "codes")

    def join(batches):
        last, held, size = None, [], 0
        gap = np.full(REACH, PAD, np.uint32).tobytes()

        def row():
            return pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([gap + gap.join([*held, b""])], pa.binary())], names=["shard", "codes"])

        for part in batches:
            for shard, codes in zip(part.column(0).to_pylist(), part.column(2)):
                if held and (shard != last or size >= 8 * shard_words):       # four bytes a word
                    yield row()
                    held, size = [], 0
                last = shard
                held.append(codes.as_py())
                size += len(held[-1])
        if held:
            yield row()

    return stored(map_arrow(dealt, join, "shard long, codes binary"), "shards")


def train_shard(lexicon: Lexicon, begun: np.ndarray, row: np.ndarray, turn: int, rounds: int) -> tuple[np.ndarray, int]:
    """The change of the parameters over the places of a shard that are targets in this round, and their number."""
    model, moved = Network(lexicon, begun), np.full(len(begun), 1e-3, np.float32)
    spare, some = np.empty_like(moved), np.flatnonzero(_turns(row, rounds) == turn)
    context, target, pairs = lexicon.spread(row)
    for i in range(0, len(some), BATCH):
        at = some[i:i + BATCH]
        change = model.gradient_at(context, pairs, at, target[at])
        np.multiply(change, change, out=spare)
        moved += spare
        np.sqrt(moved, out=spare)
        change *= RATE
        change /= spare
        model.flat -= change
    return model.flat - begun, len(some)


def train(docs: DataFrame, lexicon: Lexicon, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS,
          shard_words: int = SHARD_WORDS) -> np.ndarray:
    """The network's parameters after ``rounds`` rounds over all documents."""
    dealt = shards(docs, lexicon, key, text, shard_words)
    lexicon = lexicon.without_table()
    flat = Network(lexicon).flat
    for turn in range(rounds):
        flat = _round(dealt, lexicon, flat, turn, rounds)
    return flat


def _round(dealt: DataFrame, lexicon: Lexicon, begun: np.ndarray, turn: int, rounds: int) -> np.ndarray:
    size = len(begun)

    def run(batches):
        total = np.zeros(size + 1, np.int64)
        for part in batches:
            for codes in part.column(0):
                change, positions = train_shard(lexicon, begun, np.frombuffer(codes.as_buffer(), np.uint32), turn, rounds)
                total[:size] += np.rint(change.astype(np.float64) * (positions * FRACTION)).astype(np.int64)
                total[size] += positions
        if total[size]:
            parts = [total[i:i + CHUNK] for i in range(0, len(total), CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array(parts, pa.list_(pa.int64()))], names=["chunk", "v"])

    changes = map_arrow(dealt.select("codes"), run, "chunk int, v array<long>").withColumn("many", F.spark_partition_id() % GROUPS)
    summed = _summed(_summed(changes, "chunk", "many"), "chunk").select("chunk", "v").toPandas().sort_values("chunk")     # one model
    if not len(summed):
        return begun
    total = np.concatenate(summed["v"].to_list())
    return (begun + total[:size] / (FRACTION * total[size])).astype(np.float32)


def _summed(rows: DataFrame, *by: str) -> DataFrame:
    """Arrays ``v`` of whole numbers added up by place, for each ``by``."""
    def add(table: pa.Table) -> pa.Table:
        arrays = table.column("v").combine_chunks()
        total = arrays.values.to_numpy().reshape(len(arrays), -1).sum(axis=0)
        return table.select(["chunk", "many"]).slice(0, 1).append_column("v", pa.array([total], pa.list_(pa.int64())))

    return rows.select("chunk", "many", "v").groupBy(*by).applyInArrow(add, "chunk int, many int, v array<long>")


def score(docs: DataFrame, lexicon: Lexicon, flat: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_words, log_likelihood, mean_log_likelihood)`` per row, in nats."""
    table, lexicon = lexicon.table, lexicon.without_table()
    tail_counts = np.log(np.maximum(1.0, lexicon.counts))       # by entry

    def run(batches):
        model = Network(lexicon, flat)
        for part in text_slices(batches):
            hashes, ends = _hashes(part)
            codes = lexicon.codes(hashes)
            row, place = _padded(codes, ends)
            context, target, pairs = lexicon.spread(row)
            each = np.zeros(len(place) + 1)
            for i in range(0, len(place), 4 * BATCH):
                at = place[i:i + 4 * BATCH]
                each[i + 1:i + 1 + len(at)] = model.log_probabilities_at(context, pairs, at, target[at])
            # A word outside the vocabulary has its share of its tail; the counts that the tasks lack come below.
            other = np.flatnonzero(codes >= OTHER)
            times = lexicon.common_count(hashes[other])
            each[other + 1] += np.log(np.maximum(times, 1)) - tail_counts[target[place[other]]]
            total = np.cumsum(each)
            counts, sums = np.diff(ends, prepend=0), np.diff(total[np.append(0, ends)])
            rest = other[times == 0]
            edges = pa.array(np.searchsorted(rest, np.append(0, ends)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts.astype(np.int64)), pa.array(sums),
                                              pa.ListArray.from_arrays(edges, pa.array(hashes[rest].view(np.int64)))], names=["key", "n", "s", "rest"])

    kind = docs.schema[key].dataType.simpleString()
    out = map_arrow(_texts(docs, key, text), run, f"key {kind}, n long, s double, rest array<long>")
    if table is not None:
        # The words that the tasks do not have: looked up in the stored table, row by row of what is stored here.
        out = stored(out.withColumn("row", F.monotonically_increasing_id()), "scores")
        rest = out.select("row", F.explode("rest").alias("word")).join(table.where(F.col("n") > 1), "word")
        found = rest.groupBy("row").agg(F.sum(F.log("n")).alias("more"))
        out = out.join(found, "row", "left").withColumn("s", F.col("s") + F.coalesce("more", F.lit(0.0)))
    mean = F.when(F.col("n") > 0, F.col("s") / F.col("n"))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_words"), F.col("s").alias("log_likelihood"), mean.alias("mean_log_likelihood"))
