"""Packing of token sequences by minimum bin slack (operator 4).

Documents become ids with an end mark; only those longer than a sequence are
cut, into pieces of a sequence's length. Each sequence is then filled by itself:
the longest piece left goes in, and a subset-sum search over the lengths left,
a bitset with a bit for each sum, finds the combination that leaves least room.
It is removed and the next sequence is filled.

Pieces of one length are alike, so the search runs over the number of pieces of
each length, at most ``capacity`` numbers however many documents there are, and
a combination is used as often as the numbers allow. Between two uses some
length has run short, which bounds the combinations by ``capacity * (2 +
ln(capacity))``, about 42,000 for 4096; that bounds what the driver holds and
what tasks are sent. Spark counts lengths, numbers the pieces of each length and
looks up where they go. Numbers come in two steps, within a salted share of each
length and by the shares' totals, so a length that very many pieces have is
spread over tasks.

Rows: a null or empty text is the end mark alone. Repeated rows are packed each.
Null keys are carried. Very long texts give many pieces. An empty table gives an
empty result. Columns other than those asked for are left out.
"""

from __future__ import annotations

import math
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearsay.llm.bpe import SHORT_BYTES, Encoder, MergeTable
from hearsay.llm.tasks import map_arrow, stored, text_slices

CAPACITY = 4096
END = 1
CACHE_PIECES = 100_000
ROWS_PER_SHARE = 20_000

# The pre-tokens of the word tokenizer for text within Latin-1; a test compares it with the file's pattern.
_LATIN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\x09-\x0d\x20\x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼½¾]+")


class WordTokenizer:
    """Ids of texts as a tokenizer file gives them, with ids of known pre-tokens kept.

    Texts beyond Latin-1, and texts that hold a special token, go to the
    tokenizers library whole; other texts are cut into pre-tokens here, and unknown
    ones are merged many at a time.
    """

    def __init__(self, source: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(source)
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.merger = Encoder(MergeTable(source))
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def _simple(self, text: str) -> bool:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return not any(map(text.__contains__, self.specials))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        simple = [self._simple(t) for t in texts]
        parts = [_LATIN.findall(t.lower()) if s else [] for t, s in zip(texts, simple)]
        if len(self.young) > CACHE_PIECES:
            self.old, self.young = self.young, {}
        short: dict[int, list[str]] = {}
        long = []
        for p in set().union(*parts).difference(self.young):
            if (known := self.old.get(p)) is not None:
                self.young[p] = known
            elif (size := len(p.encode())) <= SHORT_BYTES:
                short.setdefault((size + 3) // 4, []).append(p)
            else:
                long.append(p)
        for same in short.values():
            for i in range(0, len(same), 1 << 14):
                some = same[i:i + (1 << 14)]
                self.young.update(zip(some, self.merger.merged_many([p.encode() for p in some])))
        self.young.update(zip(long, self._whole(long)))
        out = [b"".join(map(self.young.__getitem__, own)) for own in parts]
        for p in long:
            del self.young[p]
        for i, s in enumerate(simple):
            if not s:
                out[i] = self._whole([texts[i]])[0]
        return out


@lru_cache(maxsize=2)
def _tokenizer(source: str) -> WordTokenizer:
    return WordTokenizer(source)


def token_pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text",
                 capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """``(key, piece, start, length, ids)``: each document's ids and end mark, cut where longer than ``capacity``."""
    with open(tokenizer, encoding="utf-8") as f:
        source = f.read()
    chosen = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
    mark = np.array([end], "<u4").tobytes()
    step = 4 * capacity

    def run(batches):
        encoder = _tokenizer(source)
        for part in text_slices(batches):
            owner, piece, ids = [], [], []
            for i, packed in enumerate(encoder.encode_all([t or "" for t in part.column(1).to_pylist()])):
                packed += mark
                for k, at in enumerate(range(0, len(packed), step)):
                    owner.append(i)
                    piece.append(k)
                    ids.append(packed[at:at + step])
            number = np.array(piece, np.int32)
            yield pa.RecordBatch.from_arrays([
                part.column(0).take(pa.array(owner, pa.int64())), pa.array(number), pa.array(number.astype(np.int64) * capacity),
                pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                names=["key", "piece", "start", "length", "ids"])

    key_type = docs.schema[key].dataType.simpleString()
    out = map_arrow(chosen, run, f"key {key_type}, piece int, start long, length long, ids binary")
    return out.withColumnRenamed("key", key)


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """How many of each length sum to the most that ``room`` holds; ``lengths`` falls."""
    sums, steps, full = 1, [], (1 << (room + 1)) - 1
    for length in lengths:
        if length > room:
            continue
        left, take = min(counts[length], room // length), 1
        while left and not sums >> room & 1:
            take = min(take, left)
            steps.append((length, take, sums))
            sums |= sums << (length * take) & full
            left -= take
            take *= 2
        if sums >> room & 1:
            break
    at, used = sums.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return used


def combinations(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """``(times, {length: pieces})`` that use up all counts, each the fullest when it is chosen."""
    counts = {length: n for length, n in counts.items() if n}
    if any(not 0 < length <= capacity for length in counts):
        raise ValueError(f"lengths must lie in 1 to {capacity}")
    lengths, out = sorted(counts, reverse=True), []
    while lengths:
        longest = lengths[0]
        counts[longest] -= 1
        use = fullest(counts, lengths, capacity - longest)
        counts[longest] += 1
        use[longest] = use.get(longest, 0) + 1
        times = min(counts[length] // n for length, n in use.items())
        out.append((times, use))
        for length, n in use.items():
            counts[length] -= n * times
        if not all(counts[length] for length in use):
            lengths = [length for length in lengths if counts[length]]
    return out


class Plan:
    """Where the n-th piece of each length goes."""

    def __init__(self, found: list[tuple[int, dict[int, int]]]):
        rows, taken, sequence = [], {}, 0
        for times, use in found:
            offset = 0
            for length, n in use.items():
                rows.append((length, taken.get(length, 0), n, sequence, offset))
                taken[length] = taken.get(length, 0) + n * times
                offset += n * length
            sequence += times
        rows.sort()
        self.sequences = sequence
        table = np.array(rows, np.int64).reshape(-1, 5)
        self.length, self.first, self.each, self.sequence, self.offset = table.T.copy()
        self.rank = self.length << 48 | self.first

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces with these lengths and numbers, from 0."""
        at = np.searchsorted(self.rank, length << 48 | number, "right") - 1
        turn, slot = np.divmod(number - self.first[at], self.each[at])
        return self.sequence[at] + turn, self.offset[at] + slot * length


def pack(pieces: DataFrame, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece"),
         capacity: int = CAPACITY) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``; ``order`` tells pieces of one length apart."""
    pieces = stored(pieces, "pieces")
    counts = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}
    plan = Plan(combinations(counts, capacity))
    shares = max(16, math.ceil(sum(counts.values()) / ROWS_PER_SHARE))

    rows = pieces.withColumn("_share", F.pmod(F.xxhash64(*order), F.lit(shares)))
    totals = rows.groupBy(length, "_share").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(length).orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(length, "_share", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy(length, "_share").orderBy(*order)) - 1
    numbered = rows.withColumn("_row", number).join(totals, [length, "_share"])
    # No more files than shares: few rows need few.
    chosen = numbered.coalesce(shares).select(F.col(length).cast("long").alias("_length"), (F.col("_before") + F.col("_row")).alias("_number"), *pieces.columns)
    names = [*pieces.columns, "sequence_id", "offset"]

    def run(batches):
        for batch in batches:
            sequence, offset = plan.place(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(sequence), pa.array(offset)], names=names)

    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields]
    return map_arrow(chosen, run, ", ".join([*types, "sequence_id long, offset long"]))


def pack_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text",
                   capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces of whole documents with their ids, sequence and offset."""
    return pack(token_pieces(docs, tokenizer, key, text, capacity, end), order=(key, "piece"), capacity=capacity)
