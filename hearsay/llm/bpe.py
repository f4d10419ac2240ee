"""Byte-level BPE as a streaming transducer, and its decoder (operator 1).

``MergeTable`` holds the merge list and the lookahead it needs: how many bytes
behind the end of the text read so far a token can still change when more text
follows. ``Transducer`` reads a text in blocks. It emits a pre-token once its
end is certain, since no merge crosses that end. A pre-token that goes on past
``OPEN_CHARS`` is merged while it is read: ``Merger`` emits every token that ends
at least the lookahead before the last byte read. So what is held between blocks
grows neither with the text nor with a pre-token. ``Encoder`` runs the texts of a
slice through one transducer each, a block of every text at a time, and looks
emitted pre-tokens up among those merged before. ``Decoder`` feeds token bytes to
an incremental UTF-8 state machine, so a character may span tokens and blocks.

Why the lookahead is enough. Take the merges of a text ``w`` and of ``w + v``
in rank order. Both begin with the same symbols up to ``len(w)``. The common
part can only lose its last token ``x`` when one side applies a merge ``(x, y)``
across its end. The next loss needs a merge of a later rank, ``(x2, y2)``,
where ``y2`` is ``x`` or begins with it in its derivation. So the losses form a
chain of merges of rising rank, and the longest sum of their left parts, found
by one pass over the merge list, bounds what can change.

Rows: null text counts as the empty text, which gives no tokens. A text of any
length is one row; repeated rows give repeated results. An empty table gives an
empty table. Columns other than the ones asked for are left out, so clashing
names do no harm.
"""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterable
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from hearsay.llm.tasks import map_arrow, text_slices

SHIFT = 20
MASK = (1 << SHIFT) - 1
NONE = 1 << 60
CACHE_PIECES = 120_000      # pre-tokens kept per generation, two generations
SHORT_BYTES = 48            # longer pre-tokens are merged one by one and not kept
BLOCK_CHARS = 1 << 16       # read from each text at a time
OPEN_CHARS = 256            # an unended pre-token of so many characters is merged as it is read

# Pre-tokens of the byte-level scheme, with white space as Unicode defines it
# (Python's own \s also takes \x1c-\x1f).
_SPACE = r"\x09-\x0d\x20\x85\xa0  -     　"
_PIECES = (r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+")
# Texts within Latin-1 take the faster engine with the classes spelt out.
_LATIN = re.compile(_PIECES.replace("{L}", "A-Za-zªµºÀ-ÖØ-öø-ÿ").replace("{N}", "0-9²³¹¼½¾").replace("{S}", _SPACE))
_UNICODE = regex.compile(_PIECES.replace("{L}", r"\p{L}").replace("{N}", r"\p{N}").replace("{S}", _SPACE))
# How a pre-token that ends in a character of one kind may go on.
_SPACES = regex.compile(f"[{_SPACE}]*+")
_RUNS = [_SPACES, regex.compile(r"\p{L}*+"), regex.compile(r"\p{N}*+"), regex.compile(rf"[^{_SPACE}\p{{L}}\p{{N}}]*+")]


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 characters stand for themselves; the other bytes take
    the code points from 256 on, in order.
    """
    own = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class MergeTable:
    """Merges, token bytes, special tokens and the lookahead of a tokenizer file."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        before = spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
            raise ValueError("a BPE file of plain merges over bytes is needed")
        self.byte_level = (before.get("type") == "ByteLevel" and not spec.get("normalizer") and not model.get("end_of_word_suffix")
                           and not before.get("add_prefix_space") and before.get("use_regex", True))
        symbols = byte_symbols()
        to_byte = {s: b for b, s in enumerate(symbols)}
        vocab: dict[str, int] = model["vocab"]
        self.of_byte = [vocab[s] for s in symbols]
        self.of_byte_array = np.array(self.of_byte, np.int64)
        suffix = model.get("end_of_word_suffix") or ""
        self.of_last_byte = np.array([vocab[s + suffix] for s in symbols], np.int64)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merge_of = {vocab[a] << SHIFT | vocab[b]: rank << SHIFT | vocab[a + b] for rank, (a, b) in enumerate(merges)}
        self.pairs = np.array(sorted(self.merge_of), np.int64)
        self.pair_ranks = np.array([self.merge_of[p] for p in self.pairs.tolist()] + [NONE], np.int64)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.longest_special = max(map(len, self.specials), default=0)
        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.token_bytes = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(map(to_byte.__getitem__, token.removesuffix(suffix)))
        for token, i in self.specials.items():
            self.token_bytes[i] = token.encode()
        self.lookahead = sufficient_lookahead(merges) if self.byte_level else None
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None

    def ranks(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Rank and result of the merge of each two ids, ``NONE`` where there is none."""
        pairs = first << SHIFT | second
        at = np.searchsorted(self.pairs, pairs)
        at[(at == len(self.pairs)) | (self.pairs[np.minimum(at, len(self.pairs) - 1)] != pairs)] = len(self.pairs)
        return self.pair_ranks[at]


def sufficient_lookahead(merges: list[tuple[str, str]]) -> int:
    """Bytes behind the end of the text read within which tokens can change.

    ``longest[x]`` is the longest chain among the merges seen so far whose left
    part is ``x``. Merge parts must be bytes or results of earlier merges.
    """
    lefts: dict[str, list[str]] = {}
    longest: dict[str, int] = {}
    for a, b in merges:
        if any(len(x) > 1 and x not in lefts for x in (a, b)):
            raise ValueError(f"merge {a!r} {b!r} uses a token that no earlier merge makes")
        begins, at = [b], 0
        while at < len(begins):
            begins += lefts.get(begins[at], ())
            at += 1
        chain = len(a) + max(longest.get(x, 0) for x in begins)
        longest[a] = max(longest.get(a, 0), chain)
        lefts.setdefault(a + b, []).append(a)
    return max(longest.values(), default=0)


class Encoder:
    def __init__(self, table: MergeTable):
        self.table = table
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merged(self, ids: list[int]) -> list[int]:
        """All merges within ``ids``, lowest rank first, leftmost first."""
        merge_of = self.table.merge_of.get
        ranks = [merge_of(a << SHIFT | b, NONE) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == NONE:
                break
            i = ranks.index(best)
            new = ids[i] = best & MASK
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = merge_of(new << SHIFT | ids[i + 1], NONE)
            if i:
                ranks[i - 1] = merge_of(ids[i - 1] << SHIFT | new, NONE)
        return ids

    def merged_many(self, words: list[bytes]) -> list[bytes]:
        """``merged`` for many short words at once, one merge of each word a step; packed ids."""
        table, count = self.table, len(words)
        left = np.fromiter(map(len, words), np.int64, count)
        width = int(left.max())
        symbols = np.zeros((count, width + 1), np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        symbols[np.arange(width + 1) < left[:, None]] = table.of_byte_array[data]
        symbols[np.arange(count), left - 1] = table.of_last_byte[data[np.cumsum(left) - 1]]
        ranks = table.ranks(symbols[:, :-1], symbols[:, 1:])
        ranks[np.arange(width) >= left[:, None] - 1] = NONE
        result, lengths, rows = np.zeros((count, width), "<u4"), np.zeros(count, np.int64), np.arange(count)
        while len(rows):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            over = best == NONE
            if over.any():
                result[rows[over], :symbols.shape[1] - 1] = symbols[over, :-1]
                lengths[rows[over]] = left[over]
                symbols, ranks, rows, left, at, best = (x[~over] for x in (symbols, ranks, rows, left, at, best))
                if not len(rows):
                    break
            every, new = np.arange(len(rows)), best & MASK
            symbols[every, at] = new
            keep = np.arange(symbols.shape[1] - 1)
            symbols = np.take_along_axis(symbols, keep + (keep > at[:, None]), 1)
            symbols[:, -1] = 0
            ranks = np.take_along_axis(ranks, keep[:-1] + (keep[:-1] >= at[:, None]), 1)
            left -= 1
            follows = at < left - 1
            ranks[every[follows], at[follows]] = table.ranks(new[follows], symbols[every[follows], at[follows] + 1])
            leads = at > 0
            ranks[every[leads], at[leads] - 1] = table.ranks(symbols[every[leads], at[leads] - 1], new[leads])
        packed = result[np.arange(width) < lengths[:, None]].tobytes()
        ends = np.cumsum(lengths * 4).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends)]

    def long_piece(self, data: bytes) -> bytes:
        merger = Merger(self)
        return merger.feed(data) + merger.finish()

    def pieces(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
            return _LATIN.findall(text)
        except UnicodeEncodeError:
            return _UNICODE.findall(text)

    def learn(self, unknown: set) -> list[str | bytes]:
        """Take packed ids of what transducers emitted into ``young``; returns what is not to be kept."""
        short: dict[int, list[str]] = {}
        long = []
        for p in unknown:
            if (known := self.old.get(p)) is not None:
                self.young[p] = known
            elif isinstance(p, int):
                self.young[p] = np.array([p], "<u4").tobytes()
            elif isinstance(p, bytes):
                self.young[p] = p
                long.append(p)
            elif len(data := p.encode()) <= SHORT_BYTES:
                short.setdefault((len(data) + 3) // 4, []).append(p)
            else:
                self.young[p] = self.long_piece(data)
                long.append(p)
        for same in short.values():
            for i in range(0, len(same), 1 << 14):
                some = same[i:i + (1 << 14)]
                self.young.update(zip(some, self.merged_many([p.encode() for p in some])))
        return long

    def encode_all(self, texts: list[str], block: int = BLOCK_CHARS) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        packed: list[list[bytes]] = [[] for _ in texts]
        going = [(text, Transducer(self), out) for text, out in zip(texts, packed)]
        start = 0
        while going:
            end = start + block
            emitted = [reader.feed(text[start:end], end >= len(text)) for text, reader, _ in going]
            if len(self.young) > CACHE_PIECES:
                self.old, self.young = self.young, {}
            once = self.learn(set().union(*emitted).difference(self.young))
            for (_, _, out), parts in zip(going, emitted):
                out.append(b"".join(map(self.young.__getitem__, parts)))
            for p in once:
                del self.young[p]
            going = [g for g in going if len(g[0]) > end]
            start = end
        return [b"".join(out) for out in packed]


class Merger:
    """Token ids of one pre-token that comes in blocks, each emitted once it is stable."""

    def __init__(self, encoder: Encoder):
        self.merged, self.table = encoder.merged, encoder.table
        self.pending: list[int] = []

    def feed(self, data: bytes) -> bytes:
        """Packed ids of the tokens that no further byte can change."""
        of_byte, token_bytes, ahead = self.table.of_byte, self.table.token_bytes, self.table.lookahead
        step, emitted = max(1, ahead), []
        for i in range(0, len(data), step):
            self.pending += [of_byte[b] for b in data[i:i + step]]
            if len(self.pending) < 2 * ahead:
                continue
            stable = len(self.pending) - ahead
            done = 0
            for token in self.merged(self.pending.copy()):
                if done + len(token_bytes[token]) > stable:
                    break
                done += len(token_bytes[token])
                emitted.append(token)
            del self.pending[:done]
        return np.array(emitted, "<u4").tobytes()

    def finish(self) -> bytes:
        rest, self.pending = self.merged(self.pending), []
        return np.array(rest, "<u4").tobytes()


class Transducer:
    """Reads a text in blocks and emits what further text cannot change, in order.

    Emitted are pre-tokens whose end is certain (str), special tokens (int), and
    stable tokens of a pre-token that has not ended (packed ids). A pre-token's
    end is certain two characters behind it: one ends its run, and two tell
    ``'r`` from ``'re`` and white space from the last of it, which goes to the
    word that follows. No text is emitted in which a special token may begin.
    """

    def __init__(self, encoder: Encoder):
        self.encoder, self.table = encoder, encoder.table
        self.held = ""
        self.run: regex.Pattern | None = None     # how the pre-token in ``merger`` goes on
        self.merger = Merger(encoder)

    def feed(self, block: str, last: bool) -> list[str | int | bytes]:
        text, specials, emitted = self.held + block, self.table.specials, []
        longest = self.table.longest_special
        while specials and any(map(text.__contains__, specials)):
            found = self.table.special_pattern.search(text)
            if not last and found.start() + longest > len(text):      # a longer one may begin here
                break
            parts, _ = self._plain(text[:found.start()], found.start(), True)
            emitted += parts
            emitted.append(specials[found.group()])
            text = text[found.end():]
        sure = len(text) if last else max(0, len(text) - max(0, longest - 1))
        parts, self.held = self._plain(text, sure, last)
        return emitted + parts if emitted else parts

    def _plain(self, text: str, sure: int, ended: bool) -> tuple[list[str | int | bytes], str]:
        """What is certain of ``text``, of which ``sure`` characters hold no special token, and the rest."""
        parts: list[str | int | bytes] = []
        if self.run:
            end = stop = self.run.match(text, 0, sure).end()
            over = end < sure or ended
            if self.run is _SPACES and not (ended and end == sure):
                stop = max(0, end - 1)
            parts.append(self.merger.feed(text[:stop].encode()))
            text, sure = text[stop:], sure - stop
            if not over:
                return parts, text
            parts.append(self.merger.finish())
            self.run = None
        if ended:
            return parts + self.encoder.pieces(text) if parts else self.encoder.pieces(text), ""
        found, end, first = self.encoder.pieces(text[:sure]), sure, ""
        while found and end > sure - 2:
            first = found.pop()
            end -= len(first)
        parts += found
        if len(first) >= OPEN_CHARS:
            self.run = next(run for run in _RUNS if run.fullmatch(first[-1]))
            begun = first[:-1] if self.run is _SPACES else first
            parts.append(self.merger.feed(begun.encode()))
            end += len(begun)
        return parts, text[end:]


class Decoder:
    """Token ids to text; a partial character waits for the bytes that follow."""

    def __init__(self, table: MergeTable):
        self.token_bytes = table.token_bytes
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(map(self.token_bytes.__getitem__, ids)))

    def finish(self) -> str:
        rest = self.state.decode(b"", True)
        self.state.reset()
        return rest


def decode(table: MergeTable, ids: bytes, block: int = 1 << 16) -> str:
    """Text of packed ids, read in blocks; broken UTF-8 becomes U+FFFD."""
    decoder, numbers = Decoder(table), np.frombuffer(ids, "<u4")
    parts = [decoder.feed(numbers[i:i + block].tolist()) for i in range(0, len(numbers), block)]
    return "".join([*parts, decoder.finish()])


@lru_cache(maxsize=2)
def _encoder(source: str) -> Encoder:
    table = MergeTable(source)
    if not table.byte_level:
        raise ValueError("a byte-level BPE file without normalizer or prefix space is needed")
    return Encoder(table)


def read_tokenizer(path: str) -> str:
    """The tokenizer file's text; a few MB, sent to the tasks with the plan."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text",
                     decoded: bool = False) -> DataFrame:
    """``(key, ids)`` per row: packed little-endian unsigned 32-bit ids.

    ``tokenizer`` is the path of a byte-level BPE file. With ``decoded``, a
    column ``decoded`` holds the text that the ids decode to.
    """
    source = read_tokenizer(tokenizer)
    source_type = docs.schema[key].dataType.simpleString()
    chosen = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))

    def run(batches):
        encoder = _encoder(source)
        for part in text_slices(batches):
            ids = encoder.encode_all([t or "" for t in part.column(1).to_pylist()])
            columns = [part.column(0), pa.array(ids, pa.binary())]
            if decoded:
                columns.append(pa.array(list(map(decode, repeat(encoder.table), ids)), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["key", "ids", "decoded"][:len(columns)])

    out = map_arrow(chosen, run, f"key {source_type}, ids binary" + ", decoded string" * decoded)
    return out.withColumnRenamed("key", key)


def decode_documents(encoded: DataFrame, tokenizer: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``(key, text)`` per row of packed ids; null ids decode to the empty text."""
    source = read_tokenizer(tokenizer)
    source_type = encoded.schema[key].dataType.simpleString()

    def run(batches):
        table = _encoder(source).table
        for part in text_slices(batches, "ids"):
            texts = [decode(table, x) if x else "" for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    chosen = encoded.select(encoded[key].alias("key"), encoded[ids].alias("ids"))
    return map_arrow(chosen, run, f"key {source_type}, text string").withColumnRenamed("key", key)
