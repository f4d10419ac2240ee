"""Chat formatting with Spark expressions only (operator 13).

A conversation is the rows of one key, ordered by turn, then role, then text.

1. Its turns are collected as structs and sorted.
2. Adjacent turns of one role become one block: array functions find where the
   role changes and gather the texts between.
3. Blocks are written by concatenation. A block is ``### <role>:``, a line feed,
   and each of its texts followed by ``</turn>`` and a line feed, so a merged
   block still shows where each text ends.

Texts and roles are escaped: a backslash becomes ``\\s``, ``###`` ``\\h`` and
``</turn>`` ``\\t``; in roles a colon becomes ``\\c``. No control string is left in
them, each backslash opens one of these codes, and so ``read_turns`` gets back
every role and text exactly.

``pieces`` cuts the same output where the loss begins and ends: the loss covers
the texts of one role, nothing else. Joined, the pieces are ``formatted``.

Rows: a null text or role counts as empty. Null turns come first. Repeated rows
are turns of their own, and ties change no result. Rows with a null key are
together one conversation. Very long texts are whole. An empty table gives an
empty result. Other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, HEAD_END, END = "### ", ":\n", "</turn>\n"
LOSS_ROLE = "assistant"
# What is escaped, in this order; read back in the opposite order.
CODES = (("\\", "\\s"), ("###", "\\h"), ("</turn>", "\\t"))
ROLE_CODES = (*CODES, (":", "\\c"))


def escape(text: Column, codes=CODES) -> Column:
    for plain, code in codes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, codes=CODES) -> Column:
    for plain, code in reversed(codes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def joined(texts: Column) -> Column:
    return F.array_join(texts, "")


def merged_turns(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """``(_key, n_turns, blocks)``: the blocks of each conversation, ``(role, texts)`` each."""
    said = rows.select(rows[key].alias("_key"), F.struct(
        rows[turn].alias("turn"),
        F.coalesce(rows[role].cast("string"), F.lit("")).alias("role"),
        F.coalesce(rows[text].cast("string"), F.lit("")).alias("text")).alias("said"))
    turns = said.groupBy("_key").agg(F.sort_array(F.collect_list("said")).alias("turns"))
    # Each turn beside the role before it; the first has none before.
    roles = turns.select("_key", "turns", F.transform("turns", lambda t: t["role"]).alias("roles"))
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice("roles", 1, F.size("roles") - 1))
    changes = F.zip_with("roles", before, lambda now, last: ~now.eqNullSafe(last))
    first = F.filter(F.transform(changes, lambda new, i: F.when(new, i)), lambda i: i.isNotNull())
    runs = roles.select("_key", "turns", first.alias("first"))
    ends = F.concat(F.slice("first", 2, F.size("first")), F.array(F.size("turns")))
    bounds = F.zip_with("first", ends, lambda i, j: F.struct(i.alias("i"), j.alias("j")))
    blocks = F.transform(bounds, lambda b: F.struct(
        F.get("turns", b["i"])["role"].alias("role"),
        F.transform(F.slice("turns", b["i"] + 1, b["j"] - b["i"]), lambda t: t["text"]).alias("texts")))
    return runs.select("_key", F.size("turns").cast("long").alias("n_turns"), blocks.alias("blocks"))


def format_conversations(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text", loss_role: str = LOSS_ROLE) -> DataFrame:
    """``(key, n_turns, formatted, pieces)`` per conversation, ``pieces`` being ``(text, loss)`` each."""
    def piece(value, loss):
        return F.struct(value.alias("text"), loss.alias("loss"))

    def block_pieces(b):
        head = F.array(piece(F.concat(F.lit(HEAD), escape(b["role"], ROLE_CODES), F.lit(HEAD_END)), F.lit(False)))
        texts = F.flatten(F.transform(b["texts"], lambda t: F.array(
            piece(escape(t), b["role"] == loss_role), piece(F.lit(END), F.lit(False)))))
        return F.concat(head, texts)

    blocks = merged_turns(rows, key, turn, role, text)
    pieces = blocks.select("_key", "n_turns", F.flatten(F.transform("blocks", block_pieces)).alias("pieces"))
    return pieces.select(F.col("_key").alias(key), "n_turns",
                         joined(F.transform("pieces", lambda p: p["text"])).alias("formatted"), "pieces")


def read_turns(formatted: Column | str) -> Column:
    """The turns of a formatted conversation, ``array<struct<role, text>>``, as they came in."""
    def of_block(block):
        head = F.substring_index(block, HEAD_END, 1)
        body = F.substring(block, F.char_length(head) + F.lit(len(HEAD_END) + 1), F.char_length(block))
        texts = F.split(body, END)
        # The last text ends with the mark, too: nothing follows it.
        return F.transform(F.slice(texts, 1, F.size(texts) - 1), lambda t: F.struct(
            unescape(head, ROLE_CODES).alias("role"), unescape(t).alias("text")))

    blocks = F.split(formatted, HEAD)
    return F.flatten(F.transform(F.slice(blocks, 2, F.size(blocks)), of_block))


def loss_text(pieces: Column | str) -> Column:
    """All text under the loss, unescaped, nothing between."""
    return unescape(joined(F.transform(F.filter(pieces, lambda p: p["loss"]), lambda p: p["text"])))
