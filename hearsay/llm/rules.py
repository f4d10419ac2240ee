"""Quality rules as a bitmask ledger (operator 8), with built-in functions only.

``ledger`` measures every document once and stores the measurements with one
bit for each rule that fails. Policies are versioned masks over those bits:
``apply_policy`` keeps what fails none of a policy's rules, and ``ablation``
tells from the bits alone what each rule rejects, and rejects alone. A new
policy needs no second look at the texts.

Words are runs of characters other than space and U+0009 to U+000D. Repeated
words are found within a row: hash every window of three words, sort the hashes
with their places, and take the places whose hash equals a neighbour's.

Rows: a null or empty text has no words, so it fails ``few_words``. Very long
texts stay one row; nothing is cut. Repeated rows give repeated results. An
empty table gives an empty ledger. Input columns other than key and text are
left out of the ledger, so clashing names do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
PLACE_BITS = 12

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals"]

# Rules as SQL over the measurements, true where the rule fails. A rule's place
# is its bit, so rules are only ever added at the end.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 20 * n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 60 * n_lines"),
    ("capitals", "100 * n_capitals > 40 * word_chars"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
]


def mask(*names: str) -> int:
    place = {name: i for i, (name, _) in enumerate(RULES)}
    return sum(1 << place[name] for name in names)


@dataclass(frozen=True)
class Policy:
    version: str
    bits: int


BASE = Policy("base", mask("few_words", "repeated_words"))
POLICIES = [BASE, Policy("v1", mask(*(name for name, _ in RULES)))]
CURRENT = POLICIES[-1]


def _shifted(array: str, by: int, size: Column) -> Column:
    return F.slice(array, F.lit(by + 1), F.greatest(size, F.lit(0)))


def repeated_words(df: DataFrame, words: str, out: str) -> DataFrame:
    """Adds ``out``: words in windows of three words that occur twice or more in the row.

    Each step is a projection whose result the next one uses more than once, so
    that Spark keeps the steps apart; no lambda reads a column from outside,
    which would compute that column anew for each element.
    """
    old = df.columns
    n = F.size("_w")
    df = df.withColumn("_w", F.transform(F.col(words), lambda w: F.xxhash64(w)))
    two = F.zip_with(_shifted("_w", 0, n - 2), _shifted("_w", 1, n - 2), lambda a, b: F.xxhash64(a, b))
    df = df.select(*old, F.zip_with(two, _shifted("_w", 2, n - 2), lambda ab, c: F.xxhash64(ab, c)).alias("_h"))
    # Hash and place share a long where the places fit PLACE_BITS; else they stay a struct.
    few, none = F.size("_h") < (1 << PLACE_BITS), F.array().cast("array<bigint>")
    df = df.select(
        *old,
        F.sort_array(F.when(few, F.transform("_h", lambda h, i: h.bitwiseAND(F.lit(-1 << PLACE_BITS)).bitwiseOR(i.cast("long")))).otherwise(none)).alias("_s"),
        F.sort_array(F.transform(F.when(~few, F.col("_h")).otherwise(none), lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i")))).alias("_t"))
    place = F.lit((1 << PLACE_BITS) - 1)

    def alike(array: str, same, of) -> Column:
        """Places of neighbours in sorted order that have the same hash."""
        n = F.size(array) - 1
        pairs = _shifted(array, 0, n), _shifted(array, 1, n)
        first = F.zip_with(*pairs, lambda x, y: F.when(same(x, y), of(x)))
        return F.array_union(F.array_compact(first), F.array_compact(F.zip_with(*pairs, lambda x, y: F.when(same(x, y), of(y)))))

    df = df.select(*old, F.sort_array(F.array_union(
        alike("_s", lambda x, y: F.shiftright(x.bitwiseXOR(y), PLACE_BITS) == 0, lambda x: x.bitwiseAND(place)),
        alike("_t", lambda x, y: x["h"] == y["h"], lambda x: x["i"]))).alias("_i"))
    k = F.size("_i")
    gaps = F.zip_with(_shifted("_i", 0, k - 1), _shifted("_i", 1, k - 1), lambda x, y: F.least(F.lit(3).cast("long"), y - x))
    return df.select(*old, (F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)
                            + F.when(k > 0, 3).otherwise(0)).cast("long").alias(out))


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(key, *keep, measurements, fail_bits)``, one row per document."""
    carried = [F.col(c).alias(f"_keep{i}") for i, c in enumerate((key, *keep))]
    own = [f"_keep{i}" for i in range(len(carried))]
    df = docs.select(*carried, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"))
    space = F.lit(WHITE)
    df = df.select(
        *own,
        (F.char_length("_t") - F.char_length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.char_length(F.translate("_t", WHITE, "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.filter(F.split("_t", "\n"), lambda line: F.btrim(line, space) != "").alias("_lines"),
        F.filter(F.split("_t", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("_words"))
    df = df.select(
        *own, "n_symbols", "word_chars", "n_capitals", "_words",
        F.size("_words").cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"))
    df = repeated_words(df, "_words", "n_repeat_words").select(*own, *MEASURES)
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, rule) in enumerate(RULES)]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return df.select(*(F.col(o).alias(c) for o, c in zip(own, (key, *keep))), *MEASURES, failed.alias("fail_bits"))


def passes(policy: Policy, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(policy.bits)) == 0


def apply_policy(rows: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """The ledger with ``policy`` (its version) and ``kept``."""
    return rows.select(*rows.columns, F.lit(policy.version).alias("policy"), passes(policy).alias("kept"))


def ablation(rows: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail only it, and kept without it.

    Documents are counted by their failure bits first (at most ``2 ** rules``
    rows), so a rule's figures come from that small table.
    """
    names = [(name, 1 << i) for i, (name, _) in enumerate(RULES) if policy.bits & (1 << i)]
    by_bits = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.bits)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(bit).alias("bit")) for name, bit in names)))
    each = by_bits.select("bits", "n", rules.alias("r")).select("bits", "n", "r.*")
    has = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        F.sum(F.when(has, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("failed_alone"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0, F.col("n")).otherwise(0)).alias("kept_without"))


def keep_documents(docs: DataFrame, policy: Policy = CURRENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents a policy keeps, with their own columns."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    carried = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), row)
    rows = ledger(carried, "_key", "_text", keep=("_row",))
    # A plain filter would be pushed down through every step, each step's expression copied into the next.
    kept = rows.select(F.explode_outer(F.when(passes(policy), F.array("_row"))).alias("_row"))
    return kept.where(F.col("_row").isNotNull()).select("_row.*")
