"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per document; the ledger stores its measurements and one failure
bit per rule.  A policy is a versioned bit mask over the rules, so policies are applied, and
what each rule contributes is computed, from the ledger alone by bitwise operations.

Words are ``[^\\x20\\x09-\\x0D]+``; a null text has no words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Rules in bit order: name and failure condition over the measurements.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 40 * n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 60 * n_lines"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    ("exclamations", "100 * n_exclaims > 60 * n_words"),
)
#: Policies by version: the rules that drop a document.
POLICIES = {
    "v1": ("few_words", "repeated_windows"),
    "v2": ("few_words", "repeated_windows", "symbols", "duplicate_lines", "word_length", "exclamations"),
}
BASE, CURRENT = "v1", "v2"


def mask(policy: str, without: str | None = None) -> int:
    """The bits of a policy's rules."""
    return sum(1 << k for k, (name, _) in enumerate(RULES) if name in POLICIES[policy] and name != without)


def _without(text: Column, characters: str) -> Column:
    return F.char_length(F.translate(text, characters, ""))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and the measurements of each row, one row per row.

    ``n_repeat_words`` are the words inside 3-word windows that occur twice or more in the
    text: equal windows have equal hashes, sorting brings them together, and the union of the
    windows' positions is counted.  Texts without a repeated window skip the sort.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    first = docs.select(id_col, text.alias("t"), F.btrim(text, F.lit(WHITE)).alias("inner"))
    words = F.when(F.col("inner") != "", F.split("inner", "[\\x20\\x09-\\x0D]+")).otherwise(F.array().cast("array<string>"))
    lines = F.filter(F.split("t", "\n"), lambda line: F.btrim(line, F.lit(WHITE)) != "")
    second = first.select(
        id_col,
        _without(F.col("t"), WHITE).cast("bigint").alias("word_chars"),
        (F.char_length("t") - _without(F.col("t"), SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.char_length("t") - _without(F.col("t"), "!")).cast("bigint").alias("n_exclaims"),
        words.alias("words"), lines.alias("lines"),
    )
    third = second.select(
        id_col, "word_chars", "n_symbols", "n_exclaims",
        F.size("words").cast("bigint").alias("n_words"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.expr("if(size(words) < 3, cast(array() as array<bigint>), transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])))").alias("windows"),
    )
    fourth = third.withColumn(
        "ordered",
        F.expr("if(size(array_distinct(windows)) < size(windows), array_sort(transform(windows, (h, i) -> struct(h, i))), null)"),
    ).drop("windows")
    fifth = fourth.withColumn(
        "at",
        F.expr(
            "sort_array(transform(filter(ordered, (x, k) -> coalesce(get(ordered, k - 1).h = x.h, false) or coalesce(get(ordered, k + 1).h = x.h, false)), x -> x.i))"
        ),
    ).drop("ordered")
    covered = F.expr("coalesce(aggregate(transform(at, (p, k) -> least(3, coalesce(get(at, k + 1) - p, 3))), 0, (a, b) -> a + b), 0)")
    return fifth.withColumn("n_repeat_words", covered.cast("bigint")).drop("at")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements and ``failed``, an integer with bit k set where rule k fails."""
    bits = sum((F.expr(f"if({rule}, {1 << k}, 0)") for k, (_, rule) in enumerate(RULES)), F.lit(0))
    return measure(docs, id_col, text_col).withColumn("failed", bits)


def passes(policy: str, failed: Column | str = "failed") -> Column:
    """Whether a ledger row passes a policy."""
    return F.col(failed).bitwiseAND(F.lit(mask(policy))) == 0 if isinstance(failed, str) else failed.bitwiseAND(F.lit(mask(policy))) == 0


def ablation(book: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For each rule of a policy: documents failing it, failing it alone, and kept without it.

    The ledger is reduced to one count per distinct bit pattern first (at most 64 rows).
    """
    patterns = book.groupBy(F.col("failed").bitwiseAND(F.lit(mask(policy))).alias("bits")).agg(F.count("*").alias("n"))
    rules = book.sparkSession.createDataFrame(
        [(name, 1 << k, mask(policy, without=name)) for k, (name, _) in enumerate(RULES) if name in POLICIES[policy]],
        "rule string, bit int, rest int",
    )
    def count(condition: str) -> Column:
        return F.coalesce(F.sum(F.expr(f"if({condition}, n, 0)")), F.lit(0))

    return rules.join(F.broadcast(patterns), F.lit(True), "left").groupBy("rule").agg(
        count("(bits & bit) <> 0").alias("failing"), count("bits = bit").alias("alone"), count("(bits & rest) = 0").alias("kept_without"),
    )
