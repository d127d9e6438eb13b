"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Null text counts as empty.  Texts of under 20 words, or with over 30 % of their words in repeated 8-word windows, fail;
the others are kept if every rule of RULES holds.  Rows are judged one by one, so repeated rows and ties change nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.shared import WORD

WINDOW = 8
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Frequent function words of the languages that the corpus may hold.
STOP_WORDS = "the of and to in a is that for it as was with be by on are an this or der die und das ist zu den mit von ein eine nicht sich auf für im dem des le la les de et un une que qui dans en pour est sur pas du au el los las y es por con para una del se al".split()


@dataclass(frozen=True)
class Rule:
    """``least <= measure <= most``; an open end is None."""

    measure: str
    least: float | None
    most: float | None


#: Measures are SQL over the columns that ``measured`` makes.
RULES = (
    Rule("n_words", 20, 1_000_000),
    Rule("word_chars / n_words", 2.0, 12.0),
    Rule("n_symbols / n_words", None, 0.15),
    Rule("n_dup_lines / greatest(n_lines, 1)", None, 0.5),
    Rule("n_upper / greatest(n_letters, 1)", None, 0.3),
    Rule("n_stop_words / n_words", 0.05, None),
    Rule("n_letters / greatest(word_chars, 1)", 0.6, None),
)


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated_words(words: Column) -> Column:
    """How many words lie in windows of 8 words that are found twice or more.

    The windows' hashes tell whether any repeats; only then are the windows themselves sorted, and the starts of the
    repeated ones turned into covered words.
    """
    starts = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda x, i: F.when(i == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), x - F.get(at, i - 1))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def exactly(_: Column) -> Column:
        windows = F.array_sort(F.transform(starts, lambda i: F.struct(F.array_join(F.slice(words, i, WINDOW), " ").alias("w"), i.alias("i"))))
        twice = lambda s: F.array_sort(F.transform(F.filter(F.transform(s, lambda x, j: F.struct(x["i"].alias("i"), (x["w"].eqNullSafe(F.get(s, j - 1)["w"]) | x["w"].eqNullSafe(F.get(s, j + 1)["w"])).alias("t"))), lambda x: x["t"]), lambda x: x["i"]))
        return bound(bound(windows, twice), covered)

    def checked(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(exactly(hashes))

    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(F.size(words) < 2 * 1 + WINDOW - 1, F.lit(0)).otherwise(bound(hashes, checked))


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the counts that the rules use."""
    text = F.coalesce(F.col("text"), F.lit(""))
    without = lambda chars: F.length("_t") - F.length(F.translate("_t", chars, ""))
    by_words = bound(F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("r"), F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("s")))
    lines = bound(F.filter(F.split("_t", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0), lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")))
    counted = docs.select("doc_id", text.alias("_t")).select("doc_id", "_t", by_words.alias("_w"), lines.alias("_l"))
    return counted.select(
        "doc_id",
        F.col("_w.n").alias("n_words"),
        F.length(F.translate("_t", SPACES, "")).cast("long").alias("word_chars"),
        without(SYMBOLS).cast("long").alias("n_symbols"),
        F.col("_l.d").alias("n_dup_lines"),
        F.col("_w.r").alias("n_repeat_words"),
        F.col("_l.n").alias("n_lines"),
        F.col("_w.s").alias("n_stop_words"),
        F.regexp_count("_t", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("_t", F.lit(r"\p{L}")).cast("long").alias("n_letters"),
    )


def verdict(rules=RULES) -> Column:
    kept = F.lit(True)
    for r in rules:
        value = F.expr(r.measure)
        kept = kept & (value >= r.least if r.least is not None else F.lit(True)) & (value <= r.most if r.most is not None else F.lit(True))
    return F.coalesce(kept, F.lit(False))


def judge(docs: DataFrame, rules=RULES) -> DataFrame:
    """The counts, ``base_failed`` and ``kept`` for every row of ``doc_id, text``; other columns aren't carried."""
    failed = F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    kept = F.when(failed, F.lit(False)).otherwise(verdict(rules))
    return measured(docs).select(*base, failed.alias("base_failed"), kept.alias("kept"), "n_lines", "n_stop_words", "n_upper", "n_letters")
