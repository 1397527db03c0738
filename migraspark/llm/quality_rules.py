"""Quality rules: a table of thresholds compiled into one projection of native expressions."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from migraspark.llm.common import SPACES, let, words_of

WINDOW = 8

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the be to of and that have with in is was for on it as by this are from at or an "
    "der die das und ist nicht mit von den zu ein eine für auf im des dem sie es "
    "le la les de et un une du en que qui dans pour sur au par est pas "
    "el los las y una por con para su se no lo del"
).split()


class Rule(NamedTuple):
    """A measure (SQL over the measured columns) that must lie within both bounds."""

    name: str
    measure: str
    low: float | None
    high: float | None


RULES = (
    Rule("word_length", "word_chars / n_words", 2.0, 14.0),
    Rule("symbol_ratio", "n_symbols / n_words", None, 0.1),
    Rule("stop_word_ratio", "n_stop_words / n_words", 0.05, None),
    Rule("capitals_ratio", "n_capital_words / n_words", None, 0.3),
    Rule("echo_ratio", "n_echo_words / n_words", None, 0.2),
    Rule("dup_line_ratio", "n_dup_lines / greatest(n_lines, 1)", None, 0.5),
    Rule("bullet_line_ratio", "n_bullet_lines / greatest(n_lines, 1)", None, 0.9),
    Rule("ellipsis_line_ratio", "n_ellipsis_lines / greatest(n_lines, 1)", None, 0.3),
)


def _repeated_words(words: Column) -> Column:
    """Words inside windows that occur more than once, by 64-bit hashes of the windows."""
    windows = let(
        words,
        lambda w: F.when(
            F.size(w) >= WINDOW,
            F.transform(
                F.sequence(F.lit(0), F.size(w) - WINDOW),
                lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(
            F.transform(hashes, lambda h, i: F.struct(h.alias("hash"), i.alias("at")))
        )
        repeated = let(
            ordered,
            lambda s: F.filter(
                s,
                lambda x, i: F.coalesce(
                    (F.get(s, i - 1)["hash"] == x["hash"]) | (F.get(s, i + 1)["hash"] == x["hash"]),
                    F.get(s, i - 1)["hash"] == x["hash"],
                    F.get(s, i + 1)["hash"] == x["hash"],
                    F.lit(False),
                ),
            ),
        )
        places = F.sort_array(F.transform(repeated, lambda x: x["at"]))
        return F.aggregate(
            places,
            F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("total")),
            lambda a, at: F.struct(
                at.alias("last"), (a["total"] + F.least(F.lit(WINDOW), at - a["last"])).alias("total")
            ),
            lambda a: a["total"],
        )

    return let(
        windows,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
            covered(h)
        ),
    )


def measured(docs: DataFrame, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """doc_id and the counts the rules speak of; a NULL text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    word = f"[^{SPACES}]"
    parts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text.alias("text"),
        words_of(text).alias("words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(word)).alias("lines"),
    )
    return parts.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.regexp_replace("text", "[#*$%&|<>]", "")))
        .cast("long")
        .alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(*stop_words)))
        .cast("long")
        .alias("n_stop_words"),
        F.size(F.filter("words", lambda w: (F.upper(w) == w) & (F.lower(w) != w) & (F.char_length(w) > 1)))
        .cast("long")
        .alias("n_capital_words"),
        F.size(F.filter("words", lambda w, i: w == F.get(F.col("words"), i - 1)))
        .cast("long")
        .alias("n_echo_words"),
        F.size(F.filter("lines", lambda x: x.rlike(f"^[{SPACES}]*[-*•]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(f"(\\.\\.\\.|…)[{SPACES}]*$")))
        .cast("long")
        .alias("n_ellipsis_lines"),
    )


def compiled(rules: Sequence[Rule] = RULES) -> Column:
    """Whether all rules hold, as one expression; texts without words meet none of them."""
    checks = [F.expr("n_words > 0")]
    for rule in rules:
        value = F.expr(f"{rule.measure.replace('n_words', 'greatest(n_words, 1)')}")
        if rule.low is not None:
            checks.append(value >= rule.low)
        if rule.high is not None:
            checks.append(value <= rule.high)
    passed = checks[0]
    for check in checks[1:]:
        passed = passed & check
    return passed


def quality_rules(
    docs: DataFrame, rules: Sequence[Rule] = RULES, stop_words: Sequence[str] = STOP_WORDS
) -> DataFrame:
    """The counts of every row of ``docs`` (doc_id, text), base_failed and kept.

    A NULL, empty or blank text has no words, fails the base rule and is not kept. Every row is
    judged alone, so repeated rows and ids give repeated results; other columns are ignored; an
    empty table gives an empty result. There is no shuffle. Repeated windows are found by 64-bit
    hashes within one text.
    """
    base = F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")
    return (
        measured(docs, stop_words)
        .withColumn("base_failed", base)
        .withColumn("kept", ~F.col("base_failed") & compiled(rules))
    )
