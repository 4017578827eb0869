"""Quality rules as a short-circuit cascade.

Text figures are column expressions.  The further rules are judged one after
the other, and a document that one rejects is not looked at by the next.  Their
order comes from a bounded sample of rows (``sample_rows``): each rule's cost is
the time that the sample takes, its selectivity the share that it rejects, and
rules with more rejections per cost come first.  The order changes the work,
never a verdict.

Defined results: a null text counts as empty; it has no words and fails.
Repeated rows are judged alike; an empty table gives no rows; other columns
stay, and a column named like a figure is replaced.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialize

_SPACE = r"[\x20\x09-\x0D]+"
_WINDOW = 5
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` sees ``value`` computed once, also inside further lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def _repeated(words: Column) -> Column:
    """Words inside windows of five words that the text has twice or more."""

    def hashed(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - _WINDOW), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(_WINDOW))))

    def covered(at: Column) -> Column:
        """at: first words of repeated windows, ascending."""
        return _total(F.transform(at, lambda p, k: F.least(F.lit(_WINDOW), p - F.coalesce(F.get(at, k - 1), p - _WINDOW)).cast("long")))

    def neighbours(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: F.coalesce(x["h"] == F.get(s, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False)))
        return _let(F.sort_array(F.transform(twice, lambda x: x["i"])), covered)

    def counted(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(_let(pairs, neighbours))

    long_enough = F.size(words) >= _WINDOW
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(long_enough, _let(_let(hashes, hashed), counted)).otherwise(F.lit(0).cast("long"))


def with_figures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the figures, and ``_text`` and ``_lines`` for further rules."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = text
    for space in (" ", "\t", "\n", "\x0b", "\x0c", "\r"):
        bare = F.replace(bare, F.lit(space), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumn("_words", F.array_remove(F.split(text, _SPACE, -1), "")).withColumn("_lines", lines)
    out = out.withColumn("n_words", F.size("_words").cast("long")).withColumn("word_chars", F.char_length(bare).cast("long")).withColumn("n_symbols", F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"))
    out = out.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).withColumn("n_repeat_words", _repeated(F.col("_words")))
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    return out.withColumn("base_failed", failed).withColumn("_n_lines", F.size("_lines")).withColumn("_text", text).drop("_words", "_lines")


@dataclass(frozen=True)
class QualityRule:
    name: str
    rejects: Column


def default_rules() -> list[QualityRule]:
    """Rules over the figures and ``_text``; none rejects ordinary prose of any language."""
    count = lambda pattern: F.regexp_count(F.col("_text"), F.lit(pattern))
    words = F.col("n_words")
    return [
        QualityRule("upper_case", count(r"\p{Lu}") * 2 > count(r"\p{L}")),
        QualityRule("exclamations", count("!") * 4 > words),
        QualityRule("symbols", F.col("n_symbols") * 5 > words),
        QualityRule("word_length", (F.col("word_chars") > words * 20) | (F.col("word_chars") < words * 2)),
        QualityRule("few_letters", count(r"[\p{L}\p{M}]") * 2 < F.col("word_chars")),
        QualityRule("repeated_lines", F.col("n_dup_lines") * 10 > F.col("_n_lines") * 6),
    ]


def measured_order(docs: DataFrame, rules: list[QualityRule], *, text_col: str, sample_rows: int, seed: int) -> list[QualityRule]:
    """Rules by rejection per cost, as measured on a sample of about ``sample_rows`` rows."""
    n = docs.count()
    if not n:
        return rules
    chosen = docs.select(text_col) if n <= sample_rows else docs.select(text_col).sample(fraction=sample_rows / n, seed=seed)
    sample = materialize(with_figures(chosen, text_col).where("not base_failed").drop(text_col), "quality-sample")
    size = max(1, sample.count())
    gain = {}
    for rule in rules:
        began = time.perf_counter()
        rejected = sample.agg(F.count_if(rule.rejects)).first()[0]
        gain[rule.name] = (rejected / size) / (time.perf_counter() - began)
    return sorted(rules, key=lambda r: -gain[r.name])


def judge(docs: DataFrame, *, text_col: str = "text", rules: list[QualityRule] | None = None, sample_rows: int = 2000, seed: int = 17) -> DataFrame:
    """``docs`` with the figures, base_failed and kept."""
    rules = measured_order(docs, default_rules() if rules is None else rules, text_col=text_col, sample_rows=sample_rows, seed=seed)
    verdict = F.lit(True)
    for rule in reversed(rules):
        verdict = F.when(F.coalesce(rule.rejects, F.lit(False)), False).otherwise(verdict)
    out = with_figures(docs, text_col).withColumn("kept", F.when(F.col("base_failed"), False).otherwise(verdict))
    return out.drop("_text", "_n_lines")
