"""Quality rules: a threshold table compiled into one projection of text ratios.

`RULES` is data: every entry names a numerator and a denominator among the measures and the range that
their quotient must keep to. `compile_rules` turns the table into a single boolean column, so the scan, the
measures and the verdict are one stage without user functions and without a shuffle.

Defined results: a null text counts as one without words; texts of under 20 words or with too many
repeated 8-word windows fail the base test whatever the table says; a ratio whose denominator is zero is
taken as 0. Rows are independent, so repeated rows get equal verdicts, an empty table gives an empty table,
and further columns of the input are ignored by `score` and kept by `accepted`.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import packed, words

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a an and are as at be been but by for from had has have he her his i in is it its not of on or our she so than that the their they this to was we were which who will with you "
    "au aux avec ce cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour que qui sa se ses son sur un une vous "
    "als am auch auf aus bei das dass dem den der des die durch ein eine einen einer er es für hat ich ihr im ist mit nach nicht oder sich sie sind über um und von vor war werden wie wird zu zum zur "
    "al como con del el ella entre era eran es esta este fue ha hay la las lo los más muy no para pero por qué se ser sin sobre su sus también todo una uno y ya"
).split()

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
WINDOW_WORDS = 8
MAX_REPEAT_PERCENT = 30


class Rule(NamedTuple):
    name: str
    numerator: str
    denominator: str
    low: float
    high: float


#: The method's own thresholds, over the measures below; a text is kept if every quotient lies in its range.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.5, 15.0),
    Rule("symbols_per_word", "n_symbols", "n_words", 0.0, 0.2),
    Rule("stop_word_share", "n_stop_words", "n_words", 0.05, 1.0),
    Rule("duplicate_line_share", "n_dup_lines", "n_lines", 0.0, 0.5),
    Rule("bullet_line_share", "n_bullet_lines", "n_lines", 0.0, 0.9),
)


def _repeat_words(tokens: Column, window: int) -> Column:
    """Words lying in a window of `window` words that occurs twice or more in the text.

    Windows are keyed by a 64-bit hash of their words' 64-bit hashes and sorted, which puts equal ones side by
    side; the covered words are then added up over the ascending starts, each adding the part that the start
    before did not cover. Nested single-element transforms bind each array once.
    """

    def bind(value: Column, body) -> Column:
        return F.element_at(F.transform(F.array(value), body), 1)

    def starts(hashes: Column) -> Column:
        return F.sort_array(
            F.transform(
                F.sequence(F.lit(0), F.size(hashes) - F.lit(window)),
                lambda i: F.struct(F.xxhash64(*[F.get(hashes, i + k) for k in range(window)]).alias("key"), i.alias("start")),
            )
        )

    def repeated(ordered: Column) -> Column:
        same = F.filter(
            ordered,
            lambda x, i: (F.get(ordered, i - 1)["key"] == x["key"]) | (F.get(ordered, i + 1)["key"] == x["key"]),
        )
        return F.sort_array(F.transform(same, lambda x: x["start"]))

    def covered(ascending: Column) -> Column:
        zero = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("total"))
        return F.aggregate(
            ascending,
            zero,
            lambda acc, start: F.struct(start.alias("last"), (acc["total"] + F.least(F.lit(window), start - acc["last"])).alias("total")),
            lambda acc: acc["total"],
        )

    found = bind(F.transform(tokens, lambda w: F.xxhash64(w)), lambda h: bind(starts(h), lambda s: covered(repeated(s))))
    return F.when(F.size(tokens) > window, found).otherwise(F.lit(0)).cast("long")


def measures(text: Column, tokens: Column) -> dict[str, Column]:
    """The measures by name; `tokens` is the column that holds words(text)."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(tokens).cast("long"),
        "word_chars": F.length(F.array_join(tokens, "")).cast("long"),
        "n_symbols": (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_bullet_lines": F.size(F.filter(lines, lambda line: line.rlike(r"^[\x20\x09]*[-*•·]"))).cast("long"),
        "n_stop_words": F.size(F.filter(tokens, lambda w: F.lower(F.rtrim(w, F.lit(".,;:"))).isin(STOP_WORDS))).cast("long"),
        "n_repeat_words": _repeat_words(tokens, WINDOW_WORDS),
    }


def base_failed(min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def compile_rules(rules: Sequence[Rule] = RULES) -> Column:
    """One boolean column: every rule's quotient lies in its range."""
    verdict = F.lit(True)
    for rule in rules:
        top, bottom = F.col(rule.numerator).cast("double"), F.col(rule.denominator).cast("double")
        quotient = F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)
        verdict = verdict & quotient.between(rule.low, rule.high)
    return verdict


def score(docs: DataFrame, *carried: Column, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """`carried` columns of `docs`, then the measures, base_failed and kept."""
    named = [c.alias(f"carried_{i}") for i, c in enumerate(carried)]
    kept_names = [f"carried_{i}" for i in range(len(carried))]
    split = docs.select(*named, F.col(text).alias("text"), words(F.col(text)).alias("tokens"))
    # The row number keeps a later filter from being pushed below the measures, where each would be worked out anew.
    measured = split.select(*kept_names, *[c.alias(n) for n, c in measures(F.col("text"), F.col("tokens")).items()], F.monotonically_increasing_id().alias("row_no"))
    return measured.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))


def accepted(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """The rows of `docs` whose text keeps to the rules, with all their columns."""
    return score(docs, packed(docs), rules=rules, text=text).where("kept and row_no >= 0").select("carried_0.*")
