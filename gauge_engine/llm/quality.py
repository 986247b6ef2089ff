"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Each rule is a condition that rejects a document. On a sample, every rule is timed and its
rejections are counted; rules are then tried in the order of rejections per cost, inside
one conditional expression, so a document that one rule rejects costs none of the later
ones. The order decides speed only: a document is kept if no rule rejects it.

A rule's cost is the time of its passes over the sample, less that of passes without a rule.
It counts in powers of two, so that the noise of a clock hardly moves the order.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gauge_engine.session import materialize

# The sample decides the order of the rules, never a verdict.
SAMPLE_ROWS = 1_000
# The sample is repeated up to so many characters, so that a rule outweighs its job.
TIMED_CHARS = 2_000_000
MOST_COPIES = 10_000
PASSES = 3
# Costs below so many seconds are not told apart.
LEAST_SECONDS = 1 / 64

WINDOW_WORDS = 5
_SPACE = "[\\x20\\x09-\\x0D]"
_NOT_SPACE = "[^\\x20\\x09-\\x0D]"
_SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``rejects`` makes a condition from the metrics of ``metrics``."""

    name: str
    rejects: Callable[[Mapping[str, Column]], Column]


# The first two are the base rules.
RULES = (
    Rule("few_words", lambda m: m["n_words"] < 10),
    Rule("repeated_words", lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"]),
    Rule("symbols", lambda m: 10 * m["n_symbols"] > m["n_words"]),
    Rule("repeated_lines", lambda m: 10 * m["n_dup_lines"] > 3 * m["n_lines"]),
    Rule("exclamations", lambda m: 2 * m["n_exclamations"] > m["n_words"]),
    Rule("word_length", lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 20 * m["n_words"])),
)


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def words(text: Column) -> Column:
    """Runs of anything but blank, tab, line ends and form feeds."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{_SPACE}+"), "")


def _repeat_words(found: Column) -> Column:
    """Words inside windows of ``WINDOW_WORDS`` words that the text holds twice or more.

    Windows are compared by 64-bit hashes. Only texts with an equal pair are sorted.
    """
    n = WINDOW_WORDS
    windows = F.transform(
        F.sequence(F.lit(1), F.size(found) - n + 1),
        lambda i: F.xxhash64(*[F.element_at(found, i + k) for k in range(n)]),
    )

    def covered(hashes: Column) -> Column:
        places = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def marked(ordered: Column) -> Column:
            twice = F.filter(
                F.transform(
                    ordered,
                    lambda x, i: F.when(
                        (F.get(ordered, i - 1)["h"] == x["h"]) | (F.get(ordered, i + 1)["h"] == x["h"]), x["i"]
                    ),
                ),
                lambda i: i.isNotNull(),
            )
            # A window adds what lies behind the one before it.
            start = F.struct(F.lit(-n).alias("last"), F.lit(0).alias("n"))
            return F.aggregate(
                F.array_sort(twice),
                start,
                lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(i - a["last"], F.lit(n))).alias("n")),
                lambda a: a["n"],
            )

        return F.get(F.transform(F.array(places), marked), F.lit(0))

    def count(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(covered(hashes))

    return F.when(F.size(found) <= n, 0).otherwise(F.get(F.transform(F.array(windows), count), F.lit(0)))


def metrics(text: Column, found: Column) -> dict[str, Column]:
    """The numbers that rules refer to, from a text and its words."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(_NOT_SPACE))
    numbers = {
        "n_words": F.size(found),
        "word_chars": F.length(_without(text, _SPACES)),
        "n_symbols": F.length(text) - F.length(_without(text, SYMBOLS)),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": _repeat_words(found),
        "n_exclamations": F.length(text) - F.length(_without(text, "!")),
    }
    return {name: number.cast("bigint") for name, number in numbers.items()}


# The metrics that ``judge_quality`` returns.
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _cascade(ordered: Sequence[Rule], numbers: Mapping[str, Column]) -> Column:
    """False at the first rule that rejects, else true."""
    verdict = F.when(F.lit(False), F.lit(False))
    for rule in ordered:
        verdict = verdict.when(F.coalesce(rule.rejects(numbers), F.lit(False)), False)
    return verdict.otherwise(True)


def keeps(ordered: Sequence[Rule], text_col: str = "text") -> Column:
    """False at the first rule that rejects, else true.

    The words are bound once, as the variable of a one-element transform; a metric is
    computed only if no earlier rule has rejected.
    """
    text = F.col(text_col)
    return F.get(F.transform(F.array(words(text)), lambda found: _cascade(ordered, metrics(text, found))), F.lit(0))


def _counted(rows: DataFrame) -> tuple[int, float]:
    began = time.perf_counter()
    n = rows.count()
    return n, time.perf_counter() - began


def order_rules(docs: DataFrame, rules: Sequence[Rule], text_col: str = "text") -> list[Rule]:
    """Rules by rejections per cost on a sample, highest first.

    The sample is drawn from all partitions. Of rules that reject equally per cost, cheaper ones
    come first, then the name decides.
    """
    rows = docs.count()
    if not rows or len(rules) < 2:
        return list(rules)
    texts = docs.select(F.coalesce(text_col, F.lit("")).alias("text")).sample(min(1.0, SAMPLE_ROWS / rows), seed=7)
    sample = materialize(texts.repartition(1), "rule-sample")
    chars = sample.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    copies = min(max(TIMED_CHARS // max(chars, 1), 1), MOST_COPIES)
    # Written, as a rule would otherwise be tried before the rows are repeated.
    timed = materialize(sample.select("text", F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy")), "timed-sample")
    # The first reads every text, as rules do, and does nothing else.
    plans = [timed.where(F.length("text") >= 0), *[timed.where(~keeps([rule])) for rule in rules]]
    # Turn by turn, so that all have run warm when the last turn comes.
    turns = [[_counted(plan) for plan in plans] for _ in range(PASSES)]
    empty, *took = [min(turn[i][1] for turn in turns) for i in range(len(plans))]
    place = {}
    for rule, (rejected, _), seconds in zip(rules, turns[0][1:], took):
        cost = round(math.log2(max(seconds - empty, LEAST_SECONDS)))
        place[rule.name] = -rejected / 2.0**cost, cost, rule.name
    return sorted(rules, key=lambda r: place[r.name])


def judge_quality(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """``docs`` with the metrics of ``REPORTED`` and ``kept``; clashing columns are replaced.

    Metrics that are not returned are computed inside the cascade, where a rule reads them and no
    earlier one has rejected. Null and empty texts have no words and fail the rule on few words.
    Null ids and other columns do not matter. Repeated rows get equal verdicts. An empty table
    stays empty. Very long texts are measured whole.
    """
    ordered = order_rules(docs, rules, text_col)
    text = F.col(text_col)
    numbers = metrics(text, F.col("_words"))
    measured = docs.withColumn("_words", words(text)).withColumns({c: numbers[c] for c in REPORTED})
    known = {**numbers, **{c: F.col(c) for c in REPORTED}}
    return measured.withColumn("kept", _cascade(ordered, known)).drop("_words")


def keep_quality(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their own columns."""
    return docs.where(keeps(order_rules(docs, rules, text_col), text_col))
