"""Quality rules: base counts of every text, then a short-circuit cascade of rules.

The cascade rejects a document at the first rule it breaks, so the order changes the cost and
never the verdict.  The order comes from a sample: each rule is timed on it alone and its share
of rejected rows is counted, and rules run by falling rejection per cost.  All of it is built-in
functions; a ``CASE`` does not compute the rules behind the one that rejects.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import WHITE_SPACE, column, let, positions, stage, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Rows, about, on which cost and selectivity are estimated.  The order alone depends on them.
SAMPLE_ROWS = 2_000


@dataclass(frozen=True)
class Rule:
    """A document is rejected where ``broken`` holds; it may use the base counts and the text."""

    name: str
    broken: Column


def default_rules(text: Column) -> list[Rule]:
    text = F.coalesce(text, F.lit(""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    capitals = F.length(F.regexp_replace(text, r"[^\p{Lu}]+", ""))
    stutters = let(
        words(text, WHITE_SPACE),
        lambda w: F.size(F.filter(w, lambda x, i: F.coalesce(F.get(w, i + 1) == x, F.lit(False)))),
    )
    n, chars = F.col("n_words"), F.col("word_chars")
    return [
        Rule("symbols", 10 * F.col("n_symbols") > n),
        Rule("repeated lines", 2 * F.col("n_dup_lines") > F.col("n_lines")),
        Rule("word length", (chars < 2 * n) | (chars > 15 * n)),
        Rule("few letters", 2 * letters < chars),
        Rule("shouting", 2 * capitals > letters),
        Rule("stutter", 3 * stutters > n),
    ]


def base_counts(text: Column) -> dict[str, Column]:
    """Counts that need one pass; ``w`` is the array of words."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size("w").cast("long"),
        "word_chars": F.length(F.array_join("w", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_lines": let(lines, lambda x: F.size(x)).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(F.col("w"), WINDOW).cast("long"),
    }


def repeated_words(w: Column, window: int) -> Column:
    """Words inside windows of ``window`` words that stand twice or more in ``w``.

    Most texts repeat none, which counting distinct windows shows; only the others sort theirs.
    """

    def places(h: Column) -> Column:
        """Sorted starts of the windows that have a twin."""
        pairs = F.sort_array(
            F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        )
        twins = let(
            pairs,
            lambda s: F.filter(
                s,
                lambda e, i: F.coalesce(F.get(s, i - 1)["h"] == e["h"], F.lit(False))
                | F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False)),
            ),
        )
        return F.sort_array(F.transform(twins, lambda e: e["i"]))

    def covered(at: Column) -> Column:
        steps = F.transform(
            at, lambda p, i: F.least(F.lit(window), F.coalesce(F.get(at, i + 1) - p, F.lit(window)))
        )
        return F.aggregate(steps, F.lit(0), lambda n, x: n + x)

    hashes = let(
        F.transform(w, lambda x: F.xxhash64(x)),
        lambda v: F.transform(
            positions(F.size(v) - window + 1),
            lambda i: F.xxhash64(*[F.get(v, i + j) for j in range(window)]),
        ),
    )
    return let(
        hashes,
        lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), let(places(h), covered)).otherwise(
            F.lit(0)
        ),
    )


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, the text, the base counts and ``base_failed``."""
    counted = docs.select(
        column(id_col).alias("doc_id"),
        column(text_col).alias("_text"),
        words(column(text_col), WHITE_SPACE).alias("w"),
    ).withColumns(base_counts(F.col("_text")))
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    return counted.drop("w").withColumn("base_failed", failed)


def ordered_by_gain(sample: DataFrame, rules: list[Rule]) -> list[Rule]:
    """Rules by falling share of rejected rows per second on ``sample``; ties by name."""
    rows = max(sample.count(), 1)
    gains = []
    for rule in rules:
        start = time.perf_counter()
        rejected = sample.agg(F.count_if(rule.broken)).first()[0]
        gains.append((-(rejected / rows) / (time.perf_counter() - start), rule.name, rule))
    return [rule for _, _, rule in sorted(gains, key=lambda g: g[:2])]


def cascade(rules: list[Rule]) -> Column:
    """Number (from 1) of the first broken rule, else null; later rules are not computed."""
    first = F
    for i, rule in enumerate(rules, 1):
        first = first.when(rule.broken, F.lit(i))
    return first.otherwise(F.lit(None)) if rules else F.lit(None).cast("int")


def apply_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: list[Rule] | None = None,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_lines, base_failed, kept.

    Null and empty texts have no words and fail the base.  Rows are judged one by one, so
    repeated rows, null ids and further columns change nothing; an empty table gives no rows.
    """
    rules = default_rules(F.col("_text")) if rules is None else rules
    rows = docs.count()
    share = min(1.0, sample_rows / max(rows, 1))
    sample = docs.sample(fraction=share, seed=7) if share < 1 else docs
    passed = measured(sample, id_col, text_col).where(~F.col("base_failed"))
    order = ordered_by_gain(stage(passed, "rule-sample"), rules)
    whole = measured(docs, id_col, text_col)
    return whole.withColumn(
        "kept",
        F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(order).isNull()),
    ).drop("_text")
