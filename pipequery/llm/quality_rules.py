"""Quality rules as a short-circuit cascade, in DataFrame functions only.

The counts that every row needs are columns; what else a rule reads it computes from the text, where
it stands in the cascade. ``plan_cascade`` times each rule and counts what it rejects on a bounded
random sample, and orders the rules by rejections per second; ``cascade`` builds one CASE that stops
at the first rule that rejects a row, so rules behind it cost nothing there. The verdict doesn't
depend on the order, only the time it takes and the rule that ``rejected_by`` names do.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipequery.llm.common import materialize, unused

SPACES = "\x20\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
SAMPLE_ROWS = 2_000  #: rows that the costs and selectivities are estimated on, about
REPEATS = 16  #: times that a rule is evaluated on each row of the sample
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Row:
    """What a rule may read: the counts, and the text with its words and lines. All are there for every row; what a rule derives from them isn't."""

    text: Column
    words: Column
    lines: Column
    n_words: Column
    word_chars: Column
    n_symbols: Column
    n_dup_lines: Column
    n_repeat_words: Column


@dataclass(frozen=True)
class Rule:
    """``rejects(row)`` is true for rows that fail; null counts as not failing."""

    name: str
    rejects: Callable[[Row], Column]


def count_of(text: Column, chars: str) -> Column:
    """How often any of some ASCII characters occurs."""
    return sum(((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit("")))) for c in chars), F.lit(0)).cast("long")


def _measured(docs: DataFrame) -> tuple[DataFrame, Row, list[str]]:
    """``docs`` with the counts and helping columns of unused names, and what rules read of it."""
    passing = [c for c in docs.columns if c not in COUNTS]
    text_, words_, lines_, windows_, sorted_, at_ = unused(docs, "text_", "words_", "lines_", "windows_", "sorted_", "at_")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select(*(F.col(f"`{c}`") for c in passing), text.alias(text_))
    words = F.array_remove(F.split(F.col(text_), r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split(F.col(text_), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumns({words_: words, lines_: lines})
    n = F.size(words_)
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words_, i, WINDOW)))).otherwise(
        F.array().cast("array<bigint>")
    )
    df = df.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.char_length(text_).cast("long") - count_of(F.col(text_), SPACES),
            "n_symbols": count_of(F.col(text_), SYMBOLS),
            "n_dup_lines": (F.size(lines_) - F.size(F.array_distinct(lines_))).cast("long"),
            windows_: windows,
        }
    )
    # windows found twice or more, only where there are any: sorted by hash, equal ones are neighbours
    twice = F.size(F.array_distinct(windows_)) < F.size(windows_)
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    df = df.withColumn(sorted_, F.when(twice, F.array_sort(F.transform(windows_, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none))
    at = lambda i: F.get(sorted_, i)["h"]
    df = df.withColumn(at_, F.array_sort(F.transform(F.filter(sorted_, lambda x, i: x["h"].eqNullSafe(at(i - 1)) | x["h"].eqNullSafe(at(i + 1))), lambda x: x["i"])))
    covered = F.aggregate(
        at_,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(a["upto"], i)).alias("n"), (i + WINDOW).alias("upto")),
        lambda a: a["n"].cast("long"),
    )
    df = df.withColumn("n_repeat_words", covered).drop(windows_, sorted_, at_)
    return df, Row(*(F.col(c) for c in (text_, words_, lines_, *COUNTS))), [*passing, *COUNTS]


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    A null text has no words: all counts are zero. Columns of these names are replaced; all others
    pass through. Long texts need memory in proportion to their own length only. An empty table stays empty.
    """
    df, _, names = _measured(docs)
    return df.select(*(F.col(f"`{c}`") for c in names))


def base_failed(row: Row) -> Column:
    return (row.n_words < 20) | (100 * row.n_repeat_words > 30 * row.n_words)


def default_rules() -> list[Rule]:
    """Rules in whole numbers, so that any engine agrees."""
    return [
        Rule("symbols", lambda r: 100 * r.n_symbols > 25 * r.n_words),
        Rule("shouting", lambda r: 100 * count_of(r.text, "!") > 50 * r.n_words),
        Rule("repeated_lines", lambda r: (F.size(r.lines) >= 4) & (100 * r.n_dup_lines > 50 * F.size(r.lines))),
        Rule("long_words", lambda r: r.word_chars > 20 * r.n_words),
        Rule("short_words", lambda r: r.word_chars < 2 * r.n_words),
        Rule("few_distinct_words", lambda r: (r.n_words >= 30) & (r.n_words < 500) & (100 * F.size(F.array_distinct(r.words)) < 25 * r.n_words)),
    ]


def plan_cascade(docs: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> list[tuple[Rule, float, float]]:
    """``(rule, seconds, share rejected)`` ordered by rejections per second on a random sample of about ``sample_rows`` rows.

    A rule's cost is what evaluating it REPEATS times a row takes more than once, so that reading the
    sample and starting the job don't count. An empty table keeps the given order. The sample decides
    an order only, never a verdict.
    """
    share = min(1.0, sample_rows / max(1, docs.count()))
    df, row, _ = _measured(docs.select("text").sample(share, seed))
    sample = materialize(df, "rules-sample")
    rows = sample.count()
    if not rows:
        return [(r, 0.0, 0.0) for r in rules]

    def timed(condition: Column, times: int) -> tuple[float, int]:
        turns = sample.select("*", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("turn"))
        best, hits = float("inf"), 0
        for _ in range(2):  # the first compiles
            began = time.perf_counter()
            hits = turns.agg(F.count_if(condition)).first()[0]
            best = min(best, time.perf_counter() - began)
        return best, hits

    found = []
    for rule in rules:
        once, hits = timed(rule.rejects(row), 1)
        often, _ = timed(rule.rejects(row), REPEATS)
        found.append((rule, max((often - once) / (REPEATS - 1), 1e-6), hits / rows))
    return sorted(found, key=lambda x: -x[2] / x[1])


def cascade(row: Row, rules: list[Rule]) -> Column:
    """The name of the first of ``rules``, in their order, that rejects the row; null if none does. Rules after it aren't evaluated."""
    first = F.lit(None).cast("string")
    for rule in reversed(rules):
        first = F.when(rule.rejects(row), F.lit(rule.name)).otherwise(first)
    return first


def apply_rules(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS, planned: bool = True) -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``rejected_by`` and ``kept`` (not base_failed and rejected by no rule).

    ``planned``: order the rules on a sample; else they stand as given. Columns of these names are
    replaced. Repeated rows, nulls in any column and further columns pass through; an empty table stays empty.
    """
    rules = default_rules() if rules is None else rules
    if planned and len(rules) > 1:
        rules = [r for r, _, _ in plan_cascade(docs, rules, sample_rows)]
    df, row, names = _measured(docs.drop("base_failed", "rejected_by", "kept"))
    (verdict,) = unused(df, "verdict_")
    df = df.withColumn(verdict, cascade(row, [Rule("base", base_failed), *rules]))
    return df.select(
        *(F.col(f"`{c}`") for c in names), base_failed(row).alias("base_failed"), F.col(verdict).alias("rejected_by"), F.col(verdict).isNull().alias("kept")
    )
