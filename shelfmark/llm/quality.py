"""Quality rules: a decision list learned from labelled text statistics.

Sequential covering: a rule is grown on two thirds of the labelled rows, adding at each step the threshold test with
the highest information gain, then pruned on the other third by dropping tests from its end. Rows that a rule covers
leave, and the next rule is grown, until rules no longer pay on the rows held back. The list is emitted as one ordered
Spark conditional expression over the statistics, so it can be read, stored and applied without Python.

Statistics are counted over whole texts. Null texts are empty; a row with a null or unknown label teaches nothing.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.llm.common import free_name, hash_sample, map_columns, texts_of

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
SAMPLE = 20_000

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Statistics that rules may test.
STATISTICS = [
    "words", "word_length", "symbol_share", "bar_share", "exclamation_share", "upper_share", "digit_share",
    "stop_share", "duplicate_lines", "repeat_share", "distinct_share", "long_line_share",
]
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20


def repeated_words(words: Sequence[bytes]) -> int:
    """Words inside 5-word windows that occur twice or more in the text, each word counted once."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[k:] for k in range(WINDOW)), strict=False))
    seen = Counter(windows)
    if len(seen) == n:
        return 0
    total, covered = 0, -1
    for at, window in enumerate(windows):
        if seen[window] > 1:
            total += at + WINDOW - 1 - max(covered, at - 1)
            covered = at + WINDOW - 1
    return total


def statistics(text: str) -> tuple:
    """Counts and shares of one text, in the order of ``COUNTS`` and ``STATISTICS``. Words end at ASCII white space."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n_words, n_chars = len(words), len(text)
    word_chars = n_chars - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    seen: set[str] = set()
    duplicates = lines = 0
    for line in text.split("\n"):
        if line.encode("utf-8", "surrogatepass").split():
            lines += 1
            duplicates += line in seen
            seen.add(line)
    repeats = repeated_words(words)
    some, letters = max(1, n_words), max(1, word_chars)
    upper = len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(data) - len(data.translate(None, b"0123456789"))
    distinct = set(words)
    short = sum(len(w) <= 3 for w in words)
    return (
        n_words, word_chars, symbols, duplicates, repeats,
        float(n_words), word_chars / some, symbols / some, data.count(b"|") / some, data.count(b"!") / some,
        upper / letters, digits / letters, short / some, duplicates / max(1, lines), repeats / some,
        len(distinct) / some, n_words / max(1, lines) / some,
    )


_KIND = f"struct<{', '.join([f'{c}: bigint' for c in COUNTS] + [f'{c}: double' for c in STATISTICS])}>"


def measure(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a struct column ``name`` of all counts and statistics of ``text``; other columns are carried."""

    def work(texts: pa.Array) -> tuple:
        rows = [statistics(t) for t in texts_of(texts)]
        columns = list(zip(*rows, strict=True)) or [()] * (len(COUNTS) + len(STATISTICS))
        kinds = [pa.int64()] * len(COUNTS) + [pa.float64()] * len(STATISTICS)
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        return (pa.StructArray.from_arrays(arrays, COUNTS + STATISTICS),)

    whole = free_name(docs, "whole_text")
    return map_columns(docs.withColumn(whole, F.col("text")), work, f"`{name}` {_KIND}", carry=docs.columns)


@dataclass(frozen=True)
class Test:
    name: str
    above: bool
    threshold: float

    def column(self, of: Column) -> Column:
        value = of.getField(self.name)
        return value > self.threshold if self.above else value <= self.threshold

    def covers(self, table: np.ndarray) -> np.ndarray:
        values = table[:, STATISTICS.index(self.name)]
        return values > self.threshold if self.above else values <= self.threshold

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Test, ...]


def covered(rule: Rule, table: np.ndarray) -> np.ndarray:
    out = np.ones(len(table), bool)
    for test in rule:
        out &= test.covers(table)
    return out


def best_test(table: np.ndarray, bad: np.ndarray) -> tuple[float, Test | None]:
    """The threshold test with the highest gain: bad rows kept times the rise of their log share."""
    p0, n0 = int(bad.sum()), int((~bad).sum())
    if not p0 or not n0:
        return 0.0, None
    base = math.log2(p0 / (p0 + n0))
    best: tuple[float, Test | None] = (0.0, None)
    for k, name in enumerate(STATISTICS):
        order = np.argsort(table[:, k], kind="stable")
        values, flags = table[order, k], bad[order]
        cuts = np.flatnonzero(values[1:] > values[:-1])
        if not len(cuts):
            continue
        below = np.cumsum(flags)[cuts]
        size = cuts + 1
        for above, p, total in ((False, below, size), (True, p0 - below, len(values) - size)):
            gain = p * (np.log2(np.maximum(p, 1e-9) / total) - base)
            i = int(np.argmax(gain))
            if gain[i] > best[0] + 1e-9:
                low, high = values[cuts[i]], values[cuts[i] + 1]
                best = float(gain[i]), Test(name, above, float(low + (high - low) / 2))
    return best


def grow(table: np.ndarray, bad: np.ndarray) -> Rule:
    rule: Rule = ()
    while True:
        inside = covered(rule, table)
        gain, test = best_test(table[inside], bad[inside])
        if test is None or len(rule) >= 6:
            return rule
        rule = (*rule, test)


def worth(rule: Rule, table: np.ndarray, bad: np.ndarray) -> float:
    """Bad minus twice the good rows covered, as a share: rejecting a clean text costs more than keeping a bad one."""
    inside = covered(rule, table)
    p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
    return (p - 2 * n) / (p + n) if p + n else -1.0


def learn(table: np.ndarray, bad: np.ndarray, least_worth: float = 0.9, least_rows: int = 3) -> list[Rule]:
    """The decision list: rules whose rows are bad. A row that none covers is good.

    ``table`` has the columns of ``STATISTICS``. Every third row is held back for pruning.
    """
    rules: list[Rule] = []
    held = np.arange(len(table)) % 3 == 2
    left, open_rows = np.ones(len(table), bool), np.ones(len(table), bool)
    while (bad & left & open_rows & ~held).sum() >= least_rows:
        train, prune = left & open_rows & ~held, left & held
        grown = grow(table[train], bad[train])
        # Pruning: the prefix that does best on the rows held back, the shorter among equals. The whole sample must
        # agree that it leaves good rows alone.
        fair = [
            (worth(rule, table[prune], bad[prune]), -len(rule), rule)
            for rule in (grown[:k] for k in range(1, len(grown) + 1))
            if (covered(rule, table) & left & bad).sum() >= least_rows and worth(rule, table[left], bad[left]) >= least_worth
        ]
        if fair:
            rule = max(fair, key=lambda f: f[:2])[2]
            rules.append(rule)
            left &= ~covered(rule, table)
            open_rows[:] = True
        else:  # rows that no fair rule describes are set aside while the others are grown
            open_rows &= ~(covered(grown, table) & bad)
            if not grown:
                break
    return rules


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Learn rules from at most ``sample`` labelled documents, picked by a hash of the id.

    The statistics of that sample, a few numbers per row, are what the driver sees. A document with contradicting
    labels counts as good. Without labels of both kinds there are no rules.
    """
    name = free_name(docs, "stats")
    marked = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("q"))
    picked = hash_sample(marked, sample, "doc_id")
    rows = measure(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"), name).select(
        "doc_id", "q", *[F.col(name).getField(s).alias(s) for s in STATISTICS]).toPandas()
    rows = rows.sort_values(["doc_id", *STATISTICS], kind="stable").reset_index(drop=True)
    # Documents in order of id alternate between growing and pruning, the same in every run.
    return learn(rows[STATISTICS].to_numpy(float), (rows["q"] == 0).to_numpy())


def expression(rules: Sequence[Rule], of: Column) -> Column:
    """Ordered conditional expression: number of the first rule that covers the row, from 1; 0 for none."""
    out: Column | None = None
    for number, rule in enumerate(rules, 1):
        test = F.lit(True)
        for t in rule:
            test = test & t.column(of)
        out = F.when(test, number) if out is None else out.when(test, number)
    return F.lit(0) if out is None else out.otherwise(0)


def base_failed(of: Column) -> Column:
    return (of.getField("n_words") < MIN_WORDS) | (
        100 * of.getField("n_repeat_words") > MAX_REPEAT_PERCENT * of.getField("n_words"))


def judge(docs: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, str, Column, Column]:
    """Measured documents, the name of their struct, and the columns "fails the base tests" and "first rule"."""
    name = free_name(docs, "stats")
    measured = measure(docs, name)
    return measured, name, base_failed(F.col(name)), expression(rules, F.col(name))


def verdicts(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id``, counts, ``base_failed``, ``rule`` (0: none) and ``kept``. Repeated rows stay."""
    measured, name, failed, rule = judge(docs.select("doc_id", "text"), fit(docs, labels, sample))
    return measured.select(
        "doc_id", *[F.col(name).getField(c).alias(c) for c in COUNTS], failed.alias("base_failed"),
        rule.alias("rule"), (~failed & (rule == 0)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that pass, with their own columns."""
    measured, _, failed, rule = judge(docs, fit(docs, labels, sample))
    return measured.where(~failed & (rule == 0)).select(*[f"`{c}`" for c in docs.columns])
