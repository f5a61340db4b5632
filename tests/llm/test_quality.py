import duckdb
import numpy as np
import pytest
from odd_rows import ODD
from pyspark.sql import functions as F

from shelfmark.llm import quality


def brute(text):
    words = [w for w in __import__("re").split("[\\x20\\x09-\\x0D]+", text or "") if w]
    lines, seen, duplicates = (text or "").split("\n"), set(), 0
    for line in lines:
        if any(c not in " \t\n\x0b\x0c\r" for c in line):
            duplicates += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    counts = {}
    for w in windows:
        counts[w] = counts.get(w, 0) + 1
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), duplicates, len(covered)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_counts_and_verdicts(spark, odd, small):
    docs = odd.select("doc_id", "text").union(small.select("doc_id", "text"))
    texts = [t for _, t in ODD] + [r.text for r in small.collect()]
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").union(labels_of(spark, [(None, 0, 0), (1, None, 0), (2, 7, 0), (3, 0, 0), (3, 1, 0)]))
    rows = quality.verdicts(docs, labels).collect()
    got = sorted(tuple(r)[1:6] for r in rows)
    assert got == sorted(map(brute, texts))
    for r in rows:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed and r.rule == 0)


def test_odd_rows_keep_their_columns(spark, odd, none):
    labels = labels_of(spark, [])
    kept = quality.keep_good(odd, labels)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == [] or all(r.n == "own n" for r in kept.collect())
    assert quality.verdicts(none, labels).count() == 0 and quality.fit(odd, labels) == []


def test_expression_follows_the_list(spark):
    rng = np.random.default_rng(0)
    table = rng.random((400, len(quality.STATISTICS)))
    bad = (table[:, 2] > 0.7) & (table[:, 5] <= 0.5) | (table[:, 9] > 0.9)
    rules = quality.learn(table, bad)
    covered = np.zeros(len(table), int)
    for number, rule in reversed(list(enumerate(rules, 1))):
        covered[quality.covered(rule, table)] = number
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(table)], ["i", *quality.STATISTICS])
    got = df.withColumn("s", F.struct(*quality.STATISTICS)).select("i", quality.expression(rules, F.col("s"))).orderBy("i").collect()
    assert [r[1] for r in got] == covered.tolist()
    assert ((covered > 0) & bad).sum() > 0.9 * bad.sum() and ((covered > 0) & ~bad).sum() < 0.05 * len(bad)


def test_held_out_accuracy():
    path = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"SELECT text, quality FROM '{path}/documents.parquet' JOIN '{path}/labels.parquet' USING (doc_id) ORDER BY doc_id").fetchall()
    table = np.array([quality.statistics(t)[len(quality.COUNTS):] for t, _ in rows])
    bad = np.array([q == 0 for _, q in rows])
    half = len(rows) // 2
    rules = quality.learn(table[:half], bad[:half])
    rejected = np.zeros(len(rows), bool)
    for rule in rules:
        rejected |= quality.covered(rule, table)
    test = slice(half, None)
    assert (rejected & bad)[test].sum() > 0.95 * bad[test].sum()
    assert (rejected & ~bad)[test].sum() < 0.005 * (~bad)[test].sum()


@pytest.mark.parametrize(("text", "n"), [("a b c d e a b c d e", 10), ("a b c d e f", 0), ("x " * 7, 7), ("a b c d e x a b c d e y a b c d e", 15)])
def test_repeated_words(text, n):
    assert quality.repeated_words(text.encode().split()) == n
