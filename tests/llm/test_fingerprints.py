import brute_llm
from odd_rows import ODD
from pyspark.sql import functions as F

from shelfmark.llm import fingerprints


def rows_of(df):
    return {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next)
            for r in fingerprints.compare_edits(df).collect()}


def test_against_brute_force(small):
    assert rows_of(small) == brute_llm.fingerprint_rows([(r.doc_id, r.text) for r in small.collect()])


def test_odd_rows(odd, none, spark):
    texts = {i: t for i, t in ODD if i is not None}
    distinct = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    assert rows_of(distinct) == brute_llm.fingerprint_rows(list(texts.items()))
    whole = fingerprints.compare_edits(odd).collect()
    assert len(whole) == len(ODD) and fingerprints.compare_edits(none).count() == 0
    by_text = {}
    for r in fingerprints.fingerprints(odd.where("doc_id IN (5, 6)")).collect():
        by_text.setdefault(r.text, set()).add(tuple(r.fingerprint))
    assert all(len(v) == 1 for v in by_text.values())
    one = fingerprints.compare_edits(spark.createDataFrame([(1, "a b c d e f g h i")], "doc_id long, text string")).first()
    assert one.near_next == 1.0


def test_next_by_falling_id_over_many_ranges(spark):
    ids = [3 * k % 101 for k in range(101)]
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids] + [(None, f"null {k}") for k in range(9)], "doc_id long, text string")
    rows = fingerprints.with_next(docs, ["doc_id", "text"], ranges=13).collect()
    follows = {r.text: r.next_text for r in rows}
    assert all(follows[f"t{i}"] == f"t{i - 1}" for i in range(1, 101)) and follows["t0"].startswith("null")
    at, seen = "t100", []
    while at not in seen:
        seen.append(at)
        at = follows[at]
    assert at == "t100" and len(seen) == 110


def test_uniting_and_containment(spark):
    long = " ".join(f"w{k}" for k in range(3000))
    part = " ".join(f"w{k}" for k in range(1000, 1400))
    df = spark.createDataFrame([(long, part)], "a string, b string").select(
        fingerprints.sketch(F.col("a")).alias("a"), fingerprints.sketch(F.col("b")).alias("b"))
    row = df.select(fingerprints.containment(F.col("b"), F.col("a")), fingerprints.containment(F.col("a"), F.col("b")),
                    fingerprints.unite(F.col("a"), F.col("b")), "a").first()
    assert row[0] == 1.0 and abs(row[1] - 396 / 2996) < 0.04 and row[2] == row[3]
