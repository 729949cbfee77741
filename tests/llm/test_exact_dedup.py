"""Exact deduplication against brute force, with colliding digests, restarts and odd rows."""
import hashlib

import pytest
from pyspark.sql import functions as F

from bidframe.llm import exact_dedup

ODD = [(1, "Same text"), (2, "same TEXT"), (3, None), (4, ""), (5, "ÄB"), (6, "äb"), (7, "äb"), (8, " same text"),
       (9, "x" * 200_000), (10, "X" * 200_000), (11, "same text"), (11, "same text"), (None, "same text"),
       (None, "only here"), (12, "İ"), (13, "i̇")]


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def expected(rows):
    groups = {}
    for doc, text in rows:
        groups.setdefault(lowered(text), []).append(doc)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(doc, keep, len(ids), digest) for doc in ids]
    return sorted(out, key=str)


def written(spark, rows, path, files=1):
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("file", F.lit("clash")).withColumn(
        "kept", F.lit(1)).repartition(files).write.mode("append").parquet(str(path))
    return str(path)


def found(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda text: F.unhex(F.lpad(F.hex(F.length(text) % 2), 2, "0"))])
def test_equal_texts_even_where_digests_collide(spark, tmp_path, digest):
    path = written(spark, ODD, tmp_path / "docs", 3)
    out = exact_dedup.duplicates(spark, path, digest=digest).cache()
    assert found(out) == expected(ODD)
    # One row of each group stays, repeated ids included.
    assert out.where("kept").count() == len({lowered(t) for _, t in ODD})
    assert out.where("kept AND NOT doc_id <=> keep_id").count() == 0


def test_later_files_meet_the_state_of_earlier_ones(spark, tmp_path):
    path, state = written(spark, ODD[:8], tmp_path / "docs"), str(tmp_path / "state")
    exact_dedup.duplicates(spark, path, state)
    written(spark, ODD[8:], tmp_path / "docs", 2)
    assert found(exact_dedup.duplicates(spark, path, state)) == expected(ODD)
    # Nothing new: the state counts no row twice.
    assert found(exact_dedup.duplicates(spark, path, state)) == expected(ODD)


def test_one_very_large_group(spark, tmp_path):
    rows = [(i, "Hot row") for i in range(4_000)] + [(10_000 + i, f"row {i % 1500}") for i in range(2_000)]
    assert found(exact_dedup.duplicates(spark, written(spark, rows, tmp_path / "docs", 4))) == expected(rows)


def test_empty_table_and_session_settings(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    path = written(spark, [], tmp_path / "docs")
    assert exact_dedup.duplicates(spark, path).collect() == []
    assert spark.conf.get(key, None) == before
