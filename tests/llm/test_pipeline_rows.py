"""Stages drop rows, not doc_ids: repeated and NULL ids are decided row by row."""

import pytest

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


def text(word, n=40):
    return " ".join(f"{word}{i}" for i in range(n))


@pytest.fixture(scope="module")
def benchmark_text(spark):
    return max((r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if r["item_id"] is not None and r["text"]), key=len)


def left(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_one_row_of_each_group_whatever_its_ids(spark, make_docs):
    a, b, c = text("a"), text("b"), text("c")
    rows = [(None, a, "s"), (2, a, "s"), (1, a, "s"), (1, a, "s"), (None, b, "s"), (None, b, "s"), (1, c, "s"), (5, None, "s"), (5, None, "s"), (None, "", "s")]
    docs = make_docs(rows)
    got = P.near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    assert left(got) == sorted([(1, a), (None, b), (1, c), (5, None), (5, None), (None, "")], key=str)


def test_only_contaminated_rows_go(spark, make_docs, benchmark_text):
    clean, held = text("a"), f"{text('b')} {benchmark_text}"
    docs = make_docs([(7, clean, "s"), (7, held, "s"), (None, clean, "s"), (None, held, "s"), (8, None, "s")])
    got = P.decontamination(spark, docs, SF)
    assert got.columns == docs.columns
    assert left(got) == sorted([(7, clean), (None, clean), (8, None)], key=str)
