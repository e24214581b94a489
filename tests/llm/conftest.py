"""Odd documents that every operator must take."""

from __future__ import annotations

import pytest

LONG = "Long words go on and on, " * 6000
ODD = [
    (1, "the quick brown fox jumps over the lazy dog and runs far away from here today ok"),
    (2, "The Quick brown fox jumps over the lazy dog and runs far away from here today ok"),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (6, LONG),
    (7, LONG),
    (8, "naïve café ▁ 日本語 #tag <b> | 100% $5\nnaïve café ▁ 日本語 #tag <b> | 100% $5\n\nend"),
    (8, "naïve café ▁ 日本語 #tag <b> | 100% $5\nnaïve café ▁ 日本語 #tag <b> | 100% $5\n\nend"),
    (9, "same"), (9, "same"), (9, "other"),
    (None, "same"), (None, None),
    (10, "<|endoftext|> <s> </s> é é"),
]
CLASHING = (
    "doc_id bigint, text string, row bigint, fp string, component_id int, kept string, size int, "
    "shard string, slot string, start string, _row int, _passes int, `a.b` string"
)


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with extra columns whose names the operators use themselves."""
    rows = [(i, t, 7, "x", 1, "k", 2, "s", "l", "st", 3, 4, "dot") for i, t in ODD]
    return spark.createDataFrame(rows, CLASHING).repartition(3).persist()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], CLASHING)


@pytest.fixture(scope="session")
def odd_table(odd, tmp_path_factory):
    """The odd rows as a table read."""
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    odd.write.parquet(path)
    return odd.sparkSession.read.parquet(path)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
