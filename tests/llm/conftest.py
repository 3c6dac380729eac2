from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents-like table with clashing further columns."""

    def build(rows):
        full = [(i, t, None, "s", -1, "x", 0.5, 7) for i, t in rows]
        return spark.createDataFrame(
            full,
            "doc_id long, text string, lang string, source string, n_chars long, key string, score double, block int",
        )

    return build
