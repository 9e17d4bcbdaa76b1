"""Small tables with the cases that operators must bear."""

import pytest
from llm_cases import SMALL

#: Columns whose names operators use themselves.
CLASHING = ["size", "score", "part", "row", "ids", "start", "target", "label", "base", "_id", "print"]


@pytest.fixture(scope="session")
def table(spark):
    """Documents from (doc_id, text[, source]) with further columns whose names clash."""

    def make(rows, parts=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), *["x"] * len(CLASHING)) for r in rows]
        kinds = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
        return spark.createDataFrame(full, kinds).repartition(parts)

    return make


@pytest.fixture(scope="session")
def small(spark):
    return lambda name: spark.read.parquet(f"{SMALL}/{name}.parquet")
