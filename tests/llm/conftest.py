from __future__ import annotations

import re

import pytest

from tidegrid.session import share_package


@pytest.fixture(scope="session")
def corpus(spark):
    share_package(spark)

    def make(rows, more=True):
        """Documents with columns whose names the operators use inside themselves."""
        schema = "doc_id long, text string, n_chars long"
        df = spark.createDataFrame([(i, t, None if t is None else len(t)) for i, t in rows], schema)
        if more:
            from pyspark.sql import functions as F

            for c in ("score", "label", "block", "shard", "region", "batch", "t", "w", "n", "hub", "seed", "k1", "lang"):
                df = df.withColumn(c, F.lit(f"own {c}"))
        return df

    return make


def words(text):
    """The words of a text as the operators take them: A-Z lowered, cut at ASCII white space."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, a very long one, ties, repeated rows."""
    long = " ".join(f"word{i % 977}x{i % 13}" for i in range(60_000))
    return [(1, None), (2, ""), (3, " \t\n "), (4, long), (5, long), (6, "one two three"), (6, "one two three"), (None, "no id here at all"), (7, "ÄÖ ß é"), (8, "a"), (9, "one two three")]
