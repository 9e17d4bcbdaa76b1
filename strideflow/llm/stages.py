"""The stages of the corpus pipeline: (spark, docs, sf_dir) to the documents that stay.

All stages take whole texts of any length, and all columns of a document go along under their own names, whatever
those are.  A null text counts as an empty one but stays null where the stage does not change it.  Rows that repeat
each other are documents of their own.  An empty table gives an empty one with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import of_session


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under one half.

    A score depends on the text alone: equal texts stay or go together, null and empty ones stay as long as the
    bias says so.  Without labels nothing is rejected.
    """
    from .toxicity import fit, score

    weights = fit(docs, of_session(spark, sf_dir, "labels"))
    return score(docs, weights, docs.columns).filter("score < 0.5").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the smallest doc_id.

    Null, empty and wordless texts are one group.  Rows with a repeated or null doc_id stand behind all others.
    """
    from .simhash import keep_first

    return keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has.

    Earlier is a smaller doc_id; rows with a repeated or null one stand behind all others.  Texts that keep fewer
    than five words go; null and short texts are left as they are.
    """
    from .substrings import cut_repeats

    return cut_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Null sources are a source of their own; documents without words have size zero and are taken at no cost or
    not at all, as their place in the queue says.
    """
    from .mixing import mix

    chosen = mix(docs, docs.columns)
    copies = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return chosen.filter("copies > 0").select("row", copies.alias("_copy")).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of fixed-length sequences with their ids; a null or empty text is its end id alone."""
    from .packing import pack
    from .queries import vocabulary

    return pack(docs, vocabulary("word_bpe_49k.json"))
