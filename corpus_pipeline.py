"""The corpus pipeline: quality rules, near-dedup, substring dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the
last return the columns of documents, with n_chars following the text. Between stages the table
is written and read again.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fanframe.llm import minhash, packing, pii, quality, substrings
from fanframe.llm.common import documents, materialize


def _recounted(docs: DataFrame, text: DataFrame) -> DataFrame:
    """With n_chars counted anew where the table has it."""
    return text.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else text


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their group's outlier rule reject go.

    Verdicts return to their rows by a 128-bit key of the row, so null and repeated ids do no harm.
    """
    row = ["doc_id", "lang", "source", "text"]
    keys = {"key_1": F.xxhash64(*row), "key_2": F.xxhash64(F.lit("second"), *row)}
    good = quality.judge(docs.select(*row, *[k.alias(n) for n, k in keys.items()]), [*keys]).filter("kept").select(*[F.col(k).alias(f"good_{k}") for k in keys]).distinct()
    good = materialize(good, "good rows")
    same = (keys["key_1"] == good["good_key_1"]) & (keys["key_2"] == good["good_key_2"])
    return docs.join(good.hint("shuffle_hash"), same, "left_semi")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class the document with the smallest id stays; null ids come last, repeated rows are one."""
    return minhash.first_of_classes(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of 50 bytes and more that an earlier document has are cut out."""
    return _recounted(docs, substrings.remove_substrings(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind."""
    return _recounted(docs, pii.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: Suffix arrays, tokenizers and expectation-maximisation can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage {name}")
    return STAGES[-1][1](spark, docs, sf_dir)
