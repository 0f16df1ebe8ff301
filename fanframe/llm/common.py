"""Helpers that the training-data operators share.

Rules kept by all of them: a null text counts as empty, only the columns that an operator
needs are selected (so extra columns with any names do no harm), and whatever cuts lineage
is a Parquet table in the folder that the cluster shares.
"""

from __future__ import annotations

import ctypes
import functools
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of characters other than these six.
SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir, or a local one where that is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
    return f"{base.rstrip('/')}/fanframe"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{re.sub('[^a-z0-9]+', '_', label)}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that materialize() wrote, once all that came from it is written itself."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._written_to)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def utf8_list(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8; null becomes empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def str_list(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def word_numbers(texts: pa.Array | pa.ChunkedArray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of some texts, all words in a row by their numbers among those, and each text's number of words.

    Words are cut by Arrow, which needs no Python object a word. Each text has an empty word for its end.
    """
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = pc.ascii_trim_whitespace(texts.fill_null(""))
    none, gap = pa.scalar("", texts.type), pa.scalar(" ", texts.type)
    texts = pc.if_else(pc.equal(texts, none), texts, pc.binary_join_element_wise(texts, gap, none))
    lists = pc.ascii_split_whitespace(texts)
    coded = lists.values.dictionary_encode()
    kind = pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()
    return coded.dictionary.cast(kind).to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), np.diff(lists.offsets.to_numpy())


def slices(batch: pa.RecordBatch | pa.Table, name: str | int, rows: int, text_bytes: int = 1 << 22) -> Iterator:
    """The batch in slices of a multiple of `rows`, each ending with the first that brings its texts to text_bytes."""
    sizes = pc.binary_length(batch.column(name)).fill_null(0).to_numpy()
    start = held = 0
    for k in range(0, batch.num_rows, rows):
        held += int(sizes[k : k + rows].sum(dtype=np.int64))
        if held >= text_bytes or k + rows >= batch.num_rows:
            yield batch.slice(start, k + rows - start)
            start, held = k + rows, 0


@functools.lru_cache(1)
def _trim():
    """glibc's malloc_trim, or what does nothing where it is missing."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):
        return lambda pad: 0


def give_back() -> None:
    """Return freed memory to the system. A Python worker lives on after its task, and else keeps all it ever took, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def block_count(docs: DataFrame, block_bytes: int) -> int:
    """How many hash blocks of about block_bytes of text the table makes (one scan of the texts' lengths)."""
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(1, -(-total // block_bytes))
