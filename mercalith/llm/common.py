"""What several operators of this package share: tables, words, written intermediate results."""

from __future__ import annotations

import ctypes
import os
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mercalith.session import scratch_path, stored

__all__ = ["SPACES", "ids_bytes", "release_memory", "scratch_path", "sf_table", "stored", "tokenizer_file", "words"]

# the characters that separate words: space and U+0009 to U+000D
SPACES = " \t\n\x0b\x0c\r"


def sf_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; the path is joined as text so that any store Spark knows will do."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def words(text: Column) -> Column:
    """The array of words `[^\\x20\\x09-\\x0D]+` of a text; empty for NULL and for no word."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, r"[\x20\x09-\x0D]+")
    )


def tokenizer_file(name: str) -> str:
    """The file of a public tokenizer, by the installed package or below TOKENIZER_DIR."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def ids_bytes(ids) -> bytes:
    """Token ids as little-endian unsigned 32-bit integers."""
    import numpy as np

    return np.asarray(ids, dtype="<u4").tobytes()


@lru_cache(maxsize=1)
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library
        return lambda _: 0


def release_memory() -> None:
    """Give memory that is free inside this worker process back to the machine; workers outlive their tasks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    _trim()(0)
