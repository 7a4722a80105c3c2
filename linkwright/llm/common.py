"""Word rules and small helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a run of anything but the ASCII blanks 9 to 13 and 32.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column | str) -> Column:
    """Number of words, as long; null counts as the empty text."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words as UTF-8; ``bytes`` splits on exactly the blanks that end a word."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def with_new(rows, columns: list[str], new: dict[str, Column]):
    """The columns of the struct ``row``, those named in ``new`` replaced in place, the rest of ``new`` behind."""
    kept = [new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in columns]
    return rows.select(*kept, *[v.alias(n) for n, v in new.items() if n not in columns])


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(modulus: int, remainder: int) -> Column:
    """Whether crc32 of ``doc_id`` as text leaves ``remainder``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == remainder
