"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: White space of the word rule used by most operators, as a regex class body.
SPACE = r"\x20\x09-\x0D"
#: Bytes per Arrow batch handed to a Python worker: texts can be long.
ARROW_BYTES = "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small enough for a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder named by ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def tidy_shuffles(spark: SparkSession):
    """Queries made in here remove their shuffle files when they end: many small jobs in
    a row leave nothing behind but their checkpoints. Not for persisted frames."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def small(df: DataFrame, limit: int) -> DataFrame:
    """A checkpointed ``df``, to be broadcast if it is counted to have ``limit`` rows at most;
    a larger one is joined by shuffling both sides, where a hot key may be split."""
    return F.broadcast(df) if df.count() <= limit else df


def free_name(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores in front until no column (in any case) has it."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def q(name: str) -> Column:
    """Column by its literal name (dots, spaces and quotes included)."""
    return F.col("`" + name.replace("`", "``") + "`")


def wrapped(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``row`` (all columns), ``id`` and ``sig`` (hash of the text): what is joined to it
    can't clash with the columns of ``docs``; ``select("row.*")`` gives them back."""
    return docs.select(F.struct(*[q(c) for c in docs.columns]).alias("row"), q(id_col).alias("id"), F.xxhash64(q(text)).alias("sig"))


def words(text: Column) -> Column:
    """Maximal runs of characters that are not white space; null gives none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")
