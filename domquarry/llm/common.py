"""Helpers shared by the operators: shared folder, written tables, small column idioms."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the ASCII white space of this class.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, local mode makes a folder of its own; on a cluster that
    is an error, since no machine-local folder could stand in for it.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        d = spark.sparkContext.getCheckpointDir()
    return d.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the shared folder; nothing is made yet."""
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


_SAVED: list[str] = []  # folders of saved tables, in the order of writing


def save(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet into the shared folder and read it back."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    _SAVED.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def saved_within(spark: SparkSession):
    """A function that keeps a frame by saving it; what else was saved inside is
    deleted on a clean exit, when nothing reads it any more."""
    start, kept = len(_SAVED), []

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = save(df, name)
        kept.append(_SAVED.pop())
        return out

    yield keep
    for path in _SAVED[start:]:
        _delete(spark, path)
    _SAVED[start:] = kept


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text, repeats included, in order; none for a null text."""
    plain = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words, as long; 0 for a null text."""
    return F.size(words(text)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shield(df: DataFrame, names):
    """``df`` with those of its columns renamed that an operator would take or
    replace, and a function that selects the columns of ``df`` again from the result."""
    own = {c: f"_own_{c}" for c in df.columns if c in set(names)}

    def restore(out: DataFrame, *more) -> DataFrame:
        return out.select(*[F.col(own.get(c, c)).alias(c) for c in df.columns], *more)

    return df.withColumnsRenamed(own), restore
