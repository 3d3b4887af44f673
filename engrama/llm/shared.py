"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The two alphabets of words that the contracts name.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
SPACE_GAP = r"[\x20\x09-\x0D]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ALNUM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: The same folding for Python strings.
FOLD = str.maketrans(UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is named and all run on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="engrama-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def scratch_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder; it is deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/engrama-{what}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet in the shared folder and reads it back, so that a lost executor costs no recomputation."""
    path = scratch_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def if_small(df: DataFrame, rows: int, *arrays: str) -> DataFrame:
    """df (written already, so that counting is cheap), marked for broadcast if it has at most `rows` rows and its array columns at most four elements per row of that bound in all."""
    sizes = [F.coalesce(F.sum(F.size(a)), F.lit(0)) for a in arrays]
    n, *held = df.agg(F.count("*"), *sizes).first()
    return F.broadcast(df) if n <= rows and sum(held) <= 4 * rows else df


def let(value: Column, body) -> Column:
    """body(v) with v bound to value once; a plain reference would be evaluated again for each element of an inner lambda."""
    return F.transform(F.array(value), body)[0]


def fold_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; texts of ASCII alone take the faster way to the same result."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def split_words(text: Column, gap: str) -> Column:
    """The words between gaps in order; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), gap), "")


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns whose names an operator is about to add (names match as Spark's resolver does)."""
    taken = {n.lower() for n in names}
    return df.select(*[df[c] for c in dict.fromkeys(df.columns) if c.lower() not in taken])
