"""Helpers that several operators share."""

from __future__ import annotations

import itertools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the word rules name it: space and the codes 9 to 13.
SPACE_CLASS = "[\\x20\\x09-\\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def text_of(column: str = "text"):
    """The text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal_rows(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A few rows as literals of the plan; ``schema`` as "name type, ..."."""
    fields = [x.split() for x in schema.split(", ")]
    made = F.array(*(F.struct(*(F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(r, fields, strict=True))) for r in rows))
    return spark.range(1).select(F.inline(made))


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Names for helper columns that clash with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        name = next(n for i in itertools.count() if (n := f"__{stem}{i or ''}") not in taken)
        taken.add(name)
        out.append(name)
    return out


def with_out(df: DataFrame, *out: str) -> list[str]:
    """The columns of ``df`` and then ``out``, which take the place of columns so named."""
    new = {x.lower() for x in out}
    return [*(f"`{c}`" for c in df.columns if c.lower() not in new), *out]


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a folder of this machine only where none is set, as in tests."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared checkpoint folder and read back: later stages do not run it again, and a lost executor loses none of it.

    Unlike ``checkpoint()`` this leaves size estimates that come from the files,
    not from the plan that made them (which multiply with each round of joins).
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)  # with the driver, which alone can still read it
    return spark.read.schema(df.schema).parquet(path)
