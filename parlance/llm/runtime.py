"""Session helpers: where lineage is cut, how wide to spread work, and column names that can't clash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only by a single local JVM whose session names no folder, as in unit tests.
FALLBACK_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read, from ``spark.checkpoint.dir``; a cluster without one is refused."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or ""
    if not named and not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named or FALLBACK_DIR)
    return named or FALLBACK_DIR


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there.

    Later stages then see one fixed set of rows, whatever executor is lost.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def let_go(spark: SparkSession) -> None:
    """Have the driver's JVM collect: only then does Spark remove the shuffle files of what nothing refers to any more."""
    spark._jvm.System.gc()


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(name: str) -> Column:
    """The column of just this name, whatever dots or quotes it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame, name: str = "row") -> Column:
    """All columns of ``df`` as one struct, under which their names clash with no other."""
    return F.struct(*[named(c) for c in df.columns]).alias(name)


def unwrapped(df: DataFrame, columns: list[str], name: str = "row") -> list[Column]:
    """The columns of a ``whole_row`` again."""
    return [df[name].getField(c).alias(c) for c in columns]
