"""Readers and writers. Missing values become NULL where data enter."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustline.functions.scalars import finite


def clean(df: DataFrame) -> DataFrame:
    """NaN and infinities of floating columns as NULL."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[finite(F.col(f"`{c}`")).alias(c) if c in floats else F.col(f"`{c}`") for c in df.columns])


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns are pruned in the scan."""
    df = spark.read.parquet(path)
    return clean(df.select(*columns) if columns else df)


def read_any(spark: SparkSession, path: str, columns: Sequence[str] | None = None, schema=None) -> DataFrame:
    """Parquet, CSV (with a header) or JSON lines, by suffix."""
    bare = path.rstrip("/").lower()
    if bare.endswith(".csv"):
        r = spark.read.option("header", True)
        df = r.schema(schema).csv(path) if schema else r.option("inferSchema", True).csv(path)
    elif bare.endswith((".json", ".jsonl")):
        df = (spark.read.schema(schema) if schema else spark.read).json(path)
    else:
        df = spark.read.parquet(path)
    return clean(df.select(*columns) if columns else df)


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """A dataset kept on disk: read if it is there, else made (a connector's download, say), cleaned and written."""
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    make().na.drop("all").write.parquet(path)
    return spark.read.parquet(path)


def write(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Parquet, CSV or JSON lines, by suffix; dates in ISO form, NaN and infinities as NULL."""
    w = clean(df).write.mode(mode)
    w = w.partitionBy(*partition_by) if partition_by else w
    bare = path.rstrip("/").lower()
    if bare.endswith(".csv"):
        w.option("header", True).csv(path)
    elif bare.endswith((".json", ".jsonl")):
        w.option("dateFormat", "yyyy-MM-dd").json(path)
    else:
        w.parquet(path)


# --- intermediate tables --------------------------------------------------------------------------------------------

_own_root: str | None = None


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset, a temporary one in local mode; on a cluster that
    would be another disk on every machine, so it is an error there."""
    global _own_root
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    if _own_root is None:
        _own_root = "file://" + tempfile.mkdtemp(prefix="gustline-")
    return _own_root


def stash(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there, and a lost executor
    costs nothing that was computed before. The table goes with :func:`unstash`, and else when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at, fs = _at(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def unstash(df: DataFrame) -> None:
    """Delete a table written by :func:`stash` that no returned DataFrame reads."""
    path = getattr(df, "_stash_path", None)
    if path:
        at, fs = _at(df.sparkSession, path)
        fs.cancelDeleteOnExit(at)
        fs.delete(at, True)
