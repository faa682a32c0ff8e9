"""Helpers shared by the corpus operators: shared storage and input tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: While a table is written: shuffle files go when its query ends, and Python workers get texts in small batches.
_TIDY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where a local session names none, the SQL warehouse holds the tables. On a
    cluster that folder may belong to one host, so there it must be named.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def tidy(spark: SparkSession):
    """Shuffle files of the queries that run inside go when each of them ends, not when the driver collects garbage; batches for Python are bounded in bytes."""
    before = {key: spark.conf.get(key, None) for key in _TIDY}
    for key, value in _TIDY.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage, so that a lost executor costs a reread and not a rerun. The
    shuffle files that the table was made with go as soon as it is written.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    with tidy(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`stored` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_stored_at", None)
        if path:
            sc = df.sparkSession.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while (name := f"_{name}") in taken:
        pass
    return name


def id_text(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` (long) and ``text``, so that further columns cannot clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def small(spark: SparkSession, rows: list[tuple], kinds: dict[str, str]) -> DataFrame:
    """A few rows of the driver's, with Arrow's types by column; Spark has them in the plan, and starts no Python workers for them."""
    import pyarrow as pa

    columns = zip(*rows) if rows else [()] * len(kinds)
    return spark.createDataFrame(pa.table([pa.array(x, pa.type_for_alias(kind)) for x, kind in zip(columns, kinds.values())], names=list(kinds)))


def partitions(spark: SparkSession, least: int = 1) -> int:
    """Partitions for an explicit shuffle: what the session asks for."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def known_to_workers(spark: SparkSession) -> None:
    """Let Python workers find this package.

    On a cluster Spark ships it, once for each context, from the driver to every
    executor. Local workers find it where the driver did.
    """
    sc, root = spark.sparkContext, Path(__file__).resolve().parents[2]
    if sc.master.split("[")[0] == "local":
        env = sc.environment
        known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
        if str(root) not in known:
            env["PYTHONPATH"] = os.pathsep.join([*known, str(root)])
    elif not getattr(sc, "_pitchloom_shipped", False) and root.is_dir():
        packed = Path(tempfile.mkdtemp()) / "pitchloom.zip"  # read by the driver's file server only
        with zipfile.ZipFile(packed, "w") as z:
            for path in sorted(root.glob("pitchloom/**/*.py")):
                z.write(path, path.relative_to(root))
        sc.addPyFile(str(packed))
        sc._pitchloom_shipped = True
