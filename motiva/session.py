"""What operators need of a session: the package on its executors, and tables in the folder that they share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as set in ``spark.checkpoint.dir``; a new local one only where none is set and all executors are on this machine."""
    sc = spark.sparkContext
    d = sc._jsc.sc().getCheckpointDir()
    if d.isDefined():
        return d.get()
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not conf:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="motiva-")
    sc.setCheckpointDir(conf)
    return sc._jsc.sc().getCheckpointDir().get()


_written: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read back: lineage ends here, and no part of it is lost with an executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/motiva-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._motiva_path = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Removes what ``cut`` wrote for these tables: nothing that is still to be computed may read them."""
    for df in tables:
        _written.remove(df._motiva_path)
        _remove(df.sparkSession, df._motiva_path)


def sweep(spark: SparkSession) -> int:
    """Removes the tables that ``cut`` has written in this process; for when no DataFrame that reads them is needed any more. Says how many."""
    n = len(_written)
    while _written:
        _remove(spark, _written.pop())
    return n


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the executors, once per context."""
    sc = spark.sparkContext
    if not getattr(sc, "_motiva_shipped", False):
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="motiva-ship-")) / "motiva.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(archive))
        sc._motiva_shipped = True
    return spark
