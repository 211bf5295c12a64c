"""Session settings and the few helpers that touch the cluster: cutting
lineage in the shared folder and broadcasting behind a size check."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in bytes as Spark holds them in memory, that is sent to every executor.
BROADCAST_BYTES = 32 << 20


def build_session(app: str = "tailrace", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators count on; anything may be overridden by ``conf``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that their Python workers can import it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_tailrace_shipped", None) == sc.applicationId:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tailrace-code-")) / "tailrace-code.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._tailrace_shipped = sc.applicationId


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``. Only where that is unset and the master is local, as in tests, a local one is made."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = spark.conf.get("tailrace.own.dir", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="tailrace-")
        spark.conf.set("tailrace.own.dir", own)
    return own


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """A folder of the shared storage for Python: its file system and its path there."""
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet into the shared folder and read it back.

    Lineage ends there, so that an executor lost later costs no recomputation
    beyond the running stage; unlike localCheckpoint nothing is kept on executors.
    """
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def work_dir(spark: SparkSession) -> str:
    """This application's own folder within the shared one; it is deleted when the application ends."""
    sc = spark.sparkContext
    path = f"{shared_dir(spark)}/tailrace/{sc.applicationId}"
    if getattr(sc, "_tailrace_work", None) != path:
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        sc._tailrace_work = path
    return path


def table_bytes(df: DataFrame) -> int:
    """Rows of ``df`` times a generous width. An action: call it on a materialized table."""
    width = {"bigint": 8, "int": 4, "smallint": 2, "double": 8, "float": 4, "boolean": 1, "date": 4, "timestamp": 8}
    sizes = [F.lit(16)] + [F.lit(width[t] + 8) if t in width else F.coalesce(F.length(F.to_json(F.struct(c))), F.lit(8)) for c, t in df.dtypes]
    total = sizes[0]
    for s in sizes[1:]:
        total = total + s
    return df.agg(F.sum(total.cast("long"))).first()[0] or 0


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it measures at most ``limit`` bytes, else as it is (the join then shuffles)."""
    return F.broadcast(df) if table_bytes(df) <= limit else df
