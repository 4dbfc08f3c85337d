"""Session helpers: table access, materialised intermediate tables, sizing."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder shared by driver and executors: ``spark.checkpoint.dir`` of the session.

    Where the session names none, a temporary folder is made on one machine (a local master); on a cluster, whose executors could not see it, that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError(f"spark.checkpoint.dir is not set: master {master} needs a folder that driver and executors share")
    here = getattr(shared_dir, "_own", None)
    if here is None or not os.path.isdir(here):
        here = tempfile.mkdtemp(prefix="lingoweave-")
        atexit.register(shutil.rmtree, here, True)
        shared_dir._own = here
    return f"file://{here}"


def folder(spark: SparkSession, label: str) -> str:
    """Path of a new folder below the shared one, removed by ``drop_stored`` or when the program ends."""
    path = f"{shared_dir(spark)}/lingoweave/{label}-{uuid.uuid4().hex}"
    if not _stored:
        atexit.register(drop_stored, spark)
    _stored.append(path)
    return path


def store(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return a scan of it.

    Cuts the lineage without depending on any one executor, and runs ``df`` exactly once.
    """
    path = folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_stored: list[str] = []


def drop_stored(spark: SparkSession) -> None:
    """Remove all tables stored so far; results that were not written elsewhere can't be read any more. Long sessions call it between runs, others leave it to the end."""
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        while _stored:
            path = jvm.org.apache.hadoop.fs.Path(_stored.pop())
            path.getFileSystem(conf).delete(path, True)
    except Exception:  # noqa: BLE001 - the application has ended before
        pass


def ship(spark: SparkSession) -> None:
    """Give executors this package, once per application: they needn't have it installed. The archive lies in the shared folder."""
    import io
    import zipfile
    from pathlib import Path

    context = spark.sparkContext
    if getattr(ship, "_done", None) == context.applicationId:
        return
    root, archive = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"lingoweave/{p.relative_to(root)}")
    where = f"{shared_dir(spark)}/lingoweave/package-{uuid.uuid4().hex}/lingoweave.zip"
    path = context._jvm.org.apache.hadoop.fs.Path(where)
    out = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(archive.getvalue()))
    out.close()
    context.addPyFile(where)
    ship._done = context.applicationId
