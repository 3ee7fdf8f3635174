"""Folders and small files on whatever file system Spark uses."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a temporary one if all runs on one machine, else
    ValueError, as no folder is known then that all machines see."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines see")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="asserta-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh folder name in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/asserta-{label}-{uuid.uuid4().hex}"
    atexit.register(delete_path, spark, path)
    return path


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder or file; a context that has ended leaves it to the cluster."""
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def put_file(spark: SparkSession, local: str, path: str) -> None:
    """Copies a file of this machine to where all machines see it."""
    p, fs = _fs(spark, path)
    fs.copyFromLocalFile(False, True, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{local}"), p)


def rename_path(spark: SparkSession, path: str, to: str) -> None:
    """Moves a folder or file to a name that isn't there yet; one that is gone raises FileNotFoundError."""
    p, fs = _fs(spark, path)
    q, _ = _fs(spark, to)
    fs.mkdirs(q.getParent())
    if fs.exists(q):
        raise FileExistsError(to)
    if not fs.rename(p, q):
        raise FileNotFoundError(path)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, none if there is no such folder."""
    p, fs = _fs(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, None if there is none."""
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str, replace: bool = True) -> None:
    """Writes a small file. replace: through a rename, so readers see the old or the new one whole; else creates it,
    and an existing file raises FileExistsError."""
    p, fs = _fs(spark, f"{path}.{uuid.uuid4().hex}" if replace else path)
    try:
        out = fs.create(p, False)
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            raise FileExistsError(path) from None
        raise
    out.write(bytearray(text.encode()))
    out.close()
    if replace:
        context, jvm = spark.sparkContext, spark.sparkContext._jvm
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = context._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        final = jvm.org.apache.hadoop.fs.Path(path)
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), context._jsc.hadoopConfiguration())
        files.rename(fs.makeQualified(p), fs.makeQualified(final), how)
