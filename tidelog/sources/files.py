"""Small files and folders through Spark's own file systems, so that any store Spark reads will do."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _open(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _open(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file as a whole; False if another writer was first.

    The file is written under a name of its own and then gets its real one by a step that fails if the name is
    taken: a hard link on local file systems, elsewhere a rename, which distributed file systems make atomic
    and refuse. A store whose renames replace files, as some object stores' do, bears one writer at a time.
    """
    fs, p = _open(spark, path)
    temp = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{spark._jvm.java.util.UUID.randomUUID().toString()}.tmp")
    stream = fs.create(temp, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    try:
        return _linked(spark, fs, temp, p) if fs.resolvePath(temp).toUri().getScheme() == "file" else not fs.exists(p) and fs.rename(temp, p)
    finally:
        fs.delete(temp, False)


def _linked(spark: SparkSession, fs, temp, path) -> bool:
    """A hard link from the new name, which only one writer can make."""
    nio, local = spark._jvm.java.nio.file, fs.resolvePath(temp).toUri().getPath()
    target = local[: local.rindex("/") + 1] + path.getName()
    try:
        nio.Files.createLink(spark._jvm.java.io.File(target).toPath(), spark._jvm.java.io.File(local).toPath())
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" in str(error.java_exception.toString()):
            return False
        raise
    return True


def tag() -> str:
    """A part of a folder's name that no other writer uses."""
    return uuid.uuid4().hex[:12]


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it doesn't exist."""
    fs, p = _open(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def make_folder(spark: SparkSession, path: str) -> None:
    fs, p = _open(spark, path)
    fs.mkdirs(p)


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = _open(spark, path)
    return fs.delete(p, True)


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """Make a folder that goes, with all that is in it, when the driver's JVM ends."""
    fs, p = _open(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
