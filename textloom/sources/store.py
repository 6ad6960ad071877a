"""Small files of a store that Spark's file systems reach, and versions that are switched by one of them."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    fs, p = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_new(spark: SparkSession, path: str, text: str) -> None:
    """A new file, there with all of its text or not at all; an error if one of this name exists."""
    fs, p = _at(spark, path)
    _, part = _at(spark, f"{path}.part")
    stream = fs.create(part, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if fs.exists(p) or not fs.rename(part, p):
        fs.delete(part, False)
        raise FileExistsError(f"{path} was written by another")


def current(spark: SparkSession, path: str) -> dict | None:
    """The last version of the store at ``path``; None if it has none."""
    found = [n for n in names(spark, f"{path}/versions") if n.endswith(".json")]
    return json.loads(read_text(spark, f"{path}/versions/{found[-1]}")) if found else None


def commit(spark: SparkSession, path: str, version: dict) -> dict:
    """Make a version the current one. Its number is one more than that of the version it was made from; two from the same one can't both be."""
    spark._jvm.org.apache.hadoop.fs.FileSystem.mkdirs(_at(spark, path)[0], _at(spark, f"{path}/versions")[1], spark._jvm.org.apache.hadoop.fs.permission.FsPermission.getDirDefault())
    write_new(spark, f"{path}/versions/{version['number']:012d}.json", json.dumps(version))
    return version
