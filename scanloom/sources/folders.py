"""Numbered folders of a store: complete ones are listed, replaced ones dropped."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _files(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def complete_numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers of the folders ``name=<number>`` in ``path`` whose writing was finished, in order; none if there is no ``path``."""
    folder, files = _files(spark, path)
    if not files.exists(folder):
        return []
    found = [s.getPath() for s in files.listStatus(folder)]
    done = [p.getName() for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(n.removeprefix(f"{name}=")) for n in done if n.startswith(f"{name}="))


def drop_folder(spark: SparkSession, path: str) -> None:
    folder, files = _files(spark, path)
    files.delete(folder, True)
