"""Files of own formats in a shared folder, written by tasks."""

from __future__ import annotations

from pyspark.sql import SparkSession


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder as a URI with its store, as Spark itself resolves the string.

    A folder without a scheme lies in the default store of the cluster, not on the
    disk of the machine that happens to write there.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store.makeQualified(path).toString()


def write_file(folder: str, name: str, data: bytes) -> None:
    """Put one file into a folder given as a URI, as :func:`qualified` returns it."""
    from pyarrow import fs

    if folder.startswith("file:"):
        store, path = fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    else:
        store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    # The bytes are written as they are, whatever the name ends in.
    with store.open_output_stream(f"{path}/{name}", compression=None) as out:
        out.write(data)
