"""Ships the package to the executors, whose Python may not have it installed."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

import supplyloom

_SHIPPED: set[str] = set()


def share_code(spark: SparkSession) -> None:
    """Add this package to the application's Python files, once per application.

    Spark's own file server hands the archive to every executor.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(supplyloom.__file__)))
    base = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="supplyloom-")), "supplyloom")
    spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", root, "supplyloom"))
    _SHIPPED.add(app)
