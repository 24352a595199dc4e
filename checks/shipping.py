"""The package as a file that Spark hands to its Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import placerank

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give workers the package, once per application, whatever folder they start in.

    On a cluster ``--py-files`` does the same.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(placerank.__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="placerank-"), "placerank.zip")
    with zipfile.ZipFile(archive, "w") as packed:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    packed.write(path, os.path.relpath(path, os.path.dirname(root)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
