"""Sending the package to the Python workers, which may run anywhere."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_DONE = "_tidegauge_shipped"


def ship(spark: SparkSession) -> None:
    """Make the package importable in the session's Python workers, once per application.

    The driver stages a zip file in its own temporary folder; Spark hands it to
    the executors.  A cluster that has the package installed, or was given it
    with ``--py-files``, needs no call.
    """
    context = spark.sparkContext
    if getattr(context, _DONE, False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="tidegauge-package-")) / "tidegauge.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent).as_posix())
    context.addPyFile(str(archive))
    # Stateful stream operators are first set up by a worker beside the driver, which sees no shipped files.
    known = context.environment.get("PYTHONPATH")
    context.environment["PYTHONPATH"] = os.pathsep.join([str(package.parent), *([known] if known else [])])
    setattr(context, _DONE, True)
