"""Give the Python workers of a session this library."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the library to the session's Python path, once for each application.

    Functions that run in Python workers are found there by module name, wherever the
    driver was started. Spark copies the archive to every executor, later ones too.
    """
    app = spark.sparkContext.applicationId
    if app in _SENT:
        return
    top = os.path.dirname(_PACKAGE)
    path = os.path.join(tempfile.mkdtemp(prefix="pairlens-code-"), "pairlens.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(_PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, top))
    spark.sparkContext.addPyFile(path)
    _SENT.add(app)
