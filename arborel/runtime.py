"""Ships this package to the executors, for the Python workers of plans that need some."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip to the context, once; workers that can import it already are not changed."""
    context = spark.sparkContext
    if any(path.endswith("/arborel.zip") for path in context._python_includes) or any(str(x).endswith("arborel.zip") for x in getattr(context, "_arborel", ())):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="arborel-"), "arborel.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(home):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("arborel", os.path.relpath(full, home)))
    context.addPyFile(path)
    context._arborel = (path,)
