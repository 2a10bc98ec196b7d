"""The repository's packages on the Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()


def ship(spark) -> None:
    """Hand this repository's packages to the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="tickloom-py-"), "tickloom_packages.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for package in ("tickloom", "workload"):
            for folder, _, files in os.walk(os.path.join(_ROOT, package)):
                for name in files:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        archive.write(full, os.path.relpath(full, _ROOT))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
