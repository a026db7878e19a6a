"""The package on the workers: Arrow kernels are pickled by reference, so the executors' Python must be able to import them."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Puts the folder of the package on the workers' path and, beyond a single machine, sends the package itself. Once an application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    root = Path(__file__).resolve().parents[2]
    paths = [str(root), *context.environment.get("PYTHONPATH", "").split(os.pathsep)]
    context.environment["PYTHONPATH"] = os.pathsep.join(dict.fromkeys(p for p in paths if p))
    if not context.master.startswith("local"):
        archive = Path(tempfile.mkdtemp(prefix="vecstrand-package-"), "vecstrand.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted((root / "vecstrand").rglob("*.py")):
                z.write(p, p.relative_to(root))
        context.addPyFile(str(archive))
