"""Make this package importable on every executor."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession, extra: tuple[str, ...] = ()) -> None:
    """Send the package (and top-level modules in ``extra``) to the executors, once per application.

    Python functions are pickled by reference, so workers must be able to import them.  The archive travels through
    Spark's own file server; no shared folder is needed.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    root = package.parent
    target = os.path.join(tempfile.mkdtemp(prefix="lumenframe-"), "lumenframe_package.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(root))
        for name in extra:
            if (root / name).exists():
                z.write(root / name, name)
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)
