"""Executors import this package, too: each Spark context is given it once, as a zip."""

from __future__ import annotations

import os
import tempfile
import zipfile
from functools import wraps
from pathlib import Path


def ship(spark) -> None:
    context = spark.sparkContext
    if getattr(context, "_arkose_shipped", False):
        return
    package = Path(__file__).resolve().parent
    folder = os.path.realpath(tempfile.mkdtemp(prefix="arkose-"))  # Spark copies it from here
    target = f"{folder}/arkose_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(target)
    context._arkose_shipped = True


def shipped(f):
    """For operators whose first argument is a DataFrame or a session."""

    @wraps(f)
    def run(first, *args, **options):
        ship(getattr(first, "sparkSession", None) or first)
        return f(first, *args, **options)

    return run
