"""A Spark-native engine over append-only, tagged event logs."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path


def ship(spark) -> None:
    """Gives the executors' Python workers this package, once a session."""
    sc = spark.sparkContext
    if getattr(sc, "_eventlake_shipped", False):
        return
    here = Path(__file__).resolve().parent
    sc.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/eventlake", "zip", here.parent, here.name))
    sc._eventlake_shipped = True
