"""Python workers find this package."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def known_to_workers(spark: SparkSession) -> None:
    """Let Python workers import this package.

    On a cluster Spark ships it, once for each context, from the driver to every
    executor. Local workers find it where the driver did.
    """
    sc, root = spark.sparkContext, Path(__file__).resolve().parents[1]
    if sc.master.split("[")[0] == "local":
        env = sc.environment
        known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
        if str(root) not in known:
            env["PYTHONPATH"] = os.pathsep.join([*known, str(root)])
    elif not getattr(sc, "_pitchloom_shipped", False) and root.is_dir():
        packed = Path(tempfile.mkdtemp()) / "pitchloom.zip"  # read by the driver's file server only
        with zipfile.ZipFile(packed, "w") as z:
            for path in sorted(root.glob("pitchloom/**/*.py")):
                z.write(path, path.relative_to(root))
        sc.addPyFile(str(packed))
        sc._pitchloom_shipped = True
