"""Sessions: what a run needs before operators with Python parts can work anywhere."""

from __future__ import annotations

import tempfile
import threading
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Rows of an Arrow batch: texts make rows large, and a worker holds a batch in several forms.
ARROW_ROWS = 500

#: Tables are hashed by several threads at once, and the package is shipped by one of them.
SHIPPING = threading.Lock()


def ready(spark: SparkSession) -> SparkSession:
    """Ships the package to the executors once for each context, and keeps Arrow batches small unless their size was set."""
    context = spark.sparkContext
    with SHIPPING:
        if not getattr(context, "_cytoloom_shipped", False):
            root = Path(__file__).resolve().parent
            archive = Path(tempfile.mkdtemp(prefix="cytoloom-")) / "cytoloom.zip"
            with zipfile.ZipFile(archive, "w") as z:
                for path in sorted(root.rglob("*.py")):
                    z.write(path, f"{root.name}/{path.relative_to(root)}")
            context.addPyFile(str(archive))
            context._cytoloom_shipped = True
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(ARROW_ROWS))
    return spark


def local(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on one machine, with the settings that the operators expect."""
    return (
        SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", memory)
        .config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    )
