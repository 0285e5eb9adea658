"""What a session needs before a query runs."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Bytes that Spark hands to a Python worker at once. Its default is eight times as much, which every worker then keeps.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20


def ready(spark: SparkSession) -> SparkSession:
    """Sends this package to the Python workers, once an application, and bounds their batches where the session doesn't."""
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        top = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp()  # the driver serves the file from here until the end
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        place = f"{folder}/graphloom.zip"
        with zipfile.ZipFile(place, "w") as out:
            for p in sorted(top.rglob("*.py")):
                out.write(p, f"graphloom/{p.relative_to(top)}")
        spark.sparkContext.addPyFile(place)
        _shipped.add(app)
    return spark
