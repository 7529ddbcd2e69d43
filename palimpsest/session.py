"""Session defaults and table loading.

Everything that depends on the size of the data (shuffle partitions, split sizes, broadcast
limits) is left to the session that runs the query, with adaptive execution on.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults of this package; an active session is reused."""
    builder = SparkSession.builder.appName("palimpsest")
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def load_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``directory`` (a path or any URI that Spark reads)."""
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Lets executors import this package, once to a context: they need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_palimpsest_shipped", False):
        return
    top = Path(__file__).parent
    if top.is_dir():
        folder = tempfile.mkdtemp(prefix="palimpsest-code-")
        atexit.register(shutil.rmtree, folder, True)
        with zipfile.ZipFile(f"{folder}/palimpsest.zip", "w") as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f"palimpsest/{f.relative_to(top)}")
        context.addPyFile(f"{folder}/palimpsest.zip")
    context._palimpsest_shipped = True
