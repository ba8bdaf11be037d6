"""Sessions with the settings that the library expects."""

from __future__ import annotations

import copy
import functools
import tempfile
import time
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def get_session(app: str = "forumlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; a cluster's own master and memory settings are left alone."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a context, so that Python workers can import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_forumlens_sent", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="forumlens-"), "forumlens_code.zip")
    with zipfile.ZipFile(target, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(target))
    context._forumlens_sent = True


def remembered(seconds: float = 30, most: int = 128, clock=time.monotonic):
    """Decorator for functions that end in small driver-side results: kept for some seconds, the oldest going first.

    Callers get copies, so that changing a result changes no other caller's.
    """

    def wrap(f):
        kept: dict = {}

        @functools.wraps(f)
        def call(*args, **kwargs):
            key = (args, tuple(sorted(kwargs.items())))
            at, value = kept.get(key, (None, None))
            if at is None or clock() - at >= seconds:
                kept.pop(key, None)
                kept[key] = clock(), (value := f(*args, **kwargs))
                while len(kept) > most:
                    kept.pop(next(iter(kept)))
            return copy.deepcopy(value)

        return call

    return wrap
