"""Session construction shared by the bench, the tests and interactive use."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(master: str = "local[8]", app: str = "factloom", **conf: str) -> SparkSession:
    """A session with adaptive execution on and the UTC time zone.

    ``conf`` holds extra settings with ``.`` written as ``__``.
    """
    cores = "".join(c for c in master if c.isdigit()) or "8"
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", cores)
    )
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()
