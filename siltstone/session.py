"""Session factory used by bench.py and the tests; a cluster brings its own session."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "siltstone", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time zone, ANSI mode and adaptive execution; `conf` entries win over the defaults."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=settings).getOrCreate()
