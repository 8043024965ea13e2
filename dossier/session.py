"""Session factory: ANSI arithmetic, UTC, adaptive plans. Sizes of partitions are left to the cluster's settings."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "dossier", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.ansi.enabled": "true", **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
