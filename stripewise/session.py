"""Sessions and the working folder."""

from __future__ import annotations

import re
import tempfile
import warnings

from pyspark.sql import SparkSession

_OWN: list[str] = []


def session(name: str = "stripewise", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC as time zone and ORC pushdown on; other settings as given."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for k, v in {"spark.sql.session.timeZone": "UTC", "spark.sql.orc.filterPushdown": "true", **conf}.items():
        builder = builder.config(k.replace("__", "."), v)
    spark = builder.getOrCreate()
    zone = spark.sparkContext._jvm.java.util.TimeZone.getDefault().getID()
    if zone not in ("UTC", "Etc/UTC", "GMT"):
        warnings.warn(f"the JVM's time zone is {zone}; TIMESTAMP columns of files from other zones read differently", stacklevel=2)
    return spark


def work_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir. Where that is unset in a local session a temporary one of
    this process; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.match(r"local(\[[^-]*\])?$", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="stripewise-orc-"))
    return _OWN[0]
