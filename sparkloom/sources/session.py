"""What a session needs before Python code of this package runs on its executors."""

from __future__ import annotations

import re
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parents[1]
#: Folders of sessions without ``spark.checkpoint.dir``, by application.
_OWN: dict[str, str] = {}


def with_package(spark: SparkSession) -> SparkSession:
    """``spark``, with this package sent to its executors once for each context."""
    json_settings(spark)
    context = spark.sparkContext
    if getattr(context, "_sparkloom_sent", None) is None:
        folder = tempfile.mkdtemp(prefix="sparkloom-")
        context.addPyFile(shutil.make_archive(f"{folder}/sparkloom", "zip", _PACKAGE.parent, _PACKAGE.name))
        context._sparkloom_sent = True
    return spark


def json_settings(spark: SparkSession) -> SparkSession:
    """``spark``, set to take the last of repeated keys in JSON, as forms' scripts do, instead of an error."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``, which all executors share.

    Where that is unset a session on one machine, as in tests, gets a folder of
    its own; on a cluster executors couldn't read such a folder, so it raises.
    """
    name = spark.sparkContext.applicationId
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return f"{folder.rstrip('/')}/{name}"
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if name not in _OWN:
        _OWN[name] = f"file://{tempfile.mkdtemp(prefix='sparkloom-')}"
    return _OWN[name]
