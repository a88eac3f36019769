"""Session helpers."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ensure_workers(spark: SparkSession) -> SparkSession:
    """Let Python workers on this machine import the package; on a cluster it comes with ``--py-files``."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def with_workers(f: Callable) -> Callable:
    """``f(spark, ...)`` after ``ensure_workers``."""

    @wraps(f)
    def run(spark, *args):
        return f(ensure_workers(spark), *args)

    return run


def with_settings(spark: SparkSession, settings: dict[str, str]) -> SparkSession:
    """A session with the caller's settings and these: they hold for what is made with it, also as the caller writes it, and for nothing else."""
    out = spark.newSession()
    for k, v in (spark.conf.getAll | settings).items():
        if out.conf.get(k, None) != v:
            out.conf.set(k, v)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only on a single machine (master ``local``, as in tests) is a local folder used where none is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "/tmp/checkpoints"
        os.makedirs(found, exist_ok=True)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/quillgrid/{name}-{uuid.uuid4().hex}"
