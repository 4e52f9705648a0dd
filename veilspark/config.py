"""Settings of a run."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession

from . import constants as C

# Spark hides the values of settings whose name says that they are secret.
KEY_CONF = "spark.veilspark.secret.key"
OLD_KEY_CONF = "spark.veilspark.key"
KEY_ENV = "VEILSPARK_KEY"


@dataclass(frozen=True)
class DetectConfig:
    """How to detect.

    strict          False (default): a `+91` prefix belongs to the phone number; the
                    overlap exclusion of bank / IFSC / UPI runs after the context test;
                    a recognised person or place may only be relabelled as the other.
                    True: `+91…` digits count as AADHAAR, the exclusion runs before the
                    context test, and a relabel may pick any context-bound type.
    structured      use `label: value` pairs found in the text
    recogniser      "cue" (name shapes and known places) or "none"
    ner_fn          optional `fn(text) -> [(start, end, label)]` with labels PERSON, GPE,
                    LOC, FAC; replaces the built-in recogniser (see `operators.tagger`)
    ner_col         optional column of such spans, as (start, end, label), found before; with
                    `ner_fn` both count
    min_confidence  drop results below this value
    window          characters of context on each side
    """

    strict: bool = False
    structured: bool = True
    recogniser: str = "cue"
    ner_fn: Callable | None = None
    ner_col: str | None = None
    min_confidence: float = 0.0
    window: int = C.CONTEXT_WINDOW


def secret_key(spark: SparkSession) -> str:
    """The vault key from Spark configuration or the environment; there is no default."""
    key = spark.conf.get(KEY_CONF, None) or spark.conf.get(OLD_KEY_CONF, None) or os.environ.get(KEY_ENV)
    if not key:
        raise ValueError(f"set {KEY_CONF} or the environment variable {KEY_ENV}")
    return key


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder for a table that cuts lineage, in the cluster's shared folder.

    The folder named by `spark.checkpoint.dir` is used. Only a local session without
    that setting falls back to a temporary folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="veilspark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
