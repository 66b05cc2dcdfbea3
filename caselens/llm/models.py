"""Learned models, kept in the shared folder under a key made of everything they were trained on."""

from __future__ import annotations

import hashlib
import inspect
import pickle
import uuid
from collections.abc import Callable
from types import ModuleType
from typing import Any

from pyspark.sql import SparkSession

from caselens.session import shared_dir


def model_key(modules: list[ModuleType], *data: Any) -> str:
    """A key of the code that trains and of what it trains on."""
    return hashlib.sha256(repr(([inspect.getsource(m) for m in modules], data)).encode()).hexdigest()[:32]


def stored(spark: SparkSession, key: str, train: Callable[[], Any]) -> Any:
    """The model of that key: read from the shared folder, or trained now and written there.

    A model is written beside its place and renamed, so that no session reads half of one.
    """
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path
    at = path(f"{shared_dir(spark)}/caselens/models/{key}")
    fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
    if fs.exists(at):
        rows = spark.read.format("binaryFile").load(at.toString()).select("content").collect()  # one file
        return pickle.loads(bytes(rows[0].content))
    model = train()
    part = path(f"{at.toString()}-{uuid.uuid4().hex}")
    out = fs.create(part)
    out.write(bytearray(pickle.dumps(model)))
    out.close()
    fs.rename(part, at)
    return model
