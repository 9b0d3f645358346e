"""Objects that a Python worker builds once and keeps for its later tasks."""

from __future__ import annotations

import pickle
import sys
import types
import uuid
from collections.abc import Callable
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import SparkSession

#: Kept at a time; the oldest goes first.
MAX_OBJECTS = 6


def per_worker(key: tuple, make: Callable[[], Any]) -> Any:
    """The object under ``key`` in this Python process, made at its first use."""
    held = sys.modules.setdefault("loomset_worker_objects", types.ModuleType("loomset_worker_objects"))
    objects = held.__dict__.setdefault("objects", {})
    if key not in objects:
        while len(objects) >= MAX_OBJECTS:
            objects.pop(next(iter(objects)))
        objects[key] = make()
    return objects[key]


def share(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """A function that gives ``value`` in tasks. It travels once to each executor, with its class."""
    sent, name = spark.sparkContext.broadcast(cloudpickle.dumps(value)), uuid.uuid4().hex
    return lambda: per_worker(("shared", name), lambda: pickle.loads(sent.value))
