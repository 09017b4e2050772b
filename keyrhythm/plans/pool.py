"""Several fits at the same time: their jobs share the cluster, of which one small fit leaves most idle."""

from __future__ import annotations

from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame

AT_ONCE = 4


def fitted(tasks: Sequence[tuple[Estimator, DataFrame]], at_once: int = AT_ONCE) -> list[Model]:
    """Each estimator fitted on its table, several at a time, in the order of the tasks."""
    if not tasks:
        return []
    pool = ThreadPool(min(at_once, len(tasks)))
    try:
        return pool.map(inheritable_thread_target(lambda task: task[0].copy().fit(task[1])), tasks)
    finally:
        pool.close()
