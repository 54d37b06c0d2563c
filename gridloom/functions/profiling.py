"""Operation events of the driver's own calls: a decorator and a context manager that feed the profile summaries."""

from __future__ import annotations

import functools
import time
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

EVENTS = "name string, level int, started double, elapsed double, failed boolean"


class Profiler:
    """Collects an event for each call; ``frame`` gives them as rows for level_breakdown, cycle_stats and the like.

    The newest ``most`` events are held. A frame is only timed if the call runs its job, so decorate
    functions that write, count or checkpoint.
    """

    def __init__(self, most: int = 100_000):
        self.most, self.events = most, []

    @contextmanager
    def measure(self, name: str, level: int = 0):
        started, begun, failed = time.time(), time.perf_counter(), True
        try:
            yield
            failed = False
        finally:
            self.events.append((name, level, started, time.perf_counter() - begun, failed))
            del self.events[: -self.most]

    def timed(self, name: str | None = None, level: int = 0) -> Callable:
        """Decorator; the function's own name unless another is given."""

        def wrap(f):
            @functools.wraps(f)
            def called(*args, **kw):
                with self.measure(name or f.__name__, level):
                    return f(*args, **kw)

            return called

        return wrap

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.events, EVENTS)
