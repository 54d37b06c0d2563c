"""A streaming source of this machine's load, as a Python data source."""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SCHEMA = "ts timestamp, host string, metric string, value double"


def sample() -> list[tuple]:
    """(ts, host, metric, value) rows of now; memory and processors only where psutil is installed."""
    import datetime
    import os
    import socket

    now, host = datetime.datetime.now(datetime.UTC).replace(tzinfo=None), socket.gethostname()
    rows = [(now, host, "load", float(os.getloadavg()[0]))]
    try:
        import psutil
    except ImportError:
        return rows
    return [*rows, (now, host, "cpu", float(psutil.cpu_percent())), (now, host, "memory", float(psutil.virtual_memory().percent))]


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, pause: float):
        self.pause, self.kept = pause, {}

    def initialOffset(self) -> dict:
        return {"n": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        time.sleep(self.pause)
        rows = sample()
        self.kept[start["n"]] = rows
        return iter(rows), {"n": start["n"] + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([r for n in range(start["n"], end["n"]) for r in self.kept.get(n, [])])

    def commit(self, end: dict) -> None:
        for n in [k for k in self.kept if k < end["n"]]:
            del self.kept[n]


class SystemMetrics(DataSource):
    """spark.dataSource.register(SystemMetrics); spark.readStream.format("system_metrics").load()"""

    @classmethod
    def name(cls) -> str:
        return "system_metrics"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> _Reader:
        return _Reader(float(self.options.get("pause", "0.1")))
