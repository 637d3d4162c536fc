"""Files from a server that bounds its requests: one token bucket for all tasks together."""

from __future__ import annotations

import time
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame

#: Requests a second, and seconds until one is given up, unless the caller says otherwise.
RATE, TIMEOUT = 10.0, 30.0

Get = Callable[[str, float], bytes]


class Bucket:
    """``rate`` tokens a second, ``burst`` at most and at the start; ``take`` waits for one."""

    def __init__(self, rate: float, burst: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        if rate <= 0 or burst < 1:
            raise ValueError("a bucket needs a rate above 0 and room for a token")
        self.rate, self.burst, self.clock, self.sleep = rate, burst, clock, sleep
        self.tokens, self.at = burst, clock()

    def take(self) -> None:
        now = self.clock()
        self.tokens = min(self.burst, self.tokens + (now - self.at) * self.rate)
        self.at = now
        if self.tokens < 1:
            wait = (1 - self.tokens) / self.rate
            self.sleep(wait)
            self.tokens, self.at = 1.0, now + wait
        self.tokens -= 1


def by_agent(agent: str) -> Get:
    """Plain requests that name their sender."""

    def get(url: str, timeout: float) -> bytes:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=timeout) as reply:
            return reply.read()

    return get


def fetched(urls: DataFrame, url: Column, get: Get, rate: float = RATE, timeout: float = TIMEOUT, tasks: int = 4) -> DataFrame:
    """(url, content, error) for each row: what could not be had is null with the reason.

    Rows are dealt to ``tasks`` tasks that run at once, each with its share of ``rate`` and of the burst (as large as the rate, one token a
    task at least), so all together keep to it whatever the cluster's size; a task that is run again asks again. A null url is an error row.
    Write the result before it is used twice: every run is a round of requests.
    """
    if tasks < 1:
        raise ValueError("no tasks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = Bucket(rate / tasks, max(1.0, rate / tasks))
        for batch in batches:
            for at in batch.column(0).to_pylist():  # a file may be large: a batch for each
                content, error = None, None
                try:
                    if at is None:
                        raise ValueError("no url")
                    bucket.take()
                    content = get(at, timeout)
                except (OSError, ValueError) as e:
                    error = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.string()), pa.array([content], pa.binary()), pa.array([error], pa.string())], ["url", "content", "error"])

    return urls.select(url.alias("url")).repartition(tasks).mapInArrow(run, "url string, content binary, error string")
