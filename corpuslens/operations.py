"""Long operations on the driver: start, wait, cancel. Each runs its Spark jobs under a tag of its own, so cancelling stops them."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

#: Seconds: first wait, deadline, and how long a finished operation that nobody asks for is kept; running ones at most.
FIRST_WAIT, DEADLINE, IDLE, MOST_ACTIVE = 5.0, 600.0, 120.0, 8


class Operation:
    def __init__(self, run: Callable[[], object], spark: SparkSession, deadline: float):
        self.id, self.state, self.result, self.error = uuid.uuid4().hex, "running", None, None
        self.deadline, self.seen, self._spark = time.monotonic() + deadline, time.monotonic(), spark
        self._done = threading.Event()
        threading.Thread(target=self._work, args=(run,), daemon=True).start()

    def _work(self, run: Callable[[], object]) -> None:
        self._spark.addTag(self.id)
        try:
            result = run()
            if self.state == "running":
                self.result, self.state = result, "done"
        except Exception as e:  # noqa: BLE001  the caller gets it from wait()
            if self.state == "running":
                self.error, self.state = e, "failed"
        finally:
            self._spark.removeTag(self.id)
            self._done.set()

    def wait(self, seconds: float = FIRST_WAIT) -> str:
        """The state after at most so many seconds."""
        self.seen = time.monotonic()
        if not self._done.wait(min(seconds, max(0.0, self.deadline - self.seen))) and time.monotonic() >= self.deadline:
            self.cancel("expired")
        return self.state

    def cancel(self, state: str = "cancelled") -> None:
        if self.state == "running":
            self.state = state
            self._spark.interruptTag(self.id)


class Operations:
    """The registry of one engine."""

    def __init__(self, spark: SparkSession, deadline: float = DEADLINE):
        self.spark, self.deadline, self.all = spark, deadline, {}

    def start(self, run: Callable[[], object]) -> Operation:
        now = time.monotonic()
        self.all = {k: o for k, o in self.all.items() if o.state == "running" or now - o.seen < IDLE}
        if sum(o.state == "running" for o in self.all.values()) >= MOST_ACTIVE:
            raise RuntimeError("E_OPERATIONS_BUSY: too many operations are running")
        o = Operation(run, self.spark, self.deadline)
        self.all[o.id] = o
        return o

    def get(self, operation_id: str) -> Operation:
        if operation_id not in self.all:
            raise KeyError("E_OPERATION_NOT_FOUND")
        return self.all[operation_id]
