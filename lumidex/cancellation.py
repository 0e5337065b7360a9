"""Work that can be stopped from another thread, or by a callback that reports progress."""

from __future__ import annotations

import contextlib
import threading
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession

#: Told what is done, of how many, and a message; false stops the work.
Progress = Callable[[int, int, str], bool]


class Stopped(Exception):
    """Raised between two steps of work that is to stop."""


class Cancellation:
    """Stops the Spark jobs that run under it, and the steps that would follow them.

    ``cancel()`` may be called from any thread, at any time, also before the work starts.
    """

    def __init__(self, progress: Progress | None = None):
        self.tag = f"lumidex-{uuid.uuid4().hex}"
        self.progress = progress
        self._asked = threading.Event()
        self._spark: SparkSession | None = None

    @property
    def asked(self) -> bool:
        return self._asked.is_set()

    def cancel(self) -> None:
        self._asked.set()
        threading.Thread(target=self._interrupt, daemon=True).start()

    def _interrupt(self) -> None:
        """Again and again, as a job may be about to start."""
        while (spark := self._spark) is not None:
            spark.sparkContext.cancelJobsWithTag(self.tag)
            time.sleep(0.3)

    def step(self, done: int, total: int, message: str) -> None:
        """Reports progress; raises if the work is to stop, by the callback's answer or since it was cancelled."""
        if self.progress is not None and self.progress(done, total, message) is False:
            self._asked.set()
        if self.asked:
            raise Stopped(message)

    @contextlib.contextmanager
    def over(self, spark: SparkSession) -> Iterator[None]:
        """Jobs in here have the tag; what they raise once they are cancelled ends here."""
        spark.sparkContext.addJobTag(self.tag)
        self._spark = spark
        try:
            yield
        except Exception:
            if not self.asked:
                raise
        finally:
            self._spark = None
            spark.sparkContext.removeJobTag(self.tag)
