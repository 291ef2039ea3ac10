"""Runs in the background: started, waited for, told of, and interrupted.

A run is a function in a thread, whose Spark jobs carry the run's tag; to interrupt it is to
cancel the jobs of that tag, and no others.  A function should do its work and not only
plan it: write a table, or run a parameter file.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from concurrent.futures import CancelledError, Future, ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

from . import flows

#: Runs that go on at once, the others wait.
MOST = 4


class Interrupted(Exception):
    """The run was stopped from outside."""


class Run:
    """``state`` is waiting, running, done, failed or interrupted."""

    def __init__(self, spark: SparkSession, work: Callable[[], object], name: str):
        self.name, self.tag = name, f"meshlake-{uuid.uuid4().hex}"
        self._context, self._work = spark.sparkContext, work
        self._lock, self._stop, self._began = threading.Lock(), False, False
        self._future: Future | None = None

    def _go(self) -> object:
        with self._lock:
            if self._stop:
                raise Interrupted(self.name)
            self._began = True
        self._context.addJobTag(self.tag)
        try:
            out = self._work()
        except Exception as error:
            raise (Interrupted(self.name) if self._stop else error) from error
        finally:
            self._context.removeJobTag(self.tag)
        if self._stop:
            raise Interrupted(self.name)
        return out

    @property
    def state(self) -> str:
        if self._future is None or not self._future.done():
            return "running" if self._began else "waiting"
        error = self.error
        return "done" if error is None else "interrupted" if isinstance(error, Interrupted) else "failed"

    @property
    def error(self) -> BaseException | None:
        """What the run ended with, None while it goes on or if all went well."""
        if self._future is None or not self._future.done():
            return None
        return Interrupted(self.name) if self._future.cancelled() else self._future.exception()

    def result(self, timeout: float | None = None) -> object:
        """Wait for what the function returns; its error is raised here, and TimeoutError if it takes longer."""
        try:
            return self._future.result(timeout)
        except CancelledError:
            raise Interrupted(self.name) from None

    def interrupt(self) -> None:
        """Cancel the jobs of this run, now and later; one that waits does not begin, one that is over stays as it is."""
        with self._lock:
            self._stop = True
        if self._future is not None and not self._future.cancel():
            self._context.cancelJobsWithTag(self.tag)


class Runs:
    """Starts runs in a session, ``most`` of them at once; as a context, its end waits for all."""

    def __init__(self, spark: SparkSession, most: int = MOST):
        self.spark, self.all = spark, []
        self._pool = ThreadPoolExecutor(most, thread_name_prefix="meshlake-run")

    def start(self, work: Callable[[], object], name: str = "run") -> Run:
        run = Run(self.spark, work, name)
        self.all.append(run)
        run._future = self._pool.submit(inheritable_thread_target(self.spark)(run._go))
        return run

    def start_flow(self, path: str) -> Run:
        """A parameter file, see ``flows.run_flow``."""
        return self.start(lambda: flows.run_flow(self.spark, path), path)

    def states(self) -> dict[str, list[str]]:
        """The names of the runs in each state."""
        out: dict[str, list[str]] = {}
        for run in self.all:
            out.setdefault(run.state, []).append(run.name)
        return out

    def interrupt(self) -> None:
        for run in self.all:
            if run.state in ("waiting", "running"):
                run.interrupt()

    def __enter__(self) -> "Runs":
        return self

    def __exit__(self, *_: object) -> None:
        self._pool.shutdown(wait=True)
