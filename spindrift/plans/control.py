"""Runs in waves: adaptive pulls, stop conditions, pause, cancel, resume, queued plans."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class Result:
    """What a run gives: the value, leaves and combines done, why it stopped, failed leaves."""

    value: object
    n_partitions: int = 0
    n_combines: int = 0
    stopped: str | None = None
    failed: int = 0


class RunControl:
    """RUNNING, PAUSED or CANCELLED, looked at between waves; a cancel holds for one run.

    ``stop_work`` is called by a cancel, to interrupt the wave that runs (see cancel_jobs).
    """

    def __init__(self, stop_work: Callable[[], object] | None = None):
        self._free, self._cancelled = threading.Event(), False
        self._stop_work = stop_work
        self._free.set()

    @property
    def state(self) -> str:
        return "CANCELLED" if self._cancelled else "RUNNING" if self._free.is_set() else "PAUSED"

    def pause(self) -> None:
        self._free.clear()

    def resume(self) -> None:
        self._free.set()

    def cancel(self) -> None:
        self._cancelled = True
        self._free.set()
        if self._stop_work is not None:
            self._stop_work()

    def reset(self) -> None:
        self._cancelled = False
        self._free.set()

    def passes(self) -> bool:
        """Wait while paused; false once cancelled."""
        self._free.wait()
        return not self._cancelled


@dataclass
class Progress:
    """What an adaptive plan sees before it asks for more."""

    leaves: int = 0
    entries: int = 0
    failed: int = 0
    seconds: float = 0.0
    waves: list[tuple[int, float]] = field(default_factory=list)


@dataclass(frozen=True)
class Stop:
    """Limits; the first that is met ends the run."""

    entries: int | None = None
    seconds: float | None = None
    failures: int | None = None

    def reason(self, p: Progress) -> str | None:
        if self.entries is not None and p.entries >= self.entries:
            return "entries"
        if self.seconds is not None and p.seconds >= self.seconds:
            return "seconds"
        if self.failures is not None and p.failed > self.failures:
            return "failures"
        return None


def pull(next_leaves: Callable[[Progress], list | None], process: Callable[[list], tuple[object, int]], combine: Callable, empty: Callable[[], object], stop: Stop | None = None, control: RunControl | None = None, finalize: Callable | None = None) -> Result:
    """An adaptive run: ask for leaves, run them as one bounded job, fold, until there are none.

    ``process`` runs one Spark job over the leaves and gives (value, entries).  Values are folded at
    the end, in order of each wave's first leaf, whatever the order of the waves.  A cancel gives the
    fold of the waves that were done; one that it interrupts is left out.  Cancelled before the first
    wave, the result is ``empty()``.
    """
    stop, control, p = stop or Stop(), control or RunControl(), Progress()
    out, began, why = Result(empty()), time.monotonic(), None
    done: list[tuple] = []
    try:
        while why is None:
            if not control.passes():
                why = "cancelled"
                break
            leaves = next_leaves(p)
            if not leaves:
                break
            t = time.monotonic()
            try:
                value, entries = process(leaves)
            except Exception:
                if control.state != "CANCELLED":
                    raise
                why = "cancelled"
                break
            done.append((leaves[0], value))
            out.n_partitions += len(leaves)
            p.leaves, p.entries = out.n_partitions, p.entries + entries
            p.seconds = time.monotonic() - began
            p.waves.append((len(leaves), time.monotonic() - t))
            why = stop.reason(p)
    finally:
        control.reset()
    done.sort(key=lambda d: d[0])
    if done:
        out.value = done[0][1]
        for _, value in done[1:]:
            out.value = combine(out.value, value)
        out.n_combines = len(done) - 1
    out.stopped = why
    if finalize is not None:
        out.value = finalize(out.value)
    return out


def stop_at_target(leaves: DataFrame, target: int, leaf: str = "leaf_id", entries: str = "n_entries") -> DataFrame:
    """Leaves in order until their entries reach ``target``, the one that reaches it included.

    ``leaves`` is the small table of one row a leaf.
    """
    before = F.coalesce(F.sum(entries).over(Window.orderBy(leaf).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return leaves.withColumn("before", before).where(F.col("before") < target)


class PlanQueue:
    """Plans run in the order given, at most ``in_flight`` waiting (T4)."""

    def __init__(self, in_flight: int = 8):
        if in_flight < 1:
            raise ValueError("in_flight is at least 1")
        self._pool = ThreadPoolExecutor(max_workers=1, thread_name_prefix="plans")
        self._room = threading.BoundedSemaphore(in_flight)

    def submit(self, plan: Callable[[], object]) -> Future:
        """A future of the plan's value; waits while the queue is full."""
        self._room.acquire()
        try:
            done = self._pool.submit(plan)
        except BaseException:
            self._room.release()
            raise
        done.add_done_callback(lambda _: self._room.release())
        return done

    def close(self) -> None:
        self._pool.shutdown(wait=True)

    def __enter__(self) -> PlanQueue:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def cancel_jobs(spark, tag: str) -> None:
    """Interrupt the running jobs of a tag."""
    spark.interruptTag(tag)


def in_waves(items: Iterable, size: int) -> Iterable[list]:
    """Items in lists of at most ``size``, in order."""
    held: list = []
    for item in items:
        held.append(item)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held
