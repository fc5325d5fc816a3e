"""A registry of collections behind a bounded pool, with metrics, a memory breaker and settings from the environment.

Requests run on ``workers`` threads, each as Spark jobs of a fair pool; beyond ``queue`` waiting requests the caller's own thread does
the work.  Before a search, a write, a deletion or a lookup the breaker looks at the driver's heap: above ``heap_share``
it asks for a collection, at most once in ``cooldown_s``, and if that does not help the request is refused.  Counting,
health and changes of collections are never refused.
"""

from __future__ import annotations

import os
import threading
import time
from collections import defaultdict
from collections.abc import Callable, Mapping
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, fields

from facetry.sources.collection import Registry

INVALID_ARGUMENT, EXHAUSTED, INTERNAL, OK = "INVALID_ARGUMENT", "RESOURCE_EXHAUSTED", "INTERNAL", "OK"


class Exhausted(RuntimeError):
    """Too little memory is left for the request."""


@dataclass(frozen=True)
class Settings:
    workers: int = os.cpu_count() or 4
    queue: int = 1000
    heap_share: float = 0.95
    cooldown_s: float = 30.0
    metrics: bool = True

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Settings:
        """``FACETRY_WORKERS`` and so on; what is not set keeps its default, what cannot be read is an error."""
        env = os.environ if env is None else env
        found = {}
        for f in fields(cls):
            raw = env.get(f"FACETRY_{f.name.upper()}")
            if raw is not None:
                found[f.name] = raw.lower() in ("1", "true", "yes") if f.type == "bool" else (int if f.type == "int" else float)(raw)
        return cls(**found)


class Metrics:
    """Counts and seconds by operation and outcome, in the common text form."""

    BOUNDS = (0.005, 0.025, 0.1, 0.5, 1.0, 5.0, 30.0)

    def __init__(self, enabled: bool = True):
        self.enabled, self._lock = enabled, threading.Lock()
        self.counts: dict[tuple[str, str], int] = defaultdict(int)
        self.seconds: dict[str, float] = defaultdict(float)
        self.buckets: dict[str, list[int]] = defaultdict(lambda: [0] * (len(self.BOUNDS) + 1))

    def record(self, operation: str, outcome: str, seconds: float) -> None:
        if not self.enabled:
            return
        with self._lock:
            self.counts[operation, outcome] += 1
            self.seconds[operation] += seconds
            self.buckets[operation][sum(seconds > b for b in self.BOUNDS)] += 1

    def text(self) -> str:
        with self._lock:
            lines = ["# TYPE facetry_requests_total counter"]
            lines += [f'facetry_requests_total{{operation="{o}",outcome="{c}"}} {n}' for (o, c), n in sorted(self.counts.items())]
            lines.append("# TYPE facetry_request_seconds histogram")
            for o, each in sorted(self.buckets.items()):
                total = 0
                for bound, n in zip((*self.BOUNDS, "+Inf"), each, strict=True):
                    total += n
                    lines.append(f'facetry_request_seconds_bucket{{operation="{o}",le="{bound}"}} {total}')
                lines += [f'facetry_request_seconds_sum{{operation="{o}"}} {self.seconds[o]:.6f}', f'facetry_request_seconds_count{{operation="{o}"}} {total}']
        return "\n".join(lines) + "\n"


class Breaker:
    def __init__(self, used_share: Callable[[], float], collect: Callable[[], None], settings: Settings, clock=time.monotonic):
        self._used, self._collect, self.settings, self._clock = used_share, collect, settings, clock
        self._last, self._lock = None, threading.Lock()

    @property
    def open(self) -> bool:
        return self._used() >= self.settings.heap_share

    def check(self) -> None:
        if not self.open:
            return
        with self._lock:
            now = self._clock()
            if self._last is None or now - self._last >= self.settings.cooldown_s:
                self._last = now
                self._collect()
        if self.open:
            raise Exhausted("the driver's heap is nearly full")


class Service:
    GUARDED = frozenset(("search", "index", "delete_by_query", "lookup"))

    def __init__(self, registry: Registry, settings: Settings | None = None, breaker: Breaker | None = None):
        self.registry, self.settings = registry, settings or Settings.from_env()
        runtime = registry.spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
        used = lambda: (runtime.totalMemory() - runtime.freeMemory()) / runtime.maxMemory()
        self.breaker = breaker or Breaker(used, runtime.gc, self.settings)
        self.metrics = Metrics(self.settings.metrics)
        self._pool = ThreadPoolExecutor(self.settings.workers, thread_name_prefix="facetry")
        self._room = threading.BoundedSemaphore(self.settings.workers + self.settings.queue)

    def call(self, operation: str, collection: str = "", *args, **kwargs):
        """Runs an operation of a collection, or of the registry where ``collection`` is None."""
        began, outcome = time.perf_counter(), INTERNAL
        try:
            if operation in self.GUARDED:
                self.breaker.check()
            self.registry.spark.sparkContext.setLocalProperty("spark.scheduler.pool", operation)
            target = self.registry if collection is None else self.registry.get(collection)
            result, outcome = getattr(target, operation)(*args, **kwargs), OK
            return result
        except ValueError:
            outcome = INVALID_ARGUMENT
            raise
        except Exhausted:
            outcome = EXHAUSTED
            raise
        finally:
            self.metrics.record(operation, outcome, time.perf_counter() - began)

    def submit(self, operation: str, collection: str = "", *args, **kwargs) -> Future:
        """As ``call``, on the pool; where the queue is full, here and now."""
        if self._room.acquire(blocking=False):
            future = self._pool.submit(self.call, operation, collection, *args, **kwargs)
            future.add_done_callback(lambda _: self._room.release())
            return future
        future = Future()
        try:
            future.set_result(self.call(operation, collection, *args, **kwargs))
        except Exception as e:
            future.set_exception(e)
        return future

    def health(self) -> dict:
        return {"memory_breaker_open": self.breaker.open, "collections": self.registry.health()}

    def close(self) -> None:
        self._pool.shutdown()


def code_of(error: BaseException | None) -> str:
    """The status of a request that ended so."""
    if error is None:
        return OK
    return INVALID_ARGUMENT if isinstance(error, ValueError) else EXHAUSTED if isinstance(error, Exhausted) else INTERNAL
