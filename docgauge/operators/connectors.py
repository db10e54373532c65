"""The seam for models: a function of one page, run in Python workers over a table of pages."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgauge.sources.readers import PREDICTION

OUTPUT = "candidate string, run int, image string, text string, blocks string, errors string, stage1_latency double, stage2_latency double, latency double, _note string, worker_mb double, vram_mb double"


@dataclass(frozen=True)
class Calls:
    """How the whole cluster calls a service.

    The table is dealt to `workers` partitions, so no more than that many tasks
    call at once, each with at most `at_once` calls under way and its share of
    `per_minute`: whatever the cluster's size, no more calls start.  (Speculative
    copies of tasks would call once more: leave speculation off.)
    """

    per_minute: float | None = None
    workers: int = 1
    at_once: int = 1


class Pace:
    """Lets callers of all threads go on one by one, `interval` seconds apart, the first after `first` seconds."""

    def __init__(self, interval: float, first: float = 0.0, sleep=time.sleep, clock=time.perf_counter):
        self.interval, self.sleep, self.clock, self.lock = interval, sleep, clock, threading.Lock()
        self.next = clock() + first

    def wait(self) -> None:
        with self.lock:
            now = self.clock()
            at = max(now, self.next)
            self.next = at + self.interval
        self.sleep(at - now)


#: Of a worker's thread: the pace that its calls keep. Functions that travel to workers reach it by the two below.
_own = threading.local()


def keep_pace(pace: Pace | None) -> None:
    _own.pace = pace


def kept_pace() -> Pace | None:
    return getattr(_own, "pace", None)


def _in_order(rows, call, at_once: int):
    """call(row) of each row, in order, with at most `at_once` under way."""
    if at_once <= 1:
        yield from map(call, rows)
        return
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(at_once) as pool:
        under_way: deque = deque()
        for row in rows:
            if len(under_way) == at_once:
                yield under_way.popleft().result()
            under_way.append(pool.submit(call, row))
        while under_way:
            yield under_way.popleft().result()


def memory_mb() -> tuple[float | None, float | None]:
    """The most that this worker's process has held, by the operating system, and that its graphics card has, null where none answers."""
    import sys

    try:
        import resource

        own = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / (1024 if sys.platform != "darwin" else 1 << 20)
    except ImportError:
        own = None
    card = None
    torch = sys.modules.get("torch")  # a model that uses it has loaded it
    if torch is not None and torch.cuda.is_available():
        card = torch.cuda.max_memory_allocated() / (1 << 20)
    return own, card


def repeated(images: DataFrame, runs: int) -> DataFrame:
    """Every image `runs` times, with its run: one flat explode, no join."""
    return images.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))


def infer(pages: DataFrame, fn: Callable[[dict], dict], candidate: str, runs: int = 1, load: Callable[[], object] | None = None, warmup: int = 0, healthy: Callable[[], None] | None = None, limit: int = 0, calls: Calls | None = None) -> DataFrame:
    """`fn` of each page (a dict of its columns; with `load`, also of what it returns once a worker) with the time it takes.

    Before its first page a worker loads the model, asks `healthy` (which raises where the service can't be reached) and
    calls `fn` for up to `warmup` of its first pages, whose times count nowhere.  `limit` takes the first pages by image.
    A page whose function fails gives a row with the error in `_note`; where loading or `healthy` fails, all pages of the
    worker do, and other candidates go on.  `calls` bounds the rate and the calls at once over the cluster; rows of a task
    stay in order.  `worker_mb`, `vram_mb`: the most memory of the worker's process and card up to then.
    """
    import json

    from pyspark import TaskContext

    how = calls or Calls()

    def run(batches):
        pace = None
        if how.per_minute:
            part = TaskContext.get().partitionId() if TaskContext.get() else 0
            pace = Pace(60 * how.workers / how.per_minute, 60 / how.per_minute * (part % how.workers))

        def call(page):
            keep_pace(pace)
            if pace and not getattr(fn, "paced", False):
                pace.wait()
            return fn(page, model) if load else fn(page)

        def timed(page):
            began = time.perf_counter()
            try:
                got, note = ({}, down) if down else (call(page), None)
            except Exception as e:  # a page that fails must not stop the others
                got, note = {}, f"{type(e).__name__}: {e}"
            took = time.perf_counter() - began
            return (candidate, page["run"], page["image"], got.get("text", ""), json.dumps(got.get("blocks", [])), json.dumps(got.get("errors", [])), got.get("stage1_latency", 0.0), got.get("stage2_latency", 0.0), took, got.get("_note") or note, *memory_mb())

        model, down = None, None
        try:
            if healthy:
                healthy()
            model = load() if load else None
        except Exception as e:
            down = f"{type(e).__name__}: {e}"
        left = 0 if down else warmup
        for b in batches:
            rows = b.to_dict("records")
            for page in rows[:left]:
                try:
                    call(page)
                except Exception:  # told when its turn comes
                    pass
            left = max(0, left - len(rows))
            out = list(_in_order(rows, timed, how.at_once))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")]).astype({"worker_mb": "float64", "vram_mb": "float64"})

    from docgauge.operators.evaluation import first_images

    table = repeated(first_images(pages, limit), runs)
    return (table.repartition(calls.workers) if calls else table).mapInPandas(run, OUTPUT)


def guard(*names: str) -> None:
    """Refuses to go on where an environment variable or a module (`module:name`) that a connector needs is missing."""
    import importlib.util
    import os

    missing = [n for n in names if (importlib.util.find_spec(n.removeprefix("module:")) is None if n.startswith("module:") else not os.environ.get(n))]
    if missing:
        raise RuntimeError("missing: " + ", ".join(missing))


def environment(spark, wanted: dict[str, tuple[Callable[[], object], str]]) -> DataFrame:
    """Runs checks (name -> function that raises or returns a detail, severity `error` or `warning`): name, passed, detail, severity."""
    rows = []
    for name, (check, severity) in wanted.items():
        try:
            rows.append((name, True, str(check() or ""), severity))
        except Exception as e:
            rows.append((name, False, f"{type(e).__name__}: {e}", severity))
    return spark.createDataFrame(rows, "name string, passed boolean, detail string, severity string")


def parsed(inferred: DataFrame) -> DataFrame:
    """The JSON columns of `infer` as arrays."""
    kinds = dict(x.strip().split(" ", 1) for x in PREDICTION.split(", "))
    return inferred.withColumn("blocks", F.from_json("blocks", kinds["blocks"])).withColumn("errors", F.from_json("errors", kinds["errors"]))


#: What an exhausted quota and an overloaded service say; seconds to wait.
QUOTA, BUSY = ("resource_exhausted", "quota"), ("503", "unavailable")
QUOTA_WAIT, LONGEST_WAIT = 30, 30


def patient(fn: Callable[[dict], dict], attempts: int = 8, per_minute: float | None = None, sleep=time.sleep, clock=time.perf_counter) -> Callable[[dict], dict]:
    """`fn` with retries; what still fails gives no errors and says why in `_note`.

    Every attempt keeps the pace that `infer(calls=...)` sets for the cluster;
    `per_minute` sets one for this function alone, in each worker.  A second
    stage's latency counts from the first attempt, waits between attempts
    included, but not the wait for the rate before it.
    """
    own: list[Pace] = []

    def wait_for_turn() -> None:
        if per_minute:
            if not own:
                own.append(Pace(60 / per_minute, 0.0, sleep, clock))
            own[0].wait()
        elif pace := kept_pace():
            pace.wait()

    def wait_for(error: str, attempt: int) -> float:
        low = error.lower()
        if any(x in low for x in QUOTA):
            return QUOTA_WAIT
        return min(2**attempt, LONGEST_WAIT) if any(x in low for x in BUSY) else 2**attempt

    def call(page: dict) -> dict:
        wait_for_turn()
        began = clock()
        for attempt in range(attempts):
            if attempt:
                wait_for_turn()
            try:
                got = fn(page)
                return {**got, "stage2_latency": clock() - began} if "stage2_latency" in got else got
            except Exception as e:
                note = f"{type(e).__name__}: {e}"
                if attempt + 1 < attempts:
                    sleep(wait_for(str(e), attempt))
        return {"errors": [], "feedback": "", "stage2_latency": 0.0, "_note": note}

    call.paced = True
    return call


#: Names of candidates and the functions that make their connectors.
REGISTRY: dict[str, Callable[[], Callable[[dict], dict]]] = {}


def candidate(name: str):
    def register(make):
        REGISTRY[name] = make
        return make

    return register


def infer_all(pages: DataFrame, names: list[str] | None = None, runs: int = 1, warmup: int = 0, limit: int = 0, calls: Calls | None = None) -> DataFrame:
    """All named candidates (or every registered one) over the pages; each loads once a worker, and one that can't be loaded gives its pages a note."""
    out = None
    for name in names or sorted(REGISTRY):
        if name not in REGISTRY:
            raise KeyError(f"unknown candidate {name!r}; known: {', '.join(sorted(REGISTRY))}")
        one = infer(pages, lambda page, fn: fn(page), name, runs, load=REGISTRY[name], warmup=warmup, limit=limit, calls=calls)
        out = one if out is None else out.unionByName(one)
    return out
