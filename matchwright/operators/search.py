"""Random search over configurations, and ladders of growing sizes."""

from __future__ import annotations

import math
import random
import resource
import threading
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Uniform:
    low: float
    high: float
    digits: int = 4

    def draw(self, rng: random.Random, _: dict):
        return round(rng.uniform(self.low, self.high), self.digits)


@dataclass(frozen=True)
class LogUniform:
    low: float
    high: float
    integer: bool = False

    def draw(self, rng: random.Random, _: dict):
        value = math.exp(rng.uniform(math.log(self.low), math.log(self.high)))
        return int(round(value)) if self.integer else value


@dataclass(frozen=True)
class Integer:
    low: int
    high: int

    def draw(self, rng: random.Random, _: dict):
        return rng.randint(self.low, self.high)


@dataclass(frozen=True)
class Choice:
    options: tuple

    def draw(self, rng: random.Random, _: dict):
        return rng.choice(self.options)


@dataclass(frozen=True)
class When:
    """Drawn only if an earlier parameter has one of some values; else None."""

    name: str
    values: tuple
    space: object

    def draw(self, rng: random.Random, so_far: dict):
        return self.space.draw(rng, so_far) if so_far.get(self.name) in self.values else None


def sample_configs(space: dict, count: int, seed: int = 42) -> list[dict]:
    """Configurations in a fixed order for a seed."""
    rng, out = random.Random(seed), []
    for i in range(count):
        config: dict = {"config_id": i + 1}
        for name, s in space.items():
            config[name] = s.draw(rng, config)
        out.append(config)
    return out


def classify_failure(error: BaseException, timed_out: bool) -> str:
    text = str(error)
    if timed_out:
        return "TIMEOUT"
    return "OOM" if any(x in text for x in ("OutOfMemoryError", "Java heap space", "Container killed", "exit code 137")) or isinstance(error, MemoryError) else "ERROR"


def peak_memory_mb() -> float:
    """Of this Python process. The JVM's is in executor metrics, which it leaves out."""
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024


def executor_memory_mb(spark: SparkSession) -> float:
    """Storage and execution memory that executors hold now, of all."""
    status = spark.sparkContext._jsc.sc().getExecutorMemoryStatus()
    total, it = 0.0, status.values().iterator()
    while it.hasNext():
        pair = it.next()
        total += pair._1() - pair._2()
    return total / 1e6


def run_config(spark: SparkSession, config: dict, work: Callable[[dict], dict], timeout_s: float | None = None) -> dict:
    """``work``'s result with status, seconds and memory. Beyond the timeout the
    configuration's own jobs are cancelled; other failures become a status."""
    group, timed_out = f"config-{config.get('config_id')}-{time.time_ns()}", threading.Event()

    def cancel() -> None:
        timed_out.set()
        spark.sparkContext.cancelJobGroup(group)

    timer = threading.Timer(timeout_s, cancel) if timeout_s else None
    began = time.monotonic()
    spark.sparkContext.setJobGroup(group, str(config)[:200], interruptOnCancel=True)
    try:
        if timer:
            timer.start()
        got = {"status": "OK", **work(config)}
        if timed_out.is_set():
            got["status"] = "TIMEOUT"
    except Exception as error:  # noqa: BLE001 a failed configuration is a result of the search
        got = {"status": classify_failure(error, timed_out.is_set()), "error": str(error)[:500]}
    finally:
        if timer:
            timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return config | got | {"time_sec": round(time.monotonic() - began, 3), "peak_mem_mb": round(peak_memory_mb(), 1)}


def search(spark: SparkSession, configs: Iterable[dict], work: Callable[[dict], dict], timeout_s: float = 5400.0, after_each: Callable[[list[dict]], None] | None = None) -> list[dict]:
    """All configurations in turn; ``after_each`` gets the rows so far, to save them."""
    rows: list[dict] = []
    for config in configs:
        rows.append(run_config(spark, config, work, timeout_s))
        if after_each:
            after_each(rows)
    return rows


def ladder(spark: SparkSession, sizes: Iterable[int], load: Callable[[int], DataFrame | None], work: Callable[[DataFrame], dict], timeout_s: float | None = None, after_each: Callable[[list[dict]], None] | None = None) -> list[dict]:
    """One frozen configuration over growing sizes: rows OK, SKIPPED (no input), TIMEOUT,
    OOM or ERROR, with seconds for loading and for the work."""
    rows: list[dict] = []
    for size in sizes:
        began = time.monotonic()
        data = load(size)
        if data is None:
            rows.append({"size": size, "status": "SKIPPED"})
        else:
            load_s = round(time.monotonic() - began, 3)
            rows.append(run_config(spark, {"config_id": size, "size": size, "load_sec": load_s}, lambda _: work(data), timeout_s))
        if after_each:
            after_each(rows)
    return rows
