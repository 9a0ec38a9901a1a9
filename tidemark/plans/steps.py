"""Long runs in steps that can be taken up again: a step is done while its fingerprint and outputs hold."""

from __future__ import annotations

import contextlib
import fcntl
import hashlib
import json
import os
import resource
import time
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(path: str | Path, value: object) -> None:
    """Written beside its place, flushed, then renamed: a reader sees the old file or the new one."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    temp = path.with_name(f".{path.name}.{os.getpid()}")
    with open(temp, "w") as f:
        json.dump(value, f, sort_keys=True, indent=1)
        f.flush()
        os.fsync(f.fileno())
    os.replace(temp, path)


def digest(path: str | Path) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def fingerprint(**what: object) -> str:
    return hashlib.sha256(json.dumps(what, sort_keys=True, default=str).encode()).hexdigest()


class Steps:
    """Records of steps in a folder.  One process at a time holds it."""

    def __init__(self, folder: str | Path):
        self.folder = Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)

    @contextlib.contextmanager
    def held(self) -> Iterator[Steps]:
        with open(self.folder / ".lock", "w") as f:
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except OSError as e:
                raise RuntimeError(f"{self.folder} is held by another run") from e
            yield self

    def record(self, step: str) -> dict | None:
        path = self.folder / f"{step}.json"
        try:
            return json.loads(path.read_text())
        except (FileNotFoundError, json.JSONDecodeError):
            return None

    def is_done(self, step: str, mark: str) -> bool:
        """Complete under this fingerprint, with every output there as it was written."""
        r = self.record(step)
        return bool(r and r["state"] == "complete" and r["fingerprint"] == mark and all(os.path.isfile(p) and digest(p) == d for p, d in r["outputs"].items()))

    def run(self, step: str, mark: str, outputs: list[str], work: Callable[[], None], valid: Callable[[str], bool] = os.path.isfile) -> bool:
        """Do the step unless it is done; True if it was worked on.  Outputs that are there and valid, but have no
        record, are adopted; an output that isn't valid afterwards is an error and leaves the step failed."""
        if self.is_done(step, mark):
            return False
        worked = not (self.record(step) is None and all(os.path.isfile(p) and valid(p) for p in outputs))
        if worked:
            write_json(self.folder / f"{step}.json", {"step": step, "state": "running", "fingerprint": mark, "outputs": {}})
            try:
                work()
                bad = [p for p in outputs if not os.path.isfile(p) or not valid(p)]
                if bad:
                    raise ValueError(f"step {step} left {bad} missing or invalid")
            except Exception:
                write_json(self.folder / f"{step}.json", {"step": step, "state": "failed", "fingerprint": mark, "outputs": {}})
                raise
        write_json(self.folder / f"{step}.json", {"step": step, "state": "complete", "fingerprint": mark, "outputs": {p: digest(p) for p in outputs}})
        return worked


class Clock:
    """Wall and CPU seconds of this process's stages and its greatest resident set so far, as rows for ``timings``."""

    def __init__(self, process: str = "driver"):
        self.process = process
        self.rows: list[tuple[str, str, float, float, float]] = []

    @contextlib.contextmanager
    def stage(self, name: str) -> Iterator[None]:
        wall, cpu = time.perf_counter(), time.process_time()
        try:
            yield
        finally:
            peak = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024.0
            self.rows.append((self.process, name, time.perf_counter() - wall, time.process_time() - cpu, peak))


def timings(stages: DataFrame) -> DataFrame:
    """process, stage, elapsed_s, cpu_s, peak_rss_mb: the stages, a TOTAL_PROCESS row each process, and one ALL, TOTAL_RUN; seconds are
    summed, resident sets the greatest."""
    each = (F.sum("elapsed_s").alias("elapsed_s"), F.sum("cpu_s").alias("cpu_s"), F.max("peak_rss_mb").alias("peak_rss_mb"))
    columns = ("process", "stage", "elapsed_s", "cpu_s", "peak_rss_mb")
    by = stages.groupBy("process").agg(*each).withColumn("stage", F.lit("TOTAL_PROCESS"))
    whole = stages.agg(*each).withColumn("stage", F.lit("TOTAL_RUN")).withColumn("process", F.lit("ALL"))
    return stages.select(*columns).unionByName(by.select(*columns)).unionByName(whole.select(*columns))
