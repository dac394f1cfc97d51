"""Samples of the machine's load as a table that a stream can follow."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from plotweave.plans.tasks import cpu_percent

SCHEMA = "ts timestamp, cpu_pct double, memory_pct double"


def memory_percent() -> float:
    """Used share of memory, from ``/proc/meminfo``."""
    rows = dict(line.split(":", 1) for line in Path("/proc/meminfo").read_text().splitlines())
    total, free = (int(rows[k].split()[0]) for k in ("MemTotal", "MemAvailable"))
    return 100.0 * (1 - free / total)


def sample(folder: str | Path, samples: int, every_seconds: float = 5.0, cpu: Callable[[], float] | None = None,
           memory: Callable[[], float] = memory_percent, sleep: Callable[[float], None] = time.sleep) -> list[Path]:
    """Write ``samples`` one-line CSV files, each complete before it has its name."""
    folder, cpu, out = Path(folder), cpu or cpu_percent(), []
    folder.mkdir(parents=True, exist_ok=True)
    for i in range(samples):
        at = datetime.now(timezone.utc).isoformat()
        fresh = folder / f".{i:08d}.tmp"
        fresh.write_text(f"{at},{cpu():.2f},{memory():.2f}\n")
        out.append(fresh.rename(folder / f"sample-{at.replace(':', '')}-{i:08d}.csv"))
        if i + 1 < samples:
            sleep(every_seconds)
    return out


def follow_samples(spark: SparkSession, folder: str) -> DataFrame:
    """The samples of a folder as a stream."""
    return spark.readStream.schema(SCHEMA).csv(folder)
