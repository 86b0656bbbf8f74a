"""Repeated full scans of a file or folder, timed, with memory before and after."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError, guarded, invalid
from ..sources.store import resource_snapshot

# Defaults of a run.
DEFAULTS = {"iterations": 25, "warmup": 2, "batch_size": 4096, "prefetch_depth": 1, "max_memory_growth": None, "assert_no_leaks": True}


@dataclass(frozen=True)
class Report:
    path_kind: str
    files: int
    iterations: int
    rows: int
    batches: int
    min_ms: int
    avg_ms: int
    max_ms: int
    memory_before: dict
    memory_after: dict
    peak_rss: int
    samples: list = field(repr=False, default_factory=list)


def sample_memory(spark: SparkSession) -> dict[str, int]:
    """Bytes: this process, and the JVM's used heap after a collection."""
    with open("/proc/self/statm") as f:
        rss = int(f.read().split()[1]) * 4096
    spark._jvm.System.gc()
    runtime = spark._jvm.Runtime.getRuntime()
    return {"rss": rss, "jvm_heap": runtime.totalMemory() - runtime.freeMemory()}


def measure(spark: SparkSession, path: str, **options) -> Report:
    """Scans every row and column ``iterations`` times after ``warmup`` scans; ``path`` is a file or a folder of ``.parquet`` files at any depth."""
    if set(options) - set(DEFAULTS):
        raise invalid("stress", "unknown options")
    o = DEFAULTS | options
    for name, least in (("iterations", 1), ("warmup", 0), ("batch_size", 1), ("prefetch_depth", 1)):
        if isinstance(o[name], bool) or not isinstance(o[name], int) or o[name] < least:
            raise invalid("stress", f"{name} is out of range")
    with guarded("stress"):
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(jpath):
            raise EngineError("not_found", "stress", "object not found")
        folder = fs.getFileStatus(jpath).isDirectory()
        df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(path) if folder else spark.read.parquet(path)
        files = len(df.inputFiles())
        if not files:
            raise EngineError("not_found", "stress", "no Parquet files")

        def once() -> tuple[int, int, float]:
            # every column is decoded: a hash of all of them is what is counted
            began = time.monotonic()
            part = df.select(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)).alias("h"))
            per_task = part.groupBy(F.spark_partition_id().alias("p")).agg(F.count("h").alias("n"))
            r = per_task.agg(F.sum("n").alias("rows"), F.sum(F.ceil(F.col("n") / o["batch_size"])).alias("batches")).first()
            return r["rows"] or 0, r["batches"] or 0, (time.monotonic() - began) * 1000

        for _ in range(o["warmup"]):
            once()
        leaks, before = resource_snapshot(), sample_memory(spark)
        runs, peak = [], before["rss"]
        for _ in range(o["iterations"]):
            runs.append(once())
            with open("/proc/self/statm") as f:
                peak = max(peak, int(f.read().split()[1]) * 4096)
        after = sample_memory(spark)
    took = [int(r[2]) for r in runs]
    if len({r[0] for r in runs}) > 1:
        raise EngineError("conflict", "stress", "scans of the same data gave different row counts")
    if o["assert_no_leaks"] and resource_snapshot() != leaks:
        raise EngineError("native_failure", "stress", "readers or writers were left open")
    if o["max_memory_growth"] is not None and after["rss"] - before["rss"] > o["max_memory_growth"]:
        raise EngineError("native_failure", "stress", "memory grew by more than max_memory_growth")
    return Report("folder" if folder else "file", files, len(runs), sum(r[0] for r in runs), sum(r[1] for r in runs), min(took), sum(took) // len(took), max(took), before, after, peak, took)


def run(spark: SparkSession, path: str, **options) -> str:
    """``measure`` without its report."""
    measure(spark, path, **options)
    return "ok"
