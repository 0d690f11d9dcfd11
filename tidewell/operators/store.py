"""A durable store: an append-only log, immutable sorted segments in levels, and a versioned manifest.

A write appends a batch to the log (Parquet, one folder per batch). Rows that no segment holds yet are the memtable;
when they outgrow `memtable_max_bytes` they become a level-0 segment: one row per key, range-partitioned and sorted by
key, with Parquet statistics and a Bloom filter on the key. A manifest version lists segments and the last flushed
batch; it is written under a fresh name and published by an atomic rename, so a reader sees one version or the next.
Files that no version needs go only in vacuum(). One process writes at a time, from any number of threads: writes and
flushes follow each other, compactions run beside them; any number of readers.

Opening a store reads the latest manifest and takes the batches after it as memtable: that is recovery. Of a key's
versions the greatest (ts, seq) wins wherever it lies; seq is (batch, row), and rows count on through the partitions
of a batch, however many. A batch that comes from a stream carries the stream's name and its micro-batch number in its
folder's name and, once flushed, in the manifest, so that a micro-batch that is sent again changes nothing.
"""

from __future__ import annotations

import hashlib
import json
import threading
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import wait as ended
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kv

SCHEMA = "key BINARY, value BINARY, ts BIGINT, seq STRUCT<batch: BIGINT, row: BIGINT>, op STRING"


@dataclass
class Config:
    memtable_max_bytes: int = 64 << 20
    tombstone_retention_ms: int = 86_400_000
    segment_max_bytes: int = 64 << 20
    max_levels: int = 6


@dataclass
class Manifest:
    version: int = 0
    flushed_batch: int = 0
    last_ts: int = 0
    segments: list[dict] = field(default_factory=list)
    streams: dict[str, int] = field(default_factory=dict)  # of each stream, the last micro-batch that is flushed

    def level(self, n: int) -> list[dict]:
        """Segments of a level in the order added; none for a level out of range."""
        return [s for s in self.segments if s["level"] == n]


class Store:
    def __init__(self, spark: SparkSession, path: str, config: Config | None = None):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config or Config()
        jvm = spark._jvm
        self._hpath = jvm.org.apache.hadoop.fs.Path
        self._fs = self._hpath(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        for d in ("log", "segments", "manifest"):
            self._fs.mkdirs(self._hpath(f"{self.path}/{d}"))
        self._writer, self._state = threading.RLock(), threading.RLock()  # appends and flushes; manifest and memtable
        self.manifest = self._load()
        batches = self._batches()
        done = {b: n for b, n in batches.items() if b > self.manifest.flushed_batch}
        self._next = max([self.manifest.flushed_batch, *batches]) + 1
        self._pending = done
        last, size = self._rows(done).agg(F.max("ts"), F.sum(kv.entry_bytes())).first() if done else (0, 0)
        self._clock, self._size = max(self.manifest.last_ts, last or 0), size or 0

    # files

    def _names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._hpath(f"{self.path}/{folder}"))]

    def _batches(self) -> dict[int, str]:
        """Log batches whose write was committed: their folders by number."""
        whole = (n for n in self._names("log") if n.startswith("batch=") and self._fs.exists(self._hpath(f"{self.path}/log/{n}/_SUCCESS")))
        return {int(n[6:16]): n for n in sorted(whole)}

    def _seen(self) -> dict[str, int]:
        """Of each stream, the last micro-batch that the manifest or the memtable holds."""
        seen = dict(self.manifest.streams)
        for name in self._pending.values():
            _, *source = name.split("~")
            if source:
                seen[source[0]] = max(seen.get(source[0], -1), int(source[1]))
        return seen

    def _load(self) -> Manifest:
        found = sorted(n for n in self._names("manifest") if n.startswith("v"))
        if not found:
            return Manifest()
        text = self.spark.read.text(f"{self.path}/manifest/{found[-1]}", wholetext=True).first()[0]
        return Manifest(**json.loads(text))

    def _publish(self, new: Manifest) -> None:
        new.version = self.manifest.version + 1
        draft = self._hpath(f"{self.path}/manifest/.{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.write(json.dumps(new.__dict__).encode())
        out.hsync()
        out.close()
        if not self._fs.rename(draft, self._hpath(f"{self.path}/manifest/v{new.version:010d}.json")):
            raise RuntimeError("another writer published this manifest version")
        self.manifest = new

    def _rows(self, batches: dict[int, str]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*(f"{self.path}/log/{n}" for n in batches.values()))

    # writes

    def put(self, rows: DataFrame) -> None:
        """Append (key, value)."""
        self.apply(rows.select("key", "value", F.lit(kv.PUT).alias("op")))

    def delete(self, keys: DataFrame) -> None:
        """Append deletions of (key), also of absent keys."""
        self.apply(keys.select("key", F.lit(None).cast("binary").alias("value"), F.lit(kv.DELETE).alias("op")))

    def apply(self, rows: DataFrame, source: tuple[str, int] | None = None) -> None:
        """Append a batch of (key, value, op[, ts]); of a source (stream, micro-batch), what was applied before is skipped."""
        with self._writer:
            stream = hashlib.sha256(source[0].encode()).hexdigest()[:32] if source else None
            if source and source[1] <= self._seen().get(stream, -1):
                return
            batch, self._next = self._next, self._next + 1
            self._clock = max(self._clock + 1, int(time.time() * 1000))
            ts = F.col("ts") if "ts" in rows.columns else F.lit(self._clock)
            seq = F.struct(F.lit(batch).cast("bigint").alias("batch"), F.monotonically_increasing_id().alias("row"))
            out = rows.select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), ts.cast("bigint").alias("ts"), seq.alias("seq"), "op")
            name = f"batch={batch:010d}" + (f"~{stream}~{source[1]}" if source else "")
            out.write.mode("overwrite").parquet(f"{self.path}/log/{name}")
            with self._state:
                self._pending = {**self._pending, batch: name}
            self._size += kv.latest(self._rows({batch: name})).agg(F.sum(kv.entry_bytes())).first()[0] or 0
            if self._size > self.config.memtable_max_bytes:
                # keys that several batches hold were counted in each: only now all of them are read
                self._size = kv.latest(self._rows(self._pending)).agg(F.sum(kv.entry_bytes())).first()[0] or 0
            if self._size > self.config.memtable_max_bytes:
                self.flush()

    def flush(self) -> None:
        """Write the memtable as a level-0 segment."""
        with self._writer:
            if not self._pending:
                return
            segment = self._write_segment(kv.latest(self._rows(self._pending)), 0)
            with self._state:
                old = self.manifest
                segments = [*old.segments, *([segment] if segment["n"] else [])]
                self._publish(Manifest(0, max(self._pending), max(old.last_ts, segment["max_ts"] or 0), segments, self._seen()))
                self._pending, self._size = {}, 0

    def _write_segment(self, rows: DataFrame, level: int) -> dict:
        name = uuid.uuid4().hex
        size = rows.agg(F.sum(kv.record_bytes())).first()[0] or 0
        parts = max(1, -(-size // self.config.segment_max_bytes))
        path = f"{self.path}/segments/{name}"
        sorted_ = rows.repartitionByRange(parts, "key").sortWithinPartitions("key")
        sorted_.write.option("parquet.bloom.filter.enabled#key", "true").parquet(path)
        s = self.spark.read.schema(SCHEMA).parquet(path).agg(F.hex(F.min("key")), F.hex(F.max("key")), F.min("ts"), F.max("ts"), F.count("*")).first()
        return {"name": name, "level": level, "min_key": s[0], "max_key": s[1], "min_ts": s[2], "max_ts": s[3], "n": s[4], "bytes": size}

    # reads

    def _runs(self, start: bytes | None, end: bytes | None, segments: list[dict] | None = None) -> list[DataFrame]:
        """Memtable and the segments whose key bounds meet [start, end)."""
        lo, hi = start.hex().upper() if start is not None else None, end.hex().upper() if end is not None else None
        with self._state:
            held, pending = self.manifest.segments, self._pending
        met = [s for s in (held if segments is None else segments) if (lo is None or s["max_key"] >= lo) and (hi is None or s["min_key"] < hi)]
        runs = [self._rows(pending)] if segments is None else []
        if met:
            runs.append(self.spark.read.schema(SCHEMA).parquet(*(f"{self.path}/segments/{s['name']}" for s in met)))
        return [kv.between(r, start, end) for r in runs] or [self.spark.createDataFrame([], SCHEMA)]

    def range(self, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
        """Live rows of start <= key < end, in key order."""
        return kv.live(kv.merge(self._runs(start, end))).orderBy("key")

    def get(self, key: bytes) -> DataFrame:
        """The live row of a key, or none."""
        return kv.live(self.get_with_meta(key))

    def get_with_meta(self, key: bytes) -> DataFrame:
        """The latest version of a key, also a deletion."""
        return kv.latest(kv.merge(self._runs(key, key + b"\0")).where(F.col("key") == F.lit(key)))

    def stats(self) -> DataFrame:
        """One row per segment."""
        schema = "name STRING, level INT, min_key STRING, max_key STRING, min_ts BIGINT, max_ts BIGINT, n BIGINT, bytes BIGINT"
        return self.spark.createDataFrame([tuple(s[c.split()[0]] for c in schema.split(", ")) for s in self.manifest.segments], schema)

    # maintenance

    def compact(self, level: int, now_ms: int | None = None) -> None:
        """Merge a level into the next. Expired deletions go only if no deeper level can hold an older version.

        What is flushed meanwhile stays: only the merged segments are taken out of the manifest as it is then.
        """
        if level + 1 >= self.config.max_levels:
            raise ValueError(f"level {level} has no next level")
        with self._state:
            inputs = self.manifest.level(level)
            older = bool(self._pending) or any(s["level"] > level for s in self.manifest.segments)
        if not inputs:
            return
        now = int(time.time() * 1000) if now_ms is None else now_ms
        rows = kv.compact(self._runs(None, None, inputs), now, self.config.tombstone_retention_ms, not older)
        made = self._write_segment(rows, level + 1)
        names = {s["name"] for s in inputs}
        with self._state:
            old = self.manifest
            rest = [s for s in old.segments if s["name"] not in names]
            self._publish(Manifest(0, old.flushed_batch, old.last_ts, rest + ([made] if made["n"] else []), old.streams))

    def vacuum(self) -> None:
        """Delete segments that the current manifest does not list, flushed log batches, and older manifests.

        No compaction may run meanwhile: its segment is listed only at its end.
        """
        keep = {s["name"] for s in self.manifest.segments}
        for n in self._names("segments"):
            if n not in keep:
                self._fs.delete(self._hpath(f"{self.path}/segments/{n}"), True)
        for b, name in self._batches().items():
            if b <= self.manifest.flushed_batch:
                self._fs.delete(self._hpath(f"{self.path}/log/{name}"), True)
        for n in sorted(self._names("manifest"))[:-1]:
            self._fs.delete(self._hpath(f"{self.path}/manifest/{n}"), True)


@dataclass
class Job:
    job_id: str
    level: int
    status: str = "pending"
    error: str | None = None
    started_at: float | None = None
    completed_at: float | None = None


class Compactor:
    """Compactions in the background, one at a time per level, with a table of jobs."""

    def __init__(self, store: Store, workers: int = 1):
        self.store, self.jobs = store, {}
        self._pool = ThreadPoolExecutor(workers)
        self._levels = {n: threading.Lock() for n in range(store.config.max_levels)}
        self._done: dict = {}

    def schedule(self, level: int) -> str:
        if level + 1 >= self.store.config.max_levels:
            raise ValueError(f"level {level} has no next level")
        job = Job(uuid.uuid4().hex, level)
        self.jobs[job.job_id] = job
        self._done[job.job_id] = self._pool.submit(self._run, job)
        return job.job_id

    def _run(self, job: Job) -> None:
        with self._levels[job.level]:
            job.status, job.started_at = "running", time.time()
            try:
                self.store.compact(job.level)
                job.status = "completed"
            except Exception as e:  # reported through the job
                job.status, job.error = "failed", str(e)
            job.completed_at = time.time()

    def wait(self, job_id: str, timeout: float | None = None) -> bool:
        """Whether the job ended in time; a timeout of 0 only looks."""
        from concurrent.futures import TimeoutError as Late

        try:
            self._done[job_id].result(timeout)
        except Late:
            return False
        return True

    def status(self, job_id: str) -> Job | None:
        return self.jobs.get(job_id)

    def pending(self) -> list[Job]:
        return [j for j in self.jobs.values() if j.status in ("pending", "running")]

    def close(self, timeout: float = 5.0) -> bool:
        """Take no more jobs, drop those that have not begun, and wait for the others; whether they ended in time."""
        self._pool.shutdown(wait=False, cancel_futures=True)
        return not ended(self._done.values(), timeout).not_done


def row_numbers(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with an arrival number within one batch, for logs that have none."""
    return rows.withColumn("seq", F.row_number().over(Window.orderBy(*order)))
