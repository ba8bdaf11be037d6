"""Durable artifacts as an append-only event log: the state of an artifact is its latest event.

Parquet files know no row locks, so transitions belong to a single writer on the driver; readers are free.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import first_rows
from ..schemas import schema

# Fixed values of the life cycle.
TRANSIENT = {"timeout", "provider_unavailable", "rate_limited"}
LEASE_SECONDS, RETRY_SECONDS, MAX_ATTEMPTS, STALE_DAYS, ERROR_CHARS = 600, 300, 3, 7, 1000
STATUSES = ("queued", "running", "succeeded", "failed", "stale", "canceled")


def checksum(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()


def idempotency_key(kind: str, source_hash: str, version: int = 1) -> str:
    return hashlib.sha256(f"{kind}:{source_hash}:{version}".encode()).hexdigest()


@dataclass
class ArtifactLog:
    """Enqueue, claim, complete and fail; every call appends rows and reads its own writes.

    Events are appended to one folder. Compacting writes all of them to a new folder inside, which is the log once it is whole;
    what it replaces stays until the next time, for readers that have begun.
    """

    spark: SparkSession
    path: str
    clock: object = field(default=datetime.now)

    def _folders(self) -> list[str]:
        """The log's folder and the whole compacted ones in it, oldest first."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        at = path(self.path)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = sorted(s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName().startswith("_compact-")) if fs.exists(at) else []
        return [self.path, *(f"{self.path}/{n}" for n in names if fs.exists(path(f"{self.path}/{n}/_SUCCESS")))]

    def _events(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(f"{schema('analysis_artifacts').simpleString()[7:-1].replace(':', ' ')}, seq long, from_status string, reason string").parquet(self._folders()[-1])
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error):
                return None
            raise

    def state(self) -> DataFrame:
        """One row an artifact: its latest event."""
        events = self._events()
        if events is None:
            return self.spark.createDataFrame([], schema("analysis_artifacts").add("seq", "long"))
        return first_rows(events, ["artifact_id"], F.desc("seq")).drop("from_status", "reason")

    def history(self) -> DataFrame:
        return self._events().select("artifact_id", "from_status", F.col("status").alias("to_status"), "reason", F.col("lease_owner").alias("worker_id"), F.col("updated_at").alias("created_at"), "seq").orderBy("seq")

    def _append(self, row: dict, before: str | None, reason: str) -> dict:
        return self.record([(row, before, reason)])[0]

    def record(self, transitions: list[tuple[dict, str | None, str]]) -> list[dict]:
        """Append (row, status before, reason) transitions in order: one read of the last number and one file for all of them."""
        events = self._events()
        last = 0 if events is None else events.agg(F.max("seq")).first()[0] or 0
        full = schema("analysis_artifacts").add("seq", "long").add("from_status", "string").add("reason", "string")
        now = self.clock()
        rows = [row | {"seq": last + k, "from_status": before, "reason": reason, "updated_at": now} for k, (row, before, reason) in enumerate(transitions, 1)]
        if rows:
            self.spark.createDataFrame([tuple(r.get(f.name) for f in full.fields) for r in rows], full).coalesce(1).write.mode("append").parquet(self._folders()[-1])
        return rows

    def known(self, kind: str, hashes: list[str], status: str | None = None) -> set[str]:
        """Those of the source hashes that an artifact of the kind (and status) has: what comes back is no more than what was asked."""
        asked = self.spark.createDataFrame([(h,) for h in hashes], "source_input_hash string").distinct()
        found = self.state().where((F.col("kind") == kind) & (F.lit(True) if status is None else F.col("status") == status))
        return {r["source_input_hash"] for r in asked.join(found, "source_input_hash", "left_semi").collect()}

    def compact(self) -> None:
        """The whole log in one file a partition, in order; run it by the writer while nothing else writes."""
        events = self._events()
        if events is None:
            return
        known = self._folders()
        fresh = f"{self.path}/_compact-{int(known[-1].rsplit('-', 1)[1]) + 1 if len(known) > 1 else 0:012d}"
        events.repartition("artifact_id").sortWithinPartitions("seq").write.mode("overwrite").parquet(fresh)
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for old in known[1:-1]:
            fs.delete(path(old), True)

    def _row(self, where) -> dict | None:
        found = self.state().where(where).orderBy("created_at", "seq").limit(1).collect()
        return found[0].asDict() if found else None

    def enqueue(self, kind: str, source_hash: str, payload: object, **settings) -> dict:
        """A queued artifact, or the one that the same kind, source and version made before."""
        row = self.queued(kind, source_hash, payload, **settings)
        known = self._row(F.col("idempotency_key") == row["idempotency_key"])
        return known or self._append(row, None, "enqueued")

    def queued(self, kind: str, source_hash: str, payload: object, *, version: int = 1, max_attempts: int = MAX_ATTEMPTS, provider: str = "", model: str = "", prompt: str = "") -> dict:
        """The row of a new artifact; nothing is written."""
        key = idempotency_key(kind, source_hash, version)
        return {"artifact_id": key[:32], "kind": kind, "status": "queued", "idempotency_key": key, "payload": json.dumps(payload, sort_keys=True), "schema_version": version, "source_input_hash": source_hash, "attempts": 0, "max_attempts": max_attempts, "created_at": self.clock(), "provider": provider, "model_name": model, "prompt_version": prompt}

    def succeeded(self, row: dict, payload: object) -> dict:
        """The row of an artifact once it is done; nothing is written."""
        return row | {"status": "succeeded", "payload": json.dumps(payload, sort_keys=True), "checksum": checksum(payload), "freshness_timestamp": self.clock(), "lease_expires_at": None}

    def claim(self, worker: str, max_running: int = 1) -> dict | None:
        """The oldest queued or stale artifact, or one whose lease ran out; none if the worker runs enough already."""
        now = self.clock()
        if self.state().where((F.col("status") == "running") & (F.col("lease_owner") == worker) & (F.col("lease_expires_at") > F.lit(now))).count() >= max_running:
            return None
        row = self._row(F.col("status").isin("queued", "stale") | (F.col("status") == "running") & (F.col("lease_expires_at") <= F.lit(now)))
        if row is None:
            return None
        return self._append(row | {"status": "running", "attempts": row["attempts"] + 1, "lease_owner": worker, "lease_expires_at": now + timedelta(seconds=LEASE_SECONDS)}, row["status"], "claimed")

    def complete(self, artifact_id: str, payload: object) -> dict:
        row = self._row(F.col("artifact_id") == artifact_id)
        return self._append(self.succeeded(row, payload), row["status"], "completed")

    def fail(self, artifact_id: str, category: str, message: str = "") -> dict:
        """Queued again after a transient error while attempts are left; failed otherwise."""
        row = self._row(F.col("artifact_id") == artifact_id)
        return self._append(self.failed(row, category, message), row["status"], category)

    def failed(self, row: dict, category: str, message: str = "") -> dict:
        """The row of an artifact after an error; nothing is written."""
        again = category in TRANSIENT and row["attempts"] < row["max_attempts"]
        new = {"status": "queued" if again else "failed", "error_category": category, "error_message": message[:ERROR_CHARS], "lease_owner": None, "lease_expires_at": None, "retry_after": self.clock() + timedelta(seconds=RETRY_SECONDS) if again else None}
        return row | new


def freshness(state: DataFrame, as_of: datetime) -> DataFrame:
    """One row: artifacts by status, the latest success, and unpopulated, stale, failed or ready."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    row = state.agg(*map(count, STATUSES), F.max("freshness_timestamp").alias("latest"), F.max(F.when(F.col("status") == "succeeded", F.col("freshness_timestamp"))).alias("latest_success"), F.count("*").alias("total"))
    stale = F.col("latest_success") < F.lit(as_of - timedelta(days=STALE_DAYS))
    return row.withColumn("state", F.when(F.col("latest_success").isNull() & (F.col("failed") > 0), "failed").when(F.col("latest_success").isNull(), "unpopulated").when(stale, "stale").otherwise("ready"))


def claimable(state: DataFrame, as_of: datetime) -> DataFrame:
    """Artifacts that may be claimed now, oldest first."""
    ready = F.col("status").isin("queued", "stale") | (F.col("status") == "running") & (F.col("lease_expires_at") <= F.lit(as_of))
    return state.where(ready).orderBy("created_at", "artifact_id")


def activity(state: DataFrame, limit: int = 50) -> DataFrame:
    """The latest artifacts as a feed: title, severity and state for display."""
    severity = F.when(F.col("status") == "failed", "high").when(F.col("status").isin("running", "queued"), "medium").otherwise("low")
    title = F.initcap(F.replace("kind", F.lit("_"), F.lit(" ")))
    return state.select("artifact_id", title.alias("title"), "status", severity.alias("severity"), "updated_at").orderBy(F.desc("updated_at"), "artifact_id").limit(limit)
