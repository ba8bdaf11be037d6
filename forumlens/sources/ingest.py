"""Collection: time frames, rate limits, retries, a circuit breaker, resumable batches with failures kept to their group."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import between_days, holds_any, unprocessed
from ..operators.upkeep import resume_state
from ..schemas import schema
from .readers import Store
from .sinks import BatchError, store_batch


@dataclass(frozen=True)
class TimeFrame:
    """A half-open stretch of time."""

    start: datetime
    end: datetime

    def __post_init__(self):
        if self.start >= self.end:
            raise ValueError("a time frame must start before it ends")

    @classmethod
    def parse(cls, start: str, end: str) -> TimeFrame:
        return cls(datetime.fromisoformat(start), datetime.fromisoformat(end))

    @classmethod
    def last_days(cls, days: int, as_of: datetime) -> TimeFrame:
        if days <= 0:
            raise ValueError("days must be positive")
        return cls(as_of - timedelta(days=days), as_of)

    @property
    def days(self) -> int:
        return (self.end - self.start).days

    def chunks(self, days: int) -> list[TimeFrame]:
        """Stretches of at most so many days, without gap or overlap."""
        out, at = [], self.start
        while at < self.end:
            out.append(TimeFrame(at, min(at + timedelta(days=days), self.end)))
            at = out[-1].end
        return out


class Refused(RuntimeError):
    """A request was not made, or failed for good."""


@dataclass
class Limiter:
    """At most `requests` in `window` seconds; exponential back-off; a breaker that opens after `failures` in a row."""

    requests: int = 600
    window: float = 600
    retries: int = 5
    base: float = 1.0
    most: float = 60.0
    failures: int = 5
    cool_down: float = 60.0
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    state: str = "closed"
    made: int = 0
    failed: int = 0
    waits: int = 0
    trips: int = 0
    _times: deque = field(default_factory=deque)
    _in_a_row: int = 0
    _opened: float = 0.0

    def _room(self) -> None:
        now = self.clock()
        while self._times and self._times[0] <= now - self.window:
            self._times.popleft()
        if len(self._times) >= self.requests:
            self.waits += 1
            self.sleep(self._times[0] + self.window - now)
            self._times.popleft()

    def call(self, request: Callable):
        if self.state == "open":
            if self.clock() - self._opened < self.cool_down:
                raise Refused("the circuit is open")
            self.state = "half_open"
        for attempt in range(self.retries):
            self._room()
            self._times.append(self.clock())
            self.made += 1
            try:
                out = request()
            except Exception as error:
                self.failed += 1
                self._in_a_row += 1
                if self._in_a_row >= self.failures or self.state == "half_open":
                    self.state, self._opened = "open", self.clock()
                    self.trips += 1
                    raise Refused(f"the circuit opened: {error}") from error
                if attempt + 1 == self.retries:
                    raise Refused(f"gave up after {self.retries} attempts: {error}") from error
                self.sleep(min(self.base * 2**attempt, self.most))
            else:
                self._in_a_row, self.state = 0, "closed"
                return out


@dataclass
class Delay:
    """Seconds between requests: doubled on an error up to a limit, eased back otherwise; at least `between` between chunks."""

    now: float = 2.0
    least: float = 2.0
    most: float = 300.0
    between: float = 5.0

    def after_error(self) -> float:
        self.now = min(self.now * 2, self.most)
        return self.now

    def after_success(self) -> float:
        self.now = max(self.now * 0.9, self.least)
        return self.now

    def between_chunks(self) -> float:
        return max(self.now, self.between)


@dataclass
class Progress:
    done: int
    total: int
    seconds: float

    @property
    def percentage(self) -> float:
        return 100.0 * self.done / self.total if self.total else 0.0

    @property
    def eta_minutes(self) -> float | None:
        return self.seconds / self.done * (self.total - self.done) / 60 if self.done else None


def fresh(pulled: DataFrame, known: DataFrame, keywords: list[str] | None = None, frame: TimeFrame | None = None, limit: int | None = None) -> DataFrame:
    """Pulled posts that are new, within the frame and hold a keyword; the latest ones up to the limit."""
    rows = unprocessed(pulled, known, "id").where(holds_any(keywords or [], "title", "content"))
    if frame is not None:
        rows = rows.where((F.col("timestamp") >= F.lit(frame.start)) & (F.col("timestamp") < F.lit(frame.end)))
    return rows.orderBy(F.desc("timestamp"), "id").limit(limit) if limit is not None else rows


@dataclass
class Report:
    posts: int = 0
    comments: int = 0
    completed: list[str] = field(default_factory=list)
    failed: dict[str, str] = field(default_factory=dict)
    skipped: list[str] = field(default_factory=list)

    @property
    def success_rate(self) -> float:
        n = len(self.completed) + len(self.failed)
        return round(100.0 * len(self.completed) / n, 2) if n else 0.0


def collect(spark: SparkSession, store: Store, groups: Iterable[str], pull: Callable[[str], tuple[DataFrame, DataFrame]], as_of: datetime, hours: int = 24) -> Report:
    """Pull and store each group as one batch. Groups completed within the hours are skipped; a failing group fails alone."""
    report = Report()
    wanted = list(dict.fromkeys(groups))
    if not wanted:
        return report
    state = resume_state(spark.createDataFrame([(g,) for g in wanted], "subreddit string"), store.read("batch_collections"), as_of, hours)
    done = {r["subreddit"] for r in state.where("completed").collect()}
    for group in wanted:
        if group in done:
            report.skipped.append(group)
            continue
        began = time.monotonic()
        try:
            posts, comments = pull(group)
            n, m = posts.count(), comments.count()
            row = (group, as_of, n, m, time.monotonic() - began, "completed", as_of, as_of)
            store_batch(store, posts, comments, spark.createDataFrame([row], schema("batch_collections")))
        except (Refused, BatchError, ValueError) as error:
            report.failed[group] = str(error)[:1000]
            continue
        report.completed.append(group)
        report.posts += n
        report.comments += m
    return report


def estimated_calls(groups: int, chunks: int, calls: int = 6) -> int:
    """Requests that a back-fill will need."""
    return groups * chunks * calls


@dataclass(frozen=True)
class Scope:
    """What a back-fill will take, before any request is made: one request a chunk and group, and a tenth of one a post."""

    chunks: int
    requests: float
    minutes: float

    @classmethod
    def of(cls, frame: TimeFrame, groups: int, posts_per_group: int, chunk_days: int, seconds: float = 2.0) -> Scope:
        if groups <= 0 or posts_per_group < 0 or chunk_days <= 0:
            raise ValueError("a back-fill needs groups, chunks of a day at least and no negative number of posts")
        chunks = len(frame.chunks(chunk_days))
        requests = groups * chunks * (1 + posts_per_group * 0.1)
        return cls(chunks, requests, requests * seconds / 60)


@dataclass(frozen=True)
class Schedule:
    """When a collection is due: every `days` days at `hour`, and at `backup_hour` of such a day if none succeeded on it.

    It keeps no clock and no process of its own: any outer scheduler asks due() and reports successes.
    """

    first: datetime
    days: int = 2
    hour: int = 1
    backup_hour: int = 13
    guard_hours: int = 24

    def planned(self, now: datetime) -> tuple[datetime, bool] | None:
        """The latest planned start at or before now, and whether it is the backup of its day."""
        since = (now.date() - self.first.date()).days
        if since < 0:
            return None
        day = datetime.combine(now.date() - timedelta(days=since % self.days), datetime.min.time())
        starts = [(day + timedelta(hours=self.hour), False), (day + timedelta(hours=self.backup_hour), True)]
        past = [s for s in starts if s[0] <= now]
        if past:
            return past[-1]
        before = day - timedelta(days=self.days)
        return None if before < datetime.combine(self.first.date(), datetime.min.time()) else (before + timedelta(hours=self.backup_hour), True)

    def due(self, now: datetime, last_success: datetime | None = None, last_start: datetime | None = None, running: bool = False) -> bool:
        """Whether to start now: nothing runs, this planned start was not used yet, and there was no success that makes it needless."""
        planned = self.planned(now)
        if planned is None or running or last_start is not None and last_start >= planned[0]:
            return False
        if last_success is None:
            return True
        return last_success.date() < planned[0].date() if planned[1] else now - last_success >= timedelta(hours=self.guard_hours)


def checks(spark: SparkSession, store: Store, pull: Callable[[str], object] | None = None, group: str = "") -> dict[str, str]:
    """What a collection needs, each "ok" or the reason why not: the session, the store, and one pull."""

    def tried(step: Callable[[], object]) -> str:
        try:
            step()
        except Exception as error:
            return f"{type(error).__name__}: {error}"[:200]
        return "ok"

    out = {"session": tried(lambda: spark.range(1).count()), "store": tried(lambda: store.missing())}
    return out | ({"source": tried(lambda: pull(group))} if pull else {})


__all__ = ["Delay", "Limiter", "Progress", "Refused", "Report", "Schedule", "Scope", "TimeFrame", "between_days", "checks", "collect", "estimated_calls", "fresh"]
