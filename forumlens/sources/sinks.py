"""Writers: upserts and appends into a store, atomic batches, exports, copies with verification."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.filters import first_rows
from ..operators.upkeep import retained, split_by_group
from ..schemas import TABLES, schema
from .readers import Store, folders


def typed(df: DataFrame, table: str) -> DataFrame:
    """df in the table's columns and types; columns it lacks are null."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(table).fields))


def _merged(store: Store, table: str, rows: DataFrame, state: dict | None, keep: tuple[str, ...]) -> tuple[dict, int]:
    """A keyed table's state with rows put in: only the buckets of their keys are read and written anew. Also the number of distinct keys.

    The rows are evaluated once, before anything of the table changes (they may be derived from it).
    """
    keys = store.keys(table)
    new = typed(rows, table)
    fresh = store.written(table, _first(store, table, new, F.desc_nulls_last))
    parts = dict(state["parts"]) if state else {}
    old = [f for b in fresh["parts"] for f in parts.get(b, [])]
    arrived = store.of(table, [f for names in fresh["parts"].values() for f in names])
    count = arrived.count()
    both = {b: names for b, names in fresh["parts"].items() if b in parts}
    if old:
        again = store.of(table, [f for names in both.values() for f in names])
        kept = tuple(c for c in keep if c in new.columns)
        whole = store.written(table, _upserted(store, table, store.of(table, old), again, kept))
        if kept:
            _delete(store, both)
            fresh["parts"].update(whole["parts"])
        else:  # the new rows stay in the files they are in
            fresh["parts"].update({b: whole["parts"].get(b, []) + names for b, names in both.items()})
    return {"parts": parts | fresh["parts"], "loose": []}, count


def _first(store: Store, table: str, rows: DataFrame, order) -> DataFrame:
    """rows dealt to the table's buckets, one of each key, in a single shuffle."""
    keys, columns = store.keys(table), rows.columns
    return first_rows(store.dealt(table, rows), ["key_bucket", "key_share", *keys], *(order(c) for c in columns if c not in keys))


def _keys_of(store: Store, table: str, rows: DataFrame) -> DataFrame:
    """rows in their columns, but null in all that are no keys."""
    return rows.select(*(F.col(f.name) if f.name in store.keys(table) else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields))


def _upserted(store: Store, table: str, old: DataFrame, new: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """operators.upkeep.upserted for rows of distinct keys, dealt to the table's buckets: old and new rows meet in a single shuffle. Without `keep`, of the old rows only."""
    both = old.withColumn("_new", F.lit(False)).unionByName((new if keep else _keys_of(store, table, new)).withColumn("_new", F.lit(True)))
    of_key = Window.partitionBy("key_bucket", "key_share", *store.keys(table))
    both = store.dealt(table, both).withColumns({"_any": F.max("_new").over(of_key), **{f"_old_{c}": F.max(F.when(~F.col("_new"), F.col(c))).over(of_key) for c in keep}})
    columns = [F.coalesce(f"_old_{c}", c).alias(c) if c in keep else F.col(c) for c in old.columns]
    return both.where(F.col("_new") == F.col("_any") if keep else ~F.col("_any")).select(*columns, "key_bucket", "key_share")


def _lacking(store: Store, table: str, known: DataFrame, new: DataFrame, order) -> DataFrame:
    """The first row of each key that `known` lacks, dealt to the table's buckets in a single shuffle."""
    keys, columns = store.keys(table), new.columns
    both = store.dealt(table, new.withColumn("_new", F.lit(True)).unionByName(_keys_of(store, table, known).withColumn("_new", F.lit(False))))
    first = first_rows(both, ["key_bucket", "key_share", *keys], "_new", *(order(c) for c in columns if c not in keys))
    return first.where("_new").drop("_new")


def _delete(store: Store, parts: dict[str, list[str]]) -> None:
    for names in parts.values():
        for name in names:
            at, files = store._at(f"{store.root.rstrip('/')}/{name}")
            files.delete(at, True)


def upsert(store: Store, table: str, rows: DataFrame, keep: tuple[str, ...] = ("created_at",)) -> int:
    """Insert or update by the table's key; returns the number of distinct keys stored."""
    base = store.tables()
    state, count = _merged(store, table, rows, base.get(table), keep)
    store.commit(base, {table: state})
    return count


def insert_ignore(store: Store, table: str, rows: DataFrame, order=F.asc_nulls_first) -> None:
    """Add the rows whose keys the table lacks, as further files of their buckets; nothing is rewritten. Of several rows of a key the first in the order of all columns is added."""
    base = store.tables()
    state = base.get(table) or {"parts": {}, "loose": []}
    new = typed(rows, table)
    known = folders(state)
    fresh = store.written(table, _lacking(store, table, store.of(table, known), new, order) if known else _first(store, table, new, order))
    parts = {b: state["parts"].get(b, []) + fresh["parts"].get(b, []) for b in {*state["parts"], *fresh["parts"]}}
    store.commit(base, {table: {"parts": parts, "loose": []}})


def append(store: Store, table: str, rows: DataFrame) -> None:
    """Add rows whether their keys are there or not."""
    base = store.tables()
    state = base.get(table) or {"parts": {}, "loose": []}
    fresh = store.written(table, typed(rows, table))
    parts = {b: state["parts"].get(b, []) + fresh["parts"].get(b, []) for b in {*state["parts"], *fresh["parts"]}}
    store.commit(base, {table: {"parts": parts, "loose": state["loose"] + fresh["loose"]}})


def overwrite(store: Store, table: str, rows: DataFrame) -> None:
    base = store.tables()
    store.commit(base, {table: store.written(table, typed(rows, table))})


class BatchError(RuntimeError):
    """A batch was rolled back."""


def store_batch(store: Store, posts: DataFrame, comments: DataFrame, meta: DataFrame) -> dict[str, int]:
    """Posts, comments and batch row together or not at all: one commit names what all three consist of then."""
    base = store.tables()
    changed, counts = {}, {}
    try:
        for table, rows in {"posts": posts, "comments": comments, "batch_collections": meta}.items():
            changed[table], counts[table] = _merged(store, table, rows, base.get(table), ("created_at",))
        store.commit(base, changed)
    except Exception as error:
        for table, state in changed.items():
            had = set(folders(base[table])) if table in base else set()
            _delete(store, {"": [f for f in folders(state) if f not in had]})
        raise BatchError(str(error)[:1000]) from error
    return counts


def cleanup(store: Store, cutoff: datetime, tables: tuple[str, ...] = ("posts", "comments"), column: str = "timestamp") -> int:
    """Delete rows older than the cutoff; returns how many went."""
    gone = 0
    for table in tables:
        df = store.read(table)
        before = df.count()
        overwrite(store, table, retained(df, cutoff, column))
        gone += before - store.read(table).count()
    return gone


def move_groups(store: Store, table: str, groups: list[str], other: str) -> int:
    """Rows outside the groups go to `other`; fails before anything moves if the parts don't add up."""
    df = store.read(table)
    stays, moves = split_by_group(df, groups)
    n, m, total = stays.count(), moves.count(), df.count()
    if n + m != total:
        raise BatchError(f"{n} + {m} rows are not {total}")
    moves.write.mode("append").parquet(other)
    overwrite(store, table, stays)
    return m


def copy_all(source: Store, target: Store, tables: tuple[str, ...] = tuple(TABLES), verify: bool = True) -> dict[str, tuple[int, int]]:
    """Copy tables in dependency order, keeping rows that the target has; returns (source, target) counts."""
    out = {}
    for table in tables:
        if not source.exists(table):
            continue
        rows = source.read(table)
        if source.keys(table):
            insert_ignore(target, table, rows)
        else:
            append(target, table, rows)
        if verify:
            out[table] = (rows.count(), target.read(table).count())
    return out


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def export_store(store: Store, path: str, tables: tuple[str, ...] = ("posts", "comments")) -> dict[str, int]:
    """Each table as JSON lines in its own folder, and the row counts."""
    counts = {}
    for table in tables:
        df = store.read(table)
        export_json(df, f"{path}/{table}")
        counts[table] = df.count()
    return counts


def log_metrics(store: Store, run_id: str, stage: str, metrics: dict[str, float], at: datetime | None = None) -> None:
    rows = [(run_id, stage, k, float(v), at or datetime.now()) for k, v in metrics.items()]
    append(store, "run_metrics", store.spark.createDataFrame(rows, schema("run_metrics")))


def latest_run(store: Store, stage: str) -> DataFrame:
    """The metrics of the stage's latest run."""
    m = store.read("run_metrics").where(F.col("stage") == stage)
    last = m.orderBy(F.desc("logged_at"), F.desc("run_id")).limit(1).select("run_id")
    return m.join(F.broadcast(last), "run_id", "left_semi")
