"""Shared helpers of the training-data operators: staged tables and vectorised text hashing."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

U64 = np.uint64
#: Odd base of the wrap-around polynomial hashes, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
#: White space that ends a word: space and U+0009 to U+000D.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only in a local session that names none (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='forumlens-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Lists that the tables staged at the moment are noted in (see scratch).
_OPEN: list[list[DataFrame]] = []


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/forumlens/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    for noted in _OPEN:
        noted.append(out)
    return out


@contextlib.contextmanager
def scratch():
    """Deletes at its end the tables that were staged inside, but for those appended to the list it gives."""
    noted, kept = [], []
    _OPEN.append(noted)
    try:
        yield kept
    finally:
        _OPEN.remove(noted)
        unstage(*(t for t in noted if all(t is not k for k in kept)))


def sweep(spark: SparkSession) -> None:
    """Delete every staged table; call it once the results that read them are written."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/forumlens")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_staged_at", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def binary_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the n + 1 offsets of its values; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A finalising permutation of 64-bit values (shift-xor-multiply)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Powers:
    """Powers of the base and of its inverse, grown on demand."""

    up = np.ones(1, U64)
    down = np.ones(1, U64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            one = np.full(size, BASE, U64)
            one[0] = 1
            cls.up = np.cumprod(one)
            one[1:] = BASE_INV
            cls.down = np.cumprod(one)
        return cls.up[:n], cls.down[:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """G with G[j] - G[i] = sum of (byte + 1) * BASE**position over i <= position < j, modulo 2**64."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * Powers.upto(len(data) + 1)[0][:-1], out=out[1:])
    return out


#: Bytes hashed at once; longer inputs are cut at white space.
BLOCK = 1 << 18


def words_of(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document number of each word (run of bytes not `outside`, by default without white space) of a text column."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~outside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | edge[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(offsets, s, side="right") - 1


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; equal words have equal hashes wherever they stand."""
    out = np.zeros(len(s), U64)
    i = 0
    while i < len(s):
        j = max(i + 1, int(np.searchsorted(e, s[i] + BLOCK, side="right")))
        lo, hi = s[i], e[j - 1]
        g = prefix_hashes(data[lo:hi])
        down = Powers.upto(hi - lo + 1)[1]
        out[i:j] = mix((g[e[i:j] - lo] - g[s[i:j] - lo]) * down[s[i:j] - lo] + (e[i:j] - s[i:j]).astype(U64))
        i = j
    return out


def shingles_of(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words, and where each document's begin (n + 1 offsets).

    A document of fewer words, but one at least, has one shingle: all of its words.
    """
    n = len(offsets) - 1
    s, e, doc = words_of(data, offsets)
    h = word_hashes(data, s, e)
    count = np.bincount(doc, minlength=n) if len(doc) else np.zeros(n, np.int64)
    first = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
    up = Powers.upto(size + 1)[0]
    k = max(0, len(h) - size + 1)
    run = np.zeros(k, U64)
    for i in range(size):
        run += h[i : i + k] * up[i]
    whole = np.flatnonzero(doc[:k] == doc[size - 1 : size - 1 + k]) if k else np.zeros(0, np.int64)
    owner, value = doc[whole], mix(run[whole])
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        extra = np.zeros(len(short), U64)
        for i in range(size - 1):
            has = count[short] > i
            extra[has] += h[first[short[has]] + i] * up[i]
        owner, value = np.concatenate([owner, short]), np.concatenate([value, mix(extra)])
        order = np.argsort(owner, kind="stable")
        owner, value = owner[order], value[order]
    sizes = np.bincount(owner, minlength=n) if len(owner) else np.zeros(n, np.int64)
    return value, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def prepare(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, in rows and bytes, and send this package to the executors."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    ship(spark)


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 22):
    """Parts of a batch with at most `limit` bytes of the column, or one row."""
    _, offsets = binary_column(batch.column(column))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j
    trim()


def trim() -> None:
    """Give freed memory back to the system: workers are kept and would otherwise hold the most they ever had."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Exactly the given columns, so that others of any name cannot clash: only(df, text="string")."""
    return df.select(*(df[c].cast(t).alias(c) for c, t in columns.items()))


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, if it has fewer (a small table in one file); large inputs are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


SALTS = 32
#: Of a group of salted rows, the salts that occur, as bits (an aggregate expression).
PRESENT = "bit_or(shiftleft(1L, salt)) as salts"


def salted(rows: DataFrame, *by: str) -> DataFrame:
    """rows with a salt from the columns `by`: the rows of a hot key are joined in SALTS tasks."""
    return rows.withColumn("salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int"))


def each_salt(known: DataFrame) -> DataFrame:
    """What is known once a key, with PRESENT among its aggregates -> a row for each salt that occurs: the other side of a salted join."""
    each = known.withColumn("salt", F.explode(F.array(*(F.lit(i) for i in range(SALTS)))))
    return each.where("shiftright(salts, salt) & 1 = 1").drop("salts")


def carried(docs: DataFrame, added: list[tuple[str, str]], compute, inputs: tuple[str, ...] = ("text",)) -> DataFrame:
    """docs with columns added by compute(the input columns of a batch) -> a list of Arrow arrays. The first input bounds a batch.

    All columns travel along under internal names, so added names may clash with none of them on the way;
    a name that docs already has is returned in its new meaning.
    """
    from pyspark.sql import types as T

    fields = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)]
    inner = spread(docs.toDF(*(f.name for f in fields)))
    at = {f.name: i for i, f in enumerate(docs.schema.fields)}
    kinds = {"c": T.StructType.fromDDL(", ".join(f"x{i} {t}" for i, (_, t) in enumerate(added)))}
    schema = T.StructType([*fields, *kinds["c"].fields])
    names = [f.name for f in schema.fields]
    given = [f"c{at[c]}" for c in inputs]

    def run(batches):
        for whole in batches:
            for batch in slices(whole, given[0], 1 << 19):
                yield pa.RecordBatch.from_arrays([*batch.columns, *compute(*map(batch.column, given))], names=names)

    out = inner.mapInArrow(run, schema)
    new = {n.lower() for n, _ in added}
    return out.select(*(out[f"c{i}"].alias(f.name) for i, f in enumerate(docs.schema.fields) if f.name.lower() not in new), *(out[f"x{i}"].alias(n) for i, (n, _) in enumerate(added)))
