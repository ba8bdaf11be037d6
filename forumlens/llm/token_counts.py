"""Document lengths in flat token files without an index, by a scan for the separator id.

A token file is a plain run of little-endian ids in which an end-of-document id closes each document.
It is read in ranges of whole blocks, so that a file of any size is split over tasks. Each block is searched for separators at once and reports the lengths of the
documents that both begin and end in it, the tokens before its first separator and those after its last.
A prefix scan over the block reports (within super-blocks, then over them) numbers the documents and adds up
those that cross block boundaries, however many blocks they span.
"""

from __future__ import annotations

import base64
import contextlib
import uuid
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import only, prepare, shared_folder, slices, spread, stage

BLOCK_TOKENS = 1 << 16
#: Blocks that one task reads in a row.
RANGE = 64
#: Blocks of a file that one task of the scan handles together.
SUPER = 4096


def store(uri: str):
    """(file system, path in it) of a location that Arrow can open, on the driver and on executors alike; None for others."""
    import pyarrow.fs as fs

    if urlsplit(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(urlsplit(uri).path)
    try:
        return fs.FileSystem.from_uri(uri)
    except (pa.ArrowException, OSError):
        return None


def read_token_files(spark: SparkSession, path: str, *, width: int = 4, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Flat files under path -> blocks (file, block, payload).

    Spark lists the files and their lengths; tasks open ranges of RANGE blocks by seeking, so files may have any size. In a
    store that only Spark can open each file is one row of it, of 2 GB at most. Bytes after a file's last whole id are
    ignored, and an empty file has no blocks.
    """
    prepare(spark)
    step = block_tokens * width
    files = spark.read.format("binaryFile").load(path)
    if store(path) is None:

        def whole(batches):
            for batch in batches:
                for file, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                    raw = memoryview(content.as_buffer())
                    size = len(raw) // width * width
                    for k, at in enumerate(range(0, size, step)):
                        yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([k], pa.int64()), pa.array([bytes(raw[at : min(at + step, size)])])], names=["file", "block", "payload"])

        return files.select("path", "content").mapInArrow(whole, "file string, block long, payload binary")

    size = F.expr(f"length div {width} * {width}")
    ranges = files.select("path", size.alias("size")).where("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(size - 1) div {step * RANGE}"))).alias("part"))
    ranges = ranges.repartition(max(2 * spark.sparkContext.defaultParallelism, files.rdd.getNumPartitions()), "path", "part")

    def run(batches):
        for batch in batches:
            for file, size, part in zip(*(batch.column(c).to_pylist() for c in ("path", "size", "part"))):
                opened, where = store(file)
                with opened.open_input_file(where) as stream:
                    stream.seek(part * RANGE * step)
                    for k in range(part * RANGE, min((part + 1) * RANGE, -(-size // step))):
                        yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([k], pa.int64()), pa.array([stream.read(min(step, size - k * step))])], names=["file", "block", "payload"])

    return ranges.mapInArrow(run, "file string, block long, payload binary")


def _scanned(separator: int, width: int):
    kind = {2: "<u2", 4: "<u4", 8: "<u8"}[width]
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("seps", pa.int64()), ("head", pa.int64()), ("tail", pa.int64()), ("inner", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            rows = []
            for file, block, payload in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "payload"))):
                ids = np.frombuffer(payload, kind)
                at = np.flatnonzero(ids == separator)
                if len(at):
                    rows.append((file, block, len(ids), len(at), int(at[0]), len(ids) - 1 - int(at[-1]), (np.diff(at) - 1).tolist()))
                else:
                    rows.append((file, block, len(ids), 0, len(ids), len(ids), []))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), schema)], schema=schema)

    return run


def _before(df: DataFrame, part: list[str], order: str, seps: str, open_: str) -> DataFrame:
    """Adds what lies before each row of its part: the number of separators, the tokens since the last of them
    (or since the part began), and whether there was one."""
    upto = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_upto", F.sum("n").over(upto))
    closed = F.max(F.when(F.col("seps") > 0, F.col("_upto") - F.col("tail"))).over(before)
    tokens = F.col("_upto") - F.col("n") - F.coalesce(closed, F.lit(0))
    return df.select("*", F.coalesce(F.sum("seps").over(before), F.lit(0)).alias(seps), tokens.alias(open_), closed.isNotNull().alias(f"{open_}_closed")).drop("_upto")


def separator_scan(blocks: DataFrame, separator: int, *, width: int = 4) -> DataFrame:
    """blocks(file, block, payload) -> file, document, n_tokens, terminated: one row per document.

    document counts from 0 within a file; n_tokens leaves out the separator. Tokens after the last
    separator of a file are a document of their own, not terminated; none after it, none. Neighbouring
    separators enclose an empty document. Null and empty payloads hold no tokens. Block numbers order a
    file and may have gaps; each may occur once. An empty table gives no rows; other columns are ignored.
    """
    prepare(blocks.sparkSession)
    raw = blocks.select(blocks["file"].cast("string").alias("file"), blocks["block"].cast("long").alias("block"), F.coalesce(blocks["payload"], F.lit(b"")).alias("payload"))
    s = stage(raw.mapInArrow(_scanned(separator, width), "file string, block long, n long, seps long, head long, tail long, inner array<long>"), "scan")
    s = s.withColumn("super", F.floor(F.col("block") / SUPER))
    facts = s.select("file", "super", "block", "n", "seps", "head", "tail")
    inside = _before(facts, ["file", "super"], "block", "seps_in", "open_in")
    whole = facts.groupBy("file", "super").agg(F.sum("n").alias("n"), F.sum("seps").alias("seps"), F.max(F.when(F.col("seps") > 0, F.struct("block", "tail"))).alias("last"), F.max("block").alias("end"))
    after = facts.join(whole.select("file", "super", F.col("last.block").alias("lb")), ["file", "super"]).where("lb is null or block > lb").groupBy("file", "super").agg(F.sum("n").alias("more"))
    whole = whole.join(after, ["file", "super"], "left").withColumn("tail", F.coalesce("last.tail", F.lit(0)) + F.coalesce("more", F.lit(0)))
    over = _before(whole.select("file", "super", "n", "seps", "tail"), ["file"], "super", "seps_before", "open_before")
    at = inside.join(over.select("file", "super", "seps_before", "open_before"), ["file", "super"])
    at = at.withColumn("document", F.col("seps_before") + F.col("seps_in")).withColumn("open", F.col("open_in") + F.when(F.col("open_in_closed"), 0).otherwise(F.col("open_before")))
    first = at.where("seps > 0").select("file", "document", (F.col("open") + F.col("head")).alias("n_tokens"))
    within = s.where(F.size("inner") > 0).select("file", "block", F.posexplode("inner").alias("k", "n_tokens")).join(at.select("file", "block", "document"), ["file", "block"])
    within = within.select("file", (F.col("document") + F.col("k") + 1).alias("document"), "n_tokens")
    files = whole.groupBy("file").agg(F.sum("seps").alias("document"), F.max(F.when(F.col("seps") > 0, F.struct("super", "tail"))).alias("last"), F.max("super").alias("end"))
    later = whole.join(files.select("file", F.col("last.super").alias("ls")), "file").where("ls is null or super > ls").groupBy("file").agg(F.sum("n").alias("more"))
    rest = files.join(later, "file", "left").select("file", "document", (F.coalesce("last.tail", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n_tokens")).where("n_tokens > 0")
    done = first.union(within).withColumn("terminated", F.lit(True))
    return done.union(rest.withColumn("terminated", F.lit(False))).select("file", F.col("document").cast("long").alias("document"), F.col("n_tokens").cast("long").alias("n_tokens"), "terminated")


def write_tokens(docs: DataFrame, folder: str, ranks_file: str, pattern: str, separator: int) -> tuple[DataFrame, int]:
    """Tokenise docs(doc_id, text) into flat files under folder: (manifest, bytes of an id).

    Each input partition becomes one file part-N.tok, ids of 2 bytes (4 if the vocabulary is larger), that the task writes
    under a name of its own and renames at its end: a task that is lost and run again leaves one whole file. The manifest
    (file, document, doc_id) is all that tells which document is which. The ranks of the byte-pair
    vocabulary are broadcast; their number bounds that. folder must be one that Arrow can open (see store).
    """
    spark = docs.sparkSession
    prepare(spark)
    if store(folder) is None:
        raise ValueError(f"token files need a folder that executors can open: {folder}")
    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    width = 2 if max(separator, *ranks.values()) < 1 << 16 else 4
    kind = f"<u{width}"
    shared = spark.sparkContext.broadcast((pattern, ranks))
    numbers = pa.list_(pa.struct([("document", pa.int64()), ("doc_id", pa.int64())]))

    def run(batches):
        import tiktoken
        from pyspark import TaskContext

        shape, merges = shared.value
        coder = tiktoken.Encoding("flat", pat_str=shape, mergeable_ranks=merges, special_tokens={})
        task = TaskContext.get()
        file = f"part-{task.partitionId():06d}.tok"
        opened, where = store(folder)
        own = f"{where}/_{file}-{task.taskAttemptId()}"
        opened.create_dir(where, recursive=True)
        n = 0
        with opened.open_output_stream(own, buffer_size=1 << 20) as out:
            for whole in batches:
                for batch in slices(whole, "text"):
                    numbered = []
                    for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                        out.write(np.array([*coder.encode_ordinary(text or ""), separator], kind).tobytes())
                        numbered.append({"document": n, "doc_id": doc})
                        n += 1
                    yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([numbered], numbers)], names=["file", "documents"])
        if n:
            opened.move(own, f"{where}/{file}")
        else:
            opened.delete_file(own)

    out = stage(spread(only(docs, doc_id="long", text="string")).mapInArrow(run, "file string, documents array<struct<document: long, doc_id: long>>"), "manifest")
    return out.select("file", F.explode("documents").alias("d")).select("file", "d.document", "d.doc_id"), width


def token_counts(docs: DataFrame, ranks_file: str, pattern: str, separator: int) -> DataFrame:
    """docs(doc_id, text) -> file, document, doc_id, n_tokens: written as flat token files, then counted from these alone.

    Null and empty texts have 0 tokens. Repeated rows are counted each; a null doc_id is carried. A
    separator id inside a document would end it, so it must be none of the vocabulary's. The files lie in
    the shared folder while they are scanned and are then deleted.
    """
    folder = f"{shared_folder(docs.sparkSession)}/forumlens/tokens-{uuid.uuid4().hex}"
    manifest, width = write_tokens(docs, folder, ranks_file, pattern, separator)
    opened, where = store(folder)
    opened.create_dir(where, recursive=True)
    found = separator_scan(read_token_files(docs.sparkSession, folder, width=width), separator, width=width)
    with contextlib.suppress(OSError):
        opened.delete_dir(where)
    name = F.element_at(F.split("file", "/"), -1)
    return found.withColumn("file", name).join(manifest, ["file", "document"]).select("file", "document", "doc_id", "n_tokens")
