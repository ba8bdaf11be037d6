"""Product codes of vectors: each of several parts is replaced by the number of its nearest codebook entry.

Assignment searches a vantage-point tree over the entries of each part position. An inner node holds an entry and,
of the entries on either side, the least and the greatest distance to it. By the triangle inequality a side can be
left out if no entry of it can be as near as the best one so far; these bounds are rounded outwards to whole numbers and sides
that could tie are visited, so nothing is lost to rounding, and every decision between entries compares squared
distances in whole numbers, ties going to the lower index. All rows of a block walk the tree together.

A training round reduces every partition to one row a part and used entry (count and componentwise sums), and Spark adds
these up; only the codebooks (parts x entries rows) come to the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PRESENT, each_salt, prepare, salted, spread, stage

#: Whole components are held within these bounds, so that squared distances and sums fit 64 bits; larger ones count as the bound.
LARGEST = 1 << 26
#: Entries below which a node keeps a plain list, and rows that walk a tree together.
LEAF, BLOCK_ROWS = 6, 1 << 14


@dataclass
class Node:
    """A vantage entry with two sides, or a leaf (no sides) with its entries. low and high bound distances to the parent's vantage entry."""

    entries: list[int]
    low: int
    high: int
    vantage: int = -1
    middle: int = 0
    sides: tuple = ()


class Tree:
    """Nearest entries of one codebook (entries x components, whole numbers)."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.columns = [tuple(int(x) for x in row) for row in entries]
        between = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        self.root = self._built(list(range(len(entries))), 0, 0, between)

    def _built(self, members: list[int], low: int, high: int, between: np.ndarray) -> Node:
        node = Node(members, low, high)
        if len(members) <= LEAF:
            return node
        square = np.sqrt(between[np.ix_(members, members)].astype(float))
        node.vantage = members[int(square.var(axis=1).argmax())]
        rest = sorted((int(between[node.vantage, m]), m) for m in members if m != node.vantage)
        half = len(rest) // 2
        node.middle = rest[half][0]
        sides = []
        for side in (rest[:half], rest[half:]):
            least, most = math.isqrt(side[0][0]), math.isqrt(side[-1][0])
            sides.append(self._built([m for _, m in side], least, most + 1, between))
        node.sides = tuple(sides)
        return node

    def nearest(self, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Index of and squared distance to the nearest entry of each row; components are given as columns."""
        n = len(columns[0])
        best, who = np.full(n, np.iinfo(np.int64).max), np.full(n, len(self.entries), np.int64)

        def compare(entry: int, rows: np.ndarray, part: list[np.ndarray]) -> np.ndarray:
            d = np.zeros(len(rows), np.int64)
            for x, c in zip(part, self.columns[entry]):
                d += np.square(x - c)
            better = (d < best[rows]) | ((d == best[rows]) & (entry < who[rows]))
            hit = rows[better]
            best[hit], who[hit] = d[better], entry
            return d

        def visit(node: Node, rows: np.ndarray) -> None:
            if not len(rows):
                return
            part = [x[rows] for x in columns]
            if not node.sides:
                for entry in node.entries:
                    compare(entry, rows, part)
                return
            d = compare(node.vantage, rows, part)
            down = np.maximum(np.sqrt(d.astype(float)).astype(np.int64) - 1, 0)
            inside = d < node.middle
            for chosen, order in ((inside, node.sides), (~inside, node.sides[::-1])):
                some, least = rows[chosen], down[chosen]
                for side in order:
                    gap = np.maximum(np.maximum(least - side.high, side.low - least - 3), 0)
                    visit(side, some[gap * gap <= best[some]])

        visit(self.root, np.arange(n))
        return who, best


@dataclass
class Codebooks:
    """Entries by part, entry and component (whole numbers of 1 / scale)."""

    entries: np.ndarray
    scale: int

    def digest(self) -> str:
        return sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def decoded(self, code: str) -> np.ndarray:
        """The vector that a code stands for; each component is the middle of its step."""
        chosen = self.entries[np.arange(len(self.entries)), list(bytes.fromhex(code))]
        return (chosen.ravel() + 0.5) / self.scale


def whole(vectors: pa.Array, parts: int, width: int, scale: int) -> np.ndarray:
    """Rows as whole numbers [row, part, component]; components past the vector's end are zero."""
    lists = vectors.cast(pa.list_(pa.float64()))
    flat = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
    with np.errstate(over="ignore"):
        numbers = np.clip(np.floor(flat * scale), -LARGEST, LARGEST).astype(np.int64)
    out = np.zeros((len(lists), parts * width), np.int64)
    out[:, : numbers.shape[1]] = numbers
    return out.reshape(len(lists), parts, width)


def _blocks(batches):
    """Batches joined to blocks of about BLOCK_ROWS rows."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= BLOCK_ROWS:
            yield pa.concat_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.concat_batches(held)


def _assigned(numbers: np.ndarray, trees: list[Tree]):
    """For each part: its components as columns, the nearest entries, and the squared distances to them."""
    for p, tree in enumerate(trees):
        columns = [np.ascontiguousarray(numbers[:, p, i]) for i in range(numbers.shape[2])]
        yield columns, *tree.nearest(columns)


def _summed(books: Codebooks):
    parts, entries, width = books.entries.shape
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))])

    def run(batches):
        trees = [Tree(e) for e in books.entries]
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for block in _blocks(batches):
            for p, (columns, who, _) in enumerate(_assigned(whole(block.column("vector"), parts, width, books.scale), trees)):
                n[p] += np.bincount(who, minlength=entries)
                for i, x in enumerate(columns):
                    total[p, :, i] += np.bincount(who, x, entries).astype(np.int64)  # below 2**53 in a block: exact
        used = np.argwhere(n)
        yield pa.RecordBatch.from_arrays([pa.array(used[:, 0].astype(np.int32)), pa.array(used[:, 1].astype(np.int32)), pa.array(n[n > 0]), pa.array(list(total[n > 0]), pa.list_(pa.int64()))], schema=schema)

    return run


def _coded(books: Codebooks):
    parts, _, width = books.entries.shape
    schema = pa.schema([("vec_id", pa.int64()), ("code", pa.string()), ("error", pa.int64()), ("label", pa.int32())])

    def run(batches):
        trees = [Tree(e) for e in books.entries]
        for block in _blocks(batches):
            codes, error = np.zeros((block.num_rows, parts), np.uint8), np.zeros(block.num_rows, np.int64)
            for p, (_, who, distance) in enumerate(_assigned(whole(block.column("vector"), parts, width, books.scale), trees)):
                codes[:, p] = who
                error += distance
            digits = codes.tobytes().hex()
            code = [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
            yield pa.RecordBatch.from_arrays([block.column("vec_id"), pa.array(code, pa.string()), pa.array(error), block.column("label")], schema=schema)

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vector, label of the rows whose vector holds components, all of them finite numbers."""
    kept = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("vector"), vectors["label"].cast("int").alias("label"))
    return kept.where("size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")


def train_codebooks(kept: DataFrame, *, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> Codebooks | None:
    """Codebooks of usable vectors of one length; None if there are no rows."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hexadecimal digits a part: 1 to 256 entries")
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").toArrow()["vector"].combine_chunks()
    if not len(first):
        return None
    width = -(-len(first[0]) // parts)
    books = Codebooks(np.ascontiguousarray(whole(first, parts, width, scale).transpose(1, 0, 2)), scale)
    for _ in range(rounds):
        sums = kept.mapInArrow(_summed(books), "part int, entry int, n long, total array<long>")
        added = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(width)))
        new = books.entries.copy()
        for part, entry, n, *total in added.collect():  # parts x entries rows
            new[part, entry] = [t // n for t in total]
        books = Codebooks(new, scale)
    return books


def compress_vectors(vectors: DataFrame, *, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """vectors(vec_id, embedding, label, ...) -> vec_id, code, error, label, label_error, codebooks_sha256.

    Components become floor(scale * x); a vector is cut into `parts` equal parts, the last filled up with zeros if its length
    asks for it. Codebooks begin with the parts of the rows of the `entries` least ids (null ids last, equal ids by vector; fewer, if there
    are fewer rows) and are trained in `rounds` rounds over all rows. Rows whose vector is null or empty or holds null or non-finite
    components are dropped, as are those of another length than the row of the least id. Components beyond 2**26 count as
    that. Repeated rows are coded each; null labels are one label; an empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BLOCK_ROWS))
    kept = usable(vectors)
    least = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select(F.size("vector").alias("n")).first()
    schema = "vec_id long, code string, error long, label int, label_error long, codebooks_sha256 string"
    if least is None:
        return spark.createDataFrame([], schema)
    kept = spread(kept.where(F.size("vector") == least.n))
    books = train_codebooks(kept, parts=parts, entries=entries, rounds=rounds, scale=scale)
    coded = stage(kept.mapInArrow(_coded(books), "vec_id long, code string, error long, label int"), "coded")
    rows = salted(coded, "vec_id", "code")
    sums = stage(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.expr(PRESENT)), "labels")
    known = each_salt(sums).withColumnsRenamed({"label": "of", "salt": "part"})
    out = rows.join(known, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("part")))
    return out.select("vec_id", "code", "error", "label", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
