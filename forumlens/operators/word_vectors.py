"""Learned vectors of words and texts: co-occurrence counts, shifted positive mutual information, a randomised singular value decomposition.

Counts are of word pairs within WINDOW places of each other, summed over CHUNK words of text before they are shuffled. The matrix of
log(p(a, b) / (p(a) p(b))) - log(shift), where positive, is kept as counts, in compressed pieces by block of rows and block of columns. A product
with a tall thin matrix, itself a table of rows, sends the pieces and a copy of all rows to each block of rows, which meets them column block by
column block: rows are shuffled once a block, not once an entry. Up to SPLIT tasks share a block of rows, each with some column blocks, and
their sums are added, so tasks are more than blocks of rows without more copies of a row. Only square matrices of the width (Gram matrices, and the projected one) and the
hashes of the COMMON most frequent words, for which pieces hold short ranks, come to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import ship
from ..sources.domain import dealt
from ..sources.scratch import Scratch

WINDOW = 4
#: Words with a rank in place of their hash, at most; words of text whose pairs are summed at once; pairs that are summed in one task, about.
COMMON, CHUNK, MERGED = 1 << 16, 2_000_000, 3_000_000
#: Blocks of rows, at least, and rows of a block, at most; rows of a block of columns.
BLOCKS, TALL, WIDE = 6, 1 << 19, 1 << 17
#: Tasks that share a block of rows, at most.
SPLIT = 4
#: Products of a row and a number that are held at once.
HELD = 1 << 12
WORD = r"([\p{L}\p{N}']+)"


def words_in(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 1)


def vocabulary(docs: DataFrame, least: int) -> DataFrame:
    """docs(id, text) -> word, w (a 64-bit hash that stands for it), n_docs: the words of at least `least` texts."""
    held = docs.select(F.explode(F.array_distinct(words_in(F.col("text")))).alias("word"))
    return held.groupBy("word").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= least).select("word", F.xxhash64("word").alias("w"), "n_docs")


@dataclass
class Codes:
    """What stands for words: the rank of a frequent one, the hash of any other. `hashes` are those of the frequent words, sorted."""

    hashes: np.ndarray
    ranks: np.ndarray

    @classmethod
    def of(cls, words: DataFrame) -> Codes:
        """words(w, n_docs): those of as many texts as leave COMMON words at most are frequent."""
        left, least = COMMON, None
        for n, k in sorted(words.groupBy("n_docs").count().collect(), reverse=True):  # one row a number of texts
            if k > left:
                break
            left, least = left - k, n
        top = [] if least is None else words.where(F.col("n_docs") >= least).select("w", "n_docs").collect()  # COMMON rows at most
        hashes = np.array([w for w, _ in sorted(top, key=lambda x: (-x[1], x[0]))], np.int64)
        order = np.argsort(hashes)
        return cls(hashes[order], order.astype(np.int64))

    def __call__(self, w: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return w
        at = np.minimum(np.searchsorted(self.hashes, w), len(self.hashes) - 1)
        return np.where(self.hashes[at] == w, self.ranks[at], w)

    def coded(self, words: DataFrame) -> DataFrame:
        """words(w, ...) with their codes as a column more."""

        def run(batches):
            for batch in batches:
                yield batch.append_column("code", pa.array(self(batch["w"].to_numpy())))

        return words.mapInArrow(run, StructType([*words.schema.fields, StructField("code", LongType())]))


def hashed(text: Column) -> Column:
    return F.transform(words_in(text), lambda x: F.xxhash64(x))


PIECES = "i int, j int, size int, data binary"
PARTS = "i int, s int, g int, size int, data binary"
_PIECES = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("size", pa.int32()), ("data", pa.binary())])


def packed(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> bytes:
    """Entries in order of a and b: differences of a and of b, and n, byte place by byte place, compressed."""
    planes = [np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T) for x in (np.diff(a, prepend=np.int64(0)), np.diff(b, prepend=np.int64(0)), n.astype(np.int64))]
    return pa.compress(np.concatenate(planes).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    planes = np.frombuffer(pa.decompress(data, 24 * size, codec="zstd"), np.uint8).reshape(3, 8, size)
    a, b, n = (np.ascontiguousarray(x.T).view(np.int64).ravel() for x in planes)
    return np.cumsum(a), np.cumsum(b), n


def _pieces(block: np.ndarray, wide: int, a: np.ndarray, b: np.ndarray, n: np.ndarray):
    """Entries in order of a and b, of blocks i * wide + j -> one piece for each block."""
    if not len(a):
        return
    order = np.argsort(block, kind="stable")
    block, a, b, n = (x[order] for x in (block, a, b, n))
    first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    ends = np.append(first[1:], len(a))
    data = [packed(a[s:e], b[s:e], n[s:e]) for s, e in zip(first.tolist(), ends.tolist())]
    yield pa.RecordBatch.from_arrays([pa.array(block[first] // wide, pa.int32()), pa.array(block[first] % wide, pa.int32()), pa.array(ends - first, pa.int32()), pa.array(data, pa.binary())], schema=_PIECES)


def _summed(a: np.ndarray, b: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, and the sums of their n (1 by default)."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(a))) if n is None else np.add.reduceat(n[order], first) if len(a) else n
    return a[first], b[first], count


def _chunks(batches, most: int, *columns: str):
    """Of whole texts with about `most` words: all words in one array, the number of each one's text, and the other columns by text."""
    held, size = [], 0

    def joined():
        lists = [b["words"] for b in held]
        text = np.repeat(np.arange(sum(map(len, lists))), np.concatenate([np.diff(x.offsets.to_numpy()) for x in lists]))
        return np.concatenate([x.flatten().to_numpy() for x in lists]), text, *(np.concatenate([b[c].to_numpy() for b in held]) for c in columns)

    for batch in batches:
        while batch.num_rows:
            ends = batch["words"].offsets.to_numpy()
            k = min(batch.num_rows, max(1, int(np.searchsorted(ends - ends[0], most - size, side="right")) - 1))
            held.append(batch.slice(0, k))
            size += int(ends[k] - ends[0])
            batch = batch.slice(k)
            if size >= most or batch.num_rows:
                yield joined()
                held, size = [], 0
    if held:
        yield joined()


def _pairs(docs: DataFrame, codes: Codes, window: int, groups: int) -> DataFrame:
    """docs(id, text) -> pieces whose entries are the numbers of all pairs a >= b, also of words outside the vocabulary; each pair is in one piece."""

    def count(batches):
        for w, text in _chunks(batches, CHUNK):
            # Read without sign, a hash comes after all ranks: of two words, the row is the one with the greater code, so that rows are short.
            local, w = np.unique(codes(w).view(np.uint64), return_inverse=True)
            keys = [np.zeros(0, np.int64)]
            for step in range(1, min(window, len(w) - 1) + 1):
                same = text[:-step] == text[step:]
                lo, hi = np.minimum(w[:-step], w[step:])[same], np.maximum(w[:-step], w[step:])[same]
                keys.append(hi * len(local) + lo)
            key, n = np.unique(np.concatenate(keys), return_counts=True)
            a, b = (local[x].view(np.int64) for x in divmod(key, max(1, len(local))))
            yield from _pieces(a % groups, 1, a, b, n)

    def merge(batches):
        held: dict[int, list] = {}
        last = None
        for batch in batches:
            for i, size, data in zip(batch["i"].to_pylist(), batch["size"].to_pylist(), batch["data"]):
                if last is not None and i != last:
                    yield from out(last, held.pop(last))
                last = i
                part = held.setdefault(i, [])
                part.append(unpacked(data.as_buffer(), size))
                if len(part) > 1 and sum(len(x[0]) for x in part[1:]) > max(MERGED // 2, len(part[0][0])):
                    held[i] = [_summed(*map(np.concatenate, zip(*part)))]
        if last is not None:
            yield from out(last, held.pop(last))

    def out(i, part):
        a, b, n = _summed(*map(np.concatenate, zip(*part)))
        yield from _pieces(np.full(len(a), i), 1, a, b, n)

    rows = docs.select(hashed(F.col("text")).alias("words"))
    return rows.mapInArrow(count, PIECES).repartition(groups, "i").sortWithinPartitions("i").mapInArrow(merge, PIECES)


def _groups(words: DataFrame) -> int:
    """How many tasks sum pairs: about three pairs reach them for each word of each text."""
    return max(BLOCKS, -(-3 * (words.agg(F.sum("n_docs")).first()[0] or 0) // MERGED))


def cooccurrences(docs: DataFrame, words: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs(id, text), words(w, n_docs) -> a < b or a = b, n: how often two words of the vocabulary stand within `window` places."""

    def run(batches):
        for batch in batches:
            for size, data in zip(batch["size"].to_pylist(), batch["data"]):
                a, b, n = unpacked(data.as_buffer(), size)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(n)], names=["a", "b", "n"])

    known = words.select("w")
    near = _pairs(docs, Codes(np.zeros(0, np.int64), np.zeros(0, np.int64)), window, _groups(words)).mapInArrow(run, "a long, b long, n long")
    return near.join(known.toDF("a"), "a", "left_semi").join(known.toDF("b"), "b", "left_semi").select("a", "b", "n")


def information(near: DataFrame, shift: float = 1.0) -> DataFrame:
    """near(a, b, n) -> a, b, v: both triangles of the positive part of the pairs' mutual information less log(shift)."""
    full = near.select("a", "b", "n").union(near.where("a != b").select("b", "a", "n"))
    each = full.groupBy("a").agg(F.sum("n").alias("na"))
    total = each.agg(F.sum("na").alias("all"))
    joined = full.join(each, "a").join(each.toDF("b", "nb"), "b").crossJoin(F.broadcast(total))
    return joined.select("a", "b", (F.log(F.col("n") * F.col("all") / (F.col("na") * F.col("nb"))) - F.log(F.lit(float(shift)))).alias("v")).where("v > 0")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(y: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32)), pa.array(y.ravel()))


@dataclass
class Grid:
    """Pieces of a matrix's entries a, b, n: row a lies in block a mod tall, column b in block b mod wide. Once `placed`, a and b are places in the order of the block's rows."""

    pieces: DataFrame
    tall: int
    wide: int
    placed: bool = False


def both_triangles(pairs: DataFrame, tall: int, wide: int) -> DataFrame:
    """Pieces of pairs a, b -> pieces of the blocks of a grid, with b, a as well."""

    def run(batches):
        for batch in batches:
            for size, data in zip(batch["size"].to_pylist(), batch["data"]):
                a, b, n = unpacked(data.as_buffer(), size)
                other = a != b
                a, b, n = np.concatenate([a, b[other]]), np.concatenate([b, a[other]]), np.concatenate([n, n[other]])
                order = np.lexsort((b, a))
                a, b, n = a[order], b[order], n[order]
                yield from _pieces(a % tall * wide + b % wide, wide, a, b, n)

    return pairs.mapInArrow(run, PIECES)


def _times(grid: Grid, own: DataFrame, rows: DataFrame, width: int, value, real=np.float32) -> DataFrame:
    """own(w, weight), rows(w, weight, y) -> w, weight, y: for each row of own the sum of value(n, own weight, weight) * y over its entries, where that is positive.

    Equal rows of own get equal sums. Without a value the result is the pieces, placed. Entries whose row is not in own, or whose column is not in rows, count nothing.
    """
    tall, wide, in_place, split = grid.tall, grid.wide, grid.placed, min(grid.wide, SPLIT)

    def spread(blocks: int):
        def run(batches):
            for batch in batches:
                w, x = batch["w"].to_numpy(), batch["weight"].to_numpy()
                y = _matrix(batch["y"], width).astype(real) if "y" in batch.schema.names else np.zeros((len(w), 0), real)
                block = w % blocks
                for k in np.unique(block).tolist():
                    at = block == k
                    data = w[at].tobytes() + x[at].tobytes() + y[at].tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([int(at.sum())], pa.int32()), pa.array([data], pa.binary())], names=["k", "size", "data"])

        return run

    def read(data, size: int, columns: int):
        return np.frombuffer(data, np.int64, size), np.frombuffer(data, float, size, 8 * size), np.frombuffer(data, real, size * columns, 16 * size).reshape(size, columns)

    def ordered(parts):
        w, weight, y = map(np.concatenate, zip(*parts))
        order = np.argsort(w)
        return w[order], weight[order], y[order]

    def placed(w, known, a, b, n):
        i, j = np.minimum(np.searchsorted(w, a), len(w) - 1), np.minimum(np.searchsorted(known, b), len(known) - 1)
        use = (w[i] == a) & (known[j] == b)
        return i[use], j[use], n[use]

    def add(total, weight, its, y, i, j, n):
        v = value(n, weight[i], its[j])
        i, j, v = i[v > 0], j[v > 0], v[v > 0].astype(real)
        for s in range(0, len(i), HELD):
            part = slice(s, s + HELD)
            row = i[part]
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            total[row[first]] += np.add.reduceat(y[j[part]] * v[part, None], first, axis=0)

    def listed(w, weight, y):
        return pa.RecordBatch.from_arrays([pa.array(w), pa.array(weight), _lists(y)], names=["w", "weight", "y"])

    def done(block, w, weight, total):
        for s in range(0, len(w) if value else 0, 4096):
            part = slice(s, s + 4096)
            y = total[np.searchsorted(w, w[part])]
            if split == 1:
                yield listed(w[part], weight[part], y)
            else:
                data = w[part].tobytes() + weight[part].tobytes() + y.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.int32()) for x in (block[0], s // 4096, block[1], len(y))] + [pa.array([data], pa.binary())], names=["i", "s", "g", "size", "data"])

    def added(batches):
        """In order of i, s, g: the sums that tasks have of the same rows."""
        now = w = weight = total = None
        for batch in batches:
            for i, s, size, data in zip(batch["i"].to_pylist(), batch["s"].to_pylist(), batch["size"].to_pylist(), batch["data"]):
                part = read(data.as_buffer(), size, width)
                if (i, s) == now:
                    total = total + part[2]
                    continue
                if now is not None:
                    yield listed(w, weight, total)
                now, (w, weight, total) = (i, s), part
        if now is not None:
            yield listed(w, weight, total)

    def sums(batches):
        """In order of i, g, j, kind: a block's own rows, then of each of the task's blocks of columns its rows and the entries."""
        block = at = mine = columns = total = None
        for batch in batches:
            for i, g, j, kind, size, data in zip(*(batch[c].to_pylist() for c in ("i", "g", "j", "kind", "size")), batch["data"]):
                if (i, g) != block:
                    if total is not None:
                        yield from done(block, *mine[:2], total)
                    block, at, held, mine, columns, total = (i, g), -1, [], None, None, None
                if j != at:
                    if at == -1 and held:
                        mine = ordered(held)
                        total = np.zeros((len(mine[0]), width), real)
                    at, held, columns = j, [], None
                if kind < 2:
                    held.append(read(data.as_buffer(), size, width * kind))
                elif total is not None and (columns or held):
                    columns, held = columns or ordered(held), []
                    known = unpacked(data.as_buffer(), size)
                    known = known if in_place else placed(mine[0], columns[0], *known)
                    if value:
                        add(total, mine[1], *columns[1:], *known)
                    else:
                        yield from _pieces(np.full(len(known[0]), i * wide + j), wide, *known)
        if block is not None and at == -1 and held:
            mine = ordered(held)
            total = np.zeros((len(mine[0]), width), real)
        if total is not None:
            yield from done(block, *mine[:2], total)

    k = "k int, size int, data binary"
    mine = own.select("w", "weight").mapInArrow(spread(tall), k).select(F.col("k").alias("i"), F.lit(-1).alias("j"), F.lit(0).alias("kind"), "size", "data")
    theirs = rows.select("w", "weight", "y").mapInArrow(spread(wide), k).select(F.explode(F.sequence(F.lit(0), F.lit(tall - 1))).alias("i"), F.col("k").alias("j"), F.lit(1).alias("kind"), "size", "data")
    entries = grid.pieces.select("i", "j", F.lit(2).alias("kind"), "size", "data")
    shared = theirs.union(entries).withColumn("g", F.col("j") % split)
    mine = mine.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(split - 1))))
    dealt_ = mine.unionByName(shared).repartition(4 * tall * split, "i", "g").sortWithinPartitions("i", "g", "j", "kind")
    if value is None:
        return dealt_.mapInArrow(sums, PIECES)
    out = f"w long, weight double, y array<{'float' if real is np.float32 else 'double'}>"
    if split == 1:
        return dealt_.mapInArrow(sums, out)
    return dealt_.mapInArrow(sums, PARTS).repartition(4 * tall * split, "i", "s").sortWithinPartitions("i", "s", "g").mapInArrow(added, out)


def _gram(left: DataFrame, right: DataFrame, width: int) -> np.ndarray:
    """left' right (width x width), summed over partitions; the rows are joined by word unless both are one table."""
    both = left.select(F.col("y").alias("l"), F.col("y").alias("r")) if left is right else left.select("w", F.col("y").alias("l")).join(right.select("w", F.col("y").alias("r")), "w").select("l", "r")

    def part(batches):
        total = np.zeros((width, width))
        for batch in batches:
            total += _matrix(batch.column("l"), width).T.astype(float) @ _matrix(batch.column("r"), width).astype(float)
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.repeat(np.arange(width, dtype=np.int32), width)), "j": pa.array(np.tile(np.arange(width, dtype=np.int32), width)), "x": pa.array(total.ravel())})

    sums = both.mapInArrow(part, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
    out = np.zeros((width, width))
    out[sums["i"], sums["j"]] = sums["x"]
    return out


def _mapped(rows: DataFrame, m: np.ndarray) -> DataFrame:
    """Each row times m, which is small: one matrix product a batch."""

    def times(batches):
        for batch in batches:
            y = (_matrix(batch["y"], len(m)) @ m).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch["w"], batch["weight"], _lists(y)], names=["w", "weight", "y"])

    return rows.select("w", "weight", "y").mapInArrow(times, "w long, weight double, y array<float>")


def _orthonormal(rows: DataFrame, width: int) -> np.ndarray:
    """What rows are to be multiplied by for orthonormal columns of the same space: the factor of the Gram matrix is undone, twice for precision."""
    m = np.eye(width)
    for _ in range(2):
        y = _mapped(rows, m)
        value, vector = np.linalg.eigh(_gram(y, y, width))
        m = m @ (vector * np.where(value > value.max() * 1e-12, 1 / np.sqrt(np.maximum(value, 1e-300)), 0.0))
    return m


@dataclass
class WordVectors:
    """word, w, code, vector as a staged table; n_docs is how many texts hold the word, total how many texts there were."""

    table: DataFrame
    width: int
    total: int
    codes: Codes

    def of_texts(self, docs: DataFrame) -> DataFrame:
        """docs(id, text), ids long -> id, vector: the mean of its words' vectors, rare words counting more, on the unit sphere; zeros without known words."""
        held, codes = docs.where("id is not null").select(F.col("id").cast("long").alias("id"), "text"), self.codes
        tall, wide = _blocks(held.count(), BLOCKS, TALL), _blocks(self.table.count(), 1, WIDE)

        def run(batches):
            for w, text, ids in _chunks(batches, CHUNK, "id"):
                a, b, n = _summed(ids[text], codes(w))
                yield from _pieces(a % tall * wide + b % wide, wide, a, b, n)

        pieces = dealt(held).select("id", hashed(F.col("text")).alias("words")).mapInArrow(run, PIECES)
        idf = F.log(F.lit(float(self.total)) / F.col("n_docs")) + 1
        rows = self.table.select(F.col("code").alias("w"), idf.alias("weight"), F.col("vector").cast("array<float>").alias("y"))
        own = held.select(F.col("id").alias("w"), F.lit(0.0).alias("weight"))
        sums = _times(Grid(pieces, tall, wide), own, rows, self.width, lambda n, _, idf: np.log1p(n) * idf).select(F.col("w").alias("id"), F.col("y").cast("array<double>").alias("y"))
        norm = F.sqrt(F.aggregate("y", F.lit(0.0), lambda s, x: s + x * x))
        unit = sums.withColumn("norm", norm).select("id", F.transform("y", lambda x: F.when(F.col("norm") > 0, x / F.col("norm")).otherwise(0.0)).alias("vector"))
        zeros = docs.where("id is null").select("id", F.array_repeat(F.lit(0.0), self.width).alias("vector"))
        return unit.union(zeros)


def _blocks(rows: int, least: int, most: int) -> int:
    return max(least, -(-rows // most))


def learned(docs: DataFrame, *, width: int = 64, extra: int = 8, rounds: int = 2, least: int = 3, window: int = WINDOW, shift: float = 1.0, seed: int = 42) -> WordVectors:
    """docs(id, text) -> vectors of the words of at least `least` texts, from which texts get theirs.

    Null texts count as empty. The start is drawn from a hash of word and seed, so the vectors are the same at every run (to rounding).
    """
    spark = docs.sparkSession
    ship(spark)
    with Scratch(spark) as scratch:
        texts = dealt(docs).select("id", "text")
        words = scratch.staged(vocabulary(texts, least), "words")
        codes = Codes.of(words)
        n_words = words.count()
        tall, wide = _blocks(n_words, BLOCKS, TALL), _blocks(n_words, 1, WIDE)
        coded = scratch.staged(codes.coded(words), "coded")
        ones = coded.select(F.col("code").alias("w"), F.lit(0.0).alias("weight"), F.array(F.lit(1.0)).alias("y"))
        pairs = Grid(both_triangles(_pairs(texts, codes, window, _groups(words)), tall, wide), tall, wide)
        grid = Grid(scratch.staged(_times(pairs, ones, ones, 1, None, np.float64), "pieces"), tall, wide, placed=True)
        each = scratch.staged(_times(grid, ones, ones, 1, lambda n, *_: n, np.float64).select("w", F.col("y")[0].alias("weight")), "each")
        all_ = float(each.agg(F.sum("weight")).first()[0] or 0)
        n, log_shift = width + extra, float(np.log(shift))
        uniform = lambda k: (F.pmod(F.xxhash64("w", F.lit(seed), F.lit(k)), F.lit(1 << 20)) + 0.5) / (1 << 20) - 0.5
        start = coded.join(each.toDF("code", "weight"), "code").select(F.col("code").alias("w"), "weight", F.array(*(uniform(k).cast("float") for k in range(n))).alias("y"))
        times = lambda rows: scratch.staged(_times(grid, each, rows, n, lambda k, na, nb: np.log(k * all_ / (na * nb)) - log_shift), "product")
        basis = start
        for _ in range(rounds + 1):
            y = times(basis)
            scratch.drop(basis)
            basis = scratch.staged(_mapped(y, _orthonormal(y, n)), "basis")
            scratch.drop(y)
        small = _gram(basis, times(basis), n)
        value, vector = np.linalg.eigh((small + small.T) / 2)
        top = np.argsort(-np.abs(value))[:width]
        scaled = _mapped(basis, vector[:, top] * np.sqrt(np.abs(value[top])))  # left singular vectors times the roots of the singular values
        out = coded.join(scaled.select(F.col("w").alias("code"), F.col("y").cast("array<double>").alias("vector")), "code").select("word", "w", "n_docs", "code", "vector")
        return WordVectors(scratch.keep(scratch.staged(out, "vectors")), width, docs.count(), codes)
