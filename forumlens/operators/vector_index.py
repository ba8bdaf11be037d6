"""An index of vectors by coarse cells: inverted lists as a table partitioned by cell.

Each vector lies in the cell of its nearest centre (unit vectors, so cosine and distance order alike). A search reads the lists
of the cells nearest to its query only. Exact mode goes on with every cell that could still hold a better row: the
distance of a query to a cell's centre, less the cell's radius, bounds the cosine of all its vectors from above.

Lists are kept in blocks of BLOCK rows and queries meet them in chunks of BLOCK, one matrix product each, so a cell with a third
of all vectors, or of all queries, is many tasks.

The nearest others of all listed rows are found by TASKS tasks or more: each holds its rows' best so far, and all blocks come by in packed form, its own and
the cells near them first. Products in single precision tell what cannot be among the best; the rest is scored in double precision.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ..sources.scratch import new_folder, remove

BLOCK = 4096
#: Sampled rows a cell that place the centres: the only vectors that come to the driver.
SAMPLE_PER_CELL = 64
#: Tasks that find the neighbours of all rows, about; rows of one, at least and at most; scores that it holds at once.
TASKS, FEWEST, MOST, SCORES = 24, 1024, 1 << 15, 1 << 22
FOUND = "query_id long, id long, score double"


def unit(v: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm > 0, norm, 1)


def matrix(column) -> np.ndarray:
    return np.array(column.tolist(), float).reshape(len(column), -1)


def usable(vectors: DataFrame) -> DataFrame:
    """id, vector of the rows with an id and finite components; others match nothing."""
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    return rows.where("id is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")


def centres_of(sample: np.ndarray, cells: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Lloyd rounds on unit vectors from seeded, distinct starts."""
    sample = np.unique(unit(sample), axis=0)
    r = np.random.default_rng(seed)
    centres = sample[r.permutation(len(sample))[:cells]]
    for _ in range(rounds):
        near = (sample @ centres.T).argmax(axis=1)
        for c in range(len(centres)):
            if (near == c).any():
                centres[c] = sample[near == c].mean(axis=0)
        centres = unit(centres)
    return centres


def asked_of(batch: pd.DataFrame, at: np.ndarray, cell: np.ndarray):
    """Queries (places in a batch) with the cells that they ask, BLOCK rows at once: a batch can ask for each vector as often as there are cells."""
    for s in range(0, len(at), BLOCK):
        rows = at[s : s + BLOCK]
        yield pd.DataFrame({"query_id": batch["query_id"].to_numpy()[rows], "vector": batch["vector"].to_numpy()[rows], "cell": cell[s : s + BLOCK].astype(np.int32)})


class Nearest:
    """The k best others of some rows (ids, unit vectors) by rounded score, equal ones by the lesser id, while blocks of rows come by."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, k: int, digits: int):
        self.ids, self.v, self.single, self.k, self.digits = ids, v, v.astype(np.float32), k, digits
        self.score, self.other = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        self.off = (v.shape[1] + 4) * 2.0**-22 + 10.0**-digits  # more than a product in single precision is off, and a rounded one

    def meet(self, ids: np.ndarray, v: np.ndarray, rows: np.ndarray) -> None:
        """A block of rows against those of the own rows that may find something in it."""
        single, step, k = v.astype(np.float32), max(1, SCORES // max(1, len(ids))), self.k
        for s in range(0, len(rows), step):
            at = rows[s : s + step]
            near, least = self.single[at] @ single.T, self.score[at, -1]
            new = np.isinf(least)
            if k < len(ids) and new.any():  # k others score as much as the (k + 1)-th, as one may be the row itself
                least[new] = np.partition(near[new], len(ids) - k - 1, axis=1)[:, len(ids) - k - 1] - self.off
            i, j = np.nonzero(near >= (least - self.off).astype(np.float32)[:, None])
            other = self.ids[at[i]] != ids[j]
            i, j = i[other], j[other]
            if len(i) > near.size // 32:
                score = (self.v[at] @ v.T)[i, j]
            else:
                score = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", self.v[at[i[x : x + 65536]]], v[j[x : x + 65536]]) for x in range(0, len(i), 65536))])
            self.merge(at[i], np.round(score, self.digits), ids[j])

    def merge(self, row: np.ndarray, score: np.ndarray, other: np.ndarray) -> None:
        last = self.score[row, -1]
        better = (score > last) | ((score == last) & (other < self.other[row, -1]))
        touched, place = np.unique(row[better], return_inverse=True)
        r = np.concatenate([np.repeat(np.arange(len(touched)), self.k), place])
        s, o = np.concatenate([self.score[touched].ravel(), score[better]]), np.concatenate([self.other[touched].ravel(), other[better]])
        order = np.lexsort((o, -s, r))
        best = order[np.searchsorted(r[order], np.arange(len(touched)))[:, None] + np.arange(self.k)]
        self.score[touched], self.other[touched] = s[best], o[best]

    def found(self):
        for s in range(0, len(self.ids), 4096):
            i, j = np.nonzero(~np.isinf(self.score[s : s + 4096]))
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[s + i]), pa.array(self.other[s + i, j]), pa.array(self.score[s + i, j])], names=["query_id", "id", "score"])


@dataclass
class VectorIndex:
    """Where the lists are, and per cell: its centre, radius, rows and blocks (as many entries as cells: a parameter)."""

    spark: SparkSession
    path: str
    centres: np.ndarray
    radius: np.ndarray
    rows: np.ndarray

    @property
    def blocks(self) -> np.ndarray:
        return -(-self.rows // BLOCK)

    @classmethod
    def build(cls, vectors: DataFrame, path: str | None = None, *, cells: int = 64, seed: int = 42) -> VectorIndex:
        """Index vectors(id, vector). Centres come from a sample of at most cells * SAMPLE_PER_CELL rows; every row is listed."""
        spark = vectors.sparkSession
        ship(spark)
        path = path or new_folder(spark, "index")
        kept = usable(vectors)
        sample = kept.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(cells * SAMPLE_PER_CELL).select("vector").toPandas()["vector"]
        centres = centres_of(matrix(sample), cells, seed) if len(sample) else np.zeros((0, 1))

        def assign(batches):
            for batch in batches:
                v = unit(matrix(batch["vector"]))
                dots = v @ centres.T
                batch["cell"] = dots.argmax(axis=1).astype(np.int32)
                batch["far"] = np.sqrt(np.maximum((v * v).sum(axis=1) + 1 - 2 * dots.max(axis=1), 0))
                yield batch

        listed = kept.mapInPandas(assign, "id long, vector array<double>, cell int, far double") if len(centres) else kept.selectExpr("*", "0 as cell", "0d as far")
        listed.write.parquet(f"{path}/assigned")
        listed = spark.read.parquet(f"{path}/assigned")
        radius, rows = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
        for cell, far, n in listed.groupBy("cell").agg(F.max("far"), F.count("*")).collect():  # one row a cell
            radius[cell], rows[cell] = far, n
        index = cls(spark, path, centres, radius, rows)
        parts = F.element_at(F.array(*(F.lit(int(b)) for b in np.maximum(index.blocks, 1))), F.col("cell") + 1) if len(centres) else F.lit(1)
        blocked = listed.select("id", "vector", "cell", F.pmod(F.xxhash64("id"), parts).cast("int").alias("block"))
        blocked.repartition("cell", "block").write.partitionBy("cell").parquet(f"{path}/lists")
        cells_ = pd.DataFrame({"cell": range(len(centres)), "centre": centres.tolist(), "radius": radius, "n": rows})
        spark.createDataFrame(cells_, "cell int, centre array<double>, radius double, n long").coalesce(1).write.parquet(f"{path}/cells")
        return index

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        ship(spark)
        cells = spark.read.parquet(f"{path}/cells").orderBy("cell").toPandas()
        return cls(spark, path, matrix(cells["centre"]) if len(cells) else np.zeros((0, 1)), cells["radius"].to_numpy(float), cells["n"].to_numpy(np.int64))

    def remove(self) -> None:
        remove(self.spark, self.path)

    def lists(self, cells: list[int]) -> DataFrame:
        """The rows of some cells: only their folders are read."""
        schema = "id long, vector array<double>, block int, cell int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/lists").where(F.col("cell").isin(cells))

    def probed(self, queries: DataFrame, probes: int | None, least: str | None = None) -> DataFrame:
        """queries(query_id, vector, ...) -> query_id, vector, cell: the `probes` nearest cells; with `least`, the others that may hold a score of that column or more."""
        centres, radius, filled = self.centres, self.radius, self.rows > 0

        def run(batches):
            for batch in batches:
                q = unit(matrix(batch["vector"]))
                dots = q @ centres.T
                order = np.argsort(np.where(filled, -dots, np.inf), axis=1, kind="stable")
                place = np.empty_like(order)
                np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
                wanted = (place < probes) & filled
                if least:
                    size = (q * q).sum(axis=1, keepdims=True)
                    gap = np.maximum(np.sqrt(np.maximum(size + 1 - 2 * dots, 0)) - radius - 1e-9, 0)
                    most = np.maximum((size + 1 - gap * gap) / 2, 0)
                    wanted = ~wanted & filled & (most >= batch[least].to_numpy()[:, None] - 1e-9)
                at, cell = np.nonzero(wanted)
                yield from asked_of(batch, at, cell)

        return queries.mapInPandas(run, "query_id long, vector array<double>, cell int")

    def nearest(self, probed: DataFrame, k: int, digits: int | None, floor: float | None) -> DataFrame:
        """probed(query_id, vector, cell) -> the k best rows of each query in each block of its cells."""
        counts = {r["cell"]: r["n"] for r in probed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # one row a cell
        if not counts:
            return self.spark.createDataFrame([], FOUND)
        parts = F.create_map(*(F.lit(x) for c, n in counts.items() for x in (c, -(-n // BLOCK))))
        lists = F.create_map(*(F.lit(x) for c in counts for x in (c, int(self.blocks[c]))))
        asked = probed.withColumn("chunk", F.pmod(F.xxhash64("query_id"), parts[F.col("cell")]).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), lists[F.col("cell")] - 1)))
        rows = self.lists(sorted(counts)).withColumn("chunk", F.explode(F.sequence(F.lit(0), parts[F.col("cell")].cast("int") - 1)))

        def run(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(v):
                return pd.DataFrame(columns=["query_id", "id", "score"])
            ids, wanted = v["id"].to_numpy(), q["query_id"].to_numpy()
            a, b = unit(matrix(q["vector"])), unit(matrix(v["vector"]))
            out = []
            for i in range(0, len(a), 512):
                score = a[i : i + 512] @ b.T
                if floor is not None:
                    score = np.maximum(score, floor)
                if digits is not None:
                    score = np.round(score, digits)
                if k < len(ids):  # the k-th best score, then ties by the lesser id
                    cut = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k]
                    at, col = np.nonzero(score >= cut[:, None])
                else:
                    at, col = np.nonzero(np.ones(score.shape, bool))
                out.append(pd.DataFrame({"query_id": wanted[i + at], "id": ids[col], "score": score[at, col]}))
            found = pd.concat(out).sort_values(["query_id", "score", "id"], ascending=[True, False, True], kind="stable")
            return found[found.groupby("query_id").cumcount() < k]

        return asked.groupBy("cell", "block", "chunk").cogroup(rows.groupBy("cell", "block", "chunk")).applyInPandas(run, FOUND)

    def search(self, queries: DataFrame, k: int = 10, *, probes: int = 4, exact: bool = False, digits: int | None = 4, floor: float | None = 0.0, staged=None) -> DataFrame:
        """queries(id, vector) -> query_id, id, score: the k nearest rows by cosine, equal scores (to `digits` places) by the lesser id.

        `probes` cells are read for each query; exact=True reads those that may still hold a better row as well, so that the result is that of a
        full scan. `floor` is the least score shown. staged(df, name) writes what is read twice (sources.scratch.Scratch.staged).
        """
        if not self.rows.sum():
            return self.spark.createDataFrame([], FOUND)
        keep = staged or (lambda df, name: df)
        asked = keep(usable(queries).withColumnRenamed("id", "query_id"), "queries")
        first = keep(self.best(self.nearest(keep(self.probed(asked, probes), "probed"), k, digits, floor), k), "first")
        if not exact:
            return first
        slack = 0.0 if digits is None else 0.5 * 10.0**-digits
        known = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score") - slack).otherwise(-2.0).alias("least"))
        rest = asked.join(known, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))
        more = self.nearest(keep(self.probed(rest, probes, "least"), "more"), k, digits, floor)
        return self.best(first.union(more), k)

    def neighbours(self, k: int, *, digits: int = 10) -> DataFrame:
        """query_id, id, score: the k nearest others of every listed row by cosine, equal scores (to `digits` places) by the lesser id, as of a full scan."""
        total, centres, radius = int(self.rows.sum()), self.centres, self.radius
        if not total:
            return self.spark.createDataFrame([], FOUND)
        most, owned, task, held = min(max(FEWEST, -(-total // TASKS)), MOST), [], 0, 0
        for cell in np.flatnonzero(self.rows).tolist():
            for block in range(int(self.blocks[cell])):  # a block is one task's, a task has some blocks of cells in order
                n = int(self.rows[cell] // self.blocks[cell])
                task, held = (task + 1, n) if held and held + n > most else (task, held + n)
                owned.append((cell, block, task))
        order = []
        for t in range(task + 1):
            mine = sorted({c for c, _, x in owned if x == t})
            place = (-(centres[mine] @ centres.T).max(axis=0)).argsort(kind="stable").argsort().tolist()
            order += [(c, b, t, 0 if x == t else 1 + place[c]) for c, b, x in owned]
        plan = self.spark.createDataFrame(pd.DataFrame(order, columns=["cell", "block", "task", "place"]), "cell int, block int, task int, place int")  # one row a task and block

        def pack(key, rows):
            v = matrix(rows["vector"])
            with np.errstate(over="ignore"):
                single = v.astype(np.float32)
            data = rows["id"].to_numpy(np.int64).tobytes() + (single if (single == v).all() else v).tobytes()
            return pd.DataFrame({"cell": [key[0]], "block": [key[1]], "size": [len(v)], "data": [data]})

        def unpack(data, size: int) -> tuple[np.ndarray, np.ndarray]:
            real = np.float32 if len(data) == size * (8 + 4 * centres.shape[1]) else np.float64
            return np.frombuffer(data, np.int64, size), unit(np.frombuffer(data, real, offset=8 * size).reshape(size, -1).astype(float))

        def meet(best: Nearest, cell: int, ids: np.ndarray, v: np.ndarray) -> None:
            far = np.sqrt(np.maximum((best.v * best.v).sum(axis=1) + 1 - 2 * (best.v @ centres[cell]), 0))
            gap = np.maximum(far - radius[cell] - 1e-9, 0)
            best.meet(ids, v, np.flatnonzero(np.maximum(1 - gap * gap / 2, 0) >= best.score[:, -1] - best.off))

        def begun(own) -> Nearest:
            best = Nearest(*(np.concatenate(x) for x in list(zip(*own))[1:]), k, digits)
            for cell, ids, v in own:
                meet(best, cell, ids, v)
            return best

        def run(batches):
            """In order of task and place: a task's own blocks, then all others."""
            now = best = None
            own: list[tuple] = []
            for batch in batches:
                for task, place, cell, size, data in zip(*(batch[c].to_pylist() for c in ("task", "place", "cell", "size")), batch["data"]):
                    if task != now:
                        if own or best:
                            yield from (best or begun(own)).found()
                        now, own, best = task, [], None
                    ids, v = unpack(data.as_buffer(), size)
                    if not place:
                        own.append((cell, ids, v))
                        continue
                    if own:
                        best, own = begun(own), []
                    if best:
                        meet(best, cell, ids, v)
            if own or best:
                yield from (best or begun(own)).found()

        pieces = self.lists(sorted({c for c, _, _ in owned})).groupBy("cell", "block").applyInPandas(pack, "cell int, block int, size int, data binary")
        dealt = pieces.join(F.broadcast(plan), ["cell", "block"]).select("task", "place", "cell", "size", "data")
        return dealt.repartition(4 * (task + 1), "task").sortWithinPartitions("task", "place").mapInArrow(run, FOUND)

    def calibrated(self, sample: DataFrame, k: int = 10, *, target: float = 0.95, staged=None) -> int:
        """The least number of probes at which the cells read hold `target` of the k nearest rows of the sample's queries (id, vector), found exactly.

        Vectors with groups need few probes; vectors spread evenly in many dimensions need most cells, whatever their number.
        """
        if not self.rows.sum():
            return 1
        keep = staged or (lambda df, name: df)
        asked = usable(sample).withColumnRenamed("id", "query_id")
        found = keep(self.search(sample, k, exact=True, digits=None, floor=None, staged=staged), "true")
        listed = self.lists(list(range(len(self.rows)))).select("id", "cell")
        centres, filled = self.centres, self.rows > 0

        def place(batches):
            for batch in batches:
                score = np.where(filled, unit(matrix(batch["vector"])) @ centres.T, -np.inf)
                own = score[np.arange(len(score)), batch["cell"].to_numpy()]
                yield pd.DataFrame({"place": (score > own[:, None]).sum(axis=1) + 1})

        places = found.join(listed, "id").join(asked, "query_id").select("vector", "cell").mapInPandas(place, "place long")
        counts = dict(places.groupBy("place").count().collect())  # one row a cell at most
        total, held = sum(counts.values()), 0
        for place_ in sorted(counts):
            held += counts[place_]
            if held >= target * total:
                return int(place_)
        return len(self.rows)

    @staticmethod
    def best(found: DataFrame, k: int) -> DataFrame:
        """The k best of each query's rows: of each block at most k come here, so a query's list is short."""
        lists = found.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("o"), "id", "score"))), 1, k).alias("x"))
        return lists.select("query_id", F.inline("x")).select("query_id", "id", "score")

    def share_read(self, probed: DataFrame) -> float:
        """The share of vectors that searching probed(query_id, cell) reads, of all pairs of a query and a vector."""
        n = F.create_map(*(F.lit(x) for c, r in enumerate(self.rows) for x in (c, int(r))))
        row = probed.agg(F.sum(n[F.col("cell")]).alias("read"), F.countDistinct("query_id").alias("q")).first()
        return (row["read"] or 0) / max(1, row["q"] * int(self.rows.sum()))
