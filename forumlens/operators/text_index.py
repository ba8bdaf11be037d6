"""An index of words and trigrams: posting lists as sorted Parquet, dealt by hash of the term, and the texts dealt by hash of the id.

Lists are made for some millions of characters at once, so that what is shuffled and sorted is a row a term and such a group of texts.

A look-up reads the folders of its terms' hashes only, and in them the row groups whose range holds the terms. Substrings are
searched by the rarest of their trigrams and verified on the texts, which are read from the folders of the candidates' ids only. A frequent
term's list lies in several files, as groups of texts are dealt to some within a folder.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import overlap_score, search_terms
from ..session import ship
from ..sources.domain import dealt
from ..sources.scratch import Scratch, new_folder, remove

#: Trigrams of a query that are looked up, the rarest ones.
RAREST = 4
#: The words of functions.text.search_terms, in texts that are lowered.
WORD = re.compile("[a-z0-9]{3,}")


def lowered(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def trigrams(low: str) -> list[str]:
    """Distinct runs of three characters."""
    return list(dict.fromkeys(low[i : i + 3] for i in range(len(low) - 2)))


LISTS = "part int, share int, term string, n_docs int, ids array<long>, sizes array<int>"
#: Characters whose lists are made at once (a longer text by itself).
GROUP = 1 << 21


def _gram_lists(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The texts' trigrams; where each one's texts begin (and the last end) among all; the texts, by place."""
    size = np.array([len(t) for t in texts])
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), size)
    within = np.arange(len(points)) - np.repeat(np.cumsum(size) - size, size) + 2 < size[row]
    at = np.flatnonzero(within)
    code, row = points[at] << 42 | points[at + 1] << 21 | points[at + 2], row[at]
    order = np.argsort(code, kind="stable")  # texts stay in their order
    code, row = code[order], row[order]
    first = np.ones(len(code), bool)
    first[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
    code, row = code[first], row[first]
    start = np.flatnonzero(np.concatenate([np.ones(min(1, len(code)), bool), code[1:] != code[:-1]]))
    each = code[start]
    joined = np.stack([each >> 42, each >> 21 & 0x1FFFFF, each & 0x1FFFFF], axis=1).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [joined[i : i + 3] for i in range(0, len(joined), 3)], np.append(start, len(code)), row


def _lists(ids: np.ndarray, texts: list[str], parts: int, files: int) -> pa.RecordBatch:
    """The lists of one group of texts, as rows of LISTS; sizes (how many words each text has) beside words only."""
    held: dict[str, list[int]] = {}
    size = np.zeros(len(texts), np.int32)
    for i, text in enumerate(texts):
        words = set(WORD.findall(text))
        size[i] = len(words)
        for w in words:
            held.setdefault(w, []).append(i)
    grams, starts, rows = _gram_lists(texts)
    terms = [*("w" + w for w in held), *("g" + g for g in grams)]
    of_words = np.fromiter((i for x in held.values() for i in x), np.int64)
    ends = np.cumsum([0, *(len(x) for x in held.values())])
    offsets = np.concatenate([ends, starts[1:] + ends[-1]]).astype(np.int32)
    share = zlib.crc32(str(ids[0]).encode()) % files
    columns = {
        "part": pa.array([zlib.crc32(t.encode()) % parts for t in terms], pa.int32()),
        "share": pa.array(np.full(len(terms), share, np.int32)),
        "term": pa.array(terms, pa.string()),
        "n_docs": pa.array(np.diff(offsets).astype(np.int32)),
        "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids[np.concatenate([of_words, rows])])),
        "sizes": pa.ListArray.from_arrays(pa.array(np.concatenate([ends, np.full(len(grams), ends[-1])]).astype(np.int32)), pa.array(size[of_words])),
    }
    return pa.RecordBatch.from_pydict(columns)


@dataclass
class TextIndex:
    """Where the lists, the terms' counts and the texts are, and among how many folders each is dealt."""

    spark: SparkSession
    path: str
    parts: int

    @classmethod
    def build(cls, docs: DataFrame, path: str | None = None, *, parts: int = 64, files: int = 4) -> TextIndex:
        """Index docs(id, text) by words of three letters and more ("w" + word) and trigrams ("g" + trigram). Ids are unique; null texts count as empty."""
        spark = docs.sparkSession
        ship(spark)
        path = path or new_folder(spark, "index")
        rows = dealt(docs.select(F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")).where("id is not null"))
        share = F.pmod(F.xxhash64("id"), F.lit(files))

        def listed(batches):
            for batch in batches:
                ids, texts = batch.column("id").to_numpy(), batch.column("low").to_pylist()
                i = 0
                while i < len(texts):
                    j, held = i + 1, len(texts[i])
                    while j < len(texts) and held + len(texts[j]) <= GROUP:
                        held += len(texts[j])
                        j += 1
                    yield _lists(ids[i:j], texts[i:j], parts, files)
                    i = j

        lists = rows.select("id", lowered(F.col("text")).alias("low")).mapInArrow(listed, LISTS)
        lists.repartition("part", "share").drop("share").sortWithinPartitions("part", "term").write.partitionBy("part").parquet(f"{path}/lists")
        counts = spark.read.parquet(f"{path}/lists").groupBy("part", "term").agg(F.sum("n_docs").alias("n_docs"))
        counts.repartition("part").sortWithinPartitions("part", "term").write.partitionBy("part").parquet(f"{path}/terms")
        texts = rows.withColumn("part", F.pmod(F.crc32(F.col("id").cast("string")), F.lit(parts)).cast("int"))
        texts.withColumn("share", share).repartition("part", "share").drop("share").sortWithinPartitions("part", "id").write.partitionBy("part").parquet(f"{path}/texts")
        return cls(spark, path, parts)

    def remove(self) -> None:
        remove(self.spark, self.path)

    def _read(self, table: str, schema: str, parts: set[int] | None = None) -> DataFrame:
        df = self.spark.read.schema(f"{schema}, part int").parquet(f"{self.path}/{table}")
        return df if parts is None else df.where(F.col("part").isin(sorted(parts)))

    def _of(self, table: str, schema: str, terms: list[str]) -> DataFrame:
        """A table's rows of some terms: files of other folders are not opened."""
        return self._read(table, f"term string, {schema}", {zlib.crc32(t.encode()) % self.parts for t in terms}).where(F.col("term").isin(terms)).drop("part")

    def postings(self, terms: list[str]) -> DataFrame:
        """term, id, n: the texts that hold each term, and how many words each has (null beside trigrams)."""
        lists = self._of("lists", "ids array<long>, sizes array<int>", terms)
        return lists.select("term", "sizes", F.posexplode("ids").alias("at", "id")).select("term", "id", F.get("sizes", F.col("at")).alias("n"))

    def texts(self, ids: DataFrame) -> DataFrame:
        """id, text of some ids(id)."""
        parts = {r[0] for r in ids.select(F.pmod(F.crc32(F.col("id").cast("string")), F.lit(self.parts)).cast("int")).distinct().collect()}  # one row a folder
        return self._read("texts", "id long, text string", parts).join(ids.distinct(), "id", "left_semi").select("id", "text")

    def _lowered(self, query: str) -> str:
        """As Spark lowers the texts."""
        return self.spark.range(1).select(lowered(F.lit(query))).first()[0]

    def candidates(self, query: str) -> DataFrame | None:
        """The ids of texts that hold the query's rarest trigrams; None if it has none (it is too short)."""
        grams = ["g" + g for g in trigrams(self._lowered(query))]
        if not grams:
            return None
        known = {r["term"]: r["n_docs"] for r in self._of("terms", "n_docs long", grams).collect()}  # a row a trigram of the query at most
        if len(known) < len(grams):
            return self.spark.createDataFrame([], "id long")
        rarest = sorted(grams, key=lambda g: (known[g], g))[:RAREST]
        return self.postings(rarest).groupBy("id").agg(F.count_distinct("term").alias("k")).where(F.col("k") == len(rarest)).select("id")

    def containing(self, *keywords: str, scratch: Scratch) -> DataFrame:
        """id, text of the texts that hold one of the keywords, case aside: what a scan with contains() finds. Without keywords, all."""
        if not keywords:
            return self._read("texts", "id long, text string").select("id", "text")
        ids = [self.candidates(k) for k in keywords]
        if any(x is None for x in ids):
            found = self._read("texts", "id long, text string").select("id", "text")
        else:
            some = ids[0]
            for x in ids[1:]:
                some = some.union(x)
            found = self.texts(scratch.staged(some.distinct(), "candidates"))
        tests = [F.contains(lowered(F.col("text")), F.lower(F.lit(k))) for k in keywords]
        test = tests[0]
        for t in tests[1:]:
            test |= t
        return found.where(test)

    def lexical(self, query: str, limit: int = 10, *, scratch: Scratch) -> DataFrame:
        """id, score: the texts of most overlap with the query's words, at least 0.25 where they hold it as a phrase."""
        wanted = list(dict.fromkeys(WORD.findall(self._lowered(query))))
        phrase = self.containing(query, scratch=scratch).select("id", F.size(search_terms(lowered(F.col("text")))).alias("size"), F.lit(True).alias("phrase"))
        shared = self.postings(["w" + w for w in wanted]).groupBy("id").agg(F.count_distinct("term").alias("shared"), F.first("n").alias("n"))
        both = shared.join(phrase, "id", "full").select("id", F.coalesce("shared", F.lit(0)).alias("shared"), F.coalesce("n", "size").alias("n"), F.coalesce("phrase", F.lit(False)).alias("phrase"))
        scored = both.select("id", overlap_score(F.col("shared"), F.lit(len(wanted)), F.col("n"), F.col("phrase")).alias("score"))
        return scored.select("id", F.bround("score", 4).alias("score")).orderBy(F.desc("score"), "id").limit(limit)
