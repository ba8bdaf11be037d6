"""Near duplicates by weighted MinHash over hierarchical Poisson processes, banding, and exact verification.

Every distinct word shingle x with count c owns the weight interval [0, c). The weight axis is cut
into dyadic blocks [0, 1), [1, 2), [2, 4), [4, 8)...; each block has an independent Poisson process
seeded by (x, block), whose points come in order of time and carry a register and a place on the
weight axis. A register keeps the earliest point whose place lies below c. Two documents agree in a
register with probability equal to their weighted (multiset) Jaccard similarity, and a shingle of a
large count costs its logarithm only. Registers are banded; candidates are verified on the real
multisets of shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PRESENT, U64, binary_column, each_salt, mix, only, prepare, salted, shingles_of, slices, spread, stage, trim, unstage
from .components import components

GOLDEN = 0x9E3779B97F4A7C15


def step(k: int) -> np.uint64:
    return U64(k * GOLDEN & 0xFFFFFFFFFFFFFFFF)


def counted(value: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number, shingle and count of each distinct shingle of a document."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return owner[at], value[at], np.diff(np.concatenate([at, [len(value)]]))


def signatures(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, n: int, registers: int) -> np.ndarray:
    """n x registers point ids (0 where a document has no shingle)."""
    node_doc, node_seed, node_lo, node_len, node_cap = [], [], [], [], []
    level, lo, length = 0, 0, 1
    left = np.arange(len(doc))
    while len(left):
        node_doc.append(doc[left])
        node_seed.append(mix(shingle[left] + step(level + 1)))
        node_lo.append(np.full(len(left), lo, np.int64))
        node_len.append(np.full(len(left), length, np.int64))
        node_cap.append(count[left])
        lo += length
        level, length = level + 1, lo
        left = left[count[left] > lo]
    first = np.full(n * registers, np.inf)
    owner = np.zeros(n * registers, U64)
    if not node_doc:
        return owner.reshape(n, registers)
    d, seed, lo, ln, cap = (np.concatenate(x) for x in (node_doc, node_seed, node_lo, node_len, node_cap))
    t = np.zeros(len(d))
    k = 0
    while len(d):
        k += 1
        r = mix(seed + step(k))
        t = t - np.log1p(-((r >> U64(11)).astype(np.float64) * 2.0**-53)) / (ln * registers)
        s = mix(r ^ U64(0xD6E8FEB86659FD93))
        place = lo + (((s >> U64(32)) * ln.astype(U64)) >> U64(32)).astype(np.int64)
        hit = place < cap
        slot = (d * registers + ((s & U64(0xFFFFFFFF)) % U64(registers)).astype(np.int64))[hit]
        th, rh = t[hit], r[hit]
        np.minimum.at(first, slot, th)
        best = th == first[slot]
        owner[slot[best]] = rh[best]
        docs = np.unique(d)
        last = np.zeros(n)
        last[docs] = first.reshape(n, registers)[docs].max(axis=1)
        keep = t < last[d]
        d, seed, lo, ln, cap, t = d[keep], seed[keep], lo[keep], ln[keep], cap[keep], t[keep]
    return owner.reshape(n, registers)


def _banded(size: int, bands: int, rows: int):
    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("same", pa.binary()), ("n", pa.int64()), ("bands", pa.list_(pa.int64()))])
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                data, offsets = binary_column(batch.column("text"))
                value, at = shingles_of(data, offsets, size)
                n = batch.num_rows
                sig = signatures(*counted(value, at), n, bands * rows).reshape(n, bands, rows)
                key = np.zeros((n, bands), U64)
                for i in range(rows):
                    key = mix(key + sig[:, :, i] * step(1) + U64(i))
                key = mix(key + np.arange(bands, dtype=U64)).view(np.int64)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands, dtype=np.int32)), pa.array(key.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("same"), pa.array(np.diff(at)), flat], schema=schema)

    return run


def _verified(size: int, least: float):
    def run(batches):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])
        for whole in batches:
            for half in slices(whole, "text_a", 1 << 19):
                for batch in slices(half, "text_b", 1 << 19):
                    n = batch.num_rows
                    (da, sa, ca), (db, sb, cb) = (counted(*shingles_of(*binary_column(batch.column(c)), size)) for c in ("text_a", "text_b"))
                    d, s, c = np.concatenate([da, db]), np.concatenate([sa, sb]), np.concatenate([ca, cb])
                    order = np.lexsort((s, d))
                    d, s, c = d[order], s[order], c[order]
                    twice = np.flatnonzero((d[1:] == d[:-1]) & (s[1:] == s[:-1])) if len(d) else np.zeros(0, np.int64)
                    low = np.bincount(d[twice], np.minimum(c[twice], c[twice + 1]), n) if len(twice) else np.zeros(n)
                    total = np.bincount(d, c, n) if len(d) else np.zeros(n)
                    sim = low / np.maximum(total - low, 1)
                    ok = np.flatnonzero(sim >= least - 1e-12)
                    yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(ok)), batch.column("b").take(pa.array(ok)), pa.array(sim[ok])], schema=schema)

    return run


def _links(pairs: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """The pairs(a, b) whose texts overlap enough.

    Both are sort-merge joins at every size: skew handling can split a hot leader, and no list of ids is broadcast.
    """
    b = pairs.hint("merge").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = b.hint("merge").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_verified(size, least), "a long, b long, similarity double")


def _joined_blocks(size: int, least: float):
    """Sorted rows of (band, p, q) blocks -> links that join components of one block, at most one less than it has texts."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def join(rep: list[int], component: list[int], texts: list[bytes]):
        root = {c: c for c in component}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        if len(root) < 2:
            return
        doc, shingle, count = counted(*shingles_of(*binary_column(pa.array(texts, pa.binary())), size))
        total = np.bincount(doc, count, len(rep))
        # a shingle counted c times is c items, so that the overlap of multisets is that of sets
        doc, shingle = np.repeat(doc, count), np.repeat(shingle, count)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        _, item = np.unique(mix(shingle + nth.astype(U64) * step(1)), return_inverse=True)
        shared = np.bincount(item) > 1
        dense = np.cumsum(shared) - 1
        doc, item = doc[shared[item]], dense[item[shared[item]]]
        common = np.zeros((len(rep), len(rep)), np.float32)
        order = np.argsort(item, kind="stable")
        doc, item = doc[order], item[order]
        for lo in range(0, int(item[-1]) + 1 if len(item) else 0, COLUMNS):
            at = slice(*np.searchsorted(item, [lo, lo + COLUMNS]))
            part = np.zeros((len(rep), COLUMNS), np.float32)
            part[doc[at], item[at] - lo] = 1
            common += part @ part.T
        for i, j in zip(*np.nonzero(np.triu(common >= (least - 1e-12) * (total[:, None] + total[None, :] - common), 1))):
            x, y = find(component[i]), find(component[j])
            if x != y:
                root[max(x, y)] = min(x, y)
                yield min(rep[i], rep[j]), max(rep[i], rep[j])

    def run(batches):
        def blocks():
            key, rows = None, []
            for batch in batches:
                for *at, rep, component, text in zip(*(batch.column(c).to_pylist() for c in ("band", "p", "q", "rep", "component", "text"))):
                    if at != key:
                        if rows:
                            yield zip(*rows)
                        key, rows = at, []
                    rows.append((rep, component, text.encode()))
            if rows:
                yield zip(*rows)

        for rep, component, texts in blocks():
            links = list(join(list(rep), list(component), list(texts)))
            if len(texts) > BLOCK_TEXTS // 4:
                trim()
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], schema=schema)

    return run


#: Items whose overlaps are counted at once in a block, and texts and words of half a block.
COLUMNS, BLOCK_TEXTS, BLOCK_WORDS = 8192, 256, 250_000
#: Texts that may share an item for it to be searched by.
RARE = 64


def _items(size: int):
    """Texts -> their shingles as a set: a shingle counted c times is c items. n is the size of the set."""
    schema = pa.schema([("rep", pa.int64()), ("h", pa.int64()), ("n", pa.int32()), ("item", pa.int64())])

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", 1 << 19):
                doc, shingle, count = counted(*shingles_of(*binary_column(batch.column("text")), size))
                n = np.bincount(doc, count, batch.num_rows).astype(np.int32)
                doc, shingle = np.repeat(doc, count), np.repeat(shingle, count)
                nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays([batch.column("rep").take(take), batch.column("h").take(take), pa.array(n[doc]), pa.array(mix(shingle + nth.astype(U64) * step(1)).view(np.int64))], schema=schema)

    return run


def _by_rare_items(reps: DataFrame, texts: DataFrame, size: int, least: float, keep) -> tuple[DataFrame, DataFrame]:
    """reps(rep, component) -> pairs (a, b) of different components to verify, and the reps that must be compared otherwise.

    Two sets that overlap by `least` share one of the n - ceil(least * n) + 1 rarest items of each (in any one order of
    items), and an item that one text alone has is shared with none. So texts are joined by the rarest of their
    items that occur twice. An item that more than RARE texts have is never joined by: the texts that would need one
    are returned, and only pairs of two such texts are left to them. Different texts of one id are sets of their own.
    """
    found = texts.select(F.col("doc_id").alias("rep"), "text", F.xxhash64("text").alias("h")).join(reps.select("rep").distinct(), "rep").dropDuplicates(["rep", "h"])
    items = salted(keep(found.select("rep", "h", "text").mapInArrow(_items(size), "rep long, h long, n int, item long"), "items"), "rep", "h")
    common = keep(items.groupBy("item").agg(F.count("*").alias("f"), F.expr(PRESENT)).where("f > 1"), "common")
    known = items.join(each_salt(common), ["item", "salt"]).groupBy("rep", "h").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("f", "item"))).alias("x"))
    need = F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1  # as long a prefix, less the items of one text, which come first
    known = known.withColumn("need", F.greatest(F.lit(0), need - (F.col("n") - F.size("x"))).cast("int"))
    prefix = keep(known.select("rep", F.slice("x", F.lit(1), F.col("need")).alias("x")).where(F.size("x") > 0).join(reps, "rep"), "prefixes")
    crowd = prefix.where(F.element_at("x", -1)["f"] > RARE).select("rep")
    one = prefix.select("rep", "component", F.explode(F.filter("x", lambda i: i["f"] <= RARE)).alias("i")).select("rep", "component", F.col("i.item").alias("item"))
    two = one.select(F.col("rep").alias("b"), F.col("component").alias("other"), "item")
    pairs = one.hint("merge").join(two, "item").where((F.col("rep") > F.col("b")) & (F.col("component") != F.col("other")))
    return pairs.select("b", F.col("rep").alias("a")).distinct(), crowd


def near_duplicates(docs: DataFrame, *, size: int = 5, similarity: float = 0.8, bands: int = 36, rows: int = 7) -> DataFrame:
    """docs(doc_id, text, ...) -> one row per document: doc_id, class_id.

    class_id is the least doc_id of the document's class: texts joined, directly or through others,
    by verified multiset Jaccard similarity of at least `similarity` over runs of `size` words.
    With 36 bands of 7 registers a pair at exactly 0.8 becomes a candidate with probability 0.9998.

    Equal texts collapse to one representative before banding, so copies never meet in pairs. In a
    bucket every text is first compared with one leader, a different one in each band. Buckets that
    then still hold texts of several components are settled whole: small ones in one block that gives back
    spanning links only; in larger ones texts are joined by their rarest shingles, each shared by RARE texts at most
    (see _by_rare_items), and only texts whose rarest shared shingles are all common are compared in blocks.

    A null text counts as empty; a text without words is a class of its own; one of fewer than `size`
    words has one shingle. Rows with a null doc_id are in no class and keep a null class_id. Repeated
    doc_ids with equal texts share a class. An empty table gives no rows. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    texts = only(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    marked = spread(texts).withColumn("same", F.unhex(F.md5(F.col("text").cast("binary"))))
    signed = stage(marked.mapInArrow(_banded(size, bands, rows), "doc_id long, same binary, n long, bands array<long>"), "signed")
    worded = signed.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    firsts = stage(worded.groupBy("same").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")), "firsts")
    member = firsts.select("rep", "n", F.explode("bands").alias("band"))
    rank = F.struct(F.xxhash64("rep", "band").alias("h"), "rep")
    bucket = member.groupBy("band").agg(F.count("*").alias("k"), F.sum("n").alias("words"), F.min(rank)["rep"].alias("lead"), F.max(rank)["rep"].alias("last")).where("k > 1")
    bucket = stage(bucket, "buckets")
    crowd = stage(member.join(bucket.where("k > 2").drop("last"), "band"), "crowds")
    star = bucket.where("k = 2").select("lead", F.col("last").alias("rep")).union(crowd.where("rep != lead").select("lead", "rep"))
    star = star.select(F.least("lead", "rep").alias("b"), F.greatest("lead", "rep").alias("a")).distinct()
    links = stage(_links(star, texts, size, similarity).select("a", "b"), "links")
    known = components(links)
    placed = crowd.join(known.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    placed = stage(placed, "placed")
    made = [bucket, crowd, links, placed]

    def keep(df: DataFrame, name: str) -> DataFrame:
        made.append(stage(df, name))
        return made[-1]

    unsettled = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("band")
    parts = lambda k, words: F.greatest(F.ceil(k / BLOCK_TEXTS), F.ceil(words / BLOCK_WORDS)).cast("int")
    inside = keep(placed.join(unsettled, "band").select("band", "rep", "component", "n", parts(F.col("k"), F.col("words")).alias("parts")), "unsettled")
    pairs, common = _by_rare_items(inside.where("parts > 1").select("rep", "component").distinct(), texts, size, similarity, keep)
    near = keep(_links(pairs, texts, size, similarity).select("a", "b"), "links")
    # what is left of the larger buckets: texts that are searched by no rare item, at least two of them
    left = inside.where("parts > 1").join(common, "rep").select("band", "rep", "component", "n")
    sizes = left.groupBy("band").agg(F.count("*").alias("k"), F.sum("n").alias("words")).where("k > 1")
    left = left.join(sizes.select("band", parts(F.col("k"), F.col("words")).alias("parts")), "band")
    inside = inside.where("parts = 1").select("band", "rep", "component", "parts").union(left.select("band", "rep", "component", "parts"))
    inside = inside.withColumn("own", F.pmod(F.xxhash64("rep"), "parts").cast("int"))
    inside = inside.select("band", "rep", "component", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    inside = inside.select("band", "rep", "component", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
    blocks = inside.hint("merge").join(texts.select(F.col("doc_id").alias("rep"), "text"), "rep")
    blocks = blocks.repartition("band", "p", "q").sortWithinPartitions("band", "p", "q")
    more = keep(blocks.mapInArrow(_joined_blocks(size, similarity), "a long, b long"), "links")
    stars = known.select(F.col("id").alias("a"), F.col("component").alias("b"))  # what the first links join, in its shortest form
    group = stage(components(stars.union(near).union(more)), "classes")
    unstage(*made)
    of_text = firsts.select("same", F.col("rep").alias("id")).join(group, "id", "left").select("same", F.coalesce("component", "id").alias("class_id"))
    out = signed.select("doc_id", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("same")).alias("same")).join(of_text, "same", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """One document of each class of near duplicates, with all its columns: that of the least doc_id.

    Rows with a null doc_id are in no class and stay. Where rows repeat the least doc_id of a class, one row of each different text
    of theirs stays (null counts as empty): the one whose columns have the least hash. Columns may have any name.
    """
    classes = near_duplicates(docs, **options).where("doc_id is not null")
    inner = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    at = {name: f"c{i}" for i, name in enumerate(docs.columns)}
    id_, text = inner[at["doc_id"]].cast("long"), F.coalesce(inner[at["text"]].cast("string"), F.lit(""))
    first = stage(classes.where("doc_id = class_id").groupBy("doc_id").agg(F.count("*").alias("k")).select(F.col("doc_id").alias("kept_id"), "k"), "kept")
    kept = inner.join(first.where("k = 1"), id_ == F.col("kept_id"), "left_semi")
    if not first.where("k > 1").isEmpty():
        hashed = F.xxhash64(*(c for c, t in inner.dtypes if "map<" not in t and "variant" not in t))
        several = inner.join(first.where("k > 1"), id_ == F.col("kept_id"), "left_semi")
        several = several.groupBy(id_.alias("kept_id"), F.xxhash64(text).alias("th")).agg(F.min_by(F.struct(*inner.columns), hashed).alias("row"))
        kept = kept.union(several.select("row.*"))
    return kept.union(inner.where(id_.isNull())).toDF(*docs.columns)
