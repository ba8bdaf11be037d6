import random

import numpy as np
import pytest

from forumlens.llm import token_counts as T


def brute(files, sep):
    out = []
    for name, ids in files.items():
        n = size = 0
        for i in ids:
            if i == sep:
                out.append((name, n, size, True))
                n, size = n + 1, 0
            else:
                size += 1
        if size:
            out.append((name, n, size, False))
    return sorted(out)


@pytest.mark.parametrize("width, kind", [(2, "<u2"), (4, "<u4")])
@pytest.mark.parametrize("above", [1, 3, 4096])
def test_scan_of_files(spark, tmp_path, monkeypatch, width, kind, above):
    monkeypatch.setattr(T, "SUPER", above)
    monkeypatch.setattr(T, "RANGE", 1 + above % 4)
    r = random.Random(above * width)
    files = {f"f{k}": [r.choice([7] + [8] * (k * 6 + 1)) for _ in range(r.choice([0, 1, 8, 16, 129]))] for k in range(9)} | {"none": [8] * 100, "all": [7] * 33}
    for name, ids in files.items():
        np.array(ids, kind).tofile(tmp_path / name)
    (tmp_path / "odd").write_bytes(np.array([8, 7, 8], kind).tobytes() + b"\x07")
    files["odd"] = [8, 7, 8]
    blocks = T.read_token_files(spark, f"file://{tmp_path}", width=width, block_tokens=8)
    if above == 3:  # a store that only Spark can open
        monkeypatch.setattr(T, "store", lambda uri: None)
        blocks = blocks.union(T.read_token_files(spark, f"file://{tmp_path}", width=width, block_tokens=8)).distinct()
    got = sorted((x.file.rsplit("/", 1)[1], x.document, x.n_tokens, x.terminated) for x in T.separator_scan(blocks, 7, width=width).collect())
    assert got == brute(files, 7)


def test_gaps_nulls_and_empty(spark):
    rows = [("a", 0, np.array([1, 9, 1], "<u4").tobytes(), "x"), ("a", 5, None, "x"), ("a", 9, b"", "x"), ("a", 70000, np.array([1, 1, 9], "<u4").tobytes(), "x")]
    blocks = spark.createDataFrame(rows, "file string, block long, payload binary, seps string")
    assert sorted(map(tuple, T.separator_scan(blocks, 9).collect())) == [("a", 0, 1, True), ("a", 1, 3, True)]
    assert T.separator_scan(blocks.limit(0), 9).collect() == []


def test_counts_equal_direct_tokenising(documents, awkward, monkeypatch):
    import base64

    tiktoken = pytest.importorskip("tiktoken")
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("t", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = sorted(((r.doc_id, r.n_tokens) for r in T.token_counts(documents(awkward), path, public.PATTERN, 50256).collect()), key=str)
    assert got == sorted(((i, len(coder.encode_ordinary(t or ""))) for i, t in awkward), key=str)
    assert T.token_counts(documents([]), path, public.PATTERN, 50256).collect() == []


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    ids = np.tile(np.array([5] * 99 + [7], "<u2"), 20_000)
    ids.tofile(tmp_path / "one.tok")
    blocks = T.read_token_files(spark, f"file://{tmp_path}", width=2, block_tokens=1000)
    spread = blocks.groupBy(T.F.spark_partition_id()).count().collect()
    assert len(spread) > 1 and sum(r["count"] for r in spread) == 2000
    assert T.separator_scan(blocks, 7, width=2).groupBy("n_tokens").count().collect() == [(99, 20_000)]


def test_flat_files_hold_the_tokens(spark, documents, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    rows = [(i, f"text number {i} " * (i % 7)) for i in range(40)]
    manifest, width = T.write_tokens(documents(rows), f"file://{tmp_path}/flat", public.path("byte_bpe_50k.tiktoken"), public.PATTERN, 50256)
    files = sorted(p.name for p in (tmp_path / "flat").iterdir())
    assert files and all(f.startswith("part-") for f in files) and width == 2
    import base64

    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as f:
        coder = tiktoken.Encoding("t", pat_str=public.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    where = {(r.file, r.document): r.doc_id for r in manifest.collect()}
    texts = {}
    for f in files:
        ids = np.fromfile(tmp_path / "flat" / f, "<u2")
        for k, part in enumerate(np.split(ids, np.flatnonzero(ids == 50256) + 1)[:-1]):
            texts[where[f, k]] = coder.decode(part[:-1].tolist())
    assert texts == dict(rows)
