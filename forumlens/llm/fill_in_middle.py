"""Fill-in-the-middle forms of texts, cut at unit boundaries that big integers hold as bits.

A text is cut into units: runs of Latin letters, and every other code point alone. One translate() of the UTF-8
bytes drops continuation bytes and leaves a digit a code point, 1 for a letter; read as a binary number, that is
the mask of letters, bit i for code point i. A unit begins at each bit but those that are letters after a letter,
so one shift and a few boolean operations over whole numbers mark all boundaries, bit_count() gives their number,
and halving the number again and again finds the boundary of a rank. No unit is ever made as an object.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary_column, carried, prepare

PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
#: Letters become 1 and all else 0; continuation bytes go, so one byte is left for each code point.
LETTERS = bytes(0x31 if chr(b).isascii() and chr(b).isalpha() else 0x30 for b in range(256))
CONTINUATION = bytes(range(0x80, 0xC0))


def boundaries(raw: bytes) -> tuple[int, int]:
    """Code points of a UTF-8 text, and a number whose bit i is set if a unit begins at code point i."""
    digits = raw.translate(LETTERS, CONTINUATION)
    letters = int(digits[::-1] or b"0", 2)
    return len(digits), ((1 << len(digits)) - 1) & ~(letters & (letters << 1))


def ranked(bits: int, size: int, rank: int) -> int:
    """Position of the set bit with `rank` set bits below it; `size` if there is none."""
    if rank >= bits.bit_count():
        return size
    at = 0
    while size > 1:
        half = size >> 1
        low = bits & ((1 << half) - 1)
        below = low.bit_count()
        if rank < below:
            bits, size = low, half
        else:
            bits, size, rank, at = bits >> half, size - half, rank - below, at + half
    return at


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four numbers below 2**32 from a seed and an id; a null id draws as if it had no digits."""
    digest = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def rearranged(raw: bytes, draw: list[int], plain: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle (None if plain), and the text in that form."""
    text = raw.decode("utf-8", "replace")
    size, bits = boundaries(raw if text.isascii() else text.encode())
    n = bits.bit_count()
    if not text or any(m in text for m in MARKS) or draw[2] % 100 >= 100 - plain:
        return n, "plain", None, None, text
    a, b = (ranked(bits, size, k) for k in sorted(h % (n + 1) for h in draw[:2]))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if draw[3] % 100 < spm:
        return n, "spm", a, b - a, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return n, "psm", a, b - a, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def fill_in_middle(docs: DataFrame, *, seed: int = 1, plain: int = 10, spm: int = 20) -> DataFrame:
    """docs(doc_id, text, ...) with n, form, prefix_chars, middle_chars and output; all other columns are carried.

    `plain` of 100 texts stay as they are, `spm` of 100 others give the suffix first; both, and the two cuts, are drawn
    from a hash of seed and id, so that a lost task makes the same rows again. Null and empty texts are plain with n = 0
    and an empty output, and texts that hold a mark are plain. A null id draws as an id without digits; repeated rows are
    arranged alike; bytes that are not UTF-8 count as U+FFFD. A text is taken whole, of any length. Columns of docs that have the name of a new
    one are replaced; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    added = [("n", "long"), ("form", "string"), ("prefix_chars", "long"), ("middle_chars", "long"), ("output", "string")]

    def compute(texts: pa.Array, ids: pa.Array) -> list[pa.Array]:
        data, offsets = binary_column(texts)
        raw = data.tobytes()
        at = offsets.tolist()
        rows = [rearranged(raw[a:b], draws(seed, i), plain, spm) for a, b, i in zip(at, at[1:], ids.to_pylist())]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        return [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]

    return carried(docs, added, compute, ("text", "doc_id"))


def restored(output: Column, form: Column) -> Column:
    """The text from which an output of that form was made. The first of each mark is the real one, as the text holds none."""
    p, s, m = (F.instr(output, x) for x in MARKS)

    def between(left, right):
        return F.substring(output, left + F.lit(3), right - left - F.lit(3))

    middle = F.substring(output, m + F.lit(3), F.length(output))
    psm = F.concat(between(p, s), middle, between(s, m))
    spm = F.concat(between(p, m), middle, between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
