"""Fill-in-the-middle: texts cut at line ends and told in another order between sentinels.

The UTF-8 bytes of a batch are viewed as 64-bit words.  The bytes that end a line (and those that
start a code point) are marked by arithmetic on whole words; ``bitwise_count`` and a running sum
tell how many marks stand before each word.  The k-th mark is found by a search of that sum for
its word and by byte-wise prefix counts inside the word.  No text is walked byte by byte.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import slices, text_buffer

U64 = np.uint64
_ONES = U64(0x0101010101010101)
_LOW = U64(0x7F7F7F7F7F7F7F7F)
_HIGH = U64(0x8080808080808080)

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def as_words(buf: np.ndarray) -> np.ndarray:
    """The bytes as little-endian 64-bit words, zero-padded, with one whole word to spare."""
    padded = np.zeros((len(buf) // 8 + 1) * 8, np.uint8)
    padded[:len(buf)] = buf
    return padded.view("<u8")


def marks_of(words: np.ndarray, byte: int) -> np.ndarray:
    """The top bit of every byte that equals ``byte``; exact, as no carry leaves a byte."""
    x = words ^ (_ONES * U64(byte))
    return ~(((x & _LOW) + _LOW) | x) & _HIGH


def starts_of(words: np.ndarray) -> np.ndarray:
    """The top bit of every byte that starts a code point, which is not of the form 10xxxxxx."""
    return ~(words & ~(words << U64(1))) & _HIGH


class Marks:
    """Rank and select over marked bytes."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(marks), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marks on the bytes before each position."""
        word, byte = at >> 3, (at & 7).astype(U64)
        inside = self.marks[word] & ((U64(1) << (byte * U64(8))) - U64(1))
        return self.before[word] + np.bitwise_count(inside)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th mark, counted from 1."""
        word = np.searchsorted(self.before, k, "left") - 1
        left = (k - self.before[word]).astype(U64)
        up_to = (self.marks[word] >> U64(7)) * _ONES  # byte i: marks on the bytes 0 to i
        fewer = ~((up_to | _HIGH) - left * _ONES) & _HIGH
        return word * 8 + np.bitwise_count(fewer).astype(np.int64)


def cut(buf: np.ndarray, offs: np.ndarray, first: np.ndarray, second: np.ndarray) -> dict[str, np.ndarray]:
    """Units of each text and two cuts after first % (n + 1) and second % (n + 1) of them, in order."""
    words = as_words(buf)
    lines, points = Marks(marks_of(words, 10)), Marks(starts_of(words))
    start, end = offs[:-1], offs[1:]
    before = lines.rank(start)
    ended = lines.rank(end) - before
    tail = (end > start) & (buf[np.maximum(end - 1, 0)] != 10) if len(buf) else np.zeros(len(start), bool)
    n = ended + tail

    def place(units: np.ndarray) -> np.ndarray:
        out = np.where(units == 0, start, end)
        inner = (units > 0) & (units < n)
        out[inner] = lines.select((before + units)[inner]) + 1
        return out

    a, b = first % (n + 1), second % (n + 1)
    one, two = place(np.minimum(a, b)), place(np.maximum(a, b))
    at = points.rank(start), points.rank(one), points.rank(two)
    return {"n": n, "one": one, "two": two, "prefix_chars": at[1] - at[0], "middle_chars": at[2] - at[1]}


def _draw(seed: int, number: int) -> Column:
    """The number-th 8-digit group of the hex sha256 of ``seed:doc_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * number + 1, 8), 16, 10).cast("bigint")


def fill_in_middle(docs: DataFrame, rate: int = 100, spm: int = 50, seed: int = 7) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row of ``docs``.

    A text's units are its lines with their ends.  Two cuts after whole units, drawn from the
    sha256 of seed and doc_id, part it into prefix, middle and suffix.  Of 100 texts, ``rate`` are
    rearranged; of 100 of these, ``spm`` as suffix, prefix, middle and the others as prefix,
    suffix, middle.  Texts that are empty or hold a sentinel stay plain, with null lengths.

    A null text is empty, a null doc_id is drawn as an empty one.  Rows are handled one by one:
    repeated rows give repeated results, an empty table none, and other columns are left behind.
    Memory: a few times a slice of 8 MB of text, or of one longer text.  One map, no shuffle.
    """
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(iter([batch]), "text"):
                yield _rearranged(part, rate, spm)

    drawn = docs.select("doc_id", "text", *[_draw(seed, i).alias(f"_h{i + 1}") for i in range(4)])
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType()),
    ])
    return drawn.mapInArrow(parts, schema)


def _rearranged(part: pa.RecordBatch, rate: int, spm: int) -> pa.RecordBatch:
    buf, offs = text_buffer(part.column("text"))
    h1, h2, h3, h4 = (part.column(f"_h{i}").to_numpy(zero_copy_only=False) for i in (1, 2, 3, 4))
    cuts = cut(buf, offs, h1, h2)
    texts = part.column("text").fill_null("")
    marked = np.zeros(part.num_rows, bool)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        marked |= pc.match_substring(texts, sentinel).to_numpy(zero_copy_only=False)
    plain = (offs[1:] == offs[:-1]) | marked | (h3 % 100 >= rate)
    suffix_first = h4 % 100 < spm
    data, p, s, m = buf.tobytes(), PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    outputs = []
    for i, (start, one, two, end) in enumerate(zip(offs[:-1].tolist(), cuts["one"].tolist(), cuts["two"].tolist(), offs[1:].tolist())):
        if plain[i]:
            outputs.append(data[start:end])
        elif suffix_first[i]:
            outputs.append(b"".join((s, data[two:end], p, data[start:one], m, data[one:two])))
        else:
            outputs.append(b"".join((p, data[start:one], s, data[two:end], m, data[one:two])))
    form = np.where(plain, "plain", np.where(suffix_first, "spm", "psm"))
    return pa.RecordBatch.from_pydict({
        "doc_id": part.column("doc_id"), "n": pa.array(cuts["n"], pa.int64()), "form": pa.array(form.tolist(), pa.string()),
        "prefix_chars": pa.array(cuts["prefix_chars"], pa.int64(), mask=plain),
        "middle_chars": pa.array(cuts["middle_chars"], pa.int64(), mask=plain),
        "output": pa.array(outputs, pa.binary()).cast(pa.string()),
    })


def restored(output: Column, form: Column) -> Column:
    """The text an output was made from.  Parts hold no sentinel, so each splits the output once."""
    def after(sentinel: str, next_one: str) -> Column:
        return F.split_part(F.split_part(output, F.lit(sentinel), F.lit(2)), F.lit(next_one), F.lit(1))

    prefix = F.when(form == "spm", after(PREFIX, MIDDLE)).otherwise(after(PREFIX, SUFFIX))
    suffix = F.when(form == "spm", after(SUFFIX, PREFIX)).otherwise(after(SUFFIX, MIDDLE))
    middle = F.split_part(output, F.lit(MIDDLE), F.lit(2))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, middle, suffix))
