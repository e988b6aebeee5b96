"""Fill-in-middle form of whole texts: prefix, suffix and middle are cut at random unit ends and put in another order.

A unit is a run of ASCII letters or one other code point. The texts of a batch are laid out as 64-bit words, each text
from a new word on and with a zero byte at least behind it. Letters and continuation bytes are marked by word arithmetic,
eight bytes at a time; a byte ends a unit if neither both it and the next are letters nor the next continues a code point.
The marks of a word are counted by ``bitwise_count``; a unit's number is searched in the running count for its word, and
the byte in the word follows from the prefix counts of its eight marks, again by word arithmetic. No text is scanned unit
by unit, whatever its length.

The draws are digits of a hash of seed and doc_id, made by Spark. Without shuffle; a text's work is its length.

Defined cases: null text counts as empty; a text that is empty, holds one of the markers, or is not drawn stays plain,
with null for the lengths of its parts; a null doc_id is hashed as an empty string; rows with the same doc_id are
separate and cut by the same draws; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.llm import shingles as sh
from quadrat.llm.shared import ship

PREFIX, SUFFIX, MIDDLE = MARKERS = ("<P>", "<S>", "<M>")
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"

ONES = np.uint64(0x0101010101010101)
HIGH = np.uint64(0x8080808080808080)


def each(byte: int) -> np.uint64:
    """A word with this byte eight times."""
    return np.uint64(byte) * ONES


def letters(words: np.ndarray) -> np.ndarray:
    """High bit of each byte that is A-Z or a-z; sums of seven bits and a constant don't reach the next byte."""
    low = (words | each(0x20)) & each(0x7F)
    return (low + each(0x80 - ord("a"))) & ~(low + each(0x80 - ord("z") - 1)) & ~words & HIGH


def continuations(words: np.ndarray) -> np.ndarray:
    """High bit of each byte 10xxxxxx."""
    return words & ~(words << np.uint64(1)) & HIGH


def of_next(marks: np.ndarray) -> np.ndarray:
    """For each byte the mark of the byte behind it, over the words' ends."""
    out = marks >> np.uint64(8)
    out[:-1] |= marks[1:] << np.uint64(56)
    return out


class Units:
    """Unit ends and code points of the texts of a batch, for look-ups by number and by place."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        lengths = np.diff(offsets)
        n_words = lengths // 8 + 1
        self.first = np.concatenate([[0], np.cumsum(n_words)])  # first word of each text
        padded = np.zeros(int(self.first[-1]) * 8, np.uint8)
        padded[np.arange(len(data)) + np.repeat(self.first[:-1] * 8 - offsets[:-1], lengths)] = data
        words = padded.view("<u8").astype(np.uint64, copy=False)
        inside = np.full(len(words), HIGH)
        inside[self.first[1:] - 1] &= (np.uint64(1) << (8 * (lengths % 8)).astype(np.uint64)) - np.uint64(1)
        follows, letter = continuations(words), letters(words)
        self.ends = ~(letter & of_next(letter)) & ~of_next(follows) & inside
        self.points = ~follows & inside
        self.n_ends = np.concatenate([[0], np.cumsum(np.bitwise_count(self.ends).astype(np.int64))])
        self.n_points = np.concatenate([[0], np.cumsum(np.bitwise_count(self.points).astype(np.int64))])

    def counts(self) -> np.ndarray:
        """Units of each text."""
        return np.diff(self.n_ends[self.first])

    def byte_after(self, texts: np.ndarray, units: np.ndarray) -> np.ndarray:
        """Bytes of each text's first so many units."""
        rank = self.n_ends[self.first[texts]] + units
        word = np.searchsorted(self.n_ends, rank) - 1  # the last word with fewer ends before it
        out = (word - self.first[texts]) * 8 + select(self.ends[word], (rank - self.n_ends[word]).astype(np.uint64)) + 1
        return np.where(units == 0, 0, out)

    def points_before(self, texts: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Code points that begin before a byte of each text."""
        word = self.first[texts] + places // 8
        below = (np.uint64(1) << (8 * (places % 8)).astype(np.uint64)) - np.uint64(1)
        return self.n_points[word] + np.bitwise_count(self.points[word] & below) - self.n_points[self.first[texts]]


def select(marks: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Byte of the rank-th mark, from 1, in a word: as many bytes as have a smaller count of marks up to them."""
    upto = (marks >> np.uint64(7)) * ONES
    reached = ((upto | HIGH) - rank * ONES) & HIGH
    return 8 - np.bitwise_count(reached).astype(np.int64)


def rearranged(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    p, s, m = (x.encode() for x in MARKERS)
    return p + prefix + s + suffix + m + middle if form == "psm" else s + suffix + p + prefix + m + middle


def cut(data: np.ndarray, offsets: np.ndarray, draws: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of each text; bytes before the middle and behind it; code points there. ``draws`` has two columns."""
    units = Units(data, offsets)
    n = units.counts()
    at = np.sort(draws % (n + 1)[:, None], axis=1)
    texts = np.flatnonzero(wanted)
    places, points = np.zeros((2, len(n)), np.int64), np.zeros((2, len(n)), np.int64)
    for k in range(2):
        places[k, texts] = units.byte_after(texts, at[texts, k])
        points[k, texts] = units.points_before(texts, places[k, texts])
    return n, places, points


def draw(seed: int, k: int) -> Column:
    """The k-th group of eight hex digits, from 0, of the hash of seed and doc_id."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digits, 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, rate: int = 90, spm_rate: int = 20, seed: int = 1) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output; both rates in percent."""
    ship(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    marked = F.lit(False)
    for marker in MARKERS:
        marked = marked | F.contains(F.col("text"), F.lit(marker))
    form = (
        F.when((F.col("text") == "") | marked | (draw(seed, 2) % 100 >= rate), "plain")
        .when(draw(seed, 3) % 100 < spm_rate, "spm").otherwise("psm")
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", "text", form.alias("form"), draw(seed, 0).alias("h1"), draw(seed, 1).alias("h2"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = sh.text_buffer(batch.column(1))
            draws = np.stack([batch.column(k).to_numpy() for k in (3, 4)], axis=1)
            forms = np.array(batch.column(2).to_pylist())
            for low, high in sh.pieces(offsets, 1 << 23):
                base, own, form = offsets[low:high + 1] - offsets[low], data[offsets[low]:offsets[high]], forms[low:high]
                plain = form == "plain"
                n, places, points = cut(own, base, draws[low:high], ~plain)
                raw = own.tobytes()
                output = [
                    raw[a:b] if f == "plain" else rearranged(f, raw[a:a + i], raw[a + i:a + j], raw[a + j:b])
                    for a, b, f, i, j in zip(base[:-1].tolist(), base[1:].tolist(), form.tolist(), *places.tolist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(low, high - low), pa.array(n, pa.int64()), batch.column(2).slice(low, high - low),
                    pa.array(points[0], pa.int64(), mask=plain), pa.array(points[1] - points[0], pa.int64(), mask=plain),
                    pa.array(output, pa.binary()).cast(pa.string()),
                ], [x.split()[0] for x in SCHEMA.split(", ")])

    return rows.mapInArrow(run, SCHEMA)


def restored(output: str = "output", form: str = "form") -> Column:
    """The exact text, from output and form alone: the markers are in no text that was rearranged."""
    part = F.split(F.col(output), "|".join(MARKERS), -1)
    order = F.when(F.col(form) == "psm", F.concat(part[1], part[3], part[2])).otherwise(F.concat(part[2], part[3], part[1]))
    return F.when(F.col(form) == "plain", F.col(output)).otherwise(order)
