"""Exact token counts of every prefix of a text by prefix dynamic programming.

Byte-pair encodings have one last token per prefix: ``encode(text[:i])`` is ``encode(text[:i - len(t)])`` and t, where t
is the only token ending at i that may follow the last token of the shorter prefix. Two tokens may follow each other if
encoding their joint text gives them back. So one pass from left to right, which tries the tokens ending at each position,
stores the last token and the count of every prefix. Counts of prefixes are stored once; how many tokens a truncation
leaves, and the longest prefix within a budget, are then look-ups. Segments are independent (see ``pieces``), hence the
pass runs once per distinct part of a segment and worker, and a text's counts are its parts' counts and the sums before
them.

Defined cases: null text counts as empty, with no tokens; a character outside the vocabulary counts as its bytes; rows
with the same ids are separate; other columns are ignored.
"""

from __future__ import annotations

from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm import shingles as sh
from quadrat.llm.pieces import VISIBLE_SPACE, Parts, Vocabulary, default_model, spread, vocabulary
from quadrat.llm.shared import ship

CACHED = 300_000  # segments kept in a worker; the store starts anew beyond that


class PrefixCounter:
    """Counts at every prefix of parts of segments, kept for parts met before."""

    def __init__(self, model: Vocabulary):
        self.model = model
        self.pairs: dict[tuple[str, str], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.parts = Parts(self.model, self.add)
        self.begins, self.counts = array("q", [0]), array("I")
        if len(self.pairs) > CACHED:
            self.pairs.clear()

    def add(self, parts: list[str]) -> None:
        for part in parts:
            self.counts.extend(self.prefix_counts(part))
            self.begins.append(len(self.counts))

    def merged(self, text: str) -> list[str]:
        """Byte-pair encoding of a short text: the adjacent pair of the lowest rank is merged, the leftmost of equals."""
        parts, ranks = list(text), self.model.ranks
        while len(parts) > 1:
            found = [(ranks[both], k) for k in range(len(parts) - 1) if (both := parts[k] + parts[k + 1]) in ranks]
            if not found:
                break
            k = min(found)[1]
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def may_follow(self, last: str, token: str) -> bool:
        good = self.pairs[last, token] = self.merged(last + token) == ([last, token] if last else [token])
        return good

    def prefix_counts(self, segment: str) -> list[int]:
        """Tokens of every non-empty prefix of a part; a character outside the vocabulary parts what is around it."""
        ids, reach, pairs = self.model.ids, self.model.reach, self.pairs
        counts, last, wall = [0], [""], 0
        for i in range(1, len(segment) + 1):
            k = i - reach.get(segment[i - 3:i], 2) if i > 2 else 0
            if k < wall:
                k = wall
            while k < i:
                token = segment[k:i]
                if token in ids:
                    before = last[k]
                    good = pairs.get((before, token))
                    if good or (good is None and self.may_follow(before, token)):
                        counts.append(counts[k] + 1)
                        last.append(token)
                        break
                k += 1
            else:
                counts.append(counts[-1] + len(segment[i - 1].encode()))
                last.append("")
                wall = i
        del counts[0]
        return counts

    def of_texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of texts in a buffer, each with a space in front: tokens of each text, tokens of all prefixes, offsets of these by text.

        A text's prefixes have from 0 to all characters.
        """
        parts, bounds = self.parts.sequence(data, offsets)
        begins, counts = np.frombuffer(self.begins, np.int64), np.frombuffer(self.counts, np.uint32)
        low, high = begins[parts], begins[parts + 1]
        upto = np.concatenate([[0], np.cumsum(counts[high - 1].astype(np.int64))])
        texts = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        out = spread(counts, low, high) + np.repeat(upto[:-1] - upto[bounds[:-1]][texts], high - low)
        places = np.concatenate([[0], np.cumsum(high - low)])[bounds]
        out[places[:-1][np.diff(places) > 0]] = 0  # the model adds no space before an empty text
        return upto[bounds[1:]] - upto[bounds[:-1]], out, places

    def of_text(self, text: str) -> np.ndarray:
        """Tokens of ``text[:k]`` for k from 0 to its length."""
        raw = np.frombuffer(f" {text.replace(VISIBLE_SPACE, ' ')}".encode(), np.uint8)
        return self.of_texts(raw, np.array([0, len(raw)]))[1] if text else np.zeros(1, np.int64)


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _counters:
        _counters[path] = PrefixCounter(vocabulary(path))
    if len(_counters[path].parts.begins) > CACHED:
        _counters[path].clear()
    return _counters[path]


def pack(counts: np.ndarray) -> bytes:
    """Prefix counts as steps of one signed byte: a step is at most a character's bytes up, or a piece's length down."""
    return np.diff(counts).astype(np.int8).tobytes()


def unpack(steps: bytes) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.frombuffer(steps, np.int8).astype(np.int64))])


def longest_within(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most so many tokens."""
    return int(np.flatnonzero(counts <= budget)[-1])


def token_counts(docs: DataFrame, budget: int, model_path: str | None = None, keep_prefixes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_chars, n_tokens, fit_chars (longest prefix within the budget) and, if kept, prefix_steps."""
    path = model_path or default_model()
    ship(docs.sparkSession)
    schema = "doc_id long, n_bytes long, n_chars long, n_tokens long, fit_chars long" + ", prefix_steps binary" * keep_prefixes

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = sh.text_buffer(batch.column(2))
            found = []
            for low, high in sh.pieces(offsets):
                tokens, prefixes, places = counter(path).of_texts(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
                fits = np.maximum(np.diff(places) - 1, 0)
                for k in np.flatnonzero(tokens > budget):
                    fits[k] = longest_within(prefixes[places[k]:places[k + 1]], budget)
                steps = [pack(prefixes[a:b]) if b > a else b"" for a, b in zip(places[:-1], places[1:], strict=True)] if keep_prefixes else []
                found.append((np.maximum(np.diff(places) - 1, 0), tokens, fits, steps))
            longs = [pa.array(np.concatenate(x), pa.int64()) for x in list(zip(*found, strict=True))[:3]]
            steps = [pa.array([y for x in found for y in x[3]], pa.binary())] if keep_prefixes else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *longs, *steps], [x.split()[0] for x in schema.split(", ")])

    text = F.coalesce("text", F.lit(""))
    spaced = F.when(text == "", text).otherwise(F.concat(F.lit(" "), F.replace(text, F.lit(VISIBLE_SPACE), F.lit(" "))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), spaced.alias("spaced"))
    return rows.mapInArrow(run, schema)


def from_prefixes(store: DataFrame, budget: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens, fit_chars, looked up in the stored prefix counts."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, n_bytes, steps = batch.columns
            tokens, fits = [], []
            for x in steps:
                counts = unpack(x.as_py())
                tokens.append(int(counts[-1]))
                fits.append(longest_within(counts, budget))
            yield pa.RecordBatch.from_arrays([ids, n_bytes, pa.array(tokens, pa.int64()), pa.array(fits, pa.int64())], ["doc_id", "n_bytes", "n_tokens", "fit_chars"])

    return store.select("doc_id", "n_bytes", "prefix_steps").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, fit_chars long")
