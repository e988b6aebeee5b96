"""Fingerprints of documents: quartile bucket digests of byte triplets.

Slide a window of five bytes over the text and count six triplets of each window (the last byte with each pair of the
four before it) in 256 buckets by a hash. The digest holds, for each bucket, the quarter its count falls in among all
bucket counts (two bits), and the logarithm of the length in steps of a tenth. Two digests differ by the sum over buckets of their
quarters' distance (6 instead of 3 between the outer quarters, which noise seldom swaps) plus 12 for each length step
beyond the first, and their likeness is 1 - difference / ``BOUND``, 0 beyond. Equal texts have equal digests.

Defined cases: null text counts as empty; a text of less than five bytes has counts of its shorter windows only, an empty one none;
buckets with equal counts are in the same quarter; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.shared import Kept, mix64, shuffle_width

BUCKETS, BOUND, STEP = 256, 384, 0.1
DISTANCE = np.array([[0, 1, 2, 6], [1, 0, 1, 2], [2, 1, 0, 1], [6, 2, 1, 0]])
PAIRS = [(1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4)]  # places before the last byte of a window
CODES = [[(mix64(np.arange(256, dtype=np.uint64) + np.uint64(1000 * k + 10 * j)) % np.uint64(BUCKETS)).astype(np.uint8) for j in range(3)] for k in range(len(PAIRS))]


def bucket_counts(data: bytes) -> np.ndarray:
    flat = np.frombuffer(data, np.uint8)
    total = np.zeros(BUCKETS, np.int64)
    for low in range(0, len(flat), 1 << 20):
        part = flat[max(0, low - 4):low + (1 << 20)]
        skip = min(low, 4)  # bytes that the part before has counted
        for (near, far), (last, middle, first) in zip(PAIRS, CODES, strict=True):
            from_ = max(far, skip)
            if len(part) > from_:
                n = len(part) - from_
                hashed = last[part[from_:]] + middle[part[from_ - near:from_ - near + n]] + first[part[from_ - far:from_ - far + n]]
                total += np.bincount(hashed, minlength=BUCKETS)
    return total


def digest(text: str) -> str:
    """64 hexadecimal digits pairs of quarters, then two of the length step."""
    data = text.encode()
    counts = bucket_counts(data)
    ordered = np.sort(counts)
    cuts = ordered[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    quarters = (counts[:, None] > cuts[None, :]).sum(axis=1).astype(np.uint8).reshape(-1, 4)
    packed = (quarters << np.array([6, 4, 2, 0], np.uint8)).sum(axis=1).astype(np.uint8)
    step = min(255, round(math.log(len(data)) / STEP) + 1) if data else 0
    return packed.tobytes().hex() + f"{step:02x}"


def likeness(one: str, other: str) -> float:
    a, b = bytes.fromhex(one), bytes.fromhex(other)
    x, y = np.frombuffer(a[:-1], np.uint8), np.frombuffer(b[:-1], np.uint8)
    total = 0
    for shift in (6, 4, 2, 0):
        total += int(DISTANCE[x >> shift & 3, y >> shift & 3].sum())
    total += 12 * max(0, abs(a[-1] - b[-1]) - 1)
    return max(0.0, 1.0 - total / BOUND)


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by as much, or all, of the following text's begin."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _row(doc_id, text: str, mark: str, following: str, next_mark: str) -> tuple:
    changed = edited(text, following)
    new_mark = mark if changed == text else digest(changed)
    return doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), mark, new_mark, likeness(mark, new_mark), likeness(mark, next_mark)


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: its digest, and how like it is to its edited text's and to the next document's.

    Documents are sorted by id (null last, equal ids by text) in ranges of ids, and each is compared with the one that
    follows in its range. Of each range the first document is handed on, with the last one, to a table of two rows a
    range, where the last meets the first of the following range; after the last document comes the first of all.
    """
    kept = Kept(docs.sparkSession, "fingerprints")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = docs.repartitionByRange(shuffle_width(docs.sparkSession), F.col("doc_id").asc_nulls_last())
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "text")
    names = [x.split()[0] for x in ROW.split(", ")]

    def frame(rows, part, kind, text=None):
        out = pd.DataFrame(rows, columns=names)
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out.assign(part=part, kind=kind, text=text)

    def run(batches):
        from pyspark import TaskContext

        part, before, first = TaskContext.get().partitionId(), None, None
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"], strict=True):
                now = (doc_id, text, digest(text))
                if before:
                    rows.append(_row(*before, text, now[2]))
                first, before = first or now, now
            yield frame(rows, part, "done")
        for kind, end in (("first", first), ("last", before)):
            if end:
                yield frame([(end[0], None, None, end[2], None, None, None)], part, kind, end[1])

    found = kept.keep(ordered.mapInPandas(run, ROW + ", part int, kind string, text string"))
    parts = [r["part"] for r in found.where("kind = 'first'").select("part").orderBy("part").collect()]  # a number per range
    following = found.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next int")
    last = found.where("kind = 'last'").select("part", "doc_id", "text", "fingerprint").join(F.broadcast(following), "part")
    first = found.where("kind = 'first'").select(F.col("part").alias("next"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_mark"))

    def meet(batches):
        for batch in batches:
            columns = (batch["doc_id"].astype("Int64"), batch["text"], batch["fingerprint"], batch["next_text"], batch["next_mark"])
            out = pd.DataFrame([_row(*x) for x in zip(*columns, strict=True)], columns=names)
            yield out.astype({"doc_id": "Int64"})

    ends = last.join(first.hint("merge"), "next").select("doc_id", "text", "fingerprint", "next_text", "next_mark").mapInPandas(meet, ROW)
    return found.where("kind = 'done'").select(*names).union(ends)
