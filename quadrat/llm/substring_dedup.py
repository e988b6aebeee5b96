"""Substring dedup by hashes of units: repeated sentences and lines of all documents, the earliest kept.

A unit is a sentence: the words up to one that ends in ``.``, ``!`` or ``?``, or up to a line end. It is normalised to its words
with A-Z lower-cased, whatever is between them, and has a 128-bit digest. A digest's first occurrence, in the document
with the smallest ``doc_id`` and there the first, stays; later ones are repeats. Runs of repeats of at least ``min_words`` words
together go (short units recur by chance: a repeat alone with few words stays). The rest of the text stays byte for byte, and
the cut spans are kept as offsets into the original text.

With ``whole_lines``, which both queries set, a whole line (up to ``\\n``) is a unit too, with a digest of its own kind: a line that an
earlier document has as a line goes whatever its length, and so does a paragraph, as all its lines go. The floor
is then for repeated sentences in other lines alone: ``min_words`` words, or ``min_chars`` code points without white space, as some
scripts do not part words.

Digests meet in one aggregate with a map-side part, so one line in a third of all documents is a row per task. Which
digests occur in several documents is then known to a bitmap of fixed size first, and only units that pass it are joined
exactly; only documents with repeats are joined with their list.

Defined cases: null text is kept as null with no units; text without words has no units; rows with the same ``doc_id`` are one document
(their units are not repeats of each other's); rows without ``doc_id`` lose only repeats of their own; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm import shingles as sh
from quadrat.llm.shared import Kept, id_bitmap, in_bitmap, only_in_bitmap

LINE = np.uint64(0x5851F42D4C957F2D)  # tells a line's digest from that of a sentence with the same words
NEWLINE, SENTENCE_END = 10, np.isin(np.arange(256), [ord(c) for c in ".!?"])
BITS_LOG2 = 25


def units(data: np.ndarray, offsets: np.ndarray):
    """Units of the documents in a byte buffer: two digests, words, first byte, byte after the unit, offsets by document, and lines.

    A unit's bytes reach to the next unit of the document, or to the document's end, so that cutting it leaves no gap.
    Lines: two digests, offsets by document, and the line of each unit.
    """
    words, starts, stops, bounds = sh.words_of(data, offsets)
    if not len(words):
        none = np.zeros(0, np.int64)
        by_doc = np.zeros(len(offsets), np.int64)
        return words, words, none, none, none, by_doc, (words, words, by_doc, none)
    lines = np.cumsum(data == NEWLINE)
    ended = np.ones(len(words), bool)
    ended[:-1] = lines[starts[1:]] > lines[stops[:-1] - 1]
    ended[bounds[1:][bounds[1:] > 0] - 1] = True
    cuts = np.concatenate([[0], np.flatnonzero(ended | SENTENCE_END[data[stops - 1]]) + 1])
    line_cuts = np.concatenate([[0], np.flatnonzero(ended) + 1])
    line_one, line_two = sh.sequence_hashes(words, line_cuts)
    line_by_doc = np.searchsorted(line_cuts[:-1], bounds, side="left")
    line_of = np.searchsorted(line_cuts, cuts[:-1], side="right") - 1
    one, two = sh.sequence_hashes(words, cuts)
    by_doc = np.searchsorted(cuts[:-1], bounds, side="left")
    begins = starts[cuts[:-1]]
    after = np.append(begins[1:], offsets[-1])
    final = by_doc[1:][by_doc[1:] > by_doc[:-1]] - 1
    after[final] = offsets[1:][by_doc[1:] > by_doc[:-1]]
    return one, two, np.diff(cuts), begins, after, by_doc, (line_one ^ LINE, line_two, line_by_doc, line_of)


def _batches(column):
    data, offsets = sh.text_buffer(column)
    for low, high in sh.pieces(offsets):
        yield low, high, data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]


def digests(docs: DataFrame, whole_lines: bool, bitmap: np.ndarray | None = None) -> DataFrame:
    """doc_id, one, two of each distinct unit (and line) of each row; with a bitmap, of those that may be in it."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for low, high, data, offsets in _batches(batch.column(1)):
                one, two, _, _, _, by_doc, (line_one, line_two, line_by_doc, _) = units(data, offsets)
                owner = np.repeat(np.arange(high - low), np.diff(by_doc))
                if whole_lines:
                    one, two = np.concatenate([one, line_one]), np.concatenate([two, line_two])
                    owner = np.concatenate([owner, np.repeat(np.arange(high - low), np.diff(line_by_doc))])
                if shared.value is not None:
                    hit = in_bitmap(shared.value, one & np.uint64(shared.value.size * 64 - 1))
                    one, two, owner = one[hit], two[hit], owner[hit]
                order = np.lexsort((two, one, owner))
                one, two, owner = one[order], two[order], owner[order]
                new = np.ones(len(one), bool)
                new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (owner[1:] != owner[:-1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner[new] + low)), pa.array(one[new].view(np.int64)), pa.array(two[new].view(np.int64))], ["doc_id", "one", "two"]
                )

    return docs.mapInArrow(run, "doc_id long, one long, two long")


SPANS = "n_units int, n_removed int, removed array<struct<begin:int,end:int>>, text string"


def repeated(one: np.ndarray, two: np.ndarray, known: np.ndarray | None) -> np.ndarray:
    """Which digests of a document are known from earlier ones, or came before in this one."""
    digest = np.rec.fromarrays([one, two])
    _, first = np.unique(digest, return_index=True)
    out = np.ones(len(one), bool)
    out[first] = False
    return out if known is None else out | np.isin(digest, known)


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of set flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2], edge[1::2], strict=True))


def cut(rows: DataFrame, min_words: int, carry: list[str], whole_lines: bool, min_chars: int) -> DataFrame:
    """Rows of doc_id, text, repeats (digests one and two of units and lines that came earlier elsewhere), cut."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*carry).schema.fields)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, texts, lists, *others = batch.columns
            counts, gone, spans, out = [], [], [], []
            for k, text in enumerate(texts.to_pylist()):
                raw = (text or "").encode()
                data = np.frombuffer(raw, np.uint8)
                one, two, words, begins, after, _, (line_one, line_two, _, line_of) = units(data, np.array([0, len(raw)]))
                known = None
                if lists[k].is_valid:
                    known = lists[k].values
                    known = np.rec.fromarrays([known.field(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(2)])
                places = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                total = np.concatenate([[0], np.cumsum(words)])
                letters = np.concatenate([[0], np.cumsum(~sh.SPACE[data] & ((data & 0xC0) != 0x80))])
                out_of = repeated(line_one, line_two, known)[line_of] if whole_lines else np.zeros(len(one), bool)
                for a, b in runs(repeated(one, two, known)):
                    enough = whole_lines and letters[after[b - 1]] - letters[begins[a]] >= min_chars
                    out_of[a:b] |= enough or total[b] - total[a] >= min_words
                gaps = runs(out_of)
                counts.append(len(one))
                gone.append(int(out_of.sum()))
                pieces = [(int(begins[a]), int(after[b - 1])) for a, b in gaps]
                spans.append([{"begin": int(places[x]), "end": int(places[y])} for x, y in pieces])
                edges = [0, *(x for piece in pieces for x in piece), len(raw)]
                out.append(text if not pieces else b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)).decode())
            kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int32()), pa.array(gone, pa.int32()), pa.array(spans, kind), pa.array(out, pa.string()), *others], ["doc_id", "n_units", "n_removed", "removed", "text", *carry])

    return rows.select("doc_id", "text", "repeats", *carry).mapInArrow(run, ", ".join(["doc_id long", SPANS, *[schema] * bool(carry)]))


def find_repeats(docs: DataFrame, min_words: int = 10, carry: list[str] | None = None, whole_lines: bool = False, min_chars: int = 50) -> DataFrame:
    """doc_id, n_units, n_removed, removed (spans of code points in the original text), text (what stays) of every row.

    ``carry``: further columns to pass through, with other names than these. ``whole_lines``: repeated lines of any length go,
    and runs of repeated sentences from ``min_chars`` code points on too.
    """
    carry = carry or []
    kept = Kept(docs.sparkSession, "substring-dedup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carry)
    named = docs.where("doc_id is not null and text is not null")
    texts = named.select("doc_id", "text")
    firsts = digests(texts, whole_lines).groupBy("one", "two").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    firsts = kept.keep(firsts.where("first <> last").select("one", "two", "first"))
    later = digests(texts, whole_lines, id_bitmap(firsts, "one", BITS_LOG2, hashed=True)).join(firsts.hint("merge"), ["one", "two"]).where("doc_id <> first")
    lists = kept.keep(later.groupBy("doc_id").agg(F.collect_set(F.struct("one", "two")).alias("repeats")))
    bitmap = id_bitmap(lists, "doc_id")
    several = only_in_bitmap(docs, "doc_id", bitmap).join(lists.hint("merge"), "doc_id", "left")
    others = only_in_bitmap(docs, "doc_id", bitmap, inside=False)
    others = others.withColumn("repeats", F.lit(None).cast("array<struct<one:bigint,two:bigint>>"))
    return cut(several, min_words, carry, whole_lines, min_chars).union(cut(others, min_words, carry, whole_lines, min_chars))
