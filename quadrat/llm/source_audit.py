"""How far the word use of the sources of a language differs: exact differences of smoothed shares, by pairs of sources and by term.

Terms are runs of ASCII letters and code points above 127, with A-Z lower-cased. Tasks count them in numpy by
length-bucketed packing: a term of up to 8 bytes is one 64-bit word, one of up to 16 bytes is two, first byte highest, so
that the order of words is the order of bytes. The words are radix-sorted together with their group, 16 bits a pass
and without the passes whose digit is the same everywhere; equal neighbours are runs, whose lengths are the counts. The
sort is stable, so a run's documents are in order and their changes are counted in the same pass. Longer terms are
byte-sorted in separate buckets of widths 32, 64, 128 and so on, each at most half padding.

Only counts leave a task: (lang, term, source, documents, occurrences), dealt by (lang, term), so that a frequent term is one
row a batch and source. Sums over sources pick the kept terms. They are dealt once more in blocks of a language, whose number
follows the language's terms and sources: a block has ``CELLS`` cells of a matrix (terms x sources), or four times as many as it has
pairs of sources. A block gives partial sums for each pair of sources and the surplus of each term. The pairs of a language's sources are the
result itself and the only thing that grows with their square.

Shares are whole numbers, 1 + floor(scale * (count + add) / (N + add * V)), by long division in base 1,000, so nothing
overflows below 9 * 10^15 occurrences.

Defined cases: null text, lang and source count as empty strings; every row is a document, also with a repeated or null
doc_id; a group without terms takes part with counts of 0; a language without kept terms has pairs of value 0 and no
terms; a language with one source has no pairs; ties are ranked by the item's bytes; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrat.llm import shingles as sh
from quadrat.llm.pieces import spread
from quadrat.llm.shared import Kept

TERM_BYTE = np.arange(256) > 127
TERM_BYTE[[*range(65, 91), *range(97, 123)]] = True
LOWER = sh.LOWER.astype(np.uint8)
SCALE = 1_000_000_000
BASE, DIGITS = 1000, 3  # SCALE is BASE to the power of DIGITS
CELLS = 1 << 17
COUNTS = "lang string, source string, term string, n_docs long, n long"
BLOCK_ROWS = "lang string, source string, part string, item string, value long"


def radix_order(columns: list[np.ndarray]) -> np.ndarray:
    """Stable order of rows by columns of whole numbers, the last one first in rank, 16 bits a pass."""
    order = np.arange(len(columns[0]))
    for column in columns:
        values = column.astype(np.uint64, copy=False)
        differ = int(np.bitwise_or.reduce(values ^ values[0])) if len(values) else 0
        for shift in range(0, 64, 16):
            if differ >> shift & 0xFFFF:
                digit = (values >> np.uint64(shift)).astype(np.uint16)
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def term_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, length and text of each term in a buffer of texts."""
    part = np.concatenate([[False], TERM_BYTE[data], [False]])
    bound = np.zeros(len(data) + 1, bool)
    bound[offsets] = True
    starts = np.flatnonzero(part[1:] & (~part[:-1] | bound))
    stops = np.flatnonzero(part[:-1] & (~part[1:] | bound))
    return starts, stops - starts, np.searchsorted(offsets, starts, side="right") - 1


def packed(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, word: int) -> np.ndarray:
    """Bytes 8 * word to 8 * word + 7 of each span as a number, zeros behind its end. ``data`` has 16 bytes more."""
    out = np.zeros(len(starts), np.uint64)
    for k in range(8 * word, 8 * word + 8):
        byte = np.where(lengths > k, data[starts + k], 0).astype(np.uint64)
        out |= byte << np.uint64(8 * (7 - k % 8))
    return out


def buckets(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, groups: np.ndarray):
    """Numbers of the spans of each length bucket in an order that brings equal (group, term) together, and where runs begin."""
    data = np.append(data, np.zeros(16, np.uint8))
    width, longest = 8, int(lengths.max(initial=0))
    while width < 2 * longest or width == 8:
        own = np.flatnonzero((lengths <= width) & ((lengths > width // 2) | (width == 8)))
        if len(own):
            at, size, group = starts[own], lengths[own], groups[own]
            if width <= 16:
                keys = [packed(data, at, size, k) for k in reversed(range(width // 8))]
                order = radix_order([*keys, group])
                keys = [x[order] for x in keys]
            else:
                raw = np.zeros(len(own) * width, np.uint8)
                raw[spread(np.arange(len(raw)), np.arange(len(own)) * width, np.arange(len(own)) * width + size)] = spread(data, at, at + size)
                text = raw.view(f"S{width}")
                order = np.argsort(text, kind="stable")
                order = order[radix_order([group[order]])]
                keys = [text[order]]
            new = np.ones(len(own), bool)
            new[1:] = group[order][1:] != group[order][:-1]
            for x in keys:
                new[1:] |= x[1:] != x[:-1]
            yield own[order], np.flatnonzero(new)
        width *= 2


def batch_counts(data: np.ndarray, offsets: np.ndarray, groups: np.ndarray):
    """Arrow parts (group, term, documents, occurrences) of the texts of a buffer; ``groups`` has a text's group."""
    import pyarrow as pa

    data = LOWER[data]
    starts, lengths, texts = term_spans(data, offsets)
    for order, runs in buckets(data, starts, lengths, groups[texts]):
        docs = texts[order]
        first = np.ones(len(docs), bool)
        first[1:] = docs[1:] != docs[:-1]
        first[runs] = True
        head = order[runs]
        sizes = lengths[head]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        chars = spread(data, starts[head], starts[head] + sizes)
        terms = pa.LargeStringArray.from_buffers(len(head), pa.py_buffer(ends), pa.py_buffer(chars)).cast(pa.string())
        counts = np.diff(np.append(runs, len(order)))
        yield groups[docs[runs]], terms, np.add.reduceat(first.astype(np.int64), runs), counts


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n_docs, n: one row each, dealt by (lang, term)."""
    empty = F.lit("")
    rows = docs.select(*[F.coalesce(F.col(c), empty).alias(c) for c in ("lang", "source", "text")])

    def run(batches):
        import pyarrow as pa

        names = [x.split()[0] for x in COUNTS.split(", ")]
        for batch in batches:
            data, offsets = sh.text_buffer(batch.column(2))
            own = pa.table({"lang": batch.column(0), "source": batch.column(1)}).combine_chunks()
            kinds = own.group_by(["lang", "source"], use_threads=False).aggregate([])
            number = {pair: k for k, pair in enumerate(zip(kinds["lang"].to_pylist(), kinds["source"].to_pylist(), strict=True))}
            groups = np.array([number[pair] for pair in zip(own["lang"].to_pylist(), own["source"].to_pylist(), strict=True)], np.int64)
            for low, high in sh.pieces(offsets, 1 << 24):
                for group, terms, n_docs, n in batch_counts(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low], groups[low:high]):
                    at = pa.array(group)
                    lang, source = (kinds[c].combine_chunks().take(at) for c in ("lang", "source"))
                    yield pa.RecordBatch.from_arrays([lang, source, terms, pa.array(n_docs), pa.array(n)], names)

    counted = rows.mapInArrow(run, COUNTS).repartition("lang", "term")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("n"))


def share(count: np.ndarray, total: np.ndarray, n_terms: int, add: int) -> np.ndarray:
    """1 + floor(SCALE * (count + add) / (total + add * n_terms)) in whole numbers."""
    divisor = total + add * n_terms
    out, rest = np.divmod(count + add, divisor)
    for _ in range(DIGITS):
        digit, rest = np.divmod(rest * BASE, divisor)
        out = out * BASE + digit
    return out + 1


def block_rows(key, terms: pd.DataFrame, groups: pd.DataFrame, add: int) -> pd.DataFrame:
    """Of one block of a language's kept terms: partial sums of each pair of sources, and the terms with a surplus."""
    groups = groups.sort_values("source", ignore_index=True)
    sources, totals, n_terms = groups["source"].to_numpy(object), groups["total"].to_numpy(np.int64), int(groups["n_terms"].max())
    names, row = np.unique(terms["term"].to_numpy(object), return_inverse=True)
    count = np.zeros((len(names), len(sources)), np.int64)
    count[row, pd.Index(sources).get_indexer(terms["source"])] = terms["n"].to_numpy(np.int64)
    p = share(count, totals, n_terms, add)
    q = share(count.sum(axis=1), totals.sum(), n_terms, add)
    surplus = p - q[:, None]
    term, source = np.nonzero((count > 0) & (surplus > 0))
    out = [pd.DataFrame({"source": sources[source], "part": "term", "item": names[term], "value": surplus[term, source]})]
    for k in range(len(sources)):
        others = np.arange(len(sources)) != k
        value = np.abs(p - p[:, [k]]).sum(axis=0)[others]
        out.append(pd.DataFrame({"source": sources[k], "part": "pair", "item": sources[others], "value": value}))
    out = pd.concat(out, ignore_index=True)
    out.insert(0, "lang", key[0])
    return out


def source_audit(docs: DataFrame, min_docs: int = 30, add: int = 5, top: int = 50) -> DataFrame:
    """lang, source, part (pair, term), item, value, rank: all other sources of the language, and the ``top`` terms with a surplus."""
    kept = Kept(docs.sparkSession, "audit")
    counts = term_counts(docs)
    by_term = Window.partitionBy("lang", "term")
    counts = kept.keep(counts.withColumn("in_docs", F.sum("n_docs").over(by_term)).where(F.col("in_docs") >= min_docs).select("lang", "term", "source", "n"))
    names = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    totals = names.join(totals, ["lang", "source"], "left").fillna(0, ["total"])
    vocabulary = counts.select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n_terms"))
    widths = totals.groupBy("lang").agg(F.count(F.lit(1)).alias("n_sources")).join(vocabulary, "lang", "left").fillna(0, ["n_terms"])
    in_block = F.greatest(F.lit(CELLS) / F.col("n_sources"), 4 * F.col("n_sources"))
    widths = widths.withColumn("n_blocks", F.ceil(F.col("n_terms") / in_block).cast("int"))
    groups = kept.keep(totals.join(widths, "lang"))

    # A language's few numbers meet its rows by a salted key, as a language may hold a third of them.
    salts = 32
    salted = counts.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(salts)).cast("int"))
    blocks = groups.groupBy("lang").agg(F.max("n_blocks").alias("n_blocks")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = salted.join(blocks, ["lang", "salt"]).withColumn("block", F.pmod(F.xxhash64("term", F.lit(1)), F.col("n_blocks")).cast("int"))
    right = groups.where("n_blocks > 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    keys = ["lang", "block"]
    found = left.select(*keys, "term", "source", "n").groupBy(*keys).cogroup(right.select(*keys, "source", "total", "n_terms").groupBy(*keys)).applyInPandas(
        lambda key, a, b: block_rows(key, a, b, add), BLOCK_ROWS
    )
    found = kept.keep(found)
    other = F.col("other.source")
    silent = groups.where("n_blocks = 0").alias("own").join(groups.alias("other"), "lang").where(other != F.col("own.source"))
    silent = silent.select("lang", F.col("own.source"), F.lit("pair").alias("part"), other.alias("item"), F.lit(0).cast("long").alias("value"))
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = F.row_number().over(order).alias("rank")
    terms = found.where("part = 'term'").select("*", ranked).where(F.col("rank") <= top)
    return pairs.unionByName(silent).select("*", ranked).unionByName(terms)
