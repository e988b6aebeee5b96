"""Mixing sources to target weights, by blocks of words.

The words of a source, its documents in an order set by a hash, are packed into blocks of ``BLOCK`` words; the last one may be
shorter. A source passes over its blocks as often as its target needs: in each pass a pseudorandom permutation of block
numbers (a keyed Feistel network) says which block is in which slot, the shorter block comes last, and the last slot of
all is cut so that the words taken are the target's to the word. So no document is taken more often than the cap says.

Output shards have ``SLOTS`` slots. Each shard draws, by itself and seeded by its number, multinomial counts of slots per
source. Over all shards a source is drawn a little too often or too rarely: slots beyond its need go to those still
missing some, in order. A running count per source numbers the slots, numbers go through the permutation, and the slots
meet the documents' pieces of blocks by source and block number.

The driver holds a few numbers per source (a mixture names its sources, so they are few against documents).

Defined cases: null text and text without words have size 0 and are never taken; a null source is a source, the last one;
a source without words has target 0; if all sources are at their cap the targets sum to less; rows with the same
``doc_id`` are separate documents; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrat.llm import shingles as sh
from quadrat.llm.shared import Kept, is_empty, mix64

BLOCK, SLOTS, PER_GROUP = 256, 4096, 1024
WEIGHTS, CAP = (5, 2, 1), 3
WORD = re.compile("[^\x20\x09-\x0D]+")


def targets(sizes: list[int], weights: list[float], cap: float) -> list[float]:
    """Shares of the sum of sizes by weight, none above cap * size; what a capped one can't take is reshared by weight."""
    out, free, left = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while free:
        unit = left / sum(weights[k] for k in free)
        over = [k for k in free if unit * weights[k] > cap * sizes[k]]
        if not over:
            for k in free:
                out[k] = unit * weights[k]
            break
        for k in over:
            out[k] = float(cap * sizes[k])
            left -= out[k]
        free = [k for k in free if k not in over]
    return out


def permuted(number: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Image of each number under the keyed permutation of range(n): a Feistel network, walked until it is below n."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = number.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for turn in range(4):
            left, right = right, left ^ (mix64(right + k + np.uint64(turn * 0x9E3779B97F4A7C15 % 2**64)) & m)
        out[todo] = left << h | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


@dataclass(frozen=True)
class Plan:
    """Per source: size in words, target, words to take, full blocks, slots of a pass, slots in all, words of the last slot."""

    size: np.ndarray
    target: np.ndarray
    take: np.ndarray
    full: np.ndarray
    per_pass: np.ndarray
    slots: np.ndarray
    cut: np.ndarray

    @staticmethod
    def of(size: list[int], target: list[float]) -> Plan:
        size, target = np.array(size, np.int64), np.array(target)
        take = np.floor(target + 0.5).astype(np.int64)
        full = size // BLOCK
        per_pass = full + (size % BLOCK > 0)
        passes, rest = np.divmod(take, np.maximum(size, 1))
        cut = rest % BLOCK
        return Plan(size, target, take, full, per_pass, passes * per_pass + rest // BLOCK + (cut > 0), cut)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, mark (hash of the text) of every row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = sh.text_buffer(batch.column(3))
            sizes = [sh.word_counts(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]) for a, b in sh.pieces(offsets)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.concatenate(sizes), pa.int64())], ["doc_id", "source", "mark", "size"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.xxhash64("text").alias("mark"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, source string, mark long, size long")


def placed(rows: DataFrame, counts: list[int], seed: int, kept: Kept) -> DataFrame:
    """Rows with words, each with the number ``at`` of its first word in its source (rows have its number, ``k``).

    Documents of a source fall in groups of about PER_GROUP by a hash; groups are ordered by number, documents in a group by id.
    """
    groups = F.element_at(F.array(*(F.lit(max(1, n // PER_GROUP)) for n in counts)), F.col("k") + 1)
    grouped = kept.keep(rows.where("size > 0").withColumn("grp", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "mark"), groups)))
    sums = grouped.groupBy("k", "grp").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("k").orderBy("grp")) - F.col("words")
    sums = kept.keep(sums.select("k", "grp", before.alias("base")))
    inside = Window.partitionBy("k", "grp").orderBy("doc_id", "mark", "size").rowsBetween(Window.unboundedPreceding, 0)
    numbered = grouped.withColumn("upto", F.sum("size").over(inside))
    return numbered.join(sums.hint("merge"), ["k", "grp"]).select("doc_id", "mark", "k", "size", (F.col("base") + F.col("upto") - F.col("size")).alias("at"))


def drawn(plan: Plan, seed: int, kept: Kept) -> DataFrame:
    """shard, slot, k, pass, block, take of every slot of the mix."""
    spark = kept.spark
    total = int(plan.slots.sum())
    shards = -(-total // SLOTS)
    share = plan.slots / max(1, total)
    spread = spark.range(shards, numPartitions=max(1, min(shards, 4 * spark.sparkContext.defaultParallelism)))

    def draw(batches):
        for batch in batches:
            for shard in batch["id"]:
                counts = np.random.default_rng([seed, int(shard)]).multinomial(min(SLOTS, total - int(shard) * SLOTS), share)
                some = np.flatnonzero(counts)
                yield pd.DataFrame({"shard": shard, "k": some.astype(np.int32), "n": counts[some]})

    counts = kept.keep(spread.mapInPandas(draw, "shard long, k int, n long"))
    found = np.zeros(len(plan.slots), np.int64)
    for row in counts.groupBy("k").agg(F.sum("n").alias("n")).collect():  # a row per source
        found[row["k"]] = row["n"]
    extra, missing = np.maximum(found - plan.slots, 0), np.maximum(plan.slots - found, 0)
    extra_at, missing_to = np.cumsum(extra) - extra, np.cumsum(missing)
    first = F.sum("n").over(Window.partitionBy("k").orderBy("shard")) - F.col("n")
    by_shard = counts.withColumn("first", first).groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("k", "n", "first"))).alias("own"))

    def fill(batches):
        for batch in batches:
            for shard, own in zip(batch["shard"], batch["own"], strict=True):
                n = np.array([x["n"] for x in own], np.int64)
                k = np.repeat([x["k"] for x in own], n)
                number = np.repeat([x["first"] for x in own], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                over = np.flatnonzero(number >= plan.slots[k])
                place = extra_at[k[over]] + number[over] - plan.slots[k[over]]
                k[over] = np.searchsorted(missing_to, place, side="right")
                number[over] = found[k[over]] + place - (missing_to - missing)[k[over]]
                turn, at = np.divmod(number, plan.per_pass[k])
                key = mix64(np.uint64(seed) + k.astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + turn.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
                block = at.copy()
                inside = np.flatnonzero(at < plan.full[k])
                block[inside] = permuted(at[inside], plan.full[k[inside]], key[inside])
                take = np.minimum(BLOCK, plan.size[k] - block * BLOCK)
                last = (number == plan.slots[k] - 1) & (plan.cut[k] > 0)
                take[last] = plan.cut[k[last]]
                slot = permuted(np.arange(len(k)), np.full(len(k), len(k)), np.full(len(k), mix64(np.array([seed + 7 + int(shard)], np.uint64))[0]))
                yield pd.DataFrame({"shard": shard, "slot": slot, "k": k.astype(np.int32), "turn": turn, "block": block, "take": take})

    return by_shard.mapInPandas(fill, "shard long, slot long, k int, turn long, block long, take long")


@dataclass(frozen=True)
class Mix:
    rows: DataFrame  # doc_id, source, mark, size, k of every row
    sources: DataFrame  # k, source_size, target
    pieces: DataFrame  # doc_id, mark, k, at, size, block, low, high: words low to high of a block are the document's
    slots: DataFrame  # shard, slot, k, turn, block, take
    kept: Kept


def mix(docs: DataFrame, weights=WEIGHTS, cap: float = CAP, seed: int = 1) -> Mix:
    spark = docs.sparkSession
    kept = Kept(spark, "mixing")
    rows = kept.keep(sized(docs))
    sums = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()  # a row per source
    sums = sorted(sums, key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in sums]
    plan = Plan.of(sizes, targets(sizes, [weights[k % len(weights)] for k in range(len(sums))], cap))
    fixed = [(k, r["source"], r["size"], float(plan.target[k])) for k, r in enumerate(sums)]
    sources = spark.createDataFrame(fixed, "k int, source string, source_size long, target double")
    rows = rows.join(F.broadcast(sources.select("k", F.col("source").alias("name"))), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    if not int(plan.slots.sum()):
        empty = "doc_id long, mark long, k int, size long, at long, block long, low long, high long"
        return Mix(rows, sources, spark.createDataFrame([], empty), spark.createDataFrame([], "shard long, slot long, k int, turn long, block long, take long"), kept)
    spots = placed(rows, [r["n"] for r in sums], seed, kept)
    end = F.col("at") + F.col("size")
    pieces = spots.withColumn("block", F.explode(F.expr(f"sequence(at div {BLOCK}, (at + size - 1) div {BLOCK})")))
    base = F.col("block") * BLOCK
    pieces = pieces.withColumn("low", F.greatest(F.col("at") - base, F.lit(0))).withColumn("high", F.least(end - base, F.lit(BLOCK)))
    return Mix(rows, sources, pieces, kept.keep(drawn(plan, seed, kept)), kept)


def taken_words(mixed: Mix) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted) of every row."""
    used = mixed.slots.groupBy("k", "block", "take").agg(F.count("*").alias("times"))
    part = F.least("high", "take") - F.least("low", "take")
    met = mixed.pieces.join(used.hint("merge"), ["k", "block"]).groupBy("doc_id", "mark", "k", "at", "size").agg(F.sum(part * F.col("times")).alias("taken"))
    found = mixed.kept.keep(met.select("doc_id", "mark", "k", "size", "taken"))
    order = Window.partitionBy("doc_id", "mark", "k").orderBy(F.col("taken").desc())
    found = found.withColumn("copy", F.row_number().over(order))
    copies = Window.partitionBy("doc_id", "mark", "k").orderBy("size")
    rows = mixed.rows.withColumn("copy", F.row_number().over(copies)).alias("r")
    same = (F.col("r.doc_id").eqNullSafe(F.col("f.doc_id"))) & (F.col("r.mark") == F.col("f.mark")) & (F.col("r.k") == F.col("f.k")) & (F.col("r.copy") == F.col("f.copy"))
    joined = rows.join(found.alias("f").hint("merge"), same, "left").join(F.broadcast(mixed.sources.drop("source")).alias("s"), F.col("r.k") == F.col("s.k"))
    return joined.select("r.doc_id", "r.size", "s.source_size", "s.target", F.coalesce("f.taken", F.lit(0)).alias("taken"))


def mixed_documents(docs: DataFrame, mixed: Mix) -> DataFrame:
    """The mix as rows of the documents' columns: for each document and pass, the words taken, in order.

    A document that a pass takes whole keeps its text as it is; of others, the spans taken are put together by line ends.
    """
    part = mixed.pieces.join(mixed.slots.select("k", "block", "turn", "take").hint("merge"), ["k", "block"]).where("low < take")
    low = F.col("block") * BLOCK + F.col("low") - F.col("at")
    high = F.col("block") * BLOCK + F.least("high", "take") - F.col("at")
    spans = part.groupBy("doc_id", "mark", "k", "at", "turn").agg(F.sort_array(F.collect_list(F.struct(low.alias("low"), high.alias("high")))).alias("spans"), F.max("size").alias("size"))
    spans = mixed.kept.keep(spans.select("doc_id", "mark", "k", "turn", "size", "spans"))
    named = docs.select(*docs.columns, F.xxhash64("text").alias("__mark"))
    repeated = docs.groupBy("doc_id").count().where("count > 1")
    if not is_empty(repeated):
        named = named.dropDuplicates(["doc_id", "source", "__mark"])
    sources = mixed.sources.select(F.col("k").alias("__k"), F.col("source").alias("__source"))
    named = named.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    chosen = spans.select(F.col("doc_id").alias("__doc"), F.col("mark").alias("__m"), F.col("k").alias("__s"), F.col("size").alias("__size"), F.col("spans").alias("__spans"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__doc")) & (F.col("__mark") == F.col("__m")) & (F.col("__k") == F.col("__s"))
    rows = named.join(chosen.hint("merge"), same).drop("__doc", "__m", "__s", "__mark", "__k")

    def run(batches):
        for batch in batches:
            texts = []
            for text, size, spans in zip(batch["text"], batch["__size"], batch["__spans"], strict=True):
                joined: list[list[int]] = []
                for span in spans:
                    if joined and joined[-1][1] == span["low"]:
                        joined[-1][1] = span["high"]
                    else:
                        joined.append([span["low"], span["high"]])
                if joined != [[0, size]]:
                    words = [m.span() for m in WORD.finditer(text)]
                    text = "\n".join(text[words[a][0]:words[b - 1][1]] for a, b in joined)
                texts.append(text)
            out = batch.drop(columns=["__size", "__spans"]).assign(text=texts)
            if "n_chars" in out:
                out["n_chars"] = out["text"].str.len()
            yield out

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return rows.select(*docs.columns, "__size", "__spans").mapInPandas(run, fields)
