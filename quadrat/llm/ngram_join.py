"""N-gram Jaccard join of documents (grouped prefix join).

A document is the set of its distinct n-word shingles (64-bit hashes; two shingles share one with odds of about
2^-64 a pair). Two documents link when ``100 * intersection >= percent * union``.

1. One pass counts shingles in a table of fixed size (a shingle's slot is its hash). (slot count, hash) is the common
   order of all shingles: rare ones first, so passages that many documents share come last.
2. A second pass keeps each document's prefix, the first ``n - ceil(percent * n / 100) + 1`` shingles in that order. Linked
   documents share a prefix shingle. Equal word sequences are one class; classes of equal size and prefix are one group.
3. Groups meet by prefix shingle; of the shingles that the same groups share one is enough. Pairs are filtered by size and by
   the positions of the shared shingle.
4. Surviving pairs are expanded to member classes and verified on their full texts, which are dealt by ``doc_id`` once, for
   all rounds of verification.

Only components are wanted, so pairs that can't change them are left out: first the smallest group of each list meets
the others and the smallest member of each group its members; then, after linking, list entries still in different
components are compared by sketches, counts of a set's shingles in ``BUCKETS`` buckets: the sum of their differences is at
most the number of shingles that only one of the sets has, so pairs beyond the number allowed can't link. Of the others the
nearest few of each entry and component are verified, and after linking again all that are left. A pair is left out only if
its documents are known to be in one component, or can't link, so no component is missed.

Defined cases: null text, empty text and text without words have size 0 and link with nothing; rows with the same
``doc_id`` are one document, which links by any of its texts (each row is returned, linked to the others); a null ``doc_id`` links with nothing and has a
null component; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrat.llm import shingles as sh
from quadrat.llm.components import components
from quadrat.llm.shared import Kept, id_bitmap, is_empty, only_in_bitmap, shuffle_width

SLOTS_LOG2 = 20  # slots of the count table: 8 MB, whatever the input
CHUNK = 1 << 14
BUCKETS = 256  # of a sketch
BLOCK = 512  # list entries compared with the entries outside the list's first component in one group
NEAREST = 4  # pairs of an entry and a component that are verified first
PAIRS = 1 << 14  # sketches compared at once
AT_ONCE = 1 << 18  # bytes of texts worked on together
VERIFIED = 512  # pairs of texts verified at once
STAYS, BOTH, PROBES = 0, 1, 2  # roles of an entry in a block: compared with, both, compared with the others


def _sets(texts, n: int):
    """For each piece of a pyarrow string column: first row, end row, words, word bounds, set hashes, set bounds."""
    data, offsets = sh.text_buffer(texts)
    for low, high in sh.pieces(offsets, AT_ONCE):
        part = data[offsets[low]:offsets[high]]
        words, bounds = sh.word_hashes(part, offsets[low:high + 1] - offsets[low])
        yield low, high, words, bounds, *sh.shingle_sets(words, bounds, n)


def slot_counts(texts: DataFrame, n: int) -> np.ndarray:
    """Documents having a shingle in each slot, over all rows of the one column ``text``."""
    mask = np.uint64((1 << SLOTS_LOG2) - 1)

    def count(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        total = np.zeros(1 << SLOTS_LOG2, np.int64)
        for batch in batches:
            for *_, hashes, _ in _sets(batch.column(0), n):
                total += np.bincount((hashes & mask).astype(np.int64), minlength=1 << SLOTS_LOG2)
        lane = TaskContext.get().partitionId() // 256
        parts = [(k, total[k * CHUNK:(k + 1) * CHUNK]) for k in range(len(total) // CHUNK)]
        parts = [(k, x.astype(np.uint32 if x.max() < 2**32 else np.uint64).tobytes()) for k, x in parts if x.any()]
        yield pa.RecordBatch.from_pydict({
            "chunk": pa.array([k for k, _ in parts], pa.int32()), "lane": pa.array([lane] * len(parts), pa.int32()),
            "counts": pa.array([x for _, x in parts], pa.binary()),
        })

    def read(raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, np.uint32 if len(raw) == 4 * CHUNK else np.uint64).astype(np.uint64)

    def add(batch):
        total = np.zeros(CHUNK, np.uint64)
        for raw in batch["counts"]:
            total += read(raw)
        out = batch.iloc[:1].copy()
        out["counts"] = [total.tobytes()]
        return out

    schema = "chunk int, lane int, counts binary"
    parts = texts.mapInArrow(count, schema).groupBy("chunk", "lane").applyInPandas(add, schema)
    parts = parts.groupBy("chunk").applyInPandas(add, schema)
    out = np.zeros(1 << SLOTS_LOG2, np.uint64)
    for row in parts.toLocalIterator():  # 64 rows of 128 kB
        out[row["chunk"] * CHUNK:(row["chunk"] + 1) * CHUNK] = read(bytes(row["counts"]))
    return out


def prefixes(docs: DataFrame, counts: np.ndarray, n: int, percent: int) -> DataFrame:
    """doc_id, size, s1, s2 (hash of the word sequence), p1, p2 (hash of the prefix), prefix, sketch; docs: doc_id, text without nulls.

    sketch: how many of a set's shingles fall in each bucket, 255 at most.
    """
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    schema = "doc_id long, size int, s1 long, s2 long, p1 long, p2 long, prefix array<long>, sketch binary"

    def run(batches):
        import pyarrow as pa

        mask = np.uint64((1 << SLOTS_LOG2) - 1)
        for batch in batches:
            for low, high, words, bounds, hashes, at in _sets(batch.column(1), n):
                sizes = np.diff(at)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                # by owner, count and hash: within an owner the hashes are in order
                seen = np.minimum(shared.value[(hashes & mask).astype(np.int64)], np.uint64((1 << 40) - 1)).astype(np.int64)
                order = np.argsort((owner << 40) | seen, kind="stable")
                kept = np.where(sizes > 0, sizes - (percent * sizes + 99) // 100 + 1, 0)
                rank = np.arange(len(hashes)) - np.repeat(at[:-1], sizes)
                chosen = hashes[order][rank < np.repeat(kept, sizes)]
                ends = np.concatenate([[0], np.cumsum(kept)])
                s1, s2 = sh.sequence_hashes(words, bounds)
                p1, p2 = sh.sequence_hashes(chosen, ends)
                prefix = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(chosen.view(np.int64)))
                longs = [pa.array(x.view(np.int64)) for x in (s1, s2, p1, p2)]
                ids = batch.column(0).slice(low, high - low)
                spread = np.bincount(owner * BUCKETS + (hashes >> np.uint64(56)).astype(np.int64), minlength=len(sizes) * BUCKETS)
                spread = np.minimum(spread, 255).astype(np.uint8)
                sketch = pa.Array.from_buffers(pa.binary(BUCKETS), len(sizes), [None, pa.py_buffer(spread)]).cast(pa.binary())
                columns = [ids, pa.array(sizes, pa.int32()), *longs, prefix, sketch]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "size", "s1", "s2", "p1", "p2", "prefix", "sketch"])

    return docs.mapInArrow(run, schema)


def _fits(percent: int, p: str, q: str):
    """Size and position filter of entries p, q of one list: can they share enough shingles?"""
    size, other, at, to = (F.col(f"{x}.{c}").cast("long") for c in ("size", "pos") for x in (p, q))
    most = F.least(at, to) + 1 + F.least(size - at, other - to) - 1
    needed = F.ceil((size + other) * percent / F.lit(100 + percent) - 1e-9)
    return (F.least(size, other) * 100 >= F.greatest(size, other) * percent) & (most >= needed)


def verified(pairs: DataFrame, texts: DataFrame, kept: Kept, n: int, percent: int) -> DataFrame:
    """The pairs a, b whose texts link; texts: doc_id, text of every document in a pair, dealt by doc_id.

    One document may be the ``a`` of many pairs: the texts of this side are written, so that both sides of the second join are
    plain exchanges and such a document can be split.
    """

    def run(batches):
        import pyarrow as pa

        for batch in (x.slice(low, VERIFIED) for x in batches for low in range(0, x.num_rows, VERIFIED)):
            rows = batch.num_rows
            both = pa.concat_arrays([batch.column(2).cast(pa.large_string()), batch.column(3).cast(pa.large_string())])
            sets = []
            for *_, hashes, at in _sets(both, n):
                sets += np.split(hashes, at[1:-1])
            good = np.zeros(rows, bool)
            for k in range(rows):
                common = len(np.intersect1d(sets[k], sets[rows + k], assume_unique=True))
                union = len(sets[k]) + len(sets[rows + k]) - common
                good[k] = common > 0 and 100 * common >= percent * union
            yield batch.select([0, 1]).filter(pa.array(good))

    side = lambda t, c: t.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}")).hint("merge")
    first = kept.keep(texts.join(pairs.select(F.col("a").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi"))
    joined = pairs.join(side(texts, "b"), "b").join(side(first, "a"), "a").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(run, "a long, b long")


def ngram_links(docs: DataFrame, kept: Kept, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles) of every row, and (node, component) of every document linked to another."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    counts = slot_counts(docs.select("text"), n)
    found = kept.keep(prefixes(docs, counts, n, percent))
    work = Kept(docs.sparkSession, "ngram-work")
    joined = kept.keep(components(_links(docs, found, work, n, percent), work))
    work.clear()
    return found.select("doc_id", F.col("size").alias("n_shingles")), joined


def _links(docs: DataFrame, found: DataFrame, kept: Kept, n: int, percent: int) -> DataFrame:
    """Edges a, b between linked documents, enough for their components."""
    named = found.where("size > 0 and doc_id is not null")

    classes = kept.keep(named.groupBy("s1", "s2", "size", "p1", "p2").agg(F.min("doc_id").alias("rep")))
    copies = named.select("doc_id", "s1", "s2").join(classes.select("s1", "s2", "rep").hint("merge"), ["s1", "s2"])
    links = kept.keep(copies.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct())

    groups = kept.keep(classes.groupBy("size", "p1", "p2").agg(F.min("rep").alias("gid"), F.count("*").alias("members")))
    heads = found.join(groups.select(F.col("gid").alias("doc_id"), "p1", "p2", "size").hint("merge"), ["doc_id", "p1", "p2", "size"])
    entries = heads.select(F.col("doc_id").alias("gid"), "size", F.posexplode("prefix").alias("pos", "token"))
    leads = entries.groupBy("token").agg(F.min("gid").alias("lead"), F.max("gid").alias("last"))
    leads = kept.keep(leads.where("lead <> last").select("token", "lead"))
    lists = _distinct_lists(kept.keep(entries.join(leads.hint("merge"), "token").distinct()), kept)

    several = groups.where("members > 1").select("gid")
    members = classes.join(groups.hint("merge"), ["size", "p1", "p2"]).select("gid", "rep")
    members = kept.keep(members.join(lists.select("gid").union(several).distinct().hint("merge"), "gid", "left_semi"))
    if is_empty(members):
        return links
    active = members.select(F.col("rep").alias("doc_id")).distinct()
    near = only_in_bitmap(docs.where("doc_id is not null"), "doc_id", id_bitmap(active, "doc_id"))
    texts = near.repartition(shuffle_width(docs.sparkSession), "doc_id")
    texts = kept.keep_dealt(texts.groupBy("doc_id").agg(F.max("text").alias("text")) if _repeated(found) else texts, "doc_id")

    first = lists.where("gid = lead").alias("p")
    stars = lists.where("gid <> lead").alias("q").join(first.hint("merge"), F.col("p.token") == F.col("q.token")).where(_fits(percent, "p", "q"))
    stars = stars.select(F.col("p.gid").alias("a"), F.col("q.gid").alias("b"))
    within = members.where("gid <> rep").select(F.col("gid").alias("a"), F.col("rep").alias("b"))
    pairs = kept.keep(stars.union(within).distinct())
    links = kept.keep(links.union(verified(pairs, texts, kept, n, percent)))

    # what is still apart: list entries by class, with the component of each class
    rows = lists.join(members.hint("merge"), "gid").select("token", F.col("rep").alias("id"), "size", "pos")
    alone = members.join(several.hint("merge"), "gid", "left_semi").join(groups.select("gid", "size").hint("merge"), "gid")
    rows = kept.keep(rows.union(alone.select(F.xxhash64("gid", "size").alias("token"), F.col("rep").alias("id"), "size", F.lit(0).alias("pos"))))
    marks = None
    for most in (NEAREST, None):
        joined = kept.keep(components(links, kept))
        rows = kept.keep(_apart(rows, joined, kept))
        if is_empty(rows):
            break
        if marks is None:
            ids = rows.select(F.col("id").alias("doc_id")).distinct()
            marks = found.select("doc_id", "sketch").join(ids.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
            marks = kept.keep(marks)
        near_pairs = _near(rows, marks, percent, most, kept).join(pairs.hint("merge"), ["a", "b"], "left_anti")
        near_pairs = kept.keep(near_pairs)
        pairs = kept.keep(pairs.union(near_pairs))
        links = kept.keep(links.union(verified(near_pairs, texts, kept, n, percent)))
    return links


def _distinct_lists(lists: DataFrame, kept: Kept) -> DataFrame:
    """Of the lists with the same groups one: documents that share a passage share a list for each of its shingles.

    Any shared shingle will do: its list has the same pairs, and its positions bound what they can share as well. Lists are
    told apart by 128 bits of hashes of their groups and by their length.
    """
    marks = [F.bit_xor(F.xxhash64("gid", F.lit(k))).alias(f"mark{k}") for k in range(2)]
    named = lists.groupBy("token").agg(F.count("*").alias("entries"), *marks)
    chosen = named.groupBy("entries", "mark0", "mark1").agg(F.min("token").alias("token")).select("token")
    return kept.keep(lists.join(chosen.hint("merge"), "token"))


def _repeated(found: DataFrame) -> bool:
    ids = found.where("doc_id is not null").groupBy("doc_id").count()
    return not is_empty(ids.where("count > 1"))


def _apart(rows: DataFrame, joined: DataFrame, kept: Kept) -> DataFrame:
    """Entries of the lists that hold several components: token, id, size, pos, component, and the first entry's component."""
    base = rows.select("token", "id", "size", "pos")
    named = base.join(joined.select(F.col("node").alias("id"), "component").hint("merge"), "id", "left")
    named = kept.keep(named.withColumn("component", F.coalesce("component", "id")))
    bounds = named.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    bounds = kept.keep(bounds.where("low <> high").select("token", "low"))
    return named.join(bounds.hint("merge"), "token")


def _near(rows: DataFrame, marks: DataFrame, percent: int, most: int | None, kept: Kept) -> DataFrame:
    """Pairs a, b of list entries in different components whose sketches allow a link; ``most``: the nearest of each entry and component.

    Of such a pair at least one entry is outside the list's first component. Entries are dealt into blocks, and those outside go to
    all blocks of their list; in a list of one block they are there already.
    """
    blocks = kept.keep(rows.groupBy("token").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    known = rows.join(marks.select(F.col("doc_id").alias("id"), "sketch").hint("merge"), "id").join(blocks.hint("merge"), "token")
    known = kept.keep(known)
    apart, several = F.col("component") != F.col("low"), F.col("blocks") > 1
    role = F.when(~apart | several, F.lit(STAYS)).otherwise(F.lit(BOTH))
    own = known.withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("role", role)
    outside = known.where(apart & several).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = own.unionByName(outside.withColumn("role", F.lit(PROBES))).select("token", "block", "role", "id", "size", "component", "sketch")
    dealt = dealt.repartition(shuffle_width(rows.sparkSession), "token", "block").sortWithinPartitions("token", "block", "role")

    def compare(part: dict, edges: np.ndarray):
        """Pairs of each probe and the entries of its block; the blocks lie between the edges, in each the entries first."""
        stays = np.add.reduceat(part["role"] != PROBES, edges[:-1])
        block = np.repeat(np.arange(len(stays)), np.diff(edges))
        probes = np.flatnonzero(part["role"] != STAYS)
        ends = np.cumsum(stays[block[probes]])
        sketch, at = part["sketch"].astype(np.int16), 0
        while at < len(probes):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            many = stays[block[probes[at:to]]]
            one = np.repeat(probes[at:to], many)
            two = np.arange(len(one)) - np.repeat(np.cumsum(many) - many, many) + edges[block[one]]
            size, other = part["size"][one], part["size"][two]
            hit = (np.minimum(size, other) * 100 >= np.maximum(size, other) * percent) & (part["component"][one] != part["component"][two])
            one, two, room = one[hit], two[hit], ((100 - percent) * (size + other) // (100 + percent))[hit]
            away = np.abs(sketch[one] - sketch[two]).sum(axis=1)
            hit = away <= room
            one, two, away = one[hit], two[hit], away[hit]
            if most is not None and len(one):
                component = part["component"][two]
                order = np.lexsort((away, component, one))
                one, two, component = one[order], two[order], component[order]
                first = np.flatnonzero(np.concatenate([[True], (np.diff(one) != 0) | (np.diff(component) != 0)]))
                rank = np.arange(len(one)) - np.repeat(first, np.diff(np.concatenate([first, [len(one)]])))
                one, two = one[rank < most], two[rank < most]
            yield part["id"][one], part["id"][two]
            at = to

    def run(batches):
        import pyarrow as pa

        held = None
        for batch in _with_end(batches):
            if batch is not None:
                now = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in ("token", "block", "role", "id", "size", "component")}
                now["size"] = now["size"].astype(np.int64)
                now["sketch"] = np.array(sh.text_buffer(batch.column("sketch"))[0]).reshape(batch.num_rows, BUCKETS)
                held = now if held is None else {name: np.concatenate([held[name], now[name]]) for name in now}
            if held is None or not len(held["token"]):
                continue
            edges = np.flatnonzero((np.diff(held["token"]) != 0) | (np.diff(held["block"]) != 0)) + 1
            edges = np.concatenate([[0], edges, [len(held["token"])] if batch is None else []]).astype(np.int64)
            one, two = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            if len(edges) > 1:
                for who, whom in compare({name: x[:edges[-1]] for name, x in held.items()}, edges):
                    one.append(who)
                    two.append(whom)
            held = {name: x[edges[-1]:] for name, x in held.items()}
            x, y = np.concatenate(one), np.concatenate(two)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _with_end(batches):
    yield from batches
    yield None


def _by_text(docs: DataFrame, kept: Kept, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """As ``ngram_links`` where texts share a doc_id: each (doc_id, text) is a node, and the nodes of a doc_id are linked."""
    node = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("node", node)
    ids = kept.keep(docs.select("doc_id", "node").where("node is not null").distinct())
    sizes, joined = ngram_links(docs.select(F.col("node").alias("doc_id"), "text"), kept, n, percent)
    first = ids.groupBy("doc_id").agg(F.min("node").alias("first"))
    same = ids.join(first.hint("merge"), "doc_id").select(F.col("node").alias("a"), F.col("first").alias("b"))
    joined = components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).union(same), kept)
    named = kept.keep(ids.join(joined.hint("merge"), "node").select("doc_id", "component"))
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("smallest"))
    named = named.join(smallest.hint("merge"), "component").select(F.col("doc_id").alias("node"), F.col("smallest").alias("component")).distinct()
    sizes = sizes.withColumnRenamed("doc_id", "node").join(ids.hint("merge"), "node", "left")
    return sizes.select("doc_id", "n_shingles"), named


def ngram_join(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id reachable by links, itself included."""
    kept = Kept(docs.sparkSession, "ngram-join")
    sizes, joined = (_by_text if _repeated(docs) else ngram_links)(docs, kept, n, percent)
    joined = joined.select(F.col("node").alias("doc_id"), "component").hint("merge")
    return sizes.join(joined, "doc_id", "left").select(
        "doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )


def one_per_group(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents, of each group of linked ones the one with the smallest ``doc_id`` only (of rows with its id, the first by text)."""
    gone = Kept(docs.sparkSession, "ngram-groups")
    gone = gone.keep(ngram_join(docs, n, percent).where("component_id <> doc_id").select("doc_id").distinct())
    bitmap = id_bitmap(gone, "doc_id")
    clear = only_in_bitmap(docs, "doc_id", bitmap, inside=False)
    rest = only_in_bitmap(docs, "doc_id", bitmap).join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
    out = clear.union(rest)
    ids = docs.where("doc_id is not null").groupBy("doc_id").count()
    if not is_empty(ids.where("count > 1")):
        named = out.where("doc_id is not null")
        first = named.withColumn("__row", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last())))
        out = first.where("__row = 1").drop("__row").union(out.where("doc_id is null"))
    return out
