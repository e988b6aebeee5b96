"""Sampled SentencePiece segmentations by forward filtering and backward sampling over the piece lattice.

A segmentation's weight is the product of its pieces' weights, ``(rank + 1) ** -alpha``: the model stores merge ranks, and
frequencies fall off with rank about like this. The forward pass sums the weights of all ways to reach each position;
going back from the end, a piece is drawn by its share of that sum, so segmentations come with exactly their share of all
weight. Parts of segments are independent (see ``pieces``): lattices are built once per distinct part and worker, and the
draws of all parts of a batch are made together. A draw depends on the seed, the row's key, the part's position and the
step alone, so reruns, other partitions and lost executors give the same pieces.

A character outside the vocabulary goes through its byte pieces, the visible space itself too, so that decoding gives back
every text. Defined cases: null text has no pieces and decodes to an empty text; a null key is a key of its own; rows with equal
keys and texts get equal pieces; other columns are ignored.
"""

from __future__ import annotations

from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm import shingles as sh
from quadrat.llm.pieces import Parts, Vocabulary, code_points, default_model, spread, vocabulary
from quadrat.llm.shared import mix64, ship

CACHED = 100_000  # segments whose lattices are kept in a worker; the store starts anew beyond that
AT_ONCE = 1 << 18  # bytes of texts drawn, or ids decoded, together


class Trie:
    """Prefix tree of the pieces as sorted arrays, walked from many places of a text at a time."""

    def __init__(self, ids: dict[str, int]):
        characters = sorted(set("".join(ids)))
        self.width = len(characters) + 1
        self.index = np.zeros(0x110000, np.int32)  # by code point; 0: in no piece
        self.index[[ord(c) for c in characters]] = np.arange(1, self.width)
        nodes, steps = {"": 0}, []
        for piece in ids:
            for k in range(1, len(piece) + 1):
                if piece[:k] not in nodes:
                    steps.append((nodes[piece[:k - 1]] * self.width + int(self.index[ord(piece[k - 1])]), len(nodes)))
                    nodes[piece[:k]] = len(nodes)
        steps.sort()
        self.steps, self.targets = np.array([*(x for x, _ in steps), 1 << 62]), np.array([*(x for _, x in steps), 0])
        self.piece = np.full(len(nodes), -1)
        for piece, number in ids.items():
            self.piece[nodes[piece]] = number

    def matches(self, codes: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First places, lengths and ids of all pieces in a text, the longest first; ``room``: characters from each place on that a piece may take."""
        characters = self.index[codes].astype(np.int64)
        at, node, depth, found = np.arange(len(codes)), np.zeros(len(codes), np.int64), 0, []
        while len(at):
            step = node * self.width + characters[at + depth]
            where = np.searchsorted(self.steps, step)
            hit = np.flatnonzero(self.steps[where] == step)
            at, node, depth = at[hit], self.targets[where[hit]], depth + 1
            piece = self.piece[node]
            full = np.flatnonzero(piece >= 0)
            found.append((at[full], np.full(len(full), depth), piece[full]))
            going = np.flatnonzero(room[at] > depth)
            at, node = at[going], node[going]
        return tuple(np.concatenate(x) for x in zip(*reversed(found), strict=True))


class Lattices:
    """Lattices of parts as flat arrays: nodes, and the pieces that end in each node with cumulated shares."""

    def __init__(self, model: Vocabulary, alpha: float):
        self.model, self.trie = model, Trie(model.ids)
        self.weight = np.zeros(len(model.texts))
        for piece, rank in model.ranks.items():
            self.weight[model.ids[piece]] = (rank + 1) ** -alpha
        widths = [len(x) for x in model.texts]
        self.text_begins = np.concatenate([[0], np.cumsum(widths)])
        self.text_bytes = np.frombuffer(b"".join(model.texts), np.uint8)
        self.clear()

    def clear(self) -> None:
        self.parts = Parts(self.model, self.add)
        self.ends = array("q")  # by part: its last node
        self.first = array("q")  # by node: its first edge; -1 at the start of a part
        self.shares, self.back, self.piece = array("d"), array("q"), array("i")  # by edge

    def add(self, parts: list[str]) -> None:
        """Lattices of new parts, all of them a character further at a time."""
        if not parts:
            return
        codes, sizes, numbers = code_points("".join(parts)), np.array([len(x) for x in parts]), np.arange(len(parts))
        ends = np.cumsum(sizes)
        roots = ends - sizes + numbers  # a part has a node more than characters
        owner = np.repeat(numbers, sizes)
        places, lengths, piece = self.trie.matches(codes, np.repeat(ends, sizes) - np.arange(len(codes)))
        source, owner_of = places + owner[places], owner[places]
        target = source + lengths
        by_size = np.argsort(-sizes, kind="stable")
        rank = np.empty(len(parts), np.int64)
        rank[by_size] = numbers
        order = np.argsort((target - roots[owner_of]) * len(parts) + rank[owner_of], kind="stable")
        source, target, piece = source[order], target[order], piece[order]
        shares, first_of = self._forward(source, target, self.weight[piece], (target - roots[owner_of[order]]), roots[by_size], sizes[by_size], len(codes) + len(parts))

        node, edge = len(self.first), len(self.back)
        first = np.full(len(codes) + len(parts), -1)
        first[target[first_of]] = edge + first_of
        lone = first < 0
        lone[roots] = False
        self.ends.frombytes((node + roots + sizes).tobytes())
        self.first.frombytes(first.tobytes())
        self.shares.frombytes(shares.tobytes())
        self.back.frombytes((node + source).tobytes())
        self.piece.frombytes(piece.astype(np.int32).tobytes())
        for at in np.flatnonzero(lone).tolist():  # no piece ends here: the character's bytes
            before = node + at - 1
            raw = chr(codes[at - 1 - np.searchsorted(roots, at) + 1]).encode()
            for k, code in enumerate(raw):
                self.shares.append(1.0)
                self.back.append(before)
                self.piece.append(self.model.bytes[code])
                if k + 1 < len(raw):
                    before = len(self.first)
                    self.first.append(len(self.back) - 1)
                else:
                    self.first[node + at] = len(self.back) - 1

    def _forward(self, source, target, weight, place, roots, sizes, nodes: int) -> tuple[np.ndarray, np.ndarray]:
        """Cumulated shares of edges and the first edge of each node that has some.

        Edges are in order of their target's place in its part, then of the part; parts, ``roots`` and ``sizes``, are longest first.
        """
        first = np.flatnonzero(np.diff(target, prepend=-1))
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(target))))
        steps = np.arange(1, sizes[0] + 2)
        edge_at, group_at = np.searchsorted(place, steps), np.searchsorted(place[first], steps)
        having = np.searchsorted(-sizes, -steps, side="right")
        sums, shares = np.ones(nodes), np.zeros(len(target))
        for i in range(sizes[0]):
            now = roots[:having[i]] + i + 1
            sums[now] = sums[now - 1]
            low, high, begin, end = edge_at[i], edge_at[i + 1], group_at[i], group_at[i + 1]
            if high > low:
                terms = sums[source[low:high]] * weight[low:high]
                totals = np.add.reduceat(terms, first[begin:end] - low)
                sums[target[first[begin:end]]] = totals
                shares[low:high] = terms / totals[group[low:high] - begin]
            for small in now[sums[now] < 1e-150]:  # only ratios matter, and no piece reaches further back
                sums[max(small - i - 1, small - self.model.longest + 1):small + 1] *= 1e150
        later = np.arange(len(target)) - first[group]
        for k in range(1, int(later.max(initial=0)) + 1):
            at = np.flatnonzero(later == k)
            shares[at] += shares[at - 1]
        shares[np.append(first[1:], len(target))[:len(first)] - 1] = 1.0
        return shares, first

    def sample(self, parts: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Drawn pieces of all parts in order, and how many each has."""
        first, back, piece = np.frombuffer(self.first, np.int64), np.frombuffer(self.back, np.int64), np.frombuffer(self.piece, np.int32)
        shares = np.frombuffer(self.shares, np.float64)
        node = np.frombuffer(self.ends, np.int64)[parts]
        active, lengths, drawn = np.arange(len(parts)), np.zeros(len(parts), np.int64), []
        step = 0
        while len(active):
            u = (mix64(seeds[active] + np.uint64(step * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(11)) * 2.0**-53
            edge = first[node]
            late = np.flatnonzero(shares[edge] <= u)
            while len(late):
                edge[late] += 1
                late = late[shares[edge[late]] <= u[late]]
            drawn.append((active, piece[edge]))
            lengths[active] += 1
            node = back[edge]
            going = first[node] >= 0
            active, node, step = active[going], node[going], step + 1
        ends = np.cumsum(lengths)
        out = np.empty(ends[-1] if len(ends) else 0, np.int32)
        for k, (who, what) in enumerate(drawn):
            out[ends[who] - 1 - k] = what
        return out, lengths

    def decode(self, ids: np.ndarray) -> bytes:
        """Text of pieces, with the space in front that the model adds to every text."""
        return spread(self.text_bytes, self.text_begins[ids], self.text_begins[ids + 1]).tobytes()


_lattices: dict[tuple[str, float], Lattices] = {}


def lattices(path: str, alpha: float) -> Lattices:
    key = (path, alpha)
    if key not in _lattices:
        _lattices[key] = Lattices(vocabulary(path), alpha)
    if len(_lattices[key].parts.begins) > CACHED:
        _lattices[key].clear()
    return _lattices[key]


def sample_pieces(docs: DataFrame, key: str = "doc_id", seed: int = 0, alpha: float = 1.0, model_path: str | None = None) -> DataFrame:
    """key, text_hash, n_chars, n_pieces, ids: one sampled segmentation of every whole text."""
    path = model_path or default_model()
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)[key]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = sh.text_buffer(batch.column(4))
            row_seeds = batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
            for low, high in sh.pieces(offsets, AT_ONCE):
                store = lattices(path, alpha)
                parts, bounds = store.parts.sequence(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
                place = np.arange(len(parts)) - np.repeat(bounds[:-1], np.diff(bounds))
                seeds = mix64(np.repeat(row_seeds[low:high], np.diff(bounds)) + place.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
                pieces, lengths = store.sample(parts, seeds)
                ends = np.concatenate([[0], np.cumsum(lengths)])[bounds]
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pieces, pa.int32()))
                own = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([*own.columns[:3], pa.array(np.diff(ends)), ids], [key, "text_hash", "n_chars", "n_pieces", "ids"])
        lattices(path, alpha).clear()  # other tasks of this worker need the memory

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col(key), F.xxhash64(text).alias("text_hash"), F.length(text).cast("long").alias("n_chars"),
        F.xxhash64(F.lit(seed), F.col(key).cast("string")).alias("row_seed"), F.when(text == "", text).otherwise(F.concat(F.lit(" "), text)).alias("spaced"),
    )
    return rows.mapInArrow(run, f"{key} {kind}, text_hash long, n_chars long, n_pieces long, ids array<int>")


def decode_pieces(encoded: DataFrame, key: str = "doc_id", model_path: str | None = None) -> DataFrame:
    """The encoded rows with the text of their ids."""
    path = model_path or default_model()
    ship(encoded.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids"))
            bounds = ids.offsets.to_numpy() - (ids.offsets[0].as_py() if len(ids) else 0)
            flat = ids.flatten().to_numpy(zero_copy_only=False)
            for low, high in sh.pieces(bounds, AT_ONCE):
                texts = [lattices(path, 1.0).decode(flat[a:b])[1:].decode() for a, b in zip(bounds[low:high], bounds[low + 1:high + 1], strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.slice(low, high - low).columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, fields + ", text string")
