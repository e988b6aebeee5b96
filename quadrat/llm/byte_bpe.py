"""Byte-level BPE by a transducer that is made deterministic while it runs, and its streaming decoder.

The merges are compiled into a transducer over bytes. Its states before that are pairs (node in the trie of tokens,
token before it): a path that ends in a token may begin the next one if the two tokens may stand side by side, that is, if
the merges of their joint bytes give them back. Of every prefix exactly one sequence of tokens is such a path. A state
of the deterministic transducer is the set of paths that are still alive, each with the tokens it has not emitted; a step
emits what all paths agree on, so a token is emitted as soon as the bytes behind it (a bounded number) decide it, and the end of
a piece emits the rest. States and steps are made when a text first needs them, and kept in the worker up to ``HELD_BYTES``;
beyond that the transducer starts anew, which changes no result.

Whether two tokens may stand side by side is decided on their edges: with the rank at which each part next to the
boundary came to be, a merge over the boundary would have to come before the next change of either part.

Texts are cut by the pattern of the rank files (contractions, letters, digits, other signs, white space), worked out on the
code points of a batch at once from the classes of each and its neighbours; the classes are asked of the tokenizer library once, and are
a broadcast table of one byte a code point. Distinct pieces of a batch walk through the transducer side by side, a byte further at a
time; long ones walk alone. No shuffle; work follows the text's length.

Defined cases: null text counts as empty and has no ids; characters that no token joins come out as their single bytes;
markers of special tokens in a text are ordinary text; rows with the same doc_id are separate; other columns are ignored. Ids that
end within a character, or form none, decode to U+FFFD as Python's decoder has it.
"""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm import shingles as sh
from quadrat.llm.pieces import span_hashes, spread
from quadrat.llm.shared import ship

OTHER, LETTER, NUMBER, SPACE = range(4)
HELD_BYTES = 96 << 20
AT_ONCE = 1 << 20  # bytes of texts worked on together
ALONE = 512  # bytes from which a piece walks by itself
END = 256
ROOT, NONE = 0, -1


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def code_point_classes() -> np.ndarray:
    """Class of each code point by the library's own pattern engine: one byte each."""
    import tiktoken

    bytes_only = {bytes([k]): k for k in range(256)}
    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)]).astype("<u4")
    everything = points.tobytes().decode("utf-32-le")
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=bytes_only, special_tokens={})
        found = bytes(probe.encode_ordinary(everything)).decode()
        out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    return out


def piece_starts(codes: np.ndarray, firsts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Which code points begin a piece; ``firsts`` are the places of the texts' first code points, one behind the end allowed."""
    n = len(codes)
    kind = classes[codes]
    begins = np.zeros(n + 1, bool)
    begins[firsts] = True
    begins[n] = True
    before = np.concatenate([[OTHER], kind[:-1]]).astype(np.uint8)
    space, after_space = kind == SPACE, before == SPACE
    after_blank = np.concatenate([[False], codes[:-1] == 32])
    # At the end of a text white space goes on, so to speak: its last character stays with the others.
    before_space = np.concatenate([space[1:], [True]]) | begins[1:]
    start = np.where(space, ~(after_space & before_space), np.where(after_space, ~after_blank, kind != before))
    start |= begins[:-1]
    ticks = np.flatnonzero((codes == ord("'")) & start & ~begins[1:])
    if len(ticks):
        one = codes[ticks + 1]
        two = np.where(begins[np.minimum(ticks + 2, n)], 0, codes[np.minimum(ticks + 2, n - 1)])
        short = np.isin(one, [ord(x) for x in "stmd"])
        long = np.zeros(len(ticks), bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b))
        start[ticks[short | long] + 1] = False
        behind = np.concatenate([ticks[short] + 2, ticks[long] + 3])
        start[behind[behind < n]] = True
    return start


class StepTable:
    """Numbers of steps by (state, byte) for whole arrays: open addressing, at most half full."""

    def __init__(self, log2: int = 16):
        self.keys, self.values, self.shift, self.used = np.full(1 << log2, NONE), np.zeros(1 << log2, np.int32), 64 - log2, 0

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """NONE where there is none."""
        out, at, mask = np.full(len(keys), NONE, np.int64), self.slots(keys), len(self.keys) - 1
        found = self.keys[at]
        hit = found == keys
        out[hit] = self.values[at[hit]]
        open_ = np.flatnonzero(~hit & (found != NONE))
        while len(open_):
            at[open_] = (at[open_] + 1) & mask
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found != NONE)]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that are not in it."""
        if 2 * (self.used + len(keys)) > len(self.keys):
            old = self.keys != NONE
            keys, values = np.concatenate([self.keys[old], keys]), np.concatenate([self.values[old], values])
            self.__init__(int(4 * len(keys)).bit_length())
        self.used += len(keys)
        at, mask = self.slots(keys), len(self.keys) - 1
        while len(keys):
            free = self.keys[at] == NONE
            self.keys[at[free]], self.values[at[free]] = keys[free], values[free]  # of two with one place the last stays
            left = self.keys[at] != keys
            keys, values, at = keys[left], values[left], (at[left] + 1) & mask


class Transducer:
    """The merges of a rank file, as states and steps made on demand."""

    def __init__(self, ranks: dict[bytes, int]):
        if len({*ranks} & {bytes([k]) for k in range(256)}) < 256:
            raise ValueError("a byte without a token")
        self.ranks, self.texts = ranks, {v: k for k, v in ranks.items()}
        self.child: dict[int, int] = {}
        self.token, self.parent = array("i", [NONE]), array("b", [0])
        for text, rank in ranks.items():
            node = ROOT
            for byte in text:
                key = node << 8 | byte
                below = self.child.get(key)
                if below is None:
                    self.parent[node] = 1
                    below = self.child[key] = len(self.token)
                    self.token.append(NONE)
                    self.parent.append(0)
                node = below
            self.token[node] = rank
        self.edges: dict[int, tuple] = {}
        self.clear()

    def clear(self) -> None:
        self.pairs: dict[int, bool] = {}
        self.states: dict[bytes, int] = {}
        self.members: list[bytes] = []
        self.table = StepTable()
        self.next, self.low, self.outs = array("i"), array("q", [0]), array("i")
        self.held = 0
        self.start = self.state([(ROOT, NONE, ())])

    def merges(self, text: bytes):
        """Merges of a short text: ranks, and the parts after each; the lowest rank first, the leftmost of equals."""
        parts = [text[k:k + 1] for k in range(len(text))]
        yield NONE, parts
        while len(parts) > 1:
            found = [(rank, k) for k in range(len(parts) - 1) if (rank := self.ranks.get(parts[k] + parts[k + 1])) is not None]
            if not found:
                break
            rank, k = min(found)
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
            yield rank, parts

    def edge(self, token: int) -> tuple:
        """Whether the merges of its own bytes give this token, whether they come in order of rank, and its left and right parts with the ranks they come with."""
        got = self.edges.get(token)
        if got is None:
            left, right, last, ordered = [], [], NONE, True
            for rank, parts in self.merges(self.texts[token]):
                ordered, last = ordered and rank >= last, rank
                if not left or left[-1][1] != parts[0]:
                    left.append((rank, parts[0]))
                if not right or right[-1][1] != parts[-1]:
                    right.append((rank, parts[-1]))
            got = self.edges[token] = (len(parts) == 1, ordered, left, right)
        return got

    def may_follow(self, last: int, token: int) -> bool:
        good = self.pairs[last << 32 | token] = self.side_by_side(last, token)
        self.held += 130
        return good

    def side_by_side(self, last: int, token: int) -> bool:
        """Whether the merges of both tokens' joint bytes give them back; both come from their own bytes."""
        (_, in_order, _, right), (_, also, left, _) = self.edge(last), self.edge(token)
        if not (in_order and also):
            *_, (_, parts) = self.merges(self.texts[last] + self.texts[token])
            return parts == [self.texts[last], self.texts[token]]
        i = j = 0
        while True:
            here = right[i + 1][0] if i + 1 < len(right) else 1 << 40
            there = left[j + 1][0] if j + 1 < len(left) else 1 << 40
            over = self.ranks.get(right[i][1] + left[j][1])
            # Of equal ranks the leftmost merges first: inside the first token, then over the boundary, then inside the second.
            if over is not None and over < here and over <= there:
                return False
            if i + 1 == len(right) and j + 1 == len(left):
                return True
            i, j = (i + 1, j) if here <= there else (i, j + 1)

    def state(self, members: list[tuple]) -> int:
        """Number of a set of paths: (node, token before it, tokens not emitted), packed."""
        flat = array("i")
        for node, last, held in members:
            flat.extend((node, last, len(held), *held))
        packed = flat.tobytes()
        number = self.states.get(packed)
        if number is None:
            number = self.states[packed] = len(self.members)
            self.members.append(packed)
            self.held += 180 + len(packed)
        return number

    def paths(self, state: int):
        flat, at = array("i", self.members[state]), 0
        while at < len(flat):
            end = at + 3 + flat[at + 2]
            yield flat[at], flat[at + 1], tuple(flat[at + 3:end])
            at = end

    def step(self, key: int) -> int:
        """Makes the step of a (state, byte): its number. The byte behind a piece is END."""
        byte, child, tokens, pairs = key & 511, self.child, self.token, self.pairs
        if byte == END:
            members = [*self.paths(key >> 9)]
            node, last, held = members[0]
            whole = last == NONE and not held and tokens[node] != NONE
            emitted = (tokens[node],) if whole else next(held for node, _, held in members if node == ROOT)
            target = self.start
        else:
            moved, boundary = [], None
            for node, last, held in self.paths(key >> 9):
                below = child.get(node << 8 | byte)
                if below is None:
                    continue
                token, goes_on = tokens[below], self.parent[below]
                if token != NONE and (boundary is None or not goes_on):
                    own = self.edge(token)[0]
                    if own and boundary is None:
                        good = last == NONE or pairs.get(last << 32 | token)
                        if good or (good is None and self.may_follow(last, token)):
                            boundary = (ROOT, token, (*held, token))
                    # A token that its own bytes don't merge to stands for a whole piece only.
                    goes_on = goes_on or (not own and last == NONE)
                if goes_on:
                    moved.append((below, last, held))
            moved.append(boundary)
            emitted = moved[0][2]
            for _, _, held in moved:
                while emitted != held[:len(emitted)]:
                    emitted = emitted[:-1]
            if emitted:
                moved = [(node, last, held[len(emitted):]) for node, last, held in moved]
            target = self.state(moved)
        number = len(self.next)
        self.next.append(target)
        self.outs.extend(emitted)
        self.low.append(len(self.outs))
        self.held += 64
        return number

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the steps, made where there are none."""
        out = self.table.find(keys)
        missing = np.flatnonzero(out == NONE)
        if len(missing):
            new, which = np.unique(keys[missing], return_inverse=True)
            made = np.array([self.step(key) for key in new.tolist()], np.int64)
            self.table.add(new, made.astype(np.int32))
            out[missing] = made[which]
        return out

    def walk(self, piece: bytes) -> list[int]:
        """Steps of one piece, its end included."""
        at, out, known = self.start, [], {}
        for byte in (*piece, END):
            key = at << 9 | byte
            number = known.get(key)
            if number is None:
                number = known[key] = int(self.numbers(np.array([key]))[0])
            out.append(number)
            at = self.next[number]
        return out

    def encode_pieces(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the pieces, one after the other, and how many each has."""
        if self.held > HELD_BYTES:
            self.clear()
        order = np.argsort(-lengths, kind="stable")
        base = np.concatenate([[0], np.cumsum(lengths + 1)])
        steps = np.zeros(int(base[-1]), np.int64)
        alone = int(np.searchsorted(-lengths[order], -ALONE, side="left"))
        for k in order[:alone]:
            steps[base[k]:base[k + 1]] = self.walk(data[starts[k]:starts[k] + lengths[k]].tobytes())
        order = order[alone:]
        sizes, begin, place = lengths[order], starts[order], base[:-1][order]
        at = np.full(len(order), self.start, np.int64)
        active = len(order)
        for j in range(int(sizes.max(initial=NONE)) + 1):
            active = int(np.searchsorted(-sizes[:active], -j, side="right"))
            ends = sizes[:active] == j
            byte = np.where(ends, END, data[np.minimum(begin[:active] + j, len(data) - 1)].astype(np.int64))
            numbers = self.numbers(at[:active] << 9 | byte)
            steps[place[:active] + j] = numbers
            at[:active] = np.frombuffer(self.next, np.int32)[numbers]
        low = np.frombuffer(self.low, np.int64)
        begin, end = low[steps], low[steps + 1]
        del low
        ids = spread(np.frombuffer(self.outs, np.int32), begin, end)
        return ids, np.add.reduceat(end - begin, base[:-1]) if len(lengths) else np.zeros(0, np.int64)

    def encode_texts(self, data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts in a buffer, one after the other, and their offsets by text."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        leads = np.flatnonzero((data & 0xC0) != 0x80)
        starts = leads[piece_starts(codes, np.searchsorted(leads, offsets), classes)]
        stops = np.append(starts[1:], len(data))
        _, first, which = np.unique(span_hashes(data, starts, stops), return_index=True, return_inverse=True)
        ids, counts = self.encode_pieces(data, starts[first], stops[first] - starts[first])
        ends = np.cumsum(counts)
        bounds = np.concatenate([[0], np.cumsum(counts[which])])
        return spread(ids, (ends - counts)[which], ends[which]), bounds[np.searchsorted(starts, offsets)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(text): int(rank) for text, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(read_ranks(path))


@lru_cache(maxsize=2)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all tokens in the order of ids, and their offsets; an id without a token has none."""
    ranks = read_ranks(path)
    texts = [b""] * (max(ranks.values()) + 1)
    for text, rank in ranks.items():
        texts[rank] = text
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in texts])])


def encode(docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """doc_id, ids of each text."""
    path, spark = ranks_path or default_ranks(), docs.sparkSession
    ship(spark)
    classes = spark.sparkContext.broadcast(code_point_classes())

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = sh.text_buffer(batch.column(1))
            for low, high in sh.pieces(offsets, AT_ONCE):
                ids, bounds = transducer(path).encode_texts(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low], classes.value)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), lists], ["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def utf8_machine() -> list[list[int]]:
    """Next state by state and byte. 0: between characters; 1 to 3: so many more bytes; 4 to 7: as 2 or 3, the next byte in part of the range; 8: no character."""
    table = [[8] * 256 for _ in range(9)]
    for byte in range(256):
        table[0][byte] = 0 if byte < 0x80 else 1 if 0xC2 <= byte < 0xE0 else 2 if 0xE0 <= byte < 0xF0 else 3 if 0xF0 <= byte < 0xF5 else 8
    table[0][0xE0], table[0][0xED], table[0][0xF0], table[0][0xF4] = 4, 5, 6, 7
    for state, low, high, after in ((1, 0x80, 0xC0, 0), (2, 0x80, 0xC0, 1), (3, 0x80, 0xC0, 2), (4, 0xA0, 0xC0, 1), (5, 0x80, 0xA0, 1), (6, 0x90, 0xC0, 2), (7, 0x80, 0x90, 2)):
        table[state][low:high] = [after] * (high - low)
    return table


class Utf8Stream:
    """Text from bytes that come in parts; the bytes of an unfinished character wait for the next part."""

    MACHINE = utf8_machine()

    def __init__(self):
        self.waiting = b""

    def feed(self, data: bytes) -> str:
        data = self.waiting + data
        cut = len(data)
        for k in range(max(0, len(data) - 3), len(data)):
            state = 0
            for byte in data[k:]:
                state = self.MACHINE[state][byte]
            if data[k] >= 0xC0 and 0 < state < 8:
                cut = k
                break
        self.waiting = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        out, self.waiting = self.waiting.decode("utf-8", "replace"), b""
        return out


def decode(encoded: DataFrame, ranks_path: str | None = None, at_once: int = 1 << 18) -> DataFrame:
    """doc_id, ids, text; the ids of a long document are decoded so many at a time."""
    path = ranks_path or default_ranks()
    ship(encoded.sparkSession)

    def text_of(ids: np.ndarray) -> str:
        data, offsets = token_bytes(path)
        stream, out = Utf8Stream(), []
        for k in range(0, len(ids), at_once):
            some = ids[k:k + at_once]
            out.append(stream.feed(spread(data, offsets[some], offsets[some + 1]).tobytes()))
        return "".join([*out, stream.close()])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(1)
            ids, bounds = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            for low, high in sh.pieces(bounds, 1 << 20):
                texts = pa.array([text_of(ids[a:b]) for a, b in zip(bounds[low:high], bounds[low + 1:high + 1], strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*[x.slice(low, high - low) for x in batch.columns], texts], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")
