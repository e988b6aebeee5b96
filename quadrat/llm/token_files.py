"""Token ids in a compact binary file format: static range asymmetric numeral system (rANS), block by block.

Documents are sorted by id; each partition of the sort is cut into blocks of whole documents of at least ``BLOCK`` ids
(the last one of a partition may hold fewer). One pass over all ids gives one frequency table for all blocks, scaled to
2^20 with at least 1 for every id that occurs. A block is coded by itself: ``LANES`` coders take turns (id t belongs to
coder t mod LANES), each with a 64-bit state that gives off or takes in 32-bit words, all in one stream. A block holds its
documents' ids and lengths, the number of ids before it, the states that decoding starts from, checkpoints (the states and
the place in the stream after every ``EVERY`` rounds, from which a reader can start as well), the words and the CRC-32 of
its ids. The files are Parquet, a row per block, next to the table of frequencies: ``blocks`` and ``frequencies``.

Defined cases: null text counts as empty and has the end id alone; documents are in ascending order of ``doc_id`` with a
null id last, and rows with equal ids in order of their text; no documents give files without blocks; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from array import array
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.llm import shingles as sh
from quadrat.llm.pieces import SpanIndex, spread
from quadrat.llm.shared import Kept, ship, shuffle_width

BLOCK = 1 << 19  # ids in a block at least
LANES, EVERY = 2048, 64
SCALE = 20  # bits of the frequency table
LOW = 1 << 31  # smallest state between two ids
CACHED = 600_000  # words kept in a worker
LETTERS = "abcdefghijklmnopqrstuvwxyz"
ENDING = "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"  # signs that the tokenizer always parts from a letter before them


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Ids of texts, put together from those of their words.

    The tokenizer drops white space and never joins what it parts, so a text's ids are those of its words. A word of
    letters with signs behind it has the ids of the letters and of the signs, provided that the letters are still nothing but
    letters after the tokenizer's own normaliser: it would join a mark that this puts at their end with the signs. Words met
    before are looked up.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.plain = self._letters_go_through()
        self.clear()

    def _letters_go_through(self) -> bool:
        """Whether words of lower-case ASCII letters reach the tokenizer's model as they are."""
        normal, cut = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        if any(token.content.isascii() and token.content.isalpha() for token in self.tokenizer.get_added_tokens_decoder().values()):
            return False
        words = [*LETTERS, LETTERS, LETTERS[::-1]]
        same = normal is None or all(normal.normalize_str(x) == x for x in words)
        return same and (cut is None or all([y for y, _ in cut.pre_tokenize_str(x)] == [x] for x in words))

    def _encoded(self, parts: list[str]):
        """Ids of each part; those of ASCII letters, which are lower-case, need the tokenizer's model only."""
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        plain = [self.plain and x.isascii() and x.isalpha() for x in parts]
        others = iter(encode([x for x, alone in zip(parts, plain, strict=True) if not alone], add_special_tokens=False))
        tokenize = self.tokenizer.model.tokenize
        for part, alone in zip(parts, plain, strict=True):
            yield [x.id for x in tokenize(part)] if alone else next(others).ids

    def clear(self) -> None:
        self.spans = SpanIndex()
        self.parts: dict[str, int] = {}
        self.part_begins, self.part_ids = array("q", [0]), array("I")
        self.begins, self.ids = array("q", [0]), array("I")

    def _add(self, new: list[str]) -> None:
        held, members, ends, normal = len(self.parts), [], [], self.tokenizer.normalizer
        number, member, end = self.parts.setdefault, members.append, ends.append
        for word in new:
            stem = word.rstrip(ENDING)
            if stem.isalpha() and (stem.isascii() or normal is None or normal.normalize_str(stem).isalpha()):
                member(number(stem.lower() if stem.isascii() else stem, len(self.parts)))
                if len(stem) < len(word):
                    member(number(word[len(stem):], len(self.parts)))
            else:
                member(number(word, len(self.parts)))
            end(len(members))
        fresh = list(islice(reversed(self.parts), len(self.parts) - held))[::-1]
        for found in self._encoded(fresh):
            self.part_ids.extend(found)
            self.part_begins.append(len(self.part_ids))
        begins, which = np.frombuffer(self.part_begins, np.int64), np.array(members, np.int64)
        low, high = begins[which], begins[which + 1]
        held = len(self.ids)
        self.ids.frombytes(spread(np.frombuffer(self.part_ids, np.uint32), low, high).tobytes())
        upto = np.concatenate([[0], np.cumsum(high - low)])
        self.begins.frombytes((held + upto[np.array(ends, np.int64)]).tobytes())

    def of_texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a buffer, one after the other, and their offsets by text."""
        starts, stops, bounds = sh.word_spans(data, offsets)
        where = self.spans.of(data, starts, stops, self._add, separator=10)
        begins, ids = np.frombuffer(self.begins, np.int64), np.frombuffer(self.ids, np.uint32)
        low, high = begins[where], begins[where + 1]
        return spread(ids, low, high), np.concatenate([[0], np.cumsum(high - low)])[bounds]


_word_ids: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _word_ids:
        _word_ids[path] = WordIds(path)
    if len(_word_ids[path].begins) > CACHED:
        _word_ids[path].clear()
    return _word_ids[path]


class Coder:
    """Coder of a frequency table: ids in ascending order and how often each occurs."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        self.ids = ids
        total = 1 << SCALE
        share = np.maximum(1, np.floor(counts / max(1, counts.sum()) * (total - len(ids)))).astype(np.int64)
        if len(ids):
            share[np.argmax(share)] += total - share.sum()
        self.share = share.astype(np.uint64)
        ends = np.cumsum(share)
        self.begin = (ends - share).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(ids), dtype=np.int32), share)  # by place in the table
        self.rank = np.zeros(int(ids[-1]) + 1 if len(ids) else 0, np.int32)
        self.rank[ids] = np.arange(len(ids))

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(states, words, checkpoint states, words before each checkpoint)."""
        symbols = self.rank[ids]
        rounds = -(-len(ids) // LANES)
        state = np.full(LANES, LOW, np.uint64)
        chunks, saved = [], []
        for t in range(rounds - 1, -1, -1):
            now = symbols[t * LANES:(t + 1) * LANES]
            own, share = state[:len(now)], self.share[now]
            full = own >= share << np.uint64(63 - SCALE)
            chunks.append((own[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
            own[full] >>= np.uint64(32)
            high = own // share
            own += high * (np.uint64(1 << SCALE) - share) + self.begin[now]
            if t and t % EVERY == 0:
                saved.append((len(chunks), state.copy()))
        chunks.reverse()
        before = np.concatenate([[0], np.cumsum([len(x) for x in chunks])])
        points = [before[rounds - n] for n, _ in reversed(saved)]
        states = np.concatenate([s for _, s in reversed(saved)]) if saved else np.zeros(0, np.uint64)
        return state, np.concatenate(chunks) if chunks else np.zeros(0, np.uint32), states, np.array(points, np.int64)

    def decode(self, n: int, state: np.ndarray, words: np.ndarray, first_round: int = 0) -> np.ndarray:
        """The block's ids from a round on, given the states and the words from there."""
        state, at, out = state.copy(), 0, []
        for t in range(first_round, -(-n // LANES)):
            own = state[:min(LANES, n - t * LANES)]
            place = own & np.uint64((1 << SCALE) - 1)
            now = self.symbol[place.astype(np.int64)]
            own[:] = self.share[now] * (own >> np.uint64(SCALE)) + place - self.begin[now]
            short = np.flatnonzero(own < np.uint64(LOW))
            own[short] = own[short] << np.uint64(32) | words[at:at + len(short)].astype(np.uint64)
            at += len(short)
            out.append(now)
        return self.ids[np.concatenate(out)] if out else np.zeros(0, self.ids.dtype)


BLOCKS = "part int, seq int, doc_ids binary, null_ids int, lengths binary, n_ids long, local_start long, raw binary"


def tokenized(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Blocks of sorted whole documents with plain ids."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = docs.repartitionByRange(shuffle_width(docs.sparkSession), F.col("doc_id").asc_nulls_last())
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "text")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, seq, before = TaskContext.get().partitionId(), 0, 0
        doc_ids, found = [], []

        def block():
            lengths = np.array([len(x) for x in found], np.int64)
            some = [x for x in doc_ids if x is not None]
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([np.array(some, np.int64).tobytes()], pa.binary()),
                pa.array([len(doc_ids) - len(some)], pa.int32()), pa.array([lengths.tobytes()], pa.binary()), pa.array([int(lengths.sum())], pa.int64()),
                pa.array([before], pa.int64()), pa.array([np.concatenate(found).tobytes()], pa.binary()),
            ], [x.split()[0] for x in BLOCKS.split(", ")])

        held, end = 0, np.array([end_id], np.uint32)
        for batch in batches:
            names = batch.column(0).to_pylist()
            data, offsets = sh.text_buffer(batch.column(1))
            for low, high in sh.pieces(offsets):
                ids, bounds = word_ids(path).of_texts(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
                for k in range(high - low):
                    doc_ids.append(names[low + k])
                    found.append(np.concatenate([ids[bounds[k]:bounds[k + 1]], end]))
                    held += len(found[-1])
                    if held >= BLOCK:
                        yield block()
                        seq, before, held, doc_ids, found = seq + 1, before + held, 0, [], []
        if found:
            yield block()

    return ordered.mapInArrow(run, BLOCKS)


def write_tokens(docs: DataFrame, path: str, end_id: int, tokenizer_path: str | None = None) -> None:
    """Write the ids of all documents, each with the end id behind it, as files below ``path``."""
    spark = docs.sparkSession
    kept = Kept(spark, "token-files")
    plain = kept.keep(tokenized(docs, tokenizer_path or default_tokenizer(), end_id))

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch["raw"]:
                found = np.bincount(np.frombuffer(raw, np.uint32))
                if len(found) > len(total):
                    total = np.concatenate([total, np.zeros(len(found) - len(total), np.int64)])
                total[:len(found)] += found
        some = np.flatnonzero(total)
        yield pd.DataFrame({"id": some, "n": total[some]})

    counted = plain.select("raw").mapInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counted.coalesce(1).sortWithinPartitions("id").write.parquet(f"{path}/frequencies")
    table = spark.read.parquet(f"{path}/frequencies").toPandas().sort_values("id")  # a row per id of the vocabulary at most
    parts = plain.groupBy("part").agg(F.sum("n_ids").alias("n")).toPandas().sort_values("part")  # a row per partition
    shared = spark.sparkContext.broadcast((table["id"].to_numpy(np.int64), table["n"].to_numpy(np.int64), dict(zip(parts["part"], parts["n"].cumsum() - parts["n"], strict=True))))

    def encode(batches):
        ids, counts, offsets = shared.value
        coder = _coder(ids.tobytes(), counts.tobytes())
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                plain_ids = np.frombuffer(row.raw, np.uint32)
                state, words, saved, points = coder.encode(plain_ids)
                rows.append((row.part, row.seq, row.doc_ids, row.null_ids, row.lengths, row.n_ids, offsets[row.part] + row.local_start, state.tobytes(), saved.tobytes(), points.tobytes(), words.tobytes(), zlib.crc32(row.raw)))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in CODED.split(", ")])

    plain.mapInPandas(encode, CODED).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    kept.clear()


CODED = "part int, seq int, doc_ids binary, null_ids int, lengths binary, n_ids long, start long, states binary, saved binary, points binary, words binary, crc32 long"


@lru_cache(maxsize=1)
def _coder(ids: bytes, counts: bytes) -> Coder:
    return Coder(np.frombuffer(ids, np.int64), np.frombuffer(counts, np.int64))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids before it in the files), ids (little-endian unsigned 32-bit) of every document in the files."""
    ship(spark)
    table = spark.read.parquet(f"{path}/frequencies").toPandas().sort_values("id")
    shared = spark.sparkContext.broadcast((table["id"].to_numpy(np.int64), table["n"].to_numpy(np.int64)))

    def decode(batches):
        coder = _coder(*(x.tobytes() for x in shared.value))
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids = coder.decode(row.n_ids, np.frombuffer(row.states, np.uint64), np.frombuffer(row.words, np.uint32)).astype(np.uint32)
                if zlib.crc32(ids.tobytes()) != row.crc32:
                    raise ValueError(f"block {row.part}, {row.seq}: its checksum is not that of its ids")
                lengths = np.frombuffer(row.lengths, np.int64)
                ends = np.cumsum(lengths)
                names = pd.Series(np.frombuffer(row.doc_ids, np.int64), dtype="Int64")
                names = pd.concat([names, pd.Series([pd.NA] * row.null_ids, dtype="Int64")], ignore_index=True) if row.null_ids else names
                yield pd.DataFrame({"doc_id": names, "start": row.start + ends - lengths, "ids": [ids[e - n:e].tobytes() for e, n in zip(ends, lengths, strict=True)]})

    return spark.read.schema(CODED).parquet(f"{path}/blocks").mapInPandas(decode, "doc_id long, start long, ids binary")


def read_from_checkpoint(row, table: pd.DataFrame, k: int) -> np.ndarray:
    """Ids of a block from its k-th checkpoint (from 0) on."""
    coder = Coder(table["id"].to_numpy(np.int64), table["n"].to_numpy(np.int64))
    state = np.frombuffer(row["saved"], np.uint64)[k * LANES:(k + 1) * LANES]
    words = np.frombuffer(row["words"], np.uint32)[np.frombuffer(row["points"], np.int64)[k]:]
    return coder.decode(row["n_ids"], state, words, (k + 1) * EVERY)
