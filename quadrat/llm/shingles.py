"""Hashes of words and word shingles for whole batches of texts, as numpy arrays.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, both byte rules of UTF-8 text, so a batch is worked on as one
byte buffer. A word's 64-bit hash is the sum of a random number per byte times an odd number per position.
"""

from __future__ import annotations

import numpy as np

from quadrat.llm.shared import mix64

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256)
LOWER[65:91] += 32
BYTE_CODE = mix64(LOWER.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


def position_codes(n: int, seed: int) -> np.ndarray:
    """Odd 64-bit multipliers of the first n positions."""
    return mix64(np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def text_buffer(texts) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a pyarrow string array without nulls, or of a list of str."""
    import pyarrow as pa

    array = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
    array = array.cast(pa.large_binary())
    if array.offset:
        array = pa.concat_arrays([array])
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64, count=len(array) + 1)
    data = array.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None and offsets[-1] else np.zeros(0, np.uint8)
    return flat[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = 1 << 20):
    """Ranges of documents of at most so many bytes, or of one longer document."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, end
        at = end


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of each word, and the words' offsets by document."""
    word = ~SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    first[begins] = word[begins]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, starts, np.zeros(len(offsets), np.int64)
    at = np.flatnonzero(word)
    firsts = np.flatnonzero(first[at])
    lengths = np.diff(np.append(firsts, len(at)))
    within = np.arange(len(at)) - np.repeat(firsts, lengths)
    codes = position_codes(int(lengths.max()), 1)
    hashes = mix64(np.add.reduceat(BYTE_CODE[data[at]] * codes[within], firsts))
    return hashes, starts, starts + lengths, np.searchsorted(starts, offsets)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end byte of each word, and the words' offsets by document."""
    word = np.concatenate([[False], ~SPACE[data], [False]])
    parted = np.zeros(len(data) + 1, bool)  # between two texts
    parted[offsets] = True
    starts = np.flatnonzero(word[1:] & (~word[:-1] | parted))
    stops = np.flatnonzero(word[:-1] & (~word[1:] | parted))
    return starts, stops, np.searchsorted(starts, offsets)


def word_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Words of each document."""
    return np.diff(word_spans(data, offsets)[2])


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the words' offsets by document."""
    hashes, _, _, bounds = words_of(data, offsets)
    return hashes, bounds


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each n-word shingle, and its document. Fewer words than n: the whole sequence is one shingle."""
    counts = np.diff(bounds)
    codes = position_codes(n, 2)
    made = np.maximum(counts - n + 1, 0)
    docs = np.repeat(np.arange(len(counts)), made)
    at = np.repeat(bounds[:-1], made) + np.arange(made.sum()) - np.repeat(np.cumsum(made) - made, made)
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out += words[at + k] * codes[k]
    short = np.flatnonzero((counts > 0) & (counts < n))
    extra = np.zeros(len(short), np.uint64)
    for k in range(n - 1):
        there = counts[short] > k
        extra[there] += words[bounds[short[there]] + k] * codes[k]
    extra += counts[short].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix64(np.concatenate([out, extra])), np.concatenate([docs, short])


def shingle_sets(words: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, ordered by document and hash, and their offsets by document."""
    hashes, docs = shingle_hashes(words, bounds, n)
    order = np.argsort(hashes)
    order = order[np.argsort(docs[order].astype(np.uint16) if len(bounds) <= 1 << 16 else docs[order], kind="stable")]
    hashes, docs = hashes[order], docs[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
    hashes, docs = hashes[new], docs[new]
    return hashes, np.searchsorted(docs, np.arange(len(bounds)))


def sequence_hashes(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each document's word sequence."""
    counts = np.diff(bounds)
    out = []
    full = counts > 0
    for seed in (3, 4):
        codes = position_codes(int(counts.max(initial=0)), seed)
        within = np.arange(len(words)) - np.repeat(bounds[:-1], counts)
        total = np.zeros(len(counts), np.uint64)
        if full.any():
            total[full] = np.add.reduceat(words * codes[within], bounds[:-1][full])
        out.append(mix64(total + counts.astype(np.uint64)))
    return out[0], out[1]
