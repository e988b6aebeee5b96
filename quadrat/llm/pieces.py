"""A SentencePiece model's vocabulary, and the cut of texts into independent segments.

A space is the visible space of the pieces. Pieces hold spaces in front only, so no piece, and no merge, crosses from a
character to a following space: a text is encoded segment by segment, each the run of spaces before a word and the word.
The first segment's first space is the one the model puts before every text; callers put it there. Two characters that stand side by side in no piece part a segment further, for example a letter and a
comma: its parts are what is worked on once and kept.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from quadrat.llm.shared import mix64
from quadrat.llm.shingles import position_codes

VISIBLE_SPACE = "▁"
SPAN_CODE = mix64(np.arange(256, dtype=np.uint64) + np.uint64(0xA0761D6478BD642F))


class Vocabulary:
    """Pieces by text (a space for the visible space), their merge ranks, and the ids of the 256 byte pieces."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.ids, self.ranks, self.bytes = {}, {}, [0] * 256
        self.texts = [b""] * model.get_piece_size()
        for i in range(model.get_piece_size()):
            if model.is_byte(i):
                code = int(model.id_to_piece(i)[3:5], 16)
                self.bytes[code] = i
                self.texts[i] = bytes([code])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                piece = model.id_to_piece(i).replace(VISIBLE_SPACE, " ")
                if " " in piece.lstrip(" "):
                    raise ValueError("a piece with a space behind a character: texts can't be cut at spaces")
                self.ids[piece], self.ranks[piece] = i, -model.get_score(i)
                self.texts[i] = piece.encode()
        self.longest = max(map(len, self.ids))
        pairs = {ord(a) << 21 | ord(b) for piece in self.ids for a, b in zip(piece, piece[1:], strict=False)}
        self.neighbours = np.array([*sorted(pairs), 1 << 62])  # two characters side by side in a piece; the last is none
        self.reach: dict[str, int] = {}  # longest piece that ends in these three characters
        for piece in self.ids:
            if len(piece) > 2:
                self.reach[piece[-3:]] = max(len(piece), self.reach.get(piece[-3:], 0))


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of the segments of texts in a buffer, and their offsets by text; each text that isn't empty starts with a space."""
    space = data == 32
    start = space.copy()
    start[1:] &= ~space[:-1]
    start[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(start)
    return starts, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans that aren't empty."""
    lengths = stops - starts
    ends = np.cumsum(lengths)
    within = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)
    codes = position_codes(int(lengths.max()), 6)
    return mix64(np.add.reduceat(SPAN_CODE[data[np.repeat(starts, lengths) + within]] * codes[within], ends - lengths) + lengths.astype(np.uint64))


class SpanIndex:
    """Numbers of the byte spans met so far, by their hash (two spans share one with odds of about 2^-64 a pair)."""

    def __init__(self):
        self.keys, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def of(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray, add: Callable[[list[str]], None], separator: int | None = None) -> np.ndarray:
        """Number of each span; ``add`` is told the texts of new ones, which get the next numbers in this order.

        ``separator``: an ASCII code in no span, if there is one, by which the texts are taken out together.
        """
        if not len(starts):
            return np.zeros(0, np.int64)
        hashes, first, inverse = np.unique(span_hashes(data, starts, stops), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, hashes)
        known = np.zeros(len(hashes), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == hashes[inside]
        number = np.empty(len(hashes), np.int64)
        number[known] = self.numbers[at[known]]
        new = np.flatnonzero(~known)
        number[new] = len(self.keys) + np.arange(len(new))
        if separator is None:
            raw = data.tobytes()
            add([raw[starts[k]:stops[k]].decode() for k in first[new]])
        elif len(new):
            low, high = starts[first[new]], stops[first[new]]
            raw = spread(np.append(data, np.uint8(separator)), low, high + 1)
            raw[np.cumsum(high + 1 - low) - 1] = separator
            add(raw[:-1].tobytes().decode().split(chr(separator)))
        self.keys, self.numbers = np.insert(self.keys, at[new], hashes[new]), np.insert(self.numbers, at[new], number[new])
        return number[inverse]


class Parts:
    """Numbers of the parts of segments met so far; ``add`` is told the new parts, in the order of the numbers."""

    def __init__(self, model: Vocabulary, add: Callable[[list[str]], None]):
        self.neighbours, self.add = model.neighbours, add
        self.spans = SpanIndex()
        self.parts: dict[str, int] = {}
        self.begins, self.members = array("q", [0]), array("q")

    def _cut(self, new: list[str]) -> None:
        if not new:
            return
        joined, known, fresh = "".join(new), self.parts, []
        codes = code_points(joined)
        pair = codes[:-1] << 21 | codes[1:]
        ends = np.cumsum([len(x) for x in new])
        first = np.concatenate([[True], self.neighbours[np.searchsorted(self.neighbours, pair)] != pair])
        first[ends[:-1]] = True
        cuts = np.append(np.flatnonzero(first), len(codes))
        places, held = cuts.tolist(), len(self.members)
        for low, high in zip(places[:-1], places[1:], strict=True):
            part = joined[low:high]
            number = known.get(part)
            if number is None:
                number = known[part] = len(known)
                fresh.append(part)
            self.members.append(number)
        self.begins.frombytes((held + np.searchsorted(cuts, ends)).tobytes())
        self.add(fresh)

    def sequence(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts of all texts in a buffer, one after the other, and their offsets by text."""
        starts, bounds = segments(data, offsets)
        where = self.spans.of(data, starts, np.append(starts[1:], len(data)), self._cut)
        begins, members = np.frombuffer(self.begins, np.int64), np.frombuffer(self.members, np.int64)
        low, high = begins[where], begins[where + 1]
        return spread(members, low, high), np.concatenate([[0], np.cumsum(high - low)])[bounds]


def spread(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """``values[low[0]:high[0]]``, ``values[low[1]:high[1]]`` and so on, one after the other."""
    lengths = high - low
    ends = np.cumsum(lengths)
    return values[np.repeat(low - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
