"""Language of texts, and of spans in mixed texts: script ranges, per-word scores, Viterbi with a switching penalty.

The model has, per language, log probabilities of hashed byte n-grams (1 to 4, spaces at the word's edges) and the scripts
its letters are of. A word's candidates are the languages with its script (all if none has it); its score in a language is
the sum over its n-grams, a mean over the orders. Words without letters are neutral. The best labelling of a text's
words is the one with the highest sum of scores less ``PENALTY`` for each change of language (Viterbi). It is one language if
no run of words gains more than half a penalty by another one, which sums over words show without the recursion; other
texts take it. The text's language is the one with most letters in its spans; its score is their share of all letters.

The model is learned on about ``per_language`` labelled rows of each language, picked by a hash of ``doc_id``; n-grams
fall in ``SLOTS`` slots, so it has SLOTS numbers per language whatever the input.

Defined cases: null text, empty text and text without a letter are ``und`` with score 0 and no spans, and so is everything
if no row is labelled; ties go to the language first by name; a null ``doc_id`` is neither held out nor learned from; rows with equal
ids are separate; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.llm import shingles as sh
from quadrat.llm.shared import mix64, ship

SLOTS, ORDERS, PENALTY, SMOOTH = 1 << 16, (1, 2, 3, 4), 20.0, 0.5
PER_LANGUAGE = 4000
AT_ONCE = 1 << 18  # bytes of texts worked on together: their tables take a hundred times that
FAR = 1e4  # below every candidate's score
# First code points of script ranges of the Unicode standard, by script (0: no letters of a script listed)
RANGES = [
    (0x0000, "none"), (0x0041, "latin"), (0x005B, "none"), (0x0061, "latin"), (0x007B, "none"), (0x00AA, "latin"), (0x00AB, "none"),
    (0x00B5, "greek"), (0x00B6, "none"), (0x00BA, "latin"), (0x00BB, "none"), (0x00C0, "latin"), (0x00D7, "none"), (0x00D8, "latin"),
    (0x00F7, "none"), (0x00F8, "latin"), (0x02B0, "none"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "none"), (0x0750, "arabic"), (0x0780, "none"), (0x08A0, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"),
    (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"),
    (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "ethiopic"), (0x13A0, "none"), (0x1780, "khmer"), (0x1800, "none"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "none"),
    (0x2C60, "latin"), (0x2C80, "none"), (0x3040, "kana"), (0x3100, "none"), (0x3130, "hangul"), (0x3190, "none"), (0x31F0, "kana"), (0x3200, "none"),
    (0x3400, "han"), (0xA000, "none"), (0xAC00, "hangul"), (0xD7B0, "none"), (0xF900, "han"), (0xFB00, "latin"), (0xFB07, "none"), (0x20000, "han"),
    (0x323B0, "none"),
]
SCRIPTS = sorted({name for _, name in RANGES})
STARTS = np.array([low for low, _ in RANGES])
SCRIPT_AT = np.array([SCRIPTS.index(name) for _, name in RANGES])
NONE, LATIN = SCRIPTS.index("none"), SCRIPTS.index("latin")


@dataclass(frozen=True)
class Model:
    languages: list[str]
    scores: np.ndarray  # (SLOTS, languages)
    allowed: np.ndarray  # (scripts, languages)


def gram_slots(data: np.ndarray, order: int) -> np.ndarray:
    """Slot of the n-gram that ends at each byte of a buffer of words and single spaces."""
    code = np.zeros(len(data), np.uint64)
    for k in range(order):
        code[k:] += sh.position_codes(4, 50)[k] * (data[:len(data) - k].astype(np.uint64) + np.uint64(1))
    return (mix64(code + np.uint64(order)) & np.uint64(SLOTS - 1)).astype(np.int64)


def code_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points of the characters that start at the given bytes of a UTF-8 buffer."""
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    lead = data[at].astype(np.int64)
    one, two, three = (padded[at + k].astype(np.int64) & 0x3F for k in (1, 2, 3))
    return np.select([lead < 0x80, lead < 0xE0, lead < 0xF0], [lead, (lead & 0x1F) << 6 | one, (lead & 0x0F) << 12 | one << 6 | two], (lead & 0x07) << 18 | one << 12 | two << 6 | three)


def word_features(data: np.ndarray, offsets: np.ndarray):
    """Words of the texts in a buffer: first and end byte, offsets by text, letters and script of each, and the words' own buffer.

    That buffer has each word with a space before it and behind it; the n-grams of word w end at bytes edges[w] to edges[w + 1].
    """
    _, starts, stops, bounds = sh.words_of(data, offsets)
    characters = np.flatnonzero((data & 0xC0) != 0x80)
    scripts = SCRIPT_AT[np.searchsorted(STARTS, code_points(data, characters), side="right") - 1]
    letters = scripts != NONE
    owner = np.searchsorted(starts, characters[letters], side="right") - 1
    counts = np.bincount(owner * len(SCRIPTS) + scripts[letters], minlength=len(starts) * len(SCRIPTS)).reshape(len(starts), len(SCRIPTS)) if len(starts) else np.zeros((0, len(SCRIPTS)), np.int64)
    lengths = stops - starts
    edges = np.concatenate([[0], np.cumsum(lengths + 1)])
    own = np.full(edges[-1] + 1, 32, np.uint8)
    within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    own[np.repeat(edges[:-1] + 1, lengths) + within] = sh.LOWER[data[np.repeat(starts, lengths) + within]]
    return starts, stops, bounds, counts, own, edges


def word_scores(model: Model, counts: np.ndarray, own: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Score of each word in each language."""
    if not len(counts):
        return np.zeros((0, len(model.languages)))
    total = np.zeros((len(own), len(model.languages)), np.float32)
    for order in ORDERS:
        total += model.scores[gram_slots(own, order)]
    out = np.add.reduceat(total[1:], edges[:-1], axis=0).astype(np.float64) / len(ORDERS)
    script = np.argmax(counts, axis=1)
    out += np.where(model.allowed[script], 0.0, -FAR)
    out[counts.sum(axis=1) == 0] = 0.0
    return out


def best_path(scores: np.ndarray) -> np.ndarray:
    """Language of each word in the labelling with the highest sum of scores less the penalties."""
    totals = scores.sum(axis=0)
    top = int(np.argmax(totals))
    gain = np.cumsum(scores - scores[:, [top]], axis=0)
    floor = np.minimum.accumulate(np.concatenate([np.zeros((1, gain.shape[1])), gain]), axis=0)[:-1]
    if (gain - floor).max() <= PENALTY / 2:
        return np.full(len(scores), top)
    back = np.zeros(scores.shape, np.int32)
    same = np.arange(scores.shape[1])
    value = scores[0].copy()
    for t in range(1, len(scores)):
        best = int(np.argmax(value))
        switched = value[best] - PENALTY
        back[t] = np.where(value >= switched, same, best)
        value = np.maximum(value, switched) + scores[t]
    path = np.empty(len(scores), np.int64)
    path[-1] = int(np.argmax(value))
    for t in range(len(scores) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def learn(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Model from rows of doc_id, text, lang, all not null."""
    ship(labelled.sparkSession)
    sizes = dict(labelled.groupBy("lang").count().collect())  # a row per language
    if not sizes:
        return Model([], np.zeros((SLOTS, 0), np.float32), np.zeros((len(SCRIPTS), 0), bool))
    share = F.element_at(F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_language / n)))), F.col("lang"))
    picked = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * F.lit(1 << 30)).select("text", "lang")

    def count(batches):
        import pyarrow as pa

        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(1).to_pylist()
            data, offsets = sh.text_buffer(batch.column(0))
            for low, high in sh.pieces(offsets, AT_ONCE):
                _, _, bounds, counts, own, edges = word_features(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
                if not len(counts):
                    continue
                lettered = np.append(np.repeat(counts.sum(axis=1) > 0, np.diff(edges)), False)
                slots = [gram_slots(own, order)[1:] for order in ORDERS]
                for k in range(high - low):
                    a, b = edges[bounds[k]], edges[bounds[k + 1]]
                    table = tables.setdefault(names[low + k], np.zeros(SLOTS + len(SCRIPTS), np.int64))
                    for x in slots:
                        table[:SLOTS] += np.bincount(x[a:b][lettered[a:b]], minlength=SLOTS) if b - a > 4096 else 0
                        if b - a <= 4096:
                            np.add.at(table, x[a:b][lettered[a:b]], 1)
                    table[SLOTS:] += counts[bounds[k]:bounds[k + 1]].sum(axis=0)
        for lang, table in tables.items():
            some = np.flatnonzero(table)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(some), pa.string()), "slot": pa.array(some, pa.int32()), "n": pa.array(table[some])})

    found = picked.mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(sizes)
    table = np.zeros((SLOTS + len(SCRIPTS), len(languages)))
    table[found["slot"], found["lang"].map(languages.index)] = found["n"]
    grams, scripts = table[:SLOTS], table[SLOTS:]
    scores = np.log((grams + SMOOTH) / (grams.sum(axis=0) + SMOOTH * SLOTS))
    allowed = scripts > 0.001 * scripts.sum(axis=0)
    allowed[~allowed.any(axis=1)] = True
    return Model(languages, scores.astype(np.float32), allowed)


def predict(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """doc_id, lang_pred, score, spans (code points and language) of every row of doc_id, text.

    ``carry``: further columns to pass through, with other names than these.
    """
    carry = carry or []
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, lang_pred string, score double, spans array<struct<begin:int,end:int,lang:string>>"

    def run(batches):
        import pyarrow as pa

        model = shared.value
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
        for batch in batches:
            texts = batch.column(1)
            data, offsets = sh.text_buffer(texts)
            names, shares, spans = [], [], []
            for low, high in sh.pieces(offsets, AT_ONCE):
                part = data[offsets[low]:offsets[high]]
                starts, stops, bounds, counts, own, edges = word_features(part, offsets[low:high + 1] - offsets[low])
                scores = word_scores(model, counts, own, edges)
                letters = counts.sum(axis=1)
                place = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
                for k in range(high - low):
                    a, b = bounds[k], bounds[k + 1]
                    if not model.languages or a == b or not (counts[a:b, LATIN].any() or has_letter(texts[low + k].as_py())):
                        names.append("und")
                        shares.append(0.0)
                        spans.append([])
                        continue
                    path = best_path(scores[a:b])
                    weight = np.bincount(path, weights=letters[a:b], minlength=len(model.languages))
                    if not weight.any():  # letters of scripts that are not listed
                        weight = np.bincount(path, minlength=len(model.languages)).astype(float)
                    top = int(np.argmax(weight))
                    names.append(model.languages[top])
                    shares.append(float(weight[top] / weight.sum()))
                    change = np.concatenate([[0], np.flatnonzero(np.diff(path)) + 1, [b - a]])
                    shift = place[offsets[low + k] - offsets[low]]
                    spans.append([
                        {"begin": int(place[starts[a + x]] - shift), "end": int(place[stops[a + y - 1]] - shift), "lang": model.languages[path[x]]}
                        for x, y in zip(change[:-1], change[1:], strict=True)
                    ])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(shares, pa.float64()), pa.array(spans, kind), *batch.columns[2:]], ["doc_id", "lang_pred", "score", "spans", *carry])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("__text"), *carry)
    schema = ", ".join([schema, *(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*carry).schema.fields)])
    return rows.mapInArrow(run, schema)


def learned(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Model of the labelled rows that are not held out."""
    labelled = docs.where("doc_id is not null and text is not null and lang is not null").where(~held_out(F.col("doc_id")))
    return learn(labelled.select("doc_id", "text", "lang"), per_language)


def language_id(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Predictions for all rows by a model of those not held out: doc_id, held_out, lang_pred, score, spans."""
    found = predict(docs, learned(docs, per_language))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "spans")
