"""The operators of the training-data pipeline against brute force, libraries and round trips, on small tables with odd rows."""

import hashlib
import re
import sys
import unicodedata
import zlib

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from quadrat.llm.shared import Kept
from quadrat.llm import byte_bpe, embedding_dedup, fill_in_middle, fingerprints, language_id, mixing, ngram_join, sentencepiece_sampling, source_audit, substring_dedup
from quadrat.llm import shingles, token_counts, token_files, url_filters
from quadrat.llm import queries
from quadrat.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
LONG = " ".join(f"word{k % 977} and{k % 31}." for k in range(15_000))
TEXTS = [
    None, "", "   \n\t ", "a", "Two words.", "The same line here of ten words is what we repeat.\nAnd another.", "the same line here of ten words is WHAT we repeat.",
    "The same line here of ten words is what we repeat.\nAnd another.", "  leading  and  double  spaces ", "ünï ▁code 日本語 🙂 e\u0301", "<s>hi</s> <|endoftext|> x", "1234 5678 !!", "١٢٣",
    LONG, LONG + " end.", "\x01\x02 ctrl", "der die und das ist ein Haus.", "the of and that is a house.", "the of and that is a house.",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, extra columns with names that operators use themselves."""
    rows = [(k, t, ["en", "de", None][k % 3], ["a", "b", None, ""][k % 4], len(t or "")) for k, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", "1 AS size", "'x' AS source_size", "2 AS component", "3 AS token", "4 AS k", "5 AS score", "6 AS lang_pred", "7 AS repeats")


@pytest.fixture(scope="module")
def repeated(spark, odd):
    """With a row twice and without an id."""
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    more = [(5, TEXTS[5], "de", "b", 1), (None, TEXTS[5], None, None, None), (None, None, None, None, None)]
    return docs.union(spark.createDataFrame(more, SCHEMA))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")


def roots(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingled(text, n):
    w = [x.translate(LOWER) for x in words(text)]
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}


def jaccard_groups(texts, n, percent):
    sets = {k: shingled(t, n) for k, t in texts.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {k: (len(sets[k]), r) for k, r in roots(sets, links).items()}


def test_targets_share_and_reshare():
    assert mixing.targets([100, 100, 100], [5, 2, 1], 3) == [187.5, 75.0, 37.5]
    assert mixing.targets([10, 1000, 0], [5, 2, 1], 3) == [30.0, 980.0, 0.0]
    assert mixing.targets([], [], 3) == []


def test_permutation_is_one():
    for n in (1, 2, 3, 17, 256, 1000):
        out = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 99, np.uint64))
        assert sorted(out) == list(range(n))


def test_mixing(spark, odd, repeated, none):
    assert mixing.taken_words(mixing.mix(none)).count() == 0
    for docs in (odd, repeated):
        plan = mixing.mix(docs)
        rows = mixing.taken_words(plan).collect()
        assert len(rows) == docs.count()
        by_target = {}
        for r in rows:
            assert 0 <= r["taken"] <= 3 * r["size"]
            by_target.setdefault((r["source_size"], r["target"]), []).append(r)
        total = sum(r["size"] for r in rows)
        assert total == sum(len(words(r["text"])) for r in docs.collect())
        for (_, target), own in by_target.items():
            assert abs(sum(r["taken"] for r in own) - target) <= 1
        texts = mixing.mixed_documents(docs, plan)
        assert texts.columns == docs.columns
        assert sum(len(words(r["text"])) for r in texts.collect()) == sum(r["taken"] for r in rows)
        again = mixing.taken_words(mixing.mix(docs)).collect()
        assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, rows), key=repr)


def cosine_groups(rows, threshold=0.93):
    good = {}
    for i, v, label in rows:
        x = None if v is None or label is None or any(c is None or not np.isfinite(c) for c in v) else np.array(v, float)
        if x is not None and len(x) and x.any():
            good[i] = (label, x / np.linalg.norm(x))
    links = [(a, b) for a in good for b in good if a < b and good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] >= threshold]
    comp = roots([r[0] for r in rows], links)
    return {i: (sum(i in x for x in links), comp[i], comp[i] == i) for i, _, _ in rows}


def test_embedding_dedup(spark):
    rng = np.random.default_rng(0)
    rows = []
    for k in range(300):
        base = rng.standard_normal(16)
        rows.append((4 * k, base.tolist(), k % 3))
        rows.append((4 * k + 1, (base + rng.standard_normal(16) * rng.uniform(0, 0.6)).tolist(), k % 3))
        rows.append((4 * k + 2, base.tolist(), (k + k % 2) % 3))
    rows += [(5000, None, 1), (5001, [0.0] * 16, 1), (5002, [float("nan")] * 16, 1), (5003, rows[0][1], None), (5004, [None, 1.0], 1), (5005, [], 1), (5006, [1.0], 1), (5007, [2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS rep", "2 AS copies")
    got = {r["vec_id"]: tuple(r)[1:] for r in embedding_dedup.embedding_dedup(df).collect()}
    assert got == cosine_groups(rows)
    assert embedding_dedup.embedding_dedup(df.limit(0)).count() == 0


def test_embedding_buckets_find_all(spark, monkeypatch):
    """Several tables and blocks give what one bucket gives."""
    rng = np.random.default_rng(1)
    base = rng.standard_normal((60, 32))
    rows = [(k, (base[k % 60] + rng.standard_normal(32) * 0.1).tolist(), 0) for k in range(900)]
    monkeypatch.setattr(embedding_dedup, "PER_BUCKET", 64)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 50)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: tuple(r)[1:] for r in embedding_dedup.embedding_dedup(df, recall=0.99999).collect()}
    assert got == cosine_groups(rows)


def test_token_counts(spark, repeated, none):
    from sentencepiece import SentencePieceProcessor

    path = token_counts.default_model()
    model = SentencePieceProcessor(model_file=path)
    found = token_counts.token_counts(repeated, 50).collect()
    assert len(found) == len(TEXTS) + 3
    texts = dict(enumerate(TEXTS))
    for r in found:
        if r["doc_id"] is None:
            continue
        text = texts[r["doc_id"]] or ""
        assert (r["n_bytes"], r["n_chars"], r["n_tokens"]) == (len(text.encode()), len(text), len(model.encode(text)))
        counts = token_counts.unpack(r["prefix_steps"])
        at = range(len(text) + 1) if len(text) < 200 else (0, 1, 777, 5000, len(text))
        assert all(counts[k] == len(model.encode(text[:k])) for k in at)
        assert counts[r["fit_chars"]] <= 50 and (counts[r["fit_chars"] + 1:] > 50).all()
    assert token_counts.token_counts(none, 50).count() == 0


def test_token_counts_from_the_store(spark, repeated, monkeypatch, tmp_path):
    """The query writes the counts of all prefixes and reads its columns from them."""
    monkeypatch.setattr(queries, "scratch_path", lambda spark, name: f"{tmp_path}/{name}")
    monkeypatch.setattr(queries, "table", lambda *_: repeated)
    monkeypatch.setattr(queries, "TOKEN_LIMIT", 50)
    got = queries.op3_token_counts(spark, "").select("doc_id", "n_bytes", "n_tokens", "fit_chars").collect()
    want = token_counts.token_counts(repeated, 50, keep_prefixes=False).select("doc_id", "n_bytes", "n_tokens", "fit_chars").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    store = spark.read.parquet(f"{tmp_path}/prefixes").collect()
    assert len(store) == len(got) and all(len(r["prefix_steps"]) == r["n_chars"] for r in store)


def test_fingerprints(spark, odd, repeated, none):
    assert fingerprints.fingerprints(none).count() == 0
    for docs in (odd, repeated):
        rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        want = []
        for (doc_id, text), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
            half = len(text) // 2
            changed = text[:len(text) - half] + following[:half]
            marks = [fingerprints.digest(x) for x in (text, changed, following)]
            want.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), *marks[:2], fingerprints.likeness(marks[0], marks[1]), fingerprints.likeness(marks[0], marks[2])))
        assert sorted(map(tuple, fingerprints.fingerprints(docs).collect()), key=repr) == sorted(want, key=repr)


def test_fingerprint_counts_by_parts_and_whole():
    data = LONG.encode() * 9
    assert len(data) > 1 << 20
    flat = np.frombuffer(data, np.uint8)
    total = np.zeros(fingerprints.BUCKETS, np.int64)
    for (near, far), (last, middle, first) in zip(fingerprints.PAIRS, fingerprints.CODES, strict=True):
        total += np.bincount(last[flat[far:]] + middle[flat[far - near:len(flat) - near]] + first[flat[:len(flat) - far]], minlength=fingerprints.BUCKETS)
    assert (fingerprints.bucket_counts(data) == total).all()


def units(text):
    spans = [m.span() for m in WORD.finditer(text)]
    out, now = [], []
    for i, (a, b) in enumerate(spans):
        now.append((a, b))
        if i == len(spans) - 1 or text[b - 1] in ".!?" or "\n" in text[b:spans[i + 1][0]]:
            out.append(now)
            now = []
    return out


def without_repeats(rows, least=10):
    """(n_units, n_removed, spans, text) by id; rows in order of their id."""
    seen, out = {}, {}
    for doc_id, text in rows:
        if text is None:
            out[doc_id] = (0, 0, [], None)
            continue
        own = units(text)
        repeat = []
        for unit in own:
            key = tuple(text[a:b].translate(LOWER) for a, b in unit)
            repeat.append(key in seen)
            seen.setdefault(key, doc_id)
        spans, gone, i = [], 0, 0
        while i < len(own):
            j = i
            while j < len(own) and repeat[j]:
                j += 1
            if j > i and sum(map(len, own[i:j])) >= least:
                spans.append((own[i][0][0], own[j][0][0] if j < len(own) else len(text)))
                gone += j - i
            i = max(j, i + 1)
        left, at = "", 0
        for a, b in spans:
            left, at = left + text[at:a], b
        out[doc_id] = (len(own), gone, spans, left + text[at:])
    return out


def test_substring_dedup(spark, odd, none):
    docs = [odd.select("doc_id", "text"), spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")]
    for df in docs:
        want = without_repeats(sorted((r["doc_id"], r["text"]) for r in df.collect()))
        got = {r["doc_id"]: (r["n_units"], r["n_removed"], [tuple(x) for x in r["removed"]], r["text"]) for r in substring_dedup.find_repeats(df).collect()}
        assert got == want
    assert substring_dedup.find_repeats(none).count() == 0


def test_substring_dedup_same_and_no_id(spark):
    line = "one two three four five six seven eight nine ten eleven."
    rows = [(1, line), (1, line), (2, line), (None, line), (None, f"{line}\n{line}")]
    got = sorted((r["doc_id"] or 0, r["text"]) for r in substring_dedup.find_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, line), (0, f"{line}\n"), (1, line), (1, line), (2, "")]


def without_lines(rows, least=10, letters=50):
    """The same with whole lines of any length, and sentences from that many words or code points on."""
    seen, known, out = {}, set(), {}
    for doc_id, text in rows:
        own = units(text or "")
        line = [text.count("\n", 0, u[0][0]) for u in own]
        whole = {k: tuple(w for u, at in zip(own, line, strict=True) if at == k for w in (text[a:b].translate(LOWER) for a, b in u)) for k in dict.fromkeys(line)}
        again = set()
        for k, key in whole.items():
            if key in known:
                again.add(k)
            known.add(key)
        repeat = []
        for unit in own:
            key = tuple(text[a:b].translate(LOWER) for a, b in unit)
            repeat.append(key in seen)
            seen.setdefault(key, doc_id)
        gone = [at in again for at in line]
        i = 0
        while i < len(own):
            j = i
            while j < len(own) and repeat[j]:
                j += 1
            if sum(map(len, own[i:j])) >= least or sum(b - a for u in own[i:j] for a, b in u) >= letters:
                gone[i:j] = [True] * (j - i)
            i = max(j, i + 1)
        begins = [u[0][0] for u in own] + [len(text or "")]
        lead = (text or "")[:begins[0]]
        out[doc_id] = (sum(gone), None if text is None else lead + "".join(text[begins[i]:begins[i + 1]] for i in range(len(own)) if not gone[i]))
    return out


def test_whole_lines(spark, odd, none):
    """Short lines, a line and a paragraph without ASCII words, and a short sentence that is no whole line."""
    cjk = "今日は天気がいいので散歩に行きましょう。"
    texts = [
        f"Home page\nFirst text is here.\n{cjk}\n{cjk}", "HOME  page\nYes. No.\nSecond text.", f"x\nhome page\r\n\n{cjk}\nYes. Other words.", "Yes.\nSecond text.\nyes.",
        f"{cjk * 3} a.", f"b! {cjk * 3} A.", "Yes. No.", "",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in substring_dedup.find_repeats(docs, whole_lines=True).collect()}
    assert got == {0: f"Home page\nFirst text is here.\n{cjk}\n", 1: "Yes. No.\nSecond text.", 2: "x\nYes. Other words.", 3: "Yes.\n", 4: texts[4], 5: "b! ", 6: "", 7: ""}
    files = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    for df in (docs, odd.select("doc_id", "text"), files):
        want = without_lines(sorted((r["doc_id"], r["text"]) for r in df.collect()))
        found = substring_dedup.find_repeats(df, whole_lines=True).collect()
        assert {r["doc_id"]: (r["n_removed"], r["text"]) for r in found} == want
    assert substring_dedup.find_repeats(none, whole_lines=True).count() == 0
    assert {r["doc_id"]: (r["n_removed"], r["text"]) for r in QUERIES["op5_substring_dedup"](spark, SF).collect()} == want
    found = corpus_pipeline.without_repeats(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()
    assert {r["doc_id"]: r["text"] for r in found} == {k: t for k, (n, t) in want.items() if not n or words(t)}


def viterbi(scores, penalty):
    best = scores[0].copy()
    for row in scores[1:]:
        best = np.maximum(best, best.max() - penalty) + row
    return best.max()


def test_best_path_is_best():
    rng = np.random.default_rng(2)
    for n in (1, 2, 30, 200):
        for scale in (1, 10, 40):
            scores = rng.standard_normal((n, 3)) * scale
            path = language_id.best_path(scores)
            value = scores[np.arange(n), path].sum() - language_id.PENALTY * (np.diff(path) != 0).sum()
            assert value == pytest.approx(viterbi(scores, language_id.PENALTY))


def test_language_id(spark, odd, repeated, none):
    assert language_id.language_id(none).count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.98 * len(out)
    for df in (odd, repeated):
        found = language_id.language_id(df).collect()
        assert len(found) == df.count()
        for r in found:
            text = "" if r["doc_id"] is None else TEXTS[r["doc_id"]] or ""
            letters = any(unicodedata.category(c)[0] == "L" for c in text)
            assert 0 <= r["score"] <= 1 and r["doc_id"] is None or (r["lang_pred"] in ("en", "de")) == letters and (r["lang_pred"] == "und") != letters


def test_mixed_language_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.learned(docs)
    some = {lang: next(r["text"] for r in docs.where(f"lang = '{lang}' and n_chars between 400 and 900").limit(1).collect()) for lang in ("de", "en")}
    one = language_id.predict(spark.createDataFrame([(1, f"{some['de']} {some['en']}")], "doc_id long, text string"), model).collect()[0]
    assert [x["lang"] for x in one["spans"]] == ["de", "en"]
    assert abs(one["spans"][0]["end"] - len(some["de"])) < 40


def test_scripts_narrow(spark):
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("привет мир", "ru"), ("hello world", "en"), ("γειά σου", "el")] * 4)]
    model = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    found = language_id.predict(spark.createDataFrame([(1, "дом"), (2, "house"), (3, "σπίτι")], "doc_id long, text string"), model).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in found} == {1: "ru", 2: "en", 3: "el"}


def test_url_filters(spark):
    urls = [
        None, "", "no scheme", "http://net", "http://net/", "HTTP://A.NET/x", "http://xnet/", "http://example.net/en/", "http://www.example.net/EN/", "http://www.example.net/en/x?y#z",
        "http://example.com/de", "https://m.example.com/de/1", "http://a.org/fr/", "http://a.org?/fr/", "x://y://net/", "http://evil.com/x.net/", "http://ünï.net/ü", "http://a.net:80/", "http://" + "a" * 9000 + ".net/" + "b" * 9000,
    ]

    def judge(url):
        m = re.search("://", url or "")
        rest = url[m.end():] if m else ""
        host = re.match("[^/?#]*", rest).group()
        path = re.match("[^?#]*", rest[len(host):]).group()
        host = host.translate(LOWER)
        fits = [(h + p, v) for h, p, v in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda r: len(r[0]), default=(None, "allow"))
        return host, path, rule, verdict

    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'h' AS host", "1 AS rest")
    assert {r["page_id"]: tuple(r)[1:] for r in url_filters.url_verdicts(df).collect()} == {k: judge(u) for k, u in enumerate(urls)}
    assert url_filters.url_verdicts(df.limit(0)).count() == 0


def test_url_globs_over_many_words():
    rules = [(f"h{k}.com", f"/p{k}/*x?y", "block") for k in range(40)]
    machine = url_filters.automaton(rules)
    assert machine.fits.shape[1] > 4
    canon = [b".h%d.com\xff/p%d/abcx-y/z" % (k, k) for k in range(40)] + [b".h1.com\xff/p1/xy", b".a.h2.com\xff/p2/x.y", b".ah2.com\xff/p2/x.y"]
    want = np.zeros((43, 40), bool)
    want[np.arange(40), np.arange(40)] = True
    want[41, 2] = True
    assert (url_filters.matches(machine, canon) == want).all()


def test_sentencepiece_round_trip(spark, repeated, none):
    assert sentencepiece_sampling.sample_pieces(none).count() == 0
    encoded = sentencepiece_sampling.sample_pieces(repeated).cache()
    first = {(r["doc_id"], r["text_hash"]): r["ids"] for r in encoded.collect()}
    assert encoded.count() == len(TEXTS) + 3
    for r in sentencepiece_sampling.decode_pieces(encoded).collect():
        assert r["doc_id"] is None or r["text"] == (TEXTS[r["doc_id"]] or "")
        assert r["n_pieces"] == len(r["ids"])
    again = sentencepiece_sampling.sample_pieces(repeated.repartition(7))
    assert {(r["doc_id"], r["text_hash"]): r["ids"] for r in again.collect()} == first
    other = sentencepiece_sampling.sample_pieces(repeated, seed=1)
    assert {(r["doc_id"], r["text_hash"]): r["ids"] for r in other.collect()} != first


def test_sentencepiece_shares(spark):
    """Segmentations of a word come as often as their weight says."""
    from itertools import product

    from quadrat.llm.pieces import vocabulary

    model = vocabulary(token_counts.default_model())
    word = " thats"
    weight = {}
    for cuts in product([0, 1], repeat=len(word) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
        parts = tuple(word[a:b] for a, b in zip(at, at[1:], strict=False))
        if all(p in model.ids for p in parts):
            weight[tuple(model.ids[p] for p in parts)] = np.prod([1 / (model.ranks[p] + 1) for p in parts])
    total = sum(weight.values())
    n = 40_000
    store = sentencepiece_sampling.Lattices(model, 1.0)
    raw = np.frombuffer(word.encode(), np.uint8)
    parts, _ = store.parts.sequence(raw, np.array([0, len(raw)]))
    assert len(parts) == 1
    pieces, lengths = store.sample(np.repeat(parts, n), np.arange(n, dtype=np.uint64))
    ends = np.cumsum(lengths)
    drawn = {}
    for e, k in zip(ends, lengths, strict=True):
        key = tuple(pieces[e - k:e].tolist())
        drawn[key] = drawn.get(key, 0) + 1
    assert set(drawn) <= set(weight)
    for key, w in weight.items():
        p = w / total
        assert abs(drawn.get(key, 0) - n * p) <= 6 * (n * p * (1 - p)) ** 0.5 + 1


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_ngram_join(spark, odd, none, n, percent):
    for df in (odd, spark.read.parquet(f"{SF}/documents.parquet")):
        texts = {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(df, n, percent).collect()}
        assert got == jaccard_groups(texts, n, percent)
    assert ngram_join.ngram_join(none, n, percent).count() == 0


def test_ngram_join_near_group(spark, monkeypatch):
    """Many near copies around the threshold, compared in small blocks, and chains of them."""
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(120)]
    texts = {}
    for k in range(150):
        own = list(base) if k < 100 else texts[k - 40].split()
        for at in rng.integers(0, 120, rng.integers(0, 5)):
            own[at] = f"x{rng.integers(0, 10**6)}"
        texts[k] = " ".join(own)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(df, 3, 90).collect()}
    assert got == jaccard_groups(texts, 3, 90)
    assert 1 < len({c for _, c in got.values()}) < 150


def test_ngram_join_texts_of_one_id(spark):
    """A link through any text of an id counts, whichever text is the greater."""
    a, b, c = ("w%d " * 40 % tuple(range(k, k + 40)) for k in (0, 100, 200))
    rows = [(1, a), (1, "z " + b), (2, a + "end"), (5, b), (5, c), (7, "z " + b + " x"), (9, c), (9, c), (11, "q " + c), (None, a), (12, None), (12, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["component_id"]) for r in ngram_join.ngram_join(docs, 3, 90).collect()]
    assert sorted(got, key=repr) == sorted([(k, None if k is None else k if k == 12 else 1) for k, _ in rows], key=repr)


def test_ngram_lists_that_say_the_same(spark):
    """Documents that share a passage share a list for each of its shingles: one is enough, and no other list goes."""
    lists = {10: [1, 2], 11: [1, 2], 12: [1, 2, 3], 13: [2, 3], 14: [1, 2, 3], 15: [3, 4]}
    rows = [(token, gid, 50, token + gid) for token, gids in lists.items() for gid in gids]
    kept = Kept(spark, "test")
    left = ngram_join._distinct_lists(spark.createDataFrame(rows, "token long, gid long, size int, pos int"), kept)
    assert sorted(map(tuple, left.collect())) == sorted(r for r in rows if r[0] in (10, 12, 13, 15))
    kept.clear()


def test_ngram_texts_are_dealt_once(spark, monkeypatch, tmp_path):
    """Each round of verification meets the texts where they lie, and only the result's tables stay."""
    joins = []
    verified = ngram_join.verified

    def watched(pairs, texts, kept, n, percent):
        plan = texts.join(pairs.select(pairs["b"].alias("doc_id")).hint("merge"), "doc_id")._jdf.queryExecution().executedPlan().toString()
        joins.append(plan.count("Exchange hashpartitioning"))
        return verified(pairs, texts, kept, n, percent)

    monkeypatch.setattr(ngram_join, "verified", watched)
    monkeypatch.setattr("quadrat.session.shared_folder", lambda _: str(tmp_path))
    texts = [" ".join(f"w{(k * 7) % 200 + i}" for i in range(60 + k % 3)) for k in range(80)]
    ngram_join.ngram_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, 90)
    assert joins and set(joins) == {1}
    assert not [x for x in tmp_path.glob("ngram-work-*")]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("scratch_")]


def test_ngram_near_pairs_of_all_roles(spark, monkeypatch):
    """Pairs of list entries whose sketches allow a link: those of lists of one block and of several, as a plain loop finds them."""
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "PAIRS", 8)
    rng = np.random.default_rng(5)
    marks = {k: rng.integers(0, 2, ngram_join.BUCKETS).astype(np.uint8) for k in range(30)}
    for k in range(10, 30):
        marks[k] = marks[k % 5].copy()
        marks[k][rng.integers(0, ngram_join.BUCKETS, 9)] += 1
    sizes = {k: int(marks[k].sum()) for k in marks}
    lists = {token: sorted(rng.choice(30, 2 + token % 12, replace=False).tolist()) for token in range(24)}
    rows = [(t, i, sizes[i], 0, i % 7, min(j % 7 for j in ids)) for t, ids in lists.items() for i in ids]
    df = spark.createDataFrame(rows, "token long, id long, size int, pos int, component long, low long")
    known = spark.createDataFrame([(k, bytes(m)) for k, m in marks.items()], "doc_id long, sketch binary")
    kept = Kept(spark, "test")
    want = set()
    for ids in lists.values():
        for a, b in ((a, b) for a in ids for b in ids if a < b and a % 7 != b % 7):
            away = np.abs(marks[a].astype(int) - marks[b].astype(int)).sum()
            near = away <= 10 * (sizes[a] + sizes[b]) // 190
            if near and 100 * min(sizes[a], sizes[b]) >= 90 * max(sizes[a], sizes[b]):
                want.add((a, b))
    assert want and {tuple(r) for r in ngram_join._near(df, known, 90, None, kept).collect()} == want
    some = {tuple(r) for r in ngram_join._near(df, known, 90, 1, kept).collect()}
    assert some and some <= want
    kept.clear()


def test_one_per_group(spark, repeated):
    rows = ngram_join.one_per_group(repeated).collect()
    ids = [r["doc_id"] for r in rows if r["doc_id"] is not None]
    groups = jaccard_groups(dict(enumerate(TEXTS)), 5, 80)
    assert sorted(ids) == sorted(k for k, (_, c) in groups.items() if k == c)
    assert len(rows) - len(ids) == 2


def test_token_files(spark, repeated, none, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_files.default_tokenizer())
    rows = sorted(((r["doc_id"], r["text"] or "") for r in repeated.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    token_files.write_tokens(repeated, str(tmp_path / "a"), 2)
    got = sorted(token_files.read_tokens(spark, str(tmp_path / "a")).collect(), key=lambda r: r["start"])
    start = 0
    for r, (doc_id, text) in zip(got, rows, strict=True):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4").tolist()) == (doc_id, start, ids)
        start += len(ids)
    token_files.write_tokens(none, str(tmp_path / "b"), 2)
    assert token_files.read_tokens(spark, str(tmp_path / "b")).count() == 0


def test_words_that_normalisation_changes():
    """Each code point that the tokenizer's normaliser changes, at the end of a stem and before each sign."""
    from tokenizers import Tokenizer

    path = token_files.default_tokenizer()
    tokenizer = Tokenizer.from_file(path)
    changed = [c for k in range(128, 0x110000) if not 0xD800 <= k < 0xE000 and tokenizer.normalizer.normalize_str(c := chr(k)) != c]
    words_ = [f"b{c}{sign}" for c in changed for sign in token_files.ENDING] + ["BAKIRC\u0130.", "\u0130.", "e\u0301!", "\u0958,"]
    data, offsets = shingles.text_buffer(words_)
    ids, bounds = token_files.WordIds(path).of_texts(data, offsets)
    want = tokenizer.encode_batch(words_, add_special_tokens=False)
    assert [w for w, a, b, x in zip(words_, bounds, bounds[1:], want, strict=False) if ids[a:b].tolist() != x.ids] == []


def test_block_from_checkpoint_and_checksum(spark, tmp_path, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id", "text").coalesce(1)
    monkeypatch.setattr(token_files, "shuffle_width", lambda spark: 1)
    path = str(tmp_path / "c")
    token_files.write_tokens(docs, path, 2)
    row = spark.read.parquet(f"{path}/blocks").orderBy("seq").limit(1).collect()[0]
    table = spark.read.parquet(f"{path}/frequencies").toPandas().sort_values("id")
    ids = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in sorted(token_files.read_tokens(spark, path).collect(), key=lambda r: r["start"])])
    points = len(np.frombuffer(row["points"], np.int64))
    assert points >= 1
    for k in range(points):
        assert (token_files.read_from_checkpoint(row, table, k) == ids[(k + 1) * token_files.EVERY * token_files.LANES:row["n_ids"]]).all()
    bad = spark.read.parquet(f"{path}/blocks").selectExpr("* except (crc32)", "crc32 + 1 as crc32")
    bad.write.parquet(f"{path}-bad/blocks")
    spark.read.parquet(f"{path}/frequencies").write.parquet(f"{path}-bad/frequencies")
    with pytest.raises(Exception, match="checksum"):
        token_files.read_tokens(spark, f"{path}-bad").collect()


def bpe_library(path):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})


def test_byte_bpe(spark, odd, repeated, none):
    library = bpe_library(byte_bpe.default_ranks())
    for docs in (odd, repeated, none):
        got = byte_bpe.decode(byte_bpe.encode(docs), at_once=3).collect()
        want = [(r["doc_id"], library.encode_ordinary(r["text"] or ""), r["text"] or "") for r in docs.collect()]
        assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["ids"], r["text"])) for r in got)


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_transducer_is_the_library(name, monkeypatch):
    import public_tokenizers

    rng = np.random.default_rng(8)
    path = public_tokenizers.path(name)
    library, machine = bpe_library(path), byte_bpe.Transducer(byte_bpe.read_ranks(path))
    assert all(machine.edge(k)[0] for k in rng.integers(0, 50256, 3000).tolist())
    signs = list("abstvmdelr  '  \n\t\u00a0\u3000日é🙂1٣½!.ſ\u0301ABC\x85\x0b")
    tokens = [t for x in machine.ranks if (t := x.decode("utf-8", "ignore"))]
    texts = ["".join(rng.choice(signs, rng.integers(0, 40))) for _ in range(1500)]
    texts += ["".join(rng.choice(tokens, rng.integers(0, 6))) for _ in range(1500)]
    texts += ["".join(map(chr, rng.integers(0, 0xD800, 20))) for _ in range(300)]
    texts += ["a" * 3000, "ab" * 900, " " * 700, "\n" * 600 + "x", "'s't're'", "it's  'll I'LL ''s"]
    data, offsets = shingles.text_buffer(texts)
    classes = byte_bpe.code_point_classes()
    for limit in (byte_bpe.HELD_BYTES, 1 << 16):  # the second starts anew for each part
        monkeypatch.setattr(byte_bpe, "HELD_BYTES", limit)
        for low, high in shingles.pieces(offsets, 1 << 14):
            ids, bounds = machine.encode_texts(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low], classes)
            assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [library.encode_ordinary(t) for t in texts[low:high]]


def test_unmerged_token_stands_for_a_whole_piece_only():
    ranks = {bytes([k]): k for k in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 300, b"xyz": 301, b"cd": 258, b"abcd": 310}
    library = __import__("tiktoken").Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    machine = byte_bpe.Transducer(ranks)
    pieces = ["abc", "xyz", "xyza", "xy", "abcd", "abcdx", "xyzxyz", "bcd", "abxyz", "a"]
    raw = np.frombuffer("".join(pieces).encode(), np.uint8)
    lengths = np.array([len(x) for x in pieces])
    ids, counts = machine.encode_pieces(raw, np.cumsum(lengths) - lengths, lengths)
    assert np.split(ids, np.cumsum(counts)[:-1])[0].tolist() == library.encode_ordinary("abc")
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library.encode_ordinary(x) for x in pieces]


def test_streaming_utf8():
    rng = np.random.default_rng(2)
    good = "aé日🙂\u07ff\uffff\U0010ffff z".encode()
    cases = [good, b"\xf0\x9f\x99", b"\xe0\x80\x80a", b"\xed\xa0\x80", b"\xf4\x90\x80\x80", b"\xc3", b"\x80\x80"] + [bytes(rng.integers(0x70, 0x100, 9).tolist()) for _ in range(400)]
    for raw in cases:
        for step in (1, 2, 3, 5):
            stream = byte_bpe.Utf8Stream()
            assert "".join([*[stream.feed(raw[k:k + step]) for k in range(0, len(raw), step)], stream.close()]) == raw.decode("utf-8", "replace")


TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def audit(rows, least, top):
    """By dictionaries, one term and group at a time."""
    groups, count, seen = {}, {}, {}
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.setdefault(lang, set()).add(source)
        found = [t.translate(LOWER) for t in TERM.findall(text or "")]
        for t in found:
            count[lang, source, t] = count.get((lang, source, t), 0) + 1
        for t in set(found):
            seen[lang, t] = seen.get((lang, t), 0) + 1
    out = []
    for lang, sources in groups.items():
        kept = [t for (x, t), n in seen.items() if x == lang and n >= least]
        n = {s: {t: count.get((lang, s, t), 0) for t in kept} for s in sources}
        total = {t: sum(n[s][t] for s in sources) for t in kept}
        share = lambda c: {t: 1 + 10**9 * (k + 5) // (sum(c.values()) + 5 * len(kept)) for t, k in c.items()}
        p, q = {s: share(n[s]) for s in sources}, share(total)
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(q[t] - p[s][t], t.encode(), t) for t in kept if n[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                out += [(lang, s, part, item, -v, k) for k, (v, _, item) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


def test_source_audit(spark, odd, repeated, none, monkeypatch):
    long = ["x" * k + "é" * (k % 3) for k in (7, 8, 9, 15, 16, 17, 31, 32, 33, 64, 65, 5000)]
    extra = [(100 + k, " ".join(long[k % 5:] * 2) + " Ab aB ÀB àb a1b", ["fr", "", None][k % 3], ["s", "t", "ü"][k % 2 + k % 3 // 2], 0) for k in range(12)]
    docs = repeated.union(spark.createDataFrame(extra, SCHEMA))
    for frame, least in ((docs, 1), (docs, 2), (docs, 50), (odd, 2), (none, 1)):
        for cells in (source_audit.CELLS, 8):
            monkeypatch.setattr(source_audit, "CELLS", cells)
            got = source_audit.source_audit(frame, least, top=5).collect()
            want = audit([(r["text"], r["lang"], r["source"]) for r in frame.collect()], least, 5)
            assert sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in got) == want


def test_share_is_exact_for_large_counts():
    count, total = np.array([9 * 10**14, 123456789012345, 0]), np.array([10**15, 10**15 + 7, 5])
    assert source_audit.share(count, total, 40_000, 5).tolist() == [1 + 10**9 * (int(c) + 5) // (int(t) + 200_000) for c, t in zip(count, total, strict=True)]


def fim(doc_id, text):
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k:8 * k + 8], 16) for k in range(4))
    i, j = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    p, m, s = ("".join(x) for x in (tokens[:i], tokens[i:j], tokens[j:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, len(tokens), "plain", None, None, text
    if h4 % 100 < 20:
        return doc_id, len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark, odd, repeated, none):
    rng = np.random.default_rng(4)
    signs = list("abYZz @[`{é日🙂\u0301\x00\n.12<SPM>")
    made = [(1000 + k, "".join(rng.choice(signs, rng.integers(0, 40))), None, None, None) for k in range(400)]
    made += [(2000, "<P> x", None, None, None), (2001, "x <S", None, None, None), (2002, "<<S>", None, None, None), (2003, "<P<S<M", None, None, None)]
    for docs in (odd, repeated, none, spark.createDataFrame(made, SCHEMA)):
        found = fill_in_middle.fill_in_middle(docs)
        got = found.withColumn("back", fill_in_middle.restored()).collect()
        columns = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
        assert sorted(repr(tuple(r[c] for c in columns)) for r in got) == sorted(repr(fim(r["doc_id"], r["text"] or "")) for r in docs.collect())
        assert sorted(r["back"] for r in got) == sorted(r["text"] or "" for r in docs.collect())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd_rows = spark.createDataFrame([(10**6 + k, t, None, None, None) for k, t in enumerate(TEXTS)], docs.schema)
    docs = docs.union(odd_rows).cache()
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF).cache()
        rows = {r["doc_id"]: r for r in before.collect()}
        found = after.collect()
        if name != "sentencepiece":
            assert after.columns == docs.columns
        if name == "language_id":
            gone = set(rows) - {r["doc_id"] for r in found}
            assert gone and all(not language_id.has_letter(rows[k]["text"] or "") or k >= 10**6 for k in gone)
        if name == "ngram_join":
            groups = jaccard_groups({k: r["text"] for k, r in rows.items()}, 5, 80)
            assert {r["doc_id"] for r in found} == {k for k, (_, c) in groups.items() if k == c}
        if name == "substring_dedup":
            want = without_lines(sorted((k, r["text"]) for k, r in rows.items()))
            assert {r["doc_id"]: r["text"] for r in found} == {k: t for k, (n, t) in want.items() if not n or words(t)}
            assert all(r["n_chars"] == len(r["text"]) for r in found if r["doc_id"] < 10**6)
        if name == "mixing":
            plan = mixing.taken_words(mixing.mix(before)).collect()
            assert sum(len(words(r["text"])) for r in found) == sum(r["taken"] for r in plan)
        if name == "sentencepiece":
            assert len(found) == before.count()
            assert all(r["n_pieces"] == len(r["ids"]) > 0 for r in found)
        before = after


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(ORACLE[name])
    got = QUERIES[name](spark, SF)
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    clean = lambda rows: sorted(map(repr, rows))
    assert clean(tuple(r) for r in got.select(*columns).collect()) == clean(want.select(*columns).fetchall())


def test_registered():
    names = list(entry.queries())
    assert all(any(x.startswith(f"op{n}_") for x in names) for n in range(1, 14)) and "pipeline" in names
    assert "quadrat.llm.queries" in sys.modules


def test_ascii_words_need_the_model_only():
    path = token_files.default_tokenizer()
    words = token_files.WordIds(path)
    want = [words.tokenizer.encode(x, add_special_tokens=False).ids for x in ("Unwontedly", "plain", "s", "don't", "élan", "x2,")]

    class Watched:
        def __init__(self, inner):
            self.inner, self.seen = inner, []

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def encode_batch_fast(self, texts, **kw):
            self.seen += texts
            return self.inner.encode_batch(texts, **kw)

    words.tokenizer = Watched(words.tokenizer)
    ids, bounds = words.of_texts(*shingles.text_buffer(["Unwontedly", "plain", "s", "don't", "élan", "x2,"]))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == want
    assert sorted(words.tokenizer.seen) == ["don't", "x2,", "élan"]


def test_small_pieces_give_the_same(spark, monkeypatch):
    """Memory of a worker follows these sizes, results don't."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")

    def found():
        yield sorted(tuple(r) for r in byte_bpe.encode(docs).selectExpr("doc_id", "sha2(array_join(ids, ' '), 256)").collect())
        yield sorted(tuple(r) for r in ngram_join.ngram_join(docs).collect())
        yield sorted(tuple(r) for r in language_id.language_id(docs).select("doc_id", "lang_pred").collect())

    whole = list(found())
    for module, name in ((byte_bpe, "AT_ONCE"), (language_id, "AT_ONCE"), (ngram_join, "VERIFIED")):
        monkeypatch.setattr(module, name, 1 if name == "VERIFIED" else 1 << 12)
    assert list(found()) == whole
