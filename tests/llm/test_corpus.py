"""Corpus operators against brute force, library results and round trips, with the awkward rows of every table."""

import hashlib
import math
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from datetime import date, timedelta
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldspark.llm import bpe, decontaminate, jaccard, licences, mixing, pii, quality, shards, tokencount, toxicity
from fieldspark.llm.queries import ORACLES, QUERIES, tokenizer
from fieldspark.session import shared_dir

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, shard int, text_hash long, n string"


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ))


def sentences(seed, n, vocabulary=400, length=(20, 120)):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéghilmnoprstuñ") for _ in range(rng.randint(1, 9))) for _ in range(vocabulary)]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(*length))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    """Texts with copies, near copies, nulls, empty and long ones, repeated rows and clashing further columns."""
    rng = random.Random(4)
    texts = sentences(1, 60)
    near = texts[0].split()
    for k in range(25):
        copy = list(near)
        copy[rng.randrange(len(copy))] = f"new{k}"
        texts.append(" ".join(copy))
    texts += [texts[3]] * 12 + [None, "", "   \n\t", "word", "two words", "Word", "!!! ??? 1 2", " ".join(sentences(2, 60)), "x" * 30000, "é́ <|endoftext|> don't STOP 'll"]
    out = [(k, t, ["en", "de", None][k % 3], f"s{k % 2}", 7, 8, "n") for k, t in enumerate(texts)]
    return out + [(None, texts[5], "en", "s0", 1, 1, None), (7, texts[7], "en", "s0", 1, 1, None), (7, texts[7], "en", "s0", 1, 1, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def key(r):
    return (r[0] is None, r[0] or 0)


# 1 licences

def brute_matches(words, template):
    """Longest common subsequence of a template and a text that is not much longer than it."""
    t = licences_words(template)
    table = np.zeros((len(words) + 1, len(t) + 1), int)
    for i, a in enumerate(words):
        for j, b in enumerate(t):
            table[i + 1, j + 1] = table[i, j] + 1 if a == b else max(table[i, j + 1], table[i + 1, j])
    return int(table[-1, -1]), len(t)


def licences_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(AZ))


def test_licences_exact_and_edited(spark, none):
    t = licences.TEMPLATES
    long = t["MIT-grant"]
    edited = long.replace("without restriction, including ", "").replace("publish", "print")
    data = [(1, "start " + t["GPL-3.0"] + ". And more."), (2, "intro words here\n" + edited + " end"), (3, "nothing of the kind here at all"), (4, None), (5, ""),
            (6, t["Apache-2.0-header"] + "\n" + "filler " * 500 + t["MIT"]), (6, t["Apache-2.0-header"])]
    got = licences.scan(spark.createDataFrame(data, "doc_id long, text string")).collect()
    by = {(r.doc_id, r.template): r for r in got}
    assert by[(1, "GPL-3.0")].coverage == 1.0 and by[(1, "GPL-3.0")].first_word == 1
    r = by[(2, "MIT-grant")]
    want, n = brute_matches(licences_words(data[1][1]), long)
    assert (r.n_matched, r.n_template) == (want, n) and r.coverage >= 0.9 and r.matched_text.startswith("Permission") and r.matched_text.endswith("do so")
    assert (6, "MIT") in by and (6, "Apache-2.0") not in by and not [r for r in got if r.doc_id in (3, 4, 5)]
    assert licences.scan(none).count() == 0


def test_every_notice_is_found_bare_and_edited(spark, none):
    """Against brute force: each template, alone and within other words, and short ones with any one word changed."""
    data, want = [], {}
    for name, body in licences.TEMPLATES.items():
        words = licences_words(body)
        forms = [words]
        if len(words) <= licences.SHORT:
            forms += [words[:k] + ["zzyzx"] + words[k + 1:] for k in range(len(words))]
        for form in forms:
            if brute_matches(form, body)[0] >= licences.COVERAGE * len(words) if len(words) < 100 else True:
                for text in (" ".join(form), "some words before " + " ".join(form) + " and some behind"):
                    data.append((len(data), text))
                    want[len(data) - 1] = (name, brute_matches(form, body)[0] if len(words) < 100 else len(words))
    got = {}
    for r in licences.scan(spark.createDataFrame(data, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append((r.template, r.n_matched))
    lost = [(want[k], data[k][1][:80], got.get(k)) for k in want if want[k] not in got.get(k, []) and not any(n >= want[k][1] for _, n in got.get(k, []))]
    assert not lost, lost[:5]
    assert got[len(data) - 1] and {"all-rights-bare", "MPL-2.0-text", "CC0-1.0-text", "Unlicense-text", "LGPL-3-text", "BSD-text"} <= {t for x in got.values() for t, _ in x}


def test_alignment_in_a_full_band_is_the_longest_common_subsequence():
    rng = np.random.default_rng(2)
    for _ in range(60):
        text, template = rng.integers(0, 6, rng.integers(1, 30)), rng.integers(0, 6, rng.integers(1, 15))
        n = len(template)
        m, a, b = licences.align(text, template, np.full(n, 0), np.full(n, len(text)))
        table = np.zeros((len(text) + 1, n + 1), int)
        for i, j in np.ndindex(len(text), n):
            table[i + 1, j + 1] = table[i, j] + 1 if text[i] == template[j] else max(table[i, j + 1], table[i + 1, j])
        assert m == table[-1, -1]
        spans = [(y - x, x, y) for x in range(len(text)) for y in range(x, len(text) + 1) if lcs(text[x:y], template) == m] if m else [(0, 0, 0)]
        assert b - a == min(spans)[0] and lcs(text[a:b], template) == m


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = _lcs_row(row, x, b)
    return row[-1]


def _lcs_row(row, x, b):
    out = [0]
    for k, y in enumerate(b):
        out.append(row[k] + 1 if x == y else max(row[k + 1], out[-1]))
    return out


def test_whole_licences_with_passages_and_twice(spark):
    """A passage put in, one left out, the text twice, and each whole licence in little time."""
    import time

    t, data = licences.TEMPLATES, []
    whole = [n for n in t if n.endswith("-text")]
    for name in whole:
        w = t[name].split()
        put = " ".join(w[:len(w) // 2] + [f"own{k}" for k in range(40)] + w[len(w) // 2:])
        out = " ".join(w[:len(w) // 3] + w[len(w) // 3 + len(w) // 10:])
        data += [(name, 0, t[name]), (name, 1, put), (name, 2, "before " + out + " behind"), (name, 3, t[name] + " between " + t[name])]
    docs = spark.createDataFrame([(k, d[2], 1, None) for k, d in enumerate(data)], "doc_id long, text string, template int, coverage string").coalesce(1)
    began = time.time()
    got = [r for r in licences.scan(docs).collect()]
    assert (time.time() - began) / len(data) < 1.0
    for k, (name, kind, text) in enumerate(data):
        mine = [r for r in got if r.doc_id == k and r.template == name]
        n = len(licences_words(t[name]))
        assert len(mine) == (2 if kind == 3 else 1), (name, kind, [(r.template, r.n_matched) for r in got if r.doc_id == k])
        if kind != 2:
            assert all(r.n_matched == n for r in mine), (name, kind)
        else:
            assert mine[0].coverage > 0.85


# 2 decontamination

def brute_decontamination(rows, tests, window=13):
    out = []
    for r in rows:
        w = licences_words(r[1] or "")
        hit, items = set(), set()
        for item, text in tests:
            if item is None or text is None:
                continue
            t = licences_words(text)
            n = min(window, len(t))
            for s in range(len(t) - n + 1) if t else ():
                for p in range(len(w) - n + 1):
                    if w[p:p + n] == t[s:s + n]:
                        hit |= set(range(p, p + n))
                        items.add(str(item))
        out.append((r[0], len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=lambda r: (*key(r), r[1:]))


def test_decontamination(spark, rows, docs, none, monkeypatch):
    w = rows[1][1].split()
    tests = [(1, " ".join(w[2:20])), (12, "unseen " * 20), (3, "two words"), (None, rows[2][1]), (4, None), (5, ""), (1, rows[60][1]), (9, "... Word!")]
    frame = spark.createDataFrame(tests, "item_id int, text string")
    got = decontaminate.digest(decontaminate.decontaminate(docs, frame)).drop("n_near_items").collect()
    assert sorted(map(tuple, got), key=lambda r: (*key(r), r[1:])) == brute_decontamination(rows, tests)
    monkeypatch.setattr(decontaminate, "TEST_BYTES", 300)  # a full index, searched in blocks of tests
    again = decontaminate.digest(decontaminate.decontaminate(docs, frame)).drop("n_near_items").collect()
    assert sorted(map(tuple, again), key=lambda r: (*key(r), r[1:])) == brute_decontamination(rows, tests)
    assert decontaminate.decontaminate(none, frame).count() == 0
    assert decontaminate.digest(decontaminate.decontaminate(docs, frame.where("false"))).agg(F.sum("n_items")).first()[0] == 0


def test_proximity(spark):
    a = "alpha beta gamma delta".split()
    texts = [(1, "alpha x beta y gamma z delta"), (2, "delta gamma beta alpha"), (3, "alpha " + "far " * 40 + "beta gamma delta"), (4, "alpha beta gamma")]
    found = decontaminate.decontaminate(spark.createDataFrame(texts, "doc_id int, text string"), spark.createDataFrame([("t", " ".join(a))], "item_id string, text string"))
    assert {r.doc_id: r.near_items for r in found.collect()} == {1: ["t"], 2: ["t"], 3: [], 4: []}


# 3 quality

def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    grams = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {p for i in range(len(words) - 7) if grams[tuple(words[i:i + 8])] > 1 for p in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality_counts(docs, rows, spark):
    extra = [(900, "a b\na b\n\n \na b\r\n c|d #é", "en", "s", 0, 0, ""), (901, "one two three four five six seven eight nine " * 4, "en", "s", 0, 0, "")]
    frame = docs.union(spark.createDataFrame(extra, SCHEMA))
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.statistics(frame).collect()}
    assert got == {(r[0], *brute_counts(r[1])) for r in rows + extra}


def test_quality_rejects_symbols_and_keeps_prose(spark, none):
    texts = sentences(9, 300, length=(60, 120))
    junk = [" ".join(x + "###" for x in t.split()) for t in sentences(10, 12, length=(60, 120))]
    frame = spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(texts + junk)] + [(990, None, None, None), (991, "", "en", "s")], "doc_id int, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality.digest(quality.quality(frame)).collect()}
    assert all(kept[k] for k in range(300)) and not any(kept[k] for k in range(300, 312)) and not kept[990] and not kept[991]
    assert quality.quality(none).count() == 0


def test_concentration_finds_the_clean_part(spark):
    rng = np.random.default_rng(5)
    clean, bad = rng.normal(0, 1, (800, quality.P)), rng.normal(9, 0.3, (150, quality.P))
    x = np.concatenate([clean, bad])
    frame = spark.createDataFrame([("g", *map(float, r)) for r in x], "grp string, " + ", ".join(f"{c} double" for c in quality.X))
    got = quality.estimates(frame).first()
    assert np.abs(np.array(got["m"]) - clean.mean(0)).max() < 0.15


# 4 and 7 tokens

def test_transducer_matches_the_library(docs, rows, none):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    want = []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = bpe.encoded(docs, path, keep=False).collect()
    assert sorted(map(tuple, got), key=lambda r: (*key(r), r[1:])) == sorted(want, key=lambda r: (*key(r), r[1:]))
    assert bpe.encoded(none, path).count() == 0


def test_streamed_slices_and_round_trip():
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    library, merges, rng = Tokenizer.from_file(path), bpe.Merges(path), random.Random(8)
    bits = ["a", "sing", "'ll", "'", " ", "\n", "1", "²", "!!", "é", "Σ", "İ", "́", "한", "ᆨ", "国", "There"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 80))) for _ in range(150)] + ["ab" * 4000, "é" * 3000, "!" * 5000]
    for text in texts:
        coder, ids, at = bpe.Encoder(merges, hold=rng.choice([8, 64, 300])), [], 0
        while at < len(text):
            n = rng.randint(1, 400)
            ids += coder.feed(text[at:at + n])
            at += n
        ids += coder.finish()
        assert ids == library.encode(text, add_special_tokens=False).ids
    plain = "an ordinary line of words, with marks: ñandú and été!"
    decoder = bpe.Decoder(merges)
    ids = library.encode(plain, add_special_tokens=False).ids
    out = "".join(decoder.feed([i]) for i in ids) + decoder.finish()
    assert out.split() == re.findall(r"\w+|[^\w\s]+", plain)


def test_lookahead_is_sufficient():
    merges, rng = bpe.Merges(tokenizer("word_bpe_49k.json")), random.Random(2)
    for _ in range(60):
        text = "".join(rng.choice("etaoinshr") for _ in range(900)).encode()
        first, other = (merges.encode_bytes([text + bytes(rng.choice(b"abcxyz") for _ in range(50))])[0].tolist() for _ in range(2))
        end = same = 0
        for x, y in zip(first, other):
            if x != y:
                break
            same += merges.bytes[x]
        assert same >= len(text) - merges.lookahead, (same, end)


@pytest.mark.parametrize("chunk, overlap", [(16384, 64), (40, 3), (17, 1)])
def test_token_counts(rows, chunk, overlap):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [r[1] or "" for r in rows] + ["a" * 700, "\n" * 100, "x y" * 300, "<|endoftext|>" * 3 + " a"]
    want = [len(e) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert tokencount.count_texts(tokencount.Counter(path), texts, chunk, overlap).tolist() == want


def test_token_count_query(docs, rows, none):
    path = tokenizer("byte_bpe_50k.json")
    got = tokencount.token_counts(docs, path).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes) for r in got) == sorted((r[0] is None, r[0] or 0, len((r[1] or "").encode())) for r in rows)
    assert tokencount.token_counts(none, path).count() == 0


def test_tasks_of_a_process_share_a_tokenizer(docs, monkeypatch):
    """A worker process runs many tasks one after the other; a tokenizer for each would pile up in its memory."""
    runs, made = [], []

    class Counted(tokencount.Counter):
        def __init__(self, path):
            made.append(path)
            super().__init__(path)

    monkeypatch.setattr(tokencount, "Counter", Counted)
    monkeypatch.setattr(tokencount, "tidy", lambda run: runs.append(run) or run)
    tokencount.token_counts(docs, tokenizer("byte_bpe_50k.json"))
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2]), "text": ["one text", None], "n_bytes": pa.array([8, 0])})
    got = [out.column(2).to_pylist() for _ in range(3) for out in runs[0]([batch])]
    assert got == [got[0]] * 3 and got[0][1] == 0
    assert len(made) <= 1


# 5 shards

def test_shards(spark, rows, docs, none):
    got = shards.sharded(docs, shards=4)
    assert got.columns == [*(c for c in docs.columns if c not in ("size", "shard", "slot")), "size", "shard", "slot"]
    by = {}
    for r in got.collect():
        assert r["size"] == len((r["text"] or "").encode()) + 16
        by.setdefault(r["shard"], []).append(r["slot"])
    assert sum(map(len, by.values())) == len(rows) and all(sorted(x) == list(range(len(x))) for x in by.values())
    assert shards.sharded(none).count() == 0


def test_shards_are_even_and_split_a_giant_group(spark):
    texts = sentences(3, 3000, length=(10, 60)) + ["the same text again"] * 3000
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = shards.digest(frame, shards=10).toPandas()
    size = got.groupby("shard")["size"].sum()
    assert len(size) == 10 and size.max() - size.min() < 0.06 * size.mean()
    assert (got["text_crc32"].sum() == sum(zlib.crc32(t.encode()) for t in texts))
    few = got[got.text_crc32 != zlib.crc32(b"the same text again")]
    assert (few.groupby("text_crc32")["shard"].nunique() == 1).mean() > 0.99


# 6 toxicity

def toxic_corpus(seed, n):
    rng = random.Random(seed)
    texts = sentences(seed, n, length=(30, 90))
    labels = []
    for k in range(n):
        bad = k % 10 == 0
        if bad:
            words = texts[k].split()
            for _ in range(5):
                words.insert(rng.randrange(len(words)), rng.choice("idiot moron scum pathetic zorblax".split()))
            texts[k] = " ".join(words)
        labels.append((k, int(bad) if rng.random() > 0.03 else int(not bad)))
    return texts, labels


def test_toxicity(spark):
    texts, labels = toxic_corpus(6, 1500)
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(2000, None), (2001, ""), (None, "plain words here")], "doc_id long, text string")
    got = toxicity.digest(toxicity.toxicity(frame, spark.createDataFrame(labels, "doc_id long, toxic int"), ~toxicity.held_out())).toPandas()
    assert len(got) == 1503 and got["score"].between(0, 1).all()
    held = got[got.held_out & (got.doc_id < 1500)]
    assert set(held.doc_id) == {k for k in range(1500) if zlib.crc32(str(k).encode()) % 5 == 0}
    truth = held.doc_id % 10 == 0
    assert ((held.predicted == 1) == truth).mean() > 0.98
    kept = toxicity.without_toxic(frame, spark.createDataFrame(labels, "doc_id long, toxic int"), ~toxicity.held_out())
    assert kept.columns == frame.columns and kept.count() == int((got.predicted == 0).sum())


def test_toxicity_ignores_held_out_labels(spark):
    texts, labels = toxic_corpus(7, 400)
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    flipped = [(k, 1 - t) if zlib.crc32(str(k).encode()) % 5 == 0 else (k, t) for k, t in labels]
    one, two = (toxicity.toxicity(frame, spark.createDataFrame(x, "doc_id long, toxic int"), ~toxicity.held_out()).orderBy("doc_id").toPandas() for x in (labels, flipped))
    assert np.allclose(one["score"], two["score"])


def test_every_training_label_is_mined(spark, monkeypatch):
    """All labelled training rows are counted, however many there are."""
    n, seen = 45_000, []
    frame = spark.range(n).selectExpr("id AS doc_id", "concat('plain text number ', id) AS text")
    labels = spark.range(n).selectExpr("id AS doc_id", "0 AS toxic")
    monkeypatch.setattr(toxicity, "mined_words", lambda labelled: (seen.append(labelled.count()), (([], []), []))[1])
    toxicity.fitted(frame, labels, ~toxicity.held_out())
    assert seen == [frame.where(~toxicity.held_out()).count()]


def test_toxicity_without_labels_or_rows(spark, docs, none):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity(none, empty, ~toxicity.held_out()).count() == 0
    assert toxicity.toxicity(docs, empty, ~toxicity.held_out()).where("predicted = 1").count() == 0


def test_label_model_finds_rates_and_links():
    """Planted one-sided voters that abstain, two of them copies: rates, correlation and classes come back."""
    rng = np.random.default_rng(1)
    y = rng.random(60000) < 0.1
    hit, false = np.linspace(0.2, 0.8, 8), np.linspace(0.05, 0.01, 8)
    votes = np.stack([rng.random(len(y)) < np.where(y, h, f) for h, f in zip(hit, false)], 1).astype(np.int8)
    votes[:, 1] = votes[:, 0]
    votes = np.hstack([votes, -(rng.random(len(y)) < np.where(y, 0.1, 0.7)).astype(np.int8)[:, None]])
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = toxicity.LabelModel(patterns, counts.astype(float), 0.1)
    assert model.rested and model.correlation[0, 1] > 0.9 and model.correlation[2:8, 2:8].max() < 0.2
    want = np.r_[hit[:1], hit[:1], hit[2:]]
    assert np.abs(model.rates[1, :8, 2] - want).max() < 0.08 and np.abs(model.rates[0, 2:8, 2] - false[2:]).max() < 0.02
    assert abs(model.rates[0, 8, 0] - 0.7) < 0.02 and abs(model.rates[1, 8, 0] - 0.1) < 0.06
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.96


def test_label_model_on_the_real_voters(spark):
    """Precisions differ between voters and rank as the labels say that were not read."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    voters, model, _ = toxicity.fitted(docs, labels, ~toxicity.held_out())
    rows = docs.join(labels, "doc_id").where(toxicity.held_out()).select("text", "toxic").collect()
    truth = np.array([r.toxic for r in rows])
    votes = np.concatenate([voters.votes(w, s) for _, _, w, s in toxicity._slices(pa.array([r.text for r in rows]))])
    used = [k for k in range(toxicity.M) if (votes[:, k] == 1).sum() >= 3]
    assert np.ptp(model.rates[1, used, 2]) > 0.05
    got = model.posterior(votes)
    assert ((got > 0.5) == truth).mean() > 0.95 and got[truth == 1].mean() > got[truth == 0].mean() + 0.5
    hit = np.array([(votes[truth == 1, k] == 1).mean() for k in used])
    assert np.corrcoef(hit, model.rates[1, used, 2])[0, 1] > 0.7


def test_labels_of_equal_texts_all_count(spark):
    frame = spark.createDataFrame([(k, "same words in all of these", "x") for k in range(40)] + [(100 + k, "other text", "x") for k in range(5)], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(7, None), (None, 1)], "doc_id long, toxic int")
    seen = []
    real = toxicity.mined_words
    try:
        toxicity.mined_words = lambda labelled: (seen.extend(labelled.groupBy("toxic").count().collect()), real(labelled))[1]
        one = toxicity.digest(toxicity.toxicity(frame, labels, ~toxicity.held_out())).collect()
    finally:
        toxicity.mined_words = real
    learn = [k for k in range(40) if zlib.crc32(str(k).encode()) % 5]
    assert {r["toxic"]: r["count"] for r in seen} == Counter(k % 2 for k in learn)
    assert len({r.score for r in one if r.doc_id < 100}) == 1


# 8 pseudonyms

def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return (sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def with_check(body):
    return next(body + c for c in "0123456789" if luhn(body + c))


def test_pseudonyms(spark, none):
    rng = random.Random(3)
    cards = [with_check("".join(rng.choice("0123456789") for _ in range(15))) for _ in range(300)]
    days = [date(1800, 1, 1) + timedelta(days=rng.randrange(146097)) for _ in range(300)]
    data = [(k, f"card {c}, day {d:%Y-%m-%d} or {d:%d/%m/%Y}; {c[:4]}-{c[4:8]}-{c[8:12]}-{c[12:]}") for k, (c, d) in enumerate(zip(cards, days))]
    fixed = ["4111111111111112", "2023-02-29 31.04.2001", "300.1.1.1", "000-12-3456 666-12-1234", "plain", "", None, "1.2.3.4.5"]
    data += [(1000 + k, t) for k, t in enumerate(fixed)] + [(2000, "a.b9@mail.example.com"), (2001, "+1 (212) 555-0123"), (2002, "(212) 555-0123"), (2003, 'token = "' + "0a" * 20 + '"')]
    frame = spark.createDataFrame(data, "doc_id long, text string").withColumn("pii", F.lit(1)).withColumn("n", F.lit(2))
    out = {r.doc_id: r.text for r in pii.digest(frame, "key").collect()}
    assert len(out) == len(data)
    new_cards, new_days = [], []
    for k in range(300):
        m = re.fullmatch(r"card (\d{16}), day (\d{4}-\d\d-\d\d) or (\d\d)/(\d\d)/(\d{4}); (\d{4})-(\d{4})-(\d{4})-(\d{4})", out[k])
        assert luhn(m[1]) and m[1] != cards[k] and "".join(m.groups()[5:]) == m[1]
        d = date.fromisoformat(m[2])
        assert (d.day, d.month, d.year) == (int(m[3]), int(m[4]), int(m[5])) or int(m[3]) > 12 or days[k].day <= 12
        new_cards.append(m[1])
        new_days.append(m[2])
    assert len(set(new_cards)) == len(set(cards)) and len(set(new_days)) == len(set(days))
    assert [out[1000 + k] for k in range(len(fixed))] == fixed
    assert re.fullmatch(r"[a-z]\.[a-z]\d@mail\.example\.com", out[2000]) and out[2000] != "a.b9@mail.example.com"
    assert out[2001][3:] == out[2002] and out[2001].startswith("+1 (") and out[2002] != "(212) 555-0123"
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', out[2003]) and out[2003] != data[-1][1]
    assert pii.digest(frame, "other").where("doc_id = 0").first().text != out[0] and pii.digest(none, "key").count() == 0


def test_feistel_is_a_permutation_of_small_domains(spark):
    """All octet pairs of a narrow net, and all days of some years, keep apart."""
    data = [(k, f"10.1.{k // 16}.{k % 16}") for k in range(256)]
    out = {r.text for r in pii.digest(spark.createDataFrame(data, "doc_id long, text string"), "k").collect()}
    assert len(out) == 256


# 9 scores

def test_scores(spark, rows, docs, none):
    got = mixing.digest(mixing.scores(docs, ~mixing.held_out())).collect()
    counts = Counter()
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2
    for r in rows:
        if not held(r[0]):
            counts.update([*blank_words(r[1]), "\n"])
    n, v = sum(counts.values()), len(counts)
    want = []
    for r in rows:
        tokens = [*blank_words(r[1]), "\n"]
        want.append((r[0], held(r[0]), len(tokens), sum(counts[t] > 0 for t in tokens), n, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens)))
    order = lambda r: (*key(r), r[2], r[5])
    for a, b in zip(sorted(map(tuple, got), key=order), sorted(want, key=order), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 * max(1, abs(b[5])) and a[6] < 0
    assert mixing.scores(none, ~mixing.held_out()).count() == 0


def test_mixing_beats_fixed_coding(spark):
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(sentences(12, 600))], "doc_id long, text string")
    got = mixing.digest(mixing.scores(frame, ~mixing.held_out())).where("held_out").toPandas()
    assert got["bits_per_byte"].mean() < 3.0 and got["score"].sum() > 1.3 * got["base_score"].sum()


def test_context_counts_are_exact_and_grow(spark, monkeypatch):
    """Every (context, node) has the count of its own bits in all training texts, over many blocks and ranges."""
    monkeypatch.setattr(mixing, "BLOCK_BYTES", 3000)
    texts = sentences(13, 60)
    frame = spark.createDataFrame([(k, k % 3 > 0, t) for k, t in enumerate(texts)], "doc long, learn boolean, text string").repartition(3)
    blocks = mixing.text_blocks(frame, 50)
    values = mixing.path_values(blocks.where("range IS NOT NULL")).collect()

    def steps(t):
        data = "\n".join([" ".join(blank_words(t)), ""]).encode()
        for i, b in enumerate(data):
            back = bytes(4) + data[:i]
            word = data[:i].split(b" ")[-1]
            for d in range(int(mixing.LENGTH[b])):
                node = int(mixing.NODE[mixing.PLACE[b] + d])
                yield [(k, c, node) for k, c in enumerate((back[-1:], back[-2:], back[-4:], word))], int(mixing.BIT[mixing.PLACE[b] + d])

    counts = defaultdict(lambda: [0, 0])
    for k, t in enumerate(texts):
        if k % 3 > 0:
            for slots, bit in steps(t):
                for s in slots:
                    counts[s][bit] += 1
    seen = 0
    for name in {r.block for r in blocks.select("block").collect()}:
        rows = blocks.where(f"range IS NULL AND block = {name}").collect()
        _, text, first, length = mixing.block_texts(pa.array([r.words for r in rows], pa.binary()))
        known = mixing.Known(text, [(r.range, r.n, r["values"]) for r in values if r.block == name])
        at = np.flatnonzero(text)
        got = known(text, at, *mixing._paths(text[at]))
        want = [[math.log((counts[s][1] + mixing.PRIOR) / (counts[s][0] + mixing.PRIOR)) for s in slots] for r in rows for slots, _ in steps(texts[r.doc])]
        assert np.abs(got - np.array(want)).max() < 0.01
        seen += len(rows)
    assert seen == len(texts) and mixing.PREDICTORS == 4


def test_scores_write_texts_and_counts_once(spark):
    """The lists that are exchanged are not written, and what is written stays below the texts' bytes."""
    root = Path(shared_dir(spark))
    texts = sentences(21, 4000)
    before = set(root.iterdir())
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert mixing.scores(frame, ~mixing.held_out()).count() == len(texts)
    made = sum(f.stat().st_size for d in set(root.iterdir()) - before for f in d.rglob("*.parquet"))
    assert made < 0.8 * sum(len(t.encode()) for t in texts)


def test_weights_move_from_the_first_bytes_to_the_last():
    """Predictors that are always wrong cost less and less, in short texts and behind any length."""
    text = np.r_[np.zeros(mixing.PAD, np.uint8), np.random.default_rng(3).choice(np.frombuffer(b"etaoin shr", np.uint8), 400_000)]
    weights = np.full((mixing.GATES, mixing.PREDICTORS), 0.4)

    def cost(n, turn=1 << 60):
        def look(t, at, of, depth):
            right = 2 * mixing.BIT[mixing.PLACE[t[at]][of] + depth].astype(np.float32) - 1
            return np.repeat(np.where(at[of] < turn, -right, right)[:, None], mixing.PREDICTORS, 1)

        return -mixing.text_scores(text[:mixing.PAD + n], np.array([mixing.PAD]), np.array([n]), look, weights)[0]

    assert (cost(400) - cost(336)) / 64 < 0.8 * cost(64) / 64
    soon, late = cost(141_000, 140_000) - cost(140_000, 140_000), cost(400_000, 140_000) - cost(300_000, 140_000)
    assert late / 100_000 < 0.8 * soon / 1000  # what helps turns round at byte 140,000


def test_bit_model_is_a_distribution():
    """The probabilities of all one-byte continuations of a context sum to one."""
    rng = np.random.default_rng(0)
    tables = rng.normal(0, 1, mixing.SLOTS).astype(np.float32)
    weights = np.full((mixing.GATES, mixing.PREDICTORS), 0.4)
    total = 0.0
    for b in range(1, 256):
        text = np.array([0, 0, 0, 0, 97, 98, b], np.uint8)
        full = mixing.text_scores(text, np.array([4]), np.array([3]), tables, weights)[0]
        part = mixing.text_scores(text[:6], np.array([4]), np.array([2]), tables, weights)[0]
        total += 10 ** (full - part)
    assert 0.97 < total <= 1.0 + 1e-6  # the byte zero is never coded


# 10 Jaccard join

def brute_groups(rows):
    sets = []
    for r in rows:
        w = blank_words(r[1])
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    members = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(i)
    out = []
    for group in members.values():
        ids = [rows[i][0] for i in group if rows[i][0] is not None]
        for i in group:
            out.append((rows[i][0], len(sets[i]), (min(ids) if ids else None) if sets[i] else rows[i][0]))
    return sorted(out, key=lambda r: (*key(r), r[1]))


@pytest.mark.parametrize("local, hot, short", [(4, 24, 6), (2, 3, 2)])
def test_jaccard(docs, rows, none, monkeypatch, local, hot, short):
    for name, value in (("LOCAL", local), ("HOT", hot), ("SHORT", short)):
        monkeypatch.setattr(jaccard, name, value)
    got = jaccard.digest(jaccard.jaccard_groups(docs)).collect()
    assert sorted(map(tuple, got), key=lambda r: (*key(r), r[1])) == brute_groups(rows)
    assert jaccard.jaccard_groups(none).count() == 0


def test_jaccard_edges_of_the_threshold(spark):
    """Pairs of 3 : 4 are linked, pairs below are not; chains reach their smallest id."""
    rng = random.Random(11)
    data = []
    for k in range(40):
        base = [f"w{k}x{i}" for i in range(rng.randint(6, 60))]
        data.append((len(data), " ".join(base)))
        for cut in (1, 2, 3):
            data.append((len(data), " ".join(base[cut * len(base) // 12:])))
            data.append((len(data), " ".join(base[:len(base) - cut * len(base) // 10] + ["tail"] * cut)))
    got = jaccard.digest(jaccard.jaccard_groups(spark.createDataFrame(data, "doc_id long, text string"))).collect()
    assert sorted(map(tuple, got), key=lambda r: (*key(r), r[1])) == brute_groups(data)


@pytest.mark.parametrize("with_base, medium", [(True, 32), (False, 3)])
def test_jaccard_groups_of_near_copies(spark, monkeypatch, with_base, medium):
    """Many edits of one text: similar to the text, mostly not to each other; others share a passage only."""
    monkeypatch.setattr(jaccard, "SHORT", 2)
    monkeypatch.setattr(jaccard, "MEDIUM", medium)
    rng = random.Random(5)
    base = [f"v{rng.randint(0, 900)}" for _ in range(90)]
    data = [(0, " ".join(base))] if with_base else []
    for i in range(1, 150):
        text, edits = list(base), rng.randint(1, 7)
        for _ in range(edits):
            at = rng.randrange(len(text))
            kind = rng.random()
            text[at:at + 1] = [] if kind < 0.2 else [text[at], f"n{rng.randint(0, 40)}"] if kind < 0.4 else [f"n{rng.randint(0, 400)}"]
        data.append((i, " ".join(text[:rng.choice([90, 90, 70])])))
    for i in range(150, 200):
        data.append((i, " ".join(base[20:60] + [f"o{i}x{j}" for j in range(rng.choice([4, 12, 30]))])))
    got = jaccard.digest(jaccard.jaccard_groups(spark.createDataFrame(data, "doc_id long, text string"))).collect()
    assert sorted(map(tuple, got), key=lambda r: (*key(r), r[1])) == brute_groups(data)
    assert len({r.component_id for r in got}) > 20


def test_shared_items_of_two_blocks(monkeypatch):
    """Frequent items by products, rare ones by pairs, a few at a time."""
    rng = np.random.default_rng(3)
    left, right = ([rng.permutation(rng.choice(top, size, replace=False).astype(np.uint64)) for top, size in zip(rng.integers(40, 900, 60), rng.integers(0, 40, 60))] for _ in "ab")
    want = [[len(set(x.tolist()) & set(y.tolist())) for y in right] for x in left]
    for columns, pairs, dense in ((512, 1 << 20, 16), (3, 50, 4), (8, 7, 1)):
        for name, value in (("COLUMNS", columns), ("PAIRS", pairs), ("DENSE", dense)):
            monkeypatch.setattr(jaccard, name, value)
        assert jaccard.shared_items(left, right).tolist() == want
        assert jaccard.shared_items(left, left[:0]).shape == (60, 0)


@pytest.mark.parametrize("block", [2048, 40])
def test_jaccard_pairs_of_a_group_are_no_rows(spark, monkeypatch, block):
    """Edits of a text that is not there itself: the pairs of the group are decided without sending a set for each of them."""
    for name, value in (("SHORT", 2), ("MEDIUM", 3), ("GROUP", block)):
        monkeypatch.setattr(jaccard, name, value, raising=False)
    asked, linked = [], jaccard._linked
    monkeypatch.setattr(jaccard, "_linked", lambda docs, pairs: asked.append(pairs.select("a", "b").distinct().count()) or linked(docs, pairs))
    rng = random.Random(8)
    base, data = [f"v{i}" for i in range(90)], []
    for i in range(160):
        text = list(base)
        for at in rng.sample(range(90), rng.choice([1, 2, 3, 3])):
            text[at] = f"n{i}x{at}" if rng.random() < 0.8 else f"n{at}"
        data.append((i, " ".join(text)))
    got = jaccard.digest(jaccard.jaccard_groups(spark.createDataFrame(data, "doc_id long, text string"))).collect()
    assert sorted(map(tuple, got), key=lambda r: (*key(r), r[1])) == brute_groups(data)
    assert len({r.component_id for r in got}) > 20
    assert sum(asked) < 20 * len(data)


def test_written_tables_leave_no_shuffle_files(spark):
    from fieldspark.llm.common import drop, written

    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    files = lambda: {b for b in disk.getAllBlocks().mkString(",").split(",") if b.startswith("shuffle_")}
    before, many = files(), spark.range(5000).repartition(5)
    out = written(many.groupBy((many["id"] % 9).alias("k")).count().repartition(3, "k"), "counts", many.groupBy((many["id"] % 7).alias("k")).count())
    for _ in range(50):
        if not (left := files() - before):
            break
        time.sleep(0.2)
    assert not left and out.count() == 9 + 7
    folder = os.path.dirname(out.inputFiles()[0].removeprefix("file:"))
    drop(out)
    assert not os.path.exists(folder)
    with pytest.raises(KeyError):
        drop(many)  # a frame that is no written table


def test_jaccard_keeps_only_the_table_that_its_result_reads(spark, docs):
    folders = lambda: set(os.listdir(shared_dir(spark).removeprefix("file:")))
    before = folders()
    groups = jaccard.jaccard_groups(docs)
    assert {name.partition("-")[0] for name in folders() - before} == {"placed"} and len(folders() - before) == 1
    assert groups.count() == docs.count()


def test_one_of_each(docs, rows):
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    want, seen = Counter(), set()
    groups = {}
    for r, g in zip(sorted(rows, key=lambda r: (*key(r), len(blank_words(r[1])))), brute_groups(rows)):
        groups.setdefault((r[0], r[1]), g)
    for r in rows:
        if not blank_words(r[1]):
            want[(r[0], r[1])] += 1
        elif groups[(r[0], r[1])][2] == r[0] and (r[0], r[1]) not in seen:
            seen.add((r[0], r[1]))
            want[(r[0], r[1])] += 1
    assert got == want


# queries and the pipeline

@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_their_sql(spark, sf, name):
    from fieldspark.catalog.compare import canonical, connect, duck_frame

    theirs, _ = duck_frame(connect(sf), ORACLES[name])
    assert canonical(QUERIES[name](spark, sf).toPandas()) == canonical(theirs)


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns
        docs = corpus_pipeline.written(after, f"test-{name}")
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == docs.count() <= len(before) and docs.count() > 0.8 * len(before)
