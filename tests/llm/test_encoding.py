"""The transducer, exact ids, packing and splitting."""

import os
import random
import tempfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorekeep.llm import encoding, packing, splitting
from lorekeep.llm.lexicon import Lexicon, _minimal, compile_lexicon

pytestmark = pytest.mark.skipif(not os.path.isdir(encoding.TOKENIZERS), reason="no tokenizer files here")
TEXTS = [None, "", " ", "hello hello world", "Привет, мир!  \n\n\tДа", "<|endoftext|> x", "a" * 30_000, "🙂" * 500 + "\r\n", "don't we'll 123 4567", "​﻿ é", "x" + " " * 5000 + "y", "ж" * 9000, "hello world " * 400]


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.binary(min_size=1, max_size=5), st.lists(st.integers(0, 60_000), min_size=1, max_size=4), max_size=60), st.lists(st.binary(max_size=6), max_size=20))
def test_transducer_round_trip(entries, others):
    with tempfile.NamedTemporaryFile() as f:
        f.write(compile_lexicon(entries))
        f.flush()
        lex = Lexicon(f.name)
        words = [*entries, *others]
        for w, place in zip(words, lex.find(words).tolist()):
            assert (lex.sequence(place) if place >= 0 else None) == entries.get(w)


def test_automaton_is_minimal():
    words = sorted(f"{a}{b}ing".encode() for a in "abcd" for b in "xyz")
    edges, _, start = _minimal(words)
    live, todo = set(), [start]
    while todo:
        s = todo.pop()
        if s not in live:
            live.add(s)
            todo += edges[s].values()
    assert len(live) == 6  # one per letter: every prefix and every ending is shared


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "clash")], "doc_id long, text string, ids string")


@pytest.fixture(scope="module")
def tokenizer(spark, docs):
    return encoding.Tokenizer(spark, docs.select("text"))


def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{encoding.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def test_ids_are_exact(docs, tokenizer):
    t = reference()
    got = encoding.encode(docs, tokenizer, "doc_id", "text").collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        assert r.ids == t.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids


def test_other_vocabulary_and_no_rows(spark, docs):
    import tiktoken

    tok = encoding.Tokenizer(spark, docs.select("text").where("false"), vocabulary="byte_bpe_multi_50k")
    assert encoding.encode(docs.where("false"), tok, "doc_id", "text").count() == 0
    import base64

    with open(f"{encoding.TOKENIZERS}/byte_bpe_multi_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("x", pat_str=encoding.SPLIT, mergeable_ranks=ranks, special_tokens={})
    for r in encoding.encode(docs, tok, "doc_id", "text").collect():
        assert r.ids == e.encode_ordinary(TEXTS[r.doc_id] or "")


def test_very_long_text_in_runs(monkeypatch):
    monkeypatch.setattr(encoding, "_SLICE", 10)
    text = "one two  three\n" * 50
    runs = [c for _, r in encoding.chunk_runs([text]) for c in r]
    assert "".join(runs) == text and [w for c in runs for w in encoding._PATTERN.findall(c)] == encoding._PATTERN.findall(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(" \t\n\r\x1c\x85\xa0\u2028\u3000\u200b'sab1½²é.-🙂жЖ\u0301"), max_size=40))
def test_words_stay_within_their_chunks(text):
    chunks = [c for _, r in encoding.chunk_runs([text]) for c in r]
    assert "".join(chunks) == text and [w for c in chunks for w in encoding._PATTERN.findall(c)] == encoding._PATTERN.findall(text)


def test_frequent_words_count_all_rows(docs):
    assert encoding.frequent_words(docs.select("text"), 1) == [" hello"] or encoding.frequent_words(docs.select("text"), 1) == [" world"]


# ------------------------------------------------------------------ packing


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 20), max_size=200), st.integers(1, 6))
def test_best_fit_equals_a_plain_one(sizes, most):
    fit, bins, made = packing.BestFit(20, most), [], 0  # bins: [free, number], newest last
    for s in sizes:
        ok = [b for b in bins if b[0] >= s]
        if ok:
            least = min(b[0] for b in ok)
            b = [x for x in bins if x[0] == least][-1]
            bins.remove(b)
        else:
            if len(bins) == most:
                full = min(x[0] for x in bins)
                bins.remove([x for x in bins if x[0] == full][-1])
            b = [20, made]
            made += 1
        wanted = (b[1], 20 - b[0])
        b[0] -= s
        if b[0]:
            bins.append(b)
        assert fit.put(s) == wanted


def test_pack(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([0, 1, 5, 50, 99, 100, 101, 250, 1000, None])) for i in range(600)] + [(7, 3), (None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, n int").withColumn("container", F.lit("clash"))
    got = packing.pack(df, "doc_id", "n", capacity=100, open_bins=8).collect()
    used, spans = {}, {}
    for r in got:
        used.setdefault(r.container, []).append((r.offset, r.n_units))
        spans.setdefault(r.doc_id, []).append((r.first_unit, r.n_units))
    for places in used.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 100
    want = {}
    for i, n in rows:
        want.setdefault(i, []).append(max(n or 0, 0))
    assert {i: sum(n for _, n in s) for i, s in spans.items()} == {i: sum(n) for i, n in want.items()}
    assert all(len(spans[i]) == max(1, -(-n[0] // 100)) for i, n in want.items() if len(n) == 1)
    total = sum(sum(n) for n in want.values())
    assert total / (100 * len(used)) > 0.95
    assert sorted(packing.pack(df, "doc_id", "n", 100, 8).collect(), key=str) == sorted(got, key=str)
    assert packing.pack(df.where("false"), "doc_id", "n").count() == 0


# ------------------------------------------------------------------ splitting


@pytest.fixture(scope="module")
def plain():
    with open(f"{encoding.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        return splitting.Units(encoding.Encoder(f.read(), None))


def sentences(seed, n):
    rng = random.Random(seed)
    return " ".join(" ".join(rng.choice(["alpha", "бета", "gamma", "дельта", "run 12"]) for _ in range(rng.randrange(3, 12))) + rng.choice([".", "!", ".\n\n", ";"]) for _ in range(n))


@pytest.mark.parametrize("text", [sentences(1, 300), "a" * 5000, "слово" * 900, "\n" * 3000, "x y" * 1500, sentences(2, 80) + "z" * 4000 + sentences(3, 80), "🙂é" * 700])
def test_pieces_cover_overlap_and_fit(plain, text):
    t, pieces = reference(), splitting.split_text(text, plain, 100, 50, 16)
    size = lambda s: len(t.encode(s, add_special_tokens=False).ids)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text) and len(pieces) > 1
    for a, b, n, _ in pieces:
        assert size(text[a:b]) == n <= 100
    for (a, b, *_), (c, d, _, shared) in zip(pieces, pieces[1:]):
        assert a < c < b < d
        assert size(text[c:b]) == shared >= 16


def test_cuts_fall_on_boundaries(plain):
    text = sentences(4, 300)
    ends = [text[:b].rstrip()[-1] for _, b, *_ in splitting.split_text(text, plain, 100, 50, 16)[:-1]]
    assert all(e in ".!;" for e in ends)


def test_an_edit_changes_only_nearby_pieces(plain):
    text = sentences(5, 600)
    other = text[:900] + " inserted words here." + text[900:]
    a = {text[s:e] for s, e, *_ in splitting.split_text(text, plain, 100, 50, 16)}
    b = {other[s:e] for s, e, *_ in splitting.split_text(other, plain, 100, 50, 16)}
    assert len(a & b) >= len(a) - 12


def test_split_rows(spark, docs, tokenizer):
    got = splitting.split(docs, tokenizer, "doc_id", "text").collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == set(range(len(TEXTS)))
    assert [(r.piece, r.n_tokens) for r in by[0]] == [(None, 0)] and [(r.piece, r.n_tokens) for r in by[1]] == [("", 0)]
    assert all(r.n_tokens <= 512 for r in got) and len(by[3]) == 2 and len(by[6]) > 1
    assert all(TEXTS[r.doc_id][r.start : r.stop] == r.piece for r in got if r.piece)
    assert splitting.split(docs.where("false"), tokenizer, "doc_id", "text").count() == 0
