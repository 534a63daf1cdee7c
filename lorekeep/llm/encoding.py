"""Encoding of a corpus with a public tokenizer."""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import ensure_checkpoint_dir, put, spread
from ..sources.tables import table
from .lexicon import Lexicon, compile_lexicon

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
LEXICON_WORDS = 40_000  # the most frequent words; bounds the transducer's file (about 5 MB), not what is encoded
LEXICON_BYTES = 48  # longer words are merged, never looked up
# Fixed value: the pattern that splits text before the merges of the rank files.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PATTERN = regex.compile(SPLIT)
_BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # white space as the pattern knows it
# Chunks: white space and what stands between it. No word of the pattern reaches beyond its chunk, as only a single space before others joins them.
_CHUNK = re.compile(rf" ?[^{_BLANK}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")
_SLICE = 400_000  # characters split at a time
_MEMO = 150_000  # words, and chunks, remembered by a worker
_MEMO_CHARS = 8_000_000  # and their characters


def chunk_runs(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(text's place, its chunks) in order; a very long text comes in several runs of chunks."""
    for k, text in enumerate(texts):
        if len(text) <= 4 * _SLICE:
            yield k, _CHUNK.findall(text)
        else:
            found = (m.group() for m in _CHUNK.finditer(text))
            while run := list(islice(found, _SLICE // 2)):
                yield k, run


class Memo(dict):
    """What is known of strings; emptied by ``room`` when it holds too much."""

    chars = 0

    def room(self) -> None:
        if len(self) > _MEMO or self.chars > _MEMO_CHARS:
            self.clear()
            self.chars = 0


class Encoder:
    """Words to ids: the transducer for frequent words, exact merges for all others."""

    def __init__(self, ranks: bytes, lexicon: Lexicon | None):
        import tiktoken

        table_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self._merge = tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=table_, special_tokens={})._core_bpe.encode_single_piece
        self.lexicon, self.words, self.chunks = lexicon, Memo(), Memo()

    def learn(self, words: Iterable[str]) -> dict[str, list[int]]:
        """The ids of every word of ``words``, among others."""
        self.words.room()
        new = [w for w in words if w not in self.words]
        raw = [w.encode("utf-8", "replace") for w in new]
        places = self.lexicon.find(raw).tolist() if self.lexicon else [-1] * len(new)
        for w, b, p in zip(new, raw, places):
            self.words[w] = self._merge(b) if p < 0 else self.lexicon.sequence(p)
        self.words.chars += sum(map(len, new))
        return self.words

    def learn_chunks(self, chunks: set[str]) -> dict[str, list[int]]:
        """The ids of every chunk of ``chunks``, among others: those of its words."""
        self.chunks.room()
        new = [c for c in chunks if c not in self.chunks]
        split = [_PATTERN.findall(c) for c in new]
        words = self.learn(dict.fromkeys(chain.from_iterable(split)))
        for c, ws in zip(new, split):
            self.chunks[c] = words[ws[0]] if len(ws) == 1 else [i for w in ws for i in words[w]]
        self.chunks.chars += sum(map(len, new))
        return self.chunks

    def encode(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []

        def flush() -> None:
            memo = self.learn_chunks(set(chain.from_iterable(cs for _, cs in held)))
            for k, cs in held:
                out[k].extend(chain.from_iterable(map(memo.__getitem__, cs)))
            held.clear()

        n = 0
        for k, cs in chunk_runs(texts):
            held.append((k, cs))
            n += len(cs)
            if n > _SLICE // 4:
                flush()
                n = 0
        flush()
        return out


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(ranks_file: str, lexicon_file: str | None) -> Encoder:
    """This worker's encoder for files that Spark has distributed."""
    key = (ranks_file, lexicon_file)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        with open(SparkFiles.get(ranks_file), "rb") as f:
            ranks = f.read()
        _ENCODERS[key] = Encoder(ranks, Lexicon(SparkFiles.get(lexicon_file)) if lexicon_file else None)
    return _ENCODERS[key]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunks: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        words: Counter[str] = Counter()
        for chunk, n in chunks.items():
            for w in _PATTERN.findall(chunk):
                words[w] += n
        chunks.clear()
        rows = [(w, n) for w, n in words.items() if len(w) <= LEXICON_BYTES]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["word", "n"])

    held = 0
    for batch in batches:
        for _, run in chunk_runs([t for t in batch.column(0).to_pylist() if t]):
            chunks.update(run)
            held += len(run)
            if len(chunks) > 2 * _MEMO or held > 64 * _SLICE:
                yield out()
                held = 0
    yield out()


def frequent_words(texts: DataFrame, most: int = LEXICON_WORDS) -> list[str]:
    """The ``most`` most frequent words of one column of texts, by counts over all of them."""
    counted = texts.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counted.where("n > 1").orderBy(F.desc("n"), "word").limit(most)
    return [r.word for r in top.collect()]  # at most ``most`` words


class Tokenizer:
    """A public tokenizer made ready for one corpus; ``ranks`` and ``lexicon`` are distributed file names."""

    def __init__(self, spark: SparkSession, texts: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
        with open(os.path.join(folder, f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = f.read()
        plain = Encoder(ranks, None)
        words = [w for w in frequent_words(texts) if len(w.encode()) <= LEXICON_BYTES]
        ids = plain.learn(set(words))
        self.ranks = self._share(spark, f"{vocabulary}", ranks)
        self.lexicon = self._share(spark, "lexicon", compile_lexicon({w.encode(): ids[w] for w in words}))

    @staticmethod
    def _share(spark: SparkSession, name: str, content: bytes) -> str:
        """Hand a file to every executor from the shared folder, under a name made from its content. It stays there, as executors may join later."""
        name = f"{name}-{hashlib.sha256(content).hexdigest()[:16]}"
        if not any(x.endswith(f"/{name}") for x in spark.sparkContext.listFiles):
            path = f"{ensure_checkpoint_dir(spark)}/{name}"
            put(spark, path, content)
            spark.sparkContext.addFile(path)
        return name


def encode(docs: DataFrame, tokenizer: Tokenizer, key: str, text: str) -> DataFrame:
    """(``key``, ids) of every row; a null or an empty text has no ids: an empty list, never null.

    Special tokens' strings in a text are ordinary text. Rows are neither split nor shuffled: words are
    looked up in the memory-mapped transducer, what it lacks is merged exactly. Repeated keys stay
    repeated; other columns are ignored; an empty table gives an empty result.
    """
    ranks, lexicon = tokenizer.ranks, tokenizer.lexicon

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(ranks, lexicon)
        for batch in batches:
            for part in _slices(batch):
                ids = e.encode([t or "" for t in part.column(1).to_pylist()])
                offsets = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32)
                flat = pa.array(np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1])))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat)], [key, "ids"])

    rows = docs.select(key, text)
    return rows.mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, ids array<int>")


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of a few MB of text each, so that memory follows the text and not the row count."""
    sizes = np.array([len(t) if t else 0 for t in batch.column(1).to_pylist()], np.int64)
    marks = np.cumsum(sizes) // 2_000_000
    start = 0
    for stop in [*(np.flatnonzero(np.diff(marks)) + 1).tolist(), len(sizes)]:
        if stop > start:
            yield batch.slice(start, stop - start)
        start = stop


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select("doc_id", "text"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The byte_bpe_50k ids of every document, an empty list for a null or empty text."""
    docs = corpus(spark, folder)
    return encode(docs, Tokenizer(spark, docs.select("text")), "doc_id", "text")


QUERIES = {"p7_ids": p7_ids}
SQL: dict[str, str] = {}
