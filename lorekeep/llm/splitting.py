"""Splitting oversized texts at natural boundaries."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession

from .encoding import _PATTERN, Encoder, Memo, Tokenizer, chunk_runs, corpus, encoder

LIMIT, LEAST, OVERLAP = 512, 256, 64
_WINDOW = 4  # words under the rolling hash
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LONG = 24  # tokens; a longer word is divided
_TOGETHER = 1_000_000  # characters of texts looked up together
_PARAGRAPH = regex.compile(r"\n[^\S\n]*\n\s*$|\r\n\r\n\s*$")
_SENTENCE = regex.compile(r"[.!?…;:]+[\"'»”)\]]*$")


_LINE, _PAR, _LED, _BLANK_ONLY, _ENDS = 1, 2, 4, 8, 16


class Units:
    """Numbers for the words met by a worker, with what splitting needs to know of each: tokens, characters, hash and kind of boundary."""

    def __init__(self, e: Encoder):
        self.e, self.codes, self.chunks = e, {}, Memo()
        self.facts: list[tuple[int, int, int, int]] = []
        self.table = np.zeros((0, 3), np.int64), np.zeros(0, np.uint64)

    def code(self, words: list[str]) -> list[int]:
        new = [w for w in dict.fromkeys(words) if w not in self.codes]
        ids = self.e.learn(new)
        for w in new:
            self.codes[w] = len(self.facts)
            kind = ("\n" in w or "\r" in w) * _LINE | bool(_PARAGRAPH.search(w)) * _PAR | w[:1].isspace() * _LED | w.isspace() * _BLANK_ONLY | bool(_SENTENCE.search(w)) * _ENDS
            self.facts.append((len(ids[w]), len(w), kind, crc32(w.encode("utf-8", "replace"))))
        return [self.codes[w] for w in words]

    def of(self, texts: list[str]) -> list[np.ndarray]:
        """The words of each text, as numbers of this table; valid until the next call."""
        self.chunks.room()
        if not self.chunks:
            self.codes.clear()
            self.facts.clear()
            self.table = np.zeros((0, 3), np.int64), np.zeros(0, np.uint64)
        runs: list[list[list[str]]] = [[] for _ in texts]
        for k, cs in chunk_runs(texts):
            runs[k].append(cs)
        new = [c for c in set(chain.from_iterable(chain.from_iterable(runs))) if c not in self.chunks]
        split = [_PATTERN.findall(c) for c in new]
        self.code(list(chain.from_iterable(split)))
        for c, ws in zip(new, split):
            self.chunks[c] = [self.codes[w] for w in ws]
        self.chunks.chars += sum(map(len, new))
        known = self.chunks.__getitem__
        return [np.array(list(chain.from_iterable(map(known, chain.from_iterable(r)))), np.int64) for r in runs]

    def look(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, characters, kinds, hashes) of units."""
        if len(self.table[1]) < len(self.facts):
            more = self.facts[len(self.table[1]) :]
            small, hashes = np.array([f[:3] for f in more], np.int64), np.array([f[3] for f in more], np.uint64)
            self.table = np.concatenate([self.table[0], small]), np.concatenate([self.table[1], hashes])
        rows = self.table[0][codes]
        return rows[:, 0], rows[:, 1], rows[:, 2], self.table[1][codes]


def _divide(codes: np.ndarray, sizes: np.ndarray, chars: np.ndarray, text: str, units: Units) -> tuple[np.ndarray, np.ndarray]:
    """The words with very long ones divided into parts of a few characters, and how many such parts come before each unit."""
    long_ = np.flatnonzero(sizes > _LONG)
    if not len(long_):
        return codes, np.zeros(len(codes) + 1, np.int64)
    place, out, part, at = np.append(0, np.cumsum(chars)), [], [], 0
    for k in long_.tolist():
        w = text[place[k] : place[k + 1]]
        cut = units.code([w[j : j + _LONG] for j in range(0, len(w), _LONG)])
        out += [codes[at:k], cut]
        part += [np.zeros(k - at, np.int64), np.ones(len(cut), np.int64)]
        at = k + 1
    return np.concatenate([*out, codes[at:]]), np.append(0, np.cumsum(np.concatenate([*part, np.zeros(len(codes) - at, np.int64)])))


def _strength(kind: np.ndarray) -> np.ndarray:
    """Of the place before each unit: 4 paragraph, 3 line, 2 sentence, 1 white space, 0 inside a word or right before punctuation."""
    rank = np.zeros(len(kind) + 1, np.int64)
    before, here = kind[:-1], kind[1:]
    wide = (before & _PAR) > 0
    wide[1:] |= ((kind[:-2] & _LINE) > 0) & ((before[1:] & _BLANK_ONLY) > 0)
    led = np.where(here & _LED, np.where(before & _ENDS, 2, 1), (before & _BLANK_ONLY) > 0)
    rank[1:-1] = np.where(before & _LINE, np.where(wide, 4, 3), led)
    return rank


def _landmarks(h: np.ndarray) -> np.ndarray:
    """A rolling hash of the words before each place; it depends on them alone."""
    out = np.zeros(len(h) + 1, np.uint64)
    for back in range(1, _WINDOW + 1):
        out[back:] += h[: len(h) + 1 - back] * (_MIX ** np.uint64(back))
    out ^= out >> np.uint64(29)
    return out * _MIX


def split_text(text: str, known: Units, limit: int = LIMIT, least: int = LEAST, overlap: int = OVERLAP, codes: np.ndarray | None = None) -> list[tuple[int, int, int, int]]:
    """(start, end, tokens, tokens shared with the piece before) of each piece, in characters of the text.

    A piece ends between ``least`` and ``limit`` tokens after its start, at the natural boundary nearest
    to the landmark: the place of that range with the smallest rolling hash of the words before it.
    Stronger boundaries (paragraph, line, sentence, white space) come before weaker ones. The next piece
    starts where the shared words hold ``overlap`` tokens at least. Where no boundary exists, the cut is the
    landmark itself, inside the long word. Landmarks depend on nearby words only, so an edit moves
    the cuts next to it and later ones fall into place again. ``codes``: the text's words, where ``known`` has just given them.
    """
    codes = known.of([text])[0] if codes is None else codes
    sizes, chars, _, _ = known.look(codes)
    if (whole := int(sizes.sum())) <= limit:
        return [(0, len(text), whole, 0)]
    codes, divided = _divide(codes, sizes, chars, text, known)
    sizes, chars, kind, hashes = known.look(codes)
    total, place, n_units = np.append(0, np.cumsum(sizes)), np.append(0, np.cumsum(chars)), len(codes)
    strengths, marks, blank = _strength(kind), _landmarks(hashes), (kind & _BLANK_ONLY) > 0

    def count(a: int, b: int) -> int:
        """Tokens of the units a to b as a text by itself. It splits into the same words up to the white space at its end,
        which is no longer followed by a word; divided words may merge, so then all is encoded."""
        tail = b
        if divided[a] != divided[b]:
            tail = a
        while tail > a and blank[tail - 1]:
            tail -= 1
        return int(total[tail] - total[a]) + (len(known.e.encode([text[place[tail] : place[b]]])[0]) if tail < b else 0)

    pieces, start, end, shared = [], 0, 0, 0
    while end < n_units:
        high = int(np.searchsorted(total, total[start] + limit, "right")) - 1
        if high >= n_units:
            stop = n_units
        else:
            low = max(int(np.searchsorted(total, total[start] + least)), end + 1)
            low = min(low, high)
            mark = low + int(np.argmin(marks[low : high + 1]))
            strength = strengths[low : high + 1]
            near = low + np.flatnonzero(strength == strength.max())
            stop = int(near[np.argmin(np.abs(total[near] - total[mark]))])
        stop = max(stop, end + 1)
        while (n := count(start, stop)) > limit and stop > end + 1:
            stop -= 1
        pieces.append((int(place[start]), int(place[stop]), n, shared))
        end, begun = stop, start
        start = max(int(np.searchsorted(total, total[end] - overlap, "right")) - 1, begun + 1)
        while (shared := count(start, end)) < overlap and start > begun + 1:  # divided words take fewer tokens together
            start -= 1
    return pieces


def split(docs: DataFrame, tokenizer: Tokenizer, key: str, text: str, limit: int = LIMIT, least: int = LEAST, overlap: int = OVERLAP) -> DataFrame:
    """(``key``, piece_no, start, stop, n_tokens, shared_tokens, piece) of every text; start and stop count characters.

    A text within the limit is one piece. A null or empty text is one piece of no tokens that keeps
    the text as it is. Repeated ids stay repeated; other columns are ignored; an empty table gives an
    empty result. Each text is handled where it is read, without a shuffle.
    """
    ranks, lexicon = tokenizer.ranks, tokenizer.lexicon

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Units(encoder(ranks, lexicon))
        for batch in batches:
            keys, texts = batch[key].tolist(), [None if t is None or t != t else t for t in batch[text]]
            at = 0
            while at < len(texts):
                stop, chars = at, 0
                while stop < len(texts) and (stop == at or chars + len(texts[stop] or "") <= _TOGETHER):
                    chars += len(texts[stop] or "")
                    stop += 1
                rows = []
                for k, t, codes in zip(keys[at:stop], texts[at:stop], known.of([t or "" for t in texts[at:stop]])):
                    if not t:
                        rows.append((k, 1, 0, 0, 0, 0, t))
                    else:
                        rows += [(k, i, a, b, n, s, t[a:b]) for i, (a, b, n, s) in enumerate(split_text(t, known, limit, least, overlap, codes), 1)]
                yield _frame(rows, key)
                at = stop

    chosen = docs.select(key, text)
    kind = dict(chosen.dtypes)[key]
    return chosen.mapInPandas(run, f"`{key}` {kind}, piece_no long, start long, stop long, n_tokens long, shared_tokens long, piece string")


def _frame(rows: list[tuple], key: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[key, "piece_no", "start", "stop", "n_tokens", "shared_tokens", "piece"])


def p9_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Every document in pieces of at most 512 tokens that share 64 tokens with the piece before."""
    docs = corpus(spark, folder)
    return split(docs, Tokenizer(spark, docs.select("text")), "doc_id", "text")


QUERIES = {"p9_pieces": p9_pieces}
SQL: dict[str, str] = {}
