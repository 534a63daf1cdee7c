"""Personal information inside free text: found, and replaced by typed placeholders."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import cut, discard, spread
from ..sources.tables import table

LEAST_BITS = -1.2  # disclosure, as log2 of the odds that a span or term is personal, from which on it is replaced (-1.2: three in ten)
TERM_WEIGHT = 8.0  # uses that a term's own counts are smoothed by, towards the share of all
NAME_WEIGHT = 1.2  # the same for parts of names
MOST_BITS = 12.0  # of evidence that one term can give for or against
BROADCAST_TERMS = 200_000  # above that many name terms they are joined to the texts instead of broadcast

# ------------------------------------------------------------------ patterns that propose spans

_Z = "\u200b\u2060\ufeff"
_S = rf"[\s{_Z}]"  # white space and what shows nothing
_H = rf"[^\S\n\r]|[{_Z}]"  # the same within a line
_DASH = "\\-\u2010\u2011\u2012\u2013"

_LABEL = r"[^\W_](?:[\w\-]*[^\W_])?"
_LOCAL = r"[^\W_](?:[\w.+%\-]*[^\W_])?"
_AT = rf"(?:@|{_S}*(?:\((?:at|собака)\)|\[(?:at|собака)\]|\{{(?:at|собака)\}}){_S}*)"
_DOT = rf"(?:\.|{_S}*(?:\((?:dot|точка)\)|\[(?:dot|точка)\]|\{{(?:dot|точка)\}}){_S}*)"
_EMAIL = re.compile(
    rf"(?<![\w.+%\-@/])(?:{_LOCAL}{_AT}{_LABEL}(?:{_DOT}{_LABEL})+"
    rf"|{_LOCAL}{_S}+(?:at|собака){_S}+{_LABEL}(?:{_S}+(?:dot|точка){_S}+{_LABEL})+"
    rf"|{_LOCAL}{_S}+собака{_S}+{_LABEL}(?:\.{_LABEL})+)",
    re.I,
)

_AT_WORD = re.compile(r"\sat\s")

_TYPE = r"ул(?:\.|иц[аеуы])?|пр-(?:к?т)|просп(?:\.|ект[а-я]*)|пер(?:\.|еул[а-я]*\.?)|наб(?:\.|ережн[а-я]*)|б-р|бульвар[а-я]*|ш(?:\.|оссе)|пл(?:\.|ощад[а-я]*)|проезд[а-я]*|аллея"
_WORD = r"[^\W\d_][\w\-]*"
_NUM = r"\d+[а-яa-z]?(?![\w])"
_FLAT = rf"(?:{_S}*,?{_S}*(?:кв(?:\.|артира)?|оф(?:\.|ис)?|пом\.?|комн?\.?){_S}*\d+(?!\w))?"
_HOUSE = rf"(?:д(?:\.|ом)?{_S}*)?{_NUM}(?:{_S}*[/{_DASH}]{_S}*{_NUM})?(?:{_S}*,?{_S}*(?:к(?:\.|орп\.?|орпус)?|стр\.?|строение){_S}*\d+(?!\w))?{_FLAT}"
_RU = re.compile(
    rf"(?<!\w)(?:(?:{_TYPE})(?!\w){_S}*(?:{_WORD}{_S}+){{0,3}}?{_WORD}"
    rf"|(?:[^\W\d_]+(?:ый|ий|ой|ая|ое|ые){_S}+){{0,2}}?{_WORD}{_S}+(?:{_TYPE})(?!\w)){_S}*,?{_S}*{_HOUSE}",
    re.I,
)
_ROOM = rf"(?:apt|apartment|flat|suite|unit|room|office){_S}*\.?{_S}*#?\d+[a-z]?"
_ROAD = r"street|st|road|rd|avenue|ave|lane|ln|drive|dr|court|ct|crescent|cres|terrace|place|square|sq|boulevard|blvd|way|close|row|gardens"
_EN = re.compile(rf"(?<![\w./\-])(?:{_ROOM}{_S}*,{_S}*)?\d+[a-z]?{_S}+((?:[^\W\d_][\w'’]*{_S}+){{1,3}})(?:{_ROAD})(?!\w)(?:\.?{_S}*,?{_S}*{_ROOM})?", re.I)
_STREET_HINT = re.compile(rf"(?<!\w)(?:{_TYPE}|{_ROAD})(?!\w)", re.I)

_ID_LABEL = r"(?:инн|снилс|паспорт[а-я]*|ssn|passport|inn|snils|social security(?: number| no\.?)?|tax(?:payer)? (?:id|number))"
_J = rf"[\s{_DASH}{_Z}]{{1,3}}"  # between the parts of a number
_ID_SHAPE = (
    rf"\d{{2}}{_S}{{1,3}}\d{{2}}{_S}*(?:№|n|no\.?|номер){_S}*\d{{6}}|\d{{2}}{_S}{{1,3}}\d{{2}}{_S}{{1,3}}\d{{6}}|\d{{4}}{_S}*(?:№|номер){_S}*\d{{6}}|\d{{4}}{_J}\d{{6}}"
    rf"|\d{{3}}{_J}\d{{3}}{_J}\d{{3}}{_J}\d{{2}}|\d{{3}}{_J}\d{{2}}{_J}\d{{4}}|\d{{9,12}}"
)
_ID_AFTER = re.compile(rf"(?<!\w){_ID_LABEL}(?!\w)[^\d.!?\n]{{0,28}}?(?<![\w.+(])({_ID_SHAPE})(?!\w)", re.I)
_ID_BEFORE = re.compile(rf"(?<![\w.+(])({_ID_SHAPE})(?!\w)[^\d.!?\n;]{{1,16}}?(?<!\w){_ID_LABEL}(?!\w)", re.I)

_G = rf"[\s.{_DASH}{_Z}]"
_PHONE = re.compile(
    rf"(?<![\w+(])(?:\+{_G}?\d{{1,3}}{_G}{{0,2}}(?:\(\d{{2,5}}\)|\d{{2,5}}){_G}{{0,2}}\d{{2,4}}(?:{_G}{{0,2}}\d{{2,4}}){{1,3}}"
    rf"|8{_G}{{0,2}}(?:\(\d{{3}}\)|\d{{3}}){_G}{{0,2}}\d{{3}}{_G}{{0,2}}\d{{2}}{_G}{{0,2}}\d{{2}}"
    rf"|\(\d{{3}}\){_G}{{0,2}}\d{{3}}[{_DASH}.\s]\d{{4}}|(?<![.])\d{{3}}([.{_DASH}])\d{{3}}\1\d{{4}})(?![\w]|[.{_DASH}]\d)"
)
_ID_LOOSE = re.compile(rf"(?<![\w.+(])({_ID_SHAPE})(?!\w)", re.I)
_LEFT = re.compile(r"([^\W\d_][\w\-]*)[^\w\n]{0,3}$")
_RIGHT = re.compile(r"[^\w\n]{0,3}([^\W\d_][\w\-]*)")

# What is known before any text is read, as (uses for a person, uses in all) of a term.
BEFORE = {
    "PHONE": {f"l:{w}": (0, 16) for w in ("счет", "счёт", "account", "trace", "ticket", "тикет", "заявк", "build", "сборк", "ts", "commit", "invoice", "инвойс", "range", "order", "заказ", "шаг")} | {"f:+": (16, 16), "f:(": (16, 16)},
    "EMAIL": {f"l:{w}": (0, 16) for w in ("ssh", "scp", "sftp", "rsync", "remote", "clone", "push", "pull", "fetch", "login", "log-in", "origin")} | {"f:number": (0, 64), "f:path": (0, 64)},
    "ID": {"f:label": (16, 16), "f:bare": (0, 8)},
    "ADDRESS": {"f:uncased": (0, 64)},
}
SHARE_BEFORE = {"PHONE": 0.8, "EMAIL": 0.9, "ID": 0.3, "ADDRESS": 0.9}  # of each type's proposals, before any text is read


def _class(*categories: str) -> str:
    """The letters of some Unicode categories, as the inside of a character class."""
    return "".join(c for c in map(chr, range(0x10000)) if unicodedata.category(c) in categories)


_UP, _LOW = _class("Lu", "Lt"), _class("Ll")
_CAP = rf"(?:[{_UP}][{_LOW}]+|[{_UP}]['’][{_UP}][{_LOW}]+)(?:[-‑'’][{_UP}]?[{_LOW}]+)*"
_INITIAL = rf"[{_UP}]\."
_DASHES = "—–-"
_RUN = re.compile(rf"(?:(?<=[{_LOW}] )|(?<=[{_LOW}]: )|(?<=[{_LOW}] [{_DASHES}] ))(?:{_CAP}|{_INITIAL})(?: ?(?<=[\s.])(?:{_CAP}|{_INITIAL}))*(?![-\w@/])")
_WITH_INITIALS = re.compile(rf"(?<!\w)(?:{_INITIAL} ?)+({_CAP})(?![-\w@/])|(?<!\w)({_CAP}) {_INITIAL} ?{_INITIAL}")
_LISTED = re.compile(rf", ?[{_UP}]")
_FIRST = re.compile(rf"(?:(?<=[\n.!?])|(?<=[.!?] )){_CAP}(?=[.!?]|,? [{_LOW}])")
_PART = re.compile(rf"{_CAP}|{_INITIAL}")
_TOKEN = re.compile(rf"[^\W\d_]+(?:[-‑'’][^\W\d_]+)*(?:(?<![^\W\d_]{{2}})\.)?")
_LOWER = re.compile(rf"(?<![\w\-'’.+@/])[{_LOW}]{{2,}}(?![\w\-+@/]|\.\w)")
_PATRONYMIC = re.compile(r"[а-яё]{2,}(?:ович|евич|овн|евн|иничн)(?:а|у|ем|ом|е|ой|ы|и|ою)?|(?:ильич|кузьмич|фомич|лукич|никитич)(?:а|у|ом|ем|е)?")
# Fixed value: case endings of Russian names, longest first.
_ENDINGS = ("ого", "ому", "ыми", "ими", "ией", "ием", "ия", "ию", "ии", "ий", "ой", "ою", "ей", "ею", "ом", "ем", "ым", "им", "ых", "их", "ую", "ая", "ый", "а", "я", "у", "ю", "ы", "и", "е", "о", "ь", "й")


def stem(word: str) -> str:
    """A term's form without case: lower-cased, Russian case endings and the English possessive removed."""
    w = word.lower().replace("ё", "е").replace("’", "'").replace("‑", "-")
    if "а" <= w[-1:] <= "я":
        for e in _ENDINGS:
            if w.endswith(e) and len(w) - len(e) >= 3:
                return w[: -len(e)]
        return w
    return w.removesuffix("'s")


def letter_case(text: str) -> str:
    """``mixed``, or ``lower``, ``upper`` or ``title`` where a whole text of some length is written so."""
    letters = [t for t in _TOKEN.findall(text) if len(t) > 2]
    if len(letters) < 4:
        return "mixed"
    caps, upper = sum(t[0].isupper() for t in letters), sum(t.isupper() for t in letters)
    if upper > 0.6 * len(letters):
        return "upper"
    if caps > 0.6 * len(letters):
        return "title"
    return "mixed" if caps else "lower"


# ------------------------------------------------------------------ spans


def _free(spans: list, a: int, b: int) -> bool:
    return all(b <= x or a >= y for x, y, _ in spans)


class Proposal(NamedTuple):
    """A span that may be personal. ``seed``: that it is one shows without the terms around it; ``terms``: its form and its neighbours."""

    start: int
    stop: int
    type: str
    seed: bool
    terms: tuple[str, ...]


def _around(text: str, a: int, b: int) -> list[str]:
    """The words right before and right after a span."""
    left, right = _LEFT.search(text[max(0, a - 24) : a]), _RIGHT.match(text[b : b + 24])
    return [f"{side}:{stem(m[1])}" for side, m in (("l", left), ("r", right)) if m]


def proposals(text: str, case: str) -> list[Proposal]:
    """All spans whose form is that of an e-mail address, street address, identity number or phone number, in this order; they may overlap."""
    out: list[Proposal] = []
    low = text.lower()
    if "@" in low or "собака" in low or "(at)" in low or "[at]" in low or "{at}" in low or _AT_WORD.search(low):
        for m in _EMAIL.finditer(text):
            last = re.split(r"[.\s\]\)}]+", m.group())[-1]
            form = "number" if not last.isalpha() or len(last) < 2 else "path" if re.match(r":\S", text[m.end() : m.end() + 2]) else "host"
            out.append(Proposal(m.start(), m.end(), "EMAIL", form == "host", (f"f:{form}", *_around(text, m.start(), m.end()))))
    digits = sum(map(text.count, "0123456789")) if text.isascii() else sum(map(str.isdigit, text))
    if not digits:
        return out
    if _STREET_HINT.search(low):
        for m in _RU.finditer(text):
            out.append(Proposal(m.start(), m.end(), "ADDRESS", True, ("f:cased", *_around(text, m.start(), m.end()))))
        for m in _EN.finditer(text):
            cased = case == "lower" or all(w[0].isupper() for w in m.group(1).split())
            out.append(Proposal(m.start(), m.end(), "ADDRESS", cased, ("f:cased" if cased else "f:uncased", *_around(text, m.start(), m.end()))))
    if digits < 9:
        return out
    labelled: list[tuple[int, int, str]] = []
    for pattern in (_ID_AFTER, _ID_BEFORE, _ID_LOOSE):
        for m in pattern.finditer(text):
            if _free(labelled, *m.span(1)):
                a, b = m.span(1)
                seed = pattern is not _ID_LOOSE
                labelled.append((a, b, "ID"))
                form = re.sub(r"\d", "9", re.sub(r"\s+", " ", m.group(1).lower()))
                out.append(Proposal(a, b, "ID", seed, ("f:label" if seed else "f:bare", f"s:{form}", *_around(text, a, b))))
    for m in _PHONE.finditer(text):
        v = m.group()
        if 10 <= sum(c.isdigit() for c in v) <= 15:
            form = ["f:+"] * ("+" in v) + ["f:("] * ("(" in v)
            out.append(Proposal(m.start(), m.end(), "PHONE", bool(form), (*form, *_around(text, m.start(), m.end()))))
    return out


def _seeds(found: list[Proposal]) -> list[tuple[int, int, str]]:
    spans: list[tuple[int, int, str]] = []
    for p in found:
        if p.seed and _free(spans, p.start, p.stop):
            spans.append((p.start, p.stop, p.type))
    return spans


def disclosed(found: list[Proposal], bits: Callable[[str, str], float], least: float = LEAST_BITS) -> list[tuple[int, int, str]]:
    """The proposals whose disclosure is at least ``least``: the log2 odds of their type, and the evidence of each of their terms."""
    spans: list[tuple[int, int, str]] = []
    for p in found:
        if _free(spans, p.start, p.stop) and bits(p.type, "") + sum(bits(p.type, t) for t in p.terms) >= least:
            spans.append((p.start, p.stop, p.type))
    return spans


def name_spans(text: str, taken: list[tuple[int, int, str]], case: str, is_name: Callable[[str], bool]) -> list[tuple[int, int, str]]:
    """Spans of names: two or more adjacent parts, at least one of them a term that reveals persons, none outside a name."""
    parts: list[tuple[int, int, str]] = []
    hit = False
    for m in _TOKEN.finditer(text):
        t = m.group()
        if t[-1] == ".":
            kind = "I" if len(t) == 2 and (t[0].isupper() or case == "lower") else ""
        elif is_name(t) and (t[0].isupper() or case == "lower" or len(t) > 3):
            kind, hit = ("N" if t[0].isupper() or case == "lower" else "n"), True
        elif _PATRONYMIC.fullmatch(t.lower()) and (t[0].isupper() or case == "lower"):
            kind = "P"
        else:
            kind = ""
        parts.append((m.start(), m.end(), kind))
    if not hit:
        return []
    out, run = [], []

    def close() -> None:
        while run and run[-1][2] == "I" and not any(x[2] in "Nn" for x in run[-3:]):
            run.pop()
        if len(run) > 1 and any(x[2] in "Nn" for x in run) and _free(taken, run[0][0], run[-1][1]):
            out.append((run[0][0], run[-1][1], "NAME"))
        run.clear()

    gap_ok = re.compile(rf"(?:{_H})+")
    comma_ok = re.compile(rf"(?:{_H})*,(?:{_H})+")
    for at, p in enumerate(parts):
        if p[2] and not _free(taken, p[0], p[1]):
            p = (p[0], p[1], "")
        if not p[2]:
            close()
            continue
        if run:
            gap = text[run[-1][1] : p[0]]
            joined = gap_ok.fullmatch(gap) or (gap == "" and run[-1][2] == "I")
            after = parts[at + 1] if at + 1 < len(parts) else None  # "Surname, Given", not a list of names
            alone = after is None or after[2] not in ("N", "n", "P") or not gap_ok.fullmatch(text[p[1] : after[0]])
            listed = comma_ok.fullmatch(gap) and len(run) == 1 and run[0][2] in "Nn" and p[2] in "Nn" and alone
            if not (joined or listed):
                close()
        run.append(p)
    close()
    return out


def sanitise(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its type in brackets."""
    out, at = [], 0
    for a, b, kind in sorted(spans):
        out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join([*out, text[at:]])


# ------------------------------------------------------------------ which terms reveal a person


def _observe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Uses of each term in all, and those for a person: parts of names by where they stand, other terms by the proposals they come with."""
    uses, personal = Counter(), Counter()

    def out() -> pd.DataFrame:
        rows = [(*key, personal[key], n) for key, n in uses.items()]
        uses.clear()
        personal.clear()
        return pd.DataFrame(rows, columns=["type", "term", "k", "n"])

    for batch in batches:
        kept, plain = [], Counter()
        for t in batch["text"]:
            if not t:
                continue
            case = letter_case(t)
            found = proposals(t, case)
            spans = _seeds(found)
            for p in found:
                if p.seed or _free(spans, p.start, p.stop):
                    for term in ("", *p.terms):
                        uses[p.type, term] += 1
                        personal[p.type, term] += p.seed
            if case != "mixed":
                continue
            kept.append(t)
            runs, initialled = list(_RUN.finditer(t)), list(_WITH_INITIALS.finditer(t))
            for m in runs:
                if not _free(spans, *m.span()):
                    continue
                run = _PART.findall(m.group())
                if len(run) == 1 and (_LISTED.match(t, m.end()) or t[m.start() - 2 : m.start()] == ", "):
                    continue  # "Surname, Given" or a list: no evidence either way
                for w in run[t[m.start() - 2] in _DASHES :]:  # what follows a dash may be the head of a sentence
                    if w[-1] != ".":
                        uses["NAME", x := stem(w)] += 1
                        personal["NAME", x] += len(run) > 1
            if initialled:
                taken = [*spans, *((*f.span(), "") for f in runs)]
                for m in initialled:
                    if _free(taken, *m.span()):
                        uses["NAME", x := stem(m[1] or m[2])] += 1
                        personal["NAME", x] += 1
        together = "\n" + "\n".join(kept)
        plain.update(_LOWER.findall(together))
        plain.update(_FIRST.findall(together))
        for w, n in plain.items():
            uses["NAME", stem(w)] += n
        if len(uses) > 200_000:
            yield out()
    if uses:
        yield out()


def _odds(share: Column) -> Column:
    """log2 of the odds, within what one term may tell."""
    return F.greatest(F.lit(-MOST_BITS), F.least(F.lit(MOST_BITS), F.log2(share / (F.lit(1.0) - share))))


def revealing_terms(texts: DataFrame, least: float = LEAST_BITS) -> DataFrame:
    """(type, term, bits): how strongly a term discloses that a span is personal, by co-occurrence over all texts.

    A part of a name is seen where it stands, within a sentence or after a colon, in a run of two or
    more capitalised parts (words or initials), or after initials, or before two; its bits are the log2 odds that a use of it is one of these,
    and those of ``least`` and more are kept. Uses against it are those in lower case, alone within a sentence, and alone at the head of one. Of e-mail and street addresses, identity and phone numbers the terms are the forms of proposed
    spans and the words next to them; bits are the weight of evidence: log2 odds of a seed given the term, less those of all proposals of the
    type, which stand at the empty term. Shares are smoothed towards the type's own, and what is known before counts as a few uses.
    """
    spark = texts.sparkSession
    schema = "type string, term string, k long, n long"
    before = spark.createDataFrame([(kind, t, k, n) for kind, terms in BEFORE.items() for t, (k, n) in terms.items()], schema)
    counts = cut(texts.mapInPandas(_observe, schema).union(before).groupBy("type", "term").agg(F.sum("k").alias("k"), F.sum("n").alias("n")))
    all_names = counts.where("type = 'NAME'").agg(F.sum("k").alias("k"), F.sum("n").alias("n")).first()
    share = {r.type: (r.k + TERM_WEIGHT * SHARE_BEFORE[r.type]) / (r.n + TERM_WEIGHT) for r in counts.where("term = '' and type <> 'NAME'").collect()}  # four types
    share = SHARE_BEFORE | share | {"NAME": ((all_names.k or 0) + 0.5) / ((all_names.n or 0) + 1.0)}
    base = F.create_map(*[x for kind, p in share.items() for x in (F.lit(kind), F.lit(min(max(p, 1e-6), 1 - 1e-6)))])[F.col("type")]
    weight = F.when(F.col("type") == "NAME", NAME_WEIGHT).otherwise(TERM_WEIGHT)
    own = _odds((F.col("k") + weight * base) / (F.col("n") + weight))
    scored = counts.where("term <> ''").withColumn("bits", F.when(F.col("type") == "NAME", own).otherwise(own - _odds(base)))
    told = scored.where(F.when(F.col("type") == "NAME", F.col("bits") >= least).otherwise(F.abs("bits") >= 0.25)).select("type", "term", "bits")
    types = spark.createDataFrame([(kind, "", math.log2(p / (1 - p)) if 0 < p < 1 else 0.0) for kind, p in share.items() if kind != "NAME"], "type string, term string, bits double")
    out = cut(told.union(types))
    discard(counts)
    return out


def _tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The terms that could tell something about each text."""
    for batch in batches:
        rows = []
        for s, n, t in zip(batch["src"], batch["rec_no"], batch["text"]):
            if t:
                keys = {("NAME", stem(x)) for x in _TOKEN.findall(t)} | {(p.type, x) for p in proposals(t, letter_case(t)) for x in ("", *p.terms)}
                rows += [(s, n, *k) for k in keys]
        if rows:
            yield pd.DataFrame(rows, columns=["src", "rec_no", "type", "term"])


def detect(texts: DataFrame, terms: DataFrame, least: float = LEAST_BITS) -> DataFrame:
    """(src, rec_no, text, spans) of every row of ``texts`` (src, rec_no, text); spans: array of (start, stop, type, value).

    A null text has no spans. Patterns propose spans; a span is found if its disclosure in bits, from ``terms``, reaches ``least``.
    Overlapping finds go to the first of: e-mail, address, identity number,
    phone, name. Rows are handled where they are read. The terms are broadcast if there are at
    most ``BROADCAST_TERMS``; beyond that each row's own terms come to it by a join.
    """
    spark = texts.sparkSession
    schema = "src string, rec_no long, text string, spans array<struct<start:int,stop:int,pii_type:string,pii_value:string>>"
    few = terms.select("type", "term", "bits").limit(BROADCAST_TERMS + 1).collect()
    if len(few) <= BROADCAST_TERMS:
        shared = spark.sparkContext.broadcast({(r.type, r.term): r.bits for r in few})
        rows = texts.select("src", "rec_no", "text", F.lit(None).cast("array<struct<type:string,term:string,bits:double>>").alias("own"))
    else:
        shared = spark.sparkContext.broadcast({})
        told = texts.mapInPandas(_tokens, "src string, rec_no long, type string, term string").join(terms, ["type", "term"])
        own = told.groupBy("src", "rec_no").agg(F.collect_set(F.struct("type", "term", "bits")).alias("own"))
        rows = texts.join(own, ["src", "rec_no"], "left").select("src", "rec_no", "text", F.coalesce("own", F.array().cast("array<struct<type:string,term:string,bits:double>>")).alias("own"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, bool] = {}
        every = shared.value

        def known(t: str) -> bool:
            if (x := memo.get(t)) is None:
                if len(memo) > 500_000:
                    memo.clear()
                x = memo[t] = ("NAME", stem(t)) in every
            return x

        for batch in batches:
            if not len(batch):  # an empty text column can't be handed back
                continue
            found = []
            for t, own in zip(batch["text"], batch["own"]):
                if not t:
                    found.append([])
                    continue
                case = letter_case(t)
                mine = every if own is None else {(x["type"], x["term"]): x["bits"] for x in own}
                spans = disclosed(proposals(t, case), lambda kind, term, mine=mine: mine.get((kind, term), 0.0), least)
                spans += name_spans(t, spans, case, known if own is None else lambda w, mine=mine: ("NAME", stem(w)) in mine)
                found.append([{"start": a, "stop": b, "pii_type": k, "pii_value": t[a:b]} for a, b, k in sorted(spans)])
            yield pd.DataFrame({"src": batch["src"], "rec_no": batch["rec_no"], "text": batch["text"], "spans": found})

    return rows.mapInPandas(run, schema)


def texts_of(spark: SparkSession, folder: str) -> DataFrame:
    """All message contents and fact statements: src, rec_no, text."""
    m = table(spark, folder, "messages").select(F.lit("messages").alias("src"), F.col("id").alias("rec_no"), F.col("content").alias("text"))
    f = table(spark, folder, "facts").select(F.lit("facts").alias("src"), F.col("fact_no").alias("rec_no"), F.col("statement").alias("text"))
    return spread(m.union(f))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every e-mail address, phone number, identity number, street address and personal name, as it stands in its text."""
    texts = texts_of(spark, folder)
    found = detect(texts, revealing_terms(texts.select("text")))
    return found.select("src", "rec_no", F.explode("spans").alias("s")).select("src", "rec_no", "s.pii_type", "s.pii_value").distinct()


def p3_sanitised(spark: SparkSession, folder: str) -> DataFrame:
    """Every text with typed placeholders in the place of its personal information."""
    texts = texts_of(spark, folder)
    found = detect(texts, revealing_terms(texts.select("text")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            clean = [None if t is None else sanitise(t, [(s["start"], s["stop"], s["pii_type"]) for s in spans]) for t, spans in zip(b["text"], b["spans"])]
            yield pd.DataFrame({"src": b["src"], "rec_no": b["rec_no"], "clean_text": clean})

    return found.mapInPandas(run, "src string, rec_no long, clean_text string")


QUERIES = {"p3_found": p3_found, "p3_sanitised": p3_sanitised}
SQL: dict[str, str] = {}
