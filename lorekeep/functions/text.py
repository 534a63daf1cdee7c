"""Text expressions. Each takes and returns columns; null handling is stated per function."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE = r"^[\x00-\x20]+|[\x00-\x20]+$"


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def blank_to_null(c: Column) -> Column:
    return F.when(F.regexp_replace(c, r"[\x00-\x20]+", "") != "", c)


def normalize(c: Column) -> Column:
    """Trimmed of control characters and spaces, lower-cased, inner white space collapsed; null becomes ''."""
    return F.regexp_replace(F.lower(F.regexp_replace(or_empty(c), _EDGE, "")), r"[ \t\n\x0B\f\r]+", " ")


def condition_text(m: Column) -> Column:
    """A map as ``k=v`` pairs in key order joined by ``;``: equal maps give equal texts; null is the empty map."""
    entries = F.array_sort(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>"))))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), or_empty(e["value"]))), ";")


def canonical_key(owner: Column, scope: Column, project: Column, subject: Column, predicate: Column, conditions: Column) -> Column:
    """The identity of an assertion as one text: normalised parts and the conditions as they are."""
    return F.concat_ws("|", *[normalize(x) for x in (owner, scope, project, subject, predicate)], condition_text(conditions))


def fold_yo(c: Column) -> Column:
    return F.translate(F.lower(c), "ё", "е")


def flat(c: Column) -> Column:
    """For containment tests: lower case, yo folded, white space collapsed and stripped; null becomes ''."""
    return F.trim(F.regexp_replace(fold_yo(or_empty(c)), r"[\s\p{Z}]+", " "))


def contains_span(text: Column, span: Column) -> Column:
    """Whether the flat text contains the flat span; a blank span is contained nowhere."""
    return (flat(span) != "") & F.contains(flat(text), flat(span))


# What is taken out of answers, and how a marker is bounded.
_GROUPING = r"(?<=\d)[ \u00A0\u202F',](?=\d{3}(?!\d))"
_MARKUP = r"[*_`#\"]"
_NOT_AFTER, _NOT_BEFORE = r"(?<![\p{L}\p{N}])\Q", r"\E(?![\p{L}\p{N}])"


def strip_thousands(c: Column) -> Column:
    """Group separators between a digit and exactly three digits removed: 19 544, 19,544 and 19'544 become 19544."""
    return F.regexp_replace(c, _GROUPING, "")


def answer_text(c: Column) -> Column:
    """An answer as markers are searched in it: lower case, yo folded, mark-up characters and group separators removed."""
    return strip_thousands(F.regexp_replace(fold_yo(or_empty(c)), _MARKUP, ""))


def prepared(answer: Column) -> Column:
    """struct(text, words) of an answer, null for a null one: what markers are looked up in, made once for all of them."""
    text = answer_text(answer)
    return F.when(answer.isNotNull(), F.struct(text.alias("text"), F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)).alias("words")))


def marker_in(ready: Column, marker: Column) -> Column:
    """Whether the marker occurs in a prepared answer as whole words; false if either is null or the marker is blank.

    A marker of one word is looked up among the words; only others need a pattern of their own.
    """
    m = strip_thousands(F.regexp_replace(fold_yo(or_empty(marker)), r"^\s+|\s+$", ""))
    # a lower-cased marker can't hold the \E that would end the quotation
    quoted = F.concat(F.lit(_NOT_AFTER), m, F.lit(_NOT_BEFORE))
    found = F.when(m.rlike(r"^[\p{L}\p{N}]+$"), F.array_contains(ready["words"], m)).otherwise(F.regexp_like(ready["text"], quoted))
    return F.when(ready.isNull() | (m == ""), False).otherwise(found)


def matches_marker(answer: Column, marker: Column) -> Column:
    return marker_in(prepared(answer), marker)


def _of_markers(answer: Column, markers: Column, keep) -> Column:
    """The markers for which ``keep`` holds; the array of one element makes the prepared answer a value that no marker computes again."""
    ms = F.coalesce(markers, F.array().cast("array<string>"))
    return F.element_at(F.transform(F.array(prepared(answer)), lambda ready: F.filter(ms, lambda m: keep(ready, m))), 1)


def missed(answer: Column, must: Column) -> Column:
    """The markers of ``must`` that the answer lacks; null ``must`` is empty."""
    return _of_markers(answer, must, lambda ready, m: ~marker_in(ready, m))


def hit(answer: Column, must_not: Column) -> Column:
    """The markers of ``must_not`` that the answer has; null is empty."""
    return _of_markers(answer, must_not, lambda ready, m: marker_in(ready, m))


def fact_line(statement: Column, subject: Column, predicate: Column, obj: Column) -> Column:
    """The statement if not blank, else the non-blank ones of subject, predicate, object joined by a middle dot."""
    return F.coalesce(blank_to_null(statement), F.concat_ws(" · ", blank_to_null(subject), blank_to_null(predicate), blank_to_null(obj)))


def speaker(peer: Column) -> Column:
    """User for user, human and null, Assistant for assistant and ai, any other peer as it is."""
    p = F.lower(peer)
    return F.when(peer.isNull() | p.isin("user", "human"), "User").when(p.isin("assistant", "ai"), "Assistant").otherwise(peer)


def owner_of(peer: Column) -> Column:
    """``user-x`` becomes ``user:x``; other peers stay."""
    return F.regexp_replace(F.lower(F.trim(peer)), r"^user-", "user:")


def portrait_owner(session: Column, owner: Column) -> Column:
    """Benchmark sessions (``lme-`` prefix) have an owner of their own."""
    return F.when(session.startswith("lme-"), F.concat(F.lit("user:"), session)).otherwise(owner)


def portrait_project(session: Column, project: Column) -> Column:
    """Benchmark sessions (``lme-`` prefix) are a project of their own."""
    return F.when(session.startswith("lme-"), session).otherwise(project)


def duration_text(seconds: Column) -> Column:
    """h:mm:ss of whole seconds; null stays null."""
    s = seconds.cast("long")
    return F.when(s.isNotNull(), F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60))


def progress(done: Column, total: Column, seconds: Column) -> Column:
    """struct(percent, per_minute, left): whole percent, items a minute, and the time left as text; null where nothing can be said."""
    rate = F.when((seconds > 0) & (done > 0), done / seconds)
    return F.struct(
        F.when(total > 0, F.floor(done * 100 / total)).alias("percent"), F.round(rate * 60, 1).alias("per_minute"), duration_text(F.floor((total - done) / rate)).alias("left")
    )


def cut_text(c: Column, n: int, mark: str = "…") -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit(mark))).otherwise(c)


def literal(vector: Column) -> Column:
    """A vector as text, ``[0.1,0.2]``; null stays null."""
    return F.to_json(vector.cast("array<double>"))


def parse_vector(c: Column) -> Column:
    """array<double> from such a text; null if it is null or unreadable."""
    return F.from_json(c, "array<double>")


def base64_text(c: Column) -> Column:
    """UTF-8 text in base64 on one line."""
    return F.translate(F.base64(F.encode(c, "UTF-8")), "\r\n", "")


def from_base64(c: Column) -> Column:
    return F.decode(F.unbase64(c), "UTF-8")


def short(fp: Column) -> Column:
    """The first twelve characters of a fingerprint; the word ``null`` for null."""
    return F.coalesce(F.left(fp, F.lit(12)), F.lit("null"))


def row_key(*parts: Column) -> Column:
    """A key made from values alone, in the form of a UUID: equal values give equal keys, and null differs from ''."""
    h = F.sha2(F.concat_ws("\x01", *[F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts]), 256)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def point_fingerprint(answer_fp: Column, trigger: Column, session: Column, message: Column) -> Column:
    """What an answer to a point depends on: the answering set-up, the trigger and where it stands; not what is expected of it."""
    return fingerprint("point-v1", **{"answer-fp": answer_fp, "trigger": F.sha2(or_empty(trigger), 256), "session": session, "message": message})


# Fixed values within: session names and the projects they stand for.
def project_of(session: Column) -> Column:
    """The project that a session's name tells: its directory, or the default one."""
    s = or_empty(session)
    named = F.concat(F.lit("project:"), F.regexp_replace(F.regexp_replace(s, "^per-directory-opencode-", ""), "-[^-]+$", ""))
    return F.when(session.isNull() | F.contains(s, F.lit("jrestly")), "project:jrestly").when(s.startswith("per-directory-opencode-"), named).otherwise("project:libx")


def fingerprint(version: str, **lines: Column) -> Column:
    """SHA-256 of a version line and one ``name=value`` line for each value; null values are empty."""
    return F.sha2(F.concat_ws("\n", F.lit(version), *[F.concat(F.lit(f"{k}="), or_empty(v.cast("string"))) for k, v in lines.items()]), 256)
