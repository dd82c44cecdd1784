"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Only built-in column functions are used. A span's place follows from the lengths of the pieces that
splitting by the pattern leaves, in code points. Patterns that repeat a group are run on a copy of
the text of equal length in which the joining character between two allowed characters is
replaced by a mark, so that each pattern repeats single characters only and takes
time in proportion to the text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from landtally.llm.spans import between, matches, running, segments

#: Kinds in order of listing.
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn")

#: Words that make a kind more likely when they stand within NEAR code points before the span.
CONTEXT = {
    "email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "mastercard", "credit", "payment"), "phone": ("phone", "call", "tel", "fax", "mobile"),
    "iban": ("iban", "bank", "account", "transfer"), "ssn": ("ssn", "social", "security", "taxpayer")}
NEAR = 40
#: Score of a confirmed span without context, and what a context word adds. Added kinds need ENOUGH.
SCORE = {"email": 0.7, "ip": 0.55, "card": 0.7, "phone": 0.55, "iban": 0.7, "ssn": 0.3}
BONUS, ENOUGH = 0.3, 0.5

_LOCAL = r"A-Za-z0-9._%+\-\x03"
_PATTERN = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9\-]++\x03[A-Za-z0-9\-\x03]++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9][0-9\x03]{11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])"}
#: Joining characters and their neighbours, for the copy of the text with marks.
_JOINED = {"email": r"(?<=[A-Za-z0-9\-])\.(?=[A-Za-z0-9\-])", "card": r"(?<=[0-9])[\x20\-](?=[0-9])"}
#: What a text must hold for a kind at all.
_HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][0-9\x20\-]{11}", "phone": r"\+[0-9]",
         "iban": r"[A-Z]{2}[0-9]{2}", "ssn": r"[0-9]-[0-9]{2}-[0-9]"}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    n = F.length(digits)

    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number, country and check digits first, leaves 1 when divided by 97."""
    plain = F.regexp_replace(iban, r"\x20", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, F.lit(1), F.lit(4)))

    def step(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code >= 65, rest * 100 + code - 55).otherwise(rest * 10 + code - 48) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _confirmed(kind: str, value: Column) -> Column:
    digits = _digits(value)
    n = F.length(digits)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3)
                        & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(n.between(12, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        return F.when(F.length(F.regexp_replace(value, r"\x20", "")).between(15, 34), mod97(value)).otherwise(F.lit(False))
    if kind == "ssn":
        return ~value.rlike(r"^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _marked(kind: str, text: Column) -> Column:
    if kind not in _JOINED:
        return text
    return F.regexp_replace(F.translate(text, "\x03", "\x04"), _JOINED[kind], "\x03")


def _proposed(kind: str, text: Column) -> Column:
    """Array of (start, value) of the pattern's matches, in code points."""
    none = F.array().cast("array<struct<start:int,value:string>>")
    return F.when(text.rlike(_HINT[kind]), matches(_marked(kind, text), _PATTERN[kind])).otherwise(none)


def _scored(rank: int, kind: str, pieces: Column) -> Column:
    """The confirmed spans of a kind with their scores; ``pieces`` are the text's segments."""
    words = r"(?i)\b(?:" + "|".join(CONTEXT[kind]) + r")\b"

    def scored(s: Column) -> Column:
        near = between(pieces, F.greatest(s["start"] - NEAR, F.lit(0)), s["start"]).rlike(words)
        return F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), (s["start"] + F.length(s["value"])).alias("end"),
                        F.lit(kind).alias("kind"), (F.lit(SCORE[kind]) + F.when(near, BONUS).otherwise(0.0)).alias("score"))

    # A mark stands for the space that joins digits, whatever the pattern joined.
    real = F.filter(f"_{kind}", lambda s: _confirmed(kind, F.translate(s["value"], "\x03", " ")))
    spans = F.transform(real, scored)
    return spans if kind in BASE else F.filter(spans, lambda s: s["score"] >= ENOUGH)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: id and ``found``, an array of (start, rank, end, kind, score) in order.

    Places are code points, ends exclusive. The base kinds are kept whatever their score; added kinds need
    a score of ENOUGH. NULL and empty texts have no spans, a NULL id is returned as it is, repeated
    rows each return a row, other columns are ignored.
    """
    text = F.coalesce(F.col("_text"), F.lit(""))
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    for kind in (*BASE, *ADDED):
        rows = rows.withColumn(f"_{kind}", _proposed(kind, text))
    some = F.size(F.concat(*[F.col(f"_{kind}") for kind in (*BASE, *ADDED)])) > 0
    rows = rows.withColumn("_pieces", F.when(some, segments(text)))
    parts = [_scored(rank, kind, F.col("_pieces")) for rank, kind in enumerate((*BASE, *ADDED))]
    return rows.select(id_col, F.array_sort(F.concat(*parts)).alias("found"))


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by base kind, the digest of the base spans and all spans as text."""
    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("found", lambda s: s["rank"] < len(BASE))
    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    return found.select(id_col, *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "<{}>") -> DataFrame:
    """``docs`` with every span replaced by its kind; overlapping spans by the kind of the first.

    The texts of documents without spans are as given, NULL included; other columns are kept.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    given = F.col("row")[text_col]
    found = find(rows.select("row", given.alias("text")), "row", "text")
    # Spans are in order; one that begins before the end of an earlier one is part of what that replaces.
    ends = running(F.transform("found", lambda s: s["end"].cast("long")), F.greatest)
    found = found.withColumn("_ends", ends).withColumn("_pieces", F.when(F.size("found") > 0, segments(given)))
    last = F.element_at("_ends", -1).cast("int")

    def put(s: Column, i: Column) -> Column:
        at = F.coalesce(F.get("_ends", i - 1), F.lit(0)).cast("int")
        names = reduce(lambda c, k: F.when(s["kind"] == k, mark.format(k)).otherwise(c), (*BASE, *ADDED), F.lit(""))
        return F.when(s["start"] < at, "").otherwise(F.concat(between(F.col("_pieces"), at, s["start"]), names))

    changed = F.concat(F.array_join(F.transform("found", put), ""), between(F.col("_pieces"), last, F.length(given)))
    text = F.when(F.size("found") > 0, changed).otherwise(given)
    return found.select(*[text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
