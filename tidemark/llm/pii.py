"""Personal data: patterns propose spans, checksums confirm them, nearby words set a score.

Everything is a Spark expression.  The positions of a pattern's matches come from splitting the
text by the pattern: match i begins where the first i + 1 gaps and the first i matches end.

The patterns below find the same spans as the plain ones named in their comments, but in linear
time and without recursion: a search that fails is not tried again at each further character of
the same run (``\\G`` lets one begin where the last match ended), and repeats are possessive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban")
BASE = KINDS[:4]

PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+ of 12 digits at least; a run of fewer can hold no longer one
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9]){11,}+",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
#: What a confirmed span of each kind scores by itself, and words near it that change that.
PRIOR = {"email": 0.7, "ip": 0.5, "card": 0.7, "phone": 0.5, "iban": 0.8}
NEAR = {
    "email": r"mail|contact|write|reach|@|address",
    "ip": r"\bip\b|address|host|server|client|login|from",
    "card": r"card|visa|master|amex|credit|debit|payment|pay\b|cvv|expir",
    "phone": r"phone|call|tel|mobile|cell|fax|contact|dial|whatsapp",
    "iban": r"iban|bank|account|transfer|swift|bic|konto|compte|cuenta",
}
AGAINST = {
    "email": r"example|noreply|no-reply|test",
    "ip": r"version|release|build|section|chapter|v\.?\s*$",
    "card": r"order|invoice|serial|tracking|isbn|sku|item",
    "phone": r"serial|order|invoice|formula|coordinate",
    "iban": r"serial|part\s*no|model|sku",
}
CONTEXT_CHARS, STEP = 40, 0.25


def find(text: Column, pattern: str) -> Column:
    """All matches as array<struct<start, end, match>>, in code points, end exclusive."""
    text = F.coalesce(text, F.lit(""))
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    pieces = F.arrays_zip(matches.alias("m"), gaps.alias("g"))
    none = F.expr("cast(array() as array<struct<start:int,end:int,match:string>>)")

    def add(state: Column, piece: Column) -> Column:
        start = state["at"] + piece["g"]
        end = start + F.length(piece["m"])
        return F.struct(end.alias("at"), F.concat(state["found"], F.array(F.struct(start.alias("start"), end.alias("end"), piece["m"].alias("match")))).alias("found"))

    walked = F.aggregate(F.filter(pieces, lambda p: p["m"].isNotNull()), F.struct(F.lit(0).alias("at"), none.alias("found")), add, lambda s: s["found"])
    return F.when(F.regexp_like(text, F.lit(pattern)), walked).otherwise(none)


def luhn(digits: Column) -> Column:
    """Whether a string of digits ends in its Luhn check digit."""
    doubled = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: (lambda d: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))(F.ascii(c) - 48),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN (without spaces) has the check digits that its other characters ask for."""
    moved = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))
    value = lambda c: F.when(F.ascii(c) >= 65, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    rest = F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(F.ascii(c) >= 65, a * 100 + value(c)).otherwise(a * 10 + value(c)) % 97)
    return rest == 1


def confirmed(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return F.regexp_like(F.concat(match, F.lit(".")), F.lit(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])?+\.){4}$"))
    if kind == "card":
        return F.length(digits).between(12, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        plain = F.replace(match, F.lit(" "), F.lit(""))
        return F.length(plain).between(15, 34) & mod97(plain)
    return F.lit(True)


def scored(kind: str, text: Column, start: Column, end: Column) -> Column:
    """The prior, moved up by a supporting word nearby and down by a contrary one before it."""
    before = F.lower(F.substring(text, F.greatest(start - CONTEXT_CHARS, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT_CHARS))))
    after = F.lower(F.substring(text, end + 1, F.lit(CONTEXT_CHARS // 2)))
    up = F.regexp_like(before, F.lit(NEAR[kind])) | F.regexp_like(after, F.lit(NEAR[kind]))
    return F.lit(PRIOR[kind]) + F.when(up, STEP).otherwise(0.0) - F.when(F.regexp_like(before, F.lit(AGAINST[kind])), STEP).otherwise(0.0)


def _spans(kind: str, place: int, text: Column) -> Column:
    good = F.filter(F.col(f"_{kind}"), lambda s: confirmed(kind, s["match"]))
    return F.transform(good, lambda s: F.struct(
        s["start"].alias("start"), F.lit(place).alias("place"), s["end"].alias("end"), F.lit(kind).alias("kind"),
        scored(kind, text, s["start"], s["end"]).alias("score")))


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, pii`` for every row of docs: pii is an array of structs
    (start, place, end, kind, score) sorted by start, then by the kind's place in KINDS.

    Null and empty texts have none; repeated rows scan alike; extra columns are not read.
    """
    text = F.col("text")
    found = docs.select("doc_id", "text", *[find(text, PATTERNS[k]).alias(f"_{k}") for k in KINDS])
    parts = [_spans(kind, place, text) for place, kind in enumerate(KINDS)]
    return found.select("doc_id", F.array_sort(F.concat(*parts)).alias("pii"))


def _of(kind: str):
    return lambda span: span["kind"] == kind


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(docs: DataFrame) -> DataFrame:
    """``doc_id, n_<kind>..., base_sha256, spans, max_score`` from :func:`scan`."""
    pii = F.col("pii")
    counts = [F.size(F.filter(pii, _of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    base = joined(F.filter(pii, lambda s: s["place"] < len(BASE)))
    score = F.aggregate(pii, F.lit(0.0), lambda a, s: F.greatest(a, s["score"]))
    return scan(docs).select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), joined(pii).alias("spans"), score.alias("max_score"))
