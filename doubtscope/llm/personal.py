"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doubtscope.llm.spans import joined, with_spans

#: What each kind looks like. Kinds are listed in order of report. The look-behind lets
#: a run be tried at its first character (or where the last match ended) only: later starts in the
#: same run can match no more than that one does, and long runs stay linear.
PATTERNS = {
    "email": ("(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)++", 0),
    "ip": ("(?:\\G|(?<![0-9]))[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++", 0),
    "card": ("[0-9](?:[\\x20-]?[0-9]){12,}+", 0),  # fewer than 13 digits would be dropped
    "phone": ("\\+[0-9][\\x20().0-9-]+[0-9]", 0),
    "iban": ("(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:\\x20?[A-Z0-9]{4}){2,7}(?:\\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9_])", 0),
}
KINDS = list(PATTERNS)
BASE = KINDS[:4]
#: Starting score by kind, and the words that raise it when they stand nearby.
SCORES = {"email": 80, "ip": 50, "card": 60, "phone": 60, "iban": 80}
CONTEXT = {
    "email": "mail|contact|contacto|kontakt|courriel|correo",
    "ip": "address|host|server|client|adresse|direcci",
    "card": "card|visa|mastercard|credit|payment|karte|carte|tarjeta",
    "phone": "phone|mobile|call|telefon|fax|appel",
    "iban": "iban|account|bank|konto|compte|cuenta",
}
NEAR, RAISE = 48, 20


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_valid(number: Column) -> Column:
    """Luhn's checksum of a string of digits: every second digit from the right doubled."""
    backwards = F.reverse(number)

    def step(total: Column, i: Column) -> Column:
        d = F.substring(backwards, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), step) % 10 == 0


def mod97_valid(account: Column) -> Column:
    """ISO 7064 mod 97 of an IBAN without spaces: first four characters to the end, letters as 10 to 35."""
    moved = F.concat(F.substring(account, 5, 64), F.substring(account, 1, 4))

    def step(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(code >= 65, rest * 100 + code - 55).otherwise(rest * 10 + code - 48) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1


def _confirmed(kind: str, span: Column) -> Column:
    number = digits(span["whole"])
    if kind == "ip":
        parts = F.transform(F.split(span["whole"], "\\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(number).between(13, 19) & luhn_valid(number)
    if kind == "phone":
        return F.length(number).between(9, 15)
    if kind == "iban":
        return mod97_valid(F.regexp_replace(span["whole"], "\\x20", ""))
    return F.lit(True)


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (doc_id, findings), findings being an array of (kind, start, end, score)
    by kind as listed, then start. score is 0..100: the kind's own, raised by a context word within
    NEAR characters before or after the span.

    Null and empty texts have no findings; null ids and repeated rows each get their row; an empty
    table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    found = with_spans(rows, "__text", PATTERNS)

    def scored(kind: str) -> Column:
        def one(s: Column) -> Column:
            first = F.greatest(s["start"] - NEAR, F.lit(0))
            near = F.concat_ws(" ", F.substring(F.col("__text"), first + 1, s["start"] - first), F.substring(F.col("__text"), s["end"] + 1, F.lit(NEAR)))
            score = F.lit(SCORES[kind]) + F.when(F.lower(near).rlike(CONTEXT[kind]), RAISE).otherwise(0)
            return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), score.alias("score"))

        return F.transform(F.filter(kind, lambda s: _confirmed(kind, s)), one)

    return found.select("doc_id", F.concat(*[scored(k) for k in KINDS]).alias("findings"))


def digest(found: DataFrame) -> DataFrame:
    """Counts per base kind, digest of the base spans, all spans, and the scores' sum."""

    def of(kinds: list[str]) -> Column:
        return F.filter("findings", lambda s: s["kind"].isin(kinds))

    return found.select(
        "doc_id",
        *[F.size(of([k])).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(joined(of(BASE)), 256).alias("base_sha256"),
        joined(F.col("findings")).alias("spans"),
        F.aggregate("findings", F.lit(0), lambda t, s: t + s["score"]).cast("long").alias("score_sum"),
    )
