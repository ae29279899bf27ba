"""Secret scan with corpus-wide ownership frequency.

Every candidate's value is hashed, and the hash counted by distinct repositories and owners over the
whole corpus. A value that several owners have is a widely copied example; a value of one owner only
is a live-looking credential. The base patterns are reported either way; the long mixed-character
strings that the method adds are reported only when they are owner-specific.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doubtscope.llm.spans import joined, with_spans
from doubtscope.session import stored

#: What a secret looks like, by kind. Kinds are listed in order of report.
PATTERNS = {
    "assign": ("(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2),
    "access": ("AKIA[A-Z0-9]{16,}", 0),  # AKIA[A-Z0-9]+ of 20 or more: a shorter run holds no longer one
    "hex": ("[0-9a-f]{24,}", 0),
    "opaque": ("(?:\\G|(?<![A-Za-z0-9+/_=-]))[A-Za-z0-9+/_=-]{20,}", 0),
}
KINDS = list(PATTERNS)
_FOUND = "array<struct<start:int,rank:int,end:int,kind:string,hash:string>>"


def _tagged(kind: str, spans: Column) -> Column:
    rank = KINDS.index(kind)
    return F.transform(
        spans,
        lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), F.sha2(s["value"], 256).alias("hash")),
    ).cast(_FOUND)


def _apart(span: Column, others: Column) -> Column:
    return ~F.exists(others, lambda o: (o["start"] < span["end"]) & (span["start"] < o["end"]))


def candidates(docs: DataFrame, text: Column) -> DataFrame:
    """docs' columns (text aside) with ``base`` and ``opaque`` arrays of start, rank, end, kind and hash of the value."""
    rows = docs.withColumn("__text", F.coalesce(text.cast("string"), F.lit("")))
    found = with_spans(rows, "__text", PATTERNS)
    assign = F.filter("assign", lambda s: F.length(s["value"]) >= 6)
    base = F.array_sort(F.concat(*[_tagged(k, c) for k, c in (("assign", assign), ("access", F.col("access")), ("hex", F.col("hex")))]))
    mixed = F.filter("opaque", lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]"))
    kept = [c for c in docs.columns]
    based = found.select(*kept, base.alias("base"), _tagged("opaque", mixed).alias("__opaque"))
    return based.select(*kept, "base", F.filter("__opaque", lambda s: _apart(s, F.col("base"))).alias("opaque"))


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_repos, n_owners) over rows of (hash, repo, owner); each step combines before it shuffles."""
    by_owner = found.select("hash", "owner", "repo").distinct().groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return by_owner.groupBy("hash").agg(F.sum("repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", copied_owners: int = 2
) -> DataFrame:
    """One row per row of docs: (doc_id, findings), findings being an array of
    (start, rank, end, kind, hash, n_repos, n_owners, copied) by start, then kind as listed.

    ``copied`` means at least ``copied_owners`` distinct owners have the value. A null repository or
    owner counts as one unnamed one. Null and empty texts have no findings; a null id stays null;
    repeated rows are repeated, and count once. Other columns are not read.
    """
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((repo_col, "repo"), (owner_col, "owner"))]
    rows = docs.select(F.col(id_col).alias("doc_id"), *named, F.col(text_col).alias("text"))
    seen = candidates(rows.select("doc_id", "repo", "owner", "text"), F.col("text")).drop("text").withColumn("spans", F.concat("base", "opaque"))
    key = F.sha2(F.concat_ws("|", F.to_json(F.struct("doc_id", "spans"))), 256)
    seen = stored(seen.withColumn("key", F.when(F.size("spans") > 0, key)), "secret-spans")

    some = seen.where("key is not null")
    spans = some.select("key", "repo", "owner", F.explode("spans").alias("span")).distinct()
    owners = ownership(spans.select(F.col("span.hash").alias("hash"), "repo", "owner"))
    told = spans.select("key", "span").distinct().withColumn("hash", F.col("span.hash")).join(owners, "hash")
    finding = F.struct("span.*", "n_repos", "n_owners", (F.col("n_owners") >= copied_owners).alias("copied"))
    by_doc = told.where("span.kind <> 'opaque' or n_owners < %d" % copied_owners).groupBy("key").agg(F.array_sort(F.collect_list(finding)).alias("findings"))
    kind = by_doc.schema["findings"].dataType.simpleString()
    none = F.array().cast(kind)
    without = seen.where("key is null").select("doc_id", none.alias("findings"))
    return some.join(by_doc, "key", "left").select("doc_id", F.coalesce("findings", none).alias("findings")).unionByName(without)


def digest(found: DataFrame) -> DataFrame:
    """Counts per base kind, digest of the base spans, all spans, and the findings by verdict."""

    def count(keep) -> Column:
        return F.size(F.filter("findings", keep)).cast("long")

    def is_kind(kind: str):
        return lambda s: s["kind"] == kind

    base = F.filter("findings", lambda s: s["kind"] != "opaque")
    return found.select(
        "doc_id",
        *[count(is_kind(k)).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("findings")).alias("spans"),
        count(lambda s: s["copied"]).alias("n_copied"),
        count(lambda s: ~s["copied"]).alias("n_live"),
    )
