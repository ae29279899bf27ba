"""Language identification by compression with per-language zstandard dictionaries.

A language is what its dictionary compresses best: each text is cut into chunks, every chunk is
compressed once per language against that language's raw-content dictionary, and the language with
the smallest total wins. Case is folded on both sides: shouting is no language of its own. Texts whose best and second language lie too close together are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

UNKNOWN = "und"
CHUNK = 4096
LEVEL = 6
RESULT = T.StructType(
    [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
)


def held_out(doc_id: Column) -> Column:
    """True for a third of the ids, whose labels are never learned from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_dictionaries(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", samples: int = 256, excerpt: int = 1024, dict_bytes: int = 1 << 17
) -> dict[str, bytes]:
    """Raw-content dictionaries learned from labelled rows: {language: UTF-8 text}.

    Bounded sample, by parameter: per language ``samples`` distinct texts, or all where there are fewer
    (drawn and ordered by a hash of the text, copies counting once), of each an excerpt of ``excerpt`` characters, together ``dict_bytes`` bytes.
    Rows without label or text do not count. Languages come from the labels; each adds at most
    ``dict_bytes`` to what tasks receive.
    """
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where(
        "lang is not null and length(trim(text)) > 0"
    )
    # of distinct texts, by a sketch within 1 %: rows would thin out the texts of a language made of copies
    counts = dict(rows.groupBy("lang").agg(F.approx_count_distinct("text", 0.01)).collect())
    if not counts:
        return {}
    share = F.element_at(F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, 4 * samples / n + 64 / n))]), F.col("lang"))
    order = F.xxhash64("text")
    drawn = (
        rows.where(F.pmod(order, F.lit(1 << 30)) < share * float(1 << 30))
        .select("lang", order.alias("order"), F.substring("text", 1, excerpt).alias("part"))
        .distinct()
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("order", "part")))
        .where(F.col("rank") <= samples)
        .collect()
    )
    parts: dict[str, list] = {}
    for row in sorted(drawn, key=lambda r: (r.lang, r["rank"])):
        parts.setdefault(row.lang, []).append(row.part.lower().encode())
    return {lang: b"\n".join(texts)[:dict_bytes] for lang, texts in parts.items()}


def compressors(dictionaries: dict[str, bytes]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    """(language, compressor) in order of name."""
    made = []
    for lang, content in sorted(dictionaries.items()):
        learned = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        learned.precompute_compress(level=LEVEL)
        made.append((lang, zstandard.ZstdCompressor(dict_data=learned, write_checksum=False, write_content_size=False, write_dict_id=False)))
    return made


def classify(text: bytes | None, languages: list[tuple[str, zstandard.ZstdCompressor]], min_margin: float) -> tuple[str, float, bool]:
    """(language, score, rejected) of UTF-8 text.

    score is the gap between the second and the best language as a share of the second's size,
    stretched to 0..1. Ties go to the language that comes first by name.
    """
    words = (text or b"").decode("utf-8", "replace").lower()
    if not languages or not any(map(str.isalpha, words)):
        return UNKNOWN, 0.0, True
    text = words.encode()
    chunks = [text[k : k + CHUNK] for k in range(0, len(text), CHUNK)]
    sizes = sorted((sum(len(c.compress(x)) for x in chunks), lang) for lang, c in languages)
    if len(sizes) == 1:
        return sizes[0][1], 1.0, False
    margin = 1.0 - sizes[0][0] / sizes[1][0]
    return sizes[0][1], min(1.0, 4.0 * margin), margin < min_margin


def language_column(text: Column, dictionaries: dict[str, bytes], min_margin: float = 0.002) -> Column:
    """Struct (lang_pred, score, rejected) for a text column; every whole text is compressed."""

    @F.arrow_udf(RESULT)
    def language(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        languages = compressors(dictionaries)
        for texts in batches:
            found = [classify(t.as_py(), languages, min_margin) for t in texts.cast(pa.binary())]
            yield pa.StructArray.from_arrays(
                [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))],
                names=RESULT.names,
            )

    return language(text.cast("string"))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_margin: float = 0.002) -> DataFrame:
    """One row per row of docs: (doc_id, held_out, lang_pred, score, rejected).

    Learns from rows with label, text and an id that is not held out. A text that is null or has no
    letter is ``und`` with score 0 and rejected, as is every text if there is nothing to learn from.
    Repeated rows and null ids each get their row; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    dictionaries = fit_dictionaries(rows.where(~held_out(F.col("doc_id"))))
    found = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), language_column(F.col("text"), dictionaries).alias("found"))
    return found.select("doc_id", "held_out", "found.*")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_margin: float = 0.002) -> DataFrame:
    """The rows of docs, all columns, whose language is not rejected."""
    labelled = docs.where(~held_out(F.col(id_col)))
    dictionaries = fit_dictionaries(labelled, text_col, lang_col)
    return docs.where(~language_column(F.col(text_col), dictionaries, min_margin)["rejected"])
