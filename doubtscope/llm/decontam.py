"""Benchmark decontamination: a BM25 inverted index of test items, searched with block-max WAND.

A test item is cut into a question and an answer, and each is an entry of the index of its own. Every passage of every
training text is a query. The score of an entry for a passage is the BM25 sum over their common words,
divided by the score the entry gives itself, so that it reads as weighted coverage (0..1) and one threshold
serves entries of all lengths. All entries at or above the threshold are retrieved, and every retrieved passage is
verified: of the entry's five-word shingles at least ``min_overlap`` must be anywhere in the document, or, for copies
with a word changed here and there, of its words in order in one of the passages. An item is found where its question
and its answer are, however far apart. A passage is twice as long as the next power of two of the entry's length (128 words
at least), so what is found of an item does not hang on the items beside it.

The index is cut into segments of bounded size; each is broadcast and searched in turn, so neither
the driver nor a task ever holds more than one.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field, fields
from functools import reduce
from itertools import repeat
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doubtscope.functions.text import lcs_length

K1, B = 1.2, 0.75
BLOCK = 64  # postings per block
SPANS = (1024, 256)  # words bounded at once, coarse then fine, before passages are bounded and searched one by one
SHINGLE = 5
_ASCII_BREAKS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
_OTHER_BREAKS = re.compile("[\u0080-\u00a9\u00ab-\u00b4\u00b6-\u00b9\u00bb-\u00bf\u2000-\u206f\u3000-\u303f]+")


def words_of(text: str | None) -> list[bytes]:
    """Words in UTF-8, lower case; ASCII other than letters and digits, and general punctuation, separate them."""
    text = (text or "").lower()
    if not text.isascii():
        text = _OTHER_BREAKS.sub(" ", text)
    return text.encode("utf-8", "replace").translate(_ASCII_BREAKS).split()


def shingles(words: list[bytes]) -> set[bytes]:
    return {b" ".join(words[k : k + SHINGLE]) for k in range(max(1, len(words) - SHINGLE + 1))} if words else set()


def halves(words: list[bytes]) -> tuple[list[bytes], list[bytes]]:
    """Question and answer of an item that comes as one text; one part if it is too short to cut."""
    if len(words) < 2 * SHINGLE:
        return words, words
    middle = (len(words) + 1) // 2
    return words[:middle], words[middle:]


def units_of(question: list[bytes], answer: list[bytes] | None) -> list[list[bytes]]:
    """What of an item must be found: its question and its answer, without empty ones and repeats."""
    cut = halves(question) if answer is None else (question, answer)
    return [u for k, u in enumerate(cut) if u and u not in cut[:k]]


def passage_words(unit: list[bytes]) -> int:
    """Words of a passage for an entry; steps are half of it, so any run of the entry's length is inside one."""
    return max(128, 2 << (len(unit) - 1).bit_length())


@dataclass
class Index:
    """The entries of one segment that have passages of one length: postings in order of entries, cut into blocks with their maxima."""

    units: list[tuple[int, set, list]]  # per entry: its item's place, shingles, words
    terms: dict[bytes, int]
    starts: np.ndarray  # per term, into items/weights
    items: np.ndarray
    weights: np.ndarray
    passage: int
    postings: list[tuple[list, list]] = field(init=False, default_factory=list)
    block_last: list[list] = field(init=False, default_factory=list)
    block_max: list[list] = field(init=False, default_factory=list)
    term_max: list[float] = field(init=False, default_factory=list)

    def __post_init__(self):
        for a, b in zip(self.starts[:-1], self.starts[1:], strict=True):
            ids, ws = self.items[a:b], self.weights[a:b]
            self.postings.append((ids.tolist(), ws.tolist()))
            self.block_last.append([int(ids[min(k + BLOCK, b - a) - 1]) for k in range(0, b - a, BLOCK)])
            self.block_max.append([float(ws[k : k + BLOCK].max()) for k in range(0, b - a, BLOCK)])
            self.term_max.append(float(ws.max()))

    def reachable(self, ids: np.ndarray, threshold: float) -> bool:
        """Whether any item could reach the threshold if all these words were in one passage."""
        seen = np.zeros(len(self.terms), bool)
        seen[ids] = True
        at = np.flatnonzero(np.repeat(seen, self.starts[1:] - self.starts[:-1]))
        return len(at) > 0 and float(np.bincount(self.items[at], self.weights[at]).max()) >= threshold - 1e-9


@dataclass
class Segment:
    """Items, how many entries each has, and their entries by length of passage."""

    item_ids: list
    n_units: list[int]
    indexes: list[Index]


def build_segment(items: list[tuple], df: dict[bytes, int], n_items: int, mean_words: float) -> Segment:
    """Segment of (id, question words, answer words or None) rows; df and n_items are of all items, mean_words of all entries."""
    ids, n_units, by_passage = [], [], {}
    for item_id, question, answer in items:
        units = units_of(question, answer)
        if not units:
            continue
        for unit in units:
            by_passage.setdefault(passage_words(unit), []).append((len(ids), shingles(unit), unit))
        ids.append(item_id)
        n_units.append(len(units))
    indexes = []
    for passage, units in sorted(by_passage.items()):
        terms: dict[bytes, int] = {}
        rows = []
        for place, (_, _, unit) in enumerate(units):
            counts: dict[bytes, int] = {}
            for w in unit:
                counts[w] = counts.get(w, 0) + 1
            norm = K1 * (1 - B + B * len(unit) / mean_words)
            weight = {w: log(1 + (n_items - df[w] + 0.5) / (df[w] + 0.5)) * tf * (K1 + 1) / (tf + norm) for w, tf in counts.items()}
            own = sum(weight.values())
            rows += [(terms.setdefault(w, len(terms)), place, x / own) for w, x in weight.items()]
        rows.sort()
        starts = np.searchsorted(np.array([r[0] for r in rows], np.int64), np.arange(len(terms) + 1))
        indexes.append(Index(units, terms, starts, np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], float), passage))
    return Segment(ids, n_units, indexes)


def block_max_wand(index: Index, term_ids: list[int], threshold: float) -> list[tuple[int, float]]:
    """All (item, score) with score >= threshold for the distinct query terms."""
    slack = threshold - 1e-9
    lists = [[index.postings[t][0][0], 0, t] for t in term_ids]  # current item, position, term
    found = []
    while lists:
        lists.sort()
        bound, pivot = 0.0, -1
        for k, (_, _, t) in enumerate(lists):
            bound += index.term_max[t]
            if bound >= slack:
                pivot = k
                break
        if pivot < 0:
            break
        item = lists[pivot][0]
        while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
            pivot += 1
        blocks, skip_to = 0.0, None
        for _, at, t in lists[: pivot + 1]:
            last, b = index.block_last[t], at // BLOCK
            b = bisect_left(last, item, b)
            if b < len(last):
                blocks += index.block_max[t][b]
                skip_to = last[b] + 1 if skip_to is None else min(skip_to, last[b] + 1)
        if blocks >= slack:
            target = item + 1
            score = 0.0
            for entry in lists[: pivot + 1]:
                ids, weights = index.postings[entry[2]]
                at = bisect_left(ids, item, entry[1])
                if at < len(ids) and ids[at] == item:
                    score += weights[at]
            if score >= slack:
                found.append((item, score))
        else:
            beyond = lists[pivot + 1][0] if pivot + 1 < len(lists) else None
            target = skip_to if skip_to is not None else item + 1
            target = max(item + 1, target if beyond is None else min(target, beyond))
        kept = []
        for entry in lists[: pivot + 1]:
            ids = index.postings[entry[2]][0]
            at = bisect_left(ids, target, entry[1])
            if at < len(ids):
                kept.append([ids[at], at, entry[2]])
        lists = kept + lists[pivot + 1 :]
    return found


def search(segment: Segment, text: str | None, threshold: float, min_overlap: float) -> list[tuple]:
    """Verified (item id, score, overlap) of a text, by item position: the smaller of the question's and the answer's best."""
    words = words_of(text)
    if not words:
        return []
    found: dict[int, list[tuple[float, float]]] = {}
    have: set | None = None
    for index in segment.indexes:
        hits = retrieve(index, words, threshold)
        have = shingles(words) if hits and have is None else have
        for place, passages in hits.items():
            item, marks, unit = index.units[place]
            overlap = len(marks & have) / len(marks)
            for _, start in passages if overlap < 1.0 else ():
                # the passage may begin inside the copy or end in it
                near = words[max(0, start - index.passage // 2) : start + index.passage + index.passage // 2]
                overlap = max(overlap, lcs_length(unit, near) / len(unit))
            if overlap >= min_overlap:
                found.setdefault(item, []).append((max(score for score, _ in passages), overlap))
    return [
        (segment.item_ids[item], min(s for s, _ in parts), min(o for _, o in parts)) for item, parts in sorted(found.items()) if len(parts) == segment.n_units[item]
    ]


def retrieve(index: Index, words: list[bytes], threshold: float) -> dict[int, list[tuple[float, int]]]:
    """{entry: (score, first word) of every passage at or above the threshold}."""
    ids = np.fromiter(map(index.terms.get, words, repeat(-1)), np.int64, len(words))
    size, step = index.passage, index.passage // 2

    def open_spans(first: int, last: int, spans: tuple[int, ...]) -> Iterator[int]:
        """Starts of the passages in [first, last) that a bound over longer spans does not rule out."""
        if not spans:  # the last bound is over the passage itself
            for at in range(first, last, step):
                passage = ids[at : at + size]
                if index.reachable(passage[passage >= 0], threshold):
                    yield at
            return
        for at in range(first, last, max(spans[0] // step, 1) * step):
            end = min(at + max(spans[0] // step, 1) * step, last)
            span = ids[at : end + size]  # passages that start in [at, end) end before end + size
            if index.reachable(span[span >= 0], threshold):
                yield from open_spans(at, end, spans[1:])

    found: dict[int, list[tuple[float, int]]] = {}
    for start in open_spans(0, len(words), SPANS):
        terms = np.unique(ids[start : start + size])
        for place, score in block_max_wand(index, terms[terms >= 0].tolist(), threshold):
            found.setdefault(place, []).append((score, start))
    return found


def index_segments(items: DataFrame, id_col: str, text_col: str, answer_col: str | None, segment_words: int) -> Iterator[Segment]:
    """Segments of about ``segment_words`` words each; document frequencies are over all items.

    Only one segment's items are on the driver at a time. Words come from the same splitter as the
    training texts.
    """

    @F.arrow_udf(T.ArrayType(T.BinaryType()))
    def split(texts: pa.Array) -> pa.Array:
        return pa.array([words_of(t.as_py()) for t in texts], pa.list_(pa.binary()))

    answer = split(F.col(answer_col).cast("string")) if answer_col else F.lit(None).cast("array<binary>")
    rows = items.select(F.col(id_col).alias("id"), split(F.col(text_col).cast("string")).alias("question"), answer.alias("answer"))
    whole = F.concat("question", F.coalesce("answer", F.array().cast("array<binary>")))
    alone = F.when(F.size("question") < 2 * SHINGLE, 1).otherwise(2)
    n_units = F.when(F.col("answer").isNull(), alone).otherwise((F.size("question") > 0).cast("int") + (F.size("answer") > 0).cast("int"))
    n_items, n_words, entries = rows.where(F.size(whole) > 0).agg(F.count(F.lit(1)), F.sum(F.size(whole)), F.sum(n_units)).first()
    if not n_items:
        return
    n_segments = -(-n_words // segment_words)
    df = rows.select(F.explode(F.array_distinct(whole)).alias("word")).groupBy("word").count()
    place = F.pmod(F.xxhash64("question", "answer"), F.lit(n_segments))
    for segment in range(n_segments):
        part = rows.where(place == segment)
        mine = part.select(F.explode(whole).alias("word")).distinct()
        counts = {bytes(r.word): r["count"] for r in df.join(mine, "word", "left_semi").collect()}
        listed = [(r.id, [bytes(w) for w in r.question], r.answer and [bytes(w) for w in r.answer]) for r in part.orderBy("id", "question").collect()]
        yield build_segment(listed, counts, n_items, n_words / entries)


def contamination_column(session: SparkSession, text: Column, segment: Segment, threshold: float, min_overlap: float) -> Column:
    """Array of (item_id, score, overlap) for a text column against one segment, which is broadcast
    as plain values: workers need not have this package."""
    plain = [{f.name: getattr(index, f.name) for f in fields(index) if f.init} for index in segment.indexes]
    shared = session.sparkContext.broadcast((segment.item_ids, segment.n_units, plain))
    kind = T.ArrayType(
        T.StructType([T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("overlap", T.DoubleType())])
    )
    arrow = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("overlap", pa.float64())]))

    @F.arrow_udf(kind)
    def hits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ids, n_units, plain = shared.value
        segment = Segment(ids, n_units, [Index(**p) for p in plain])
        for texts in batches:
            found = (search(segment, t.as_py(), threshold, min_overlap) for t in texts)
            yield pa.array([[dict(zip(("item_id", "score", "overlap"), h, strict=True)) for h in rows] for rows in found], arrow)

    return hits(text.cast("string"))


def contaminated_pairs(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    item_answer: str | None = None,
    threshold: float = 0.6,
    min_overlap: float = 0.8,
    segment_words: int = 1_000_000,
) -> DataFrame:
    """(doc_id, item_id, score, overlap): every verified pair of a document row and an item.

    score is the best passage's share of the entry's own BM25 score, overlap the share of it that is found; of question
    and answer the smaller. Null and empty texts on either side have no pairs;
    no items or no documents give an empty result; repeated rows repeat their pairs. Of repeated
    items each id is reported. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    session = docs.sparkSession
    found = [
        rows.select("doc_id", F.inline(contamination_column(session, F.col("text"), segment, threshold, min_overlap)))
        for segment in index_segments(items, item_id, item_text, item_answer, segment_words)
    ]
    if not found:
        return session.createDataFrame([], "doc_id long, item_id long, score double, overlap double")
    return reduce(DataFrame.unionByName, found)


def keep_clean(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    item_answer: str | None = None,
    threshold: float = 0.6,
    min_overlap: float = 0.8,
    segment_words: int = 1_000_000,
) -> DataFrame:
    """The rows of docs, all columns, that hold no item."""
    for segment in index_segments(items, item_id, item_text, item_answer, segment_words):
        found = contamination_column(docs.sparkSession, F.col(text_col), segment, threshold, min_overlap)
        docs = docs.where(F.size(found) == 0)
    return docs
