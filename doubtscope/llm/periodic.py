"""Periodic runs of words, found by string synchronising sets at dyadic scales.

At scale t a position is synchronising if the content hash of the t words there, or t words on, is the
least of the window between: a choice that depends on the next 2t words only, so equal texts choose
alike. Two neighbouring positions with equal contexts of 2t words at a distance of t to 2t - 1 propose
that distance as a period, and extending it both ways gives the run. Positions whose t words have a
period of at most t / 4 are left out, else periodic stretches would make every position synchronising;
their periods are smaller than t and stand in the runs of the scales before, which also tell where
those stretches lie. Contexts are compared by exact names of substrings, made by doubling.

Why nothing is missed: let a run have smallest period p, t <= p < 2t, and length >= 4p. Among any t
places in a row one is synchronising unless 3t - 1 words there have a period of at most t / 4, which would
contradict p. Its copy p places on lies in the run with its context, so it is chosen too; and no equal
context lies between, or the run would have a smaller period.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
GROUP_WORDS = 1 << 16
_FREE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64-bit integers; never all ones for the small names it is given."""
    with np.errstate(over="ignore"):
        x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _doubled(names: np.ndarray, step: int) -> np.ndarray:
    """Names of substrings of twice the length, from names of those of length ``step``."""
    pairs = names[:-step].astype(np.int64) * (int(names.max()) + 1) + names[step:]
    return np.unique(pairs, return_inverse=True)[1].reshape(-1)


def _window_least(h: np.ndarray, width: int) -> np.ndarray:
    """Least of h[j .. j + width - 1] for every j with a whole window; width is a power of two plus one."""
    step, least = 1, h
    while step < width - 1:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    return np.minimum(least[:-1], h[width - 1 :])


def _alike(names: np.ndarray, a: int, b: int, forward: bool) -> int:
    """How many places on from a and b (or before them) names agree, a < b."""
    done, piece = 0, 32
    while True:
        if forward:
            size = min(piece, len(names) - b - done)
            same = names[a + done : a + done + size] == names[b + done : b + done + size]
        else:
            size = min(piece, a - done)
            same = (names[a - done - size : a - done] == names[b - done - size : b - done])[::-1]
        if size <= 0:
            return done
        if not same.all():
            return done + int(same.argmin())
        done, piece = done + size, piece * 2


def find_runs(names: np.ndarray, longest: int | None = None) -> list[tuple[int, int, int]]:
    """All (start, length, period) with the smallest period and length >= 4 * period, sorted.

    ``names`` are integers from 0; no run holds a value that occurs once. ``longest`` bounds the length
    of a run, where several sequences are searched in one.
    """
    runs: list[tuple[int, int, int]] = []
    n, scale = len(names), 1
    at_scale = names.astype(np.int64)
    longest = n if longest is None else longest
    while LEAST_EXPONENT * scale <= longest and 2 * scale <= n:
        contexts = _doubled(at_scale, scale)  # of 2 * scale words, at 0 .. n - 2 * scale
        h = _mixed(at_scale)  # of scale words, at 0 .. n - scale
        held = np.zeros(n + 1, np.int64)
        for start, length, period in runs:
            if LEAST_EXPONENT * period <= scale <= length:
                held[start] += 1
                held[start + length - scale + 1] -= 1
        h[np.cumsum(held)[: len(h)] > 0] = _FREE
        least = _window_least(h, scale + 1)
        chosen = np.flatnonzero((least != _FREE) & ((least == h[: len(least)]) | (least == h[scale : scale + len(least)])))
        chosen = chosen[chosen < len(contexts)]
        order = chosen[np.argsort(contexts[chosen], kind="stable")]
        gap = np.diff(order)
        proposed = (contexts[order[1:]] == contexts[order[:-1]]) & (gap >= scale) & (gap < 2 * scale)
        ends: dict[int, int] = {}
        places, periods = order[:-1][proposed], gap[proposed]
        for a, period in sorted(zip(places.tolist(), periods.tolist(), strict=True)):
            if a + period < ends.get(period, 0):
                continue
            start = a - _alike(names, a, a + period, False)
            end = a + period + _alike(names, a, a + period, True)
            ends[period] = end
            if end - start >= LEAST_EXPONENT * period:
                runs.append((start, end - start, period))
        at_scale, scale = contexts, 2 * scale
    return sorted(runs)


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each list of words: (start, length, period) by start, then period.

    The lists are searched as one sequence, parted by values that occur once and so stand in no run; words get
    names of their own in each list, so that no context spans two.
    """
    names: list[int] = []
    firsts: list[int] = []
    base = 0
    for words in texts:
        firsts.append(len(names))
        seen: dict[bytes, int] = {}
        names += [base + seen.setdefault(w, len(seen)) for w in words]
        base += len(seen) + 1
        names.append(base - 1)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if names:
        for start, length, period in find_runs(np.array(names, np.int64), max(map(len, texts))):
            if length >= LEAST_LENGTH:
                k = bisect_right(firsts, start) - 1
                found[k].append((start - firsts[k], length, period))
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    cover = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        cover[start + period] += 1
        cover[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(cover[:-1]) == 0)
    return b" ".join([words[k] for k in kept.tolist()])


FOUND = "array<struct<start:long,length:long,period:long>>"


def with_runs(docs: DataFrame, text_col: str = "text", runs_col: str = "runs", collapsed_col: str = "collapsed") -> DataFrame:
    """docs with the array of periodic runs of the words of each whole text, and the text with each run cut to its first period.

    Words are what ASCII white space parts. A run is a stretch of at least 6 words and four of its smallest periods
    that cannot be extended. A null or empty text has no run and collapses to "". Columns of these two names
    in docs are replaced; repeated rows are repeated. Rows are independent: nothing is shuffled.
    """
    rest = [c for c in docs.columns if c not in (runs_col, collapsed_col)]
    shaped = docs.select(*rest, F.lit(None).cast(FOUND).alias(runs_col), F.lit(None).cast("string").alias(collapsed_col))
    span = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col).cast(pa.binary())
            done: list[list[tuple[int, int, int]]] = []
            short: list[bytes] = []
            group: list[list[bytes]] = []

            def close() -> None:
                for words, runs in zip(group, runs_of(group), strict=True):
                    done.append(runs)
                    short.append(collapsed(words, runs))
                group.clear()

            held = 0
            for t in texts:
                words = (t.as_py() or b"").split()
                group.append(words)
                held += len(words)
                if held >= GROUP_WORDS:
                    close()
                    held = 0
            close()
            listed = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in runs] for runs in done], pa.list_(span))
            columns = {c: batch.column(c) for c in rest} | {runs_col: listed, collapsed_col: pa.array(short, pa.binary()).cast(pa.string())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = shaped.schema
    return docs.select(*rest).mapInArrow(run, schema)


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with planted periods: with h = crc32 of the id, where h is divisible by 10, the words
    from a = (h / 10) % n on repeat those at a .. a + p - 1, p = 1 + (n - a) / (3 + (h / 10) % 8), all whole
    numbers. A null id or text is left as it is."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(F.col(text_col), F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    planted = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.when(h % 10 == 0, words).alias("__w"), g.alias("__g"))
    n = F.size("__w")
    a = (F.col("__g") % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.col("__g") % 8))).cast("int")
    made = F.array_join(F.concat(F.slice("__w", 1, a), F.transform(F.sequence(F.lit(0), n - a - 1), lambda i: F.get("__w", a + i % p))), " ")
    return planted.select("doc_id", F.when(n > 0, made).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """Of (doc_id, runs, collapsed): counts, the run of greatest exponent and digests.

    Exponents are compared as fractions in doubles, which tell apart all lengths and periods below 2^26.
    """
    ranked = F.sort_array(F.transform("runs", lambda r: F.struct((-(r["length"] / r["period"])).alias("less"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))))
    best = F.get(ranked, F.lit(0))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(F.lit(1000) * best["length"] / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
