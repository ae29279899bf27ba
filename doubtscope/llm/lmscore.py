"""Language-model scores by online logistic mixing of hashed-context bit predictors.

Two models learn from the whole training part of the corpus, gathered in one pass that counts before it shuffles:

- the base, add-one smoothed token frequencies;
- the mixer, which reads the lower-cased words as bytes, joined by one space and closed by a line feed, and predicts
  them bit by bit. A predictor per context (the last 1, 2, 3, 4 bytes, and the beginning of the word) knows how
  often each bit followed; a table of hashed slots holds its log odds. The predictors' log odds are mixed with
  weights that a gate chooses (place of the bit, and whether the longest context is known); after each
  bit the weights move along the error, and an adaptive map from mixed odds to observed frequency
  refines the result. Every bit's probability is fixed before the bit is seen, so the score is a true log probability.

Texts are scored in lanes of numpy arrays, one block of ``BLOCK`` bytes a lane: contexts reach back over a block's
start, weights start anew there. A lane's result depends on nothing else in its batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doubtscope.session import spread, stored

END = b"\n"
ORDERS = (3, 4)
WORD_BYTES, BASE = 6, 0x9E3779B97F4A7C15  # a word's beginning counts as context up to here
#: Tasks receive at most 2^20 tokens; the others are joined. No (context, byte) pair is left out for its share:
#: CONTEXT_SHARE, below which one once was, only bounds the small corpora of the tests.
TOKEN_SHARE, CONTEXT_SHARE, LONGEST_HEAVY = 1 << 20, 1 << 21, 256
CODE_BITS, SLOT_BITS = 6, 22
CODES = 1 << CODE_BITS
BLOCK, LANES = 2048, 8192
#: Weights at the start of a block: of the orders, then of the word's beginning.
START = (0.4, 0.4, 0.3)
RATE, SLOPE_RATE, SHIFT_RATE, ODDS = 0.005, 0.002, 0.01, 8.7
_STEP = 8.0 / 127  # of the stored log odds
_WORD_TAG = 1 << 60
#: Keys of a kind and bytes of words that a task holds before it hands them on, and bytes that it counts at once: they bound its memory.
_FLUSH_KEYS, _FLUSH_TOKENS, _PIECE = 1 << 20, 1 << 25, 1 << 18

GATHERED = "kind int, token binary, key bigint, n bigint"


def held_out(doc_id: Column) -> Column:
    """True for a seventh of the ids, whose texts are never learned from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()  # of bytes: only A-Z fold, only ASCII white space parts


def _finished(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32)


def _powers(n: int, base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.r_[np.uint64(1), np.full(max(0, n - 1), base, np.uint64)], dtype=np.uint64)


#: A byte's factor by its place in the word; those past WORD_BYTES count nothing.
WORD_POWERS = np.r_[_powers(WORD_BYTES, BASE), np.uint64(0)]


def word_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the bytes of the current word before each place, at most the first WORD_BYTES of them.

    A word's bytes are a polynomial in ``BASE`` modulo 2^64; differences of one running sum give it for all places.
    """
    edges = np.flatnonzero((data == 32) | (data == 10)) + 1
    starts = np.r_[0, edges[: np.searchsorted(edges, len(data))]]
    sizes = np.diff(starts, append=len(data))
    into = np.arange(len(data)) - np.repeat(starts, sizes)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data + np.uint64(1)) * WORD_POWERS.take(np.minimum(into, WORD_BYTES, out=into)), out=sums[1:])
        return _finished(sums[:-1] - np.repeat(sums[starts], sizes))


def gram_keys(data: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every byte that ``text`` marks, none of the first four: the four before it and itself as one number; and its word context and itself."""
    pairs = data[:-1].astype(np.uint16) << np.uint16(8) | data[1:]
    fours = pairs[:-2].astype(np.uint32) << np.uint32(16) | pairs[2:]
    byte, marked = data[text], text[4:]
    last = fours[:-1][marked].astype(np.int64) << 8
    word = word_hashes(data)[text].astype(np.int64) << 8
    word |= _WORD_TAG
    return last | byte, word | byte


def words_in(data: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of joined texts, in order, and the place where each begins; the data begin and close with an edge."""
    inner = (data != 32) & (data != 10)
    turns = np.flatnonzero(inner[1:] != inner[:-1]) + 1
    starts, ends = turns[::2], turns[1::2]
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inner])]), starts


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's counts. Empties the lists, so that the parts are not held beside their whole."""
    k, n = np.concatenate(keys), np.concatenate(counts)
    keys.clear()
    counts.clear()
    order = np.argsort(k)
    k, n = k[order], n[order]
    del order
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]][: len(k)])
    return k[first], np.add.reduceat(n, first) if len(first) else n


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``GATHERED`` from the texts of a task. A token or pair may come in several of them; what is held at once is bounded."""
    schema = pa.schema([("kind", pa.int32()), ("token", pa.binary()), ("key", pa.int64()), ("n", pa.int64())])

    def rows(kind: int, values: pa.Array | np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(values), 1 << 17):
            part = values[at : at + (1 << 17)]
            columns = [pa.array(np.full(len(part), kind, np.int32)), pa.nulls(len(part), pa.binary()) if kind else part.cast(pa.binary()), pa.array(part) if kind else pa.nulls(len(part), pa.int64()), pa.array(n[at : at + (1 << 17)])]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    words: list[pa.Array] = []  # of a piece each
    ends = 0
    keys: tuple[list[np.ndarray], ...] = ([], [])  # of last bytes, of words: merged apart, so that half of them is copied at a time
    counts: tuple[list[np.ndarray], ...] = ([], [])
    buffer = bytearray()
    starts: list[int] = []

    def count_bytes() -> None:
        data = np.frombuffer(bytes(buffer), np.uint8)
        text = np.ones(len(data), bool)  # the four line feeds before each text are context only
        text[(np.array(starts)[:, None] + np.arange(4)).reshape(-1)] = False
        buffer.clear()
        starts.clear()
        words.append(words_in(data)[0])
        for row, ks, ns in zip(gram_keys(data, text), keys, counts, strict=True):
            k, n = np.unique(row, return_counts=True)
            ks.append(k)
            ns.append(n)

    def tokens() -> Iterator[pa.RecordBatch]:
        found = pa.chunked_array(words, pa.large_binary()).value_counts()
        words.clear()
        yield from rows(0, found.field("values"), found.field("counts").to_numpy())

    for batch in batches:
        for t in batch.column(0).cast(pa.binary()):
            ends += 1
            starts.append(len(buffer))
            buffer += END * 4 + b" ".join(words_of(t.as_py())) + END
            if len(buffer) >= _PIECE:
                count_bytes()
                for ks, ns in zip(keys, counts, strict=True):
                    if sum(map(len, ks)) >= _FLUSH_KEYS:
                        k, n = _merged(ks, ns)
                        if len(k) >= _FLUSH_KEYS // 2:
                            yield from rows(1, k, n)
                        else:
                            ks.append(k)
                            ns.append(n)
                        del k, n
                if sum(w.nbytes for w in words) >= _FLUSH_TOKENS:
                    yield from tokens()
    if buffer:
        count_bytes()
    for ks, ns in zip(keys, counts, strict=True):
        if ks:
            yield from rows(1, *_merged(ks, ns))
    yield from tokens()
    if ends:
        yield from rows(0, pa.array([END]), np.array([ends]))


def gather(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Counts over all texts: (kind 0, token, null, n) and (kind 1, null, (context, byte), n), each once."""
    found = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(counted, GATHERED)
    return found.groupBy("kind", "token", "key").agg(F.sum("n").alias("n"))


def byte_codes(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of each byte, nats on top) from the counts of the bytes.

    The 63 most frequent bytes have codes of their own; all others share the last one, and what tells them
    apart costs their add-one frequency among themselves.
    """
    order = np.lexsort((np.arange(256), -n))
    codes = np.full(256, CODES - 1)
    codes[order[: CODES - 1]] = np.arange(CODES - 1)
    rare = order[CODES - 1 :]
    more = np.zeros(256)
    more[rare] = np.log((n[rare].sum() + len(rare)) / (n[rare] + 1.0))
    return codes, more


def _lines(contexts: np.ndarray) -> np.ndarray:
    """First slot of a context's line; the line has a slot for every node of a code's tree of bits."""
    with np.errstate(over="ignore"):
        x = contexts * np.uint32(0x9E3779B1)
        x = (x ^ (x >> np.uint32(15))) * np.uint32(0xC2B2AE35)
        return (x >> np.uint32(32 - SLOT_BITS)) & np.uint32((1 << SLOT_BITS) - CODES)


def odds_table(contexts: np.ndarray, codes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Stored log odds of a one, per slot, from counts of (context, code that followed); 0 where nothing is known."""
    return cell_odds(_lines(contexts.astype(np.uint32)).astype(np.int64) + codes, n)


def cell_odds(cells: np.ndarray, n: np.ndarray) -> np.ndarray:
    """As ``odds_table`` from counts of cells: a context's line plus the code that followed."""
    lines, codes = cells & -CODES, cells & (CODES - 1)
    ones, total = np.zeros(1 << SLOT_BITS), np.zeros(1 << SLOT_BITS)
    for bit in range(CODE_BITS):
        slot = lines + ((1 << bit) | (codes >> (CODE_BITS - bit)))
        total += np.bincount(slot, n, 1 << SLOT_BITS)
        ones += np.bincount(slot, n * ((codes >> (CODE_BITS - 1 - bit)) & 1), 1 << SLOT_BITS)
    odds = np.log((ones + 0.4) / (total - ones + 0.4))
    return np.where(total > 0, np.clip(np.rint(odds / _STEP), -127, 127), 0).astype(np.int8)


def cell_counts(grams: DataFrame, order: int, codes: np.ndarray) -> DataFrame:
    """(cell, n): how often each code followed in each line of a predictor's table, over all pairs of ``gather``.

    ``order`` 0 is the beginning of the word. A table has 2^16 lines of 64 codes: 2^22 cells, whatever the corpus.
    """
    schema = pa.schema([("cell", pa.int32()), ("n", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy()
            context = key >> 8 & (((1 << 8 * order) - 1) if order else 0xFFFFFFFF)
            cell = _lines(context.astype(np.uint32)).astype(np.int64) + codes[key & 255]
            cells, n = _merged([cell], [batch.column(1).to_numpy()])
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(n, pa.int64())], schema=schema)

    kind = F.col("key") < _WORD_TAG if order else F.col("key") >= _WORD_TAG
    return grams.where(kind).select("key", "n").mapInArrow(work, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))


def fit_predictors(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(one row of slots per predictor, code of each byte, nats on top of a code) from the counts of ``gather``.

    Every (context, byte) pair counts. Pairs are added up by cell before they are collected, so a predictor
    has at most 2^22 numbers to collect.
    """
    grams = counts.where("kind = 1")
    bytes_read = grams.where(F.col("key") < _WORD_TAG).groupBy(F.col("key").bitwiseAND(255).alias("byte")).agg(F.sum("n").alias("n")).collect()
    n = np.zeros(256, np.int64)
    for r in bytes_read:
        n[r.byte] = r.n
    codes, more = byte_codes(n)
    tables = []
    for order in (*ORDERS, 0):
        found = cell_counts(grams, order, codes).toArrow()
        tables.append(cell_odds(found["cell"].to_numpy().astype(np.int64), found["n"].to_numpy()))
    return np.stack(tables), codes, more


def _lanes(texts: list[bytes]) -> Iterator[tuple[int, bytes, int, int, int]]:
    """(text, block, last four bytes before it as a number, polynomial of the word begun, place in it) for every block of every text."""
    for number, text in enumerate(texts):
        for at in range(0, len(text), BLOCK):
            before = (END * 4 + text[max(0, at - 4) : at])[-4:]
            begun = max(text.rfind(b" ", 0, at) + 1, 0)
            h = sum((byte + 1) * pow(BASE, k, 1 << 64) for k, byte in enumerate(text[begun : min(at, begun + WORD_BYTES)])) & (1 << 64) - 1
            yield number, text[at : at + BLOCK], int.from_bytes(before), h, min(at - begun, WORD_BYTES)


def squash(odds: np.ndarray) -> np.ndarray:
    """Probability of log odds, cut at ODDS: the logistic function by a quotient of polynomials, so that the same
    additions and products give the same digits on every machine."""
    y = np.maximum(odds, np.float32(-ODDS))
    np.minimum(y, np.float32(ODDS), out=y)
    y *= np.float32(0.5)
    z = y * y
    over = z * np.float32(21)
    over += np.float32(1260)
    over *= z
    over += np.float32(10395)
    over *= y
    under = np.add(z, np.float32(210), out=y)
    under *= z
    under += np.float32(4725)
    under *= z
    under += np.float32(10395)
    over /= under
    over *= np.float32(0.5)
    over += np.float32(0.5)
    return over


class Mixer:
    """Bits of texts under the predictors' tables; the state of a lane is its weights, slopes and shifts.

    The gate goes by the bit's place in its code, so the bits of a byte use different sets of weights
    and can be handled at once: each set sees one bit of every byte, in order. For that the odds along a code's
    path lie together, eight bytes for a line and code: one look at a predictor's table gives them for all bits.
    """

    def __init__(self, tables: np.ndarray, codes: np.ndarray, more: np.ndarray):
        self.k, self.more = len(tables), more
        self.codes = codes.astype(np.uint8).tobytes()
        self.paths = np.zeros((tables.size // CODES, CODES, 8), np.int8)
        for lines, paths in zip(np.split(tables.reshape(-1, CODES), 64 * self.k), np.split(self.paths, 64 * self.k), strict=True):  # what a cache holds
            for bit in range(CODE_BITS):
                paths.reshape(len(lines), 1 << bit, -1, 8)[..., bit] = lines[:, 1 << bit : 2 << bit, None]
        self.paths = self.paths.reshape(-1).view(np.int64)
        self.offsets = (np.arange(self.k) << SLOT_BITS)[:, None]

    def _group(self, lanes: list[tuple[int, bytes, int, int, int]]) -> np.ndarray:
        """Nats that each lane's block takes; lanes are in order of falling length."""
        width, k = len(lanes), self.k
        sizes = np.array([len(b) for _, b, _, _, _ in lanes])
        data = np.zeros((width, int(sizes[0]) + 64), np.uint8)  # rows of 2^11 bytes would share few places of a cache
        for row, (_, block, _, _, _) in zip(data, lanes, strict=True):
            row[: len(block)] = np.frombuffer(block, np.uint8)
        data = np.ascontiguousarray(data[:, : sizes[0]].T)
        coded = np.frombuffer(data.tobytes().translate(self.codes), np.uint8).reshape(data.shape)
        last = np.array([x[2] for x in lanes], np.uint32)
        word = np.array([x[3] for x in lanes], np.uint64)
        into = np.array([x[4] for x in lanes], np.intp)
        start = np.array(START, np.float32) * np.float32(_STEP)  # for odds as they are stored
        weights = np.tile(np.repeat(start[:, None], width, axis=1), (CODE_BITS, 1, 1))
        slopes, shifts = np.ones((CODE_BITS, width), np.float32), np.zeros((CODE_BITS, width), np.float32)
        cost, rate = np.zeros(width), np.float32(RATE * _STEP * _STEP)
        longer = np.searchsorted(-sizes, -np.arange(data.shape[0])).tolist()  # lanes longer than each place
        masks = np.array([(1 << 8 * o) - 1 for o in ORDERS], np.uint32)[:, None]
        place = np.arange(CODE_BITS - 1, -1, -1, dtype=np.uint8)[:, None]
        seen, read = np.empty((k, width), np.uint32), np.empty((CODE_BITS, k, width), np.float32)
        both = np.empty((2, CODE_BITS, width), np.float32)
        with np.errstate(over="ignore"):
            for at in range(data.shape[0]):
                n = longer[at]
                byte, code = data[at, :n], coded[at, :n]
                np.bitwise_and(last[:n], masks, out=seen[:-1, :n])
                seen[-1, :n] = _finished(word[:n])
                slots = _lines(seen[:, :n]) + self.offsets
                slots += code
                odds = read[:, :, :n]
                odds[:] = self.paths[slots].view(np.int8).reshape(k, n, 8)[:, :, :CODE_BITS].transpose(2, 0, 1)
                bits = (code >> place & np.uint8(1)).astype(np.float32)
                w, slope, shift, x = weights[:, :, :n], slopes[:, :n], shifts[:, :n], both[:, :, :n]
                dot = np.einsum("jkn,jkn->jn", w, odds, out=x[0])
                np.multiply(slope, dot, out=x[1])
                x[1] += shift
                p, refined = squash(x)
                off = bits - p
                off *= rate
                odds *= off[:, None]
                w += odds
                p += refined
                p *= np.float32(0.5)
                np.subtract(bits, refined, out=off)
                shift += np.multiply(off, np.float32(SHIFT_RATE), out=refined)
                off *= dot
                off *= np.float32(SLOPE_RATE)
                slope += off
                bits -= np.float32(1)
                p += bits
                nats = -np.log(np.multiply.reduce(np.abs(p, out=p), axis=0, dtype=np.float64))  # of the chance given to the bits that came
                rare = np.flatnonzero(code == CODES - 1)  # only bytes without a code of their own have more
                nats[rare] += self.more[byte[rare]]
                cost[:n] += nats
                last[:n] = (last[:n] << np.uint32(8)) | byte
                inner = (byte != 32) & (byte != 10)
                word[:n] += (byte + np.uint64(1)) * WORD_POWERS.take(into[:n])
                word[:n] *= inner
                into[:n] += 1
                np.minimum(into[:n], WORD_BYTES, out=into[:n])
                into[:n] *= inner
        return cost

    def nats(self, texts: list[bytes]) -> np.ndarray:
        """What each text takes, in nats."""
        out = np.zeros(len(texts))
        lanes = sorted(_lanes(texts), key=lambda x: -len(x[1]))
        for at in range(0, len(lanes), LANES):
            group = lanes[at : at + LANES]
            np.add.at(out, [x[0] for x in group], self._group(group))
        return out


def _sliced(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about 16 MB of text, whole rows."""
    for batch in batches:
        sizes = np.diff(np.frombuffer(batch.column(column).cast(pa.large_binary()).buffers()[1], np.int64)[: batch.num_rows + 1])
        part = np.cumsum(sizes) >> 24
        cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, batch.num_rows]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b > a:
                yield batch.slice(a, b - a)


def known_and_others(texts: list[bytes], heavy: pa.Array, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """Per text: how many tokens it has, how many of them are heavy, the sum of their logs, its other tokens, and how often each of these comes."""
    words, starts = words_in(np.frombuffer(END + b"".join(texts), np.uint8))
    n = np.diff(np.searchsorted(starts, np.cumsum([len(t) for t in texts])), prepend=0)
    owner = np.r_[np.repeat(np.arange(len(texts)), n), np.arange(len(texts))]  # the ends come after all words
    coded = pa.concat_arrays([words, pa.array([END] * len(texts), pa.large_binary())]).dictionary_encode()
    at, ids = pc.index_in(coded.dictionary, heavy).fill_null(-1).to_numpy(zero_copy_only=False), coded.indices.to_numpy()
    base = np.bincount(owner, np.r_[logs, 0.0][at][ids], len(texts))
    other = (at < 0)[ids]
    pairs, times = np.unique(owner[other] * len(at) + ids[other], return_counts=True)
    offsets = pa.array(np.searchsorted(pairs, np.arange(len(texts) + 1) * len(at)), pa.int32())
    tokens = coded.dictionary.take(pa.array(pairs % len(at))).cast(pa.binary())
    known = n + 1 - np.bincount(owner[other], minlength=len(texts))
    return n + 1, known, base, pa.ListArray.from_arrays(offsets, tokens), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32()))


SCORED = "doc_id {}, held_out boolean, k1 long, k2 long, n_tokens long, known long, base double, score double, others array<binary>, times array<int>"


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    Learns from rows that are not held out. A null text is empty: its one token is the end. With nothing to learn
    from, the base gives every token 1 and the mixer every bit 1/2. Repeated rows and null ids each get
    their row; other columns are not read. ``score`` is rounded to 6 digits.

    The base needs the exact count of every token. Tokens of at least a 2^20th of all are looked up in
    the task, so no key of the join that finds the others is hot through training tokens; each row's
    sums come back under a 128-bit digest of its id and text.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    named = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    rows = spread(named).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", "doc_id", F.lit(1)).alias("k2"), "text"
    )
    counts = stored(gather(rows.where(~F.col("held_out"))), "lm-counts")
    tokens = counts.where("kind = 0").select("token", F.col("n").alias("c"))
    all_tokens, distinct = tokens.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    below = all_tokens + distinct + 1
    heavy = tokens.where((F.col("c") * TOKEN_SHARE >= all_tokens) & (F.length("token") <= LONGEST_HEAVY)).toArrow()  # at most TOKEN_SHARE rows
    logs = heavy["token"].combine_chunks().cast(pa.large_binary()), np.log10((heavy["c"].to_numpy() + 1) / below)
    shared = spark.sparkContext.broadcast((fit_predictors(counts), logs))  # arrays of bounded size
    names = SCORED.format("x").replace(",", "").split()[8::2]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictors, logs = shared.value
        mixer = Mixer(*predictors)
        for batch in _sliced(batches, "text"):
            texts = [b" ".join(words_of(t.as_py())) + END for t in batch.column("text").cast(pa.large_binary())]
            n, known, base, others, times = known_and_others(texts, *logs)
            scores = np.round(-mixer.nats(texts) / np.log(10), 6)
            columns = [pa.array(n), pa.array(known), pa.array(base), pa.array(scores), others, times]
            kept = ["doc_id", "held_out", "k1", "k2"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + columns, names=kept + names)

    scored = stored(rows.mapInArrow(work, SCORED.format(rows.schema["doc_id"].dataType.simpleString())), "lm-scored")
    listed = scored.select("k1", "k2", F.explode(F.arrays_zip("others", "times")).alias("x")).select("k1", "k2", F.col("x.others").alias("token"), F.col("x.times").alias("n"))
    others = listed.join(tokens.hint("shuffle_hash"), "token", "left")
    c = F.coalesce(F.col("c"), F.lit(0))
    sums = others.groupBy("k1", "k2").agg(F.sum(F.col("n") * F.log10((c + 1) / F.lit(float(below)))).alias("more"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more_known"))
    copies = scored.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"))  # rows of one id and text have added up
    whole = scored.join(copies.join(sums, ["k1", "k2"]), ["k1", "k2"], "left")
    return whole.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce(F.expr("more_known div copies"), F.lit(0))).alias("n_known"),
        F.lit(all_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce(F.col("more") / F.col("copies"), F.lit(0.0))).alias("base_score"),
        "score",
    )
