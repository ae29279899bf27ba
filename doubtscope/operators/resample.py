"""Bootstrap of the detection metrics.

Two ways to the same distribution:

- ``split`` (the default): what a resample draws from n rows, counted per distinct score and class, is multinomial. The counts
  are drawn top down: first how many draws are wrong answers, then, halving again and again, how many fall in
  each range of scores, then on each score of a range. Every split is a binomial keyed by (seed, node), so
  a task works out the totals below its own range by a few splits, without seeing other ranges, and
  gives back five numbers per resample. Cost: distinct scores x resamples, whatever the number of rows.
- ``draws``: every draw picks up its row by a digest that SQL can repeat. Rows are packed in blocks that go to the
  tasks; a task counts a resample's draws in its block by score and class, so draws are never stored or
  shuffled. Where one block has all rows the task finishes the metrics; else the counts are shuffled and ranked by
  ``running_totals``. Time: rows x resamples, times blocks: of 2^26 rows with up to 2^16 scores and classes, else of 2^23.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doubtscope.functions.mixing import digest_ints, draw_below
from doubtscope.operators.metrics import NAN, detection_table, finite_only, score_cells
from doubtscope.operators.prefix import dense_index, with_ranges
from doubtscope.session import stored

RESAMPLES_DEFAULT = 1000
METRICS = ["auroc", "aurac", "balanced_acc"]


def resample_draws(spark, n_rows: int, n_resamples: int, seed: int) -> DataFrame:
    """(resample, row_index): n draws with replacement per resample, the same on every run."""
    n = F.lit(n_rows).cast("bigint")
    draws = spark.range(0, n_resamples * n_rows).select(
        F.expr(f"id div {n_rows}L").alias("resample"), (F.col("id") % n).alias("at")
    )
    return draws.select(
        "resample", draw_below(n, F.lit(seed), F.col("resample"), F.col("at")).alias("row_index")
    )


#: Rows of a block that a task looks draws up in, whatever their scores: a task makes all draws of a resample for each of its blocks.
BLOCK_ROWS = 1 << 23
#: Where no run has more distinct scores and classes than this, a code takes two bytes at most and a block holds eight times the rows.
FEW_CELLS = 1 << 16
#: Rows that are packed at a time, and draws that are counted at a time.
PACK_ROWS, PIECE = 1 << 20, 1 << 16
#: Rows, at most a block, up to which a task that has drawn a resample also measures it; with a dozen arrays of them it stays in some 200 MB.
WHOLE_ROWS = 1 << 21
_PACKED = "run_id int, block long, piece long, at binary, width int, codes binary, unc binary, flags binary"
_COUNTED = "run_id int, resample long, unc double, ok boolean, times long"


def drawn_rows(n: int, seed: int, resample: int) -> Iterator[np.ndarray]:
    """The row indices of ``resample_draws`` for one resample, piece by piece."""
    for drawn in digest_ints(f"{seed}:{resample}:", n):
        whole = drawn // np.uint64(n)  # several times as quick as the remainder itself
        whole *= np.uint64(n)
        drawn -= whole
        yield drawn.view(np.int64)


def _pack(piece: pd.DataFrame) -> pd.DataFrame:
    """One row per piece of a block: the place of each row in it (empty if they are 0, 1, 2 …), the code of its score and class, and the codes' meaning."""
    piece = piece.sort_values("at")
    unc, flags, codes = _distinct(piece["unc"].to_numpy(np.float64), piece["flags"].to_numpy(np.int8))
    width = _width(len(unc))
    at = piece["at"].to_numpy(np.int32)
    dense = (at == np.arange(len(at))).all()
    parts = b"" if dense else at.tobytes(), width, codes.astype(f"u{width}").tobytes(), unc.tobytes(), flags.tobytes()
    return pd.DataFrame([(*(int(piece[c].iloc[0]) for c in ("run_id", "block", "piece")), *parts)], columns=[c.split()[0] for c in _PACKED.split(", ")])


def _distinct(unc: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The scores and the flags of distinct pairs (scores by their bits), and the code of each row."""
    bits, at = np.unique(unc.view(np.int64), return_inverse=True)
    pairs, codes = np.unique(at * 8 + flags, return_inverse=True)
    return bits[pairs // 8].view(np.float64), (pairs % 8).astype(np.int8), codes


def _width(cells: int) -> int:
    return 1 if cells <= 1 << 8 else 2 if cells <= 1 << 16 else 4


def _block_rows(flagged: DataFrame, n_rows: int) -> int:
    """Rows of a block: more where codes are short and every row is there, as then the codes are all that a task holds."""
    if n_rows <= BLOCK_ROWS:
        return BLOCK_ROWS
    cells = flagged.groupBy("run_id", "unc", "flags").agg(F.count(F.lit(1)).alias("n"))
    most = cells.groupBy("run_id").agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("n")).agg(F.max("cells"), F.min("n"), F.max("n")).first()
    return BLOCK_ROWS << 3 if (most[0] or 0) <= FEW_CELLS and most[1] == most[2] == n_rows else BLOCK_ROWS


def _dealt_blocks(rows: DataFrame, n_rows: int, n_resamples: int, runs: int) -> tuple[DataFrame, int]:
    """(packed blocks of rows, each once per part, parts): part k of a block makes the resamples k, k + parts, …

    The pieces of a block and part lie in one partition, one after the other.
    """
    flags = "cast(if(unc is null, 1, 0) + case when ok is null then 2 when ok then 4 else 0 end as byte) as flags"
    flagged = rows.selectExpr("int(run_id) as run_id", "row_index", "coalesce(unc, 0D) as unc", flags)
    size = _block_rows(flagged, n_rows)
    step = min(size, PACK_ROWS)
    placed = flagged.selectExpr("run_id", f"row_index div {size}L * {size}L as block", f"row_index % {size}L div {step}L * {step}L as piece", f"int(row_index % {step}L) as at", "unc", "flags")
    packed = stored(placed.groupBy("run_id", "block", "piece").applyInPandas(_pack, _PACKED), "resample-blocks")
    tasks, blocks = max(1, 2 * rows.sparkSession.sparkContext.defaultParallelism), max(1, -(-n_rows // size))
    parts = max(1, min(n_resamples, -(-tasks // max(1, runs))))
    numbers = rows.sparkSession.range(0, parts).withColumnRenamed("id", "part")
    # blocks and parts go to the tasks in turn: dealt by a hash, some tasks would have several and others none
    turn = F.expr(f"int(pmod((run_id * {blocks}L + block div {size}L) * {parts}L + part, {tasks}L))")
    return packed.crossJoin(F.broadcast(numbers)).repartitionById(tasks, turn).sortWithinPartitions("run_id", "block", "part", "piece"), parts


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Run, block, part and codes of one block after the other, from its pieces."""
    pieces: list[dict] = []
    for batch in batches:
        for k in range(batch.num_rows):
            piece = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
            if pieces and any(piece[c] != pieces[0][c] for c in ("run_id", "block", "part")):
                yield _joined(pieces)
                pieces = []
            pieces.append(piece)
        del batch
    if pieces:
        yield _joined(pieces)


def _joined(pieces: list[dict]) -> dict:
    """One block of its pieces, with codes that all pieces share."""
    kinds = [(np.frombuffer(p.pop("unc")), np.frombuffer(p.pop("flags"), np.int8)) for p in pieces]
    scores, flags, shared = _distinct(*(np.concatenate([kind[i] for kind in kinds]) for i in (0, 1)))
    kind, sizes = f"u{_width(len(scores))}", [len(p["codes"]) // p["width"] for p in pieces]
    codes, rows, met = np.empty(sum(sizes), kind), 0, 0
    dense, places = True, []
    for p, n, (unc, _) in zip(pieces, sizes, kinds, strict=True):
        codes[rows : rows + n] = shared[met : met + len(unc)].astype(kind)[np.frombuffer(p.pop("codes"), f"u{p['width']}")]
        dense &= not p["at"] and p["piece"] == rows
        rows, met = rows + n, met + len(unc)
    if not dense:
        places = [p["piece"] + (np.frombuffer(p["at"], np.int32) if p["at"] else np.arange(n)) for p, n in zip(pieces, sizes, strict=True)]
    at = None if dense else np.concatenate(places).astype(np.int32)
    return {c: pieces[0][c] for c in ("run_id", "block", "part")} | {"codes": codes, "at": at, "unc": scores, "flags": flags}


def _drawn_times(x: dict, n_rows: int, n_resamples: int, parts: int, seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """(resample, how often each code of block ``x`` is drawn) for the resamples of its part."""
    codes, at, low, cells = x["codes"], x["at"], x["block"], len(x["unc"])
    for resample in range(x["part"], n_resamples, parts):
        if at is None:
            yield resample, _counted_codes(drawn_rows(n_rows, seed, resample), codes, low, n_rows, cells)
            continue
        size = int(at[-1]) + 1
        met = np.zeros(size, np.int32)
        for drawn in drawn_rows(n_rows, seed, resample):
            here = drawn[(drawn >= low) & (drawn < low + size)] - low
            np.add.at(met, here, 1)
        yield resample, np.bincount(codes, met[at], cells).astype(np.int64)


def _counted_codes(draws: Iterator[np.ndarray], codes: np.ndarray, low: int, n_rows: int, cells: int) -> np.ndarray:
    """How often each of the codes of the rows from ``low`` on is drawn: looked up at once, counted many at a time."""
    times, held, waiting = np.zeros(cells, np.int64), [], 0
    for drawn in draws:
        if len(codes) < n_rows:
            drawn = drawn[(drawn >= low) & (drawn < low + len(codes))] - low
        held.append(codes[drawn])
        waiting += len(drawn)
        if waiting >= max(PIECE, cells):
            times += np.bincount(np.concatenate(held), minlength=cells)
            held, waiting = [], 0
    if held:
        times += np.bincount(np.concatenate(held), minlength=cells)
    return times


def drawn_cells(rows: DataFrame, n_rows: int, n_resamples: int, seeds: dict[int, int]) -> DataFrame:
    """(run_id, resample, unc, ok, times): how often a resample of n_rows draws meets a score and class.

    ``rows`` has run_id, row_index, unc, ok; a row_index may be missing or repeated within a run.
    """
    dealt, parts = _dealt_blocks(rows, n_rows, n_resamples, len(seeds))
    schema = pa.schema([("run_id", pa.int32()), ("resample", pa.int64()), ("unc", pa.float64()), ("ok", pa.bool_()), ("times", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _whole_blocks(batches):
            unc, flags = x["unc"], x["flags"]
            for resample, times in _drawn_times(x, n_rows, n_resamples, parts, seeds[x["run_id"]]):
                k = np.flatnonzero(times)
                columns = [
                    pa.array(np.full(len(k), x["run_id"], np.int32)),
                    pa.array(np.full(len(k), resample, np.int64)),
                    pa.array(unc[k], mask=(flags[k] & 1).astype(bool)),
                    pa.array((flags[k] & 4).astype(bool), mask=(flags[k] & 2).astype(bool)),
                    pa.array(times[k]),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return dealt.mapInArrow(count, _COUNTED)


def _drawn_metrics(rows: DataFrame, n_rows: int, n_resamples: int, seeds: dict[int, int], thresholds: dict[int, float] | None) -> DataFrame:
    """auroc, aurac, balanced_acc per run and resample of ``rows`` as in ``drawn_cells``; one-class resamples are left out.

    Up to WHOLE_ROWS rows are one block, whose task has all draws of a resample: it finishes the metrics, and what is shuffled does
    not grow with rows x resamples. Of more rows the counted cells of all blocks are ranked by ``running_totals``.
    """
    if n_rows > WHOLE_ROWS:
        cells = drawn_cells(rows, n_rows, n_resamples, seeds)
        at = None if thresholds is None else f"element_at(map({', '.join(f'{r}, double({str(thresholds[r])!r})' for r in seeds)}), run_id)"
        table = detection_table(cells, ["run_id", "resample"], metrics=[*METRICS, "n_ranked", "n_wrong"], at=at, times="times")
        return table.filter((F.col("n_wrong") > 0) & (F.col("n_wrong") < F.col("n_ranked"))).select("run_id", "resample", *METRICS)
    dealt, parts = _dealt_blocks(rows, n_rows, n_resamples, len(seeds))
    names = ["run_id", "resample", *METRICS]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _whole_blocks(batches):
            unc, flags, cut = x["unc"], x["flags"], None if thresholds is None else thresholds[x["run_id"]]
            null, wrong, right = (flags & 1) > 0, (flags & 6) == 0, (flags & 6) == 4
            ranked = np.isfinite(unc) & ~null
            score, place = np.unique(unc[ranked], return_inverse=True)
            above = unc >= np.inf if cut is None else (unc >= cut) | np.isnan(unc)  # NaN is above all, a null score on neither side
            out = []
            for resample, times in _drawn_times(x, n_rows, n_resamples, parts, seeds[x["run_id"]]):
                w, r = (np.bincount(place, np.where(kind, times, 0)[ranked], len(score)).astype(np.int64)[None] for kind in (wrong, right))
                p, n, none = w.sum(axis=1), r.sum(axis=1), np.zeros(1, np.int64)
                if p[0] and n[0]:
                    found = range_metrics(score, w, r, none, none, p, n, np.inf)
                    pairs = float(p[0]) * float(n[0])
                    balanced = (1.0 + max(found["j"][0], 0.0) / pairs) / 2
                    if cut is not None:
                        balanced = (times[wrong & above & ~null].sum() / times[wrong].sum() + times[right & ~above & ~null].sum() / times[right].sum()) / 2
                    out.append((x["run_id"], resample, found["wins"][0] / (2 * pairs), found["covered"][0] * (0.9 / 19), balanced))
            if out:
                kinds = [pa.int32(), pa.int64(), *[pa.float64()] * 3]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return dealt.mapInArrow(measure, "run_id int, resample long, auroc double, aurac double, balanced_acc double")


METHODS = ("split", "draws")
#: Drawn counts that a task holds at a time.
HELD = 1 << 22


def _binomial(n: np.ndarray, share: float, *node: int) -> np.ndarray:
    """One binomial draw per resample, the same wherever this node of the tree is worked out."""
    return np.random.default_rng([x & 0xFFFFFFFF for x in node]).binomial(n, min(max(share, 0.0), 1.0))


def draws_in_range(weights: np.ndarray, at: int, n: np.ndarray, *node: int) -> tuple[np.ndarray, np.ndarray]:
    """(draws below range ``at``, draws in it) of n draws per resample over ranges with these weights.

    Halves the ranges and follows the half that holds ``at``: one binomial per level.
    """
    low, high, below = 0, len(weights), np.zeros_like(n)
    while high - low > 1:
        middle, whole = (low + high) // 2, weights[low:high].sum()
        left = _binomial(n, weights[low:middle].sum() / whole if whole else 0.0, *node, low, high)
        if at < middle:
            high, n = middle, left
        else:
            low, n, below = middle, n - left, below + left
    return below, n


def range_metrics(score, wrong, right, wrong_below, right_below, all_wrong, all_right, at) -> dict[str, np.ndarray]:
    """What one range of ascending scores adds to the metrics, per resample: arrays are resamples x scores."""
    up_wrong, up_right = wrong_below[:, None] + np.cumsum(wrong, axis=1), right_below[:, None] + np.cumsum(right, axis=1)
    flagged, passed = (all_wrong[:, None] - up_wrong + wrong).astype(float), (all_right[:, None] - up_right + right).astype(float)
    upto, n = up_wrong + up_right, all_wrong + all_right
    cuts = (n[:, None] - 1) * (19 + 9 * np.arange(20)) // 190
    here = (cuts >= (wrong_below + right_below)[:, None]) & (cuts < upto[:, -1:])
    covered = np.zeros(len(upto))
    for r in np.flatnonzero(here.any(axis=1)):
        k = np.searchsorted(upto[r], cuts[r][here[r]], side="right")
        covered[r] = (up_right[r][k] / upto[r][k]).sum()
    above = score >= at
    return {
        "wins": (right * (2.0 * (all_wrong[:, None] - up_wrong) + wrong)).sum(axis=1),
        "j": (flagged * all_right[:, None] - passed * all_wrong[:, None]).max(axis=1),
        "covered": covered,
        "caught": wrong[:, above].sum(axis=1),
        "passed": right[:, ~above].sum(axis=1),
    }


_SPLIT = "run_id int, resample long, wins double, j double, covered double, caught long, passed long, p long, n long, w_rows long, r_rows long"


def _split_metrics(rows: DataFrame, seeds: dict[int, int], thresholds: dict[int, float] | None, n_resamples: int) -> DataFrame:
    """auroc, aurac, balanced_acc per run and resample of (run_id, unc, ok), by multinomial splitting."""
    cells = stored(score_cells(rows, ["run_id"]), "resample-cells")
    # stored, so that every task sees the same ranges; with other ranges a seed draws other resamples
    ranged = stored(with_ranges(cells.filter("n_wrong + n_right > 0"), "score").select("run_id", "__range", "score", "n_wrong", "n_right"), "resample-ranges")
    # a row per run and range of scores, and the few scores that cannot be ranked
    totals = ranged.groupBy("run_id", "__range").agg(F.sum("n_wrong").alias("w"), F.sum("n_right").alias("r")).collect()
    odd = cells.filter("n_wrong + n_right = 0").select("run_id", "score", F.col("w_all").alias("w"), F.col("r_all").alias("r")).collect()
    size = 1 + max((t["__range"] for t in totals), default=0)
    plan: dict[int, list] = {}
    for run in seeds:
        plan[run] = [np.zeros(size, np.int64), np.zeros(size, np.int64), sorted(((x.score is None, x.score or 0.0, x.w, x.r) for x in odd if x.run_id == run), key=str)]
    for t in totals:
        plan[t.run_id][0][t["__range"]], plan[t.run_id][1][t["__range"]] = t.w, t.r

    def measure(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        run, block = int(key[0]), int(key[1])
        wrong, right, odd = plan[run]
        seed, at = seeds[run], float("inf") if thresholds is None else thresholds[run]
        n = int(wrong.sum() + right.sum() + sum(x[2] + x[3] for x in odd))
        left, left_weight, caught, passed, extra_w, extra_r = np.full(n_resamples, n if n > 1 else 0), n, 0, 0, 0, 0
        for k, (null, score, w, r) in enumerate(odd):  # draws of scores that are not ranked come first
            for kind, weight in ((0, w), (1, r)):
                drawn = _binomial(left, weight / left_weight if left_weight else 0.0, seed, 0, k, kind)
                left, left_weight = left - drawn, left_weight - weight
                if kind:
                    extra_r = extra_r + drawn
                    passed = passed + drawn * (not null and score < at)
                else:
                    extra_w = extra_w + drawn
                    caught = caught + drawn * (not null and not score < at)
        all_wrong = _binomial(left, wrong.sum() / left_weight if left_weight else 0.0, seed, 1, 0, 0)
        all_right = left - all_wrong
        below_w, here_w = draws_in_range(wrong, block, all_wrong, seed, 2)
        below_r, here_r = draws_in_range(right, block, all_right, seed, 3)
        cells = cells.sort_values("score")
        score, w, r = (cells[c].to_numpy() for c in ("score", "n_wrong", "n_right"))
        rng, parts, step = np.random.default_rng([seed & 0xFFFFFFFF, 4, block]), [], max(1, HELD // len(score))
        for a in range(0, n_resamples, step):
            part = slice(a, a + step)
            drawn = [rng.multinomial(k[part], x / x.sum()) if x.sum() else np.zeros((len(k[part]), len(x)), np.int64) for k, x in ((here_w, w), (here_r, r))]
            parts.append(pd.DataFrame(range_metrics(score, *drawn, below_w[part], below_r[part], all_wrong[part], all_right[part], at)))
        out = pd.concat(parts, ignore_index=True)
        if block == int(np.flatnonzero(wrong + right)[0]):
            out["caught"], out["passed"] = out["caught"] + caught, out["passed"] + passed
        out = out.assign(p=all_wrong, n=all_right, w_rows=all_wrong + extra_w, r_rows=all_right + extra_r, resample=np.arange(n_resamples), run_id=run)
        return out[["run_id", "resample", "wins", "j", "covered", "caught", "passed", "p", "n", "w_rows", "r_rows"]]

    found = ranged.groupBy("run_id", "__range").applyInPandas(measure, _SPLIT)
    whole = found.groupBy("run_id", "resample").agg(
        *[F.sum(c).alias(c) for c in ("wins", "covered", "caught", "passed")], *[F.max(c).alias(c) for c in ("j", "p", "n", "w_rows", "r_rows")]
    )
    balanced = "(1D + greatest(j, 0D) / (cast(p as double) * n)) / 2" if thresholds is None else "(caught / w_rows + passed / r_rows) / 2"
    return whole.filter("p > 0 and n > 0").selectExpr(
        "run_id", "resample", "wins / (2D * p * n) as auroc", "covered * (0.9D / 19) as aurac", f"{balanced} as balanced_acc"
    )


def resample_metrics(
    df: DataFrame,
    order: str,
    n_resamples: int = RESAMPLES_DEFAULT,
    seed: int = 0,
    threshold: float | None = None,
    unc: str = "unc",
    ok: str = "ok",
    finite: bool = True,
    method: str = "split",
) -> DataFrame:
    """auroc, aurac, balanced_acc per resample; one-class resamples are left out.

    ``order`` is the unique numeric column that numbers the rows (for ``draws``). Balanced accuracy is taken at
    ``threshold``, or at each resample's own best threshold when it is None.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}, expected one of {METHODS}")
    rows = finite_only(df, unc) if finite else df
    if method == "split":
        one = rows.select(F.lit(0).alias("run_id"), F.col(unc).cast("double").alias("unc"), F.col(ok).alias("ok"))
        return _split_metrics(one, {0: seed}, None if threshold is None else {0: threshold}, n_resamples).drop("run_id")
    rows = rows.select(F.col(order).alias("__order"), F.col(unc).cast("double").alias("unc"), F.col(ok).alias("ok"))
    # two numbers and a flag per row, stored once: what made the scores is not run per resample
    indexed = stored(dense_index(rows, "__order", "row_index").drop("__order"), "resample-rows")
    n_rows = indexed.count()
    if n_rows < 2:
        n_resamples = 0
    one = indexed.withColumn("run_id", F.lit(0))
    return _drawn_metrics(one, n_rows, n_resamples, {0: seed}, None if threshold is None else {0: threshold}).drop("run_id")


def resample_runs(
    scored: DataFrame, order: str, seeds: dict[int, int], thresholds: dict[int, float], n_resamples: int = RESAMPLES_DEFAULT, method: str = "split"
) -> DataFrame:
    """auroc, aurac, balanced_acc per run and resample of (run_id, order, unc, ok), all runs in one job.

    Every run scores the same rows; each has its own seed and its own threshold for balanced accuracy.
    """
    if method == "split":
        return _split_metrics(scored.select("run_id", F.col("unc").cast("double").alias("unc"), "ok"), seeds, thresholds, n_resamples)
    index = stored(dense_index(scored.select(F.col(order).alias("__order")).distinct(), "__order", "row_index"), "resample-index")
    n_rows = index.count()
    rows = scored.join(index, F.col(order) == F.col("__order")).select("run_id", "row_index", F.col("unc").cast("double").alias("unc"), "ok")
    rows = stored(rows, "resample-rows")
    return _drawn_metrics(rows.filter(F.col("run_id").isin(sorted(seeds))), n_rows, n_resamples if n_rows > 1 else 0, seeds, thresholds)


def _rounded(c: Column) -> Column:
    return F.coalesce(F.round(c, 3), F.lit(NAN))


def _per_metric(values: DataFrame, shape, keys: list[str] | None = None) -> DataFrame:
    """One row per metric (and key). Without keys there is a row even without resamples."""
    keys = keys or []
    one = values.groupBy(*keys).agg(*[shape(F.col(m)).alias(m) for m in METRICS])
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("r")) for m in METRICS])
    return one.select(*keys, F.explode(rows).alias("m")).select(*keys, "m.metric", "m.r.*")


def _interval(v: Column) -> Column:
    v = F.when(~F.isnan(v), v)
    return F.struct(
        _rounded(F.avg(v)).alias("mean"),
        _rounded(F.stddev_pop(v)).alias("std"),
        _rounded(F.percentile(v, F.lit(0.025))).alias("ci_low"),
        _rounded(F.percentile(v, F.lit(0.975))).alias("ci_high"),
    )


def bootstrap_metrics(df: DataFrame, order: str, **how) -> DataFrame:
    """(metric, mean, std): mean and population deviation over resamples, rounded to 3 digits."""
    return _per_metric(
        resample_metrics(df, order, **how),
        lambda v: F.struct(_rounded(F.avg(v)).alias("mean"), _rounded(F.stddev_pop(v)).alias("std")),
    )


def bootstrap_ci(df: DataFrame, order: str, finite: bool = False, **how) -> DataFrame:
    """As ``bootstrap_metrics`` with the 2.5 and 97.5 percentiles; NaN results are left out."""
    return _per_metric(resample_metrics(df, order, finite=finite, **how), _interval)


def bootstrap_runs_ci(scored: DataFrame, order: str, seeds: dict[int, int], thresholds: dict[int, float],
                      n_resamples: int = RESAMPLES_DEFAULT, method: str = "split") -> DataFrame:
    """(run_id, metric, mean, std, ci_low, ci_high) of every run."""
    return _per_metric(resample_runs(scored, order, seeds, thresholds, n_resamples, method), _interval, ["run_id"])


def seed_report(df: DataFrame, keys: list[str], value: str = "mean") -> DataFrame:
    """Mean and population deviation of a per-seed value; finite only, NaN when there is none."""
    x = F.col(value)
    kept = F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)
    return df.groupBy(*keys).agg(
        F.coalesce(F.avg(kept), F.lit(NAN)).alias("mean_of_bootstrapped_means"),
        F.coalesce(F.stddev_pop(kept), F.lit(NAN)).alias("std_across_seeds"),
    )
