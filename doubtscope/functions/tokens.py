"""Token-score functions over nested arrays. All return a ``Column`` and stay in the JVM.

A sequence is ``array<array<struct<…, logit double>>>``: one inner array of top-k entries per
token, which may be null or empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TOPK_DEFAULT = 20
HEAP_DEFAULT = 5
PATIENCE_DEFAULT = 20

_STATE = "struct<top:array<double>,idle:int,tau:int,stop:boolean>"


def token_l2(entries: Column) -> Column:
    """L2 norm of the positive part of a token's logits; null when the token has no entry."""
    # one pass names the entries once; the sum stays null until there is an entry
    squares = F.aggregate(
        entries.getField("logit"),
        F.lit(None).cast("double"),
        lambda acc, x: F.when(x > 0, F.coalesce(acc, F.lit(0.0)) + x * x).when(x.isNotNull(), F.coalesce(acc, F.lit(0.0))).otherwise(acc),
    )
    return F.sqrt(squares)


def seq_token_scores(seq: Column) -> Column:
    """Scores of the scorable tokens in order; null when there is none."""
    scores = F.filter(F.transform(seq, token_l2), lambda x: x.isNotNull())
    # by way of a one-element array the scores are named, and computed, once
    return F.get(F.filter(F.array(scores), lambda s: F.size(s) > 0), F.lit(0))


def _mean(values: Column) -> Column:
    """Mean of a non-empty array; null for an empty one. Names ``values`` once: it may be costly."""
    return F.aggregate(
        values,
        F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n")),
        lambda a, x: F.struct((a["sum"] + x).alias("sum"), (a["n"] + 1).alias("n")),
        lambda a: F.when(a["n"] > 0, a["sum"] / a["n"]),
    )


def topm_mean(scores: Column, m: int) -> Column:
    """Mean of the m highest scores; of all scores when m <= 0; null when there is none."""
    chosen = F.slice(F.sort_array(scores, asc=False), 1, m) if m > 0 else scores
    return _mean(chosen)


def _check(m: int, w: int) -> None:
    if m < 1 or w < 1:
        raise ValueError(f"heap size and patience must be at least 1, got M={m}, W={w}")


def _start() -> Column:
    return F.struct(
        F.array().cast("array<double>").alias("top"),
        F.lit(0).alias("idle"),
        F.lit(0).alias("tau"),
        F.lit(False).alias("stop"),
    ).cast(_STATE)


def _state(top: Column, idle: Column, tau: Column, stop: Column) -> Column:
    return F.struct(top.alias("top"), idle.alias("idle"), tau.alias("tau"), stop.alias("stop"))


def _step(m: int, w: int) -> Callable[[Column, Column], Column]:
    """One token: keep the m highest scores (ascending), count tokens that change nothing."""

    def step(acc: Column, x: Column) -> Column:
        top, tau = acc["top"], acc["tau"] + 1
        idle = acc["idle"] + 1
        grown = F.sort_array(F.concat(top, F.array(x)))
        swapped = F.sort_array(F.concat(F.slice(top, 2, m - 1), F.array(x))) if m > 1 else F.array(x)
        # strictly above the floor; Spark puts NaN above everything, so NaN is shut out by hand
        beats = (x > F.get(top, F.lit(0))) & ~F.isnan(x)
        return (
            F.when(F.size(top) < m, _state(grown, F.lit(0), tau, F.lit(False)))
            .when(beats, _state(swapped, F.lit(0), tau, F.lit(False)))
            .otherwise(_state(top, idle, tau, idle >= w))
        )

    return step


def _finish(acc: Column) -> Column:
    return F.struct(
        _mean(acc["top"]).alias("mean"),
        acc["tau"].alias("tau"),
        acc["stop"].alias("triggered"),
    )


def patience_agg(scores: Column, m: int = HEAP_DEFAULT, w: int = PATIENCE_DEFAULT) -> Column:
    """Mean of the m highest scores read before w tokens in a row failed to change them.

    Returns ``struct<mean, tau, triggered>``; tau is the number of scores read. Null in, null out.
    """
    _check(m, w)
    step = _step(m, w)
    return F.aggregate(
        scores, _start(), lambda a, x: F.when(a["stop"], a).otherwise(step(a, x)), _finish
    )


def patience_from_topk(seq: Column, m: int = HEAP_DEFAULT, w: int = PATIENCE_DEFAULT) -> Column:
    """``patience_agg(seq_token_scores(seq))`` in one pass: tokens past the halt are never scored."""
    _check(m, w)
    step = _step(m, w)

    def visit(acc: Column, token: Column) -> Column:
        # the one-element array binds the score, so it is computed once per token
        scored = F.aggregate(
            F.array(token_l2(token)), acc, lambda a, x: F.when(x.isNull(), a).otherwise(step(a, x))
        )
        return F.when(acc["stop"], acc).otherwise(scored)

    return F.aggregate(seq, _start(), visit, lambda a: F.when(a["tau"] > 0, _finish(a)))


def running_floor(scores: Column, m: int = HEAP_DEFAULT) -> Column:
    """Per token: score, the m-th highest score before it (null while fewer), and whether it counts.

    Returns ``array<struct<score, floor, updates>>``. The fold keeps only the tokens that count, which
    are few unless scores keep rising; the tokens between two of them share a floor and are filled
    in afterwards, so the work grows with the sequence and not with its square.
    """
    _check(m, 1)
    change = "array<struct<at:int,before:double,after:double>>"
    init = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<double>").alias("top"), F.array().cast(change).alias("changes")
    )

    def visit(acc: Column, x: Column) -> Column:
        top = acc["top"]
        full = F.size(top) >= m
        beats = ~full | ((x > F.get(top, F.lit(0))) & ~F.isnan(x))
        base = F.when(full, F.slice(top, 2, m - 1) if m > 1 else F.array().cast("array<double>")).otherwise(top)
        after = F.sort_array(F.concat(base, F.array(x)))
        floor = F.when(full, F.get(top, F.lit(0)))
        entry = F.struct(acc["at"].alias("at"), floor.alias("before"), F.when(F.size(after) >= m, F.get(after, F.lit(0))).alias("after"))
        return F.struct(
            (acc["at"] + 1).alias("at"),
            F.when(beats, after).otherwise(top).alias("top"),
            F.when(beats, F.concat(acc["changes"], F.array(entry)).cast(change)).otherwise(acc["changes"]).alias("changes"),
        )

    def fill(acc: Column) -> Column:
        """(floor, updates) of every token: the changing one, then its followers up to the next change."""

        def stretch(c: Column, k: Column) -> Column:
            end = F.coalesce(F.get(acc["changes"], k + 1)["at"], acc["at"])
            rest = F.struct(c["after"].alias("floor"), F.lit(False).alias("updates"))
            return F.concat(F.array(F.struct(c["before"].alias("floor"), F.lit(True).alias("updates"))), F.array_repeat(rest, end - c["at"] - 1))

        return F.flatten(F.transform(acc["changes"], stretch))

    filled = F.aggregate(scores, init, visit, fill)
    return F.zip_with(
        scores, filled, lambda x, f: F.struct(x.alias("score"), f["floor"].alias("floor"), f["updates"].alias("updates"))
    )


def patience_trace(scores: Column, m: int = HEAP_DEFAULT, w: int = PATIENCE_DEFAULT) -> Column:
    """``struct<tau, n_tokens, share_read, triggered>``: how much of the sequence was needed."""
    run = patience_agg(scores, m, w)
    return F.struct(
        run["tau"].alias("tau"),
        F.size(scores).alias("n_tokens"),
        F.try_divide(run["tau"].cast("double"), F.size(scores).cast("double")).alias("share_read"),
        run["triggered"].alias("triggered"),
    )


def topk_entries(candidates: Column, k: int = TOPK_DEFAULT, chosen_rank: int = 0) -> Column:
    """Per token ``map<token_id, struct<logprob, decoded_token, rank>>`` → ordered top-k entries.

    By rank if every rank is known, else by logit descending; ties keep the map's order. The entry
    of rank ``chosen_rank`` is appended when the cut lost it. A null token stays null.
    """

    def entry(e: Column) -> Column:
        value = e["value"]
        logit = F.coalesce(value["logprob"], F.lit(0.0)).cast("double").alias("logit")
        return F.struct(e["key"].alias("token_id"), value["decoded_token"].alias("token"), logit, value["rank"].alias("rank"))

    def cut(found: Column, order: Column) -> Column:
        kept = F.transform(F.slice(order, 1, k), lambda s: entry(F.get(found, s["at"])))
        lost = F.filter(F.slice(order, k + 1, F.greatest(F.size(order), F.lit(1))), lambda s: F.get(found, s["at"])["value"]["rank"] == chosen_rank)
        return F.concat(kept, F.transform(F.slice(lost, 1, 1), lambda s: entry(F.get(found, s["at"]))))

    def one_token(cand: Column) -> Column:
        found = F.map_entries(cand)
        ranks = found.getField("value").getField("rank")
        by_rank = F.transform(ranks, lambda r, i: F.struct(r.cast("double").alias("by"), i.alias("at")))
        by_logit = F.transform(
            found.getField("value").getField("logprob"),
            lambda x, i: F.struct((-F.coalesce(x, F.lit(0.0)).cast("double")).alias("by"), i.alias("at")),
        )
        # places are sorted, not entries; only entries that stay are built, and the order is worked out once
        order = F.sort_array(F.when(F.forall(ranks, lambda r: r.isNotNull()), by_rank).otherwise(by_logit))
        both = F.array(F.struct(found.alias("found"), order.alias("order")))
        return F.when(cand.isNotNull(), F.get(F.transform(both, lambda b: cut(b["found"], b["order"])), F.lit(0)))

    return F.transform(candidates, one_token)


def answer_token_index(seq: Column) -> Column:
    """Index of the last token, null when there is none."""
    return F.when(F.size(seq) > 0, F.size(seq) - 1)


def answer_token_topk(seq: Column) -> Column:
    """The last token's entries as a one-element array, null when there are none."""
    last = F.get(seq, F.size(seq) - 1)
    return F.when((F.size(seq) > 0) & last.isNotNull(), F.array(last))
