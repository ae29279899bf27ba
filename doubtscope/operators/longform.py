"""The early-halting score over token *rows*, for sequences too long to hold as one array.

The rule is an ordered fold, but it is worked out as a parallel scan over blocks of consecutive positions. What
the heap holds before a block follows from a small summary of all tokens before it, and summaries merge:
the m highest scores, which of the first m tokens were NaN (those keep their place), and a count. So every
block replays alone, from the heap it starts with, and gives back one row: its first and last update, where it
halts by itself, and its heap at that place. Idle runs across blocks come from running totals over these
rows. No task and no row holds more than one block of tokens, or the summaries of ``FAN`` blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doubtscope.functions.tokens import HEAP_DEFAULT, PATIENCE_DEFAULT
from doubtscope.operators.prefix import running_totals
from doubtscope.session import stored

BLOCK_DEFAULT = 4096
FAN = 1024  # blocks, or groups of blocks, whose summaries are merged in one row

_NONE = "named_struct('n', 0L, 'top', cast(array() as array<double>), 'odd', cast(array() as array<boolean>))"


def _merged(a: str, b: str, m: int) -> str:
    """SQL of the summary of tokens a followed by tokens b: count, m highest, NaN flags of the first m."""
    return (
        f"named_struct('n', {a}.n + {b}.n, 'top', slice(sort_array(concat({a}.top, {b}.top), false), 1, {m}),"
        f" 'odd', slice(concat({a}.odd, {b}.odd), 1, {m}))"
    )


def _heap(s: str, m: int) -> str:
    """SQL of the ascending heap after the tokens of a summary; NaN comes last."""
    odd = f"size(filter({s}.odd, x -> x))"
    return f"sort_array(concat(array_repeat(double('NaN'), {odd}), slice({s}.top, 1, {m} - {odd})))"


def _before(parts: DataFrame, keys: list[str], order: str, m: int) -> DataFrame:
    """(keys, order, before, whole): for every summary ``s`` the merged summary of those before it within
    its keys, and of all of them."""
    rows = f"sort_array(collect_list(struct({order}, s)))"
    start = f"named_struct('s', {_NONE}, 'seen', cast(array() as array<struct<at:bigint,before:struct<n:bigint,top:array<double>,odd:array<boolean>>>>))"
    step = f"(a, e) -> named_struct('s', {_merged('a.s', 'e.s', m)}, 'seen', concat(a.seen, array(named_struct('at', e.{order}, 'before', a.s))))"
    folded = parts.groupBy(*keys).agg(F.expr(rows).alias("rows")).select(*keys, F.expr(f"aggregate(rows, {start}, {step})").alias("f"))
    return folded.select(*keys, F.col("f.s").alias("whole"), F.explode("f.seen").alias("e")).select(*keys, F.col("e.at").alias(order), "e.before", "whole")


def _replay(m: int, w: int) -> str:
    """SQL fold of one block's ordered scores from the heap ``start``; ordinals count from 1, 0 is none."""
    init = "named_struct('top', start, 'n', 0, 'first', 0, 'last', 0, 'halt', 0)"
    put = "named_struct('top', {top}, 'n', a.n + 1, 'first', {first}, 'last', {last}, 'halt', {halt})"
    first = "if(a.first = 0, a.n + 1, a.first)"
    grow = put.format(top="sort_array(concat(a.top, array(e.score)))", first=first, last="a.n + 1", halt="0")
    swap = put.format(top=f"sort_array(concat(slice(a.top, 2, {m - 1}), array(e.score)))", first=first, last="a.n + 1", halt="0")
    wait = put.format(top="a.top", first="a.first", last="a.last", halt=f"if(a.last > 0 and a.n + 1 - a.last >= {w}, a.n + 1, 0)")
    return (
        f"aggregate(tokens, {init}, (a, e) -> case when a.halt > 0 then a when size(a.top) < {m} then {grow}"
        f" when e.score > a.top[0] and not isnan(e.score) then {swap} else {wait} end)"
    )


def patience_long(tokens: DataFrame, m: int = HEAP_DEFAULT, w: int = PATIENCE_DEFAULT,
                  block: int = BLOCK_DEFAULT) -> DataFrame:
    """(seq, pos, score or null) → (seq, mean, tau, triggered); equals ``patience_agg``."""
    if m < 1 or w < 1 or block < 1:
        raise ValueError("heap size, patience and block must be at least 1")
    # read twice: making the scores again costs more. Rows of tokens, as no stored row holds a whole block
    tokens = stored(tokens.select("seq", "pos", "score"), "long-tokens")
    parts = tokens.groupBy("seq", F.expr(f"pos div {block}").alias("block")).agg(
        F.expr("sort_array(collect_list(if(score is null, null, struct(pos, score)))) as tokens")
    )
    whole = (
        f"named_struct('n', cast(size(tokens) as bigint), 'top', slice(sort_array(filter(transform(tokens, t -> t.score), x -> not isnan(x)), false), 1, {m}),"
        f" 'odd', transform(slice(tokens, 1, {m}), t -> isnan(t.score)))"
    )
    summaries = stored(parts.select("seq", "block", F.expr(f"block div {FAN} as stretch"), F.expr(whole).alias("s")), "long-summaries")
    inside = stored(_before(summaries, ["seq", "stretch"], "block", m), "long-inside")
    stretches = inside.groupBy("seq", "stretch").agg(F.first("whole").alias("s"))
    ahead = stretches.withColumn("far", F.expr(f"stretch div {FAN}"))
    # a third level: what comes before each FAN stretches, so that rows stay short at any length
    near = stored(_before(ahead, ["seq", "far"], "stretch", m), "long-near")
    far = _before(near.groupBy("seq", "far").agg(F.first("whole").alias("s")), ["seq"], "far", m).select("seq", "far", F.col("before").alias("s"))
    outer = near.join(far, ["seq", "far"]).select("seq", "stretch", F.expr(_merged("s", "before", m)).alias("s"))
    starts = inside.join(outer, ["seq", "stretch"]).select("seq", "block", F.expr(_heap(f"({_merged('s', 'before', m)})", m)).alias("start"))

    played = parts.join(starts, ["seq", "block"]).select("seq", "block", "start", F.size("tokens").cast("bigint").alias("n"), F.expr(_replay(m, w)).alias("r"))
    rows = stored(played.select("seq", "block", "start", "n", "r.first", "r.last", "r.halt", "r.top"), "long-blocks")
    based = stored(running_totals(rows, ["seq"], "block", {"n": "n"}).withColumn("base", F.expr("cum_n - n")), "long-based")
    # the last update before a block: a running maximum over two places a block, asked at the first, told at the second
    twice = based.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("told")).withColumn("place", F.expr("2 * block + told"))
    seen = running_totals(twice, ["seq"], "place", {}, maxima={"last": "if(told = 1 and last > 0, base + last, null)"})
    here = seen.filter("told = 0").withColumn("since", F.expr("coalesce(top_last, 0L)"))
    idle = f"base - since + if(first = 0, n, first - 1) >= {w}"
    ended = here.select(
        "seq", "block", "n", "top",
        F.expr(f"case when n > 0 and {idle} then struct(block, since + {w} as tau, start as top) when halt > 0 then struct(block, base + halt as tau, top) end as stop"),
    )
    found = ended.groupBy("seq").agg(F.min("stop").alias("stop"), F.max(F.struct("block", "top")).alias("end"), F.sum("n").alias("n"))
    top = "coalesce(stop.top, end.top)"
    return found.select(
        "seq",
        F.expr(f"if(size({top}) > 0, aggregate({top}, 0D, (a, x) -> a + x) / size({top}), null) as mean"),
        F.expr("cast(coalesce(stop.tau, n) as int) as tau"),
        F.expr("stop is not null as triggered"),
    )
