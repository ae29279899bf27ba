"""Mixing sources to target weights: iterative proportional fitting over token counts.

Documents are counted into cells of (source, language, topic). The cells' token weights are raked:
scaled to the source marginal, then the language marginal, then the topic marginal, round after
round. A document is then kept with the probability its cell's weight calls for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doubtscope.session import stored

DIMENSIONS = ("source", "lang", "topic")
MISSING = "(none)"


def format_topic(text: Column) -> Column:
    """Topic of a text from its form, for tables without a topic column; nulls count as empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return (
        F.when(F.instr(text, " | ") > 0, "tabular")
        .when(F.length(text) < 400, "note")
        .when(F.length(text) < 4000, "article")
        .otherwise("essay")
    )


def n_tokens(text: Column) -> Column:
    """Words between ASCII spaces, 1 at least, so that every document has weight."""
    words = F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"))
    return F.greatest(words, F.lit(1)).cast("long")


def target_shares(cells: DataFrame, dimension: str, power: float, wanted: dict[str, float] | None = None) -> DataFrame:
    """(value, target) of a dimension: the ``wanted`` shares of its values, normalised over those that occur (values not named
    get none); without them each value's token share to the power, normalised: power 1 keeps the mix, 0 makes values equal."""
    share = F.pow(F.sum("tokens").cast("double"), F.lit(power))
    if wanted is not None:
        named = [x for k, v in wanted.items() for x in (F.lit(k), F.lit(float(v)))]
        share = F.coalesce(F.element_at(F.create_map(*named), F.col(dimension)), F.lit(0.0)) if named else F.lit(0.0)
    shares = stored(cells.groupBy(dimension).agg(share.alias("share")), "mix-shares")
    whole = shares.agg(F.sum("share")).first()[0]
    return shares.select(dimension, (F.col("share") / F.lit(whole or 1.0)).alias("target"))


def rake(
    cells: DataFrame, powers: dict[str, float], rounds: int, share: float = 0.0, targets: dict[str, dict[str, float]] | None = None
) -> DataFrame:
    """Cells (the dimensions, tokens) with ``weight``, raked so that each dimension's marginal is its target.

    ``targets`` gives shares by dimension and value; a dimension that it does not name follows its power
    (see ``target_shares``). Cells are as many as there are combinations, far fewer than documents; they stay a
    distributed table, written out at every step. With ``share`` no cell gets more weight than all its
    tokens have in a sample of that share; the next rounds give what it cannot take to other cells of the
    same values.
    """
    total = cells.agg(F.sum("tokens").cast("double")).first()[0] or 1.0
    wanted = {d: target_shares(cells, d, powers[d], (targets or {}).get(d)) for d in DIMENSIONS}
    now = cells.withColumn("weight", F.col("tokens") / F.lit(total))
    for _ in range(rounds):
        for d in DIMENSIONS:
            have = now.groupBy(d).agg(F.sum("weight").alias("have"))
            factor = have.join(wanted[d], d).select(d, F.when(F.col("have") > 0, F.col("target") / F.col("have")).otherwise(0.0).alias("factor"))
            weight = F.col("weight") * F.col("factor")
            if share:
                weight = F.least(weight, F.col("tokens") / F.lit(share * total))
            now = now.join(factor, d).select(*DIMENSIONS, "tokens", weight.alias("weight"))
            now = stored(now, "mix-cells")
    return now


POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.7}


def keyed(docs: DataFrame, text: Column, source: Column, lang: Column, topic: Column) -> DataFrame:
    """docs with the struct column ``__mix`` of source, lang, topic and tokens; missing values form a value of their own."""
    named = [F.coalesce(c.cast("string"), F.lit(MISSING)).alias(d) for c, d in zip((source, lang, topic), DIMENSIONS, strict=True)]
    return docs.withColumn("__mix", F.struct(*named, n_tokens(text).alias("tokens")))


#: Share of all tokens that the query and the pipeline sample, in expectation.
SHARE = 0.15


def _rated(marked: DataFrame, powers, rounds, share, targets) -> DataFrame:
    """(source, lang, topic, tokens, p) of every cell."""
    cells = stored(marked.groupBy(*[F.col(f"__mix.{d}").alias(d) for d in DIMENSIONS]).agg(F.sum("__mix.tokens").alias("tokens")), "mix-counts")
    raked = rake(cells, powers, rounds, share or 0.0, targets).withColumn("rate", F.col("weight") / F.col("tokens"))
    top, tokens = raked.agg(F.max("rate"), F.sum("tokens")).first()
    if share is None:
        p = F.col("rate") / F.lit(top or 1.0)
    else:
        p = F.least(F.lit(1.0), F.col("rate") * F.lit(_scale(raked, share * tokens) if top else 0.0))
    return raked.select(*DIMENSIONS, "tokens", p.alias("p"))


def keep_probabilities(
    marked: DataFrame, powers: dict[str, float] = POWERS, rounds: int = 6, share: float | None = None, targets: dict[str, dict[str, float]] | None = None
) -> DataFrame:
    """(source, lang, topic, p): the chance of a cell's documents.

    With ``share`` the sample has this share of all tokens in expectation: cells too small for their weight are
    kept whole, and others of the same values make up the rest. Without it the sample is the largest that has
    all weights in proportion, so the cell with the highest rate sets its size.
    """
    return _rated(marked, powers, rounds, share, targets).select(*DIMENSIONS, "p")


def _scale(raked: DataFrame, size: float) -> float:
    """The factor of the rates, cut at 1, that makes a sample of ``size`` tokens; one pass more per set of cells kept whole."""
    scale, full = size / raked.agg(F.sum("weight")).first()[0], -1
    while True:
        whole = F.col("rate") * F.lit(scale) >= 1.0
        n, kept, rest = raked.agg(F.count_if(whole), F.sum(F.when(whole, F.col("tokens"))), F.sum(F.when(~whole, F.col("weight")))).first()
        if n == full or rest is None:
            return scale
        scale, full = max(scale, (size - (kept or 0)) / rest), n


def draw(doc_id: Column, seed: int) -> Column:
    """Repeatable uniform number in [0, 1) of an id: 15 hexadecimal digits of a digest; a null id is the empty text."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)


def sample_mixture(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    topic: Column | None = None,
    powers: dict[str, float] = POWERS,
    rounds: int = 6,
    seed: int = 7,
    share: float | None = None,
    targets: dict[str, dict[str, float]] | None = None,
) -> DataFrame:
    """All columns of docs, and ``__mix`` (source, lang, topic, tokens), ``__p`` and ``__kept``.

    ``__kept`` says whether the document is in the sample. A null source, language or text is a value
    of its own or an empty text; rows that repeat an id share one draw; an empty table stays empty. Columns of
    docs by these three names are replaced. ``share`` and ``targets`` as in ``keep_probabilities`` and ``rake``.
    """
    text = F.col(text_col)
    own = docs.drop("__mix", "__p", "__kept")
    marked = keyed(own, text, F.col(source_col), F.col(lang_col), format_topic(text) if topic is None else topic)
    rates = keep_probabilities(marked, powers, rounds, share, targets).select(F.struct(*DIMENSIONS).alias("__cell"), F.col("p").alias("__p"))
    cell = F.struct(*[F.col(f"__mix.{d}").alias(d) for d in DIMENSIONS])
    return marked.join(rates, cell == F.col("__cell")).drop("__cell").withColumn("__kept", draw(F.col(id_col), seed) < F.col("__p"))


def keep_mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", **how) -> DataFrame:
    """The rows of docs that are in the sample, all columns whatever their names."""
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    mixed = sample_mixture(packed, f"row.{id_col}", f"row.{text_col}", f"row.{source_col}", f"row.{lang_col}", **how)
    return mixed.where("__kept").select("row.*")


def marginals(
    marked: DataFrame, powers: dict[str, float] = POWERS, rounds: int = 6, share: float | None = None, targets: dict[str, dict[str, float]] | None = None
) -> DataFrame:
    """(dimension, value, target, reached): the share of tokens each value should have, and has in the sample in expectation."""
    rated = stored(_rated(marked, powers, rounds, share, targets), "mix-rated")
    whole = rated.agg(F.sum(F.col("tokens") * F.col("p"))).first()[0]
    rows = []
    for d in DIMENSIONS:
        wanted = target_shares(rated, d, powers[d], (targets or {}).get(d))
        reached = rated.groupBy(d).agg((F.sum(F.col("tokens") * F.col("p")) / F.lit(whole or 1.0)).alias("reached"))
        rows.append(reached.join(wanted, d).select(F.lit(d).alias("dimension"), F.col(d).alias("value"), "target", "reached"))
    return rows[0].unionByName(rows[1]).unionByName(rows[2])
