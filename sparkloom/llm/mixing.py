"""Mixing sources to target shares of a total size, with capped repetition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: Buckets of the seeded order; only the one bucket in which a source's sample ends is ordered row by row.
BUCKETS = 4096
#: Sources up to which the plan (one row per source) is sent to every task; beyond it is joined by shuffle.
MOST_SOURCES = 100_000
#: A total: all tokens of the sources that take part.
CORPUS = "corpus"


def water_fill(tokens: dict[str, int], shares: dict[str, float], max_repeats: dict[str, int], total: float | None = None) -> dict[str, float]:
    """Tokens to take of each source, by the rounds that ``plan`` has in closed form.

    Without ``total``: the largest total at which every source that has documents keeps its share under its cap.
    With it: sources whose share asks for more than ``max_repeats`` epochs are clamped there, and the excess goes
    to the others in proportion to their shares, until every one is feasible or all are clamped.
    """
    cap = {s: float(tokens.get(s, 0)) * max_repeats[s] for s in shares}
    live = {s: w for s, w in shares.items() if w > 0 and cap[s] > 0}
    take = {s: 0.0 for s in shares}
    if not live:
        return take
    if total is None:
        weight = sum(live.values())
        total = min(cap[s] * weight / w for s, w in live.items())
    left = float(total)
    while live:
        weight = sum(live.values())
        over = [s for s, w in live.items() if left * w / weight > cap[s] * (1 + 1e-12)]
        if not over:
            return take | {s: left * w / weight for s, w in live.items()}
        for s in over:
            take[s] = cap[s]
            left -= cap[s]
            del live[s]
    return take


def plan(docs: DataFrame, targets: DataFrame, source_col: str = "source", size_col: str = "n_tokens", total: float | str | None = None) -> DataFrame:
    """(source, target_share, max_repeats, tokens_there, goal, clamped): the tokens to take of each source of the targets.

    Capped water-filling. Sources stand in order of cap over share: however much is to be filled, those that reach their
    cap are the first ones of this order, so that the rounds of clamping and redistributing become two running sums, of
    the caps before a source and of the shares from it on. The first source that stays below its cap gives the level, the
    tokens per unit of share that all the unclamped ones get.

    ``total`` is a number of tokens, ``CORPUS`` (all tokens of the sources that take part), or None: the largest total at
    which no source is clamped. A null source or share, a share of 0 or less, and a source without tokens take no part;
    the others share its part. A null or negative ``max_repeats`` counts as 0. Targets have one row per source (the first
    by share where there are more); sizes are counted over all documents.
    """
    size = F.coalesce(F.col(size_col), F.lit(0)).cast("bigint")
    there = docs.where(F.col(source_col).isNotNull()).groupBy(F.col(source_col).alias("source")).agg(F.sum(size).alias("n"))
    t = targets.where("source is not null").groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t")).select("source", "t.*")
    share = F.when(F.isnan("target_share") | (F.col("target_share") < 0), 0.0).otherwise(F.coalesce("target_share", F.lit(0.0)))
    j = t.join(there, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("n", F.lit(0)).alias("tokens_there"), share.alias("w"))
    j = j.withColumn("cap", F.col("tokens_there").cast("double") * F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)))
    j = j.withColumn("live", (F.col("w") > 0) & (F.col("cap") > 0))
    every = Window.partitionBy("live")  # one row per source of the targets
    epochs = F.try_divide(F.col("cap"), F.col("w"))
    order = every.orderBy(epochs, "source")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    if total is None:
        amount = F.min(epochs).over(every) * F.sum("w").over(every)
    else:
        amount = F.sum(F.col("tokens_there").cast("double")).over(every) if total == CORPUS else F.lit(float(total))
    j = j.withColumn("level", F.try_divide(amount - before, weight))
    j = j.withColumn("clamped", F.col("live") & (F.col("level") * F.col("w") > F.col("cap") * (1 + 1e-12)))
    level = F.min(F.when(~F.col("clamped"), F.struct(epochs.alias("at"), "source", "level"))).over(every)["level"]
    goal = F.when(~F.col("live"), 0.0).when(F.col("clamped"), F.col("cap")).otherwise(level * F.col("w"))
    return j.select("source", "target_share", "max_repeats", "tokens_there", goal.alias("goal"), "clamped")


def mix(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "n_tokens", total: float | str | None = None, seed: int = 17, buckets: int = BUCKETS, goals: DataFrame | None = None) -> DataFrame:
    """(id, source, n_tokens, repeats): each used document with the number of times it is repeated.

    The goals of the sources come from ``plan`` (or are given). Each document of a source gets the whole part of the
    source's epochs; the fractional part goes to documents in a seeded order until the source's size is reached (to the
    nearest document). The order is found by a histogram over hash buckets, so that a source with a third of all rows
    is never sorted in one task. No document is repeated more than ``max_repeats`` times.

    A null size counts as 0. Repeated rows are documents of their own. An empty input gives an empty result.
    """
    spark = docs.sparkSession
    checkpoint_dir(spark)
    goals = plan(docs, targets, source_col, size_col, total) if goals is None else goals
    small = targets.select("source").limit(MOST_SOURCES + 1).count() <= MOST_SOURCES
    send = F.broadcast if small else lambda x: x  # one row per source of the targets; many are joined by shuffle
    whole = F.floor(F.col("goal") / F.col("tokens_there") + 1e-9)
    want = goals.where("goal > 0").select(F.col("source").alias("_s"), F.col("max_repeats").alias("_max"), whole.cast("int").alias("_whole"), (F.col("goal") - whole * F.col("tokens_there")).alias("_rest")).checkpoint()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_s"), F.coalesce(F.col(size_col), F.lit(0)).cast("bigint").alias("_z"))
    rows = rows.join(send(want), "_s").withColumn("_o", F.xxhash64(F.lit(seed), F.col("_id").cast("string")))
    rows = rows.withColumn("_b", F.pmod(F.shiftright("_o", 20), F.lit(buckets)))
    hist = rows.groupBy("_s", "_b").agg(F.sum("_z").alias("_h"), F.first("_rest").alias("_r"))
    upto = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    edge = hist.withColumn("_c", F.sum("_h").over(upto)).where("_c >= _r and _c - _h < _r").select("_s", F.col("_b").alias("_cut"), (F.col("_c") - F.col("_h")).alias("_base")).checkpoint()
    rows = rows.join(send(edge), "_s", "left")
    inside = Window.partitionBy("_s", "_b").orderBy("_o", "_id").rowsBetween(Window.unboundedPreceding, 0)
    at_edge = rows.where("_b = _cut").withColumn("_c", F.col("_base") + F.sum("_z").over(inside)).withColumn("_extra", (F.col("_c") - F.col("_z") / 2.0 <= F.col("_rest")).cast("int"))
    away = rows.where("_cut is null or _b <> _cut").withColumn("_extra", F.when(F.col("_cut").isNull(), 0).otherwise((F.col("_b") < F.col("_cut")).cast("int")))
    used = away.select("_id", "_s", "_z", "_whole", "_extra", "_max").unionByName(at_edge.select("_id", "_s", "_z", "_whole", "_extra", "_max"))
    n = F.least(F.col("_whole") + F.col("_extra"), F.col("_max"))
    return used.select(F.col("_id").alias(id_col), F.col("_s").alias(source_col), F.col("_z").alias(size_col), n.alias("repeats")).where("repeats > 0")


def report(mixed: DataFrame, docs: DataFrame, goals: DataFrame, source_col: str = "source", size_col: str = "n_tokens") -> DataFrame:
    """(source, target_share, max_repeats, clamped, docs_there, docs_used, tokens_there, tokens_used, most_repeats, epochs,
    share): what each source of the goals reached; a source that takes no part has 0 used."""
    there = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("docs_there"))
    used = mixed.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("docs_used"), F.sum(F.col(size_col) * F.col("repeats")).alias("tokens_used"), F.max("repeats").alias("most_repeats"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    j = goals.join(there, "source", "left").join(used, "source", "left")
    j = j.select("source", "target_share", "max_repeats", "clamped", *map(zero, ["docs_there", "docs_used", "tokens_there", "tokens_used", "most_repeats"]))
    every = Window.partitionBy()  # one row per source of the targets table
    return j.select("*", F.round(F.col("tokens_used") / F.nullif(F.col("tokens_there"), F.lit(0)), 6).alias("epochs"), F.round(F.col("tokens_used") / F.nullif(F.sum("tokens_used").over(every), F.lit(0)), 6).alias("share"))
