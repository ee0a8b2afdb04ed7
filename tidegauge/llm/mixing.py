"""Mixing sources to target weights by Pfair scheduling (operator 5).

DataFrame operations only."""

from __future__ import annotations

from fractions import Fraction
from math import gcd, lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import broadcast_if, materialise, numbered, without

NEW = ["mix_class", "mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_place"]

#: The fold over a period is done in chunks of so many slots, and is no longer than MOST slots.
CHUNK, MOST = 1024, 1 << 20

#: One period of the schedule, as a fold over its slots: of the blocks whose release time has
#: come, the one with the earliest deadline runs, and of several the first source's. With shares
#: a and period W the block j (from 0) is released at floor(j W / a) and due by ceil((j + 1) W / a).
_PERIOD = f"""
flatten(aggregate(sequence(0L, (period - 1L) div {CHUNK}),
  named_struct('done', transform(shares, a -> 0L), 'picks', cast(array() as array<array<int>>)),
  (o, c) -> element_at(transform(array(
    aggregate(sequence(c * {CHUNK}, least(period, (c + 1L) * {CHUNK}) - 1L), named_struct('done', o.done, 'picks', cast(array() as array<int>)),
      (s, t) -> element_at(transform(array(cast(array_min(transform(
            filter(sequence(0, size(shares) - 1), i -> s.done[i] < shares[i] and s.done[i] * period div shares[i] <= t),
            i -> ((s.done[i] + 1L) * period + shares[i] - 1L) div shares[i] * 100000L + i)) % 100000L as int)),
          p -> named_struct('done', transform(s.done, (x, i) -> if(i = p, x + 1L, x)), 'picks', array_append(s.picks, p))), 1))),
    r -> named_struct('done', r.done, 'picks', array_append(o.picks, r.picks))), 1),
  o -> o.picks))
"""


def _key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))


def whole_shares(weights: dict[str, float | Fraction]) -> dict[str, int]:
    """Whole numbers in exactly the proportions of the weights, as they are written (0.1 is a tenth).
    A weight must be over 0."""
    exact = {s: Fraction(str(w)) for s, w in weights.items()}
    if any(w <= 0 for w in exact.values()):
        raise ValueError("weights must be over 0: no source is left out")
    scale = lcm(*[w.denominator for w in exact.values()]) if exact else 1
    least = gcd(*[int(w * scale) for w in exact.values()]) if exact else 1
    return {s: int(w * scale) // least for s, w in exact.items()}


def classes(docs: DataFrame, source: str, weights: dict[str, float] | None, power: float, resolution: int, named: int) -> DataFrame:
    """(key, n, share, class): each source's rows and its share, and the class that it is scheduled in:
    itself for the ``named`` sources of the largest shares, '*' for all others."""
    counts = materialise(docs.groupBy(_key(source).alias("key")).agg(F.count(F.lit(1)).alias("n")), "sources")
    if weights is None:
        total = F.broadcast(counts.agg(F.sum(F.pow("n", F.lit(power))).alias("total")))
        shared = counts.crossJoin(total).select("key", "n", F.greatest(F.lit(1), F.round(F.pow("n", F.lit(power)) / F.col("total") * resolution)).cast("long").alias("share"))
    else:
        own = whole_shares(weights)
        given = docs.sparkSession.createDataFrame([(f"={s}", w) for s, w in own.items()], "key string, given long")
        shared = counts.join(F.broadcast(given), "key", "left").select("key", "n", F.coalesce("given", F.lit(min(own.values(), default=1))).alias("share"))
    shared = materialise(shared, "shares")
    top = shared.orderBy(F.desc("share"), "key").limit(named).select("key", F.lit(True).alias("top"))
    return materialise(shared.join(F.broadcast(top), "key", "left").withColumn("class", F.when(F.col("top"), F.col("key")).otherwise("*")).drop("top"), "classes")


def schedule(of: DataFrame) -> DataFrame:
    """(class, share, period, turn, at): where in the period each turn of a class comes; as many
    rows as the period has slots."""
    of = of.groupBy("class").agg(F.sum("share").alias("share"))
    period = of.agg(F.sum("share")).first()[0] or 0
    if period > MOST:
        raise ValueError(f"the weights' exact proportions repeat after {period} slots, over {MOST}; give weights of fewer digits")
    one = of.agg(F.sort_array(F.collect_list(F.struct("class", "share"))).alias("all"), F.sum("share").alias("period")).where("size(`all`) > 0")
    picks = one.withColumn("shares", F.col("all.share")).withColumn("picks", F.expr(_PERIOD))
    slots = picks.select("period", "all", F.posexplode("picks").alias("at", "i")).select("period", F.expr("all[i].class").alias("class"), F.expr("all[i].share").alias("share"), F.col("at").cast("long").alias("at"))
    return slots.withColumn("turn", F.row_number().over(Window.partitionBy("class").orderBy("at")).cast("long") - 1)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, source: str = "source", doc_id: str = "doc_id", power: float = 0.5, resolution: int = 720, block_rows: int = 16, bucket_blocks: int = 16, named: int = 512) -> DataFrame:
    """``docs`` with mix_class, mix_block (the block's number in its class), mix_release,
    mix_deadline, mix_slot (when the block runs) and mix_place (the row's place in it).

    Weights are kept exactly: those given as the fractions they are written as (sources not named get
    the least of them), else whole numbers out of about ``resolution``, in proportion to row counts to
    ``power`` and 1 at least. Read by (mix_slot, mix_place), after any number of slots every class has
    had its weight's share of them to within less than one block, as long as no source is used up; from
    then on its slots stay idle and the others keep their relation. A class is a source, up to ``named``
    of them; further sources share class '*' with the sum of their weights, and in its slots the block
    with the earliest deadline by its own source's weight is next, so none is ever late by a block
    there. No row is left out or repeated. Rows of null source are one source. Rows of equal doc_id,
    and those of null doc_id, keep together, in any order; no rows give none. Columns with the names
    of the new ones are replaced.

    A source's rows are dealt by id hash into buckets of about bucket_blocks * block_rows rows,
    which become blocks on their own, so no task needs a whole source. Only the named sources and one
    period (MOST slots at most, else ValueError) are broadcast."""
    of = classes(docs, source, weights, power, resolution, named)
    hashed = F.coalesce(F.conv(F.substring(F.md5(F.col(doc_id).cast("string")), 1, 15), 16, 10).cast("long"), F.lit(0))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in without(docs, NEW).columns]).alias("row"), _key(source).alias("key"), F.col(doc_id).alias("id"), hashed.alias("hash"))
    own = broadcast_if(of.select("key", "n"), 1 << 16)
    dealt = rows.join(own, "key").withColumn("bucket", F.col("hash") % F.ceil(F.col("n") / (block_rows * bucket_blocks))).drop("n")
    sizes = materialise(dealt.groupBy("key", "bucket").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("k")), "buckets")
    # running totals in two steps, as a large source has many buckets
    high = F.expr("bucket div 4096")
    to = lambda by, order: F.sum("k").over(by.orderBy(order)) - F.col("k")
    upper = sizes.groupBy("key", high.alias("high")).agg(F.sum("k").alias("k")).select("key", "high", to(Window.partitionBy("key"), "high").alias("upper"))
    lower = sizes.withColumn("high", high).withColumn("lower", to(Window.partitionBy("key", "high"), "bucket"))
    before = lower.join(upper, ["key", "high"]).select("key", "bucket", (F.col("lower") + F.col("upper")).alias("before"), "k")
    place = F.row_number().over(Window.partitionBy("key", "bucket").orderBy("hash", "id")) - 1
    placed = dealt.withColumn("i", place).join(before.drop("k"), ["key", "bucket"]).withColumn("block", F.expr(f"before + i div {block_rows}")).withColumn("class", F.col("key"))
    if not of.where("class = '*'").isEmpty():
        rest = before.join(of.where("class = '*'").select("key", "share"), "key").select("key", "share", F.explode(F.expr("sequence(before, before + k - 1)")).alias("block"))
        due = (F.col("block") + 1) / F.col("share")
        turns = numbered(rest.select("key", "block", due.alias("due")), ["due", "key", "block"], "number")
        placed = placed.join(turns.select("key", "block", "number"), ["key", "block"], "left").withColumn("class", F.when(F.col("number").isNull(), F.col("key")).otherwise("*")).withColumn("block", F.coalesce("number", "block")).drop("number")
    period = materialise(schedule(of), "period")
    shares = F.broadcast(of.groupBy("class").agg(F.sum("share").alias("share")))
    timed = placed.join(shares, "class").withColumn("turn", F.col("block") % F.col("share")).join(F.broadcast(period.select("class", "turn", "at", "period")), ["class", "turn"])
    return timed.select(
        "row.*",
        F.col("class").alias("mix_class"),
        F.col("block").alias("mix_block"),
        F.expr("block * period div share").alias("mix_release"),
        F.expr("((block + 1) * period + share - 1) div share").alias("mix_deadline"),
        F.expr("block div share * period + at").alias("mix_slot"),
        F.expr(f"i % {block_rows}").cast("int").alias("mix_place"),
    )
