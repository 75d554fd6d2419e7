"""Mixing sources to target weights, with whole documents.

Words are summed per source, every source gets a target, and target / size is its repetition rate. A document is
emitted floor(rate) times, plus once more with a probability equal to the fraction, drawn from a hash of its id.
Targets share the words of all sources by weight; none is above ``most`` times its source, and what is cut off
there goes to the others by weight.

Targets are found without rounds: a source is capped exactly if its cap per weight is at most the final share per weight,
so the sources are ordered by cap per weight and running sums give the share. This happens on one row per source;
documents meet their source's rate in a join that Spark may broadcast if it measures a small side and otherwise
splits where a source is hot.

Defined cases: a null text has size 0; null is a source of its own, the last; sources whose documents hold no word
have target 0, and their documents are not emitted. Rows that repeat a doc_id draw the same number. An empty table
gives an empty mix. The draw uses the id, the source and the seed only, so reruns agree. Further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystar.llm.shared import positional, restored, word_count

MOST = 3
WEIGHTS = (1, 2, 3)
SEED = "mix"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Target per source from rows (source, source_size); sources by code point, null last, take the weights in turn."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int")).cast("long")
    ranked = sizes.withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    earlier, onward = before.rowsBetween(Window.unboundedPreceding, -1), before.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    share = (total - F.coalesce(F.sum("cap").over(earlier), F.lit(0))) / F.sum("weight").over(onward)
    # The share per weight of all that are not capped is the first at which a source stays below its cap.
    shares = ranked.withColumn("share", share)
    level = F.min(F.when(F.col("cap") >= F.col("share") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "share"))).over(everything)
    target = F.least(F.col("cap").cast("double"), level["share"] * F.col("weight"))
    return shares.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def draw(doc_id: Column, source: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the hash of id, source and seed."""
    key = F.concat_ws("/", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(source, F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def plan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source",
         weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The documents as c0, c1, … with size, source_size, target and copies."""
    frame, names = positional(docs, text, doc_id, source)
    sized = frame.withColumn("size", word_count(F.col(names[text])))
    sizes = sized.groupBy(F.col(names[source]).alias("source")).agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, most)
    joined = sized.join(targets, F.col(names[source]).eqNullSafe(F.col("source")), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate)
    extra = (draw(F.col(names[doc_id]), F.col(names[source]), seed) < rate - whole).cast("long")
    return joined.withColumn("copies", whole + extra).drop("source")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as planned, with the columns of the input."""
    planned = plan(docs, **options).where("copies > 0")
    return restored(planned.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))), docs)
