"""Repeated runs of lines, found with a suffix array over line ids and cut down to their first copy.

A document is the sequence of its lines that hold a word. Lines get 64-bit ids, and only lines that occur at least twice
take part: any other line ends every repeated run. The suffixes that start at such lines are ranked by prefix doubling.
A round joins each suffix, ranked by its first lines, with the rank of what follows them, counts the pairs of ranks and
numbers them in order by running totals; the rank of a pair is its place in the suffix array. Ranks by 1, 2, 4, … lines
come from pairs of equal length, those by other numbers of lines from the largest power of two and a rest, up to
``least_lines``. Suffixes whose prefix is unique leave after each round, as no repeated run of that length starts there.

Suffixes of equal rank by d lines form the intervals whose longest common prefix is d or more. In each interval the suffix
with the smallest (doc_id, text hash, line number) is the first copy. Under the others, d lines are marked if d is
``least_lines``, or if they hold more than ``least_words`` words. Marks that touch join to maximal runs, which are deleted
with the blank lines inside them. So a line is deleted exactly if it lies in a run that also starts at an earlier place, in
another document or the same one, and that has ``least_lines`` lines or more than ``least_words`` words. A longer run
is the union of its windows of ``least_lines`` lines, all of them later copies too, so no rank by more lines could add to it.

Running totals are taken over ranges of the ordered pairs, never in one task, and a frequent line is counted before it is
joined; adaptive execution splits what remains of it.

Defined cases: a null text stays null and has no line; blank texts stay; rows that repeat doc_id and text are one document
and get the same result; a null doc_id comes last. Lines are compared exactly. An empty table gives an empty result.
Further columns pass through.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallystar.llm.shared import WORD, positional, restored, written

LEAST_LINES = 3
LEAST_WORDS = 50
_PLACE = ["doc", "text_hash", "seq"]


def _lines(frame: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Rows (doc, text_hash, seq, id, words) of all lines that hold a word."""
    counted = F.transform(F.split(text, "\n", -1), lambda line: F.struct(
        F.xxhash64(line).alias("id"), F.regexp_count(line, F.lit(WORD)).alias("words")))
    spoken = F.filter(counted, lambda line: line["words"] > 0)
    return frame.select(F.col(doc_id).alias("doc"), F.xxhash64(text).alias("text_hash"), F.posexplode(spoken).alias(
        "seq", "line")).select("doc", "text_hash", "seq", "line.*")


def _numbered(counted: DataFrame, *order: str) -> DataFrame:
    """``counted`` with ``rank``, the running total of ``n`` over all rows before, in the order of the columns."""
    ranged = written(counted.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "line-ranges")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("range").agg(F.sum("n").alias("total")).select(
        "range", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.withColumn("inside", F.coalesce(F.sum("n").over(within), F.lit(0))).join(starts, "range").withColumn(
        "rank", F.col("start") + F.col("inside")).drop("range", "inside", "start")


def suffix_ranks(lines: DataFrame, depth: int) -> dict[int, DataFrame]:
    """Per number of lines up to ``depth``, rows (doc, text_hash, seq, rank, words) of all suffixes that share so many."""
    lines = written(lines, "lines")
    repeated = _numbered(lines.groupBy("id").agg(F.count("*").alias("n")).where("n > 1"), "id").select("id", "rank")
    levels = {1: written(lines.join(repeated, "id").groupBy(*_PLACE).agg(
        F.min("rank").alias("rank"), F.min("words").cast("long").alias("words")), "line-ranks")}
    for reached in range(2, depth + 1):
        step = 1 << ((reached - 1).bit_length() - 1)
        further = levels[reached - step].select(
            F.col("doc").alias("f_doc"), F.col("text_hash").alias("f_hash"), (F.col("seq") - step).alias("f_seq"),
            F.col("rank").alias("next"), F.col("words").alias("more"))
        same = [F.col(c).eqNullSafe(F.col(f)) for c, f in zip(_PLACE, ("f_doc", "f_hash", "f_seq"))]
        pairs = written(levels[step].join(further, same).select(
            *_PLACE, "rank", "next", (F.col("words") + F.col("more")).alias("words")), "line-pairs")
        counted = pairs.groupBy("rank", "next").agg(F.count("*").alias("n")).where("n > 1")
        numbers = _numbered(counted.withColumnsRenamed({"rank": "old"}), "old", "next").select("old", F.col("next").alias("old_next"), "rank")
        levels[reached] = written(pairs.withColumnRenamed("rank", "was").join(
            numbers, (F.col("was") == F.col("old")) & (F.col("next") == F.col("old_next"))).select(*_PLACE, "rank", "words"), "line-ranks")
    return levels


def later_runs(lines: DataFrame, least_lines: int = LEAST_LINES, least_words: int = LEAST_WORDS) -> DataFrame:
    """Rows (doc, text_hash, runs): the maximal runs of later copies, as an array of (first, last) line numbers."""
    place = F.struct(F.col("doc").isNull(), *_PLACE)
    marks = []
    for depth, ranks in suffix_ranks(lines, least_lines).items():
        enough = ranks if depth == least_lines else ranks.where(F.col("words") > least_words)
        firsts = enough.groupBy("rank").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        marks.append(enough.join(firsts, "rank").where(place != F.col("first")).select(
            "doc", "text_hash", "seq", (F.col("seq") + depth - 1).alias("last")))
    # A window holds the marks of one document.
    own = Window.partitionBy("doc", "text_hash").orderBy("seq", "last")
    reached = F.max("last").over(own.rowsBetween(Window.unboundedPreceding, -1))
    opened = reduce(DataFrame.unionAll, marks).withColumn("opens", F.coalesce(F.col("seq") > reached + 1, F.lit(True)).cast("int"))
    runs = opened.withColumn("run", F.sum("opens").over(own.rowsBetween(Window.unboundedPreceding, 0))).groupBy(
        "doc", "text_hash", "run").agg(F.min("seq").alias("first"), F.max("last").alias("last"))
    return runs.groupBy("doc", "text_hash").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))


def mark(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_lines: int = LEAST_LINES,
         least_words: int = LEAST_WORDS) -> DataFrame:
    """The documents as c0, c1, … with n_lines, runs (array of first and last line, from 0) and kept_text."""
    frame, names = positional(docs, text, doc_id)
    t, d = names[text], names[doc_id]
    runs = written(later_runs(_lines(frame, t, d), least_lines, least_words), "line-runs")
    own = F.col(d).eqNullSafe(F.col("doc")) & (F.xxhash64(t) == F.col("text_hash"))
    # The same join at every size: a small table of runs would be broadcast, and the shuffle of the texts would set in later.
    joined = frame.join(runs.hint("merge"), own, "left").drop("doc", "text_hash")
    parted = joined.withColumn("_lines", F.split(t, "\n", -1))
    spoken = F.filter(F.transform("_lines", lambda line, i: F.when(F.rlike(line, F.lit(r"[^\x20\x09-\x0D]")), i)),
                      lambda i: i.isNotNull())
    placed = parted.withColumn("_at", F.when(F.col("runs").isNotNull(), spoken)).withColumn("runs", F.coalesce(F.transform(
        "runs", lambda r: F.struct(F.get("_at", r["first"]).alias("first"), F.get("_at", r["last"]).alias("last"))),
        F.array().cast("array<struct<first:int,last:int>>")))
    # Lines between one run's end and the next one's start stay.
    gaps = F.zip_with(F.concat(F.array(F.lit(-1)), F.col("runs.last")), F.concat(F.col("runs.first"), F.array(F.size("_lines"))),
                      lambda end, start: F.slice("_lines", end + 2, start - end - 1))
    kept = F.when(F.size("runs") == 0, F.col(t)).otherwise(F.array_join(F.flatten(gaps), "\n"))
    return placed.withColumn("kept_text", kept).withColumn(
        "n_lines", F.coalesce(F.size("_lines"), F.lit(0)).cast("long")).drop("_lines", "_at")


def delete_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_lines: int = LEAST_LINES,
                least_words: int = LEAST_WORDS) -> DataFrame:
    """The documents with later copies of repeated runs deleted from their texts, with the columns of the input."""
    at = f"c{docs.columns.index(text)}"
    return restored(mark(docs, text, doc_id, least_lines, least_words).withColumn(at, F.col("kept_text")), docs)
