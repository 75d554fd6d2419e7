"""Near duplicates by SimHash, found with an inverted index of byte positions and a count filter.

A fingerprint has 64 bits, that is 8 positional bytes. Two fingerprints at a distance of at most d bits differ in at
most d bytes, so they share at least 8 − d positional bytes; hence among any d + w positions they share at least w. The index
holds, for every set of w of the first d + w positions, the bytes at these positions. Members of one posting list are
paired, the positional bytes that a pair shares are tallied, pairs below the guaranteed minimum go, and the Hamming
distance of the rest is verified. w is 3 or, beyond ``WIDE`` different fingerprints, 4, but at most 8 − d; either gives the
same links, 4 from shorter lists.

Long posting lists do not produce all their pairs. Fingerprints are made distinct first, so copies count once. Then

1. each list links its members to one pivot, its least fingerprint, if they verify; components of these links are built;
2. what the pivots left open lies between components: in each list, the members outside the list's largest component are
   paired with all other members. A list that lies in one component makes no pair.

A link between two fingerprints is thus either found or within a component that is already joined; none is lost.

Spark takes an exploded index for no larger than the table it comes from, so it would broadcast one of many times its threshold:
the joins of the index are told to merge, and its rows stay in the tasks.

Defined cases: a null or blank text has fingerprint zero and is linked like any other; fewer words than a shingle give
one shingle, the whole sequence; rows that repeat a text or an id are all reported; a null doc_id is never the smallest, and
a component of null ids alone has a null id. Very long texts are counted in blocks. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystar.llm.components import components
from tallystar.llm.shared import positional, restored, slices, written
from tallystar.tasks import ship_by_value

ship_by_value(__name__)

SHINGLE = 4
DISTANCE = 4
WIDE = 1 << 26
SEED = 42
_BLOCK = 1 << 16


def shingle_hashes(data: bytes, shingle: int):
    """Hashes of all shingles of a text in UTF-8, in blocks; none for a blank text."""
    import xxhash

    parts = data.lower().split()
    if not parts:
        return
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    starts = [0, *accumulate(len(p) + 1 for p in parts)]
    count = max(1, len(parts) - shingle + 1)
    ends = starts[min(shingle, len(parts)):]
    for first in range(0, count, _BLOCK):
        span = slice(first, min(first + _BLOCK, count))
        yield np.array([digest(joined[a:b - 1], SEED) for a, b in zip(starts[span], ends[span])], np.uint64)


def fingerprint(data: bytes, shingle: int) -> int:
    """The fingerprint of a text in UTF-8, as an unsigned 64-bit number."""
    totals, count = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(data, shingle):
        count += len(hashes)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        totals += bits.sum(axis=0, dtype=np.int64)
    if not count:
        return 0
    return int(np.packbits(2 * totals > count, bitorder="little").view("<u8")[0])


def _read(shingle: int):
    def run(batches):
        for batch in slices(batches):
            prints = [fingerprint((t or "").encode(), shingle) for t in batch.column(0).to_pylist()]
            signed = pa.array(np.array(prints, np.uint64).astype("<u8").view("<i8"))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], signed], [*batch.schema.names[1:], "f0"])
    return run


def fingerprint_table(docs: DataFrame, text: str, doc_id: str, shingle: int) -> DataFrame:
    """Rows (doc_id, text_hash, f0) of all documents; fingerprints as signed longs."""
    frame, names = positional(docs, text, doc_id)
    pair = frame.select(F.col(names[text]).alias("text"), F.col(names[doc_id]).alias("doc_id"),
                        F.xxhash64(names[text]).alias("text_hash"))
    kind = docs.schema[doc_id].dataType.simpleString()
    return pair.mapInArrow(_read(shingle), f"doc_id {kind}, text_hash long, f0 long")


def _byte(print_: Column, position: int) -> Column:
    return F.shiftright(print_, 8 * position).bitwiseAND(F.lit(255))


def _posted(rows: DataFrame, distance: int, width: int) -> DataFrame:
    """The index: each row once per set of positions, with ``place`` (which set) and ``bytes`` (the fingerprint there)."""
    sets = [sum(255 << 8 * p for p in positions) for positions in combinations(range(min(8, distance + width)), width)]
    marks = F.array(*[F.struct(F.lit(n).alias("place"), F.lit(_signed(mask)).alias("mask")) for n, mask in enumerate(sets)])
    spread = rows.withColumn("_mark", F.explode(marks))
    return spread.withColumn("place", F.col("_mark.place")).withColumn(
        "bytes", F.col("f0").bitwiseAND(F.col("_mark.mask"))).drop("_mark")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _close(a: str, b: str, distance: int) -> Column:
    """Count filter and verification of a pair of rows."""
    other = F.col(f"{a}.f0").bitwiseXOR(F.col(f"{b}.f0"))
    shared = sum(((_byte(other, p) == 0).cast("int") for p in range(8)), F.lit(0))
    return (shared >= 8 - distance) & (F.bit_count(other) <= distance)


def links(nodes: DataFrame, distance: int) -> DataFrame:
    """Labels (f0, component) of all different fingerprints in rows (f0)."""
    key = ["place", "bytes"]
    same = (F.col("a.place") == F.col("b.place")) & (F.col("a.bytes") == F.col("b.bytes"))
    width = min(3 if nodes.count() < WIDE else 4, 8 - distance)
    posted = _posted(nodes.select("f0"), distance, width)
    pivots = posted.groupBy(*key).agg(F.min("f0").alias("f0"), F.count("*").alias("members")).where("members > 1")
    starred = posted.alias("a").join(pivots.alias("b").hint("merge"), same & (F.col("a.f0") != F.col("b.f0"))
                                     & _close("a", "b", distance))
    first = components(starred.select(F.col("a.f0").alias("a"), F.col("b.f0").alias("b")))
    labelled = written(nodes.join(first, F.col("f0") == F.col("node"), "left").select(
        "f0", F.coalesce("component", "f0").alias("label")), "simhash-labels")

    posted = _posted(labelled, distance, width)
    several = posted.groupBy(*key).agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high")
    mixed = written(posted.join(several.select(*key).hint("merge"), key), "simhash-lists")
    largest = mixed.groupBy(*key, "label").agg(F.count("*").alias("n")).groupBy(*key).agg(
        F.max(F.struct("n", "label")).alias("top")).select(*key, F.col("top.label").alias("main"))
    few, every = mixed.join(largest.hint("merge"), key).where("label != main").alias("a"), mixed.alias("b")
    across = few.join(every.hint("merge"), same & (F.col("a.label") != F.col("b.label"))
                      & _close("a", "b", distance))
    second = components(across.select(F.col("a.label").alias("a"), F.col("b.label").alias("b")))
    return labelled.join(second, F.col("label") == F.col("node"), "left").select(
        "f0", F.coalesce("component", "label").alias("label"))


def near_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE,
                distance: int = DISTANCE) -> DataFrame:
    """One row per document: doc_id, text_hash, f0 (the fingerprint), label and component_id of its group.

    The label is the group's least fingerprint, component_id its smallest doc_id.
    """
    found = written(fingerprint_table(docs, text, doc_id, shingle), "simhash-prints")
    nodes = written(found.groupBy("f0").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    labels = written(links(nodes.drop("least"), distance), "simhash-groups")
    named = nodes.join(labels, "f0")
    ids = named.groupBy("label").agg(F.min("least").alias("component_id"))
    groups = named.join(ids, "label").select(F.col("f0").alias("g0"), "label", "component_id")
    return found.join(groups, F.col("f0") == F.col("g0")).select("doc_id", "text_hash", "f0", "label", "component_id")


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """One document of each group, that with the smallest doc_id, with the columns of the input.

    Rows that repeat the id and text of the one that stays are dropped too; of a group of null ids, one row stays.
    """
    frame, names = positional(docs, text, doc_id)
    groups = written(near_groups(docs, text, doc_id, **options), "near-groups")
    # Of rows with the group's smallest id (repeated ids), the least text hash decides.
    stays = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("label", "component_id").agg(
        F.min("text_hash").alias("text_hash"), F.count("*").alias("rows"))
    stays = written(stays.drop("label"), "near-kept")
    own = (F.col(names[doc_id]).eqNullSafe(F.col("component_id"))) & (F.xxhash64(names[text]) == F.col("text_hash"))
    kept = frame.join(stays, own)
    single = kept.where("rows = 1")
    if not stays.where("rows > 1").isEmpty():
        single = single.unionByName(kept.where("rows > 1").dropDuplicates([names[doc_id], "text_hash"]))
    return restored(single, docs)
