"""Ranked lexical search by a dual tree over items and documents.

The items are the stated query set; all documents are searched for all of them. A document is a sparse vector of term
impacts, an item one of term weights. Both sides get a hierarchy: items are ordered by their weightiest terms, documents
of a chunk by their strongest one, and halved down to single items and leaves of ``LEAF`` documents. A node holds the
largest value of each coordinate below it. The product of an item node and a document node bounds every score between
them; where it stays below the smallest kth score known for the node's items, the pair of nodes is dropped with all
pairs in it. What is left is scored exactly. Ties at the kth score are never dropped.

1. One pass over the texts writes, per document, its length and the items' terms in it, and per task the number of
   documents and terms and the document frequencies.
2. A search over a hash-chosen share of the documents, about ``SEED_DOCS`` of them, gives a kth score per item. It is a
   true lower bound for any choice, so it only saves work.
3. Every task searches its chunks of documents with these bounds and its own, and returns what may still be among the
   best; a window per item takes the final ranks, after a window per task range has cut what is no longer needed.

Items go to the tasks in blocks of at most ``BLOCK_TERMS`` item terms, one search a block, so what is broadcast has a
fixed bound however many items there are; blocks are cut from a stream of items.

Defined cases: a null text has no terms; items and documents without terms have no rows. Rows of equal item_id form one
item with the terms of all of them. Repeated documents are ranked each. Of equal scores the smaller doc_id is first, a
null id last. Very long texts are read whole. An empty table gives no rows. Further columns are ignored. Ids of documents
are integers; ids of items can have any type.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallystar.llm.shared import positional, slices, written
from tallystar.tasks import ship_by_value

ship_by_value(__name__)

BEST = 50
LEAF = 16
CHUNK_DOCS = 1024
CHUNK_ENTRIES = 1 << 20
BLOCK_TERMS = 1 << 20
SEED_DOCS = 20_000
RANGES = 64

# ASCII characters other than digits and letters separate; only A-Z are lower-cased.
_FOLD = bytes(32 if c < 128 and not chr(c).isalnum() else c + 32 if 65 <= c <= 90 else c for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def _item_terms(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([list(set(terms_of(t))) for t in batch.column(1).to_pylist()], pa.list_(pa.binary()))],
            ["item", "terms"])


def item_blocks(items: DataFrame, text: str, item_id: str, block_terms: int) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Items in blocks of bounded size: their ids, and the sorted terms of each."""
    frame, names = positional(items, text, item_id)
    kind = items.schema[item_id].dataType.simpleString()
    told = frame.select(names[item_id], F.col(names[text]).cast("string")).mapInArrow(
        _item_terms, f"item {kind}, terms array<binary>")
    whole = told.select("item", F.explode("terms").alias("term")).groupBy("item").agg(
        F.sort_array(F.collect_set("term")).alias("terms")).orderBy("item")
    ids, terms, size = [], [], 0
    for row in whole.toLocalIterator():
        if ids and size + len(row.terms) > block_terms:
            yield ids, terms
            ids, terms, size = [], [], 0
        ids.append(row["item"])
        terms.append([bytes(t) for t in row.terms])
        size += len(row.terms)
    if ids:
        yield ids, terms


def _vectors(known):
    """Documents as counts of known terms, and a row of totals per task."""
    schema = pa.schema([("doc_id", pa.int64()), ("length", pa.int64()), ("terms", pa.list_(pa.int32())),
                        ("counts", pa.list_(pa.int64())), ("docs", pa.int64())])

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), schema.types)], schema=schema)

    def run(batches):
        from collections import Counter

        place = {term: at for at, term in enumerate(known.value)}
        frequency = np.zeros(len(place), np.int64)
        docs = words = 0
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = terms_of(text.as_py())
                if not found:
                    continue
                docs += 1
                words += len(found)
                held = sorted((place[t], n) for t, n in Counter(found).items() if t in place)
                if held:
                    terms, counts = zip(*held)
                    frequency[list(terms)] += 1
                    rows.append((doc_id, len(found), terms, counts, None))
            if rows:
                yield made(rows)
        seen = np.flatnonzero(frequency)
        yield made([(None, words, seen, frequency[seen], docs)])
    return run


class ItemTree:
    """Items in order of their weightiest terms; a level halves the one above, the last holds single items.

    A level is flat: ``terms`` and ``weights`` of all nodes one after the other, ``starts`` of each node, and the range
    of items ``first`` to ``last`` below it.
    """

    def __init__(self, terms: list[np.ndarray], weights: np.ndarray):
        heaviest = [t[np.lexsort((t, -weights[t]))][:4].tolist() for t in terms]
        self.order = sorted(range(len(terms)), key=lambda i: heaviest[i])
        sorted_terms = [terms[i] for i in self.order]
        ranges = [(0, len(terms))]
        self.levels = []
        while True:
            nodes = [np.unique(np.concatenate(sorted_terms[a:b])) for a, b in ranges]
            flat = np.concatenate(nodes)
            sizes = np.array([len(n) for n in nodes])
            self.levels.append((flat, weights[flat], np.cumsum(sizes) - sizes, sizes, np.array(ranges)))
            if all(b - a == 1 for a, b in ranges):
                return
            ranges = [r for a, b in ranges for r in ([(a, b)] if b - a == 1 else [(a, (a + b) // 2), ((a + b) // 2, b)])]

    def bounds(self, level: int, nodes: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Products of item nodes with each row of ``values``: an array of (rows, nodes)."""
        flat, weights, starts, sizes, _ = self.levels[level]
        size = sizes[nodes]
        begins = np.cumsum(size) - size
        at = np.repeat(starts[nodes] - begins, size) + np.arange(size.sum())
        return np.add.reduceat(values[..., flat[at]] * weights[at], begins, axis=-1)

    def below(self, level: int, nodes: np.ndarray) -> tuple[int, np.ndarray]:
        """The nodes of the next level that are below these."""
        if level + 1 == len(self.levels):
            return level, nodes
        ranges, onward = self.levels[level][4][nodes], self.levels[level + 1][4]
        left = np.searchsorted(onward[:, 0], ranges[:, 0])
        two = ranges[:, 1] - ranges[:, 0] > 1
        return level + 1, np.sort(np.concatenate([left, left[two] + 1]))


class Best:
    """The best documents of each item so far, in the order of the item tree."""

    def __init__(self, floor: np.ndarray, best: int):
        self.best, self.floor = best, floor.copy()
        self.rows = [np.zeros(0, np.int64)] * 4
        self.waiting: list[tuple] = []
        self.held = 0

    def add(self, items, scores, docs, missing):
        self.waiting.append((items, scores, docs, missing))
        self.held += len(items)
        if self.held > 1 << 18:
            self.settle()

    def settle(self):
        """Keep the best of each item and raise its floor to the kth score."""
        items, scores, docs, missing = (np.concatenate(c) for c in zip(tuple(self.rows), *self.waiting))
        order = np.lexsort((docs, missing, -scores, items))
        items, scores, docs, missing = items[order], scores[order], docs[order], missing[order]
        rank = np.arange(len(items)) - np.searchsorted(items, items)
        full = rank == self.best - 1
        self.floor[items[full]] = np.maximum(self.floor[items[full]], scores[full])
        kept = rank < self.best
        self.rows = [c[kept] for c in (items, scores, docs, missing)]
        self.waiting, self.held = [], 0


def _impacts(counts: np.ndarray, length: int, total_docs: int, total_terms: int) -> np.ndarray:
    size = 100 - 50 + 50 * length * total_docs // total_terms
    return 1_000_000_000 * counts // (1000 * counts + 20 * size)


def search_chunk(tree: ItemTree, n_terms: int, docs: list[tuple], found: Best) -> None:
    """Search documents (doc_id, terms, impacts) of one chunk; what may be among the best goes to ``found``."""
    weight = np.zeros(n_terms, np.int64)
    flat, weights = tree.levels[0][:2]
    weight[flat] = weights
    strongest = [int(t[np.argmax(weight[t] * v)]) for _, t, v in docs]
    docs = [docs[i] for i in sorted(range(len(docs)), key=strongest.__getitem__)]
    # The last level has the leaves of documents; a node above has the larger of its two children's values.
    leaves = [docs[a:a + LEAF] for a in range(0, len(docs), LEAF)]
    bottom = np.zeros((len(leaves), n_terms), np.int32)
    for leaf, row in zip(leaves, bottom):
        for _, terms, values in leaf:
            row[terms] = np.maximum(row[terms], values)
    levels = [bottom]
    while len(levels[0]) > 1:
        down = levels[0]
        up = down[::2].copy()
        np.maximum(up[:len(down) // 2], down[1::2], out=up[:len(down) // 2])
        levels.insert(0, up)

    def visit(depth: int, node: int, level: int, nodes: np.ndarray):
        while True:
            ranges = tree.levels[level][4][nodes]
            floor = np.minimum.reduceat(np.append(found.floor, np.iinfo(np.int64).max), ranges.ravel())[::2]
            bound = tree.bounds(level, nodes, levels[depth][node].astype(np.int64))
            nodes = nodes[(bound >= floor) & (bound > 0)]
            at_leaf = depth + 1 == len(levels)
            if not len(nodes) or not at_leaf or level + 1 == len(tree.levels):
                break
            level, nodes = tree.below(level, nodes)
        if not len(nodes):
            return
        if not at_leaf:
            level, nodes = tree.below(level, nodes)
            for child in (2 * node, 2 * node + 1):
                if child < len(levels[depth + 1]):
                    visit(depth + 1, child, level, nodes)
            return
        leaf = leaves[node]
        values = np.zeros((len(leaf), n_terms), np.int64)
        for row, (_, terms, impacts) in zip(values, leaf):
            row[terms] = impacts
        scores = tree.bounds(level, nodes, values)
        items = tree.levels[level][4][nodes][:, 0]
        doc_at, node_at = np.nonzero((scores >= found.floor[items]) & (scores > 0))
        ids = np.array([d[0] or 0 for d in leaf], np.int64)
        missing = np.array([d[0] is None for d in leaf], np.int64)
        found.add(items[node_at], scores[doc_at, node_at], ids[doc_at], missing[doc_at])

    visit(0, 0, 0, np.array([0]))
    found.settle()


_FOUND = "place int, score long, doc_id long, missing long, part int"


def _searched(sent, best: int):
    """Search the documents of a task chunk by chunk."""
    def run(batches):
        from pyspark import TaskContext

        terms, weights, floor, total_docs, total_terms = sent.value
        tree = ItemTree(terms, weights)
        found = Best(floor[tree.order], best)
        chunk, entries = [], 0

        def flush():
            if chunk:
                search_chunk(tree, len(weights), chunk, found)
                chunk.clear()

        for batch in slices(batches):
            for doc_id, length, has, counts in zip(*(c.to_pylist() for c in batch.columns)):
                chunk.append((doc_id, np.array(has), _impacts(np.array(counts, np.int64), length, total_docs, total_terms)))
                entries += len(has)
                if len(chunk) >= CHUNK_DOCS or entries >= CHUNK_ENTRIES:
                    flush()
                    entries = 0
        flush()
        items, scores, docs, missing = found.rows
        part = np.full(len(items), TaskContext.get().partitionId() % RANGES)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array(tree.order)[items], pa.int32()), pa.array(scores), pa.array(docs), pa.array(missing),
             pa.array(part, pa.int32())], ["place", "score", "doc_id", "missing", "part"])
    return run


def _top(frame: DataFrame, best: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "missing", "doc_id")
    return frame.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def _search_block(pairs: DataFrame, ids: list, terms: list[list[bytes]], best: int, seed_docs: int) -> DataFrame:
    """place, rank, doc_id and score of the best documents for one block of items."""
    spark = pairs.sparkSession
    known = sorted({t for some in terms for t in some})
    place = {t: at for at, t in enumerate(known)}
    made = written(pairs.mapInArrow(
        _vectors(spark.sparkContext.broadcast(known)),
        "doc_id long, length long, terms array<int>, counts array<long>, docs long"), "item-term-counts")
    totals = made.where("docs IS NOT NULL")
    total_docs, total_terms = totals.agg(F.sum("docs"), F.sum("length")).first()
    entry = F.explode(F.arrays_zip("terms", "counts")).alias("e")
    frequency = np.zeros(len(known), np.int64)
    for row in totals.select(entry).groupBy("e.terms").agg(F.sum("e.counts").alias("df")).toLocalIterator():
        frequency[row["terms"]] = row["df"]
    weights = np.array([math.floor(1000 * math.log((2 * (total_docs or 0) + 2) / (2 * int(n) + 1))) for n in frequency], np.int64)
    places = [np.array([place[t] for t in some]) for some in terms]
    vectors = made.where("docs IS NULL").select("doc_id", "length", "terms", "counts")

    def searched(frame: DataFrame, floor: np.ndarray) -> DataFrame:
        sent = spark.sparkContext.broadcast((places, weights, floor, total_docs or 0, total_terms or 1))
        found = frame.mapInArrow(_searched(sent, best), _FOUND)
        return _top(_top(found, best, "place", "part").drop("rank"), best, "place")

    floor = np.zeros(len(ids), np.int64)
    share = (total_docs or 0) // seed_docs
    if share > 1:
        chosen = F.pmod(F.xxhash64("doc_id", "length"), F.lit(share)) == 0
        for row in searched(vectors.where(chosen), floor).where(F.col("rank") == best).toLocalIterator():
            floor[row["place"]] = row["score"]
    return searched(vectors, floor)


def search(docs: DataFrame, items: DataFrame, best: int = BEST, text: str = "text", doc_id: str = "doc_id",
           item_text: str = "text", item_id: str = "item_id", block_terms: int = BLOCK_TERMS,
           seed_docs: int = SEED_DOCS) -> DataFrame:
    """Columns item_id, rank, doc_id, score: the ``best`` documents with a positive score for each item."""
    frame, names = positional(docs, text, doc_id)
    pairs = frame.select(F.col(names[doc_id]).cast("long"), F.col(names[text]).cast("string"))
    spark, kind = docs.sparkSession, items.schema[item_id].dataType
    empty = spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    parts = [empty]
    for ids, terms in item_blocks(items, item_text, item_id, block_terms):
        named = spark.createDataFrame(list(enumerate(ids)), f"place int, item_id {kind.simpleString()}")
        ranked = _search_block(pairs, ids, terms, best, seed_docs).join(named, "place")
        parts.append(written(ranked.select(
            "item_id", "rank", F.when(F.col("missing") == 0, F.col("doc_id")).alias("doc_id"), "score"), "ranked"))
    return reduce(DataFrame.unionAll, parts)
