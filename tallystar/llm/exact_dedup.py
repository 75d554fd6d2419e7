"""Exact duplicates by skew-safe combining.

Texts are equal when they are identical after all ASCII white space is deleted. Copies are combined three times, and
each time the whole content is compared, not only its digest:

1. locally, inside every Arrow batch of a task;
2. per (digest, salt), the salt being the task a row came from, so copies of one text meet in many tasks at first;
3. per digest, where at most ``salts`` rows of a content are left.

A merge reads its partition sorted by digest as a stream and holds one row per different content of one digest.
A group of copies of any size therefore never meets in one task.

Defined cases: a null text counts as empty, so all empty and blank texts form one group. Of equal texts the row with
the most code points stays, then the smallest doc_id, a null doc_id last; rows that repeat text and doc_id count as
copies and one of them stays. Ids can have any ordered type. An empty table gives an empty result. Further columns pass through, also when they are
called ``digest`` or ``group_size``.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from tallystar.llm.shared import positional, restored, slices, trim, written
from tallystar.tasks import ship_by_value

ship_by_value(__name__)

SALTS = 16
_BLANKS = b" \t\n\x0b\x0c\r"
_NOTES = StructType([
    StructField("_digest", StringType()), StructField("_length", LongType()), StructField("_size", LongType()),
    StructField("_salt", LongType()), StructField("_clash", BooleanType()),
])


def sha256_hex(content: bytes) -> str:
    return hashlib.sha256(content).hexdigest()


def _content(text: str | None) -> bytes:
    return (text or "").encode().translate(None, _BLANKS)


def _better(a: tuple, b: tuple) -> bool:
    """Whether row a = (length, doc_id) stays rather than b."""
    if a[0] != b[0]:
        return a[0] > b[0]
    return a[1] is not None and (b[1] is None or a[1] < b[1])


def _local(text_at: int, id_at: int, digest):
    def run(batches):
        from pyspark import TaskContext

        salt = TaskContext.get().partitionId() % SALTS
        for batch in batches:
            found: dict[str, list] = {}
            for at, (text, doc_id) in enumerate(_pairs(batch, text_at, id_at)):
                content = _content(text)
                key = digest(content)
                rank = (len(text or ""), doc_id)
                for entry in found.setdefault(key, []):
                    if entry[0] == content:
                        entry[3] += 1
                        if _better(rank, entry[1]):
                            entry[1], entry[2] = rank, at
                        break
                else:
                    found[key].append([content, rank, at, 1])
            rows = [(key, e) for key, entries in found.items() for e in entries]
            found.clear()
            taken = batch.take([e[2] for _, e in rows])
            notes = [(key, e[1][0], e[3], salt, False) for key, e in rows]
            del batch, rows
            yield _noted(taken, notes)
            del taken
            trim()
    return run


def _pairs(batch, text_at: int, id_at: int):
    """Text and id of each row, a few texts as Python objects at a time."""
    for part in slices([batch]):
        yield from zip(part.column(text_at).to_pylist(), part.column(id_at).to_pylist())


def _noted(batch, notes):
    columns = [pa.array([n[i] for n in notes], t) for i, t in
               enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()))]
    names = batch.schema.names + _NOTES.names
    return pa.RecordBatch.from_arrays(batch.columns + columns, names)


def _merge(text_at: int, id_at: int, n_columns: int):
    """Combine the rows of equal content in a stream that is sorted by digest."""

    def flush(key, entries):
        if entries:
            row = pa.concat_batches([e[2] for e in entries])
            yield _noted(row.select(range(n_columns)), [(key, e[1][0], e[3], e[4], len(entries) > 1) for e in entries])

    def run(batches):
        key, entries, ready, held = None, [], [], 0
        for batch in slices(batches):
            texts, ids = batch.column(text_at).to_pylist(), batch.column(id_at).to_pylist()
            digests, lengths, sizes, salts = (batch.column(n_columns + i).to_pylist() for i in range(4))
            for at, now in enumerate(digests):
                if now != key:
                    ready += flush(key, entries)
                    held += sum(len(e[0]) for e in entries)
                    if len(ready) >= 500 or held > 2 << 20:
                        yield pa.concat_batches(ready)
                        ready, held = [], 0
                    key, entries = now, []
                content, rank = _content(texts[at]), (lengths[at], ids[at])
                for entry in entries:
                    if entry[0] == content:
                        entry[3] += sizes[at]
                        if _better(rank, entry[1]):
                            entry[1], entry[2] = rank, batch.slice(at, 1)
                        break
                else:
                    entries.append([content, rank, batch.slice(at, 1), sizes[at], salts[at]])
        ready += flush(key, entries)
        if ready:
            yield pa.concat_batches(ready)
    return run


def combine(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", digest=sha256_hex) -> DataFrame:
    """One row per different content: the row that stays as c0, c1, …, with _digest, _length, _size and _clash.

    ``_clash`` marks a digest that several contents share.
    """
    frame, names = positional(docs, text, doc_id)
    text_at, id_at, width = docs.columns.index(text), docs.columns.index(doc_id), len(docs.columns)
    schema = StructType(frame.schema.fields + _NOTES.fields)
    merge = _merge(text_at, id_at, width)
    local = frame.mapInArrow(_local(text_at, id_at, digest), schema)
    salted = local.repartition("_digest", "_salt").sortWithinPartitions("_digest").mapInArrow(merge, schema)
    return salted.repartition("_digest").sortWithinPartitions("_digest").mapInArrow(merge, schema)


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", digest=sha256_hex) -> DataFrame:
    """The rows that stay, with the columns of the input."""
    return restored(combine(docs, text, doc_id, digest), docs)


def _own(text_at: int, id_at: int, digest, with_content: bool):
    def run(batches):
        for batch in slices(batches):
            contents = [_content(t) for t in batch.column(text_at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_at), pa.array([digest(c) for c in contents], pa.string()),
                 pa.array(contents if with_content else [None] * len(contents), pa.binary())],
                ["doc_id", "digest", "content"])
    return run


def assign(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", digest=sha256_hex) -> DataFrame:
    """One row per input row: doc_id, digest, keep_id, group_size, kept.

    Rows that repeat the doc_id of the row that stays are the same document and all carry kept = true.
    Digests of several contents, which no input is known to have, are joined by content in a second pass.
    """
    at = docs.columns.index(text), docs.columns.index(doc_id)
    kind = docs.schema[doc_id].dataType
    best = combine(docs, text, doc_id, digest)
    found = written(best.select(
        F.col("_digest").alias("group"), F.col(f"c{at[1]}").alias("keep_id"), F.col("_size").alias("group_size"),
        F.col("_clash").alias("clash"),
        F.when(F.col("_clash"), F.regexp_replace(F.coalesce(F.col(f"c{at[0]}"), F.lit("")), r"[\x20\x09-\x0D]+", "")
               .cast("binary")).alias("group_content")), "exact-groups")
    schema = f"doc_id {kind.simpleString()}, digest string, content binary"
    frame, names = positional(docs, text, doc_id)
    pair = frame.select(names[text], names[doc_id])

    def joined(with_content: bool) -> DataFrame:
        own = pair.mapInArrow(_own(0, 1, digest, with_content), schema)
        same = own["digest"] == found["group"]
        if with_content:
            same &= found["clash"] & (own["content"] == found["group_content"])
        else:
            same &= ~found["clash"]
        return own.join(found, same).select(
            "doc_id", "digest", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))

    plain = joined(False)
    return plain if found.where("clash").isEmpty() else plain.unionByName(joined(True))
