"""Removal of long byte strings that occur more than once, with run-length compressed suffix indexes.

A byte goes if it lies in a string of ``LENGTH`` bytes that starts at another place too, in any document. Documents are
read as UTF-8, and strings never cross documents.

Candidates. Every window of ``LENGTH`` bytes has an anchor, the place of its least hashed gram of ``GRAM`` bytes, so equal windows
have equal anchor grams. Windows that follow each other and share an anchor make one snippet, the bytes they cover.
Snippets whose gram occurs once in the whole corpus hold no repeat. Of the others, equal snippets of a gram are counted
and kept once. A gram with one different snippet is settled: its windows are all repeats.

Index. The different snippets of the remaining grams are dealt to tasks by gram and indexed together, some megabytes at a
time: suffix array, Burrows-Wheeler transform, its runs, and the suffix-array samples at both ends of each run. Only at
the ends of runs the match of neighbouring suffixes is measured. Within a run the match of a place is that of the
place before it less one, so one pass over the text streams the matching statistics, the longest match of every place with
any other place, from the samples. Windows that match over ``LENGTH`` bytes or more are repeats.

Frequent grams. A gram with more than ``INDEXED`` different snippets is not indexed in one task. Its single windows are
counted by their 128-bit hash in an aggregation, which gives the same answer for any number of snippets.

Copies are counted before they are joined, so a group of any size is one row per task. Snippets of one gram are told
apart by 64-bit hashes. Defined cases: null and empty texts have no byte and nothing is removed; texts shorter than
``LENGTH`` stay whole; rows that repeat doc_id and text count as separate documents, so each removes the other's
windows; very long texts are read in chunks. An empty table gives an empty result. Further columns are not part of the result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystar.llm.shared import positional, slices, written
from tallystar.tasks import ship_by_value

ship_by_value(__name__)

LENGTH = 400
GRAM = 64
INDEXED = 1000
_INDEX_BYTES = 3 << 20
_CHUNK = 1 << 20
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def _words8(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as one number; zeros beyond the end."""
    out = np.zeros(len(data) + 7, np.uint64)
    out[:len(data)] = data
    for shift in (1, 2, 4):
        out[:-shift] |= out[shift:] << np.uint64(8 * shift)
    return out[:len(data)]


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from each place on."""
    x = _words8(data) * _K[0]
    width = 8
    while width < GRAM:
        x ^= x >> np.uint64(31)
        x = x[:-width] * _K[1] + x[width:] * _K[3]
        width *= 2
    x = x[:len(data) - GRAM + 1]
    x ^= x >> np.uint64(29)
    x *= _K[2]
    return x ^ (x >> np.uint64(32))


def snippet_runs(data: bytes, length: int = LENGTH):
    """Arrays (gram, first window, last window) of the snippets of a text."""
    found = []
    for at in range(0, max(0, len(data) - length + 1), _CHUNK):
        part = np.frombuffer(data, np.uint8)[at:at + _CHUNK + length - 1]
        grams = _gram_hashes(part)
        key = (grams >> np.uint64(24) << np.uint64(24)) | np.arange(len(grams), dtype=np.uint64)
        reach, wanted = 1, length - GRAM + 1
        least = key
        while reach < wanted:
            step = min(reach, wanted - reach)
            least = np.minimum(least[:-step], least[step:])
            reach += step
        anchor = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        firsts = np.flatnonzero(np.diff(anchor, prepend=-1))
        lasts = np.append(firsts[1:], len(anchor)) - 1
        found.append((grams[anchor[firsts]], firsts + at, lasts + at))
    return [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.uint64)] + [np.zeros(0, np.int64)] * 2


def _read(length: int):
    def run(batches):
        import xxhash

        digest = xxhash.xxh64_intdigest
        for batch in slices(batches):
            rows, held = [], 0
            for at, text in enumerate(batch.column(0).to_pylist()):
                data = (text or "").encode()
                grams, firsts, lasts = snippet_runs(data, length)
                hashes = np.array([digest(data[a:b + length]) for a, b in zip(firsts.tolist(), lasts.tolist())], np.uint64)
                rows.append((np.full(len(grams), at), grams, firsts, lasts, hashes))
                held += len(grams)
                if held > 100_000:
                    yield _run_batch(batch, rows)
                    rows, held = [], 0
            if rows:
                yield _run_batch(batch, rows)
    return run


def _run_batch(batch, rows):
    at, grams, firsts, lasts, hashes = (np.concatenate(c) for c in zip(*rows))
    keys = batch.select([1, 2]).take(pa.array(at))
    return pa.RecordBatch.from_arrays(
        [pa.array(grams.view(np.int64)), pa.array(hashes.view(np.int64)), *keys.columns, pa.array(firsts), pa.array(lasts)],
        ["gram", "snippet", "doc", "text_hash", "first", "last"])


def suffix_array(codes: np.ndarray, base: int) -> np.ndarray:
    """Suffix array of codes below ``base`` whose last one is unique, by prefix doubling on what is still tied."""
    n = len(codes)
    packed = 1
    while base ** (packed + 1) < 1 << 62 and packed < 8:
        packed += 1
    key = np.zeros(n, np.int64)
    for k in range(packed):
        key = key * base
        key[:n - k] += codes[k:]
    rank, tied, reach = np.zeros(n, np.int64), np.arange(n), packed
    while len(tied):
        order = np.argsort(key)
        tied, key = tied[order], key[order]
        old = rank[tied]
        new_group = np.diff(old, prepend=-1) != 0
        group_at = np.maximum.accumulate(np.where(new_group, np.arange(len(tied)), 0))
        slot = old + np.arange(len(tied)) - group_at
        fresh = np.diff(key, prepend=-1) != 0
        fresh_at = np.flatnonzero(fresh)
        sizes = np.diff(np.append(fresh_at, len(tied)))
        rank[tied] = np.repeat(slot[fresh_at], sizes)
        tied = tied[np.repeat(sizes > 1, sizes)]
        further = np.where(tied + reach < n, rank[np.minimum(tied + reach, n - 1)] + 1, 0)
        key = rank[tied] * (n + 1) + further
        reach *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def matching_statistics(snippets: list[bytes]) -> list[np.ndarray]:
    """For every place of every snippet, the length of its longest match with another place, within the snippets."""
    data = np.frombuffer(b"\0".join(snippets) + b"\0", np.uint8)
    ends = np.cumsum([len(s) + 1 for s in snippets]) - 1
    codes = data.astype(np.int64) + len(snippets)
    codes[ends] = np.arange(len(snippets))  # each end mark is a symbol of its own, below all bytes
    suffixes = suffix_array(codes, len(snippets) + 256)
    transform = codes[suffixes - 1]
    heads = np.flatnonzero(transform[1:] != transform[:-1]) + 1
    one, two = suffixes[heads - 1], suffixes[heads]
    left = ends[np.searchsorted(ends, np.arange(len(data)))] - np.arange(len(data))
    match = _common(_words8(data), one, two, np.minimum(left[one], left[two]))
    best = np.zeros(len(data), np.int64)
    for places in (one, two):
        sample = np.zeros(len(data), np.int64)
        sample[places] = match
        stream = np.maximum.accumulate(sample + np.arange(len(data))) - np.arange(len(data))
        np.maximum(best, stream, out=best)
    return [part[:-1] for part in np.split(best, ends[:-1] + 1)]


def _common(words: np.ndarray, one: np.ndarray, two: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each pair of places, at most its limit."""
    out, live, depth = limit.copy(), np.flatnonzero(limit > 0), 0
    while len(live):
        other = words[one[live] + depth] ^ words[two[live] + depth]
        stopped = other != 0
        low = other[stopped] & (~other[stopped] + np.uint64(1))
        out[live[stopped]] = np.minimum(out[live[stopped]], depth + np.bitwise_count(low - np.uint64(1)).astype(np.int64) // 8)
        depth += 8
        live = live[~stopped]
        live = live[limit[live] > depth]
    return out


def _spans(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return [(int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2])]


def _index(length: int):
    """Match the different snippets of whole grams in a stream that is sorted by gram."""
    def settle(rows):
        found = matching_statistics([r[2] for r in rows])
        for (gram, snippet, data, copies), match in zip(rows, found):
            windows = match[:len(data) - length + 1] >= length
            yield gram, snippet, _spans(windows | (copies > 1))

    def run(batches):
        rows, held, last = [], 0, None
        for batch in batches:
            for gram, snippet, data, copies in zip(*[c.to_pylist() for c in batch.columns]):
                if rows and rows[-1][:2] == (gram, snippet):
                    continue
                if held > _INDEX_BYTES and gram != last:
                    yield _span_batch(settle(rows))
                    rows, held = [], 0
                rows.append((gram, snippet, data, copies))
                held, last = held + len(data), gram
        if rows:
            yield _span_batch(settle(rows))
    return run


_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def _span_batch(found):
    grams, snippets, spans = zip(*found)
    return pa.RecordBatch.from_arrays(
        [pa.array(grams, pa.int64()), pa.array(snippets, pa.int64()),
         pa.array([[{"first": a, "last": b} for a, b in s] for s in spans], _SPANS)], ["gram", "snippet", "spans"])


def _fetch(length: int):
    """Bytes of the wanted snippets; for frequent grams, hashes of their windows instead."""
    def run(batches):
        for batch in slices(batches):
            rows = []
            for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = (text or "").encode()
                for w in wanted:
                    part = data[w["first"]:w["last"] + length]
                    hashes = None
                    if w["frequent"]:
                        hashes = [hashlib.blake2b(part[i:i + length], digest_size=16).digest() for i in range(len(part) - length + 1)]
                        part = None
                    rows.append((w["gram"], w["snippet"], part, w["copies"], hashes))
                    if len(rows) == 5000:
                        yield _snippet_batch(rows)
                        rows = []
            if rows:
                yield _snippet_batch(rows)
    return run


def _snippet_batch(rows):
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                      ["gram", "snippet", "data", "copies", "windows"])


def _cut(length: int):
    def run(batches):
        for batch in slices(batches):
            rows = []
            for text, spans in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                data = (text or "").encode()
                runs, kept, at = [], [], 0
                for s in sorted((s["first"], s["last"] + length) for s in spans or []):
                    if runs and s[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s[1])
                    else:
                        runs.append(list(s))
                for a, b in runs:
                    kept.append(data[at:a])
                    at = b
                kept.append(data[at:])
                rest = b"".join(kept)
                rows.append((len(data), len(data) - len(rest), len(runs), rest, [{"first": a, "last": b} for a, b in runs]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), _LONG_SPANS]
            yield pa.RecordBatch.from_arrays([batch.column(1), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "removed"])
    return run


_LONG_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def repeated_windows(docs: DataFrame, text: str, doc_id: str, length: int = LENGTH, indexed: int = INDEXED) -> DataFrame:
    """Rows (doc, text_hash, first, last): runs of window starts that are repeats."""
    kind = docs.schema[doc_id].dataType.simpleString()
    runs = written(docs.select(text, F.col(doc_id).alias("doc"), F.xxhash64(text).alias("text_hash")).mapInArrow(
        _read(length), f"gram long, snippet long, doc {kind}, text_hash long, first long, last long"), "repeat-runs")
    # Counts are written before they are joined: a join with an aggregation in its own stage cannot split a frequent gram.
    twice = written(runs.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select(F.col("gram").alias("twice")), "repeat-grams")
    places = written(runs.join(twice, F.col("gram") == F.col("twice")).drop("twice"), "repeat-places")
    different = written(places.groupBy("gram", "snippet").agg(
        F.count("*").alias("copies"), F.min(F.struct(F.col("doc").isNull(), "doc", "text_hash", "first", "last")).alias("at")),
        "repeat-snippets")
    kinds = written(different.groupBy("gram").agg(F.count("*").alias("kinds")), "repeat-kinds")
    settled = kinds.where("kinds = 1").join(different, "gram").select(
        "gram", "snippet", F.array(F.struct(F.lit(0).alias("first"), (F.col("at.last") - F.col("at.first")).cast("int").alias("last"))).alias("spans"))

    open_ = kinds.where("kinds > 1").join(different, "gram").groupBy(
        F.col("at.doc").alias("own"), F.col("at.text_hash").alias("own_hash")).agg(F.collect_list(F.struct(
            "gram", "snippet", F.col("at.first").alias("first"), F.col("at.last").alias("last"), "copies",
            (F.col("kinds") > indexed).alias("frequent"))).alias("wanted"))
    own = F.col(doc_id).eqNullSafe(F.col("own")) & (F.xxhash64(text) == F.col("own_hash"))
    fetched = written(docs.select(text, doc_id).join(open_, own).select(text, "wanted").mapInArrow(
        _fetch(length), "gram long, snippet long, data binary, copies long, windows array<binary>"), "repeat-bytes")
    matched = fetched.where("data is not null").select("gram", "snippet", "data", "copies").repartition("gram").sortWithinPartitions(
        "gram", "snippet").mapInArrow(_index(length), "gram long, snippet long, spans array<struct<first:int,last:int>>")

    windows = fetched.where("data is null").groupBy("gram", "snippet").agg(
        F.first("windows").alias("windows"), F.max("copies").alias("copies")).select(
        "gram", "snippet", "copies", F.posexplode("windows").alias("offset", "window"))
    met = windows.groupBy("window").agg(F.sum("copies").alias("times")).where("times > 1").select(F.col("window").alias("met"))
    counted = windows.join(met, F.col("window") == F.col("met")).select(
        "gram", "snippet", F.array(F.struct(F.col("offset").alias("first"), F.col("offset").alias("last"))).alias("spans"))

    found = settled.unionByName(matched).unionByName(counted).withColumnsRenamed({"gram": "g", "snippet": "s"})
    return places.join(found, (F.col("gram") == F.col("g")) & (F.col("snippet") == F.col("s"))).select(
        "doc", "text_hash", F.col("first").alias("from"), F.inline("spans")).select(
        "doc", "text_hash", (F.col("from") + F.col("first")).alias("first"), (F.col("from") + F.col("last")).alias("last"))


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH,
                   indexed: int = INDEXED) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes), removed (its spans, end exclusive)."""
    frame, names = positional(docs, text, doc_id)
    t, d = names[text], names[doc_id]
    spans = repeated_windows(frame, t, d, length, indexed).groupBy("doc", "text_hash").agg(
        F.collect_set(F.struct("first", "last")).alias("spans"))
    own = F.col(d).eqNullSafe(F.col("doc")) & (F.xxhash64(t) == F.col("text_hash"))
    kind = docs.schema[doc_id].dataType.simpleString()
    return frame.select(t, d).join(spans, own, "left").select(t, d, "spans").mapInArrow(
        _cut(length), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, "
                      "removed array<struct<first:bigint,last:bigint>>")
