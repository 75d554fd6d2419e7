"""Quality rules: base rules, then a log-likelihood ratio of hashed n-grams.

Two multinomials over hashed words and word pairs are counted: one over the trusted target (documents with label
quality 1 and not toxic), one over the raw corpus, all its documents. The score of a document is its log-likelihood
ratio per n-gram, and a document is kept if that is at least ``threshold``; every document is judged, by no chance.
Raw counts cover every text. The trusted sample is bounded by ``TRUSTED_LIMIT`` ids (the smallest hashes of more), and
the ratios are one array of ``BUCKETS`` numbers whatever the input; both bounds hold for what travels to the tasks.

A bucket's ratio compares its count in the trusted text with the count that its share of the corpus would give there, both
raised by ``PRIOR``, so rare n-grams weigh little and text of wholly unknown n-grams stays near 0. Text like the target
scores about 0 or above; text whose n-grams the raw corpus has and the target lacks falls far below. The threshold of −0.07
nats per n-gram says that the target makes a document's n-grams on (geometric) average at least 0.93 times as likely as
the corpus does.

Defined cases: a null or blank text has no word and fails the base rules; without any trusted document the ratio is 0
for every document and only the base rules decide; labels of unknown ids and repeated labels change nothing, and rows
that repeat a doc_id are each counted. An empty table gives an empty result. Whole texts are counted, in pieces of
bounded size, so a very long text costs time but not memory. Further columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallystar.llm.shared import positional, restored, slices
from tallystar.llm.words import pieces, stirred, word_keys
from tallystar.tasks import ship_by_value

ship_by_value(__name__)

BUCKETS = 1 << 16
TRUSTED_LIMIT = 200_000
THRESHOLD = -0.07
MIN_WORDS = 50
PRIOR = 20.0
_SYMBOLS = b"#*$%&|<>"
_NO_SYMBOLS = bytes(b for b in range(256) if b not in _SYMBOLS)
_CONTINUATION = bytes(range(0x80, 0xC0))


def _base(data: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    words = data.split()
    joined = b"".join(words)
    chars = len(joined) - (len(joined) - len(joined.translate(None, _CONTINUATION)))
    lines = [line for line in data.split(b"\n") if line.strip()]
    repeats = 0
    if len(words) >= 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            first, covered = {}, bytearray(len(words))
            for at, window in enumerate(windows):
                seen = first.setdefault(window, at)
                if seen != at:
                    covered[at:at + 3] = covered[seen:seen + 3] = b"\x01\x01\x01"
            repeats = sum(covered)
    return len(words), chars, len(data.translate(None, _NO_SYMBOLS)), len(lines) - len(set(lines)), repeats


def _grams(data: bytes, buckets: int) -> list[np.ndarray]:
    """Bucket numbers of all words and word pairs of a text."""
    found, last = [], np.zeros(0, np.uint64)
    for _, piece in pieces(data):
        keys, _ = word_keys(np.frombuffer(piece, np.uint8))
        row = np.concatenate([last, keys])
        pairs = stirred(row[:-1] * np.uint64(3) + row[1:]) if len(row) > 1 else row[:0]
        found += [(keys % np.uint64(buckets)).astype(np.int64), (pairs % np.uint64(buckets)).astype(np.int64)]
        last = row[-1:]
    return found


def _count(buckets: int, trusted: frozenset):
    def run(batches):
        sums = np.zeros((2, buckets), np.int64)
        pending, held = ([], []), 0

        def tally():
            for row, grams in zip(sums, pending):
                if grams:
                    row += np.bincount(np.concatenate(grams), minlength=buckets)
                grams.clear()

        for batch in slices(batches):
            for text, doc_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for grams in _grams((text or "").encode(), buckets):
                    pending[0].append(grams)
                    if doc_id in trusted:
                        pending[1].append(grams)
                    held += len(grams)
                if held > 1 << 20:
                    tally()
                    held = 0
        tally()
        used = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[0][used]), pa.array(sums[1][used])],
                                         ["bucket", "raw", "target"])
    return run


def _judge(text_at: int, ratios: np.ndarray, threshold: float):
    def run(batches):
        for batch in slices(batches):
            rows = []
            for text in batch.column(text_at).to_pylist():
                data = (text or "").encode()
                base = _base(data)
                failed = base[0] < MIN_WORDS or 100 * base[4] > 50 * base[0]
                total, n = 0.0, 0
                for grams in _grams(data, len(ratios)):
                    total += float(ratios[grams].sum())
                    n += len(grams)
                score = total / n if n else 0.0
                rows.append((*base, score, failed, not failed and score >= threshold))
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in
                       enumerate([pa.int64()] * 5 + [pa.float64(), pa.bool_(), pa.bool_()])]
            yield pa.RecordBatch.from_arrays(batch.columns + columns, batch.schema.names + NOTES)
    return run


NOTES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed", "kept"]


def trusted_ids(labels: DataFrame, limit: int = TRUSTED_LIMIT) -> frozenset:
    """Ids of trusted documents; of more than ``limit`` those with the smallest hash."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).where(
        "quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null")
    chosen = good.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return frozenset(chosen.toArrow().column(0).to_pylist())


def gram_ratios(docs: DataFrame, trusted: frozenset, text: str = "text", doc_id: str = "doc_id",
                buckets: int = BUCKETS) -> np.ndarray:
    """Log-likelihood ratio of each bucket, trusted target against raw corpus."""
    frame, names = positional(docs, text, doc_id)
    counted = frame.select(names[text], names[doc_id]).mapInArrow(
        _count(buckets, trusted), "bucket long, raw long, target long")
    found = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    at, ratios = found.column(0).to_numpy(), np.zeros(buckets)
    raw, target = found.column(1).to_numpy().astype(float), found.column(2).to_numpy().astype(float)
    if target.sum():
        expected = raw * (target.sum() / raw.sum())
        ratios[at] = np.log((target + PRIOR) / (expected + PRIOR))
    return ratios


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", buckets: int = BUCKETS,
          threshold: float = THRESHOLD) -> DataFrame:
    """The documents as c0, c1, … with the counts, the score and the verdict of each."""
    ratios = gram_ratios(docs, trusted_ids(labels), text, doc_id, buckets)
    frame, _ = positional(docs, text)
    notes = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double, " \
            "base_failed boolean, kept boolean"
    schema = StructType(frame.schema.fields + StructType.fromDDL(notes).fields)
    return frame.mapInArrow(_judge(docs.columns.index(text), ratios, threshold), schema)


def accept(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are kept, with the columns of the input."""
    return restored(judge(docs, labels, **options).where("kept"), docs)
