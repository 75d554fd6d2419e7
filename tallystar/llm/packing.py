"""Harmonic packing of tokenised documents into fixed-length sequences.

A document's ids are cut into pieces whose lengths are reciprocals of the capacity: capacity // k for the classes k in
``CLASSES``. Class k fills a bin with exactly k pieces, so a full bin of a class wastes capacity mod (capacity // k)
places, at most 0.4 %. The tail of a document goes to the largest class that it fills, what remains to the next, down to
single ids. Each task fills the bins of its classes by itself: nothing is shuffled, no order between tasks is needed,
and a repeated task makes the same bins of the same rows.

When a task ends, a class has less than one bin of pieces left. These leftovers, together bounded by the number of
classes times the capacity, are laid end to end into full sequences; the last rest is cut into lengths that are
powers of two, which need no padding.

Ids come from the tokenizer, word by word: its normaliser and its splitting never look across ASCII white space, so the
ids of a text are those of its words in order. Words a worker has met lately are kept in two tables of bounded size
(``KNOWN_WORDS`` each, the older one dropped when the newer is full; none of over ``LONG_WORD`` bytes), which later tasks of
the same worker reuse.

Defined cases: a null or empty text is the end id alone, so every document has at least one piece; rows that repeat a
doc_id are separate documents; an empty table gives no piece. A very long text is cut like any other. Further columns
are not part of the result.
"""

from __future__ import annotations

import re
import zlib
from array import array
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystar.llm.shared import WORKER_WORDS, positional, slices
from tallystar.tasks import ship_by_value

ship_by_value(__name__)

CAPACITY = 2048
END_ID = 1
KNOWN_WORDS = 250_000
_BATCH_BYTES = 4 << 20
LONG_WORD = 200
TOKENIZER = "word_bpe_49k.json"
# Splitting and normalising agree with these: signs behind a letter, up to the end of the word, are a token start of their own
# (an apostrophe is not always), and letters are made small anyway. It leaves fewer different words to keep. The pattern begins
# with the sign, so that the search skips to the next one.
_CLOSED = re.compile(rb"[!-&(-/:-@\[-`{-~](?<=[a-z].)[!-&(-/:-@\[-`{-~]*(?=[\x20\x09-\x0D]|\Z)")
SCHEMA = "doc_id {kind}, start long, length long, ids array<int>, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def class_sizes(capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(pieces per bin, piece length), longest first: reciprocals that waste at most 0.4 %, then powers of two."""
    wanted = {k: capacity // k for k in range(1, capacity + 1)
              if (k <= 16 or k & (k - 1) == 0) and 250 * (capacity - k * (capacity // k)) <= capacity}
    wanted.setdefault(capacity, 1)
    by_size = {}
    for k, size in wanted.items():
        by_size[size] = max(k, by_size.get(size, 0))
    return sorted(((k, size) for size, k in by_size.items()), key=lambda c: -c[1])


def encoder(tokenizer_path: str, known_words: int = KNOWN_WORDS):
    """A function from texts to their ids, each as bytes (unsigned 32-bit, little endian)."""
    import sys
    import types

    # Outlives this task, not this Python worker.
    keep = sys.modules.setdefault(WORKER_WORDS, types.ModuleType(WORKER_WORDS))
    if getattr(keep, "path", None) != tokenizer_path:
        from tokenizers import Tokenizer

        keep.tokenizer, keep.path = Tokenizer.from_file(tokenizer_path), tokenizer_path
        keep.words, keep.older = {}, {}
        vocabulary = keep.tokenizer.get_vocab(with_added_tokens=True)
        keep.closing = np.zeros(max(vocabulary.values()) + 1, bool)
        keep.closing[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
    tokenizer = keep.tokenizer

    def learn(new: list[bytes], words: dict) -> None:
        """Encode several words as one text and deal its ids out."""
        texts = [w.decode() for w in new]
        # Nothing is to be split or normalised in small ASCII letters: the model alone gives their ids.
        plain = [t.isascii() and t.isalpha() and t.islower() for t in texts]
        model = tokenizer.model
        for word, text in compress(zip(new, texts), plain):
            words[word] = array("I", [token.id for token in model.tokenize(text)]).tobytes()
        new, texts = ([w for w, done in zip(part, plain) if not done] for part in (new, texts))
        letters = [k for k, t in enumerate(texts) if t.isalpha()]
        others = [k for k, t in enumerate(texts) if not t.isalpha()]
        for chosen in (letters, others):
            for first in range(0, len(chosen), 256):
                part = [texts[k] for k in chosen[first:first + 256]]
                # A word of letters ends with its only closing token; others are told by their places in the text.
                if chosen is letters:
                    ids = np.array(tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
                    ends = np.flatnonzero(keep.closing[ids]) + 1
                if chosen is others or len(ends) != len(part):
                    code = tokenizer.encode(" ".join(part), add_special_tokens=False)
                    ids = np.array(code.ids, "<u4")
                    starts = np.cumsum([len(t) + 1 for t in part])
                    ends = np.searchsorted(np.array([o[0] for o in code.offsets], np.int64), starts)
                data, at = ids.tobytes(), 0
                for k, end in zip(chosen[first:first + 256], (4 * ends).tolist()):
                    words[new[k]] = data[at:end]
                    at = end

    def split(text: str | None) -> list[bytes]:
        data = (text or "").encode()
        if b"<|" not in data:  # special tokens are matched before letters are made small
            data = _CLOSED.sub(rb" \g<0>", data.lower())
        return data.split()

    def encode(texts: list[str | None]) -> list[bytes]:
        parted = [split(t) for t in texts]
        words = keep.words
        found = [list(map(words.get, parts)) for parts in parted]
        lacking = [(ids, parts, at) for ids, parts in zip(found, parted) for at in _absent(ids)]
        new = {parts[at] for _, parts, at in lacking}
        if len(words) + len(new) > known_words:
            keep.older, keep.words = words, {}
        words = keep.words
        words.update({p: keep.older[p] for p in new & keep.older.keys()})
        new = {p for p in new if p not in words}
        long_ = {p for p in new if len(p) > LONG_WORD}
        learn(list(new - long_), words)
        alone = {p: np.array(tokenizer.encode(p.decode(), add_special_tokens=False).ids, "<u4").tobytes() for p in long_}
        for ids, parts, at in lacking:
            ids[at] = words[parts[at]] if parts[at] in words else alone[parts[at]]
        return [b"".join(ids) for ids in found]
    return encode


def _absent(values: list):
    """The places of None."""
    at = -1
    try:
        while True:
            at = values.index(None, at + 1)
            yield at
    except ValueError:
        return


class _Bins:
    """The open bins of one task."""

    def __init__(self, task: int, capacity: int):
        self.next_id, self.capacity = task << 36, capacity
        self.open = {size: [] for _, size in class_sizes(capacity)}
        self.full = {size: k for k, size in class_sizes(capacity)}

    def _sequence(self, pieces):
        offset = 0
        for doc, start, data, total in pieces:
            yield doc, start, data, total, self.next_id, offset
            offset += len(data) // 4
        self.next_id += 1

    def add(self, doc, ids: bytes):
        total, at = len(ids) // 4, 0
        for size, bin_ in self.open.items():
            while total - at >= size:
                bin_.append((doc, at, ids[4 * at:4 * (at + size)], total))
                at += size
                if len(bin_) == self.full[size]:
                    yield from self._sequence(bin_)
                    bin_.clear()

    def rest(self):
        """Lay what is left end to end, the last part in lengths that are powers of two."""
        left = [p for bin_ in self.open.values() for p in bin_][::-1]
        tokens = sum(len(p[2]) // 4 for p in left)
        while tokens:
            length = min(self.capacity, 1 << (tokens.bit_length() - 1))
            tokens -= length
            pieces = []
            while length:
                doc, start, data, total = left.pop()
                take = min(length, len(data) // 4)
                pieces.append((doc, start, data[:4 * take], total))
                if 4 * take < len(data):
                    left.append((doc, start + take, data[4 * take:], total))
                length -= take
            yield from self._sequence(pieces)


def _pack(text_at, id_at, tokenizer_path, capacity, end_id):
    def run(batches):
        from pyspark import TaskContext

        encode, bins = encoder(tokenizer_path), _Bins(TaskContext.get().partitionId(), capacity)
        end, rows, held = np.array([end_id], "<u4").tobytes(), [], 0

        def batch():
            data = b"".join(r[2] for r in rows)
            ends = np.cumsum([0] + [len(r[2]) // 4 for r in rows]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(data, "<i4")))
            longs = zip(*[(r[1], len(r[2]) // 4, zlib.crc32(r[2]), r[3], r[4], r[5]) for r in rows])
            start, length, crc, total, sequence, offset = (pa.array(v, pa.int64()) for v in longs)
            out = [pa.array([r[0] for r in rows], kind), start, length, ids, crc, total, sequence, offset]
            rows.clear()
            return pa.RecordBatch.from_arrays(out, ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens",
                                                    "sequence_id", "offset"])

        for part in slices(batches, keep_words=True):
            kind = part.schema.field(id_at).type
            for ids, doc in zip(encode(part.column(text_at).to_pylist()), part.column(id_at).to_pylist()):
                for piece in bins.add(doc, ids + end):
                    rows.append(piece)
                    held += len(piece[2])
                    if len(rows) == 10_000 or held >= _BATCH_BYTES:
                        yield batch()
                        held = 0
        rows += bins.rest()
        if rows:
            yield batch()
    return run


def tokenizer_file(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", tokenizer_path: str | None = None,
         capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece, with its ids."""
    frame, names = positional(docs, text, doc_id)
    pair = frame.select(names[text], names[doc_id])
    schema = SCHEMA.format(kind=docs.schema[doc_id].dataType.simpleString())
    return pair.mapInArrow(_pack(0, 1, tokenizer_path or tokenizer_file(), capacity, end_id), schema)
