"""Spelling variants: words one edit apart, found by products of letter-count blocks.

Words are runs of Latin letters, counted in the tasks before they are shuffled. A word is a vector of letter counts; one
inserted or deleted letter changes its square by 1, one replaced letter by 2, so near words have a squared distance of at
most 2. Words are dealt into blocks by how many letters of each of ``GROUPS`` letter groups they have, which also fixes
their length. One edit moves a word to a block that differs by one letter in one group, or by one letter more in one and
one less in another, so only such blocks of equal or adjacent length meet: as rows of a join, each with two blocks of
about ``BLOCK_WORDS`` words. NumPy multiplies their count matrices, keeps pairs at squared distance two or less, and every
kept pair is verified as one edit. Blocks of a crowded key are many, so no key meets in one task.

A task returns, per word, the number of near words and the best of them; pairs never leave it. Forms are followed by
pointer doubling, which ends after a few joins, as every step at least doubles the count.

Defined cases: a null text has no words; a null id counts as empty text where runs are altered. Repeated rows count each.
Words of any length are handled whole. Of near words with equal counts the first by code point is the form. An empty
table gives no rows. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystar.llm.shared import positional, slices, written
from tallystar.tasks import ship_by_value

ship_by_value(__name__)

MODULUS = 97
LEAST_LETTERS = 5
LEAST_COUNT = 3
GROUPS = 6
BLOCK_WORDS = 512
_HELD_WORDS = 200_000

LETTERS = [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]
_LETTER_PLACE = np.zeros(256, np.int64)
_LETTER_PLACE[LETTERS] = np.arange(len(LETTERS))
# In UTF-8, U+00C0 to U+00FF are the byte C3 and one further byte.
_RUN = re.compile(rb"(?:[a-z]|\xC3[\x80-\xBF])+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def altered(run: str, doc_id: str, modulus: int = MODULUS) -> str:
    """The run, without one letter where ``modulus`` divides the checksum of id and run."""
    mark = zlib.crc32(f"{doc_id}:{run}".encode())
    at = mark % len(run)
    return run[:at] + run[at + 1:] if mark % modulus == 0 else run


def _counted(modulus: int, least_letters: int):
    def emptied(totals):
        out = pa.RecordBatch.from_arrays(
            [pa.array([w.decode() for w in totals], pa.string()), pa.array(list(totals.values()), pa.int64())],
            ["word", "n"])
        totals.clear()
        return out

    def run(batches):
        from collections import Counter

        totals: dict[bytes, int] = {}
        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                if not text.is_valid:
                    continue
                start = zlib.crc32(f"{doc_id.as_py() or ''}:".encode())
                for word, n in Counter(_RUN.findall(text.as_py().encode().translate(_LOWER))).items():
                    if zlib.crc32(word, start) % modulus == 0:
                        word = altered(word.decode(), doc_id.as_py() or "", modulus).encode()
                    if len(word) >= least_letters:
                        totals[word] = totals.get(word, 0) + n
                if len(totals) > _HELD_WORDS:
                    yield emptied(totals)
        if totals:
            yield emptied(totals)
    return run


def count_words(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", modulus: int = MODULUS,
                least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """Columns word and n: all words of enough letters and occurrences."""
    frame, names = positional(docs, text, doc_id)
    rows = frame.select(F.col(names[doc_id]).cast("string"), F.col(names[text]).cast("string"))
    counted = rows.mapInArrow(_counted(modulus, least_letters), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(
        (F.col("n") >= least_count) & (F.length("word") >= least_letters))


def group_counts(word: Column) -> Column:
    """How many letters of each group the word has, as an array."""
    letters = ["".join(chr(c) for c in LETTERS if c % GROUPS == g) for g in range(GROUPS)]
    return F.array(*[F.length(word) - F.length(F.translate(word, some, "")) for some in letters])


def _moves() -> list[list[int]]:
    """From a block to itself and to the blocks one edit away, one direction of each pair."""
    one = np.eye(GROUPS, dtype=int)
    swaps = [one[i] - one[j] for i, j in itertools.combinations(range(GROUPS), 2)]
    return [[0] * GROUPS, *(m.tolist() for m in [*one, *swaps])]


def blocks_of(words: DataFrame) -> DataFrame:
    """Words in blocks: counts (array), key, part, and members (word, n)."""
    keyed = words.withColumn("counts", group_counts(F.col("word"))).withColumn("key", F.array_join(
        F.transform("counts", lambda c: c.cast("string")), ","))
    parts = keyed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_WORDS)).alias("parts"))
    placed = keyed.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("word"), "parts"))
    members = placed.groupBy("key", "part").agg(
        F.any_value("counts").alias("counts"), F.collect_list(F.struct("word", "n")).alias("members"))
    return members.select("key", "part", "counts", F.array_join("members.word", " ").alias("words"),
                          F.col("members.n").alias("ns"))


class Block:
    """Words of one length: their letters and letter counts as matrices, one row a word."""

    def __init__(self, words: list[str]):
        self.words, self.length = words, len(words[0])
        self.letters = np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), self.length)
        rows, size = np.repeat(np.arange(len(words)), self.length), len(LETTERS)
        flat = np.bincount(rows * size + _LETTER_PLACE[self.letters.ravel()], minlength=size * len(words))
        self.counts = flat.reshape(len(words), size).astype(np.float64)
        self.squares = (self.counts * self.counts).sum(1)


def near_pairs(left: Block, right: Block) -> tuple[np.ndarray, np.ndarray]:
    """Places of all words one edit apart; words of ``right`` are as long as those of ``left`` or one letter longer."""
    distances = left.counts @ right.counts.T
    distances *= -2
    distances += left.squares[:, None]
    distances += right.squares[None, :]
    i, j = np.nonzero(distances <= 2)
    a, b = left.letters[i], right.letters[j]
    if left.length == right.length:
        edit = (a != b).sum(1) == 1
    else:
        before = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(1)
        behind = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(1)
        edit = before + behind >= left.length
    return i[edit], j[edit]


class _Best:
    """Per word: how many near words there are, and the one of largest count, then first by code point."""

    def __init__(self):
        self.found: dict[str, list] = {}

    def add(self, left: Block, left_ns, right: Block, right_ns, within: bool):
        i, j = near_pairs(left, right)
        if within:
            i, j = i[i < j], j[i < j]
        for x, y in zip(i.tolist(), j.tolist()):
            self._note(left.words[x], right_ns[y], right.words[y])
            self._note(right.words[y], left_ns[x], left.words[x])

    def _note(self, word, n, other):
        entry = self.found.get(word)
        if entry is None:
            self.found[word] = [1, n, other]
            return
        entry[0] += 1
        if n > entry[1] or n == entry[1] and other < entry[2]:
            entry[1:] = n, other

    def batch(self):
        rows, self.found = self.found, {}
        columns = zip(*((w, *e) for w, e in rows.items())) if rows else ([], [], [], [])
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                          ["word", "n_near", "form_n", "form"])


def _best_near(batches):
    """Blocks that ask one block are met with it together while their rows follow each other."""
    best = _Best()
    at, right, right_ns, waiting = None, None, None, {}

    def meet():
        for words, ns in waiting.values():
            best.add(Block(words), ns, right, right_ns, False)
        waiting.clear()

    for batch in batches:
        names = ("left_key", "left_part", "left_words", "left_ns", "key", "part", "words", "ns")
        columns = [batch.column(n) for n in names]
        for row in range(batch.num_rows):
            left_key, left_part, left_text, left_ns, key, part, text, ns = (c[row] for c in columns)
            now = key.as_py(), part.as_py()
            if now != at:
                meet()
                at, right, right_ns = now, Block(text.as_py().split(" ")), ns.as_py()
            if now == (left_key.as_py(), left_part.as_py()):
                best.add(right, right_ns, right, right_ns, True)
                continue
            words = left_text.as_py().split(" ")
            held = waiting.setdefault(len(words[0]), ([], []))
            held[0].extend(words)
            held[1].extend(left_ns.as_py())
            if len(held[0]) > 8 * BLOCK_WORDS:
                meet()
        if len(best.found) > _HELD_WORDS // 4:
            yield best.batch()
    meet()
    yield best.batch()


def near_words(words: DataFrame) -> DataFrame:
    """Per word with a near word: n_near, and form_n and form of the near word of largest count."""
    blocks = written(blocks_of(words), "letter-blocks")
    moves = F.array(*[F.array(*[F.lit(v) for v in move]) for move in _moves()])
    asked = blocks.select(
        F.col("key").alias("left_key"), F.col("part").alias("left_part"), F.col("words").alias("left_words"),
        F.col("ns").alias("left_ns"), F.explode(F.transform(moves, lambda move: F.array_join(
            F.transform(F.zip_with("counts", move, lambda c, m: c + m), lambda c: c.cast("string")), ","))).alias("key"))
    # A merge join, so that the rows of a block follow each other.
    met = asked.join(blocks.select("key", "part", "words", "ns").hint("merge"), "key").where(
        (F.col("left_key") != F.col("key")) | (F.col("left_part") <= F.col("part")))
    found = met.select("left_key", "left_part", "left_words", "left_ns", "key", "part", "words", "ns").mapInArrow(
        _best_near, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("rank"), F.col("form"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("best.rank")).alias("form_n"), F.col("best.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """From (word, form) rows, the word at which following forms ends: (word, root)."""
    at = written(forms.select("word", F.col("form").alias("root")), "word-roots")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = at.join(onward, "root", "left")
        moved = written(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias(
            "moved")), "word-roots")
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return at


def group_variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", modulus: int = MODULUS,
                   least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root.

    The form is the near word of largest count, if that is at least twice the word's own.
    """
    words = written(count_words(docs, text, doc_id, modulus, least_letters, least_count), "words")
    linked = words.join(near_words(words), "word", "left")
    ample = F.col("form_n") >= 2 * F.col("n")
    formed = written(linked.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(ample, F.col("form")).alias("form"),
        F.when(ample, F.col("form_n")).alias("form_n")), "word-forms")
    last = roots(formed.where("form IS NOT NULL").select("word", "form"))
    return formed.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))
