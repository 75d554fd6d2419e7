import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from tallystar.llm import packing, quality, suffix_tree, words


def text_of(rng, n, vocabulary="the of and to in model data text spark page line word set"):
    return " ".join(rng.choice(vocabulary.split()) for _ in range(n))


def test_word_hashes_tell_words_apart_at_any_place():
    rng = random.Random(2)
    data = " ".join("".join(rng.choice("ab\u00e9z") for _ in range(rng.randrange(1, 9))) for _ in range(4000)).encode()
    keys, starts = words.text_keys(data + b" " + data)
    named = {}
    for key, at in zip(keys.tolist(), starts.tolist()):
        word = (data + b" " + data)[at:].split(None, 1)[0]
        assert named.setdefault(word, key) == key
    assert len(set(named.values())) == len(named)
    assert len(words.text_keys(b"")[0]) == len(words.text_keys(b" \t")[0]) == 0


def test_pieces_keep_every_word(monkeypatch):
    monkeypatch.setattr(words, "_PIECE", 50)
    data = b"alpha beta " * 40 + b"x" * 300 + b" end"
    assert b"".join(p for _, p in words.pieces(data)) == data
    assert len(words.text_keys(data)[0]) == len(data.split())


@pytest.fixture
def spoken():
    rng = random.Random(9)
    rows = []
    for i in range(120):
        rows.append((i, "In the beginning was the word " * (i % 3) + text_of(rng, 60)))
    return rows + [(200, None), (201, ""), (202, " \n"), (None, "of null id"), (203, "twice"), (203, "twice"), (204, "É " * 3000)]


def test_scores_match_the_base_formula_and_gain(docs, clashing, spoken):
    frame = clashing(docs(*spoken).repartition(3), "row", "key", "n", "rest", "rare")
    got = suffix_tree.score(frame).collect()
    counts = Counter()
    for doc_id, text in spoken:
        if crc32(b"" if doc_id is None else str(doc_id).encode()) % 10:
            counts.update([*(text or "").encode().lower().split(), None])
    total, mass = sum(counts.values()), sum(counts.values()) + 0.1 * (len(counts) + 1)
    want = Counter()
    for doc_id, text in spoken:
        tokens = [*(text or "").encode().lower().split(), None]
        base = sum(math.log10((counts[t] + 0.1) / mass) for t in tokens)
        held = crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0
        want[(doc_id, held, len(tokens), sum(counts[t] > 0 for t in tokens), total, round(base, 6))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


class Tree:
    """The suffix tree by brute force: counts of tuples of words, and every rule applied as it is stated."""

    def __init__(self, rows, divergence, least=2):
        texts = [(t or "").encode().lower().split() for i, t in rows if crc32(b"" if i is None else str(i).encode()) % 10]
        self.words = Counter(w for t in texts for w in [*t, "end"])
        self.mass = sum(self.words.values()) + 0.1 * (len(self.words) + 1)
        self.states, depth = {}, 0
        while depth == 0 or any(len(c) == depth for c in self.states):
            depth += 1
            follow = {}
            for t in texts:
                said = ["begin", *t, "end"]
                for at in range(depth, len(said)):
                    follow.setdefault(tuple(said[at - depth:at]), Counter())[said[at]] += 1
            found = {}
            for context, symbols in follow.items():
                times, kept = sum(symbols.values()), {s: n - 0.5 for s, n in symbols.items() if n >= least}
                if kept:
                    logs = {s: self.log(context[1:], s) for s in kept}
                    left = 1 - sum(kept.values()) / times
                    back = math.log(left / (1 - sum(map(math.exp, logs.values()))))
                    if sum(m * (math.log(m / times) - logs[s]) for s, m in kept.items()) + times * left * back >= divergence:
                        found[context] = ({s: math.log(m / times) for s, m in kept.items()}, back)
            self.states |= found

    def log(self, context, symbol):
        for at in range(len(context)):
            if context[at:] in self.states:
                own, back = self.states[context[at:]]
                return own[symbol] if symbol in own else back + self.log(context[at + 1:], symbol)
        return math.log((self.words[symbol] + 0.1) / self.mass)

    def score(self, text):
        said = ["begin", *(text or "").encode().lower().split(), "end"]
        deep = max(map(len, self.states), default=0)
        return sum(self.log(tuple(said[max(at - deep, 0):at]), said[at]) for at in range(1, len(said))) / math.log(10)


@pytest.mark.parametrize("divergence", [5.0, 20.0])
def test_scores_equal_brute_force(docs, spoken, divergence, monkeypatch):
    rng = random.Random(3)
    passage = text_of(rng, 40, "p q r s t u v w x y")
    copies = [(1000 + i, f"{text_of(rng, 3)} {passage} {rng.choice('ab')} {text_of(rng, 3)}") for i in range(60)]
    said, chained = ["a", "b", "a", "b"], []
    for i in range(12):
        for _ in range(400):
            said.append("a" if rng.random() < (said[-4:].count("a") + 0.2) / 4.4 else "b")
        chained.append((2000 + i, " ".join(said[-400:])))
    rows = spoken + copies + chained
    tree = Tree(rows, divergence)
    assert max(map(len, tree.states)) >= 3
    want = sorted((str(i), t or "", round(tree.score(t), 6)) for i, t in rows)
    monkeypatch.setattr(suffix_tree, "BLOCK", 20_000)
    got = suffix_tree.score(docs(*rows).repartition(5), divergence=divergence).collect()
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in got) == sorted((i, s) for i, _, s in want)
    for context in list(tree.states)[::7][:30]:
        assert sum(math.exp(tree.log(context, s)) for s in [*tree.words, "never"]) == pytest.approx(1)


def test_scores_without_training_text(docs):
    assert suffix_tree.score(docs((1, "a")).where("false")).count() == 0
    only_held = next(i for i in range(100) if crc32(str(i).encode()) % 10 == 0)
    row = suffix_tree.score(docs((only_held, "a b"))).first()
    assert (row.held_out, row.n_known, row.train_tokens, row.score, row.base_score) == (True, 0, 0, 0.0, 0.0)


def base_of(text):
    w = [p for p in (text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if p]
    lines = [p for p in (text or "").split("\n") if p.strip(" \t\x0b\x0c\r")]
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    count, covered = Counter(windows), set()
    for i, window in enumerate(windows):
        if count[window] > 1:
            covered |= {i, i + 1, i + 2}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_quality_counts_and_verdicts(docs, clashing, spark):
    rng = random.Random(11)
    good = [(i, text_of(rng, 90) + "\nsame line\nsame line\n \n") for i in range(60)]
    junk = [(100 + i, text_of(rng, 90, " ".join(f"{w}{n}$$$" for w in ("buy", "now", "cheap") for n in range(9)))) for i in range(30)]
    odd = [(200, None), (201, ""), (202, "one two three " * 40), (203, "\u2003a b " * 70), (204, text_of(rng, 40_000)), (None, text_of(rng, 80)),
           (205, text_of(rng, 70)), (205, text_of(rng, 70)), (206, "a" * 200_000)]
    rows = good + junk + odd
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good[:40]] + [(i, 1, 0) for i, _ in good[:5]] + [(100, 0, 0), (999, 1, 0), (5, 0, 0),
                                   (6, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    frame = clashing(docs(*rows), "kept", "score", "n_words", "bucket")
    got = quality.judge(frame, labels).collect()
    at = len(frame.columns)
    assert Counter((r[0], *r[at:at + 5]) for r in got) == Counter((i, *base_of(t)) for i, t in rows)
    kept = {r[0] for r in quality.accept(frame, labels).collect()}
    assert {i for i, _ in good} | {205, None} <= kept
    assert not kept & ({i for i, _ in junk} | {200, 201, 202, 206})
    assert quality.accept(frame, labels).columns == frame.columns
    for r in got:
        n, repeated = r[at], r[at + 4]
        assert r[at + 6] == (n < 50 or 100 * repeated > 50 * n)
    assert quality.accept(frame.where("false"), labels).count() == 0
    assert all(r[at + 7] != r[at + 6] for r in quality.judge(frame, labels.where("false")).collect())


def test_classes_waste_little():
    for k, size in packing.class_sizes():
        assert k * size <= 2048 and 250 * (2048 - k * size) <= 2048
    assert packing.class_sizes()[0] == (1, 2048) and packing.class_sizes()[-1] == (2048, 1)


def test_packed_pieces_hold_every_id_once(docs, clashing):
    from tokenizers import Tokenizer

    rng = random.Random(12)
    odd = ["", None, " \t\n", "It's o'clock, WE'LL go", "\u0130STANBUL \u03a3\u03a3 \u03bf\u03a3", "e\u0301\u00e9 a\u00a0b\u2003c\x1cd\x85e",
           "<|endoftext|> x<|startoftext|>y", "日本語テキスト 123 4.5", "👩‍👩‍👧 \u0301x", "x" * 5000, "\u00a0", "\ufb01 \u2126 \u0345"]
    rows = [(i, text_of(rng, rng.randrange(3000))) for i in range(25)] + [(100 + i, t) for i, t in enumerate(odd)] + [(7, "again"), (None, "n")]
    rows += [(300 + i, "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 1500), rng.randrange(0x1F300, 0x1F600)]))
                               for _ in range(60))) for i in range(30)]
    frame = clashing(docs(*rows).repartition(3), "start", "ids", "sequence_id")
    pieces = packing.pack(frame).collect()
    tokenizer = Tokenizer.from_file(packing.tokenizer_file())
    want = Counter((i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in rows)
    sequences, texts = {}, {}
    for p in pieces:
        assert p.length == len(p.ids) > 0 and p.ids_crc32 == crc32(np.array(p.ids, "<u4").tobytes())
        sequences.setdefault(p.sequence_id, []).append(p)
        texts.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    unique = {key: t for key, t in texts.items() if sum(n for (i, ids), n in want.items() if i == key[0]) == 1}
    for (doc_id, n), parts in unique.items():
        parts.sort(key=lambda p: p.start)
        assert [p.start for p in parts] == [sum(q.length for q in parts[:k]) for k in range(len(parts))]
        assert want[(doc_id, tuple(t for p in parts for t in p.ids))] == 1 and sum(p.length for p in parts) == n
    assert len(unique) >= len(rows) - 2
    padding = 0
    for parts in sequences.values():
        parts.sort(key=lambda p: p.offset)
        assert [p.offset for p in parts] == [sum(q.length for q in parts[:k]) for k in range(len(parts))]
        filled = sum(p.length for p in parts)
        assert filled <= 2048
        padding += 0 if filled & (filled - 1) == 0 else 2048 - filled
    assert padding < 0.01 * sum(p.length for p in pieces)
    assert packing.pack(frame.where("false")).count() == 0


def test_tree_keeps_rare_contexts_of_any_depth(docs):
    rng = random.Random(5)
    train = [i for i in range(900) if crc32(str(i).encode()) % 10][:700]
    # The next word depends on the last four, and each of them tells something of it.
    rows = []
    for i in train[:40]:
        said = ["a", "b", "a", "b"]
        for _ in range(1000):
            said.append("a" if rng.random() < (said[-4:].count("a") + 0.2) / 4.4 else "b")
        rows.append((i, " ".join(said)))
    tree = suffix_tree.grow(docs(*rows))
    assert len(tree.levels) >= 4 and tree.levels[3][1].count() > 0
    # Words of one context each, seen ten times in two million tokens: no share of the text decides what is kept.
    filler = " ".join(["m n"] * 100_000)
    rows = [(i, filler) for i in train[:10]] + [(i, f"u{k // 10} v{k // 10} v{k // 10}") for k, i in enumerate(train[10:210])]
    tree = suffix_tree.grow(docs(*rows))
    assert tree.total > 2_000_000
    times = {r.n for r in tree.levels[0][0].where("own").collect()}
    assert 10 in times and suffix_tree.grow(docs(*rows), depths=1).levels[0][1].count() >= 40
    got = {r.doc_id: r for r in suffix_tree.score(docs(*rows)).collect()}
    assert got[train[10]].score > got[train[10]].base_score / 2


def test_cut_pieces_and_released_bit_sets_change_no_score(spark, monkeypatch):
    """Depths that read cut pieces find what the texts hold, and every bit set that is sent to the tasks is deleted again."""
    from pyspark import Broadcast, SparkContext

    rng = random.Random(5)
    line = [rng.choice("abcd") for _ in range(20)]
    rows = [(i, " ".join([*rng.choices("abcd", k=rng.randrange(9)), *line[rng.randrange(9):], rng.choice("xy")])) for i in range(150)]
    frame = spark.createDataFrame([*rows, (300, None), (301, "")], "doc_id long, text string")
    sent, deleted, found = [], [], {}
    send, delete = SparkContext.broadcast, Broadcast.destroy
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: sent.append(0) or send(self, value))
    monkeypatch.setattr(Broadcast, "destroy", lambda self, *a: deleted.append(0) or delete(self, *a))
    for fewer in (1 << 60, 0):
        monkeypatch.setattr(suffix_tree, "_FEWER", fewer)
        found[fewer] = {r.doc_id: (r.n_tokens, r.n_known, round(r.base_score, 9), round(r.score, 9))
                        for r in suffix_tree.score(frame, divergence=6.0).collect()}
    assert found[0] == found[1 << 60] and len(found[0]) == 152
    assert len(sent) > 4 and len(deleted) == len(sent)


def test_deep_depths_are_settled_in_few_passes(spark, monkeypatch):
    """What is settled in one pass, context by context or at several chunks, is what counting depth by depth finds."""
    rng = random.Random(7)
    line = [rng.choice("abcd") for _ in range(30)]
    rows = [(i, " ".join([*rng.choices("abcd", k=rng.randrange(9)), *line[rng.randrange(5):], rng.choice("xy")])) for i in range(150)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    tables, found, write = {}, {}, suffix_tree.written
    for fewer, chunk in ((1 << 60, 32 << 20), (0, 32 << 20), (0, 8 << 10)):
        names = tables[fewer, chunk] = []
        monkeypatch.setattr(suffix_tree, "written", lambda f, name, path=None: names.append(name) or write(f, name, path))
        monkeypatch.setattr(suffix_tree, "_FEWER", fewer)
        monkeypatch.setattr(suffix_tree, "_CHUNK", chunk)
        tree = suffix_tree.grow(frame, divergence=6.0)
        found[fewer, chunk] = [sorted((r.context, r.times, round(r.back, 9)) for r in states.collect()) for _, states in tree.levels]
        assert len(tree.levels) == tree.depths >= 6
    assert found[0, 32 << 20] == found[0, 8 << 10] == found[1 << 60, 32 << 20]
    assert tables[0, 32 << 20].count("lm-grams") <= 5 < tables[1 << 60, 32 << 20].count("lm-grams")


def test_signs_behind_a_word_make_no_word_of_their_own():
    import sys

    from tokenizers import Tokenizer

    from tallystar.llm.shared import WORKER_WORDS

    sys.modules.pop(WORKER_WORDS, None)
    texts = ["word### word%%% Word. (word) it's word's)  word'' it's...", "q<|> Q.", "é### naïve* ǅ word̸ don't; 'tis", None, "x<|endoftext|>."]
    got = [np.frombuffer(ids, "<u4").tolist() for ids in packing.encoder(packing.tokenizer_file())(texts)]
    tokenizer = Tokenizer.from_file(packing.tokenizer_file())
    assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    kept = sys.modules.pop(WORKER_WORDS).words
    assert b"word" in kept and not {b"word###", b"word%%%", b"(word)"} & kept.keys()


def test_few_places_are_hashed_as_all_are():
    """A walk that keeps only the places on the way finds the grams that hashing every place at every depth finds."""
    rng = np.random.default_rng(3)
    tokens = rng.integers(1, 1 << 62, 50, np.uint64)[rng.integers(0, 50, 6000)]
    tokens[2000:2300] = tokens[4000:4300]
    symbols, number = suffix_tree._symbols(tokens, np.array([1500, 1500, 6000]))
    hashes, every = symbols, []
    for depth in range(1, 41):
        at = np.flatnonzero(number >= depth)
        longer = suffix_tree._longer(hashes)
        every.append((at, hashes[at - 1], longer[at]))
        hashes = longer
    twice = np.concatenate([c for _, c, _ in every])
    twice, n = np.unique(twice, return_counts=True)
    twice = twice[n > 1]

    def on_the_way(contexts):
        chosen = np.isin(contexts, twice)
        return chosen, contexts[chosen]

    found = list(suffix_tree._walk(symbols, number, 40, on_the_way))
    assert len(found) == 40
    for (at, contexts, grams), (places, hashed, told) in zip(every, found):
        chosen = np.isin(contexts, twice)
        assert [places.tolist(), hashed.tolist(), told.tolist()] == [v[chosen].tolist() for v in (at, grams, contexts)]


def test_scoring_asks_in_rounds(docs, monkeypatch):
    """What the model answers is held for a part of the blocks at a time, in cells of many hashes."""
    from pathlib import Path

    paths, write = [], suffix_tree.written

    def written(frame, name, path=None):
        if name == "lm-found":
            assert not any(Path(p.removeprefix("file:")).exists() for p in paths)
            paths.append(path)
        out = write(frame, name, path)
        if name == "lm-found":
            assert out.count() < 2000 and "key" in out.columns
        return out

    monkeypatch.setattr(suffix_tree, "written", written)
    monkeypatch.setattr(suffix_tree, "BLOCK", 4_000)
    rng = random.Random(3)
    rows = [(i, text_of(rng, 60, " ".join(f"w{k}" for k in range(40)))) for i in range(200)]
    got = suffix_tree.score(docs(*rows), depths=1).collect()
    assert len(paths) > 1 and sorted(r.doc_id for r in got) == [i for i, _ in rows]


def test_runs_without_a_place_to_count_make_no_piece(spark, monkeypatch):
    """Texts of words that no other text has may fill a whole run of a task that cuts pieces."""
    rng = random.Random(5)
    line = [rng.choice("abcd") for _ in range(20)]
    rows = [(i, " ".join([*rng.choices("abcd", k=rng.randrange(9)), *line[rng.randrange(9):], rng.choice("xy")])) for i in range(150)]
    alone = [(i, f"p{i} q{i} r{i} s{i}") for i in range(300, 320)]
    pair = "doc_id long, text string"
    frame = spark.createDataFrame(rows, pair).coalesce(1).union(spark.createDataFrame(alone, pair).coalesce(1))
    found = {}
    for fewer in (1 << 60, 0):
        monkeypatch.setattr(suffix_tree, "_FEWER", fewer)
        found[fewer] = {r.doc_id: (r.n_tokens, round(r.score, 9)) for r in suffix_tree.score(frame, divergence=6.0).collect()}
    assert found[0] == found[1 << 60] and len(found[0]) == 170


def test_tables_made_on_the_driver_stay_there():
    """A job's functions are small, whatever words the driver has hashed itself."""
    from pyspark import cloudpickle

    words.text_keys(b"some words")
    assert words._tables and len(cloudpickle.dumps(suffix_tree._dealt_words(4))) < 1 << 18
    assert len(cloudpickle.loads(cloudpickle.dumps(words.text_keys))(b"some words")[0]) == 2


def test_hashes_are_found_and_ordered_as_numpy_does():
    """Also numbers that are not spread like hashes, hashes of one bucket, values beyond both ends of a table and empty arrays."""
    from tallystar.llm import cells

    rng = np.random.default_rng(4)
    wide = rng.integers(0, 1 << 64, 3000, np.uint64)
    ends = np.array([0, 1, (1 << 64) - 1], np.uint64)
    close = np.uint64(1 << 40) + rng.integers(0, 1 << 13, 3000, np.uint64) * np.uint64(3)
    for keys in (wide, np.concatenate([wide, ends]), wide >> np.uint64(30), close, rng.choice(wide, 9000), np.arange(3000, dtype=np.uint64)[::-1].copy(),
                 np.concatenate([ends, np.uint64(1 << 63) + np.arange(300, dtype=np.uint64)]), np.repeat(ends, 40), wide[:1], wide[:0]):
        assert cells.ordered(keys).tolist() == np.argsort(keys, kind="stable").tolist()
        found = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        assert [v.tolist() for v in cells.grouped(keys)] == [v.tolist() for v in found]
        table = found[0][::2]
        where = {k: at for at, k in enumerate(table.tolist())}
        wanted = np.concatenate([keys, ends, wide])
        for some in (wanted, wanted[:3]):
            assert cells.places(table, some).tolist() == cells.Places(table).of(some).tolist() == [where.get(k, -1) for k in some.tolist()]
