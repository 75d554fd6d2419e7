import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tallystar.llm import mixing, packing, simhash
from tests.llm.test_near_and_repeats import fingerprint, groups_of

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def clean_text(rng, n):
    return " ".join(f"{rng.choice('abcdefgh')}{rng.choice(['or', 'an', 'el', 'um'])}{rng.randrange(60)}" for _ in range(n)) + "."


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder of tables, and the ids that survive the first three stages by construction."""
    rng = random.Random(21)
    rows, kept = [], set()
    for i in range(60):
        text = clean_text(rng, rng.randrange(150, 400))
        source = rng.choice(["a", "a", "a", "b", "c", None])
        rows.append((10 * i, text, source))
        kept.add(10 * i)
        if i % 4 == 0:  # exact copies; the one with most characters stays
            rows += [(10 * i + 1, text.replace(" ", "  "), source), (10 * i + 2, text.replace(" ", "\n"), source)]
            kept = kept - {10 * i} | {10 * i + 1}
        if i % 4 == 1:  # near copies
            for k in (1, 2):
                words = text.split()
                words[rng.randrange(len(words))] = f"changed{k}"
                rows.append((10 * i + k, " ".join(words), source))
                kept.add(10 * i + k)
    rows += [(1000 + i, " ".join(f"{w}{rng.randrange(9)}###" for w in ("win", "now", "free", "cash") * 40), "b") for i in range(20)]
    rows += [(2000, None, "a"), (2001, "", "b"), (2002, "too short", "c"), (2003, "again and again " * 60, "a")]
    ids = sorted(kept)
    by_id = {r[0]: r[1] for r in rows}
    group = groups_of([fingerprint(by_id[i], 4) for i in ids], lambda a, b: (a ^ b).bit_count() <= 4)
    near = len(kept)
    kept = {min(i for i, g in zip(ids, group) if g == own) for own in group}
    assert near - len(kept) >= 15
    labels = [(r[0], 1, 0) for r in rows if r[0] < 1000] + [(1000, 0, 0)]
    root = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCUMENTS).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root), {r[0]: r for r in rows}, kept


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "exact_duplicates", "near_duplicates", "source_mix", "sequence_packing"]
    assert (simhash.SHINGLE, simhash.DISTANCE) == (4, 4)


def test_run_matches_the_stages_by_hand(spark, corpus):
    root, rows, kept = corpus
    docs = spark.read.parquet(f"{root}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        columns = docs.columns
        docs = stage(spark, docs, root)
        assert docs.columns == columns
    assert sorted(r.doc_id for r in docs.collect()) == sorted(kept)

    copies = {r.c0: r.copies for r in mixing.plan(docs).collect()}
    taken, available = defaultdict(int), defaultdict(int)
    for i in kept:
        size = len(rows[i][1].split())
        taken[rows[i][2]] += size * copies[i]
        available[rows[i][2]] += size
    assert sum(taken.values()) == pytest.approx(sum(available.values()), rel=0.3)

    tokenizer = Tokenizer.from_file(packing.tokenizer_file())
    pieces = corpus_pipeline.run(spark, root).collect()
    assert Counter(p.doc_id for p in pieces if p.start == 0) == Counter({i: n for i, n in copies.items() if n})
    spans, sequences = defaultdict(list), defaultdict(int)
    for p in pieces:
        ids = tokenizer.encode(rows[p.doc_id][1], add_special_tokens=False).ids + [1]
        assert p.ids == ids[p.start:p.start + p.length] and p.doc_tokens == len(ids)
        spans[p.doc_id].append((p.start, p.length))
        sequences[p.sequence_id] += p.length
    for doc_id, found in spans.items():
        cover = np.zeros(sum(n for _, n in found) // copies[doc_id] + 1, int)
        for start, n in found:
            cover[start:start + n] += 1
        assert (cover[:-1] == copies[doc_id]).all() and cover[-1] == 0
    assert max(sequences.values()) <= 2048


def test_pipeline_on_empty_tables(spark, corpus, tmp_path):
    root, _, _ = corpus
    for name in ("documents", "labels"):
        spark.read.parquet(f"{root}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
