import random
from collections import defaultdict

import pytest

from tallystar.llm import exact_dedup, mixing


def normalised(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


def wanted_groups(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[normalised(text)].append((-len(text or ""), doc_id is None, doc_id))
    return {key: (min(members)[2], len(members)) for key, members in groups.items()}


ROWS = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, "a\u00a0b"), (5, ""), (6, None), (7, " \n\t"), (8, "long " * 50_000),
        (9, "long" * 50_000), (9, "c"), (9, "c"), (None, "c  "), (None, None), (12, "\u2003"), (13, "e\u0301"), (14, "é")]


@pytest.mark.parametrize("digest", [exact_dedup.sha256_hex, lambda content: str(len(content) % 3)])
def test_copies_are_told_by_content_not_by_digest(docs, digest):
    frame = docs(*ROWS).repartition(5)
    got = exact_dedup.assign(frame, digest=digest).collect()
    want = wanted_groups(ROWS)
    assert len(got) == len(ROWS)
    by_id = {r.doc_id: r for r in got if r.doc_id not in (None, 9)}
    for doc_id, text in ROWS:
        if doc_id in by_id:
            row = by_id[doc_id]
            assert (row.keep_id, row.group_size) == want[normalised(text)]
            assert row.kept == (row.keep_id == doc_id)
    kept = exact_dedup.deduplicate(frame, digest=digest).collect()
    assert sorted(normalised(r.text) for r in kept) == sorted(want)
    assert {normalised(r.text): r.doc_id for r in kept} == {key: keep for key, (keep, _) in want.items()}


def test_a_hot_group_keeps_one_row(docs):
    frame = docs(*[(i, "same text " * (1 + i % 2)) for i in range(600)], *[(1000 + i, f"other {i}") for i in range(50)])
    assert {r.doc_id for r in exact_dedup.deduplicate(frame.repartition(8)).collect()} == {0, 1} | set(range(1000, 1050))


def test_clashing_columns_and_empty_tables(docs, clashing):
    frame = clashing(docs((1, "a"), (2, " a")), "_digest", "digest", "group_size", "c0", "kept")
    assert exact_dedup.deduplicate(frame).columns == frame.columns
    assert [r.doc_id for r in exact_dedup.deduplicate(frame).collect()] == [2]
    assert exact_dedup.assign(frame).count() == 2
    empty = frame.where("false")
    assert exact_dedup.assign(empty).count() == exact_dedup.deduplicate(empty).count() == mixing.mix(empty).count() == 0


def wanted_targets(sizes, weights=(1, 2, 3), most=3):
    """Round by round: share what is left among the sources that are not capped."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target = dict.fromkeys(order, 0.0)
    open_, rest = set(order), float(sum(sizes.values()))
    while open_ and rest > 1e-9:
        total = sum(weight[s] for s in open_)
        share = {s: rest * weight[s] / total for s in open_}
        rest = 0.0
        for s in list(open_):
            target[s] += share[s]
            if target[s] > most * sizes[s]:
                rest += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.remove(s)
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets_follow_the_rounds(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([0, 1, 5, 50, 4000]) * rng.randrange(1, 9) for s in ["a", "b", "é", "", "z", None, "m"][: 3 + seed]}
    sizes["big"] = 9000
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    assert got == pytest.approx(wanted_targets(sizes), rel=1e-9, abs=1e-6)


def test_mix_emits_what_is_planned(docs, clashing):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randrange(1, 60), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(900)]
    rows += [(1000, None, "a"), (1001, "", "b"), (1002, " \t", "only blanks"), (1003, "x " * 40_000, "c")]
    frame = clashing(docs(*rows), "size", "copies", "target", "weight", "copy")
    plan = mixing.plan(frame)
    planned = {r.c0: r for r in plan.collect()}
    emitted = defaultdict(int)
    for r in mixing.mix(frame).collect():
        emitted[r.doc_id] += 1
    assert mixing.mix(frame).columns == frame.columns
    assert emitted == {i: r.copies for i, r in planned.items() if r.copies}
    taken, target = defaultdict(int), {}
    for doc_id, text, source in rows:
        r = planned[doc_id]
        assert r.size == len((text or "").split()) and 0 <= r.copies <= 3
        taken[source] += r.size * r.copies
        target[source] = r.target
    for source in ("a", "b", None):
        assert taken[source] == pytest.approx(target[source], rel=0.25)
    assert target["only blanks"] == 0
    assert {r.c0: r.copies for r in mixing.plan(frame.repartition(7)).collect()} == {i: r.copies for i, r in planned.items()}


def test_ids_of_text(spark):
    rows = [("b", "same text"), ("", "sametext"), (None, "same\ttext"), ("a", "same text"), ("z", "other"), (None, "other")]
    frame = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    assert sorted(r.doc_id for r in exact_dedup.deduplicate(frame).collect()) == ["a", "z"]
    got = {(r.doc_id, r.keep_id) for r in exact_dedup.assign(frame).collect()}
    assert got == {("b", "a"), ("", "a"), (None, "a"), ("a", "a"), ("z", "z"), (None, "z")}
