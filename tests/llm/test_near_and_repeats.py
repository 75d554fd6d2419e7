import random

import numpy as np
import pytest
import xxhash

from tallystar.llm import components, repeats, simhash


def fingerprint(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(values, linked):
    group = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return group


def some_text(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(40)) for _ in range(n))


def near_rows(rng):
    rows = []
    for base in range(12):
        words = some_text(rng, 300).split()
        for copy in range(8):
            edited = list(words)
            for _ in range(copy % 4):
                edited[rng.randrange(len(edited))] = f"x{rng.randrange(100)}"
            rows.append((len(rows) * 3, " ".join(edited).title() if copy == 2 else "\n".join(edited)))
    return rows + [(901, None), (902, ""), (903, " \t "), (904, "one two"), (905, "One\x0bTWO"), (906, "É x"), (907, "é x"),
                   (908, some_text(rng, 70_000))]


@pytest.mark.parametrize("wide", [simhash.WIDE, 1])
def test_components_match_all_pairs(docs, monkeypatch, wide):
    monkeypatch.setattr(simhash, "WIDE", wide)
    rows = near_rows(random.Random(3))
    got = {r.doc_id: r for r in simhash.near_groups(docs(*rows), shingle=4, distance=4).collect()}
    prints = [fingerprint(t, 4) for _, t in rows]
    group = groups_of(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    assert len(set(group)) < len(rows) - 10
    for (doc_id, _), value, g in zip(rows, prints, group):
        assert got[doc_id].f0 % (1 << 64) == value
        assert got[doc_id].component_id == min(d for (d, _), h in zip(rows, group) if h == g)


def test_the_exploded_index_is_not_broadcast(docs, monkeypatch):
    """Spark sizes an exploded table like the one it comes from, so a join that may broadcast it fills the driver."""
    plans, write, join = [], simhash.written, simhash.components

    def planned(frame):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return frame

    monkeypatch.setattr(simhash, "written", lambda frame, name: write(planned(frame), name))
    monkeypatch.setattr(simhash, "components", lambda frame: join(planned(frame)))
    simhash.near_groups(docs(*near_rows(random.Random(3)))).collect()
    spread = [p for p in plans if "Generate explode" in p]
    assert len(spread) == 2 and not any("Broadcast" in p for p in spread)
    lists = [p for p in plans if p.count("place#") > 4 and p not in spread]
    assert len(lists) == 1 and "Broadcast" not in lists[0]


def test_dense_fingerprints_lose_no_link(spark):
    rng = random.Random(8)
    base = rng.getrandbits(64)
    values = {base}
    while len(values) < 250:
        flips = rng.sample(range(64), rng.choice([1, 2, 3, 5, 9]))
        values.add(rng.choice(sorted(values)) ^ sum(1 << f for f in flips))
    values = sorted(values)
    nodes = spark.createDataFrame([(simhash._signed(v),) for v in values], "f0 long")
    label = {r.f0 % (1 << 64): r.label for r in simhash.links(nodes, 4).collect()}
    group = groups_of(values, lambda a, b: (a ^ b).bit_count() <= 4)
    pairs = {(g, label[v]) for v, g in zip(values, group)}
    assert len(pairs) == len(set(group)) == len(set(label.values()))


def test_deduplicate_keeps_one_of_each_group(docs, clashing):
    rng = random.Random(4)
    words = some_text(rng, 400).split()
    near = words[:200] + ["changed"] + words[201:]
    rows = [(5, " ".join(words)), (3, " ".join(near)), (9, " ".join(words)), (20, some_text(rng, 300)), (20, some_text(rng, 300)),
            (31, None), (30, ""), (None, "only null id"), (None, "other null id"), (40, "twin"), (40, "twin")]
    frame = clashing(docs(*rows), "f0", "label", "component_id", "text_hash", "rows")
    got = simhash.deduplicate(frame)
    assert got.columns == frame.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in got.collect()) == [
        (False, 3), (False, 20), (False, 20), (False, 30), (False, 40), (True, None), (True, None)]
    assert simhash.deduplicate(frame.where("false")).count() == 0


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (100, 101)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}


def longest_matches(snippets):
    found = []
    for i, s in enumerate(snippets):
        row = []
        for p in range(len(s)):
            best = 0
            for j, u in enumerate(snippets):
                for q in range(len(u)):
                    if (i, p) != (j, q):
                        n = 0
                        while p + n < len(s) and q + n < len(u) and s[p + n] == u[q + n]:
                            n += 1
                        best = max(best, n)
            row.append(best)
        found.append(row)
    return found


def test_matching_statistics_of_repetitive_text():
    rng = random.Random(1)
    for _ in range(15):
        base = bytes(rng.choice(b"ab") for _ in range(50))
        snippets = [base[rng.randrange(25):rng.randrange(26, 50)] + bytes(rng.choice(b"ab\0\xff") for _ in range(9)) for _ in range(5)]
        assert [m.tolist() for m in repeats.matching_statistics(snippets)] == longest_matches(snippets)


def removed_spans(rows, length):
    count = {}
    texts = [(t or "").encode() for _, t in rows]
    for t in texts:
        for i in range(len(t) - length + 1):
            count[t[i:i + length]] = count.get(t[i:i + length], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i:i + length]] > 1:
                gone[i:i + length] = True
        out.append(bytes(np.frombuffer(t, np.uint8)[~gone]))
    return out


@pytest.mark.parametrize("indexed", [repeats.INDEXED, 1])
def test_repeats_match_brute_force(docs, clashing, indexed):
    rng = random.Random(6)
    passage = some_text(rng, 120)
    rows = [(i, some_text(rng, rng.randrange(20, 120)) + passage[rng.randrange(50):600 + rng.randrange(100)] + some_text(rng, 30)) for i in range(25)]
    rows += [(30, None), (31, ""), (32, "a" * 900), (33, "b" * 401), (34, "c" * 400), (35, passage), (35, passage), (36, "é" * 700),
             (37, some_text(rng, 9_000) + passage), (None, passage[:450]), (38, "\0" * 500)]
    frame = clashing(docs(*rows).repartition(3), "gram", "spans", "kept", "doc", "text_hash")
    got = repeats.remove_repeats(frame, indexed=indexed).collect()
    want = removed_spans(rows, repeats.LENGTH)
    assert sorted((r.doc_id is None, r.doc_id or 0, bytes(r.kept)) for r in got) == sorted(
        (d is None, d or 0, w) for (d, _), w in zip(rows, want))
    for r in got:
        assert r.n_bytes - r.n_removed == len(r.kept) and r.n_spans == len(r.removed)
    assert repeats.remove_repeats(frame.where("false")).count() == 0


def test_groups_of_odd_tables(docs, clashing):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "A B C D E F"), (9, None), (8, "")]
    frame = clashing(docs(*rows), "f0", "label", "component_id", "text_hash", "place", "bytes")
    got = [(r.doc_id, r.component_id) for r in simhash.near_groups(frame).collect()]
    assert sorted(got, key=str) == sorted([(5, 5), (5, 5), (None, 5), (9, 8), (8, 8)], key=str)
    assert simhash.near_groups(frame.where("false")).count() == 0
    assert simhash.near_groups(docs((None, "x"), (None, "X"))).select("component_id").distinct().collect()[0][0] is None
