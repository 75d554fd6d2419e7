import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tallystar.llm import chat, line_runs, urls

TRAP = r"\### Assistant: </turn> ok"


def test_examples_read_back_as_the_conversation(spark):
    rng = random.Random(1)
    marks = ["<turn:user>", "</turn>\n", "\\", "\\e", "\\l", "<", ">", "\n", "é", "x", "\\n", TRAP]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "as>\\sis<tant", None]),
             rng.choice([None, "", "".join(rng.choice(marks) for _ in range(rng.randrange(12)))])) for c in range(25) for t in range(rng.randrange(1, 9))]
    rows += [(90, 0, "assistant", "a"), (90, 0, "assistant", "a"), (90, None, "user", "first"), (None, 1, "user", "u"), (91, 0, "assistant", "long " * 50_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("said", F.lit(2))
    made = chat.format_examples(frame.repartition(4)).withColumn("read", chat.read_turns(F.col("formatted"))).withColumn(
        "loss", chat.loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end"))).collect()
    key = lambda v: (v is not None, v or 0)
    for conv in {r[0] for r in rows}:
        turns = sorted(((key(t), (r is not None, r or ""), x or "") for c, t, r, x in rows if c == conv))
        said = [(r[1] if r[0] else None, x) for _, r, x in turns]
        examples = sorted((r for r in made if r.conv_id == conv), key=lambda r: r.turns)
        assert [r.loss for r in examples if said[r.turns - 1][0] == "assistant"] == [x for r, x in said if r == "assistant"]
        for e in examples:
            assert [tuple(t) for t in e.read] == said[:e.turns]
            if said[e.turns - 1][0] != "assistant":
                assert e.whole and e.loss == "" and e.loss_start == e.loss_end
        assert sum(e.whole for e in examples) == 1 and examples[-1].whole
    assert chat.format_examples(frame.where("false")).count() == 0


CASES = [
    ("http://A.Example.COM/en/1?x#y", "a.example.com", "/en/1"), ("https://x.net?q=/es/", "x.net", ""), ("ftp://x.net#/fr/", "x.net", ""),
    (None, "", ""), ("no scheme/at all", "", ""), ("://", "", ""), ("http://É.com/é", "É.com", "/é"), ("a://b://c/d", "b:", "//c/d"),
    ("http://example.com", "example.com", ""), ("", "", ""), ("http://www.example.com/en/" + "a" * 40_000, "www.example.com", "/en/" + "a" * 40_000),
]
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/")]


def test_url_parts_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, (u, _, _) in enumerate(CASES)], "page_id long, url string, host string")
    got = urls.judge(pages.unionByName(pages), urls.labelled_urls(spark), RULES).collect()
    assert len(got) == 2 * len(CASES)
    for r in got:
        host, path = CASES[r[0]][1:]
        assert (r[3], r[4]) == (host, path)
        fitting = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert r["rule"] == (max(fitting)[1] if fitting else None)
        assert r["verdict"] == max(fitting)[2] if fitting else r["verdict"] in ("allow", "block")
    by_id = {r[0]: r for r in got}
    assert by_id[3]["verdict"] == by_id[5]["verdict"] == "allow"


def test_learned_verdicts_on_unseen_hosts(spark):
    bad = ["online-casino.example.org", "pills-cheap.example.org", "spam-farm.example.org", "bets-free.example.org", "adult-x.example.org"]
    good = ["thering.example.org", "www.onand.example.org", "blog.ething.example.org", "m.reading.example.org", "whale.example.org"]
    pages = spark.createDataFrame([(f"https://{h}/de/{i}",) for i, h in enumerate(bad + good)], "url string")
    got = {r[0].split("/")[2]: r["verdict"] for r in urls.judge(pages, urls.labelled_urls(spark), []).collect()}
    assert sum(got[h] == "block" for h in bad) >= 4 and all(got[h] == "allow" for h in good)
    one_sided = urls.labelled_urls(spark).where("block = 1")
    assert {r["verdict"] for r in urls.judge(pages, one_sided, []).collect()} == {"allow"}
    assert urls.judge(pages.where("false"), urls.labelled_urls(spark), []).count() == 0


def cut_runs(rows, least, words):
    """Brute force over all runs of up to nine lines, first copy by (id, hash of the text, line)."""
    documents = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    seen, out = set(), {}
    for doc_id, text, order in documents:
        if text is None:
            out[(doc_id, text)] = None
            continue
        lines = text.split("\n")
        spoken = [i for i, line in enumerate(lines) if line.strip(" \t\x0b\x0c\r")]
        gone = set()
        for length in range(1, 10):
            for s in range(len(spoken) - length + 1):
                run = tuple(lines[i] for i in spoken[s:s + length])
                if run in seen and (length >= least or sum(len(line.split()) for line in run) > words):
                    gone |= set(range(s, s + length))
                seen.add(run)
        dropped = {i for i in range(len(lines)) if any(
            a in gone and b in gone and spoken[a] <= i <= spoken[b] for a, b in [_around(spoken, i)])}
        out[(doc_id, text)] = "\n".join(line for i, line in enumerate(lines) if i not in dropped)
    return out


def _around(spoken, i):
    before = max((k for k, p in enumerate(spoken) if p <= i), default=-1)
    after = min((k for k, p in enumerate(spoken) if p >= i), default=-1)
    return before, after


@pytest.mark.parametrize("least, words", [(1, 50), (2, 3), (3, 2), (3, 50), (5, 6), (6, 0)])
def test_line_runs_match_brute_force(docs, clashing, spark, least, words):
    rng = random.Random(least + words)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c d", "e f g", "", f"own {i}"]) for _ in range(rng.randrange(14)))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, " \n\t\n"), (53, "a\n" * 3000), (54, rows[3][1]), (54, rows[4][1]), (3, rows[3][1]), (None, rows[5][1])]
    frame = clashing(docs(*rows).repartition(3), "seq", "rank", "runs", "doc", "n")
    hashed = {r[0]: r[1] for r in frame.select("text", F.xxhash64("text")).collect()}
    want = cut_runs([(d, t, hashed[t]) for d, t in rows], least, words)
    got = line_runs.delete_runs(frame, least_lines=least, least_words=words)
    assert got.columns == frame.columns
    digest = lambda pairs: sorted(hashlib.sha256(repr(p).encode()).hexdigest() for p in pairs)
    assert digest((r.doc_id, r.text) for r in got.collect()) == digest((d, want[(d, t)]) for d, t in rows)
    assert line_runs.delete_runs(frame.where("false")).count() == 0


def test_long_passages_of_one_or_two_lines_go(docs):
    rng = random.Random(12)
    sentence = lambda n: " ".join(f"w{rng.randrange(10_000)}" for _ in range(n))
    one, first, second, short = sentence(51), sentence(30), sentence(21), sentence(50)
    rows = [(1, one), (2, f"own 2\n{one}"), (3, f"{first}\n\n{second}"), (4, f"own 4\n{first}\n{second}\nend"), (5, short), (6, short), (7, f"{second}\n{first}")]
    got = {r.doc_id: r.text for r in line_runs.delete_runs(docs(*rows)).collect()}
    assert got == {1: one, 2: "own 2", 3: rows[2][1], 4: "own 4\nend", 5: short, 6: short, 7: rows[6][1]}


def test_verdicts_on_held_out_hosts(spark):
    """A sixth of the labelled hosts is left out of the fit; hosts of words that no label has are left alone."""
    labelled = urls.labelled_urls(spark)
    out = F.pmod(F.xxhash64(F.regexp_extract("url", "://([^/]*)", 1)), F.lit(6)) == 0
    judged = urls.judge(labelled.where(out), labelled.where(~out), []).collect()
    assert len(judged) > 60 and sum((r["verdict"] == "block") == bool(r.c1) for r in judged) >= 0.95 * len(judged)
    unseen = ["http://viagra-discount.biz/x", "http://www.poker.org/", "http://torrent-crack.to/", "http://example.org/about",
              "http://www.gazette.info/", "https://cs.stanford.edu/people/", "http://tionsh.example.net/de/1", "http://m.ththnt.example.com/es/2"]
    got = {r[0]: r["verdict"] for r in urls.judge(spark.createDataFrame([(u,) for u in unseen], "url string"), labelled, []).collect()}
    assert [got[u] for u in unseen] == ["block"] * 3 + ["allow"] * 5
