import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallystar.functions import json_text, numeric, similarity, text
from tallystar.schema import ALIAS_TO_CANONICAL, CANONICAL_COLUMNS, FACT_SCHEMA, NUMERIC_COLUMNS


def apply(spark, fn, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("v"))).collect()]


def test_schema_counts():
    assert len(CANONICAL_COLUMNS) == 32 and len(NUMERIC_COLUMNS) == 20
    assert len(ALIAS_TO_CANONICAL) == 50 and len(FACT_SCHEMA) == 37
    assert ALIAS_TO_CANONICAL["loc_quotiont"] == "LOC_QUOTIENT"


def test_normalize_header(spark):
    raw = ["Area Title*", "occ code", " a b ", "a__b", "a___b", "†Tot Emp¹", "(x)", None, ""]
    want = ["area_title", "occ_code", "a_b", "a_b", "a__b", "tot_emp", "x", "", ""]
    assert apply(spark, text.normalize_header, raw) == want


def test_safe_name(spark):
    raw = ["Sheet 1", "weird/\\name*", "  spaced  ", "", "Größe-1"]
    assert apply(spark, text.safe_name, raw) == ["Sheet_1", "weird__name_", "spaced", "sheet", "Größe-1"]


def test_detect_year(spark):
    rows = spark.createDataFrame(
        [("all_2021_2022.csv", "/x/2019"), ("data.csv", "/y2018/2019"), ("data.csv", "/none")], "n string, p string"
    )
    assert [r[0] for r in rows.select(text.detect_year(F.col("n"), F.col("p"))).collect()] == [2021, 2018, None]


def test_paths(spark):
    assert apply(spark, text.path_name, ["file:/a/b/c.csv"]) == ["c.csv"]
    assert apply(spark, text.path_parent, ["file:/a/b/c.csv"]) == ["file:/a/b"]


def test_extract_location(spark):
    asked = [
        "Salaries in Winston-Salem, O'Brien?", "What are jobs for Portland, Oregon", "x at Seattle and Boise",
        "pay for nurses in Ohio", "nothing here",
    ]
    want = ["Winston-Salem, O'Brien", "Portland,", "Seattle", "Ohio", None]
    assert apply(spark, text.extract_location, asked) == want


def test_extract_occupation(spark):
    asked = ["software developer salaries", "How much do nurses make?", "the chief data scientist and engineer", "none"]
    want = ["software developer", "much do nurses", "scientist and engineer", None]
    assert apply(spark, text.extract_occupation, asked) == want


def test_mask_sensitive(spark):
    masked = text.MASKED_TEXT
    got = apply(spark, text.mask_sensitive, ["Bearer abc", "see HTTP://x", "plain", "y" * 201])
    assert got == [masked, masked, "Workflow execution failed: plain", "Workflow execution failed: " + "y" * 200 + "..."]


def test_length_gate(spark):
    assert apply(spark, text.within_length, ["ab", "abc", "é" * 500, "x" * 501]) == [False, True, True, False]


def _random_value(r, depth=0):
    kinds = ["text", "number", "constant"] + (["object", "list"] * 2 if depth < 4 else [])
    kind = r.choice(kinds)
    if kind == "text":
        return "".join(r.choice('ab{}[]",:\\\n\té日 ') for _ in range(r.randrange(8)))
    if kind == "number":
        return r.choice([r.randrange(-999, 999), round(r.uniform(-9, 9), 3)])
    if kind == "constant":
        return r.choice([True, False, None])
    if kind == "list":
        return [_random_value(r, depth + 1) for _ in range(r.randrange(4))]
    return {f"k{i}\"{{": _random_value(r, depth + 1) for i in range(r.randrange(4))}


def _marker_texts(r):
    """Texts around generated documents, with what Python's own reader finds after the first marker."""
    for _ in range(60):
        value = _random_value(r)
        written = json.dumps(value, ensure_ascii=r.random() < 0.5, indent=r.choice([None, None, 1]))
        tail = r.choice(["", " tail", "\nM: {}", "}", ' "x"'])
        gap = r.choice(["", " ", "\n  "])
        if isinstance(value, (dict, list)):
            yield f"{r.choice(['', 'before ', '{}'])}M:{gap}{written}{tail}", value
            yield f"M:{gap}{written[:-1]}", None
        else:
            yield f"M:{gap}{written}", None
        yield f"M: x{written}", None
        yield f"N: {written}", None


def test_json_after_marker(spark):
    cases = list(_marker_texts(random.Random(7)))
    got = apply(spark, lambda c: json_text.json_after_marker(c, "M:"), [t for t, _ in cases])
    assert [None if g is None else json.loads(g) for g in got] == [w for _, w in cases]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(new[-1], row[j + 1], row[j] + (x == y)))
        row = new
    return row[-1]


def plain_ratio(a, b):
    a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    return 100.0 if not a and not b else 200.0 * lcs(a, b) / (len(a) + len(b))


def test_token_sort_ratio_against_plain_lcs(spark):
    r = random.Random(3)
    sizes = [0, 1, 2, 7, 20, 59, 60, 61, 119, 120, 121, 180]
    word = lambda: "".join(r.choice("abc é𝒳 dE") for _ in range(r.choice(sizes)))
    pairs = [(word(), word()) for _ in range(300)] + [("a b", "b a"), ("Seattle", "seattle")]
    rows = spark.createDataFrame(pairs, "a string, b string")
    scored = rows.select("a", "b", similarity.token_sort_ratio(F.col("a"), F.col("b")).alias("s")).collect()
    assert all(abs(x.s - plain_ratio(x.a, x.b)) < 1e-9 for x in scored)


def test_suppression_and_numbers(spark):
    assert apply(spark, text.suppress_text, ["", "#", "**", "*", "~", " # ", "ok", None]) == [None] * 5 + [" # ", "ok", None]
    values = ["", " ** ", "#", None, " 42 ", "-1.5e3", ".5"]
    got = apply(spark, lambda c: numeric.sanitize_numeric(c, T.DoubleType()), values)
    assert got == [None, None, None, None, 42.0, -1500.0, 0.5]
    assert apply(spark, lambda c: numeric.sanitize_numeric(c, T.LongType(), "quarantine"), ["12", "12.0", "1d", "x"]) == [
        12, None, None, None,
    ]


@pytest.mark.parametrize("value", ["12.0", "1d", "abc", "99999999999999999999"])
def test_strict_number_raises(spark, value):
    with pytest.raises(PySparkException, match="not a number"):
        apply(spark, lambda c: numeric.sanitize_numeric(c, T.LongType()), [value])
    assert apply(spark, lambda c: numeric.is_bad_number(c, T.LongType()), [value, "1", "#", None]) == [True, False, False, False]


def test_tolerant_number(spark):
    values = ["1_000", " 7 ", "1d", "1__0", "N/A", "1e3", "-inf", None, ".5", "5.", "_1"]
    got = apply(spark, numeric.tolerant_number, values)
    assert got == [1000.0, 7.0, None, None, None, 1000.0, float("-inf"), None, 0.5, 5.0, None]
