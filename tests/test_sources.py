import datetime as dt
import io
import json
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallystar.operators import warehouse
from tallystar.plans import pipeline
from tallystar.queries.inputs import workbook_bytes
from tallystar.sources import archives, corpus, workbooks
from tallystar.streaming import jobs


def write(root, name, text):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return path


@pytest.fixture
def root(tmp_path):
    root = tmp_path / "csv"
    write(root, "2024/sample.csv", "AREA,AREA_TITLE,OCC_CODE,OCC_TITLE,TOT_EMP\n000000,Test Area,11-1011,Manager,42\n")
    write(root, "2024/filler_description.csv", "a\n1\n")
    write(root, "2024/empty.csv", "")
    write(root, "2024/notes.txt", "x")
    write(root, "2024/deep/inner.csv", "AREA\n1\n")
    write(root, "y2023/UpdateTime.csv", "a\n1\n")
    write(
        root, "y2023/part_2022.csv",
        'Area,"Area Title*",area,Total Emp,a_mean,Extra\n1,"Say ""hi"", you\nthere",9, ** ,~,e1\n2,,9,#,10.5,\n3,**,9,7,"",*\n',
    )
    return root


def layout_plan(spark, root):
    heads = corpus.read_heads(corpus.scan_corpus(spark, str(root)))
    return heads, corpus.plan_corpus(heads)


def test_scan_and_heads(spark, root):
    found = corpus.scan_corpus(spark, str(root)).collect()
    assert [(r.folder, r.file_name) for r in found] == [("2024", "sample.csv"), ("y2023", "part_2022.csv")]
    heads, plan = layout_plan(spark, root)
    got = {r.file_name: r for r in heads.collect()}
    assert got["part_2022.csv"].header[1] == "Area Title*" and len(got["part_2022.csv"].samples) == 3
    assert corpus.read_heads(corpus.scan_corpus(spark, str(root)), 1).where("size(samples) = 1").count() == 2
    assert plan.extras == ["EXTRA"]
    ranges = {r.file_path.rsplit("/", 1)[1]: r for r in plan.manifest.ranges.collect()}
    assert ranges["part_2022.csv"].places == {"AREA": 0, "AREA_TITLE": 1, "TOT_EMP": 3, "A_MEAN": 4, "EXTRA": 5}
    assert (ranges["sample.csv"].start, ranges["sample.csv"].stop, ranges["sample.csv"].width) == (0, ranges["sample.csv"].size_bytes, 5)


def test_rows_longer_than_their_header_fail_the_file(spark, root):
    write(root, "2021/long.csv", "AREA,OCC_CODE\n1,a\n2,b,beyond\n3\n")
    _, plan = layout_plan(spark, root)
    clean, results = corpus.split_failed(corpus.standardize(plan, "quarantine"))
    failed = {r["_source_path"].rsplit("/", 1)[1]: r for r in results.collect()}
    assert failed["long.csv"].rows == 3 and failed["long.csv"].bad_columns == [corpus.RAGGED]
    assert failed["sample.csv"].bad_rows == 0
    assert {r["_source_file"] for r in clean.select("_source_file").collect()} == {"sample.csv", "part_2022.csv"}
    with pytest.raises(PySparkException, match="longer than its header"):
        corpus.standardize(plan).collect()


def test_inventory(spark, root):
    heads, _ = layout_plan(spark, root)
    got = corpus.file_inventory(heads).where("folder = 'y2023'").first()
    assert (got.year, got.column_count, got.row_samples) == (2022, 6, 3)
    assert got.suppression_tokens == ["", "#", "*", "**", "~"] or got.suppression_tokens == sorted(["", "#", "*", "**", "~"])
    assert got.columns[3].normalized_name == "total_emp" and got.columns[3].example_values == [" ** ", "#", "7"]


def test_standardize(spark, root):
    _, plan = layout_plan(spark, root)
    out = corpus.standardize(plan)
    got = {r.AREA: r for r in out.collect()}
    assert got["1"].AREA_TITLE == 'Say "hi", you\nthere' and got["1"].TOT_EMP is None and got["1"].EXTRA == "e1"
    assert got["2"].A_MEAN == 10.5 and got["2"].AREA_TITLE is None
    assert got["3"].TOT_EMP == 7 and got["3"].AREA_TITLE is None and got["3"].EXTRA is None
    assert got["000000"].TOT_EMP == 42 and got["000000"].I_GROUP == "cross-industry" and got["000000"]._data_year == 2024
    assert got["1"]._data_year == 2022 and got["1"]._source_folder == "y2023" and got["1"]._source_file == "part_2022.csv"
    assert out.columns[-3:] == ["_source_file", "_source_folder", "_data_year"] and len(out.columns) == 36


def test_bad_number_fails_its_file_only(spark, root):
    write(root, "2021/bad.csv", "AREA,TOT_EMP,A_MEAN\n5,12.0,1\n6,1,x\n7,2,2\n")
    _, plan = layout_plan(spark, root)
    with pytest.raises(PySparkException, match="not a number"):
        corpus.standardize(plan).collect()
    clean, results = corpus.split_failed(corpus.standardize(plan, "quarantine"))
    assert clean.count() == 4 and "_bad_columns" not in clean.columns
    failed = results.where("bad_rows > 0").first()
    assert (failed.rows, failed.bad_rows, failed.bad_columns) == (3, 2, ["TOT_EMP", "A_MEAN"])


def test_empty_corpus(spark, tmp_path):
    write(tmp_path, "c/x/field_notes.csv", "a\n1\n")
    _, plan = layout_plan(spark, tmp_path / "c")
    assert plan.manifest.ranges.isEmpty() and plan.extras == [] and corpus.standardize(plan).count() == 0


AWKWARD = (
    'AREA,"OCC\ncode",Extra\r\n1,a,x\r\n"2","he said ""no"",\nand\r\nleft",""\n\n3,,"é\n\n"\n4\n5,b,"last, no end"'
)


@pytest.mark.parametrize("split", [1, 2, 3, 5, 7, 16, 40, 1000, None])
def test_ranges_of_any_size_give_the_same_records(spark, tmp_path, split):
    write(tmp_path, "c/2020/long.csv", AWKWARD)
    write(tmp_path, "c/2020/other.csv", "OCC_CODE,AREA\nz,9\n")
    heads = corpus.read_heads(corpus.scan_corpus(spark, str(tmp_path / "c")), 0)
    plan = corpus.plan_corpus(heads, split)
    rows = corpus.read_corpus(plan)
    got = sorted((r.AREA, r.OCC_CODE, r.EXTRA) for r in rows.select("AREA", "OCC_CODE", "EXTRA").collect())
    assert got == [("1", "a", "x"), ("2", 'he said "no",\nand\r\nleft', ""), ("3", None, "é\n\n"), ("4", None, None),
                   ("5", "b", "last, no end"), ("9", "z", None)]


@pytest.mark.parametrize("split", [3, 11, 64])
def test_single_line_ranges_take_stray_quotes(spark, tmp_path, split):
    write(tmp_path, "c/2020/a.csv", 'AREA,OCC_CODE\n1,5" pipe\n2,"x"\n3,6" pipe\n')
    heads = corpus.read_heads(corpus.scan_corpus(spark, str(tmp_path / "c")), 0)
    rows = corpus.read_corpus(corpus.plan_corpus(heads, split, multi_line=False))
    assert sorted((r.AREA, r.OCC_CODE) for r in rows.select("AREA", "OCC_CODE").collect()) == [
        ("1", '5" pipe'), ("2", "x"), ("3", '6" pipe')]


def test_many_small_files_and_one_large_one(spark, tmp_path):
    for i in range(10_000):
        write(tmp_path, f"c/f{i % 7}/s{i}.csv", f"AREA,X{i % 3}\n{i},v\n")
    write(tmp_path, "c/f0/large.csv", "X0,AREA\n" + "".join(f'"line\n{i}",{i}\n' for i in range(10_000, 60_000)))
    heads = corpus.read_heads(corpus.scan_corpus(spark, str(tmp_path / "c")), 0)
    plan = corpus.plan_corpus(heads, split_bytes=100_000)
    rows = corpus.read_corpus(plan).select("AREA", "X0", "X1", "X2", "_source_path", F.spark_partition_id().alias("task"))
    large = F.col("_source_path").endswith("large.csv")
    got = rows.agg(
        F.count("*"), F.sum(F.col("AREA").cast("long")), F.count("X0"), F.count("X1"),
        F.count_distinct(F.when(large, F.col("task"))), F.count_distinct("task"), F.count_if(F.col("X0").startswith("line\n"))).first()
    assert got[:4] == (60_000, sum(range(60_000)), 3334 + 50_000, 3333) and got[6] == 50_000
    assert plan.extras == ["X0", "X1", "X2"] and got[4] > 5 and got[5] > 10


def test_files_are_opened_by_the_given_function(spark, root):
    def elsewhere(path):
        import io

        return io.BytesIO(b"AREA,NEW\n1,shipped\n2,shipped\n")

    heads = corpus.read_heads(corpus.scan_corpus(spark, str(root)), 5, open_file=elsewhere)
    plan = corpus.plan_corpus(heads, open_file=elsewhere)
    assert [r.NEW for r in corpus.read_corpus(plan).select("NEW").collect()] == ["shipped"] * 4


def test_places_of_files():
    from pyarrow import fs

    from tallystar.sources.paths import arrow_location

    for path in ("/tmp/a b%20/é.csv", "file:/tmp/a b%20/é.csv", "file:///tmp/a b%20/é.csv"):
        system, inner = arrow_location(path)
        assert isinstance(system, fs.LocalFileSystem) and inner == "/tmp/a b%20/é.csv"


def test_pipeline_end_to_end(spark, root, tmp_path):
    write(root, "2021/bad.csv", "AREA,TOT_EMP\n5,oops\n")
    out = str(tmp_path / "out")
    outcome = pipeline.standardize(spark, str(root), out)
    assert (outcome.files_processed, outcome.files_failed, outcome.total_rows) == (2, 1, 4)
    report = {r.file_path.rsplit("/", 1)[-1]: r for r in spark.read.json(outcome.report_path).collect()}
    assert report["bad.csv"].status == "failed" and "TOT_EMP" in report["bad.csv"].error
    assert report["sample.csv"].columns == 35 and len(report["sample.csv"].added_columns) == 27
    fact = pipeline.migrate(spark, outcome, str(tmp_path / "wh"))
    assert fact.count() == 4 and len(fact.columns) == 37
    assert tuple(warehouse.load_summary(fact).first()) == (4, 2, 2022, 2024)
    vintages = spark.read.parquet(str(tmp_path / "wh" / "data_vintages"))
    assert {(r.SOURCE_FILE, r.ROW_COUNT) for r in vintages.collect()} == {("sample.csv", 1), ("part_2022.csv", 3)}
    sql = pipeline.guarded_warehouse(spark, str(tmp_path / "wh"))
    assert sql.run("SELECT AREA_TITLE FROM fact WHERE OCC_CODE = ?", '["11-1011"]').envelope()["data"] == [["Test Area"]]
    assert sql.run("SELECT count(*) FROM data_vintages").envelope()["data"] == [[2]]
    variants = pipeline.analyze(spark, str(root), str(tmp_path / "an"))
    assert variants.where("normalized = 'area'").agg(F.sum("files")).first()[0] == 4
    assert spark.read.json(str(tmp_path / "an" / "column_inventory")).count() == 3


def test_equal_names_in_two_folders_do_not_cancel(spark, root, tmp_path):
    write(root, "2025/sample.csv", "AREA,OCC_CODE\n1,a\n2,b\n")
    _, plan = layout_plan(spark, root)
    rows = warehouse.load_projection(corpus.standardize(plan))
    swapped = spark.createDataFrame([("2024/sample.csv", 2), ("2025/sample.csv", 1), ("y2023/part_2022.csv", 3)], "path string, rows long")
    with pytest.raises(RuntimeError, match="2 source files do not reconcile"):
        warehouse.load_table(rows, str(tmp_path / "wh"), "fact", swapped)
    assert pipeline.run(spark, str(root), str(tmp_path / "out")).first().total_rows == 6


def test_load_is_all_or_nothing(spark, root, tmp_path):
    _, plan = layout_plan(spark, root)
    rows = warehouse.load_projection(corpus.standardize(plan))
    base = str(tmp_path / "wh")
    warehouse.load_table(rows, base, "fact")
    first = warehouse.current_version(spark, base, "fact")
    wrong = spark.createDataFrame([("2024/sample.csv", 1), ("y2023/part_2022.csv", 99)], "path string, rows long")
    with pytest.raises(RuntimeError, match="1 source files do not reconcile"):
        warehouse.load_table(rows.where("SOURCE_FILE = 'sample.csv' OR AREA = '1'"), base, "fact", wrong.limit(0).union(wrong.where("path = 'y2023/part_2022.csv'")).union(
            spark.createDataFrame([("2024/sample.csv", 1)], "path string, rows long")))
    assert warehouse.current_version(spark, base, "fact") == first
    warehouse.load_table(rows, base, "fact")
    assert warehouse.current_version(spark, base, "fact") != first
    with pytest.raises(LookupError):
        warehouse.current_version(spark, base, "other")


def test_publishers_of_the_same_moment_are_ordered(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    base = str(tmp_path / "wh")
    with ThreadPoolExecutor(8) as pool:
        numbers = list(pool.map(lambda i: (warehouse.publish(spark, base, "t", f"v{i}", i), i), range(24)))
    assert sorted(n for n, _ in numbers) == list(range(1, 25))
    assert warehouse.current_version(spark, base, "t") == f"v{max(numbers)[1]}"
    # A publisher that died before it wrote the content is not the current one, and its number is not used again.
    write(tmp_path, "wh/_versions/t/000000000025", "")
    assert warehouse.current_version(spark, base, "t") == f"v{max(numbers)[1]}"
    assert warehouse.publish(spark, base, "t", "after", 1) == 26 and warehouse.current_version(spark, base, "t") == "after"


def test_vintages_are_replaced_by_key_and_survive_an_interrupted_upsert(spark, tmp_path):
    path, schema = str(tmp_path / "vintages"), "SOURCE_FILE string, SOURCE_FOLDER string, SURVEY_YEAR int, ROW_COUNT long"
    audits = lambda *rows: spark.createDataFrame(list(rows), schema)
    state = lambda: sorted(((r.SOURCE_FILE or "", r.SOURCE_FOLDER, r.SURVEY_YEAR, r.ROW_COUNT) for r in warehouse.read_vintages(spark, path).collect()))
    warehouse.upsert_vintages(spark, path, audits(*[(f"f{i}.csv", "a", 2000 + i, i) for i in range(40)], (None, "a", None, 1)))
    before = state()
    assert len(before) == 41
    failing = audits(("f3.csv", "b", 2050, 7), ("new.csv", "b", 2050, 8)).withColumn("ROW_COUNT", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(PySparkException, match="lost"):
        warehouse.upsert_vintages(spark, path, failing)
    assert state() == before
    for _ in range(2):
        warehouse.upsert_vintages(spark, path, audits(("f3.csv", "b", 2050, 7), ("new.csv", "b", 2050, 8), (None, "b", None, 2)))
        assert state() == sorted([r for r in before if r[0] not in ("f3.csv", "")] + [("f3.csv", "b", 2050, 7), ("new.csv", "b", 2050, 8), ("", "b", None, 2)])


def test_archives(spark, tmp_path):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("nested/", "")
        z.writestr("nested/sample.xlsx", workbook_bytes({"S": [["a", 1]]}))
        z.writestr("top.csv", "x")
    write(tmp_path, "z/good.zip", out.getvalue())
    write(tmp_path, "z/bad.zip", b"nope")
    members = archives.read_archives(spark, str(tmp_path / "z"))
    assert {(r.base_name, r.member) for r in members.where("error IS NULL").collect()} == {
        ("sample.xlsx", "nested/sample.xlsx"), ("top.csv", "top.csv"),
    }
    outcomes = {r.archive.rsplit("/", 1)[-1]: (r.ok, r.members) for r in archives.archive_outcomes(members).collect()}
    assert outcomes == {"good.zip": (True, 2), "bad.zip": (False, 0)}
    books = members.where("base_name LIKE '%.xlsx'").select(F.col("member").alias("path"), "content")
    assert [r.cells for r in workbooks.workbook_rows(workbooks.decode_workbooks(books)).collect()] == [["a", "1"]]


def rich_workbook():
    """Shared strings, a date style, sparse cells, a boolean, and a second sheet that is broken."""
    base = zipfile.ZipFile(io.BytesIO(workbook_bytes({"A 1": [["x"]], "Bad/": [["y"]], "Empty": []})))
    out = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(out, "w") as z:
        for name in base.namelist():
            if name.endswith("sheet1.xml"):
                z.writestr(name, f'<worksheet {ns}><sheetData><row r="2"><c r="A2" t="s"><v>1</v></c><c r="D2" s="1"><v>45292</v></c>'
                                 '<c r="E2" t="b"><v>1</v></c><c r="AB2"><v>2.5</v></c></row></sheetData></worksheet>')
            elif name.endswith("sheet2.xml"):
                z.writestr(name, f'<worksheet {ns}><sheetData><row r="1"><c r="A1"><v>1</v></c></row><oops')
            else:
                z.writestr(name, base.read(name))
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>no</t></si><si><r><t>he</t></r><r><t>llo</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    write(tmp_path, "b/rich.xlsx", rich_workbook())
    write(tmp_path, "b/good.xlsx", workbook_bytes({"One": [["a"], ["b"]], "Two": [["c", None, 1.5]]}))
    write(tmp_path, "b/broken.xlsx", b"x")
    decoded = workbooks.read_workbooks(spark, str(tmp_path / "b"))
    rows = workbooks.workbook_rows(decoded)
    rich = rows.where("file = 'rich.xlsx'").collect()
    assert [(r.sheet, r.row_no) for r in rich] == [("A_1", 2)]
    assert rich[0].cells[:5] == ["hello", None, None, "2024-01-01", "true"] and len(rich[0].cells) == 28
    report = {r.file: r for r in workbooks.conversion_report(decoded).collect()}
    assert (report["good.xlsx"].success, report["good.xlsx"].sheets_converted) == (True, 2)
    assert (report["rich.xlsx"].success, report["rich.xlsx"].sheets_converted, report["rich.xlsx"].sheets_failed) == (False, 2, 1)
    assert report["rich.xlsx"].message.endswith("Failed: Bad/") and "Failed to read" in report["broken.xlsx"].message
    workbooks.write_sheet_csv(rows.where("file = 'good.xlsx'"), str(tmp_path / "csv"))
    back = spark.read.option("escape", '"').csv(str(tmp_path / "csv"))
    assert {(r.sheet, r._c0, r._c2) for r in back.collect()} == {("One", "a", None), ("One", "b", None), ("Two", "c", "1.5")}


def test_sheets_of_any_layout_are_standardized_without_files(spark, tmp_path):
    write(tmp_path, "b/survey_2021.xlsx", workbook_bytes({
        "Main": [[None], ["Area", "OCC Code", None, "Total Emp", "Note"], ["1", "a", "unnamed", "12", ""], [], [None, None, None, None],
                 [None, "b", None, "**"], ["3"]],
        "No rows": [["Area", "tot_emp"]], "Nothing": [], "Long row": [["area"], ["7", None, None, "beyond"]],
        "Bad 2018": [["tot_emp", "area", "Area"], ["many", "8", "9"]],
    }))
    write(tmp_path, "b/other.xlsx", workbook_bytes({"Main": [["tot_emp", "Extra"], [5, "x"]]}))
    write(tmp_path, "b/broken.xlsx", b"x")
    outcome = pipeline.standardize_workbooks(spark, str(tmp_path / "b"), str(tmp_path / "out"))
    rows = spark.read.parquet(outcome.rows_path)
    got = {(r._source_folder, r._source_file, r.AREA, r.OCC_CODE, r.TOT_EMP, r.NOTE, r.EXTRA, r._data_year) for r in rows.collect()}
    assert got == {
        ("survey_2021", "Main.csv", "1", "a", 12, None, None, 2021), ("survey_2021", "Main.csv", None, "b", None, None, None, 2021),
        ("survey_2021", "Main.csv", "3", None, None, None, None, 2021), ("other", "Main.csv", None, None, 5, None, "x", None)}
    assert rows.where("I_GROUP = 'cross-industry'").count() == 4
    report = {r.file_path.split("/b/")[1]: r for r in spark.read.json(outcome.report_path).collect()}
    assert {p: (r.status, r.rows) for p, r in report.items()} == {
        "survey_2021/Main.csv": ("ok", 3), "survey_2021/No_rows.csv": ("ok", 0), "survey_2021/Long_row.csv": ("failed", 1),
        "survey_2021/Bad_2018.csv": ("failed", 1), "other/Main.csv": ("ok", 1)}
    assert report["survey_2021/Bad_2018.csv"].dropped_columns == ["Area"] and "TOT_EMP" in report["survey_2021/Bad_2018.csv"].error
    assert (outcome.files_processed, outcome.files_failed, outcome.total_rows) == (3, 2, 4)
    converted = {r.file: r.success for r in spark.read.json(str(tmp_path / "out" / "conversion_report")).collect()}
    assert converted == {"survey_2021.xlsx": True, "other.xlsx": True, "broken.xlsx": False}


def test_convert_skips_what_is_done(spark, tmp_path):
    source, output = str(tmp_path / "in"), str(tmp_path / "out")
    write(tmp_path, "in/a.xlsx", workbook_bytes({"One": [["a"]]}))
    write(tmp_path, "in/bad.xlsx", b"x")
    first = pipeline.convert(spark, source, output)
    assert {(r.file, r.success) for r in first.collect()} == {("a.xlsx", True), ("bad.xlsx", False)}
    write(tmp_path, "in/b.xlsx", workbook_bytes({"One": [["b"]], "Two": [["c"]]}))
    again = pipeline.convert(spark, source, output)
    assert {(r.file, r.sheets_converted) for r in again.collect()} == {("b.xlsx", 2), ("bad.xlsx", 0)}
    assert {r.file for r in pipeline.convert(spark, source, output, force=True).collect()} == {"a.xlsx", "b.xlsx", "bad.xlsx"}


# --- streams ---


def test_stream_load_equals_batch_and_adds_nothing_twice(spark, root, tmp_path):
    _, plan = layout_plan(spark, root)
    source = tmp_path / "std"
    rows = corpus.standardize(plan)
    rows.where("_source_folder = '2024'").write.parquet(str(source / "a"))
    paths = [str(tmp_path / n) for n in ("rows", "audit", "cp")]
    renamed = {"_data_year": "SURVEY_YEAR", "_source_file": "SOURCE_FILE", "_source_folder": "SOURCE_FOLDER"}
    run = lambda: jobs.stream_load(spark, str(source), rows.schema, *paths, files_per_batch=1, renamed=renamed)
    run()
    run()
    assert spark.read.parquet(paths[0]).count() == 1
    rows.where("_source_folder <> '2024'").write.parquet(str(source / "b"))
    run()
    assert spark.read.parquet(paths[0]).count() == rows.count()
    audit = spark.read.parquet(paths[1])
    assert {(r.SOURCE_FILE, r.n) for r in audit.groupBy("SOURCE_FILE").agg(F.sum("ROW_COUNT").alias("n")).collect()} == {
        ("sample.csv", 1), ("part_2022.csv", 3),
    }


def test_stream_quota_equals_batch(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    data = [(start + dt.timedelta(minutes=7 * i), "hot" if i % 3 else "cold") for i in range(120)]
    hits = spark.createDataFrame(data, "ts timestamp, key string")
    hits.repartition(1).write.parquet(str(tmp_path / "in" / "1"))
    # A far later hit moves the watermark past every window above.
    closing = spark.createDataFrame([(start + dt.timedelta(days=9), "end")], hits.schema)
    batch = {tuple(r) for r in jobs.quota_windows(hits, "ts", "key", limit=4).collect()}
    assert batch and all(r[2] > 4 for r in batch)
    stream = lambda: spark.readStream.schema(hits.schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    options = dict(time="ts", key="key", limit=4, lateness="10 minutes")
    jobs.stream_quota(stream(), out, cp, **options)
    closing.write.parquet(str(tmp_path / "in" / "2"))
    jobs.stream_quota(stream(), out, cp, **options)
    late = spark.createDataFrame([(start, "hot")] * 50, hits.schema)
    late.write.parquet(str(tmp_path / "in" / "3"))
    jobs.stream_quota(stream(), out, cp, **options)
    assert {tuple(r) for r in spark.read.parquet(out).collect()} == batch


def test_hits_delivered_again_count_once(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    data = [(i, start + dt.timedelta(minutes=7 * i), "k") for i in range(40)]
    hits = spark.createDataFrame(data, "id long, ts timestamp, key string")
    out, cp, options = str(tmp_path / "out"), str(tmp_path / "cp"), dict(time="ts", key="key", limit=4, lateness="1 hour", unique="id")
    batch = {tuple(r) for r in jobs.quota_windows(hits.unionAll(hits), "ts", "key", limit=4, unique="id").collect()}
    closing = spark.createDataFrame([(99, start + dt.timedelta(days=3), "end")], hits.schema)
    for n, part in enumerate([hits.where("id < 25"), hits.where("id >= 15"), hits, closing, hits]):
        part.write.parquet(str(tmp_path / "in" / str(n)))
        stream = spark.readStream.schema(hits.schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        jobs.stream_quota(stream, out, cp, **options)
    assert batch and {tuple(r) for r in spark.read.parquet(out).collect()} == batch


def test_stream_logs(spark, tmp_path):
    write(tmp_path, "logs/a.log", '{"event": "x", "data": {"k": 1}}\n\nbroken\n')
    paths = [str(tmp_path / n) for n in ("logs", "rows", "bad", "cp")]
    jobs.stream_logs(spark, *paths)
    write(tmp_path, "logs/b.log", '{"event": "y"}\n')
    jobs.stream_logs(spark, *paths)
    got = {(r.event, r.data) for r in spark.read.parquet(paths[1]).collect()}
    assert got == {("x", json.dumps({"k": 1}, separators=(",", ":"))), ("y", None)}
    assert [r.preview for r in spark.read.parquet(paths[2]).collect()] == ["broken"]


def test_star_schema_views(spark):
    from tallystar.plans import star_schema
    from tallystar.schema import FACT_SCHEMA

    def row(area, kind, occ, year, emp, wage, own="5", title="T"):
        values = dict.fromkeys([f.name for f in FACT_SCHEMA.fields])
        values |= dict(AREA=area, AREA_TITLE=title, AREA_TYPE=kind, NAICS="0", NAICS_TITLE="All", I_GROUP="x", OWN_CODE=own)
        values |= dict(OCC_CODE=occ, OCC_TITLE=f"job {occ}", O_GROUP="detailed", TOT_EMP=emp, A_MEAN=wage, H_MEAN=12.345)
        return tuple((values | dict(SURVEY_YEAR=year, SURVEY_MONTH="May", ANNUAL="TRUE")).values())

    data = [
        row("1", 2, "a", 2023, 10, 50.0, title="New"), row("1", 2, "a", 2022, 9, 40.0, title="Old"),
        row("2", 4, "a", 2023, 20, 70.0), row("3", 1, "a", 2023, 99, 10.0), row("2", 4, "b", 2023, None, 70.0),
        row("2", 4, "a", 2023, 5, 5.0, own="4"),
    ]
    tables = star_schema.star_tables(spark.createDataFrame(data, FACT_SCHEMA))
    assert dict(tables["employment_wage_data"].dtypes)["mean_hourly_wage"] == "decimal(10,2)"
    assert tables["geographic_areas"].where("area_code = '1'").first().area_title == "New"
    views = star_schema.analytic_views(tables)
    assert views["latest_employment_data"].count() == 4
    assert views["state_employment_data"].count() == 1 and views["metro_employment_data"].count() == 2
    summary = views["occupation_summary"].collect()
    assert [(r.occ_code, r.occ_title, r.area_count, r.total_national_employment, r.avg_annual_wage) for r in summary] == [
        ("a", "job a", 2, 30, 60.0)
    ]


def test_corpus_files_are_written_in_one_pass(spark, tmp_path):
    """All years' files come from one join of the survey rows: the number of jobs does not grow with the layouts."""
    from tallystar.queries import inputs

    spark.sql("""SELECT id AS o_orderkey, id AS o_custkey, 'F' AS o_orderstatus, '1-URGENT' AS o_orderpriority, id + 0.5D AS o_totalprice,
        make_date(CAST(1995 + id % 7 AS INT), 1, 1) AS o_orderdate FROM range(70)""").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("SELECT id AS c_custkey, 0L AS c_nationkey, 'A, \"b\"' AS c_mktsegment FROM range(70)").write.parquet(f"{tmp_path}/customer.parquet")
    spark.sql("SELECT 0L AS n_nationkey, 1L AS n_regionkey, 'N' AS n_name").write.parquet(f"{tmp_path}/nation.parquet")
    sc = spark.sparkContext
    sc.setJobGroup("corpus-files", "")
    try:
        root = inputs.corpus_root(spark, str(tmp_path))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup("corpus-files")) < 2 * len(inputs.LAYOUTS)
    files = spark.read.format("binaryFile").load(f"{root}/*/*.csv").select("path", "content").collect()
    assert len(files) == 7
    text = next(bytes(f.content).decode() for f in files if f.path.endswith("vintage_2015/rows_2015_00000.csv"))
    lines = text.split("\n")
    assert lines[0] == "area,area_title,area_type,occ code,occ title,group,tot_emp,a_mean,annual" and lines[-1] == ""
    assert lines[1] == '0000000,N,2,11-0,"1-URGENT, ""F"" staff",detailed,**,*,TRUE' and len(lines) == 12


def test_sheets_are_decoded_as_arrow_batches():
    """Rows go from the decoder to Spark without a data frame between; gaps, empty rows and columns beyond Z keep their places."""
    import pyarrow as pa

    from tallystar.queries.inputs import workbook_bytes
    from tallystar.sources import workbooks

    content = workbook_bytes({"s": [["a", None, 2.5], [], [None, "<&>"]]})
    batch = pa.RecordBatch.from_arrays([pa.array(["p"]), pa.array([content])], ["path", "content"])
    rows = [r for b in workbooks._workbook_rows(iter([batch])) for r in b.to_pylist()]
    assert [r["cells"] for r in rows] == [None, ["a", None, "2.5"], [], [None, "<&>"]]
    assert [r["row_no"] for r in rows] == [None, 1, 2, 3] and workbooks._column_index("AB12") == 27
