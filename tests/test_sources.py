import json
import random
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

import docketframe as d
from docketframe.functions.sentences import SENTENCE_COLUMNS

HEADER = ",".join(SENTENCE_COLUMNS)


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def cells(df):
    return [tuple(r) for r in df.collect()]


def test_ragged_rows(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'a,b,c\n1,2,3\n1,2\n1,2,3,4\n"x,y",,"q""r"\n   \n\n1,2,3,\n"p,q,r,s",5,"t,u",v,w\n7,"8,9"\n')
    rows = d.read_table(spark, path)
    assert cells(rows) == [("1", "2", "3"), ("1", "2", None), ("x,y", None, 'q"r'), ("7", "8,9", None)]
    # One column alone sees the same rows.
    assert [r.a for r in rows.select("a").collect()] == ["1", "1", "x,y", "7"]
    assert rows.count() == 4
    assert rows.where("b = '2'").select("c").count() == 2


def test_line_break_in_quotes(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'a,b,c\n"l1\nl2",5,6\n   \n1,2,3,4\n7,8\n')
    assert cells(d.read_table(spark, path, multi_line=True)) == [("l1\nl2", "5", "6"), ("7", "8", None)]
    with pytest.raises(Exception, match="multi_line"):
        d.read_table(spark, path).collect()


def open_at_end(text):
    state = "start"
    for c in text:
        if state in ("start", "closing") and c == '"':
            state = "quoted"
        elif state == "quoted":
            state = "closing" if c == '"' else "quoted"
        else:
            state = "start" if c in ",\n" else "bare"
    return state == "quoted"


def test_split_files_with_line_breaks_in_quotes(spark, tmp_path):
    rng, pieces = random.Random(5), ['"', '""', ",", "\n", "a", "é", " ", "b\n", '"x\ny"', '"p,q"', "1,2,3\n"]
    sizes = [1, 2, 3, 5, 7, 11, 10_000]
    try:
        for n, size in enumerate(sizes):
            texts = ["a,b,c\n" + "".join(rng.choice(pieces) for _ in range(rng.randrange(40))) for _ in range(12)]
            for i, text in enumerate(texts):
                text = text.rstrip("\n") + '"' * open_at_end(text.rstrip("\n")) + "\n"
                (tmp_path / f"{n}_{i}.csv").write_bytes(text.replace("\n", "\r\n" if i % 4 == 3 else "\n").encode())
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            path = str(tmp_path / f"{n}_*.csv")
            split = d.read_table(spark, path, columns=["a", "b", "c"], multi_line="split", with_order=True)
            whole = d.read_table(spark, path, columns=["a", "b", "c"], multi_line=True, with_order=True)
            by_file = {}
            for frame in (split, whole):
                for row in sorted(frame.collect(), key=lambda r: (r.ord.path, r.ord.block, r.ord.row)):
                    by_file.setdefault(row.ord.path, {}).setdefault(frame is split, []).append((row.a, row.b, row.c))
            for file, found in by_file.items():
                assert found.get(True) == found.get(False), (size, open(unquote(file.removeprefix("file:")), encoding="utf-8", newline="").read())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_stray_quote_in_a_wide_line(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'a,b,c\n1,2,3\n1,2,3,4"\n7,8,9\n')
    assert cells(d.read_table(spark, path)) == [("1", "2", "3"), ("7", "8", "9")]
    path = write(tmp_path / "b.csv", 'a,b,c\n1,2,3\n1,"2,3\n7,8,9\n')
    assert cells(d.read_table(spark, path, strict_quotes=False)) == [("1", "2", "3"), ("7", "8", "9")]


def test_other_header_in_a_directory(spark, tmp_path):
    write(tmp_path / "1.csv", "uid,offence\nu1,o1\n")
    write(tmp_path / "2.csv", "offence,uid\no2,u2\n")
    with pytest.raises(Exception, match="header"):
        d.read_table(spark, str(tmp_path)).collect()


def test_missing_value_tokens(spark, tmp_path):
    path = write(tmp_path / "a.csv", f"{HEADER}\nu,None,NA,n/a,null,<NA>,NaN,N/A\nu2, NA,x,-,.,0,nan.,Null\n")
    first, second = cells(d.read_sentences(spark, path))
    assert first == ("u", *[None] * 7)
    assert second == ("u2", " NA", "x", "-", ".", "0", "nan.", "Null")


def test_append_files(spark, tmp_path):
    one = write(tmp_path / "1.csv", "uid,jail\na,1y\nb,2y\n")
    two = write(tmp_path / "2.csv", "fine,uid\n5,c\n")
    rows = d.append_files(spark, [one, two])
    assert rows.columns == ["uid", "jail", "fine"]
    assert cells(rows) == [("a", "1y", None), ("b", "2y", None), ("c", None, "5")]
    with pytest.raises(ValueError):
        d.append_files(spark, [])


def test_one_scan_per_header(spark, tmp_path):
    headers = ["uid,jail", "fine,uid", '"uid",mode']
    paths = [write(tmp_path / f"t {i:02d}%é.csv", f"\n{headers[i % 3]}\n{i},x{i}\n") for i in range(30)]
    paths.append(write(tmp_path / "empty.csv", ""))
    paths.append(write(tmp_path / "long.csv", 'uid,"two\nlines"\n30,z\n'))
    rows = d.append_files(spark, paths, with_order=True, multi_line=True)
    assert rows.columns == ["uid", "jail", "ord", "fine", "mode", "two\nlines"]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 4
    wanted = [(i, *[str(i) if i % 3 != 1 else f"x{i}", f"x{i}" if i % 3 == 0 else None, str(i) if i % 3 == 1 else None]) for i in range(30)]
    got = sorted((r.ord.file, r.uid, r.jail, r.fine) for r in rows.collect())
    assert got == [*wanted, (31, "30", None, None)]
    # A directory is matched by column name as well, and its files share one place.
    whole = d.append_files(spark, [str(tmp_path), paths[0]], with_order=True, multi_line=True)
    assert sorted(whole.select("uid", "jail", "fine").collect(), key=str) == sorted(rows.select("uid", "jail", "fine").collect(), key=str)
    assert {r.ord.file for r in whole.collect()} == {0}
    assert d.append_files(spark, [paths[-2]]).count() == 0


def test_file_order(spark, tmp_path):
    lines = "\n".join(f"cc_{i % 50},name {i}" for i in range(20_000))
    path = write(tmp_path / "o.csv", f"section,offence_name\n{lines}\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        offences = d.read_offences(spark, path)
        assert offences.rdd.getNumPartitions() > 5
        firsts = {r.section: r.offence_name for r in d.first_per_section(offences).collect()}
        assert firsts == {f"cc_{i}": f"name {i}" for i in range(50)}
        order = ["ord.file", "ord.block", "ord.row"]
        for index in (0, 777, 19_999, 50_000):
            for limit in (100, 100_000):
                got = d.row_at(offences, index, order, left_to_sort=limit, ranges=16).first().offence_name
                assert got == f"name {min(index, 19_999)}"
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a,b", 'q"r', None), ("x", " y ", "z\tt"), ("é", "\\", "1")], "a string, b string, c string")
    d.write_table(rows, str(tmp_path / "out"))
    assert sorted(cells(d.read_table(spark, str(tmp_path / "out"))), key=str) == sorted(cells(rows), key=str)


def test_sentences_end_to_end(spark, tmp_path):
    sentences = write(tmp_path / "s.csv", f"{HEADER}\n2024x1_a_1,cc_101_ycja,2024-01-01,1y&6m,jail,,1000,\n2024x1_b\n")
    offences = write(tmp_path / "o.csv", "section,offence_name,minimum_sc\ncc_101,First,\ncc_101,Second,\n")
    rows = d.parse_sentences(d.read_sentences(spark, sentences), d.read_offences(spark, offences)).collect()
    assert rows[0].offence.offence_name == "First (YCJA)" and rows[0].jail.total_days == 545 and rows[0].fine == "$1000.00"
    assert rows[1].uid.docket == "b" and rows[1].jail.total_days == 0


def test_pages(spark, tmp_path):
    write(tmp_path / "one.html", "<h1>T</h1>\n<p>é")
    write(tmp_path / "two.HTML", "x")
    write(tmp_path / "three.txt", "no")
    pages = d.read_pages(spark, str(tmp_path))
    assert {r.case_name: r.html for r in pages.collect()} == {"one": "<h1>T</h1>\n<p>é", "two": "x"}
    assert [r.markdown for r in d.pages_to_markdown(d.read_pages(spark, str(tmp_path), "one")).collect()] == ["# T\n\né"]


@pytest.fixture
def reports(spark):
    link = "[s 1](/en/ca/laws/stat/sc-1996-c-19/latest/sc-1996-c-19.html#s1)"
    cases = spark.createDataFrame(
        [(1, "h", "", "R v A, 2024 ABCJ 1", [f"p {link}"]), (2, "h", "", "R v B, 2024 ABCJ 2", [])],
        "doc_id int, header string, section_heading string, citation string, paragraphs array<string>",
    )
    citations = spark.createDataFrame(
        [("2024abcj1", "R v A", "raw"), ("2024abcj2", None, "raw")], "uid string, style_of_cause string, raw_citation string"
    )
    responses = spark.createDataFrame(
        [(1, "2024abcj1", "citingCases", 200, '{"citingCases":[{"caseId":"2024abcj2"}]}')],
        "request_id int, case_id string, caseref_type string, status int, body string",
    )
    return d.build_reports(cases, d.citation_metadata(citations), responses)


@pytest.mark.parametrize("per_case", [True, False])
def test_report_round_trip(spark, tmp_path, reports, per_case):
    path = str(tmp_path / "reports")
    d.write_reports(reports, path, per_case=per_case)
    if per_case:
        assert (tmp_path / "reports" / "case_id=2024abcj1").is_dir()
    fields = ["case_id", "citation", "metadata", "references", "header", "body_paragraphs"]
    stored = d.read_reports(spark, path)
    assert sorted(map(str, stored.select(fields).collect())) == sorted(map(str, reports.select(fields).collect()))
    assert [tuple(r) for r in d.report_legislation(stored).collect()] == [
        ("2024abcj1", 1, "Controlled Drugs and Substances Act", "s1", [1])
    ]


def test_report_with_bad_paragraphs(spark, tmp_path):
    write(tmp_path / "ok.json", json.dumps({"citation": "c"}, indent=2))
    assert d.read_reports(spark, str(tmp_path / "ok.json"), multi_line=True).first().body_paragraphs == []
    write(tmp_path / "bad.json", json.dumps({"citation": "c", "body_paragraphs": "text"}))
    with pytest.raises(Exception, match="not a list"):
        d.read_reports(spark, str(tmp_path / "bad.json")).collect()
    assert d.read_reports(spark, str(tmp_path / "ok.json"), multi_line=True).select(F.col("citation")).first()[0] == "c"
