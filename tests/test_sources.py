import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from shelfline.operators import consolidate as co
from shelfline.sources import archive as ar
from shelfline.sources import columns as sc
from shelfline.sources import filenames as fn
from shelfline.sources import ordered, reports
from shelfline.sources import snapshot as sn
from shelfline.sources import split_csv
from shelfline.session import written

HEADER = "Title,Brand,Availability,Price range max.,Popularity rank"


def xlsx(rows):
    """A minimal workbook: one sheet, shared and inline strings, numbers."""
    shared, cells = [], []
    for r, row in enumerate(rows, 1):
        parts = []
        for c, value in enumerate(row):
            ref = f"{chr(65 + c)}{r}"
            if value is None:
                continue
            if isinstance(value, (int, float)):
                parts.append(f'<c r="{ref}"><v>{value}</v></c>')
            elif c % 2:
                parts.append(f'<c r="{ref}" t="inlineStr"><is><t>{value}</t></is></c>')
            else:
                shared.append(value)
                parts.append(f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>')
        cells.append(f'<row r="{r}">{"".join(parts)}</row>')
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="Toys" '
                   f'sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels",
                   '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>" + "".join(
            f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml",
                   f'<worksheet {main}><sheetData>{"".join(cells)}</sheetData></worksheet>')
    return out.getvalue()


@pytest.fixture()
def archives(tmp_path):
    def write(name, members):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for member, content in members:
                z.writestr(member, content)
        return str(tmp_path)
    return write


def test_archives_to_feed_and_issues(spark, archives, tmp_path):
    utf16 = ("﻿" + HEADER.replace(",", "\t") + "\r\nRosé Wine\tAcme\tin stock\t12\t3\r\n").encode("utf-16-le")
    folder = archives("feed.zip", [
        ("sub/", b""), ("__MACOSX/Jan-2025.csv", b"junk"), (".hidden.csv", b"x"),
        ("sub/Feb-2025.csv", f"{HEADER}\nRed Wine,Acme,in,1,5\n,x,,,\nRed wine!,Other,in,2,4\n".encode()),
        ("Dec-2025.csv", utf16),
        ("BWS Feb 2024.csv", HEADER.encode() + b"\nlate,x,x,1,1\n"),
        ("notes.txt", b"hello"), ("Mar-2025.csv", b"\n"),
        ("Mar 2024.csv", b"report of\nMarch\nProduct Title;Brand;Availability;Price range max..;Popularity rank.\nAle;B;N/A;3.50;7\n"),
        ("Apr-2025.xlsx", xlsx([["Title", "Brand", "Availability", "Price range max.", "Popularity rank"],
                                ["Gin", "Maker", None, 9.5, 2]])),
        ("May-2025.csv", b"Title,Brand\nStout,C\n")])
    archives("empty.zip", [("__MACOSX/x.csv", b"")])
    feed, issues = ar.ingest_archives(spark, folder, tasks=4, store=str(tmp_path / "store"))
    rows = {(r.month, r.row_seq): r for r in feed.filter(F.col("feed_id").endswith("feed.zip")).collect()}
    assert {k[0] for k in rows} == {"Feb", "Dec", "Mar", "Apr", "May"}
    assert rows[("Dec", 0)].title == "Rosé Wine" and rows[("Dec", 0)].popularity_rank == "3"
    assert (rows[("Mar", 0)].title, rows[("Mar", 0)].availability, rows[("Mar", 0)].price) == ("Ale", None, "3.50")
    assert (rows[("Apr", 0)].title, rows[("Apr", 0)].brand, rows[("Apr", 0)].price) == ("Gin", "Maker", "9.5")
    assert rows[("May", 0)].price is None
    found = [(r.archive.rsplit("/", 1)[1], r.file_name, r.issue) for r in issues.collect()]
    assert ("empty.zip", None, "No valid files found in archive") in found
    texts = {(n, i.split(":")[0]) for a, n, i in found if a == "feed.zip"}
    assert texts == {("BWS Feb 2024.csv", "Duplicate file for month"), ("notes.txt", "Invalid filename format"),
                     ("Mar-2025.csv", "Error reading Mar-2025.csv"), ("May-2025.csv", "Missing required column")}
    assert sum(n == "May-2025.csv" for _, n, _ in found) == 3
    master = {r.product_key: r for r in co.master_products(feed).collect()}
    assert master["red wine"].title == "Red Wine" and master["red wine"].brand == "Acme"


def test_a_damaged_member_does_not_take_others_with_it(spark, tmp_path):
    rows = f"{HEADER}\nAle,B,in,1,2\n"
    with zipfile.ZipFile(tmp_path / "f.zip", "w") as z:
        for month in ("Jan", "Feb", "Mar", "Dec"):
            z.writestr(f"{month}-2025.csv", rows.replace("Ale", f"Ale {month}"))
    data = (tmp_path / "f.zip").read_bytes()
    (tmp_path / "f.zip").write_bytes(data.replace(b"Ale Feb", b"Ale Fxb", 1))
    feed, issues = ar.ingest_archives(spark, str(tmp_path), store=str(tmp_path / "store"))
    assert {r.month for r in feed.collect()} == {"Jan", "Mar", "Dec"}
    (issue,) = issues.collect()
    assert issue.file_name == "Feb-2025.csv" and issue.issue.startswith("Error reading Feb-2025.csv")


@pytest.mark.parametrize("encoding", ["utf-16", "utf-8", "utf-8-sig", "utf-16-le", "utf-16-be", "latin-1"])
@pytest.mark.parametrize("delimiter", [",", ";", "\t", "|"])
def test_sniffing(encoding, delimiter):
    text = HEADER.replace(",", delimiter) + "\n" + delimiter.join(["Rosé", "b", "c", "1", "2"]) + "\n"
    table = ar.csv_table(text.encode(encoding))
    assert [ar.scrub_cell(h) for h in table[0]] == HEADER.split(",")
    assert table[1] == ["Rosé", "b", "c", "1", "2"] and len(table) == 2


def test_quoted_delimiters_and_long_records():
    table = ar.csv_table(f'{HEADER}\n"a, b",c,d,1,2\n'.encode())
    assert table[1][0] == "a, b"
    with pytest.raises(ValueError):
        ar.csv_table(b"a,b\n1,2,3\n")


def test_later_member_of_a_base_name_keeps_the_first_place():
    assert ar.feed_members(["a/x.csv", "y.csv", "b/x.csv", "d/"]) == [("x.csv", "b/x.csv"), ("y.csv", "y.csv")]


@pytest.mark.parametrize("name, want", [
    ("Jan-2025.xlsx", ("Jan", 2025, "xlsx")), ("BWS Sept 2025.csv", ("Sep", 2025, "csv")),
    ("december 2024.CSV", ("Dec", 2024, "csv")), ("BWS Apr-2025.csv", (None, None, None)),
    ("Foo-2025.csv", (None, None, None)), ("Apr 2025.txt", (None, None, None)),
    ("a b Feb 2020.csv", ("Feb", 2020, "csv")), (None, (None, None, None))])
def test_file_names(spark, name, want):
    df = spark.createDataFrame([(name,)], "n string")
    assert tuple(fn.with_file_parts(df, "n").drop("n").first()) == want


def test_unreadable_file_does_not_take_its_month(spark):
    files = spark.createDataFrame(
        [("z", 0, "Jan-2024.csv", "Jan", "bad"), ("z", 1, "Jan-2025.csv", "Jan", None),
         ("z", 2, "Jan 2026.csv", "Jan", "bad")],
        "archive string, file_seq long, file_name string, month string, error string")
    got = {r.file_seq: (r.accepted, r.issue) for r in fn.file_status(files).collect()}
    assert got[0] == (False, "Error reading Jan-2024.csv: bad")
    assert got[1] == (True, None) and got[2] == (False, "Duplicate file for month: Jan")


def test_header_rules(spark):
    header = [" product TITLE ", "Brand", "brand", "Popularity rank.", "Price range max.."]
    df = spark.createDataFrame([(1, header)], "file_id long, header array<string>")
    assert [r.missing for r in sc.missing_columns(df, ["file_id"]).collect()] == ["Availability"]
    mapping = {r.field: r.source for r in sc.column_mapping(df, ["file_id"]).collect()}
    assert mapping == {"title": header[0], "brand": "Brand", "availability": None,
                       "price": header[4], "popularity_rank": header[3]}
    assert sc.header_map(header) == {"title": 0, "brand": 1, "price": 4, "popularity_rank": 3}
    renamed = sc.rename_date_columns(spark.createDataFrame([(1, 2)], ["2023-01-01 00:00:00", "x"]))
    assert renamed.columns == ["Jan 2023", "x"]
    twice = spark.createDataFrame([(1, 2, 3)], ["a", "b", "a2"]).toDF("a", "b", "a")
    assert sc.first_of_each_column(twice).collect()[0].asDict() == {"a": 1, "b": 2}


def test_snapshot_round_trip(spark, tmp_path):
    folder = str(tmp_path / "snap")
    assert sn.load_snapshot(spark, folder) is None
    df = spark.createDataFrame([("Gin", 1.5, None)], "`Product Title` string, `Price range max.` double, "
                               "`Product Keyword` string")
    sn.save_snapshot(df, folder, product_type="BWS")
    table, facts = sn.load_snapshot(spark, folder)
    assert table.columns == df.columns and facts == {"product_type": "BWS"}
    assert [tuple(r) for r in table.collect()] == [("Gin", 1.5, None)]
    assert sn.clear_snapshot(spark, folder) and sn.load_snapshot(spark, folder) is None


def test_report_and_side_files(spark, tmp_path):
    df = spark.createDataFrame([("Gin", "N/A")], "`Product Title` string, `Jan 2023` string")
    sn.write_report(df, str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r"), header=True).columns == df.columns
    (tmp_path / "side.csv").write_text(
        "Product Title , Product Keyword,Product Keyword Avg MSV,2023-02-01 00:00:00,Peak Seasonality\nGin,dry gin,10,4,Feb\n")
    side = sn.read_side_file(spark, str(tmp_path / "side.csv"))
    assert sc.volume_columns(side.columns) == {
        "monthly": ["Feb 2023"], "average": ["Product Keyword Avg MSV"], "peak": ["Peak Seasonality"]}


def test_taxonomy_workbook(spark, tmp_path):
    (tmp_path / "t.xlsx").write_bytes(xlsx([["Level 1", "Level 2", "Level 3"], ["Games", "Board", None]]))
    rows = [tuple(r) for r in sn.read_taxonomy_workbooks(spark, str(tmp_path)).collect()]
    assert rows == [("Toys", "Games", "Board", None)]


def test_side_files_may_be_workbooks(spark, tmp_path):
    (tmp_path / "up.xlsx").write_bytes(xlsx([
        [" Product Title ", "Product Keyword", "2024-03-01 00:00:00"], ["Gin", "dry gin", 7],
        ["Rum", None, 0]]))
    side = sn.read_side_file(spark, str(tmp_path / "up.xlsx"))
    assert side.columns == ["Product Title", "Product Keyword", "Mar 2024"]
    assert [tuple(r) for r in side.orderBy("Product Title").collect()] == [
        ("Gin", "dry gin", "7"), ("Rum", None, "0")]


def test_reports_keep_their_column_names_as_parquet(spark, tmp_path):
    report = spark.createDataFrame([(1, 2)], ["Product Title", "Product_Title"])
    sn.write_report(report, str(tmp_path / "r"), "parquet")
    assert spark.read.parquet(str(tmp_path / "r")).columns == report.columns


def test_a_half_written_version_does_not_count(spark, tmp_path):
    folder = str(tmp_path / "snap")
    sn.save_snapshot(spark.createDataFrame([(1,)], "a int"), folder, n="1")
    (tmp_path / "snap" / "version-99999999999999999999" / "catalog").mkdir(parents=True)
    table, facts = sn.load_snapshot(spark, folder)
    assert table.first().a == 1 and facts == {"n": "1"}
    sn.save_snapshot(spark.createDataFrame([(2,)], "a int"), folder, n="2")
    assert sn.load_snapshot(spark, folder)[1] == {"n": "2"}


# --- members read in blocks -----------------------------------------------------------------------

def odd_members():
    r = random.Random(1)

    def cell():
        return r.choice(['"a ""q"" , ; \n x\r\n"', '""', 'in"ner', '"x"y', "", " é日𝄞 ", *["w" * n for n in range(9)]])

    for encoding in ["utf-16", "utf-8", "utf-8-sig", "utf-16-le", "utf-16-be", "latin-1", "cp1252"]:
        for d in ",;\t|":
            for skip in (0, 1, 2):
                eol = r.choice(["\n", "\r\n", "\r"])
                rows = [HEADER.replace(",", d)] + [d.join(cell() for _ in range(r.choice([5, 5, 5, 4])))
                                                   for _ in range(r.randrange(1, 25))] + [""] * r.randrange(3)
                text = "".join(r.choice(["report,of", "x", '"q', ""]) + eol for _ in range(skip)) + eol.join(
                    rows) + r.choice(["", eol, '"open'])
                yield text.encode(encoding, "replace")
    yield from [b"", b"abc", b"a,b\n1,2,3\n", b'a,b\n"' + b"x\n," * 200, b"a,b\n" + b"1,2\n" * 100,
                b"\n\n\n\n\na;b\n1;2\n" + b"\r" * 50, "a,b\n1,é日𝄞\n".encode() * 30, b"a,b\n\xff\xfe,1\n" * 20]


@pytest.mark.parametrize("size", [16, 300])
def test_blocks_read_like_the_whole(spark, tmp_path, size):
    members, rows = list(odd_members()), []
    for i, m in enumerate(members):
        pieces = (m[k:k + 37] for k in range(0, len(m), 37))
        rows += [("z", i, *b) for b in split_csv.cut_blocks(pieces, size)]
    spark.createDataFrame(rows, split_csv.BLOCK_ROW).repartition(8).write.parquet(str(tmp_path / "blocks"))
    records, tables = split_csv.split_tables(
        spark.read.parquet(str(tmp_path / "blocks")), lambda df: written(df, "split"))
    cells = {}
    for x in records.collect():
        cells.setdefault(x.file_seq, {})[x.row_seq] = x.cells
    found = {t.file_seq: t for t in tables.collect()}
    assert len(found) == len(members) and len(rows) > 2 * len(members)
    for i, m in enumerate(members):
        t, own = found[i], cells.get(i, {})
        assert ar.sniff_csv(m) == ((t.encoding, t.delimiter, t.skip) if t.encoding else None)
        if t.encoding:
            assert [t.header, *(own[k] for k in range(len(own)))] == ar.csv_table(m)
        else:
            assert not own


def test_a_first_block_is_not_handed_all_text_of_a_reading_without_records(spark, tmp_path):
    # Text of one byte a character is one endless record in UTF-16.
    content, kept = b"a;b\n" + b"12;3\n" * 200, []
    rows = [("z", 0, *b) for b in split_csv.cut_blocks(iter([content]), 64)]
    spark.createDataFrame(rows, split_csv.BLOCK_ROW).write.parquet(str(tmp_path / "blocks"))
    records, tables = split_csv.split_tables(spark.read.parquet(str(tmp_path / "blocks")), lambda df: (
        kept.append(written(df, "split")) or kept[-1]))
    assert records.count() == 200 and tables.first().header == ["a", "b"]
    handed = [df.where("piece is not null").select(F.max(F.length("text"))).first()[0] or 0
              for df in kept if "text" in df.columns]
    assert max(handed) < 64 and len(handed) == 1


def test_feed_rows_are_not_sent_to_their_files(spark, archives, tmp_path):
    folder = archives("feed.zip", [("Dec-2025.csv", f"{HEADER}\nAle,B,in,1,1\n")])
    feed, _ = ar.ingest_archives(spark, folder, store=str(tmp_path / "store"))
    assert "rightHint=(strategy=broadcast)" in feed._jdf.queryExecution().optimizedPlan().toString()


def test_archives_in_blocks_give_the_same_feed(spark, archives, tmp_path):
    rows = "".join(f'"Ale ""{i}"", {i}",B,N/A,{i},{i}\n' for i in range(400))
    folder = archives("feed.zip", [("Dec-2025.csv", f"{HEADER}\n{rows}".encode("utf-16")),
                                   ("Jan-2025.csv", f"x\n{HEADER}\n{rows}".encode()),
                                   ("Feb-2025.csv", b"nothing to split here " * 90),
                                   ("Mar-2025.csv", f"{HEADER}\nGin,B,in,1,2\n".encode())])
    got = []
    for block in (512, 1 << 20):
        feed, issues = ar.ingest_archives(spark, folder, block=block, store=str(tmp_path / f"store{block}"))
        got.append((sorted(map(tuple, feed.collect())), sorted((r.file_name, r.issue) for r in issues.collect())))
    assert got[0] == got[1] and len(got[0][0]) == 801 and len(got[0][1]) == 1


def test_damaged_member_in_blocks_is_left_out(spark, archives, tmp_path):
    rows = "".join(f"Ale {i},B,in,1,2\n" for i in range(300))
    with zipfile.ZipFile(tmp_path / "f.zip", "w") as z:
        z.writestr("Dec-2025.csv", f"{HEADER}\n{rows}")
        z.writestr("Jan-2025.csv", f"{HEADER}\n{rows}end,B,in,1,2\n")
    data = (tmp_path / "f.zip").read_bytes()
    (tmp_path / "f.zip").write_bytes(data.replace(b"end,B", b"enx,B", 1))
    (tmp_path / "g.zip").write_bytes(b"PK no archive")
    (tmp_path / "h.zip").write_bytes(b"no archive at all " * 90)
    feed, issues = ar.ingest_archives(spark, str(tmp_path), block=256, store=str(tmp_path / "store"))
    assert feed.count() == 300 and {r.month for r in feed.collect()} == {"Dec"}
    found = {(r.archive.rsplit("/", 1)[1], r.issue.split(":")[0]) for r in issues.collect()}
    undated = "December file is required but missing"
    assert found == {("f.zip", "Error reading Jan-2025.csv"), ("g.zip", "Archive cannot be opened"),
                     ("h.zip", "Archive cannot be opened"), ("g.zip", undated), ("h.zip", undated)}


# --- order, side files, reports, updates ----------------------------------------------------------

def test_lines_keep_their_order_over_blocks_and_files(spark, tmp_path):
    for f in range(3):
        (tmp_path / f"{f}.txt").write_text("".join(f"{f}-{i}\n" + "x" * (i % 50) + "\n" for i in range(400)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        lines = ordered.numbered_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 10
        got = [r.value for r in lines.orderBy("line_no").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [x for f in range(3) for i in range(400) for x in (f"{f}-{i}", "x" * (i % 50))]


def test_side_files_of_differing_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(" Title ,2024-01-01,Title\nGin,5,other\nRum,,x\n".encode("utf-16"))
    (tmp_path / "b.csv").write_text("notes\nkeyword;Title;\n\"dry; gin\";Gin;z\n")
    (tmp_path / "c.xlsx").write_bytes(xlsx([["Avg MSV", "Title"], [7, "Ale"]]))
    (tmp_path / "d.csv").write_text("no table")
    side = ordered.read_side_files(spark, str(tmp_path))
    assert side.columns == ["Title", "Jan 2024", "keyword", "Avg MSV"]
    assert sorted(map(tuple, side.collect()), key=str) == [
        ("Ale", None, None, "7"), ("Gin", "5", None, None), ("Gin", None, "dry; gin", None),
        ("Rum", None, None, None)]
    (tmp_path / "none").mkdir()
    assert ordered.read_side_files(spark, str(tmp_path / "none")).columns == []


def test_report_files_are_bounded_ordered_and_committed(spark, tmp_path):
    folder = str(tmp_path / "report")
    assert reports.load_report(spark, folder) is None
    rows = [(i * 3, f'a "{i}"\n,', None if i % 2 else "", "x") for i in range(25)]
    df = spark.createDataFrame(rows, "row_id long, a string, b string, c string").repartition(5)
    reports.save_report(df.limit(3), folder)
    reports.save_report(df, folder, rows=10, names=[" Title", "Mar 2024", "Title "])
    table, manifest = reports.load_report(spark, folder)
    assert table.columns == ["Title", "Mar 2024", "ordinal"]
    assert sorted((r.file_no, r.first, r.rows) for r in manifest.collect()) == [(0, 0, 10), (1, 10, 10), (2, 20, 5)]
    assert [tuple(r) for r in table.orderBy("ordinal").collect()] == [
        (a, b, i) for i, (_, a, b, _) in enumerate(rows)]
    (version,) = (tmp_path / "report").iterdir()
    assert len(list((version / "files").glob("file_no=*/*.csv"))) == 3
    next((version / "files").glob("file_no=1/*.csv")).unlink()
    with pytest.raises(ValueError, match="manifest"):
        reports.load_report(spark, folder)
    reports.save_report(df.limit(0), folder)
    assert reports.load_report(spark, folder)[0].count() == 0


def test_updates_write_what_changed(spark, tmp_path):
    folder = str(tmp_path / "snap")
    row = "`Row Id` long, title string"
    sn.save_snapshot(spark.createDataFrame([(i, f"title {i}" * 9) for i in range(5000)], row), folder, kind="BWS")
    size = lambda p: sum(f.stat().st_size for f in p.rglob("*.parquet"))
    want, (version,) = {i: f"title {i}" * 9 for i in range(5000)}, (tmp_path / "snap").iterdir()
    for n in range(5):
        sn.update_snapshot(spark.createDataFrame([(n, f"new {n}"), (9000 + n, "added")], row), folder, "Row Id",
                           removed=spark.createDataFrame([(100 + n, "")], row), most=3)
        want |= {n: f"new {n}", 9000 + n: "added"}
        del want[100 + n]
        if n < 3:
            assert size(version / "deltas") < size(version / "catalog") / 2
        table, facts = sn.load_snapshot(spark, folder)
        assert {r["Row Id"]: r.title for r in table.collect()} == want and facts == {"kind": "BWS"}
        assert table.count() == len(want)
    (now,) = (tmp_path / "snap").iterdir()
    assert now != version and len(list((now / "deltas").iterdir())) == 1
    with pytest.raises(ValueError):
        sn.update_snapshot(table, str(tmp_path / "nothing"), "Row Id")
