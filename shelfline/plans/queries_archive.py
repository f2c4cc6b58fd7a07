"""Queries: archives made from the given tables, read back through ingest.

Every brand of ``part`` uploads an archive for each bucket of its parts, of BUCKET keys at most, with a
member per month.  Members differ in encoding, delimiter, form and lines before the header by month; one
is damaged, one has no table, one has no month.  Archives are files in the shared folder, and are read
as any other archive is.  ``split_csv`` reads members in blocks far smaller than they are.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from shelfline.functions import fixed_values as fv
from shelfline.plans import views
from shelfline.plans.registry import query
from shelfline.session import shared_folder
from shelfline.sources import archive as ar
from shelfline.sources.files import write_file

BUCKET, LARGE, BLOCK = 5000, 2500, 32 << 10
# Month, encoding, delimiter and lines before the header by the number of a member; XLSX where there is
# no delimiter.
KINDS = [("Jan", "utf-8", ",", 1), ("Feb", "utf-16", "\t", 0), ("Mar", "utf-8", ";", 2),
         ("Apr", None, None, 0), ("May", "latin-1", "|", 0), ("Jun", "utf-16-le", ",", 1),
         ("Dec", "utf-8-sig", ",", 0)]
DAMAGED, BARE, NAMELESS = "Mar", "May", "Jun"
MONTH = "case p_partkey % 7 " + " ".join(
    f"when {i} then '{k[0]}'" for i, k in enumerate(KINDS)) + " end"
# The damaged members, those without a table and those without a month, by brand.
BROKEN = f"month = '{DAMAGED}' and upload like '%1/%'"
EMPTY = f"month = '{BARE}' and upload like '%2/%'"
UNNAMED = f"month = '{NAMELESS}' and upload like '%3/%'"
ROWS = f"""p_brand || '/' || cast(floor(p_partkey / {BUCKET}) as bigint) as upload, p_partkey, {MONTH} as month, p_name || ' é' as title, p_type as brand,
 case when p_size % 5 = 0 then null else 'in stock' end as availability,
 p_size || '.50' as price, p_size || '' as popularity_rank"""


def workbook(sheets: dict[str, list[list[str]]]) -> bytes:
    """A workbook of sheets with inline strings."""
    space = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    link = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{space}" xmlns:r="{link}"><sheets>' + "".join(
            f'<sheet name="{escape(name)}" sheetId="{i}" r:id="r{i}"/>' for i, name in enumerate(sheets, 1))
            + '</sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(
            f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
            + "</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            cells = "".join("<row>" + "".join(
                f'<c t="inlineStr"><is><t>{escape(v or "")}</t></is></c>' for v in row) + "</row>"
                for row in rows)
            book.writestr(f"xl/worksheets/sheet{i}.xml",
                          f'<worksheet xmlns="{space}"><sheetData>{cells}</sheetData></worksheet>')
    return out.getvalue()


HEADER = ["title", "brand", "availability", "price", "popularity_rank"]


def csv_bytes(table: list[list[str]], encoding: str, delimiter: str, before: int = 0) -> bytes:
    lines = [f"Line {i} before the header" for i in range(before)]
    lines += [delimiter.join('"' + (v or "").replace('"', '""') + '"' for v in row) for row in table]
    return ("\r\n".join(lines) + "\r\n").encode(encoding)


def upload(parts: pd.DataFrame) -> bytes:
    """The archive of one upload."""
    name, damaged, out = parts["upload"].iloc[0], None, io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
        archive.writestr("__MACOSX/notes", b"none")
        for month, encoding, delimiter, before in KINDS:
            own = parts[parts["month"] == month].sort_values("p_partkey")
            if not len(own):
                continue
            table = [fv.REQUIRED_COLUMNS, *own[HEADER].values.tolist()]
            member = f"feed/{month}-2024." + ("xlsx" if delimiter is None else "csv")
            if month == NAMELESS and "3/" in name:
                member = "feed/Summer.csv"
            if delimiter is None:
                data = workbook({"Feed": table})
            elif month == BARE and "2/" in name:
                data = b"nothing here"
            else:
                data = csv_bytes(table, encoding, delimiter, before)
            archive.writestr(member, data)
            if month == DAMAGED and "1/" in name:
                damaged = data
    content = out.getvalue()
    if damaged is not None:  # another byte than the checksum was made of
        content = content.replace(damaged, b"X" + damaged[1:])
    return content


def large_upload(parts: pd.DataFrame) -> bytes:
    """An archive of one deflated member whose cells hold quotes, delimiters and line ends."""
    own = parts.sort_values("p_partkey")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("Dec-2024.csv", csv_bytes(
            [fv.REQUIRED_COLUMNS, *own[HEADER].values.tolist()], "utf-8", ";", 2))
    return out.getvalue()


def written_uploads(parts, make, ending: str = ".zip") -> str:
    """The folder that holds the file of every upload."""
    folder = f"{shared_folder(parts.sparkSession)}/uploads-{uuid.uuid4().hex}"

    def write(own: pd.DataFrame) -> pd.DataFrame:
        name = own["upload"].iloc[0]
        write_file(f"{folder}/{name}{ending}", make(own))
        return pd.DataFrame({"upload": [name]})

    parts.groupBy("upload").applyInPandas(write, "upload string").write.format("noop").mode(
        "overwrite").save()
    return folder


def decoded(spark, sf, columns=ROWS, make=upload, **more):
    """(feed, issues) of all uploads, named by what they were written as."""
    folder = written_uploads(views.select_from(spark, sf, "part", columns), make)
    feed, issues = ar.ingest_archives(spark, folder, **more)
    name = lambda c: F.regexp_replace(F.substring_index(c, "/", -2), "[.]zip$", "")
    return feed.withColumn("feed_id", name("feed_id")), issues.withColumn("archive", name("archive"))


@query("archive_feed", f"""with parts as (select {ROWS} from part),
placed as (select *, row_number() over (partition by upload, month order by p_partkey) - 1 as row_seq
  from parts)
select upload as feed_id, month, cast(2024 as bigint) as year, row_seq, title, brand, availability,
 price, popularity_rank from placed where not ({BROKEN}) and not ({EMPTY}) and not ({UNNAMED})""")
def archive_feed(spark, sf):
    feed, _ = decoded(spark, sf)
    return feed.drop("file_seq").withColumn("year", F.col("year").cast("bigint"))


@query("archive_issues", f"""with files as (select distinct upload, month from (
 select {ROWS} from part))
select upload as archive, month || '-2024.csv' as file_name, 'Error reading ' || month || '-2024.csv'
  as issue from files where ({BROKEN}) or ({EMPTY})
union all select upload, 'Summer.csv', 'Invalid filename format: Summer.csv' from files
 where {UNNAMED}
union all select upload, null, 'December file is required but missing' from files group by upload
 having count_if(month = 'Dec') = 0""")
def archive_issues(spark, sf):
    _, issues = decoded(spark, sf)
    # What a reader says of a damaged file is its own affair.
    return issues.withColumn("issue", F.when(
        F.startswith("issue", F.lit("Error reading")), F.element_at(F.split("issue", ": "), 1))
        .otherwise(F.col("issue")))


LARGE_ROWS = f"""'all/' || cast(floor(p_partkey / {LARGE}) as bigint) as upload, p_partkey,
 p_name || ' "é"; ' || p_size || chr(10) || p_brand as title, p_type as brand,
 case when p_size % 5 = 0 then null else 'in; stock' end as availability,
 p_retailprice || '' as price, p_size || '' as popularity_rank"""


@query("split_csv", f"""with parts as (select {LARGE_ROWS} from part)
select upload as feed_id, 'Dec' as month, row_number() over (partition by upload order by p_partkey) - 1
 as row_seq, title, brand, availability, price, popularity_rank from parts""")
def split(spark, sf):
    feed, _ = decoded(spark, sf, LARGE_ROWS, large_upload, block=BLOCK)
    return feed.drop("file_seq", "year")
