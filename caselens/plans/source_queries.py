"""Queries over file sources: the stations table is written in each format to the shared folder and read back."""

from __future__ import annotations

import csv
import io
import json
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import functions as F

from caselens.plans.registry import Registry
from caselens.session import Scratch
from caselens.sources import files
from caselens.sources.paged import PagedSource
from caselens.tables import table

_R = Registry()
QUERIES, SQL, query = _R.QUERIES, _R.SQL, _R.query
_HEAD = ("station_code", "station_name", "district", "desk_phone")
_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_M = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def _stations(spark, d) -> list[tuple]:
    """The stations in order: a fixed table of 64 rows."""
    return [tuple(r) for r in table(spark, d, "stations").select(*_HEAD).distinct().orderBy("station_code").collect()]


def _folder(spark, contents: dict[str, bytes]) -> str:
    """A new folder of the shared one with these files."""
    root = Scratch(spark, "files").path("in")
    jvm = spark.sparkContext._jvm
    for name, data in contents.items():
        at = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
        out.write(bytearray(data))
        out.close()
    return root


def _csv(rows: list[tuple], code: str = "utf-8", delimiter: str = ",") -> bytes:
    out = io.StringIO()
    csv.writer(out, delimiter=delimiter).writerows([_HEAD, *[[c or "" for c in r] for r in rows]])
    return out.getvalue().encode(code)


def _xlsx(rows: list[tuple]) -> bytes:
    words = sorted({c for r in (_HEAD, *rows) for c in r if c})
    at = {w: k for k, w in enumerate(words)}
    cells = lambda n, r: "".join(f'<c r="{chr(65 + k)}{n}" t="s"><v>{at[c]}</v></c>' for k, c in enumerate(r) if c)
    body = "".join(f'<row r="{n}">{cells(n, r)}</row>' for n, r in enumerate((_HEAD, *rows), 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {_M}>{''.join(f'<si><t>{escape(w)}</t></si>' for w in words)}</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {_M}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def _by_district(rows: list[tuple]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for _, name, district, _ in rows:
        if name and district:
            out.setdefault(district, []).append(name)
    return out


def _docx(rows: list[tuple]) -> bytes:
    para = lambda t, style="": f'<w:p>{style}<w:r><w:t>{escape(t)}</w:t></w:r></w:p>'
    head = '<w:pPr><w:pStyle w:val="Heading2"/></w:pPr>'
    body = "".join(para(k, head) + "".join(para(n) for n in names) for k, names in _by_district(rows).items())
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {_W}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def _html(rows: list[tuple]) -> bytes:
    body = "".join(f"<h2>{escape(k)}</h2><ul>{''.join(f'<li>{escape(n)}</li>' for n in names)}</ul><script>x()</script>" for k, names in _by_district(rows).items())
    return f"<html><body><nav>Menu</nav><main>{body}</main><footer>End</footer></body></html>".encode()


_FILLED = """SELECT concat_ws(' | ', 'station_code: ' || station_code, 'station_name: ' || last_value(station_name IGNORE NULLS) OVER w,
 'district: ' || last_value(district IGNORE NULLS) OVER w, 'desk_phone: ' || last_value(desk_phone IGNORE NULLS) OVER w) AS text, row_number() OVER w AS row_no
 FROM (SELECT DISTINCT station_code, nullif(station_name, '') AS station_name, nullif(district, '') AS district, nullif(desk_phone, '') AS desk_phone FROM stations) WINDOW w AS (ORDER BY station_code)"""
_SECTIONS = """SELECT district AS section, district || chr(10) || string_agg(station_name, chr(10) ORDER BY station_code) AS text
 FROM (SELECT DISTINCT * FROM stations) WHERE district <> '' AND station_name <> '' GROUP BY 1"""


@query("src_csv", f"SELECT f.file, t.* FROM (VALUES ('a.csv'), ('b.tsv')) f(file), ({_FILLED}) t")
def src_csv(spark, d):
    """Comma and tab separated tables, one not in UTF-8; empty cells take the value above."""
    rows = _stations(spark, d)
    got = files.read_documents(spark, _folder(spark, {"a.csv": _csv(rows, "latin-1"), "b.tsv": _csv(rows, delimiter="\t")}))
    return got.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "text", F.col("row_start").cast("long").alias("row_no"))


@query("src_excel", _FILLED)
def src_excel(spark, d):
    """A spreadsheet with shared strings and empty cells."""
    got = files.read_documents(spark, _folder(spark, {"book.xlsx": _xlsx(_stations(spark, d))}))
    return got.select("text", F.col("row_start").cast("long").alias("row_no"))


@query("src_html", _SECTIONS)
def src_html(spark, d):
    """The sections of a page, without navigation, scripts and footer."""
    return files.read_documents(spark, _folder(spark, {"p.html": _html(_stations(spark, d))})).select("section", "text")


@query("src_docx", _SECTIONS)
def src_docx(spark, d):
    """The sections of a word-processor file by heading."""
    return files.read_documents(spark, _folder(spark, {"d.docx": _docx(_stations(spark, d))})).select("section", "text")


@query("src_text", "SELECT DISTINCT station_code AS name, station_name AS text FROM stations WHERE trim(station_name) <> ''")
def src_text(spark, d):
    """One text file per station, with blanks around."""
    root = _folder(spark, {f"{c}.txt": f"  {n or ''}\n".encode() for c, n, _, _ in _stations(spark, d)})
    return files.read_documents(spark, root).select(F.regexp_extract("path", r"([^/]+)\.txt$", 1).alias("name"), "text")


@query("src_dir", "SELECT DISTINCT district AS folder, station_code AS name FROM stations WHERE district <> '' AND station_name <> ''")
def src_dir(spark, d):
    """A folder of folders, read whole."""
    root = _folder(spark, {f"{k}/{c}.md": n.encode() for c, n, k, _ in _stations(spark, d) if k and n})
    path = F.url_decode(F.col("path"))
    got = files.read_documents(spark, root)
    return got.select(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("folder"), F.regexp_extract(path, r"([^/]+)\.md$", 1).alias("name"))


@query("src_dispatch", """SELECT * FROM (VALUES ('a.csv', 'table', (SELECT count(DISTINCT station_code) FROM stations), NULL), ('b.xlsx', 'xlsx', (SELECT count(DISTINCT station_code) FROM stations), NULL),
 ('c.html', 'html', (SELECT count(DISTINCT district) FROM stations WHERE district <> '' AND station_name <> ''), NULL), ('d.docx', 'docx', (SELECT count(DISTINCT district) FROM stations WHERE district <> '' AND station_name <> ''), NULL),
 ('e.txt', 'text', 1, NULL), ('f.docx', 'docx', 1, 'BadZipFile'), ('g.bin', NULL, 1, 'unknown extension'), ('h.docx', 'docx', 1, 'ValueError')) t(file, loader, parts, error)""")
def src_dispatch(spark, d):
    """Files of all kinds in one folder: each goes to its loader, broken and unknown ones are rows with an error."""
    rows = _stations(spark, d)
    bomb = io.BytesIO()
    with zipfile.ZipFile(bomb, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", "0" * 5_000_000)
    root = _folder(spark, {"a.csv": _csv(rows), "b.xlsx": _xlsx(rows), "c.html": _html(rows), "d.docx": _docx(rows), "e.txt": b"one", "f.docx": b"no archive", "g.bin": b"\x00", "h.docx": bomb.getvalue()})
    got = files.read_documents(spark, root).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "loader", F.regexp_extract("error", r"^([^:]+)", 1).alias("error"))
    return got.groupBy("file", "loader", "error").agg(F.count(F.lit(1)).alias("parts"))


@query("src_validate", """SELECT * FROM (VALUES ('b.xlsx', 'xlsx', NULL), ('d.docx', 'docx', NULL), ('e.txt', 'txt', NULL), ('f.docx', 'docx', 'wrong_magic'), ('g.bin', 'bin', 'extension'), ('h.docx', 'docx', 'unpacks_to_too_much')) t(name, extension, problem)""")
def src_validate(spark, d):
    """Which files of a folder may be read, and what is wrong with the others."""
    rows = _stations(spark, d)
    bomb = io.BytesIO()
    with zipfile.ZipFile(bomb, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", "0" * 5_000_000)
    root = _folder(spark, {"b.xlsx": _xlsx(rows), "d.docx": _docx(rows), "e.txt": b"one", "f.docx": b"no archive", "g.bin": b"\x00", "h.docx": bomb.getvalue()})
    f = spark.read.format("binaryFile").load(root)
    return files.check(f).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "extension", "problem")


@query("src_snapshot", "SELECT DISTINCT station_code, station_name, district, desk_phone FROM stations")
def src_snapshot(spark, d):
    """One kind of record of a point-in-time dump."""
    dump = {"stations": [dict(zip(_HEAD, r)) for r in _stations(spark, d)], "others": [{"x": 1}]}
    root = _folder(spark, {"dump.json": json.dumps(dump).encode()})
    return files.read_snapshot(spark, f"{root}/dump.json", "stations").select(*_HEAD)


@query("src_api_pages", "SELECT DISTINCT station_code AS id, station_name FROM stations WHERE station_code >= 'PS020'")
def src_api_pages(spark, d):
    """A paged service read from a time on, a partition per page (the folder must be mounted on all workers)."""
    rows = [{"id": c, "updated_at": c, "station_name": n} for c, n, _, _ in _stations(spark, d)]
    pages = {f"page-{k // 10 + 1}.json": json.dumps({"meta": {"total": len(rows)}, "data": rows[k : k + 10]}).encode() for k in range(0, len(rows), 10)}
    spark.dataSource.register(PagedSource)
    root = _folder(spark, pages).removeprefix("file://").removeprefix("file:")
    got = spark.read.format("paged").option("root", root).option("updated_since", "PS020").load()
    return got.select("id", F.get_json_object("record", "$.station_name").alias("station_name"))
