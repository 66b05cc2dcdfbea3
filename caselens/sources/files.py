"""Files of many formats as documents: one row per passage with its place."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BYTES = 50 * 1024 * 1024
MAX_RATIO, MAX_UNPACKED = 100, 2 * 1024**3
# How files of a format begin.
MAGIC = {"pdf": "25504446", "docx": "504B0304", "xlsx": "504B0304", "png": "89504E47", "jpg": "FFD8FF", "parquet": "50415231"}
LOADERS = {"txt": "text", "md": "text", "csv": "table", "tsv": "table", "html": "html", "htm": "html", "docx": "docx", "xlsx": "xlsx", "json": "json", "jsonl": "json"}

SCHEMA = "path string, loader string, section string, row_start int, row_end int, text string, error string"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


@F.pandas_udf(T.BooleanType())
def _unpacks(content: pd.Series) -> pd.Series:
    """Whether an archive stays within the limits of ``_guard``; true for what is no archive."""
    def fits(data: bytes) -> bool:
        try:
            with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
                _guard(z)
        except ValueError:
            return False
        except zipfile.BadZipFile:
            return True
        return True

    return content.map(fits, na_action="ignore")


def check(files: DataFrame) -> DataFrame:
    """``(path, length, extension, problem)`` of binary files: of unknown kind, empty, too large, not what the extension
    says, or an archive that unpacks to too much. Null where a file may be read."""
    ext = extension(F.col("path"))
    magic = F.create_map(*[F.lit(x) for k, v in MAGIC.items() for x in (k, v)])[ext]
    head = F.hex(F.substring("content", 1, 8))
    first = (
        F.when(~ext.isin([*LOADERS, *MAGIC]), "extension")
        .when(F.col("length") == 0, "empty")
        .when(F.col("length") > MAX_BYTES, "too_large")
        .when(magic.isNotNull() & ~head.startswith(magic), "wrong_magic")
    )
    zipped = ext.isin("docx", "xlsx") & (F.col("length") <= MAX_BYTES)
    out = files.select("path", "length", ext.alias("extension"), first.alias("first"), _unpacks(F.when(zipped, F.col("content"))).alias("fits"))
    return out.select("path", "length", "extension", F.coalesce("first", F.when(~F.col("fits"), "unpacks_to_too_much")).alias("problem"))


class _Sections(HTMLParser):
    """Text of a page by heading, without navigation and scripts."""

    SKIP = frozenset("script style nav footer header aside noscript iframe form button".split())
    HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
    BREAK = frozenset("p li td th tr div br table ul ol section article main".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.hidden, self.in_head = 0, False
        self.parts: list[tuple[list[str], list[str]]] = [([], [])]

    def handle_starttag(self, tag: str, attrs) -> None:  # noqa: ANN001
        if tag in self.SKIP:
            self.hidden += 1
        elif tag in self.HEADS:
            self.in_head = True
            self.parts.append(([], []))
        elif tag in self.BREAK:
            self.parts[-1][1].append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SKIP:
            self.hidden = max(0, self.hidden - 1)
        elif tag in self.HEADS:
            self.in_head = False

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts[-1][0 if self.in_head else 1].append(data)

    def sections(self) -> list[tuple[str, str]]:
        out = []
        for head, body in self.parts:
            title = " ".join("".join(head).split())
            text = "\n".join(x for x in (" ".join(line.split()) for line in "".join(body).split("\n")) if x)
            if title or text:
                out.append((title, "\n".join(x for x in (title, text) if x)))
        return out


def html_sections(page: str) -> list[tuple[str, str]]:
    """``(heading, text)`` of the sections of a page; the main part only where the page marks it."""
    for tag in ("main", "article"):
        m = re.search(rf"<{tag}\b.*?</{tag}>", page, re.S | re.I)
        if m:
            page = m[0]
            break
    p = _Sections()
    p.feed(page)
    p.close()
    return p.sections()


def table_rows(content: bytes, delimiter: str = ",") -> list[str]:
    """Rows as ``column: value | column: value``; empty cells take the value above, columns empty so far are left out."""
    try:
        text = content.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = content.decode("latin-1")
    rows = list(csv.reader(io.StringIO(text), delimiter=delimiter))
    if not rows:
        return []
    head, last, out = rows[0], {}, []
    for row in rows[1:]:
        cells = []
        for i, name in enumerate(head):
            v = row[i].strip() if i < len(row) else ""
            v = last[i] = v or last.get(i, "")
            if v:
                cells.append(f"{name}: {v}")
        if cells:
            out.append(" | ".join(cells))
    return out


def _guard(z: zipfile.ZipFile) -> None:
    total = 0
    for i in z.infolist():
        total += i.file_size
        if total > MAX_UNPACKED or (i.compress_size and i.file_size / i.compress_size > MAX_RATIO):
            raise ValueError("archive unpacks to too much")


def docx_sections(content: bytes) -> list[tuple[str, str]]:
    """``(heading, text)`` of a word-processor file; tables come as lines of cells."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        _guard(z)
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
    out: list[tuple[str, list[str]]] = [("", [])]
    words = lambda e: "".join(t.text or "" for t in e.iter(f"{w}t")).strip()
    for e in body if body is not None else []:
        if e.tag == f"{w}p":
            style = e.find(f"{w}pPr/{w}pStyle")
            text = words(e)
            if style is not None and style.get(f"{w}val", "").lower().startswith("heading"):
                out.append((text, [text]))
            elif text:
                out[-1][1].append(text)
        elif e.tag == f"{w}tbl":
            out[-1][1].extend(" | ".join(words(c) for c in r.iter(f"{w}tc")) for r in e.iter(f"{w}tr"))
    return [(h, "\n".join(x)) for h, x in out if x]


def xlsx_rows(content: bytes) -> list[tuple[str, str]]:
    """``(sheet, row text)`` of a spreadsheet, rows as in ``table_rows``."""
    m = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        _guard(z)
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{m}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        for sheet in sorted(n for n in names if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)):
            grid = []
            for row in ElementTree.fromstring(z.read(sheet)).iter(f"{m}row"):
                cells: dict[int, str] = {}
                for n, c in enumerate(row.iter(f"{m}c")):
                    letters = re.match(r"[A-Z]+", c.get("r", ""))
                    at = n
                    if letters:
                        at = 0
                        for ch in letters[0]:
                            at = at * 26 + ord(ch) - 64
                        at -= 1
                    v = c.find(f"{m}v")
                    text = "".join(t.text or "" for t in c.iter(f"{m}t")) if c.get("t") == "inlineStr" else (v.text or "" if v is not None else "")
                    cells[at] = shared[int(text)] if c.get("t") == "s" and text else text
                grid.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
            buffer = io.StringIO()
            csv.writer(buffer).writerows(grid)
            out += [(sheet.rsplit("/", 1)[1][:-4], r) for r in table_rows(buffer.getvalue().encode())]
    return out


def _load(path: str, content: bytes) -> Iterator[tuple]:
    ext = path.rsplit(".", 1)[-1].lower()
    loader = LOADERS.get(ext)
    try:
        if loader is None:
            yield path, None, None, None, None, None, "unknown extension"
        elif loader in ("text", "json"):
            lines = [content.decode("utf-8", "replace").strip()]
            for text in lines:
                if text:
                    yield path, loader, None, None, None, text, None
        elif loader == "table":
            for i, r in enumerate(table_rows(content, "\t" if ext == "tsv" else ","), 1):
                yield path, loader, None, i, i, r, None
        elif loader == "xlsx":
            for i, (sheet, r) in enumerate(xlsx_rows(content), 1):
                yield path, loader, sheet, i, i, r, None
        else:
            found = html_sections(content.decode("utf-8", "replace")) if loader == "html" else docx_sections(content)
            for h, t in found:
                yield path, loader, h or None, None, None, t, None
    except Exception as e:  # noqa: BLE001  a broken file is a row, not a failed job
        yield path, loader, None, None, None, None, f"{type(e).__name__}: {e}"[:200]


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """All files of a folder as documents; files that are too large, of unknown kind or broken come as rows with an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    small = files.where(F.col("length") <= MAX_BYTES).select("path", "content")
    large = files.where(F.col("length") > MAX_BYTES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
        for pdf in batches:
            rows = [r for p, c in zip(pdf["path"], pdf["content"]) for r in _load(p, bytes(c))]
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"row_start": "Int32", "row_end": "Int32"})

    too_large = large.select("path", *[F.lit(None).cast(t.split(" ")[1]).alias(t.split(" ")[0]) for t in SCHEMA.split(", ")[1:-1]], F.lit("too large").alias("error"))
    return small.mapInPandas(run, SCHEMA).unionByName(too_large)


def read_snapshot(spark: SparkSession, path: str, records: str) -> DataFrame:
    """The records of one kind in a point-in-time JSON dump ``{kind: [record, ...]}``."""
    return spark.read.json(path, multiLine=True).select(F.explode(F.col(records)).alias("r")).select("r.*")


def effective_range(filename: Column) -> list[Column]:
    """First and last day in force that a file name states as a year: 1 July to 30 June of the next."""
    year = F.regexp_extract(filename, r"(20\d{2})", 1).try_cast("int")
    return [F.make_date(year, F.lit(7), F.lit(1)).alias("effective_from"), F.make_date(year + 1, F.lit(6), F.lit(30)).alias("effective_to")]


def safe_cell(c: Column) -> Column:
    """A cell that no spreadsheet takes for a formula."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def write_table(rows: DataFrame, path: str, fmt: str = "csv") -> None:
    """Rows as CSV with safe cells, JSON lines or Parquet."""
    if fmt == "csv":
        text = [safe_cell(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes]
        rows.select(*text).write.mode("overwrite").option("header", True).csv(path)
    else:
        rows.write.mode("overwrite").format(fmt).save(path)


def export_session(messages: DataFrame, session: str = "session_id") -> DataFrame:
    """One JSON text per session with its messages in order."""
    m = F.array_sort(F.collect_list(F.struct("created_at", "message_id", "role", "content")))
    return messages.groupBy(session).agg(F.to_json(m).alias("json"))
