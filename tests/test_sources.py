import json
import zipfile

from pyspark.sql import functions as F

from caselens.sources import files
from caselens.sources.paged import PagedSource


def make(folder):
    (folder / "a.txt").write_text("  hello \n")
    (folder / "b.csv").write_bytes("n,city\nAli,Caf\xe9\n,\nOmar,".encode("latin-1"))
    (folder / "c.html").write_text("<html><nav>menu</nav><main><h1>One</h1><p>first</p><script>x()</script><h2>Two</h2><p>a&amp;b</p></main></html>")
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(folder / "d.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>body</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(folder / "e.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {m}><si><t>name</t></si><si><t>Zed</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {m}><sheetData><row><c r="A1" t="s"><v>0</v></c></row><row><c r="A2" t="s"><v>1</v></c></row></sheetData></worksheet>')
    (folder / "f.docx").write_bytes(b"not a zip")
    (folder / "g.bin").write_bytes(b"\x00")
    with zipfile.ZipFile(folder / "h.docx", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", "0" * 5_000_000)


def test_all_formats(spark, tmp_path):
    make(tmp_path)
    rows = files.read_documents(spark, str(tmp_path)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.path.rsplit("/", 1)[1], []).append(r)
    assert [r.text for r in by["a.txt"]] == ["hello"]
    assert [r.text for r in by["b.csv"]] == ["n: Ali | city: Café", "n: Ali | city: Café", "n: Omar | city: Café"]
    assert [(r.section, r.text) for r in by["c.html"]] == [("One", "One\nfirst"), ("Two", "Two\na&b")]
    assert [(r.section, r.text) for r in by["d.docx"]] == [("Top", "Top\nbody\nx | y")]
    assert [(r.section, r.text) for r in by["e.xlsx"]] == [("sheet1", "name: Zed")]
    assert by["f.docx"][0].error.startswith("BadZipFile") and by["g.bin"][0].error == "unknown extension"
    assert "too much" in by["h.docx"][0].error
    checked = {r.path.rsplit("/", 1)[1]: r.problem for r in files.check(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert checked["f.docx"] == "wrong_magic" and checked["d.docx"] is None


def test_cells_snapshot_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", 1), ("ok", 2), (None, 3)], "a string, b int")
    assert [r[0] for r in df.select(files.safe_cell(F.col("a"))).collect()] == ["'=1+1", "ok", None]
    files.write_table(df, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 3
    (tmp_path / "snap.json").write_text(json.dumps({"fir": [{"id": 1}, {"id": 2}]}))
    assert files.read_snapshot(spark, str(tmp_path / "snap.json"), "fir").count() == 2
    r = spark.createDataFrame([("FinanceAct2024.pdf",), ("none.pdf",)], "f string").select(*files.effective_range(F.col("f"))).collect()
    assert str(r[0].effective_from) == "2024-07-01" and r[1].effective_to is None


def test_paged_service(spark, tmp_path):
    for n in (1, 2):
        data = [{"id": i, "updated_at": f"2025-01-0{i}"} for i in range(2 * n - 1, 2 * n + 1)]
        (tmp_path / f"page-{n}.json").write_text(json.dumps({"meta": {"total": 4}, "data": data}))
    spark.dataSource.register(PagedSource)
    assert spark.read.format("paged").option("root", str(tmp_path)).load().count() == 4
    assert spark.read.format("paged").option("root", str(tmp_path)).option("updated_since", "2025-01-03").load().count() == 2
