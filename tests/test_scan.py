import csv
import io
import json
import os
import re
import tomllib
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillsift import cli, config
from quillsift.config import ScanConfig
from quillsift.operators import results, selection
from quillsift.operators.limits import rows_within_limits, within_limits
from quillsift.plans import scan
from quillsift.sinks import writers
from quillsift.sources import files, readers
from quillsift.sources.encoding import decode, detect_encoding
from quillsift.sources.readers import read_docx, read_xlsx, sheet_text
from quillsift.streaming import scan as streaming

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def docx():
    p = lambda *t: f"<w:p>{''.join(f'<w:r><w:t>{x}</w:t></w:r>' for x in t)}</w:p>"
    return zipped({
        "word/document.xml": f"<w:document {W}><w:body>{p('mail a', '@b.co')}<w:tbl><w:tr><w:tc>{p('cell')}</w:tc></w:tr></w:tbl></w:body></w:document>",
        "word/header1.xml": f"<w:hdr {W}>{p('top')}</w:hdr>", "word/footer1.xml": f"<w:ftr {W}>{p('bottom')}</w:ftr>",
        "word/footnotes.xml": f"<w:footnotes {W}>{p('note')}</w:footnotes>", "word/comments.xml": f"<w:comments {W}>{p('remark')}</w:comments>",
        "docProps/core.xml": '<c:coreProperties xmlns:c="x" xmlns:d="y"><d:creator>Ann</d:creator></c:coreProperties>',
    })


def xlsx():
    return zipped({
        "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="one" r:id="r1"/><sheet name="none" r:id="r2"/><sheet name="two" r:id="r3"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/><Relationship Id="r3" Target="/xl/worksheets/sheet3.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {S}><si><t>name</t></si><si><r><t>x@</t></r><r><t>y.org</t></r></si></sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="3"><c r="B3"><f>1+1</f><v>2</v></c></row></sheetData></worksheet>',
        "xl/worksheets/sheet2.xml": f"<worksheet {S}><sheetData/></worksheet>",
        "xl/worksheets/sheet3.xml": f'<worksheet {S}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>4700123456789010</t></is></c><c r="B1" t="b"><v>1</v></c></row></sheetData></worksheet>',
    })


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    for name, raw in {
        "a.txt": b"card 4700123456789010 and user@example.com\nuser@example.com", "b.TXT": b"no@case.org", "empty.txt": b"", "c.csv": b"\xef\xbb\xbfPAN,x\r\n371234567890120,amex\r\n",
        "d.bin": b"who@bin.org", "f.docx": docx(), "g.xlsx": xlsx(), "h.docx": b"not a zip", "i.xls": b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1junk", "latin.log": "caf\xe9 m\xe9@x.org z@z.net".encode("latin-1"),
        "skip/k.txt": b"skip@me.org", "keep/l.xml": b"<?xml version='1.0'?><m>in@xml.net</m>", ".hid/m.txt": b"hid@den.org", "noise.txt": bytes(range(256)), "pic.png": b"\x89PNG\r\n\x1a\n\x00",
    }.items():
        (top / name).parent.mkdir(exist_ok=True)
        (top / name).write_bytes(raw)
    return top


def conf(tree, **more):
    return ScanConfig(start_dirs=[str(tree)], exclude_dirs=[f"{tree}/SKIP"], **more)


def names(frame):
    return {(os.path.basename(r["filename"]), r["key"], r["value"]) for r in frame.collect()}


WANT = {
    ("a.txt", "visa", "470012******9010"), ("a.txt", "email", "u***@example.com"), ("c.csv", "amex", ",371234*****0120,"), ("f.docx", "email", "*@b.co"),
    ("g.xlsx", "email", "*@y.org"), ("g.xlsx", "visa", "470012******9010"), ("d.bin", "email", "w**@bin.org"), ("b.TXT", "email", "n*@case.org"), ("latin.log", "email", "*@z.net"), ("l.xml", "email", "i*@xml.net"),
}


def test_scan(spark, tree):
    got = names(results.flat(scan.findings(spark, conf(tree))))
    want = {(a, b, c.strip(",") if a == "c.csv" else c) for a, b, c in WANT}
    assert {(a, b, c.strip(",") if a == "c.csv" else c) for a, b, c in got} == want
    failed = {os.path.basename(r["filename"]) for r in scan.errors(spark, conf(tree)).collect()}
    assert failed == {"h.docx", "i.xls"}


def test_hidden_and_case(spark, tree):
    got = {f for f, *_ in names(results.flat(scan.findings(spark, conf(tree, hidden=True, ignore_case=True))))}
    assert {"m.txt", "b.TXT"} <= got and "k.txt" not in got


def test_totals(spark, tree):
    row = scan.totals(spark, conf(tree)).first()
    assert row["files_found"] > row["files_scanned"] > 5 and row["total_results"] == len(WANT) and row["bytes_found"] >= row["bytes_scanned"]


def test_sinks(spark, tree, tmp_path):
    found = scan.findings(spark, conf(tree))
    writers.fan_out(found, {k: str(tmp_path / k) for k in ("csv", "json", "text")})
    lines = [r for p in (tmp_path / "csv").glob("*.csv") for r in csv.DictReader(p.open(newline="", encoding="utf-8"))]
    assert {r["value"] for r in lines if r["filename"].endswith("a.txt")} == {"visa: 470012******9010", "email: u***@example.com"}
    rows = [json.loads(x) for p in (tmp_path / "json").glob("*.json") for x in p.read_text().splitlines()]
    assert {k: v for r in rows if r["filename"].endswith("g.xlsx") for k, v in r["matches"].items()} == {"Email Address": {"email": ["*@y.org"]}, "Primary Account Number": {"visa": ["470012******9010"]}}
    text = "".join(p.read_text() for p in (tmp_path / "text").glob("*.txt"))
    in_order = [json.loads(x)["filename"] for p in sorted((tmp_path / "json").glob("part-*.json")) for x in p.read_text().splitlines()]
    told = [x for p in sorted((tmp_path / "text").glob("part-*.txt")) for x in p.read_text().splitlines() if x.startswith("filename: ")]
    listed = [r["filename"] for p in sorted((tmp_path / "csv").glob("part-*.csv")) for r in csv.DictReader(p.open(newline="", encoding="utf-8"))]
    assert in_order == sorted(in_order) and told == sorted(told) and len(told) == len(in_order) and listed == sorted(listed)
    assert "matches:\n    Email Address:\n        email:\n        - '*@b.co'\n" in text and text.count("---\n") == len(rows)


def test_json_array(spark, tree, tmp_path):
    found = scan.findings(spark, conf(tree))
    for frame, n in ((found, len({w[0] for w in WANT})), (found.limit(0), 0)):
        writers.write_json_array(frame, str(tmp_path / "array"))
        parts = sorted((tmp_path / "array").glob("part-*.txt"))
        assert len(json.loads("".join(p.read_text() for p in parts))) == n


def test_stream_matches_batch(spark, tree, tmp_path):
    one = ScanConfig(start_dirs=[str(tree)], results={"json": str(tmp_path / "out")})
    streaming.run(spark, one, str(tmp_path / "state")).awaitTermination(120)
    rows = spark.read.json(str(tmp_path / "out/batch=0"))
    batch = results.nested(scan.findings(spark, one))
    assert rows.select(F.regexp_extract("filename", "[^/]*$", 0)).distinct().count() == batch.count()


# Own sentences; the encodings they are written in are told from the bytes.
SCRIPTS = {
    "shift_jis": "これは日本語の文章です。カタカナもあります。", "euc-jp": "これは日本語の文章です。カタカナもあります。", "euc-kr": "한국어 문장입니다. 오늘은 날씨가 좋습니다.", "gb18030": "这是一个中文句子，今天天气很好，我们去公园散步。",
    "big5": "這是一個中文句子，今天天氣很好，我們去公園散步。", "cp1251": "Это русский текст. Сегодня хорошая погода, Москва.", "koi8-r": "Это русский текст. Сегодня хорошая погода, Москва.",
    "cp866": "Это русский текст. Сегодня хорошая погода, Москва.", "cp1252": "Café déjà vu, naïve Übergrößen für Ärzte – schön",
}


@pytest.mark.parametrize("name", SCRIPTS)
def test_encodings_by_script(name):
    for text in (SCRIPTS[name], SCRIPTS[name] * 50, f"user@example.com\n{SCRIPTS[name]}"):
        assert detect_encoding(text.encode(name)) == name and decode(text.encode(name)) == text


def test_encodings():
    assert detect_encoding(b"ab\xe9") == "cp1252" and detect_encoding(b"ab\x81") == "iso-8859-1" and decode(b"ascii first \xc3\xa9", "ascii") == "ascii first é" and decode(b"caf\xe9", "ascii") == "café"
    assert detect_encoding(b"plain") == "ascii" and detect_encoding(b"") is None and detect_encoding(bytes(range(256))) is None
    assert decode("é".encode()) == "é" and decode(b"\xe9t\xe9") == "été" and decode(b"\xef\xbb\xbfx") == "x" and decode("né".encode("utf-16")) == "né"


def test_readers():
    assert list(read_docx(docx())) == ["top\nmail a@b.co\ncell\nbottom\nnote\nremark\n{'creator': 'Ann'}"]
    assert list(read_xlsx(xlsx())) == ["name x@y.org\n2", "4700123456789010 True"]
    assert sheet_text(iter([["a"], *[[]] * 250, ["b"], *[[]] * 251, ["c"]])) == "a\nb"
    assert sheet_text(iter([[*[""] * 500, "x", "", "y"]])) == "x"


def test_blank_limits(spark):
    rows = [(1, 1, 1, "a"), (1, 1, 2, ""), (1, 1, 3, None), (1, 1, 4, "late"), (1, 2, 1, ""), (1, 3, 1, ""), (1, 4, 1, "below"), (2, 1, 1, "ok")]
    cells = spark.createDataFrame(rows, "sheet int, row int, col int, value string")
    assert {r["value"] for r in within_limits(cells, 1, 1).collect()} == {"a", "ok"}
    assert {r["value"] for r in within_limits(cells, 2, 2).collect()} == {"a", "late", "below", "ok"}


def test_blank_limits_of_rows_in_parts(spark):
    """Parts of a row count as one; the cells of a sheet are as a plain loop reads them, and rows are dealt out once, not cells."""
    import random

    draw = random.Random(5)
    rows = [(s, r, [(draw.randint(1, 9), draw.choice(["", None, f"{s}-{r}"])) for _ in range(draw.randint(1, 6))]) for s in range(40) for r in (draw.randint(1, 12) for _ in range(9)) if draw.random() < 0.8 or s % 2]
    rows += [(s, r, [(1, "")]) for s in range(0, 40, 3) for r in range(3, 6)]
    want = []
    for sheet in {s for s, *_ in rows}:
        idle = 0
        for row in sorted({r for s, r, _ in rows if s == sheet}):
            cells = [c for s, r, part in rows if (s, r) == (sheet, row) for c in part]
            kept = [c for c in cells if c[1] and sum(not v and k <= c[0] for k, v in cells) <= 2]
            idle = 0 if kept else idle + 1
            if idle > 1:
                break
            want += [(sheet, row, *c) for c in kept]
    frame = spark.createDataFrame(rows, "sheet int, row int, cells array<struct<col: int, value: string>>")
    got = rows_within_limits(frame, 2, 1)
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
    assert got._jdf.queryExecution().sparkPlan().toString().count("Exchange ") <= 1 and "Join" not in got._jdf.queryExecution().sparkPlan().toString()
    cells = frame.select("sheet", "row", F.inline("cells"))
    assert sorted(map(tuple, within_limits(cells, 2, 1).collect())) == sorted(want)


def test_selection(spark):
    rows = spark.createDataFrame([(".docx", None), (".txt", "application/pdf"), (".TXT", None), ("", "text/plain"), (".x", "image/png")], "ext string, mime string")
    got = rows.select(selection.handler(F.col("ext"), F.col("mime")).alias("h"), selection.file_matches(F.col("ext"), F.col("mime")).alias("m")).collect()
    assert [(r["h"], r["m"]) for r in got] == [("docx", True), ("pdf", True), (None, False), ("plaintext", True), (None, False)]
    dirs = spark.createDataFrame([("/dev",), ("/Development/x",), ("/usr/src",), ("/usr/src/y",), ("/home",)], "d string")
    kept = dirs.where(~selection.excluded(F.col("d"), ["/dev", "/usr/src/"], ["/dev"])).collect()
    assert [r["d"] for r in kept] == ["/dev", "/usr/src", "/home"]


OFFICE = "application/vnd.openxmlformats-officedocument"


@pytest.mark.parametrize("raw,mime", [
    (b"%PDF-1.7", "application/pdf"), (b"<?xml?>", "application/xml"), (docx(), f"{OFFICE}.wordprocessingml.document"), (xlsx(), f"{OFFICE}.spreadsheetml.sheet"), (b"PK\x03\x04plain", None),
    (zipped({f"junk/{k}": "x" for k in range(3000)} | {"word/document.xml": ""}), f"{OFFICE}.wordprocessingml.document"), (zipped({"a": ""}), "application/zip"), (b"", None),
    (bytes.fromhex("D0CF11E0A1B11AE100"), "application/vnd.ms-excel"), (b"{\\rtf1 x}", "text/rtf"), (b'{"a": [1, 2]}', "application/json"), (b' [{"a": 1}]\n', "application/json"), (b"{curly, but no JSON}", "text/plain"),
    (b'{"a": ' + b"[1], " * 20000, "application/json"), (b"<a><b/></a>", "application/xml"), (b"<!-- x --><a/>", "application/xml"), (b"\xef\xbb\xbf<!DOCTYPE HTML><p>", "text/html"), (b"< 3 words", "text/plain"),
    (b"plain text", "text/plain"), ("текст на русском языке".encode("cp1251"), "text/plain"), (b"\x00\x01\x02", None), ("né".encode("utf-16"), "text/plain"),
])
def test_media_types(raw, mime):
    assert selection.media_type_of(io.BytesIO(raw)) == mime


def test_large_files_are_read_in_ranges(spark, tmp_path, monkeypatch):
    """Each line once, whatever the ranges; a large file that isn't selected or isn't text is only looked at."""
    monkeypatch.setattr(files, "RANGE", 997)
    lines = [f"line {k} user{k}@host{k % 7}.org\n" for k in range(900)]
    (tmp_path / "big.log").write_text("".join(lines))
    (tmp_path / "wide.txt").write_text("é" * 700 + " wide@line.org " + "x " * 3000 + "last@line.org")
    (tmp_path / "utf16.txt").write_bytes("".join(lines).encode("utf-16"))
    for name, size in (("video.mp4", 3 << 30), ("zeros.log", 3 << 20)):
        with open(tmp_path / name, "wb") as f:
            f.truncate(size)
    one = ScanConfig(start_dirs=[str(tmp_path), str(tmp_path / "missing")])
    blocks = files.read_blocks(spark, one).collect()
    assert {os.path.basename(r["filename"]) for r in blocks} == {"big.log", "wide.txt", "utf16.txt", "zeros.log"} and not any(r["error"] for r in blocks)
    for name in ("big.log", "utf16.txt"):
        own = sorted((r["block"], r["content"]) for r in blocks if r["filename"].endswith(name) and r["content"])
        assert " ".join(c for _, c in own) == " ".join("".join(lines).split()) and (len(own) > 20) == (name == "big.log")
    assert {v for f, _, v in names(results.flat(scan.findings(spark, one))) if f == "wide.txt"} == {"w***@line.org", "l***@line.org"}
    row = scan.totals(spark, one).first()
    assert row["files_found"] == 5 and row["files_scanned"] == 4


def test_lines_of_ranges(monkeypatch):
    monkeypatch.setattr(readers, "_STEP", 16)
    raw = b"one\ntwo words\n\n" + b"long line of many words " * 9 + b"\nend without a feed"
    for size in range(1, 60):
        parts = [b"".join(readers.lines_between(io.BytesIO(raw), k, min(len(raw), k + size))) for k in range(0, len(raw), size)]
        full = [p for p in parts if p]
        assert b"".join(parts) == raw and all(p.endswith(b"\n") for p in full[:-1])
    assert all(p.endswith((b" ", b"\n")) for p in readers.lines_between(io.BytesIO(raw), 0, len(raw) - 20))


def test_packing_of_words_into_blocks():
    assert list(readers.pack([], 10)) == [""] and list(readers.pack(["  ", ""], 10)) == [""]
    # a block ends with the word that fills it, blanks counted; a line gives one block at most, and the rest comes at the end
    assert list(readers.pack(["aaaa bbbb cccc dddd eeee ffff"], 10)) == ["aaaa bbbb", "cccc dddd eeee ffff"]
    assert list(readers.pack(["aaaa bbbb", "c", "dddd eeeee\tf"], 10)) == ["aaaa bbbb", "c dddd eeeee", "f"]
    assert list(readers.pack(["x" * 700, "y"], 650)) == ["x" * 700, "y"]


def test_blocks_are_packed_in_little_memory(monkeypatch):
    """A worker holds the characters of a block, not an object for each of its words, and of pieces only one."""
    import tracemalloc

    monkeypatch.setattr(readers, "_STEP", 1 << 18)
    raw = b"some words of a line that is read from a file\n" * 200_000
    for pieces, most in ((False, 4 * len(raw)), (True, len(raw))):
        tracemalloc.start()
        got = [hash(b) for b in readers.read_plaintext(io.BytesIO(raw), pieces=pieces)]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most and (len(got) > 5) == pieces


def test_pieces_have_the_findings_of_the_whole():
    import random

    from quillsift.functions import email, pan

    number = re.compile(r"(?:^|[^\d.-])(?:" + "|".join(pan.BRANDS.values()) + r")(?:$|[^\d.-])")
    mail = re.compile(email.PATTERN.replace(r"(?:\G|(?<!", "(?:(?<!").replace("(?<!" + email.ATOM + ")", "(?<!" + email.ATOM + ")"))
    found = lambda texts: [[m.strip() for t in texts for m in p.findall(t)] for p in (number, mail)]
    draw = random.Random(7)
    words = ["4700123456789010", "4700", "1234", "5678", "9010", "371234 567890", "12345", "a", "end", "x@y.org", '"a\\ b"@y.org', "-", "4700-1234-5678-9010", "é9", "9é"]
    for _ in range(300):
        lines = [" ".join(draw.choices(words, k=draw.randint(0, 9))) for _ in range(draw.randint(0, 30))]
        whole = " ".join(" ".join(lines).split())
        for size in (1, 5, 40, 200):
            got = list(readers.cut(lines, size))
            assert " ".join(got) == whole and found(got) == found([whole])
    digits = [" ".join(["4700 1234"] * 9)] * 50
    assert list(readers.cut(digits, 10)) == [" ".join(digits)] and max(map(len, readers.cut(digits, 10, 100))) < 110
    assert " ".join(readers.cut(digits, 10, 100)) == " ".join(digits)


def test_pieces_only_for_detectors_that_allow_them(spark):
    from quillsift.functions import registry

    assert registry.takes_pieces() and registry.takes_pieces(["pan"]) and not registry.takes_pieces(mode="last_per_brand")
    registry.register("own", "Own", lambda text, **_: F.array())
    try:
        assert not registry.takes_pieces() and not registry.takes_pieces(["own"]) and registry.takes_pieces(["email"])
    finally:
        registry.unregister("own")


def test_own_readers_and_writers(spark, tmp_path):
    selection.register("reversed", (".rev",))
    readers.register("reversed", lambda raw: iter([raw.decode()[::-1]]))
    writers.register("counts", lambda found, path: results.count_results(found).write.mode("overwrite").parquet(path))
    try:
        assert list(readers.read("reversed", io.BytesIO(b"olleh"))) == ["hello"]
        rows = spark.createDataFrame([(".rev",)], "ext string").select(selection.handler(F.col("ext"), F.lit(None).cast("string")).alias("h"), selection.file_matches(F.col("ext"), F.lit("x")).alias("m"))
        assert tuple(rows.first()) == ("reversed", True)
        found = results.findings(spark.createDataFrame([("f", 0, "a@b.co")], "filename string, block int, content string"))
        writers.fan_out(found, {"counts": str(tmp_path / "counts")})
        assert spark.read.parquet(str(tmp_path / "counts")).first()["results"] == 1
    finally:
        selection.unregister("reversed")
        readers.unregister("reversed")
        writers.unregister("counts")
    assert "reversed" not in selection.HANDLERS and "counts" not in writers.WRITERS


def test_yaml_of_odd_names(spark):
    row = spark.createDataFrame([("a 'b'\nc", {"t": {"k": ["v'"]}})], "f string, m map<string, map<string, array<string>>>").select(writers.yaml_document(F.col("f"), F.col("m")).alias("y")).first()
    assert row["y"].splitlines()[1] == 'filename: "a \'b\'\\nc"' and row["y"].endswith("- 'v'" + "''")


def test_stream_of_several_directories(spark, tmp_path):
    """All start directories are followed, excluded ones are not."""
    for name in ("in1/a.txt", "in2/b.txt", "in2/skip/c.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"{name[-5]}@{name[:3]}.org")
    two = ScanConfig(start_dirs=[str(tmp_path / "in1"), str(tmp_path / "in2")], exclude_dirs=[str(tmp_path / "in2/skip")], results={"json": str(tmp_path / "out")})
    streaming.run(spark, two, str(tmp_path / "state")).awaitTermination(120)
    rows = spark.read.json(str(tmp_path / "out/batch=*"))
    assert {os.path.basename(r["filename"]) for r in rows.collect()} == {"a.txt", "b.txt"}


def test_files_of_other_stores(spark, tree, monkeypatch):
    """Where the workers can't open the paths, Spark reads the selected files; those too large for that are told."""
    monkeypatch.setattr(files, "opens", lambda config: False)
    got = names(results.flat(scan.findings(spark, conf(tree))))
    assert {f for f, *_ in got} == {f for f, *_ in WANT}
    monkeypatch.setattr(files, "WHOLE", 20)
    errors = {os.path.basename(r["filename"]): r["error"] for r in scan.errors(spark, conf(tree)).collect()}
    assert errors["a.txt"] == "too large for its store" and "c.csv" in errors


def test_nested_union_and_counts(spark):
    blocks = spark.createDataFrame([("f", 0, "a@b.co"), ("f", 1, "a@b.co and x@y.org"), ("g", 0, "nothing"), ("h", 0, None)], "filename string, block int, content string")
    found = results.findings(blocks)
    assert {r["filename"]: r["results"] for r in results.count_results(found).collect()} == {"f": 2}
    assert results.nested(found).first()["matches"] == {"Email Address": {"email": ["*@b.co", "*@y.org"]}}


def test_config(tmp_path):
    path = tmp_path / "own.toml"
    assert config.write_default(str(path)) == "Success"
    saved = tomllib.loads(path.read_text())
    assert saved == config.DEFAULTS
    assert config.write_default(str(tmp_path / "no/such/own.toml")) != "Success"
    saved["dataHandlers"], saved["includeFiles"]["ext"], saved["results"]["csv"] = ["pan", "dna"], ["txt", ".zzz"], False
    got = config.resolve(saved, root="/r", os_name="linux")
    assert got.detectors == ["pan"] and got.extensions == [".txt"] and got.ignored == ["dna", ".zzz"] and set(got.results) == {"json", "text"}
    assert got.exclude_dirs[-2:] == ["/r/scan-results", "/r/logs"] or got.exclude_dirs[-2].startswith("/r/scan-results")
    assert [config.is_all(x) for x in ("All", ["ALL"], {"all": 1}, "x", [])] == [True, True, True, False, False]
    assert config.load(str(tmp_path / "none.toml")).detectors == ["pan", "email"]


def test_command_line(tmp_path, capsys):
    assert cli.main(["-c", str(tmp_path / "c.toml")]) == 0 and Path(tmp_path / "c.toml").exists()
    assert cli.main(["--list-datahandlers"]) == 0 and cli.main(["--list-filetypes"]) == 0 and cli.main(["--cpu-count"]) == 0
    (tmp_path / "x.bin").write_bytes(docx())
    assert cli.main(["--mime", str(tmp_path), str(tmp_path / "x.bin")]) == 0
    said = capsys.readouterr().out
    assert "pan" in said and ".docx" in said and "Directory" in said and "wordprocessingml" in said


def test_files_listing(spark, tree):
    listed = {os.path.basename(r["path"]): r for r in files.list_files(spark, conf(tree)).collect()}
    assert "k.txt" not in listed and listed["a.txt"]["ext"] == ".txt" and "empty.txt" not in listed


def test_a_number_across_the_end_of_a_piece_stays_whole():
    text = "word " * 20 + "4700 1234 5678 9010 end"
    for size in range(90, 125):
        assert any("4700 1234 5678 9010" in p for p in readers.read("plaintext", io.BytesIO(text.encode()), pieces=True))
        assert any("4700 1234 5678 9010" in p for p in readers.cut([text], size))
