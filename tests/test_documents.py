"""Rules of document conversion on small cases."""

import datetime as dt
import io
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow import settings as S
from folioflow.functions import cleanup
from folioflow.functions import text as T
from folioflow.operators import docx, ocr, phrases
from folioflow.plans.convert import convert_folder, write_results
from folioflow.sources import docx_parts, engines, manifest
from folioflow.streaming.incremental import follow

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def make_docx(body, footnotes=None, picture=False):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        if footnotes:
            z.writestr("word/footnotes.xml", f"<w:footnotes {W}>{footnotes}</w:footnotes>")
        if picture:
            z.writestr("word/media/image1.png", b"picture")
            z.writestr("word/_rels/document.xml.rels", '<Relationships><Relationship Id="rId1" Type="http://x/image" Target="media/image1.png"/><Relationship Id="rId2" Type="http://x/image" TargetMode="External" Target="http://y"/></Relationships>')
    return out.getvalue()


def para(text):
    return f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


def test_settings():
    assert S.parse_languages("rus+eng,osd") == ("rus", "eng", "osd")
    assert S.parse_languages("eng eng") == ("eng",)
    with pytest.raises(ValueError):
        S.parse_languages("+")
    with pytest.raises(ValueError):
        S.parse_workers("9")
    assert S.parse_workers("2") == 2
    assert len(S.Settings().dpi) * len(S.Settings().psm) * len(S.Settings().variants) == 27
    assert S.Settings(quality_mode="standard").dpi == (216,)


@pytest.mark.parametrize("text, needed", [("", True), ("Это предложение из текстового слоя. " * 5, False), ("z q x F E a o N\n" * 20, True)])
def test_which_pages_need_recognition(spark, text, needed):
    assert one(spark, T.needs_ocr, text) is needed


def test_docx(spark):
    body = para("Intro") + "<w:tbl><w:tr><w:tc>" + para("A|1") + "</w:tc><w:tc>" + para("B") + "</w:tc></w:tr><w:tr><w:tc>" + para("C") + "</w:tc></w:tr></w:tbl>"
    body += '<w:p><w:r><w:t>Claim</w:t><w:footnoteReference w:id="2"/></w:r></w:p>'
    notes = f'<w:footnote w:id="-1">{para("no")}</w:footnote><w:footnote w:id="2">{para("Note text")}</w:footnote>'
    files = spark.createDataFrame([(1, make_docx(body, notes)), (2, b"not a zip"), (3, make_docx(""))], "doc_id long, content binary")
    got = {r["doc_id"]: r for r in docx.docx_text(docx.docx_blocks(files)).collect()}
    assert got[1]["raw_text"] == "Intro\n\n| A\\|1 | B |\n| --- | --- |\n| C |  |\n\nClaim[2]\n\n## Сноски\n\n[2] Note text"
    assert got[2]["error"] and got[3]["error"] == "Встроенное чтение DOCX не извлекло текст."


def test_docx_pictures(spark):
    data = make_docx(para("x") + '<w:p><w:blip r:embed="rId1"/><w:blip r:embed="rId1"/><w:blip r:id="rId2"/></w:p>', picture=True)
    files = spark.createDataFrame([(1, data)], "doc_id long, content binary")
    assert [(r["number"], r["target"]) for r in docx.picture_places(docx_parts.references(files)).collect()] == [(1, "word/media/image1.png")]
    rows = docx.docx_pictures(files).collect()
    assert [(r["number"], bytes(r["content"])) for r in rows] == [(1, b"picture")]
    seen = spark.createDataFrame([(1, 1, "short"), (1, 2, "long enough text of a picture")], "doc_id long, number int, text string")
    assert [r["block"] for r in docx.picture_sections(seen).collect()] == ["### Изображение 1\n\nlong enough text of a picture"]


def test_word_table(spark):
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext"
    row = lambda line, conf, word: f"5\t1\t1\t1\t{line}\t1\t0\t0\t1\t1\t{conf}\t{word}"
    tsv = "\r\n".join([head, row(1, 90, "Hello"), row(1, 80, "world"), row(2, 70, "Again"), row(2, -1, " "), "short"])
    tables = spark.createDataFrame([(1, tsv), (2, "no\theader"), (3, "")], "doc_id long, tsv string")
    got = ocr.recognised_text(ocr.word_table(tables, ["doc_id"]), ["doc_id"]).collect()
    assert [(r["doc_id"], r["text"], r["confidence"]) for r in got] == [(1, "Hello world\nAgain", 80.0)]


def test_scores(spark):
    rows = [("A page of clear text was extracted. " * 5, 90.0, 6), ("a b c d e f g", 30.0, 11), ("same text here", 50.0, 6), ("same text here", 50.0, 11), ("", None, 6)]
    s = [r["score"] for r in ocr.scored(spark.createDataFrame(rows, "text string, confidence double, psm int")).collect()]
    assert s[0] > s[1] and s[2] - s[3] == pytest.approx(8.0) and s[4] == 8.0


def sequential_choice(tries, least):
    best = None
    for n, (score, sure, chars) in enumerate(tries, 1):
        if best is None or score > best[0]:
            best = (score, sure, chars, n)
        if n >= least and best[1] is not None and best[1] >= 88 and best[2] >= 400:
            return best[3], n
    return best[3], len(tries)


def test_best_attempt_with_early_stop(spark):
    rnd = random.Random(1)
    pages = [[(rnd.randrange(6), rnd.choice([None, 80.0, 90.0]), rnd.choice([10, 500])) for _ in range(27)] for _ in range(120)]
    rows = [(p, 1, n, float(s), c, "x" * k) for p, page in enumerate(pages) for n, (s, c, k) in enumerate(page, 1)]
    df = spark.createDataFrame(rows, "doc_id long, page_index int, attempt_no int, score double, confidence double, text string")
    got = {r["doc_id"]: (r["attempt_no"], r["attempt_count"]) for r in ocr.best_attempts(df, ["doc_id", "page_index"], 9).collect()}
    assert got == {p: sequential_choice(page, 9) for p, page in enumerate(pages)}
    assert len({c for _, c in got.values()}) > 1


def test_cleanup(spark):
    text = "Heading line\n\nперенос сло-\nва здесь\nстр. 12\nпродолжение\n- item\n1. first\n# Title\n\n\n\nEnd."
    assert one(spark, cleanup.clean_markdown, text) == "Heading line\n\nперенос слова здесь продолжение\n- item\n1. first\n# Title\n\nEnd."
    long = "x" * 81
    assert one(spark, cleanup.clean_markdown, f"{long}\nNew sentence") == f"{long}\nNew sentence"
    assert one(spark, cleanup.clean_markdown, "Short\nNew") == "Short New"
    assert one(spark, cleanup.clean_markdown, "") == ""


def test_phrases(spark):
    texts = spark.createDataFrame([(1, "Quality: signal\nphrase, alpha beta"), (2, "beta, alpha and phrase; a signal of QUALITY"), (3, "nothing")], "doc_id long, text string")
    got = {r["doc_id"]: r["found"] for r in phrases.phrase_recall(texts, ["quality signal phrase alpha beta"]).collect()}
    assert got == {1: 1, 2: 1, 3: 0}


def test_verdict(spark):
    schema = "mode string, passed boolean, phrase_found int, russian_passed boolean"
    check = lambda *rows: tuple(phrases.verdict(spark.createDataFrame(list(rows), schema)).first())
    assert check(("standard", True, 3, False), ("max", True, 3, True)) == (True, True, True)
    assert check(("standard", True, 4, False), ("max", True, 3, False)) == (False, False, False)
    assert check(("max", True, 3, True)) == (False, False, True)


def test_folder_listing(tmp_path):
    for name in ("runtime/a.pdf", "build/b.pdf", "markdown_result_old/c.pdf", "docs/visible.docx", "VISIBLE.PDF", "~$x.docx", "note.txt", ".hidden/d.pdf"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    assert [n for _, n, _, _ in manifest.list_files(str(tmp_path))] == ["d.pdf", "visible.docx", "VISIBLE.PDF"]
    now = dt.datetime(2024, 1, 2, 3, 4)
    assert [manifest.result_folder(str(tmp_path), now).name for _ in range(2)] == ["markdown_result_2024-01-02_03-04", "markdown_result_2024-01-02_03-04_2"]
    assert manifest.latest_result(str(tmp_path)) is not None


def test_unique_names():
    assert manifest.unique_names(["a", "A", "a_2"]) == ["a.md", "A_2.md", "a_2_2.md"]


def test_pictures():
    white, grey = np.full((400, 400), 255, np.uint8), np.tile(np.arange(400) % 256, (400, 1)).astype(np.uint8)
    assert engines.is_blank(white) and not engines.is_blank(grey)
    assert engines.is_candidate(grey) and not engines.is_candidate(grey[:100])
    assert set(np.unique(engines.image_variant(grey, "binary"))) == {0, 255}
    assert engines.image_variant(grey, "contrast_sharp").shape == grey.shape


def test_folder_end_to_end(spark, tmp_path):
    good = "Это хороший текстовый слой страницы документа. " * 12
    (tmp_path / "a.pdf").write_bytes(f"{good}\f{good}".encode())
    (tmp_path / "b.pdf").write_bytes(f"{good}\f ".encode())
    (tmp_path / "c.docx").write_bytes(make_docx(para("Текст документа. " * 40)))
    (tmp_path / "d.docx").write_bytes(b"broken")
    answer = "block_num\tpar_num\tline_num\tconf\ttext\n" + "\n".join(f"1\t1\t{n // 6}\t50\tслово" for n in range(60))
    info = engines.EngineInfo("engine", ("rus", "eng"))
    done = convert_folder(spark, str(tmp_path), S.Settings(), engines.FakePdf, lambda: engines.FakeOcr(answer), info)
    rows = {r["name"]: r for r in done.collect()}
    assert rows["a.pdf"]["doc_type"] == S.TEXT_PDF and rows["a.pdf"]["status"] == S.SUCCESS
    assert rows["b.pdf"]["doc_type"] == S.MIXED and rows["b.pdf"]["ocr_page_count"] == 1 and rows["b.pdf"]["status"] == S.REVIEW
    assert rows["b.pdf"]["page_report"][1]["confidence"] == 50.0 and "Низкая уверенность OCR: 50.0." in rows["b.pdf"]["page_report"][1]["warning"]
    assert rows["c.docx"]["status"] == S.SUCCESS and rows["d.docx"]["status"] == S.ERROR
    top = write_results(done, str(tmp_path), S.Settings(), dt.datetime(2024, 1, 2, 3, 4))
    assert sorted(p.name for p in (top / "01_markdown").iterdir()) == ["a.md", "b.md", "c.md", "d.md"]
    assert sorted(p.name for p in (top / "02_problem_files").iterdir()) == ["b.md", "d.md"]
    assert "- документов обработано: 4" in (top / "REPORT.txt").read_text(encoding="utf-8")
    assert "стр. 2: OCR" in (top / "OCR_REPORT.txt").read_text(encoding="utf-8")
    assert (top / "00_ALL_DOCUMENTS.md").read_text(encoding="utf-8").count("# Документ ") == 4


def test_stream(spark, tmp_path):
    docs = [(n, f"Строка {n}-\nая\nтекст", "ru", "s", 1) for n in range(5)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        follow(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
