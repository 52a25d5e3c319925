"""Pictures in DOCX files, other converters and text mode take effect in the conversion of a folder."""

from folioflow import settings as S
from folioflow.plans.convert import convert_folder
from folioflow.sources import engines
from tests.test_documents import make_docx, para

INFO = engines.EngineInfo("engine", ("rus", "eng"))
PICTURE = '<w:p><w:blip r:embed="rId1"/></w:p>'
TABLE = "block_num\tpar_num\tline_num\tconf\ttext\n" + "\n".join(f"1\t1\t{n // 6}\t90\tслово" for n in range(60))


def convert(spark, path, recogniser=None, converter=engines.third_party_markdown):
    info = INFO if recogniser else engines.EngineInfo()
    done = convert_folder(spark, str(path), S.Settings(), engines.FakePdf, recogniser, info, engines.FakePictures, converter)
    return {r["name"]: r for r in done.collect()}


def test_text_of_pictures_is_part_of_the_document(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(make_docx(para("Текст документа. ") + PICTURE, picture=True))
    (tmp_path / "b.docx").write_bytes(make_docx(PICTURE, picture=True))
    rows = convert(spark, tmp_path, lambda: engines.FakeOcr(TABLE))
    for name in ("a.docx", "b.docx"):
        r = rows[name]
        assert "### Изображение 1" in r["clean_markdown"] and "слово слово" in r["clean_markdown"] and r["error"] == ""
        assert r["docx_image_ocr_count"] == 1 and r["method"] == S.DOCX_METHOD
        entry = r["page_report"][0]
        assert (entry["source"], entry["confidence"], entry["attempt_count"], entry["dpi"]) == ("docx-image", 90.0, 9, None)


def test_the_next_converter_is_tried(spark, tmp_path):
    good = "Это хороший текстовый слой страницы документа. " * 12
    (tmp_path / "a.pdf").write_bytes(good.encode())
    (tmp_path / "b.docx").write_bytes(b"broken")
    (tmp_path / "c.pdf").write_bytes(b"")
    (tmp_path / "d.pdf").write_bytes(b"few words")
    answers = {"markitdown": {b"broken": good, b"": good}, "docling": {b"broken": "wrong"}}

    def fake(content, name, engine):
        if content == b"" and engine == "docling":
            raise engines.EngineMissing(engine)
        return answers[engine].get(content, " ")

    rows = convert(spark, tmp_path, converter=fake)
    assert {n: r["method"] for n, r in rows.items()} == {"a.pdf": S.LAYER_METHOD, "b.docx": "MarkItDown", "c.pdf": "MarkItDown", "d.pdf": S.LAYER_METHOD}
    assert all(r["error"] == "" for r in rows.values())
    rows = convert(spark, tmp_path, converter=lambda content, name, engine: "")
    assert rows["b.docx"]["status"] == S.ERROR and "MarkItDown: пустой результат; Docling: пустой результат" in rows["b.docx"]["error"]


def test_text_mode_where_the_table_has_no_words(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b" ")
    rows = convert(spark, tmp_path, lambda: engines.FakeOcr("block_num\tpar_num\tline_num\tconf\ttext\n", "слово " * 100))
    assert rows["a.pdf"]["method"] == S.PAGEWISE and rows["a.pdf"]["char_count"] > 500
