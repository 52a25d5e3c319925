"""Whole reports as files, numbered lines, and sinks that leave nothing half written."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from folioflow import settings as S
from folioflow.operators import reports
from folioflow.plans.convert import convert_folder, write_results
from folioflow.sources import engines, sinks
from tests.test_documents import make_docx, para


def test_numbers_are_prefix_sums(spark, monkeypatch):
    monkeypatch.setattr(reports, "COUNTED_TOGETHER", 8)
    rnd = random.Random(1)
    blocks = [(s, d, [f"{s}.{d}.{i}" for i in range(rnd.randint(0, 3))]) for s in (0, 1, 3) for d in range(60)]
    rows = spark.createDataFrame(rnd.sample(blocks, len(blocks)), "section int, doc_index long, lines array<string>").repartition(5)
    got = sorted((r["line_no"], r["line"]) for r in reports.numbered(rows).collect())
    assert got == list(enumerate([line for *_, lines in blocks for line in lines], 1))


def test_lines_of_many_tasks_are_one_file_in_order(spark, tmp_path):
    rows = spark.range(5000).select((5000 - F.col("id")).alias("line_no"), F.concat(F.lit("строка "), 5000 - F.col("id")).alias("line")).repartition(7)
    sinks.write_lines(rows, f"{tmp_path}/all.txt")
    assert (tmp_path / "all.txt").read_text(encoding="utf-8").splitlines() == [f"строка {n}" for n in range(1, 5001)]
    sinks.write_lines(rows.limit(0), f"{tmp_path}/none.txt")
    assert (tmp_path / "none.txt").read_text() == "" and {p.name for p in tmp_path.iterdir()} == {"all.txt", "none.txt"}


def test_a_failing_task_leaves_nothing_behind(spark, tmp_path):
    bad = spark.range(100).repartition(4).withColumn("line", F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise("x"))
    (tmp_path / "files").mkdir()
    with pytest.raises(Exception, match="lost"):
        sinks.write_lines(bad.select(F.col("id").alias("line_no"), "line"), f"{tmp_path}/all.txt")
    with pytest.raises(Exception, match="lost"):
        sinks.write_files(bad.select(F.concat(F.lit("f"), "id").alias("name"), F.col("line").alias("text")), f"{tmp_path}/files")
    assert [p.name for p in tmp_path.rglob("*")] == ["files"]


def test_reports_of_a_folder(spark, tmp_path):
    good = "Это хороший текстовый слой страницы документа. " * 12
    (tmp_path / "a.pdf").write_bytes(f"{good}\f{good}".encode())
    (tmp_path / "b.pdf").write_bytes(f"{good}\f ".encode())
    (tmp_path / "c.docx").write_bytes(make_docx(para("Текст документа. " * 40)))
    answer = "block_num\tpar_num\tline_num\tconf\ttext\n" + "\n".join(f"1\t1\t{n // 6}\t50\tслово" for n in range(60))
    info = engines.EngineInfo("engine", ("rus", "eng"), "/data", "5.0")
    done = convert_folder(spark, str(tmp_path), S.Settings(), engines.FakePdf, lambda: engines.FakeOcr(answer), info)
    began = dt.datetime(2024, 1, 2, 3, 4, 5)
    top = write_results(done, str(tmp_path), S.Settings(), began, info, began + dt.timedelta(seconds=59))
    run = (top / "REPORT.txt").read_text(encoding="utf-8").split("\n")
    assert run[:8] == [reports.TITLE, "", "Создан: 2024-01-02 03:05:04", f"Исходная папка: {tmp_path}", f"Папка результата: {top}", "Время обработки: 59 сек", "", "Итог:"]
    assert "- Tesseract OCR: найден, версия 5.0 (rus, eng)" in run and "- tessdata: /data" in run and "- средняя уверенность OCR: 50.0" in run
    at = run.index("2. b.pdf")
    assert run[at - 1] == "" and run[at + 5 : at + 10] == ["   Страниц: 2", "   OCR страниц: 1", "   Изображений DOCX распознано OCR: 0", "   Текстовый слой: 1", "   Пустые страницы: 0"]
    assert run[at + 12] == "   Средняя уверенность OCR: 50.0" and run[-2] == "   Ошибка: нет" and run[-1] == ""
    ocr = (top / "OCR_REPORT.txt").read_text(encoding="utf-8").split("\n")
    assert ocr[:3] == [reports.OCR_TITLE, "", "Создан: 2024-01-02 03:05:04"] and ocr[5] == "Страницы и изображения для ручной проверки:"
    assert ocr[6] == "- b.pdf, стр. 2: Низкая уверенность OCR: 50.0." and ocr[7:9] == ["", "Файл: b.pdf"]
    assert sum(line.startswith("Файл: ") for line in ocr) == 1 and any(line.startswith("- стр. 2: OCR, символов: ") for line in ocr)
