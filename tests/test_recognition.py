"""The search over attempts, its limits, and the pictures that it prepares."""

import itertools
import random
from pathlib import Path

import numpy as np
import pytest

from folioflow import settings as S
from folioflow.operators import ocr
from folioflow.plans.convert import convert_folder, convert_pages
from folioflow.sources import engines, recognition

HEAD = "level\tblock_num\tpar_num\tline_num\tconf\ttext"


def made_up(seed):
    """An answer to every attempt at one picture: (text, confidence)."""
    rnd = random.Random(seed)
    words = ["слово", "word", "a", "и", "x�", "done."]
    answers = {}
    for key in itertools.product((300, 250, 216), ("gray", "contrast_sharp", "binary"), (6, 4, 11)):
        text = " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 3, 90, 120])))
        answers[key] = text, rnd.choice([None, 40.0, 88.0, 95.5])
    return answers


def searched(answers, settings):
    drawn, calls = [], []

    def pictures():
        for dpi in settings.dpi:
            drawn.append(dpi)
            yield dpi, dpi

    def judge(shown, dpi, variant, psm):
        calls.append((dpi, variant, psm))
        text, sure = answers[dpi, variant, psm]
        return recognition.Attempt(text, sure, dpi, variant, psm, recognition.score_of(text, sure, psm))

    found, made = recognition.search(pictures(), lambda picture, variant: picture, judge, settings)
    assert made == len(calls) and len(drawn) == -(-made // 9)  # no resolution is drawn before its turn
    return found, made


def test_the_search_chooses_what_the_window_over_all_attempts_chooses(spark):
    settings, rows, expected = S.Settings(), [], {}
    for page in range(150):
        answers = made_up(page)
        rows += [(page, n, text, sure, psm) for n, ((_, _, psm), (text, sure)) in enumerate(answers.items(), 1)]
        found, made = searched(answers, settings)
        expected[page] = (found.text, found.confidence, found.psm, found.score, made)
    tried = spark.createDataFrame(rows, "page int, attempt_no int, text string, confidence double, psm int")
    got = {r["page"]: (r["text"], r["confidence"], r["psm"], r["score"], r["attempt_count"]) for r in ocr.best_attempts(ocr.scored(tried), ["page"], 9).collect()}
    assert got == expected
    made = {m for *_, m in expected.values()}
    assert {9, 27} <= made and len(made) > 5


def test_lines_of_a_table_are_those_of_the_column_form(spark):
    rnd = random.Random(4)
    tables = ["", "no\theader", HEAD]
    for _ in range(200):
        cells = lambda: "\t".join(["5", *(str(rnd.randint(1, 2)) for _ in range(3)), rnd.choice(["90", "-1", "x", "nan", " 7.25 ", "", "1e1"]), rnd.choice(["word", " ", "б.", "two words"])])
        tables.append(rnd.choice(["\n", "\r\n"]).join([HEAD, *(cells() for _ in range(rnd.randint(0, 9))), "short"]))
    rows = spark.createDataFrame(list(enumerate(tables)), "doc_id long, tsv string")
    got = {r["doc_id"]: (r["text"], r["confidence"]) for r in ocr.recognised_text(ocr.word_table(rows, ["doc_id"]), ["doc_id"]).collect()}
    assert {k: got.get(k, ("", None)) for k in range(len(tables))} == {k: recognition.lines_of(t) for k, t in enumerate(tables)}


def counting():
    """A class of its own in each test, so that workers get it by value."""

    class Counting:
        """Writes down what it is asked, by a file of its own a document, since workers share no memory."""

        def __init__(self, folder, table="", plain=""):
            self.folder, self.answer, self.plain = Path(folder), table, plain

        def note(self, what):
            with (self.folder / "notes").open("a") as out:
                out.write(f"{what}\n")

        def table(self, image, psm):
            self.note("table")
            return self.answer

        def text(self, image, psm):
            self.note("text")
            return self.plain

        def opened(self, content):
            self.note("opened")
            return self

        def page_texts(self, content):
            return content.decode().split("\f")

        def render(self, page, dpi):
            self.note(f"render {dpi}")
            return np.zeros((10, 10), dtype=np.uint8)

        def close(self):
            self.note("closed")

    return Counting


def recognised(spark, folder, pages, settings, **answers):
    kind = counting()
    files = spark.createDataFrame([(d, bytearray(b"x")) for d in {d for d, _ in pages}], "doc_id long, content binary")
    rows = recognition.recognise(files, spark.createDataFrame(pages, "doc_id long, page_index int"), lambda: kind(folder), lambda: kind(folder, **answers), settings).collect()
    return rows, (folder / "notes").read_text().split("\n")[:-1]


def sure_table(confidence):
    return "\n".join([HEAD, *(f"5\t1\t1\t{n // 6}\t{confidence}\tслово" for n in range(90))])


@pytest.mark.parametrize("confidence, calls, resolutions", [(95, 9, ["render 300"]), (50, 27, ["render 300", "render 250", "render 216"])])
def test_a_good_attempt_saves_calls_and_pictures(spark, tmp_path, confidence, calls, resolutions):
    rows, notes = recognised(spark, tmp_path, [(1, 1)], S.Settings(), table=sure_table(confidence))
    assert notes.count("table") == calls and [n for n in notes if n.startswith("render")] == resolutions
    assert [(r["attempt_count"], r["confidence"], r["psm"], r["variant"], r["dpi"]) for r in rows] == [(calls, confidence, 6, "gray", 300)]


def test_standard_quality_asks_for_text_alone(spark, tmp_path):
    rows, notes = recognised(spark, tmp_path, [(1, 1)], S.Settings(quality_mode="standard"), table=sure_table(99), plain="plain text")
    assert notes.count("text") == 1 and notes.count("table") == 0 and [(r["text"], r["confidence"]) for r in rows] == [("plain text", None)]


def test_a_document_is_opened_once_a_group_and_has_no_more_groups_than_workers(spark, tmp_path):
    rows, notes = recognised(spark, tmp_path, [(1, p) for p in range(1, 12)] + [(2, 5)], S.Settings(quality_mode="standard", max_ocr_workers=3), plain="text")
    assert len(rows) == 12 and notes.count("opened") == notes.count("closed") == 3 + 1


def test_what_fails_is_told_and_stops_nothing(spark):
    class BrittlePdf:
        """The first page renders at 300 dpi only, the second not at all, the third is white."""

        def render(self, content, page, dpi):
            if page == 2 or dpi != 300:
                raise ValueError("no picture")
            return np.full((10, 10), 255 * (page == 3), dtype=np.uint8)

        def opened(self, content):
            if content == b"broken":
                raise OSError("cannot be opened")
            return engines.OpenedEachTime(self, content)

    class BrittleOcr:
        def table(self, image, psm):
            raise TimeoutError("too long" if psm == 6 else "")

        def text(self, image, psm):
            return "text"

    files = spark.createDataFrame([(1, bytearray(b"x")), (2, bytearray(b"broken"))], "doc_id long, content binary")
    poor = [(1, p, " ") for p in (1, 2, 3)] + [(2, 7, "")]
    rows = recognition.recognise(files, spark.createDataFrame(poor, "doc_id long, page_index int, t string"), BrittlePdf, BrittleOcr, S.Settings()).collect()
    told = {(r["doc_id"], r["page_index"]): (r["blank"], r["attempt_count"], r["score"], r["attempt_warning"]) for r in rows}
    assert told == {(1, 1): (False, 9, 0.0, "too long"), (1, 2): (False, 0, 0.0, "OCR page render failed: 2"), (1, 3): (True, 0, 0.0, ""), (2, 7): (False, 0, 0.0, "cannot be opened")}
    pages = spark.createDataFrame(poor, "doc_id long, page_index int, page_text string")
    report = {r["doc_id"]: r["page_report"] for r in convert_pages(files, pages, BrittlePdf, BrittleOcr, S.Settings()).collect()}
    assert report[1][0]["warning"].endswith("too long") and report[1][1]["warning"].endswith("render failed: 2") and report[1][2]["source"] == "blank"


def test_a_missing_language_sends_scans_to_other_converters(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b" ")
    table = sure_table(95)
    done = lambda languages: convert_folder(
        spark, str(tmp_path), S.Settings(), engines.FakePdf, lambda: engines.FakeOcr(table), engines.EngineInfo("engine", languages), engines.FakePictures, lambda *a: "other " * 100
    ).first()
    assert done(("rus", "eng"))["method"] == S.PAGEWISE
    r = done(("eng",))
    assert r["method"] == "Docling OCR" and "rus" in r["warning"]


def plain_contrast(image):
    """Cut one pixel in a hundred at either end, grey by grey, and stretch."""
    counts = [int((image == g).sum()) for g in range(256)]
    for order in (range(256), range(255, -1, -1)):
        left = image.size * 1 // 100
        for g in order:
            taken = min(left, counts[g])
            counts[g] -= taken
            left -= taken
            if not left:
                break
    kept = [g for g in range(256) if counts[g]]
    if not kept or kept[0] == kept[-1]:
        return image.astype(int)
    scale = 255 / (kept[-1] - kept[0])
    return np.array([[min(255, max(0, int(int(v) * scale - kept[0] * scale))) for v in row] for row in image])


@pytest.mark.parametrize("seed", range(6))
def test_variants_equal_plain_loops(seed):
    rnd = np.random.default_rng(seed)
    image = [rnd.integers(0, 256, (23, 31)), rnd.normal(120, 20, (40, 17)).clip(0, 255), rnd.integers(90, 92, (9, 9)), np.full((5, 5), 7), rnd.integers(0, 2, (3, 3)) * 255, rnd.integers(0, 256, (2, 9))][seed].astype(np.uint8)
    stretched = plain_contrast(image)
    sharp = stretched.copy()
    for y in range(1, image.shape[0] - 1):
        for x in range(1, image.shape[1] - 1):
            around = sum(int(stretched[y + i, x + j]) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j)
            sharp[y, x] = min(255, max(0, int(np.floor((32 * int(stretched[y, x]) - 2 * around) / 16 + 0.5))))
    assert (engines.image_variant(image, "gray") == image).all()
    assert (engines.image_variant(image, "contrast_sharp") == sharp).all()
    assert (engines.image_variant(image, "binary") == np.where(stretched > 180, 255, 0)).all()
