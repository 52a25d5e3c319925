"""Text measures, predicates and labels as native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow import settings as S

# Letters are Latin without accents and Russian, by definition.
LETTER = "A-Za-zА-Яа-яЁё"
#: All of them, one by one.
LETTERS = "".join(map(chr, (*range(65, 91), *range(97, 123), *range(0x410, 0x450), 0x401, 0x451)))
BLANK = r"[\s\x1c-\x1f]"


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with ``value`` computed once a row, however often ``of`` uses it; nothing is merged into or pushed through it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def newlines(text: Column) -> Column:
    """All line ends as LF."""
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    # The pattern goes through a whole text, so it is asked only if either end is white.
    ends = lambda t: F.concat(F.left(t, F.lit(1)), F.right(t, F.lit(1)))
    return let(text, lambda t: F.when(ends(t).rlike(f"(?U){BLANK}"), F.regexp_replace(t, rf"(?U)\A{BLANK}+|{BLANK}+\z", "")).otherwise(t))


def _counts(text: Column) -> Column:
    """struct(letters, cyrillic) of a text, by what stays of it without letters; no list of matches is made."""
    rest = F.translate(text, LETTERS, "")
    gone = lambda r: F.length(text) - F.length(r)
    # Latin letters take one byte in UTF-8, Russian letters two.
    return let(rest, lambda r: F.struct(gone(r).alias("letters"), (F.octet_length(text) - F.octet_length(r) - gone(r)).alias("cyrillic")))


def letters(text: Column) -> Column:
    return let(text, lambda t: F.length(t) - F.length(F.translate(t, LETTERS, "")))


def cyrillic(text: Column) -> Column:
    return let(text, lambda t: _counts(t)["cyrillic"])


def _runs(text: Column) -> Column:
    """struct(words, singles): runs of two letters or more, and letters that stand alone."""
    pattern = f"[{LETTER}]{{2,}}"
    known = lambda t, alone: F.struct((F.length(F.regexp_replace(t, pattern, "x")) - F.length(alone)).alias("words"), (F.length(alone) - F.length(F.translate(t, LETTERS, ""))).alias("singles"))
    return let(text, lambda t: let(F.regexp_replace(t, pattern, ""), lambda alone: known(t, alone)))


def words(text: Column) -> Column:
    """Runs of two letters or more."""
    return _runs(text)["words"]


def singles(text: Column) -> Column:
    """Letters that stand alone."""
    return _runs(text)["singles"]


def replacements(text: Column) -> Column:
    """Replacement characters U+FFFD."""
    return let(text, lambda t: F.length(t) - F.length(F.replace(t, F.lit("�"), F.lit(""))))


def _share(counts: Column) -> Column:
    return F.when(counts["letters"] > 0, counts["cyrillic"] / counts["letters"]).otherwise(0.0)


def cyrillic_share(text: Column) -> Column:
    return let(text, lambda t: let(_counts(t), _share))


def single_share(text: Column) -> Column:
    return let(_runs(text), lambda r: r["singles"] / F.greatest(F.lit(1), r["words"] + r["singles"]))


def bad_layer(text: Column) -> Column:
    """Is a PDF text layer made of scattered letters?"""
    latin = lambda c: (c["letters"] >= S.LAYER_MIN_LETTERS) & (_share(c) < S.LAYER_BAD_CYRILLIC)
    return let(text, lambda t: let(_counts(t), latin) & (single_share(t) >= S.LAYER_BAD_SINGLES))


def needs_ocr(text: Column) -> Column:
    """Must a page be recognised, its text layer being too short or bad?"""
    return let(strip(newlines(text)), lambda plain: (F.length(plain) < S.LAYER_MIN_CHARS) | bad_layer(plain))


def bad_russian(text: Column) -> Column:
    """Does recognised text look unlike Russian?"""
    return let(text, lambda t: let(_counts(t), lambda c: (c["letters"] >= S.SCAN_MIN_LETTERS) & (_share(c) < S.SCAN_LOW_CYRILLIC)))


def join_notes(*notes: Column) -> Column:
    """Notes that are not empty, with a blank between them."""
    return F.concat_ws(" ", *[F.nullif(n, F.lit("")) for n in notes])


def _scanned(doc_type: Column) -> Column:
    return doc_type.isin(S.SCAN, S.MIXED)


def quality(text: Column, doc_type: Column) -> Column:
    """struct(status, cyrillic_ratio, replacement_count, warning) of a whole text."""

    def told(m: Column) -> Column:
        warning = F.concat_ws(
            " ",
            F.when(m["count"] > 0, F.format_string("Есть нечитаемые символы: %d.", m["count"])),
            F.when(m["chars"] < S.LOW_TEXT, F.lit("Очень мало текста.")),
            F.when(_scanned(doc_type) & (m["ratio"] < S.SCAN_LOW_CYRILLIC) & (m["letters"] >= S.SCAN_MIN_LETTERS), F.lit("Низкая доля кириллицы для русского скана.")),
        )
        return let(warning, lambda w: F.struct(F.when(w == "", F.lit(S.NORMAL)).otherwise(F.lit(S.CHECK)).alias("status"), m["ratio"].alias("cyrillic_ratio"), m["count"].alias("replacement_count"), w.alias("warning")))

    measured = lambda t: let(_counts(t), lambda c: F.struct(F.length(t).alias("chars"), replacements(t).alias("count"), c["letters"].alias("letters"), F.bround(_share(c), 3).alias("ratio")))
    return let(let(text, measured), told)


def page_warning(text: Column, source: Column, confidence: Column, require_confidence: bool = False) -> Column:
    """What a reviewer should know of a page; empty if nothing."""
    ocr = source == "ocr"

    def told(plain: Column) -> Column:
        missing = ocr & F.lit(require_confidence) & (plain != "") & confidence.isNull()
        strange = let(_counts(plain), lambda c: (c["letters"] >= S.PAGE_MIN_LETTERS) & (_share(c) < S.SCAN_LOW_CYRILLIC))
        return F.concat_ws(
            " ",
            F.when(plain == "", F.lit("Текст не извлечен.")).when(F.length(plain) < S.LAYER_MIN_CHARS, F.lit("Мало текста.")),
            F.when(missing, F.lit("Уверенность OCR не получена.")).when(confidence < S.REVIEW_CONFIDENCE, F.format_string("Низкая уверенность OCR: %.1f.", confidence)),
            let(replacements(plain), lambda n: F.when(n > 0, F.format_string("Нечитаемые символы: %d.", n))),
            F.when(ocr, F.when(strange, F.lit("Низкая доля кириллицы после OCR."))),
        )

    return let(strip(newlines(text)), told)


def docx_text(text: Column) -> Column:
    """Text of a DOCX run: blanks squeezed, none around line ends."""
    squeezed = F.regexp_replace(newlines(text), r"[ \t]+", " ")
    return strip(F.regexp_replace(squeezed, r" *\n *", "\n"))


def table_cell(text: Column) -> Column:
    return F.replace(F.replace(docx_text(text), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" / "))


def page_markdown(index: Column, text: Column, page_breaks: bool = False) -> Column:
    """A page under its heading."""
    rule = "---\n\n" if page_breaks else ""
    return strip(F.concat(F.lit(f"{rule}## Страница "), index.cast("string"), F.lit("\n\n"), strip(text)))


def page_number(markdown: Column) -> Column:
    """The page number that a heading tells, or 0."""
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(markdown, r"## Страница ([0-9]+)", 1), F.lit("")), F.lit("9999999999")).cast("int"), F.lit(0))


def file_safe(name: Column, runs: bool = False) -> Column:
    """A name without characters that file systems refuse, and without blanks and dots at its ends."""
    bad = r'[<>:"/\\|?*\x00-\x1F]' + ("+" if runs else "")
    return F.regexp_replace(F.regexp_replace(name, bad, "_"), r"\A[ .]+|[ .]+\z", "")


def match_form(text: Column) -> Column:
    """Upper case, letters and digits only, single blanks."""
    return F.trim(F.regexp_replace(F.upper(text), f"[^0-9{LETTER}]+", " "))


def phrase_present(matched_text: Column, phrase: Column) -> Column:
    """Does a text (in match form) hold a phrase, or at least all its words of four letters or more?"""
    form = match_form(phrase)
    long_words = F.filter(F.split(form, " "), lambda w: F.length(w) >= 4)
    return F.contains(matched_text, form) | ((F.size(long_words) > 0) & F.forall(long_words, lambda w: F.contains(matched_text, w)))


def optional_int(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("не определено"))


def optional_float(value: Column, missing: str = "нет данных") -> Column:
    return F.when(value.isNull(), F.lit(missing)).otherwise(F.format_string("%.1f", value))


def duration(start: Column, end: Column) -> Column:
    """Whole seconds between two instants, as minutes and seconds."""
    seconds = F.greatest(F.lit(0), (F.unix_timestamp(end) - F.unix_timestamp(start)).cast("int"))
    minutes = F.floor(seconds / 60).cast("int")
    return F.when(minutes > 0, F.format_string("%d мин %d сек", minutes, seconds % 60)).otherwise(F.format_string("%d сек", seconds))


def source_label(source: Column) -> Column:
    out = None
    for key, label in S.SOURCE_LABELS.items():
        out = F.when(source == key, F.lit(label)) if out is None else out.when(source == key, F.lit(label))
    return out.otherwise(source)


def entry_place(entry: Column) -> Column:
    return F.when(entry["source"] == "docx-image", F.format_string("изображение %d", entry["page_index"])).otherwise(F.format_string("стр. %d", entry["page_index"]))


def entry_details(entry: Column) -> Column:
    """How a page was recognised."""
    dpi = F.when(entry["source"] == "docx-image", F.lit("исходное изображение")).otherwise(optional_int(entry["dpi"]))
    none = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("нет"))
    told = F.concat(
        F.lit("уверенность: "), optional_float(entry["confidence"]), F.lit(", dpi: "), dpi, F.lit(", psm: "), optional_int(entry["psm"]),
        F.lit(", вариант: "), none(entry["variant"]), F.lit(", попыток: "), entry["attempt_count"].cast("string"), F.lit(", выбор: "), none(entry["selected_reason"]),
    )
    return F.when(entry["source"].isin("ocr", "docx-image"), told).otherwise(F.lit("OCR детали: нет"))
