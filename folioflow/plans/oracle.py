"""DuckDB SQL with the same rows as the registered queries, written independently of the Spark plans."""

from __future__ import annotations

L, C = "A-Za-zА-Яа-яЁё", "А-Яа-яЁё"


def _n(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def _letters(t: str) -> str:
    return _n(t, f"[{L}]")


def _cyr(t: str) -> str:
    return f"(CASE WHEN {_letters(t)} > 0 THEN {_n(t, f'[{C}]')} / {_letters(t)} ELSE 0.0 END)"


def _runs(t: str, test: str) -> str:
    return f"len(list_filter(regexp_extract_all({t}, '[{L}]+'), lambda x: length(x) {test}))"


def _strip(t: str) -> str:
    return rf"regexp_replace({t}, '^\s+|\s+$', '', 'g')"


def _tidy(t: str) -> str:
    t = f"replace(replace({t}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    return _strip(rf"regexp_replace(regexp_replace({t}, '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g')")


def _single(t: str) -> str:
    return f"({_runs(t, '= 1')} / greatest(1, len(regexp_extract_all({t}, '[{L}]+'))))"


def _bad(t: str) -> str:
    return f"({_letters(t)} >= 60 AND {_single(t)} >= 0.65 AND {_cyr(t)} < 0.25)"


def _repl(t: str) -> str:
    return f"(length({t}) - length(replace({t}, '�', '')))"


ALTERED = r"""a AS (SELECT doc_id, lang, CASE WHEN doc_id % 3 = 0 THEN translate(text, 'abcdefghijklmnopqrstuvwxyz', 'абцдефгхижклмнопярстувщызэ') ELSE text END AS text FROM documents),
b AS (SELECT doc_id, lang, CASE WHEN doc_id % 7 = 0 THEN regexp_replace(text, '(.)', '\1 ', 'g') ELSE text END AS text FROM a),
d AS (SELECT doc_id, lang, CASE WHEN doc_id % 11 = 0 THEN replace(text, 'e', '�') ELSE text END AS text FROM b)"""
PAGES = """l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM d),
p AS (SELECT doc_id, i AS page_index, array_to_string(list_slice(lines, (i - 1) * 8 + 1, i * 8), chr(10)) AS page_text FROM (SELECT doc_id, lines, unnest(range(1, (len(lines) + 7) // 8 + 1)) AS i FROM l))"""
MARKED = """m1 AS (SELECT doc_id, replace(text, 'tion', 'ti-' || chr(10) || 'on') AS text FROM documents),
m2 AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN replace(text, '. ', '.' || chr(10) || chr(10) || 'стр. 12' || chr(10)) ELSE text END AS text FROM m1),
m AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN replace(text, ', ', chr(10) || '- ') ELSE text END AS text FROM m2)"""
KIND = "CASE doc_id % 4 WHEN 0 THEN 'DOCX' WHEN 1 THEN 'PDF-скан' WHEN 2 THEN 'PDF смешанный' ELSE 'PDF с текстом' END"
NEED = f"(length(st) < 40 OR {_bad('st')})"
SURE = "CASE WHEN (doc_id + page_index) % 10 <> 0 THEN ((doc_id * 31 + page_index * 17) % 101)::DOUBLE END"
NOTE = f"""concat_ws(' ', CASE WHEN st = '' THEN 'Текст не извлечен.' WHEN length(st) < 40 THEN 'Мало текста.' END,
 CASE WHEN {{strict}} AND st <> '' AND sure IS NULL THEN 'Уверенность OCR не получена.' WHEN sure < 65 THEN 'Низкая уверенность OCR: ' || printf('%.1f', sure) || '.' END,
 CASE WHEN {_repl('st')} > 0 THEN 'Нечитаемые символы: ' || {_repl('st')} || '.' END,
 CASE WHEN {{ocr}} AND {_letters('st')} >= 100 AND {_cyr('st')} < 0.35 THEN 'Низкая доля кириллицы после OCR.' END)"""
STATUS = f"""{ALTERED}, {PAGES},
pk AS (SELECT doc_id, page_index, {_strip('page_text')} AS st FROM p),
dec AS (SELECT *, {NEED} AS need FROM pk),
ent AS (SELECT doc_id, page_index, st, need, CASE WHEN NOT need THEN 'text' WHEN st = '' THEN 'blank' ELSE 'ocr' END AS src, CASE WHEN need THEN {SURE} END AS sure FROM dec),
noted AS (SELECT *, CASE WHEN src = 'blank' THEN 'Страница похожа на пустую.' ELSE {NOTE.format(strict='FALSE', ocr="src = 'ocr'")} END AS note,
 CASE WHEN st = '' THEN '## Страница ' || page_index ELSE '## Страница ' || page_index || chr(10) || chr(10) || st END AS md FROM ent),
kinds AS (SELECT doc_id, count(*) AS page_count, CASE WHEN count_if(need) = count(*) THEN 'PDF-скан' WHEN count_if(need) > 0 THEN 'PDF смешанный' ELSE 'PDF с текстом' END AS doc_type FROM ent GROUP BY doc_id),
e AS (SELECT n.* FROM noted n JOIN kinds k USING (doc_id) WHERE k.doc_type <> 'PDF с текстом'),
per AS (SELECT doc_id, count_if(note <> '') AS reviews, count_if(src = 'text') AS tp, count_if(src = 'ocr') AS op, count_if(src = 'blank') AS bp, sum(CASE WHEN src = 'ocr' THEN sure END) AS ssum, count(CASE WHEN src = 'ocr' THEN sure END) AS sn FROM e GROUP BY doc_id),
txt AS (SELECT doc_id, string_agg(md, chr(10) || chr(10) ORDER BY page_index) AS text FROM noted GROUP BY doc_id),
r0 AS (SELECT k.doc_id, k.doc_type, k.page_count, t.text, coalesce(reviews, 0) AS reviews, coalesce(tp, 0) AS tp, coalesce(op, 0) AS op, coalesce(bp, 0) AS bp, coalesce(ssum, 0) AS ssum, coalesce(sn, 0) AS sn,
 k.doc_type IN ('PDF-скан', 'PDF смешанный') AS scanned, {_letters('t.text')} AS nl, {_cyr('t.text')} AS cy, {_repl('t.text')} AS rp FROM kinds k JOIN txt t USING (doc_id) LEFT JOIN per USING (doc_id)),
r1 AS (SELECT *, concat_ws(' ', CASE WHEN rp > 0 THEN 'Есть нечитаемые символы: ' || rp || '.' END, CASE WHEN length(text) < 400 THEN 'Очень мало текста.' END,
 CASE WHEN scanned AND round_even(cy, 3) < 0.35 AND nl >= 200 THEN 'Низкая доля кириллицы для русского скана.' END) AS qw, scanned AND nl >= 200 AND cy < 0.35 AS bad FROM r0),
r AS (SELECT *, CASE WHEN qw = '' THEN 'норма' ELSE 'проверить' END AS quality_status,
 CASE WHEN reviews > 0 OR length(text) < 400 OR bad OR qw <> '' THEN 'требует проверки' ELSE 'успешно' END AS status,
 concat_ws(' ', CASE WHEN length(text) < 400 THEN 'Мало извлечённого текста, нужно проверить вручную.' WHEN reviews > 0 THEN 'Есть элементы OCR для ручной проверки: ' || reviews || '.' END,
 CASE WHEN bad THEN 'Похоже на слабое распознавание русского текста.' END, nullif(qw, '')) AS warning,
 CASE WHEN scanned THEN 'Постранично: текст+OCR' ELSE 'PDFium text' END AS method FROM r1)"""
MATRIX = """mx AS (SELECT row_number() OVER (ORDER BY di, vi, pi) AS attempt_no, dpi, vi, psm FROM (VALUES (1, 300), (2, 250), (3, 216)) x(di, dpi), (VALUES (1), (2), (3)) y(vi), (VALUES (1, 6), (2, 4), (3, 11)) z(pi, psm))"""
ATTEMPT_SURE = "((doc_id * 31 + dpi * 7 + psm * 13 + vi * 17) % 101)::DOUBLE"
_PHRASES = ("the that", "and the of", "mit license", "tionre thand", "quality of des", "ing")


def _present(phrase: str) -> str:
    form = phrase.upper()
    words = [w for w in form.split() if len(w) >= 4]
    every = " AND ".join(f"contains(f, '{w}')" for w in words)
    return f"(contains(f, '{form}')" + (f" OR ({every}))" if every else ")")


_FOLD = r"""list_reduce(list_prepend({'o': []::VARCHAR[], 'p': ''}, list_transform(k, lambda x: {'o': []::VARCHAR[], 'p': x})), lambda s, x:
 CASE WHEN x.p = '' THEN {'o': CASE WHEN len(s.o || CASE WHEN s.p <> '' THEN [s.p] ELSE []::VARCHAR[] END) > 0 AND list_extract(s.o || CASE WHEN s.p <> '' THEN [s.p] ELSE []::VARCHAR[] END, -1) <> ''
   THEN s.o || CASE WHEN s.p <> '' THEN [s.p] ELSE []::VARCHAR[] END || [''] ELSE s.o || CASE WHEN s.p <> '' THEN [s.p] ELSE []::VARCHAR[] END END, 'p': ''}
 WHEN STRUCT(x.p) THEN {'o': s.o || CASE WHEN s.p <> '' THEN [s.p] ELSE []::VARCHAR[] END || [x.p], 'p': ''}
 WHEN s.p <> '' AND NOT STRUCT(s.p) AND NOT regexp_matches(s.p, '[.!?:;»"]$') AND NOT (regexp_matches(x.p, '^\p{Lu}') AND length(s.p) > 80) THEN {'o': s.o, 'p': s.p || ' ' || x.p}
 ELSE {'o': s.o || CASE WHEN s.p <> '' THEN [s.p] ELSE []::VARCHAR[] END, 'p': x.p} END)"""
_STRUCTURAL = r"regexp_matches({}, '^([#>|]|[-*+]\s|[0-9]+[.)]\s|-{{3,}}$)')"
FOLD = _FOLD.replace("STRUCT(x.p)", _STRUCTURAL.format("x.p")).replace("STRUCT(s.p)", _STRUCTURAL.format("s.p"))
HYPHEN = r"regexp_replace(regexp_replace(text, '([\pL\pN_])-\n([\pL\pN_])', '\1\2', 'g'), '([\pL\pN_])-\n([\pL\pN_])', '\1\2', 'g')"
_WORDS = r"w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM documents))"

BEST = f"""WITH {ALTERED}, {MATRIX}, w AS (SELECT doc_id, {_strip("replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))")} AS st FROM d),
o AS MATERIALIZED (SELECT doc_id, length(st) AS n, {_runs('st', '>= 2')} AS w, {_cyr('st')} AS c, {_repl('st')} AS r, {_single('st')} AS g FROM w),
t AS (SELECT *, {ATTEMPT_SURE} AS sure, CASE psm WHEN 6 THEN 8.0::DOUBLE WHEN 4 THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS bonus, (doc_id + attempt_no) % 5 = 0 OR n = 0 AS empty FROM o, mx),
s AS (SELECT doc_id, attempt_no, sure, CASE WHEN empty THEN 0 ELSE n END AS n, round_even(CASE WHEN empty THEN 0.0::DOUBLE ELSE round_even(least(n, 2500) * 0.03::DOUBLE + w * 0.8::DOUBLE + sure * 2.0::DOUBLE + c * 35.0::DOUBLE - r * 8.0::DOUBLE - g * 40.0::DOUBLE, 3) END + bonus, 3) AS score FROM t),
g AS (SELECT *, coalesce(max(score) OVER (PARTITION BY doc_id ORDER BY attempt_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1e9) AS before FROM s),
bs AS (SELECT doc_id, attempt_no, max(CASE WHEN score > before THEN attempt_no END) OVER (PARTITION BY doc_id ORDER BY attempt_no) AS best FROM g),
j AS (SELECT bs.doc_id, bs.attempt_no, bs.best, s.sure, s.n, s.score FROM bs JOIN s ON s.doc_id = bs.doc_id AND s.attempt_no = bs.best),
e AS (SELECT doc_id, coalesce(min(CASE WHEN attempt_no >= 9 AND sure >= 88 AND n >= 400 THEN attempt_no END), 27) AS attempt_count FROM j GROUP BY doc_id)
SELECT e.doc_id, j.best AS attempt_no, e.attempt_count, floor(j.score * 100 + 0.5)::BIGINT AS hundredths FROM e JOIN j ON j.doc_id = e.doc_id AND j.attempt_no = e.attempt_count"""

GREYS = """b AS (SELECT doc_id, ('0x' || unnest(regexp_extract_all(hex(encode(text)), '..')))::INT AS v FROM documents),
q AS (SELECT doc_id, CASE WHEN v < doc_id * 7 % 128 THEN v ELSE 255 END AS grey, 16 * count(*) AS n FROM b GROUP BY ALL),
z AS (SELECT doc_id, 320 * ((octet_length(encode(text)) + 19) // 20) AS total, 16 * octet_length(encode(text)) AS filled FROM documents),
y AS (SELECT doc_id, grey, sum(n)::BIGINT AS n FROM (SELECT * FROM q UNION ALL SELECT doc_id, 255, total - filled FROM z) GROUP BY ALL HAVING sum(n) > 0)"""

SQL: dict[str, str] = {
    "text_quality": f"""WITH {ALTERED}, q AS (SELECT lang, text, concat_ws(' ', CASE WHEN {_repl('text')} > 0 THEN 'Есть нечитаемые символы: ' || {_repl('text')} || '.' END, CASE WHEN length(text) < 400 THEN 'Очень мало текста.' END,
 CASE WHEN {KIND} IN ('PDF-скан', 'PDF смешанный') AND round_even({_cyr('text')}, 3) < 0.35 AND {_letters('text')} >= 200 THEN 'Низкая доля кириллицы для русского скана.' END) AS warning FROM d)
SELECT lang, CASE WHEN warning = '' THEN 'норма' ELSE 'проверить' END AS quality_status, warning, count(*) AS documents, sum(length(text))::BIGINT AS chars FROM q GROUP BY ALL""",
    "letter_stats": f"""WITH {ALTERED} SELECT doc_id, {_letters('text')} AS letters, {_n('text', f'[{C}]')} AS cyrillic, {_runs('text', '>= 2')} AS words, {_runs('text', '= 1')} AS singles, {_repl('text')} AS replacements FROM d""",
    "page_ocr_decision": f"""WITH {ALTERED}, {PAGES}, s AS (SELECT doc_id, page_index, {_strip('page_text')} AS st FROM p) SELECT doc_id, page_index, {NEED} AS needs_ocr, {_bad('st')} AS bad_layer FROM s""",
    "doc_type": f"""WITH {ALTERED}, {PAGES}, s AS (SELECT doc_id, {_strip('page_text')} AS st FROM p), c AS (SELECT doc_id, count(*) AS n, count_if({NEED}) AS o FROM s GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.doc_id % 13 = 0 THEN 'DOCX' WHEN d.doc_id % 17 = 0 THEN 'ODT' WHEN n IS NULL OR n = o THEN 'PDF-скан' WHEN o > 0 THEN 'PDF смешанный' ELSE 'PDF с текстом' END AS doc_type, n AS page_count FROM d LEFT JOIN c USING (doc_id)""",
    "page_warnings": f"""WITH {ALTERED}, {PAGES}, s AS (SELECT doc_id, page_index, {_strip('page_text')} AS st, {SURE} AS sure FROM p) SELECT doc_id, page_index, {NOTE.format(strict='TRUE', ocr='TRUE')} AS warning FROM s""",
    "bad_russian_ocr": f"""WITH {ALTERED} SELECT doc_id, {_letters('text')} >= 200 AND {_cyr('text')} < 0.35 AS bad FROM d""",
    "dehyphenate": f"WITH {MARKED} SELECT doc_id, md5({HYPHEN}) AS digest FROM m",
    "line_kinds": rf"""WITH {MARKED}, x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM m)
SELECT doc_id, count_if(regexp_matches(line, '^(?i)(стр\.?|страница)\s*[0-9]{{1,3}}(\s*из\s*[0-9]{{1,3}})?$')) AS page_numbers, count_if({_STRUCTURAL.format('line')}) AS structural, count(*) AS lines FROM x GROUP BY doc_id""",
    "clean_markdown": rf"""WITH {MARKED}, h AS (SELECT doc_id, regexp_replace({HYPHEN.replace('text', _strip('text'))}, '[ \t]+', ' ', 'g') AS text FROM m),
k AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_strip('x')}), lambda x: NOT regexp_matches(x, '^(?i)(стр\.?|страница)\s*[0-9]{{1,3}}(\s*из\s*[0-9]{{1,3}})?$')) AS k FROM h),
f AS (SELECT doc_id, {FOLD} AS s FROM k),
o AS (SELECT doc_id, array_to_string(s.o || CASE WHEN s.p <> '' THEN [s.p] ELSE []::VARCHAR[] END, chr(10)) AS t FROM f)
SELECT doc_id, md5({_strip(r"regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g')")}) AS digest FROM o""",
    "tsv_lines": f"WITH {_WORDS} SELECT doc_id, (i // 7)::BIGINT AS line_num, string_agg(word, ' ' ORDER BY i) AS line FROM w GROUP BY doc_id, i // 7",
    "tsv_confidence": f"WITH {_WORDS}, c AS (SELECT doc_id, (doc_id * 7 + i * 13) % 103 - 2 AS c FROM w) SELECT doc_id, sum(CASE WHEN c >= 0 THEN c END)::DOUBLE AS total, count(CASE WHEN c >= 0 THEN 1 END) AS words FROM c GROUP BY doc_id",
    "attempt_scores": f"""WITH {ALTERED}, {MATRIX}, s AS (SELECT doc_id, {_strip('text')} AS st FROM d),
o AS MATERIALIZED (SELECT doc_id, st = '' AS none, least(length(st), 2500) AS n, {_runs('st', '>= 2')} AS w, {_cyr('st')} AS c, {_repl('st')} AS r, {_single('st')} AS g FROM s)
SELECT doc_id, attempt_no, floor(((CASE WHEN none THEN 0.0::DOUBLE ELSE n * 0.03::DOUBLE + w * 0.8::DOUBLE + {ATTEMPT_SURE} * 2.0::DOUBLE + c * 35.0::DOUBLE - r * 8.0::DOUBLE - g * 40.0::DOUBLE END)
 + CASE psm WHEN 6 THEN 8.0::DOUBLE WHEN 4 THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END) * 100 + 0.5)::BIGINT AS hundredths FROM o, mx""",
    "best_attempt": BEST,
    "recognition_search": BEST,
    "assemble_pages": f"""WITH {ALTERED}, {PAGES}, s AS (SELECT doc_id, page_index, {_strip('page_text')} AS st FROM p)
SELECT doc_id, md5(string_agg('## Страница ' || page_index || chr(10) || chr(10) || st, chr(10) || chr(10) ORDER BY page_index)) AS digest, min(page_index) AS first_page FROM s WHERE st <> '' GROUP BY doc_id""",
    "document_status": f"""WITH {STATUS} SELECT doc_id, doc_type, method, status, warning, quality_status, page_count, length(text) AS char_count, rp AS replacement_count, tp AS text_page_count, op AS ocr_page_count, bp AS blank_page_count FROM r""",
    "run_report": f"""WITH {STATUS} SELECT count(*) AS documents, count_if(status = 'успешно') AS succeeded, count_if(status = 'требует проверки') AS to_review, count_if(status = 'ошибка') AS failed, sum(page_count)::BIGINT AS pages, sum(op)::BIGINT AS ocr_pages, 0::BIGINT AS docx_images,
 sum(tp)::BIGINT AS text_pages, sum(bp)::BIGINT AS blank_pages, sum(reviews)::BIGINT AS page_warnings, 0::BIGINT AS image_warnings, sum(length(text))::BIGINT AS chars, printf('%.1f', round_even(sum(ssum) / sum(sn), 1)) AS mean_confidence FROM r""",
    "file_report": f"""WITH {STATUS} SELECT doc_id, status, quality_status, reviews AS page_warnings, op AS ocr_page_count, CASE WHEN sn > 0 THEN printf('%.1f', round_even(ssum / sn, 1)) ELSE 'нет данных' END AS mean_confidence FROM r""",
    "review_list": f"""WITH {STATUS} SELECT doc_id, page_index, 'стр. ' || page_index AS place, note AS warning FROM e WHERE note <> ''""",
    "page_report_lines": f"""WITH {STATUS} SELECT doc_id, page_index, '- стр. ' || page_index || ': ' || CASE src WHEN 'ocr' THEN 'OCR' WHEN 'text' THEN 'текстовый слой' ELSE 'пустая/почти пустая' END || ', символов: ' || length(st) || ', '
 || CASE WHEN src = 'ocr' THEN 'уверенность: ' || coalesce(printf('%.1f', sure), 'нет данных') || ', dpi: 216, psm: 6, вариант: contrast_sharp, попыток: 1, выбор: score=1.0; confidence=' || coalesce(printf('%.1f', sure), 'нет') || '; dpi=216; psm=6; variant=contrast_sharp; attempts=1' ELSE 'OCR детали: нет' END
 || ', замечание: ' || CASE WHEN note = '' THEN 'нет' ELSE note END AS line FROM e""",
    "run_report_lines": f"""WITH {STATUS},
hd AS (SELECT ['Отчёт о конвертации документов', '', 'Создан: 2024-01-02 03:06:10', 'Исходная папка: /in', 'Папка результата: /out', 'Время обработки: 2 мин 5 сек', '', 'Итог:', '- документов обработано: ' || count(*), '- успешно: ' || count_if(status = 'успешно'), '- требует проверки: ' || count_if(status = 'требует проверки'), '- ошибки: 0',
 '- страниц PDF: ' || sum(page_count), '- страниц OCR: ' || sum(op), '- изображений DOCX распознано OCR: 0', '- страниц прочитано текстовым слоем: ' || sum(tp), '- пустых/почти пустых страниц: ' || sum(bp), '- страниц с замечаниями OCR: ' || sum(reviews), '- изображений DOCX с замечаниями OCR: 0', '- символов извлечено: ' || sum(length(text)),
 '- Tesseract OCR: найден, версия 5.3 (rus, eng)', '- Tesseract path: /bin/engine', '- tessdata: не определено', '- OCR языки: rus+eng', '- режим качества OCR: max', '- максимум параллельных OCR-страниц: 4', '- границы страниц в Markdown: обычный режим', '- средняя уверенность OCR: ' || printf('%.1f', round_even(sum(ssum) / sum(sn), 1)), '', 'Файлы:'] AS ls FROM r),
fl AS (SELECT doc_id, CASE WHEN doc_id > (SELECT min(doc_id) FROM r) THEN [''] ELSE []::VARCHAR[] END || [(doc_id + 1) || '. doc_' || doc_id || '.pdf', '   Статус: ' || status, '   Тип: ' || doc_type, '   Метод: ' || method, '   Markdown: 01_markdown/doc_' || doc_id || '.md', '   Страниц: ' || page_count, '   OCR страниц: ' || op, '   Изображений DOCX распознано OCR: 0',
 '   Текстовый слой: ' || tp, '   Пустые страницы: ' || bp, '   Страниц с замечаниями OCR: ' || reviews, '   Изображений DOCX с замечаниями OCR: 0', '   Средняя уверенность OCR: ' || CASE WHEN sn > 0 THEN printf('%.1f', round_even(ssum / sn, 1)) ELSE 'нет данных' END, '   Символов: ' || length(text), '   Качество: ' || quality_status, '   Предупреждение: ' || CASE WHEN warning = '' THEN 'нет' ELSE warning END, '   Ошибка: нет'] AS ls FROM r),
al AS (SELECT -1 AS d, ls FROM hd UNION ALL SELECT doc_id AS d, ls FROM fl), ul AS (SELECT d, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM al)
SELECT row_number() OVER (ORDER BY d, i) AS line_no, line FROM ul""",
    "ocr_report_lines": f"""WITH {STATUS}, pl AS (SELECT doc_id, page_index, note, '- стр. ' || page_index || ': ' || CASE src WHEN 'ocr' THEN 'OCR' WHEN 'text' THEN 'текстовый слой' ELSE 'пустая/почти пустая' END || ', символов: ' || length(st) || ', '
 || CASE WHEN src = 'ocr' THEN 'уверенность: ' || coalesce(printf('%.1f', sure), 'нет данных') || ', dpi: 216, psm: 6, вариант: contrast_sharp, попыток: 1, выбор: score=1.0; confidence=' || coalesce(printf('%.1f', sure), 'нет') || '; dpi=216; psm=6; variant=contrast_sharp; attempts=1' ELSE 'OCR детали: нет' END
 || ', замечание: ' || CASE WHEN note = '' THEN 'нет' ELSE note END AS line FROM e),
bl AS (SELECT doc_id, CASE WHEN doc_id > (SELECT min(doc_id) FROM e) THEN [''] ELSE []::VARCHAR[] END || ['Файл: doc_' || doc_id || '.pdf', 'Тип: ' || doc_type, 'Метод: ' || method, 'Страниц: ' || page_count, 'OCR страниц: ' || op, 'Изображений DOCX распознано OCR: 0', 'Текстовый слой: ' || tp, 'Пустые страницы: ' || bp, '', 'Страницы и изображения:'] AS ls FROM r WHERE doc_id IN (SELECT doc_id FROM e)),
ul AS (SELECT 0 AS s, 0 AS d, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM (SELECT ['Постраничный OCR-отчет', '', 'Создан: 2024-01-02 03:06:10', 'Время обработки: 2 мин 5 сек', '', 'Страницы и изображения для ручной проверки:'] AS ls)
 UNION ALL SELECT 1, doc_id, page_index, '- doc_' || doc_id || '.pdf, стр. ' || page_index || ': ' || note FROM pl WHERE note <> '' UNION ALL SELECT 2, 0, 0, ''
 UNION ALL SELECT 3, doc_id, generate_subscripts(ls, 1), unnest(ls) FROM bl UNION ALL SELECT 3, doc_id, page_index + 1000000, line FROM pl)
SELECT row_number() OVER (ORDER BY s, d, i) AS line_no, line FROM ul""",
    "problem_notes": f"""WITH {STATUS} SELECT doc_id, array_to_string(['# Требует проверки: doc_' || doc_id || '.pdf', '', '- Исходный файл: `/in/doc_' || doc_id || '.pdf`', '- Тип: ' || doc_type, '- Метод: ' || method, '- Статус: ' || status, '- Предупреждение: ' || CASE WHEN warning = '' THEN 'нет' ELSE warning END, '- Ошибка: нет', '', 'Проверьте исходный документ вручную, особенно если это бумажный скан.', ''], chr(10)) AS note FROM r WHERE status <> 'успешно'""",
    "combined_markdown": rf"""WITH {STATUS}, hy AS (SELECT doc_id, regexp_replace({HYPHEN.replace('text', _strip('text'))}, '[ \t]+', ' ', 'g') AS t FROM r),
ln AS (SELECT doc_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: {_strip('x')}), lambda x: NOT regexp_matches(x, '^(?i)(стр\.?|страница)\s*[0-9]{{1,3}}(\s*из\s*[0-9]{{1,3}})?$')) AS k FROM hy),
fo AS (SELECT doc_id, {FOLD} AS s FROM ln),
jo AS (SELECT doc_id, array_to_string(s.o || CASE WHEN s.p <> '' THEN [s.p] ELSE []::VARCHAR[] END, chr(10)) AS t FROM fo),
cl AS (SELECT doc_id, {_strip(r"regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g')")} AS body FROM jo),
sec AS (SELECT r.doc_id, array_to_string(['', '', '---', '', '# Документ ' || (r.doc_id + 1) || ': doc_' || r.doc_id || '.pdf', '', '- Тип: ' || doc_type, '- Метод: ' || method, '- Статус: ' || status, '- Качество: ' || quality_status, '- Исходный файл: `/in/doc_' || r.doc_id || '.pdf`', '- Границы страниц: обычный режим', '', CASE WHEN body = '' THEN {_strip('r.text')} ELSE body END], chr(10)) AS section FROM r JOIN cl USING (doc_id))
SELECT doc_id + 1 AS doc_index, md5(section) AS digest, length(section) AS chars FROM sec""",
    "phrase_presence": f"""WITH f AS (SELECT doc_id, trim(regexp_replace(upper(text), '[^0-9{L}]+', ' ', 'g')) AS f FROM documents), m AS (SELECT doc_id, list_filter([{', '.join(f"CASE WHEN {_present(p)} THEN NULL ELSE '{p}' END" for p in _PHRASES)}], lambda x: x IS NOT NULL) AS missing FROM f)
SELECT doc_id, {len(_PHRASES)}::BIGINT AS total, {len(_PHRASES)} - len(missing) AS found, array_to_string(missing, '|') AS missing FROM m""",
    "missing_languages": """SELECT doc_id, array_to_string(list_filter(['rus', 'eng'], lambda x: NOT list_contains(CASE WHEN doc_id % 2 = 0 THEN ['eng'] ELSE [lang, 'rus'] END, x)), ',') AS missing FROM documents""",
    "skip_paths": """WITH w AS (SELECT doc_id, generate_subscripts(ws, 1) - 1 AS i, unnest(ws) AS w FROM (SELECT doc_id, string_split(text, ' ') AS ws FROM documents)),
n AS (SELECT doc_id, list_extract(['docs', 'build', 'markdown_result_1', '.converter_x', 'Build', 'runtime', 'benchmark_result_2', 'a'], (length(w) % 8 + 1)::INT) AS folder, CASE WHEN i % 7 = 0 THEN '~$' ELSE '' END || w || list_extract(['.pdf', '.PDF', '.Docx', '.txt', '.d.pdf', ''], (i % 6 + 1)::INT) AS name FROM w)
SELECT doc_id, count(*) AS files, count_if((lower(name) LIKE '%.pdf' OR lower(name) LIKE '%.docx') AND NOT starts_with(name, '~$') AND folder NOT IN ('build', 'runtime') AND NOT starts_with(folder, 'markdown_result_') AND NOT starts_with(folder, 'benchmark_result_') AND NOT starts_with(folder, '.converter_')) AS wanted FROM n GROUP BY doc_id""",
    "output_stems": r"""WITH s AS (SELECT doc_id, ' .' || translate(text, 'aeo', ':*"') || '. ' AS odd FROM documents)
SELECT doc_id, md5(regexp_replace(regexp_replace('sub__' || odd, '[<>:"/\\|?*\x00-\x1F]', '_', 'g'), '^[ .]+|[ .]+$', '', 'g')) AS stem, md5(regexp_replace(regexp_replace(odd, '[<>:"/\\|?*\x00-\x1F]+', '_', 'g'), '^[ .]+|[ .]+$', '', 'g')) AS part FROM s""",
    "docx_cells": rf"""WITH s AS (SELECT doc_id, replace(replace(text, ', ', ' ' || chr(9) || '| '), chr(10), '  ' || chr(13) || chr(10) || ' ') AS t FROM documents), c AS (SELECT doc_id, {_strip(r"regexp_replace(regexp_replace(replace(t, chr(13) || chr(10), chr(10)), '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g')")} AS t FROM s)
SELECT doc_id, md5(t) AS run, md5(replace(replace(t, '|', '\|'), chr(10), ' / ')) AS cell FROM c""",
    "docx_documents": rf"""WITH x AS (SELECT doc_id, regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', ' ', 'g') AS text FROM documents),
l AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM x)),
n AS (SELECT doc_id, i, CASE WHEN i = 0 AND doc_id % 4 = 0 THEN {_tidy("line || '[2]'")} ELSE {_tidy('line')} END AS para, list_transform(string_split(line, ', '), lambda c: replace(replace({_tidy('c')}, '|', '\|'), chr(10), ' / ')) AS cs FROM l),
b AS (SELECT doc_id, i, CASE WHEN i % 3 <> 2 THEN para WHEN len(list_filter(cs, lambda c: c <> '')) = 0 THEN '' ELSE '| ' || array_to_string(cs, ' | ') || ' |' || chr(10) || '| ' || array_to_string(list_transform(cs, lambda c: '---'), ' | ') || ' |'
 || CASE WHEN cs[1] <> '' THEN chr(10) || '| ' || array_to_string([cs[1]] || list_transform(range(1, len(cs)), lambda k: ''), ' | ') || ' |' ELSE '' END END AS t FROM n),
d AS (SELECT doc_id, string_agg(t, chr(10) || chr(10) ORDER BY i) FILTER (t <> '') AS t FROM b GROUP BY doc_id),
f AS (SELECT doc_id, '## Сноски' || chr(10) || chr(10) || '[2] ' || {_tidy('line')} AS note FROM l WHERE i = 0 AND doc_id % 4 = 0 AND {_tidy('line')} <> ''),
o AS (SELECT d.doc_id, concat_ws(chr(10) || chr(10), t, note) AS t FROM d LEFT JOIN f USING (doc_id))
SELECT doc_id, md5(t) AS digest, length(t) AS chars, t = '' AS failed FROM o""",
    "docx_picture_places": r"""WITH x AS (SELECT doc_id, string_split(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', ' ', 'g'), chr(10)) AS ws FROM documents),
w AS (SELECT doc_id, generate_subscripts(ws, 1) AS pos, unnest(ws) AS w FROM x),
m AS (SELECT doc_id, min(pos) AS pos, t FROM w JOIN (VALUES (0, 'word/media/a.png'), (1, 'word/media/b.png'), (4, 'word/media/c.png'), (5, 'word/media/b.png'), (6, 'word/media/e.png')) v(k, t) ON length(w) % 9 = k GROUP BY doc_id, t)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS number, t AS target FROM m""",
    "raster_measures": f"""WITH {GREYS}, c AS (SELECT y.doc_id, grey, n, total, sum(n) OVER (PARTITION BY y.doc_id ORDER BY grey) AS up, sum(n) OVER (PARTITION BY y.doc_id ORDER BY grey DESC) AS down FROM y JOIN z ON z.doc_id = y.doc_id),
m AS (SELECT doc_id, sum(CASE WHEN grey < 245 THEN n ELSE 0 END)::BIGINT AS dark, min(CASE WHEN up > total // 100 THEN grey END)::BIGINT AS low, max(CASE WHEN down > total // 100 THEN grey END)::BIGINT AS high FROM c GROUP BY doc_id),
j AS (SELECT z.doc_id, coalesce(dark, 0)::BIGINT AS dark, total::BIGINT AS total, total = 0 OR coalesce(dark, 0) / total < 0.01 AS blank, coalesce(low, 0) AS low, coalesce(high, 0) AS high FROM z LEFT JOIN m ON m.doc_id = z.doc_id)
SELECT doc_id, dark, total, blank, NOT blank AND total // 320 >= 160 AND total >= 120000 AS candidate, low, high FROM j""",
    "raster_greys": f"WITH {GREYS} SELECT grey::BIGINT AS grey, sum(n)::BIGINT AS pixels FROM y GROUP BY grey",
    "phrase_table": f"""WITH p AS (SELECT item_id * 1000 + k - 1 AS phrase_id, trim(regexp_replace(upper(replace(ph, 'ß', 'ss')), '[^0-9{L}]+', ' ', 'g')) AS f FROM (SELECT item_id, generate_subscripts(ps, 1) AS k, unnest(ps) AS ph FROM (SELECT item_id, regexp_split_to_array(text, '[.\n]') AS ps FROM benchmark))),
q AS (SELECT phrase_id, f, list_filter(string_split(f, ' '), lambda w: length(w) >= 4) AS ws FROM p),
d AS MATERIALIZED (SELECT doc_id, trim(regexp_replace(upper(replace(text, 'ß', 'ss')), '[^0-9{L}]+', ' ', 'g')) AS t FROM documents),
h AS (SELECT doc_id, phrase_id FROM d, q WHERE contains(t, f) OR (len(ws) > 0 AND len(list_filter(ws, lambda w: NOT contains(t, w))) = 0))
SELECT d.doc_id, (SELECT count(*) FROM q) AS total, count(phrase_id) AS found, coalesce(string_agg(phrase_id, ',' ORDER BY phrase_id), '') AS ids FROM d LEFT JOIN h USING (doc_id) GROUP BY d.doc_id""",
    "first_converter": """SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND trim(text) <> '' THEN 0 WHEN doc_id % 4 = 0 AND trim(text) <> '' THEN 1 WHEN doc_id % 5 = 0 THEN 2 END::BIGINT AS converter FROM documents""",
    "report_metrics": f"""WITH {STATUS} SELECT doc_id, length(text) AS extracted_chars, CASE WHEN op > 0 THEN op END AS ocr_pages, reviews AS review_pages, CASE WHEN sn > 0 THEN round_even(ssum / sn, 1) END AS confidence FROM r""",
    "benchmark_verdict": f"""WITH {ALTERED}, x AS (SELECT 'max' AS mode, text FROM documents UNION ALL SELECT 'standard', text FROM d),
f AS (SELECT mode, trim(regexp_replace(upper(replace(text, 'ß', 'ss')), '[^0-9{L}]+', ' ', 'g')) AS f FROM x), c AS (SELECT mode, {' + '.join(f'({_present(p)})::INT' for p in _PHRASES)} AS found FROM f),
m AS (SELECT mode, sum(found) AS found, count_if(found = {len(_PHRASES)}) > 0 AS whole FROM c GROUP BY mode),
v AS (SELECT coalesce((SELECT found FROM m WHERE mode = 'max') >= (SELECT found FROM m WHERE mode = 'standard'), FALSE) AS ok, bool_and(found > 0) AS passed, bool_or(mode = 'max' AND whole) AS russian FROM m)
SELECT passed AND ok AS passed, ok AS max_not_worse, russian AS russian_passed FROM v""",
}
