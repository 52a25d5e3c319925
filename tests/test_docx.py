"""DOCX files as rows: against a plain walk over the XML tree, and by the data source."""

import io
import random
import zipfile
from xml.etree import ElementTree

from folioflow.operators import docx
from folioflow.sources import docx_parts

W, R = docx_parts.MAIN, docx_parts.LINKS
SPACES = f'xmlns:w="{W[1:-1]}" xmlns:r="{R[1:-1]}"'


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, data in parts.items():
            archive.writestr(name, data)
    return out.getvalue()


def tree_text(node):
    parts = []
    for x in node.iter():
        name = x.tag.replace(W, "")
        note = x.get(f"{W}id") or ""
        parts += [x.text or ""] * (name == "t") + ["\t"] * (name == "tab") + ["\n"] * (name in ("br", "cr")) + [f"[{note}]"] * (name.endswith("noteReference") and note[:1] not in ("", "-"))
    lines = "".join(parts).replace("\r\n", "\n").replace("\r", "\n").split("\n")
    squeezed = [" ".join(x for x in line.replace("\t", " ").split(" ") if x) for line in lines]
    return "\n".join(squeezed).strip()


def tree_blocks(container):
    out = []
    for child in container:
        if child.tag == f"{W}p":
            out.append(tree_text(child))
        elif child.tag == f"{W}tbl":
            grid = [[" ".join(filter(None, (tree_text(p) for p in cell.iter(f"{W}p")))).replace("|", "\\|").replace("\n", " / ") for cell in row if cell.tag == f"{W}tc"] for row in child.iter(f"{W}tr")]
            grid = [cells for cells in grid if any(cells)]
            width = max(map(len, grid), default=0)
            lines = ["| " + " | ".join(cells + [""] * (width - len(cells))) + " |" for cells in grid]
            out.append("\n".join([*lines[:1], *(["| " + " | ".join(["---"] * width) + " |"] if lines else []), *lines[1:]]))
    return [x for x in out if x]


def tree_document(parts):
    blocks = tree_blocks(next(ElementTree.fromstring(parts[docx_parts.BODY]).iter(f"{W}body")))
    for name, title in zip(docx_parts.PARTS[1:], docx.TITLES[1:], strict=True):
        found = []
        for note in ElementTree.fromstring(parts[name]) if name in parts else []:
            number, text = note.get(f"{W}id") or "", "\n\n".join(tree_blocks(note))
            found += [f"[{number}] {text}"] if number[:1] not in ("", "-") and text else []
        blocks += [f"## {title}", *found] if found else []
    return "\n\n".join(blocks)


def made_up(rnd):
    def run():
        return rnd.choice(["<w:t>word</w:t>", "<w:t> a|b </w:t>", "<w:tab/>", "<w:br/>", "<w:t/>", '<w:footnoteReference w:id="2"/>', '<w:endnoteReference w:id="-1"/>', "<w:t>é\r\nx</w:t>", "<w:cr/>"])

    def paragraph(depth):
        inner = "".join(f"<w:r>{run()}</w:r>" for _ in range(rnd.randint(0, 4)))
        return f"<w:p>{inner}{'<w:box>' + paragraph(depth + 1) + '</w:box>' if depth < 2 and rnd.random() < 0.15 else ''}</w:p>"

    def table(depth):
        def cell():
            inner = "".join(table(depth + 1) if depth < 2 and rnd.random() < 0.2 else paragraph(1) for _ in range(rnd.randint(0, 3)))
            return f"<w:tc>{inner}</w:tc>" if rnd.random() < 0.9 else f"<w:sdt><w:tc>{inner}</w:tc></w:sdt>"

        return "<w:tbl>" + "".join("<w:tr>" + "".join(cell() for _ in range(rnd.randint(0, 4))) + "</w:tr>" for _ in range(rnd.randint(0, 4))) + "</w:tbl>"

    def blocks(n):
        return "".join(rnd.choice([paragraph, paragraph, table, lambda d: f"<w:sdt>{paragraph(d)}</w:sdt>"])(0) for _ in range(rnd.randint(0, n)))

    parts = {docx_parts.BODY: f"<w:document {SPACES}><w:body>{blocks(6)}</w:body><w:body>{blocks(2)}</w:body></w:document>"}
    for name, tag in zip(docx_parts.PARTS[1:], ("footnote", "endnote"), strict=True):
        if rnd.random() < 0.6:
            shown = "".join(f'<w:{tag} w:id="{rnd.choice(["-1", "1", "2", "33", ""])}">{blocks(3)}</w:{tag}>' for _ in range(rnd.randint(0, 4)))
            parts[name] = f"<w:notes {SPACES}>{shown}</w:notes>"
    return parts


def test_texts_equal_a_walk_over_the_tree(spark):
    rnd = random.Random(12)
    files = [made_up(rnd) for _ in range(250)]
    rows = [(n, bytearray(zipped(parts))) for n, parts in enumerate(files)] + [(900, bytearray(b"no zip")), (901, bytearray(zipped({"x": "y"}))), (902, bytearray(zipped({docx_parts.BODY: "<a><b></a>"}))), (903, bytearray(zipped({docx_parts.BODY: "<a/>"})))]
    table = spark.createDataFrame(rows, "doc_id long, content binary").repartition(3)
    got = {r["doc_id"]: (r["raw_text"], r["error"]) for r in docx.docx_text(docx.docx_blocks(table)).collect()}
    expected = {n: tree_document(parts) for n, parts in enumerate(files)}
    assert {n: got[n] for n in expected} == {n: (t, "" if t else docx.NO_TEXT) for n, t in expected.items()}
    assert all(got[n][0] == "" and got[n][1] not in ("", docx.NO_TEXT) for n in (900, 901, 902, 903)) and len(got) == 254
    assert sum("---" in t for t in expected.values()) > 20 and sum("## " in t for t in expected.values()) > 20


def test_pictures_by_first_reference(spark):
    rel = lambda n, target, more="": f'<Relationship Id="{n}" Type="http://x/image" Target="{target}" {more}/>'
    part = lambda *links: f"<w:x {SPACES}>" + "".join(f'<w:blip r:{a}="{x}"/>' for a, x in links) + "</w:x>"
    parts = {
        docx_parts.BODY: part(("embed", "b"), ("id", "a"), ("embed", "b"), ("embed", "out"), ("embed", "gone"), ("embed", "doc"), ("embed", "twice")),
        "word/_rels/document.xml.rels": "<r>" + rel("a", "media/a.png") + rel("b", "./media/../media/b.png") + rel("out", "media/a.png", 'TargetMode="External"') + rel("gone", "media/none.png") + rel("twice", "media/a.png") + rel("twice", "media/c.png") + '<Relationship Id="doc" Type="http://x/other" Target="media/a.png"/></r>',
        "word/header2.xml": part(("embed", "h"), ("embed", "a")),
        "word/_rels/header2.xml.rels": "<r>" + rel("h", "media/a.png") + rel("a", "media/d.png") + "</r>",
        "word/header10.xml": part(("embed", "h")),
        "word/_rels/header10.xml.rels": "<r>" + rel("h", "media/e.png") + "</r>",
        "word/footer1.xml": "<broken",
        "word/_rels/footer1.xml.rels": "<r>" + rel("h", "media/f.png") + "</r>",
        **{f"word/media/{x}.png": x for x in "abcdef"},
    }
    files = spark.createDataFrame([(1, bytearray(zipped(parts))), (2, bytearray(b"no zip"))], "doc_id long, content binary")
    rows = sorted((r["number"], r["target"][-5:], bytes(r["content"]).decode()) for r in docx.docx_pictures(files).collect())
    assert rows == [(1, "b.png", "b"), (2, "a.png", "a"), (3, "c.png", "c"), (4, "e.png", "e"), (5, "d.png", "d")]


def test_the_data_source_reads_folders_and_takes_filters(spark, tmp_path):
    for n in range(3):
        data = docx_parts.document([f"text {n}", [["a", "b"], ["c"]]], {"2": f"note {n}"})
        (tmp_path / f"_{n}").mkdir()
        (tmp_path / f"_{n}" / f".{n}.DocX").write_bytes(data)
    (tmp_path / "broken.docx").write_bytes(b"x")
    docx_parts.register(spark)
    rows = spark.read.format("docx").load(str(tmp_path))
    found = docx.blocks_of(rows.withColumnRenamed("path", "doc_id"))
    texts = {r["doc_id"].rpartition("/")[2]: r["raw_text"] for r in docx.docx_text(found).collect()}
    assert texts == {"broken.docx": ""} | {f".{n}.DocX": f"text {n}[2]\n\n| a | b |\n| --- | --- |\n| c |  |\n\n## Сноски\n\n[2] note {n}" for n in range(3)}
    one = rows.filter(f"path = '{tmp_path}/_1/.1.DocX' and part = 1")
    assert [(r["note"], r["text"]) for r in one.collect()] == [("2", "note 1")] and one.rdd.getNumPartitions() == 1
