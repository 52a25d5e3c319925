"""The training-data operators against brute force, exact round trips and held-out accuracy."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import embeddings, jpeg, langid, licenses, mixing, ngram_join, packing, pii, queries, token_files, toxicity
from folioflow.llm.bytebpe import PieceEncoder
from folioflow.llm.components import components

ODD_TEXTS = [None, "", " ", "\n\t", "a", "Ab c", "é😀ß", "a's 'll x'y  12 ½", "x" * 5000, "w " * 3000, "same words here", "same words here", "\x01\x02", "a <|endoftext|><|endoftext|>b <|endoftext"]


def docs_of(spark, texts, **more):
    rows = [(n, t, "x") for n, t in enumerate(texts)] + [(None, "row without id", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, node string").repartition(3)


def empty(spark, schema="doc_id long, text string, lang string, source string, n_chars long"):
    return spark.createDataFrame([], schema)


@pytest.fixture(scope="module")
def vocabulary():
    return queries.vocabulary()


@pytest.fixture(scope="module")
def library(vocabulary):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


def test_encoder_equals_the_library(vocabulary, library):
    rnd = random.Random(1)
    parts = ["a", "B", "é", " ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "1", "²", "½", "!", "?", "，", "中", "😀", "x", "́", "٣", "\x1c", "\x85", "'t", "<|endoftext|>", "<|", "|>", "endoftext"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
    ids, bounds = PieceEncoder(vocabulary).encode(texts)
    for k, t in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 257, 5000])
def test_elias_fano(n):
    values = np.cumsum(np.random.default_rng(n).integers(0, 900, n))
    read = token_files.EliasFano.from_bytes(memoryview(token_files.EliasFano.encode(values).to_bytes()))
    assert [read.select(i) for i in range(n)] == values.tolist()
    if n > 1000:
        assert len(token_files.EliasFano.encode(values).to_bytes()) < 8 * n / 4


def test_token_files(spark, vocabulary, library, tmp_path):
    docs = docs_of(spark, ODD_TEXTS)
    files = token_files.write_token_files(docs, vocabulary, 2, f"file://{tmp_path}", file_ids=1000)
    assert len(files) > 1
    rows = token_files.read_token_files(spark, files).collect()
    start = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        text = "row without id" if r["doc_id"] is None else ODD_TEXTS[r["doc_id"]]
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])] == [None, *range(len(ODD_TEXTS))]
    file = token_files.TokenFile(token_files._read(files[0][0]))
    assert file.document(0)[-1] == 2 and file.doc_id(0) is None and file.doc_id(1) == 0
    assert token_files.encode_to_files(empty(spark), vocabulary).count() == 0


def test_packing(spark, vocabulary, library):
    rows = packing.pack_documents(docs_of(spark, ODD_TEXTS * 3), vocabulary).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert len(pieces) == 3 * len(ODD_TEXTS) + 1
    for doc_id, found in pieces.items():
        text = "row without id" if doc_id is None else ODD_TEXTS[doc_id % len(ODD_TEXTS)]
        ids, at = library.encode(text or "", add_special_tokens=False).ids + [1], 0
        for r in sorted(found, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for found in sequences.values():
        found.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in found] == np.cumsum([0] + [r["length"] for r in found])[:-1].tolist()
        total = sum(r["length"] for r in found)
        assert total <= 2048 and total & (total - 1) == 0
    assert packing.pack_documents(empty(spark), vocabulary).count() == 0


def test_hilbert_curve_visits_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    keys = packing.hilbert_key(grid, 3)
    assert sorted(keys.tolist()) == list(range(512))
    path = grid[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_jpeg_round_trip(spark):
    rnd = np.random.default_rng(3)
    for n in (1, 2, 255, 257, 700):
        payload = rnd.integers(0, 256, 64 * n, dtype=np.uint8).tobytes()[:-64] + b"\xff" * 64
        media = jpeg.write_media(payload)
        ((read, images, thumbs),) = jpeg.read_media([media])
        assert read == payload and thumbs[0].shape == (images[0].height // 8, images[0].width // 8)
    rows = {r["doc_id"]: r for r in jpeg.media_features(docs_of(spark, ODD_TEXTS)).collect()}
    for n, text in enumerate(ODD_TEXTS):
        data = (text or "").encode()
        padded = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        r = rows[n]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(padded))
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest() and r["tail_crc32"] == zlib.crc32(padded[-64:])
    same = [k for k in rows[0].asDict() if k != "doc_id"]
    assert [rows[0][k] for k in same] == [rows[1][k] for k in same]
    assert jpeg.media_features(empty(spark)).count() == 0


def test_jpeg_of_other_tables_and_components():
    """A hand-made colour image: 2x1 sampling, run lengths, end-of-block codes, one scan without restart markers."""
    table = lambda kind, symbols: jpeg._segment(0xC4, bytes([kind]) + bytes([0, 0, 0, len(symbols)] + [0] * 12) + bytes(symbols))
    dc, ac = [0, 3], [0x00, 0x12, 0xF0, 0x21]
    code = lambda symbols, s: format(symbols.index(s), "04b")

    def block(diff, coefficients):
        bits = code(dc, 3 if diff else 0) + (format(diff if diff > 0 else diff + 7, "03b") if diff else "")
        for run, value in coefficients:
            while run > 15:
                bits, run = bits + code(ac, 0xF0), run - 16
            size = abs(value).bit_length()
            bits += code(ac, run << 4 | size) + format(value if value > 0 else value + (1 << size) - 1, f"0{size}b")
        return bits + code(ac, 0x00)

    scan = block(5, [(1, 3)]) + block(-6, [(2, -1)]) + block(0, []) + block(4, [(17, 2)])
    scan += "1" * (-len(scan) % 8)
    data = bytes(int(scan[k : k + 8], 2) for k in range(0, len(scan), 8)).replace(b"\xff", b"\xff\0")
    frame = jpeg._segment(0xC0, bytes([8, 0, 8, 0, 16, 3, 1, 0x21, 0, 2, 0x11, 0, 3, 0x11, 0]))
    media = b"\xff\xd8" + jpeg._segment(0xDB, bytes([0, *[2] * 64])) + table(0, dc) + table(0x10, ac) + frame
    media += jpeg._segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + data + b"\xff\xd9"
    image = jpeg.parse(media)
    luma, blue, red = jpeg.coefficients([image])[0]
    assert luma[:, 0].tolist() == [5, -1] and luma[0, 2] == 3 and luma[1, 3] == -1
    assert blue[0].tolist() == [0] * 64 and red[0, 0] == 4 and red[0, 18] == 2
    assert jpeg.thumbnail(image, luma).tolist() == [[128 + (10 + 4 >> 3), 128 + (-2 + 4 >> 3)]]


def shingle_set(text, size=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute_components(texts, words=3, units=(90, 100)):
    sets = [shingle_set(t, words) for t in texts]
    root = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and units[1] * both >= units[0] * len(sets[a] | sets[b]):
                x, y = a, b
                while root[x] != x:
                    x = root[x]
                while root[y] != y:
                    y = root[y]
                root[max(x, y)] = min(x, y)
    def top(x):
        return x if root[x] == x else top(root[x])
    return {n: (len(sets[n]), top(n)) for n in range(len(sets))}


def near_copies(seed):
    rnd = random.Random(seed)
    words = [f"W{i}" for i in range(300)]
    texts = list(ODD_TEXTS)
    for _ in range(12):
        base = [rnd.choice(words) for _ in range(rnd.choice([1, 2, 3, 9, 12, 13, 21, 40, 90, 300]))]
        for _ in range(rnd.choice([1, 2, 6, 20])):
            copy = list(base)
            for _ in range(int(len(copy) * rnd.choice([0, 0, 0.01, 0.02, 0.03, 0.06]) + rnd.random())):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_equals_brute_force(spark, seed):
    texts = near_copies(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(docs_of(spark, texts)).collect()}
    assert got.pop(None) == (1, None)
    assert got == brute_components(texts)


def thue_morse(n):
    return "".join("ab"[bin(k).count("1") % 2] for k in range(n)), "".join("ba"[bin(k).count("1") % 2] for k in range(n))


def test_long_words_of_like_structure_differ(spark, vocabulary, library):
    """Words whose polynomial hashes by an odd base are equal, whatever the base."""
    pair = thue_morse(4096)
    texts = [f"{word} {word} {word} end" for word in pair]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join(docs_of(spark, texts)).collect()}
    assert (got[0], got[1]) == (0, 1)
    a, b = (set(toxicity.features([t])[1].tolist()) for t in texts)
    assert len(a - b) > 0
    encoder = PieceEncoder(vocabulary)
    for texts in (list(pair), list(thue_morse(256))):
        ids, bounds = encoder.encode(texts)
        for k, t in enumerate(texts):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == library.encode(t, add_special_tokens=False).ids


def matrix_parts(spark, texts, words, units):
    docs = docs_of(spark, texts)
    sketched = ngram_join.materialise(ngram_join.sketch(docs, words, units), "test").filter("doc_id is not null")
    named = sketched.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("first"))
    return docs, sketched, named, spark.createDataFrame([], "node long, component long")


@pytest.mark.parametrize("words, units", [(3, (90, 100)), (5, (80, 100)), (1, (60, 100))])
def test_matrix_alone_finds_every_component(spark, words, units):
    """Without the families of the first pass the matrix must still miss nothing."""
    texts = near_copies(5)
    docs, sketched, named, none = matrix_parts(spark, texts, words, units)
    links = ngram_join.matrix_links(docs, sketched, named, none, words, units, block=16)
    top = {r["node"]: r["component"] for r in components(links).collect()}
    found = collections.defaultdict(set)
    for r in sketched.filter("n > 0").collect():
        found[top.get(r["node"], r["node"])].add(r["doc_id"])
    expected = collections.defaultdict(set)
    for n, (size, component) in brute_components(texts, words, units).items():
        if size:
            expected[component].add(n)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, expected.values()))


def test_stored_unions_rule_queries_out(spark):
    """Groups are opened only if their stored union of tokens, within a group that of two members, could hold a link."""
    common = " ".join(f"c{k}" for k in range(12))
    texts = [f"{common} " + " ".join(f"{n}x{k}" for k in range(8)) for n in range(60)] + [f"{common} " + " ".join(f"0x{k}" for k in range(7)) + " y"]
    docs, sketched, named, none = matrix_parts(spark, texts, 1, (80, 100))
    seen = []
    original = ngram_join.opened

    def watched(asked, members, units):
        seen.append(ngram_join.materialise(original(asked, members, units), "watched"))
        return seen[-1]

    ngram_join.opened = watched
    try:
        links = ngram_join.matrix_links(docs, sketched, named, none, 1, (80, 100), block=16)
    finally:
        ngram_join.opened = original
    counts = {r["open"]: r["count"] for r in seen[0].groupBy("open").count().collect()}
    assert counts[False] > counts[True] > 0
    assert links.count() == 1


def test_keep_one_of_repeated_rows(spark):
    text, other = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(3, text, 1), (3, text, 1), (1, other, 2), (3, other, 3), (5, text, 4), (None, text, 5), (7, "", 6), (7, "", 6), (8, None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, same long").withColumnRenamed("same", "n")
    kept = sorted((r["doc_id"] or 0, r["text"] or "", r["n"]) for r in ngram_join.keep_one(docs).collect())
    assert kept == sorted([(3, text, 1), (1, other, 2), (0, text, 5), (7, "", 6), (7, "", 6), (8, "", 7)])


def test_ngram_join_of_nothing(spark):
    assert ngram_join.join(empty(spark)).count() == 0
    assert ngram_join.keep_one(empty(spark)).count() == 0


def test_components(spark):
    rnd = random.Random(4)
    edges = [(n, n + 1) for n in range(60)] + [(100, n) for n in range(101, 140)] + [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(40)]
    root = {n: n for e in edges for n in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: c for n, c in root.items() if n != c}


def base_of(text):
    text, out, counts = text or "", [], []
    patterns = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
    for kind, pattern in patterns:
        before = len(out)
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(d if n % 2 == 0 else d * 2 - 9 * (d > 4) for n, d in enumerate(map(int, reversed(digits)))) % 10
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(digits) <= 19 and luhn == 0, "phone": 9 <= len(digits) <= 15}
            if ok[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
        counts.append(len(out) - before)
    return counts, ",".join(out)


def test_pii_base_equals_brute_force(spark):
    rnd = random.Random(3)
    parts = ["a.b", "@", "x", "1", "23", " ", "-", ".", "+1", " (", "4", "0", "255", "256", "@c.de", "_", "%", "😀", "é", "4111 1111-1111 1111", "4111111111111111", "1.2.3.4", "+1 555 123 45678", "\x01", "\n"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(1500)] + ODD_TEXTS + ["1 " * 20000, "a@" + "b." * 10000 + "c", "x" * 50000]
    rows = pii.find(docs_of(spark, texts)).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        counts, listed = base_of("row without id" if r["doc_id"] is None else texts[r["doc_id"]])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == counts
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest() and r["spans"].startswith(listed)


def test_pii_terms_follow_disclosure(spark):
    told = [(n, f"filler{n} word{n} zorblax reach joe@corp.com now", "s") for n in range(4)]
    rest = [(10 + n, f"plain{n} reach the text now {n}", "s") for n in range(300)]
    copies = [(400 + n, "copied quux near ann@corp.com", "s") for n in range(5)]
    docs = spark.createDataFrame(told + rest + copies, "doc_id long, text string, source string").withColumn("n_chars", F.length("text"))
    found = {r["doc_id"]: r["spans"] for r in pii.find(docs).collect()}
    start = told[0][1].index("zorblax")
    assert f"removed:{start}:{start + 7}" in found[0] and "removed" not in found[400]
    clean = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pii.sanitise(docs).collect()}
    assert clean[0][0] == "filler0 word0  reach [EMAIL] now" and clean[0][1] == len(clean[0][0])
    assert clean[400][0] == "copied quux near [EMAIL]" and clean[10][0] == rest[0][1]
    assert len(clean) == 309 and pii.sanitise(empty(spark)).count() == 0 and pii.find(empty(spark)).count() == 0


def test_license_base_equals_brute_force(spark):
    rnd = random.Random(2)
    parts = ["under", "the", "THE", "mit", "MIT", "license", "apache", "License,", "version", "2", "2.0", "cc", "by", "nc", "CC BY-NC", "x", "é", "😀", "--", "."]
    texts = [rnd.choice([" ", "-", ". "]).join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(1200)]
    texts += ["Released under the MIT License.", "x under  the\nmit-license cc_by_nc", "under the mit licenseé", *ODD_TEXTS]
    rows = licenses.license_scan(docs_of(spark, texts)).collect()
    for r in rows:
        text = "row without id" if r["doc_id"] is None else texts[r["doc_id"]] or ""
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        places = [(i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert licenses.license_scan(empty(spark)).count() == 0


@pytest.mark.parametrize(
    "text, labels",
    [
        ("Licensed under the GNU General Public License, version 3.", "gpl-3"),
        ("SPDX-License-Identifier: MIT", "mit"),
        ("Distributed under the GNU Affero General Public License version 3.", "agpl-3"),
        ("Released under the BSD 3-Clause License", "bsd-3-clause"),
        ("license: Apache-2.0", "apache-2"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit"),
        ("All rights reserved.", "all-rights-reserved"),
        ("Use is covered by the MIT\n * license of", "mit"),
        ("the mit  license", "mit"),
        ("He works under the license of nobody", ""),
    ],
)
def test_license_rules(spark, text, labels):
    rows = licenses.license_scan(spark.createDataFrame([(1, text), (2, "x " * 400 + text)], "doc_id long, text string")).collect()
    assert [r["labels"] for r in rows] == [labels, labels]


def brute_labels(text):
    """Every rule on the whole normalised text, without gates or windows, and suppression pair by pair."""
    low = re.sub(r"\s++(?:(?:[#*;%]++|//++)\s++)*+", " ", (text or "").lower(), flags=re.ASCII)
    hits = [(m.start(), m.end(), r["p"], r["n"], r["label"]) for r in licenses.rules() for m in re.finditer(r["re"], low, flags=re.ASCII)]
    better = lambda o, x: o[2] < x[2] or (o[2] == x[2] and (o[1] - o[0] > x[1] - x[0] or (o[1] - o[0] == x[1] - x[0] and o[3] < x[3])))
    return ",".join(sorted({x[4] for x in hits if not any(o[0] <= x[0] and o[1] >= x[1] and better(o, x) for o in hits)}))


def sample_of(expression):
    """A text that an expression matches: its plain reading, the first of alternatives, options left out."""
    text, old = expression, None
    while text != old:
        old = text
        text = re.sub(r"\(\?[!<=]+[^()]*\)", "", text)
        text = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)\??(?:\{0,\d+\})?", lambda m: "" if m[0].endswith(("?", "}")) else m[1], text.replace("\\(", "\0").replace("\\)", "\1"))
    text = re.sub(r"\.\{\d+,\d+\}\??|\[\^\.\]\{\d+,\d+\}", "x", text)
    text = re.sub(r"\[([^]])[^]]*\](\?)?", lambda m: "" if m[2] else m[1], text)
    text = re.sub(r"\\[bd]", lambda m: "0" if m[0][1] == "d" else "", re.sub(r".\?", lambda m: "" if m[0].endswith("?") else m[0], text, flags=re.DOTALL) if False else text)
    text = re.sub(r"(\\.|[^\\])\?", "", text)
    return text.replace("\0", "(").replace("\1", ")").replace("\\.", ".").replace("\\+", "+").replace("\\*", "*")


def test_license_labels_equal_brute_force(spark):
    rnd = random.Random(9)
    samples = [sample_of(expression) for _, expression, *_ in licenses.signatures()]
    matched = [re.search(e, t, flags=re.ASCII) is not None for (_, e, *_), t in zip(licenses.signatures(), samples, strict=True)]
    assert sum(matched) > 0.9 * len(matched)
    texts = [t.upper() for t in samples] + ["x" * 500 + " " + t.replace(" ", "\n  * ") + " y" for t in samples] + [t[1:] for t in samples] + [t[:-1] + "q" for t in samples]
    names = ["the MIT", "gpl v2", "Apache 2.0", "GNU  Lesser General Public License, version 2.1", "CC BY-NC-SA", "bsd 3-clause", "mozilla public license 2.0", "commercial"]
    ways = ["licensed under {}", "the {} license", "{}\nlicense", "License: {}", "SPDX-License-Identifier: {}", "under the terms of\n// {}", "re{}"]
    texts += [" ".join(rnd.choice([rnd.choice(ways).format(rnd.choice(names)), "filler " * rnd.randint(0, 90), rnd.choice(samples)]) for _ in range(rnd.randint(1, 8))) for _ in range(300)]
    got = {r["doc_id"]: set(filter(None, r["labels"].split(","))) - set(filter(None, r["base_labels"].split(","))) for r in licenses.license_scan(docs_of(spark, texts)).collect()}
    wrong = [(t, got[n], brute_labels(t)) for n, t in enumerate(texts) if not got[n] <= set(brute_labels(t).split(",")) or set(filter(None, brute_labels(t).split(","))) - got[n] - {label for _, label in licenses.BASE}]
    assert not wrong, (len(wrong), wrong[:2])


def test_license_rules_are_bounded_and_hold_their_literals():
    assert len(licenses.signatures()) > 150 and licenses.reach() < 400
    assert all(rule["gates"] and rule["keys"] for rule in licenses.rules())


@pytest.mark.parametrize("leaf_rows", [3, 4096])
def test_mixing(spark, leaf_rows):
    rnd = random.Random(6)
    rows = [(n, "w " * rnd.choice([0, 1, 5, 50, 400]), rnd.choice(["a", "b", "c", "d", "e", None, "hot", "hot", "hot"])) for n in range(400)] + [(7, "again again", "a")] * 3 + [(None, None, "only")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mixing.mix(docs, leaf_rows=leaf_rows).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    left, target, total = dict(zip(order, [3, 1, 2] * 9, strict=False)), {}, 1.5 * sum(sizes.values())
    while True:
        level = (total - sum(target.values())) / sum(left.values())
        full = [s for s in left if level * left[s] >= 2 * sizes[s]]
        if not full:
            break
        for s in full:
            target[s] = 2 * sizes[s]
            del left[s]
    target |= {s: level * w for s, w in left.items()}
    taken = collections.Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in order:
        assert abs(taken[s] - target[s]) <= 1
    again = mixing.mix(docs.repartition(5), leaf_rows=leaf_rows).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_pivotal_keeps_words_and_expectations():
    rnd, sizes, fractions = random.Random(8), [3, 10, 1, 7, 20], [0.3, 0.6, 0.5, 0.2, 0.8]
    means = np.zeros(5)
    for _ in range(4000):
        out, held = mixing.pivotal(sizes, fractions, [rnd.random() for _ in range(5)])
        assert sum(s * x for s, x in zip(sizes, out, strict=True)) == pytest.approx(sum(s * x for s, x in zip(sizes, fractions, strict=True)))
        assert all(x in (0.0, 1.0) for k, x in enumerate(out) if k != held)
        means += out
    assert np.abs(means / 4000 - fractions).max() < 0.04


def test_apply_mix_takes_what_the_mix_says(spark):
    docs = spark.createDataFrame([(n, f"a{n} b  c\nd " * (n % 5 + 1), f"s{n % 4}", None, n) for n in range(60)] + [(1, "a1 b  c\nd a1 b  c\nd ", "s1", None, 1)] * 2, "doc_id long, text string, source string, lang string, n_chars long")
    taken = collections.Counter()
    for r in mixing.mix(docs).collect():
        taken[r["doc_id"]] += r["taken"]
    out = mixing.apply_mix(docs)
    found = collections.Counter()
    for r in out.collect():
        found[r["doc_id"]] += len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    assert out.columns == docs.columns and +found == +taken
    assert mixing.apply_mix(empty(spark)).count() == 0


def test_embeddings_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x = unit(rng.normal(size=(600, 64)))
    side = rng.normal(size=x.shape)
    side = unit(side - (side * x).sum(axis=1, keepdims=True) * x)
    dense = unit(x[:1] + 0.02 * rng.normal(size=(200, 64)))
    vectors = np.vstack([x, 0.951 * x + np.sqrt(1 - 0.951**2) * side, dense, x[:20]]).astype(np.float32)
    rows = [(n, v.tolist()) for n, v in enumerate(vectors)]
    odd = [(9000, None), (9001, [0.0] * 64), (9002, [float("nan")] * 64), (None, [1.0] * 64), (9003, [1.0, 2.0]), (9004, [2.0, 4.0]), (9005, []), (9006, [None, 1.0])]
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>"), block=64).collect()}
    v = unit(vectors.astype(np.float64))
    links = (v @ v.T >= 0.95).sum(axis=1) - 1
    mine = np.array([got[n]["n_links"] for n in range(len(v))])
    assert (mine <= links).all() and mine.sum() >= 0.95 * links.sum()
    assert got[9004]["component_id"] == 9003 and got[9004]["n_links"] == 1 and not got[9004]["kept"]
    assert all(got[n]["n_links"] == 0 and got[n]["kept"] for n in (9000, 9001, 9002, 9005, 9006))
    assert got[None]["component_id"] is None and not got[None]["kept"]
    assert embeddings.near_duplicates(empty(spark, "vec_id long, embedding array<float>")).count() == 0


def test_embeddings_all_alike(spark):
    rng = np.random.default_rng(2)
    rows = [(n, v.tolist()) for n, v in enumerate(1 + 0.01 * rng.normal(size=(50, 8)))]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=16).collect()
    assert {r["component_id"] for r in got} == {0} and min(r["n_links"] for r in got) == 49


def synthetic_texts(seed=0):
    rnd = random.Random(seed)
    syllables = {"en": ["th", "ing", "er", "on"], "fr": ["eau", "que", "ou", "é"], "de": ["sch", "ein", "ung", "ü"]}
    for n in range(600):
        lang = rnd.choice(list(syllables))
        words = ["".join(rnd.choice(syllables[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(5, 60))]
        yield n, lang, words, rnd


def test_language_id(spark):
    rows = [(n, " ".join(words), lang) for n, lang, words, _ in synthetic_texts()] + [(n + 1000, t, "en" if n % 2 else None) for n, t in enumerate(ODD_TEXTS)] + [(None, "thing", "en")]
    got = {r["doc_id"]: r for r in langid.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    held = [n for n in range(600) if zlib.crc32(str(n).encode()) % 5 == 0]
    assert all(got[n]["held_out"] == (n in set(held)) for n in range(600))
    assert np.mean([got[n]["lang_pred"] == rows[n][2] for n in held]) > 0.97
    for n, t in enumerate(ODD_TEXTS):
        assert (got[n + 1000]["lang_pred"] == "und") == (not any(c.isalpha() for c in t or "")) and 0 <= got[n + 1000]["score"] <= 1
    assert langid.language_id(empty(spark)).count() == 0


def test_language_id_without_labels(spark):
    got = langid.language_id(spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)]


def toxic_corpus(spark):
    rows, labels = [], []
    for n, _, words, rnd in synthetic_texts(1):
        toxic = rnd.random() < 0.2
        if toxic:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(["Grobian", "blockhead", "rotter", "blockheads!"]))
        rows.append((n, " ".join(words), toxic))
        if rnd.random() < 0.6:
            labels.append((n, int(toxic)))
    docs = spark.createDataFrame([(n, t) for n, t, _ in rows] + [(1000 + n, t) for n, t in enumerate(ODD_TEXTS)] + [(None, "no id")], "doc_id long, text string")
    return rows, docs, spark.createDataFrame(labels + [(5, None), (None, 1)], "doc_id long, toxic int")


def test_toxicity(spark):
    rows, docs, labels = toxic_corpus(spark)
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == 600 + len(ODD_TEXTS) + 1
    held = [(got[n]["predicted"], toxic) for n, _, toxic in rows if zlib.crc32(str(n).encode()) % 3 == 1]
    assert all(got[n]["held_out"] == (zlib.crc32(str(n).encode()) % 3 == 1) for n in range(600))
    assert np.mean([p for p, t in held if t]) > 0.95 and np.mean([p for p, t in held if not t]) < 0.02
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {n for n, r in got.items() if not r["predicted"]}


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    docs = docs_of(spark, ODD_TEXTS)
    assert {r["score"] for r in toxicity.toxicity(docs, none).collect()} == {0.0}
    assert toxicity.keep_clean(docs, none).count() == len(ODD_TEXTS) + 1
    assert toxicity.keep_clean(empty(spark), none).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, name):
    import duckdb

    c = duckdb.connect()
    for table in ("documents", "embeddings"):
        c.execute(f"create view {table} as select * from '/root/testdata/sf0.001/{table}.parquet'")
    ours, theirs = queries.QUERIES[name](spark, "/root/testdata/sf0.001"), c.sql(queries.ORACLE[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert sorted(map(str, ours.select(*theirs.columns).toPandas().itertuples(index=False, name=None))) == sorted(map(str, theirs.df().itertuples(index=False, name=None)))
