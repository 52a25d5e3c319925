"""The alignment of two tokenizers against a plain sweep over each text with the libraries themselves."""

import hashlib
from collections import Counter
from itertools import accumulate

import pytest
from test_token_operators import hostile

from folioflow.llm import queries
from folioflow.llm.alignment import SWEPT, TABLE, align

PATHS = queries.vocabulary(), queries.vocabulary("piece_bpe_32k.model")
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def byte_of():
    """Character of a byte-level vocabulary -> byte: printable ones stand for themselves, the others for 256 and up in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}


def tokens(texts):
    """(ids of A, their bytes, ids of B, their bytes) of every text; None for those without tokens."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b, table = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1]), byte_of()
    a.encode_special_tokens = True
    for text in texts:
        if not text:
            yield None
            continue
        left, right = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        of_left = [bytes(table[c] for c in a.id_to_token(k)) for k in left]
        of_right = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in right]
        same = b"".join(of_left) == b"".join(of_right) == (" " + text).encode()
        yield (left, of_left, right, of_right) if same else None


def brute_force(texts):
    counts, found = Counter(), []
    for one in tokens(texts):
        if one is None:
            found.append(None)
            continue
        left, of_left, right, of_right = one
        ends_a, ends_b = (list(accumulate(map(len, x))) for x in (of_left, of_right))
        common = sorted(set(ends_a) & set(ends_b))
        links, groups, i, j = [], [], 0, 0
        for end in common:
            x, y = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append(",".join(map(str, left[i:x])) + "|" + ",".join(map(str, right[j:y])))
            links.append((left[x - 1], right[y - 1]))
            i, j = x, y
        counts.update(links)
        found.append((len(left), len(right), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return [(*f[:3], len(f[3]), sum(counts[x] == best[x[1]] for x in f[3]), sum(counts[x] for x in f[3]), f[4]) if f else (0, 0, 0, 0, 0, 0, "") for f in found]


@pytest.mark.parametrize("most, swept", [(TABLE, SWEPT), (50, 64), (0, SWEPT)])
def test_all_columns_equal_a_plain_sweep(spark, most, swept):
    """With a table of all pairs, of some, and of none; documents swept whole, and in many steps."""
    texts = [*hostile(700), "long words " * 4000]
    rows = [(None if k == 3 else k, t, 7) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int").repartition(7)
    got = Counter((r["doc_id"], *(r[c] for c in COLUMNS)) for r in align(docs, *PATHS, most, swept).collect())
    assert got == Counter((None if k == 3 else k, *x) for k, x in enumerate(brute_force(texts)))
    assert sum(n for row, n in got.items() if row[1]) > 300


def test_tables_without_tokens(spark):
    assert align(spark.createDataFrame([], "doc_id long, text string"), *PATHS).count() == 0
    rows = align(spark.createDataFrame([(1, None), (1, ""), (2, "▁")], "doc_id long, text string"), *PATHS).collect()
    assert sorted((r["doc_id"], *(r[c] for c in COLUMNS)) for r in rows) == [(1, 0, 0, 0, 0, 0, 0, ""), (1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
