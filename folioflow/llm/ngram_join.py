"""Operator 1: n-gram Jaccard join by a token-group matrix.

A document's set holds its distinct word shingles as 64-bit hashes; documents of equal sets are one
node. Two nodes link if intersection / union reaches the threshold. The join finds every link between
unlike nodes that matters for the components, in two passes.

*Families.* Each node has a few keys of two min-hashes, and is compared with the smallest of the nodes that
share one with it; links make families of similar nodes. This pass is linear and need not be complete.

*Candidates.* Tokens are made so that a link cannot do without one. Sizes fall into classes such that linked
nodes are of the same or of neighbouring classes; for each level of two classes let k be the largest
symmetric difference that linked sets can have. The shingles are dealt by hash into k + 1 + x buckets; k
differences touch k buckets at most, so 1 + x buckets at least are equal, and a bucket's content is a token.
Empty buckets make no token; a node with more than x of them has its smallest shingles as further tokens, as
many as two linked sets cannot both have without a common one. One shuffle by token keeps those that stand
in several nodes, and of these the ones that stand in several families.

*Token-group matrix.* The nodes with such tokens are partitioned into groups of alike ones, and each group's
union of tokens is stored: the matrix of tokens and groups. Every node is a query against the groups that
hold a token of its own. A link leaves so many buckets of a level equal that the query must overlap the
group's union by a number of tokens that follows from its size, its empty buckets and the largest size in the
group (in its own group only tokens of two members count). Groups that are not overlapped by so much are ruled
out; the others are opened: their members' shingles are compared with those of the queries that opened them.
Links, thinned to a spanning forest, are all that comes back.

So large sets of near copies are settled by the first pass in linear time, and pairs of nodes are never
listed. The rest are joins and aggregations with map-side partial sums; keys that hold a large share of the
rows are broadcast (at most a thousand), hubs' sets are replicated by the number of their members. Shingling
and comparing run in numpy, the matrix is a join and a count.

Defined results: a text without words is empty and links with nothing, as does a null text; with fewer
words than a shingle has, the whole sequence is the one shingle; a row with null doc_id links with
nothing and has a null component_id; rows that repeat are copies of one another, of which ``keep_one`` keeps
one; unlike texts of one doc_id are judged each for itself; an empty table gives no row. Other columns are
ignored by ``join`` and kept by ``keep_one``. Words, shingles and nodes are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import chunks, heavy_join, materialise, ragged
from folioflow.llm.components import components
from folioflow.llm.words import code_points, mix64, word_hashes

WORDS = 3
#: Code points shingled at once: a worker holds about 100 bytes for each.
SHINGLED_AT_ONCE = 300_000
#: Intersection * UNITS[1] >= UNITS[0] * union.
UNITS = (90, 100)
KEYS = 3
#: About how many nodes a group has at most, and how many queries are compared with a group at once.
BLOCK = 128
#: About how many members a copy of a hub's set serves.
HUB_ROWS = 512
_SALTS = mix64(np.arange(1, 2 * KEYS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(texts: list[str | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all texts, sorted within each, and where each text's begin (one more at the end)."""
    points, owner = code_points([t or "" for t in texts])
    points = np.where((points >= 65) & (points <= 90), points + 32, points)
    inside = ~((points == 0x20) | ((points >= 9) & (points <= 13)))
    begin, hashes = word_hashes(points, inside)
    rows = owner[begin]
    held = np.bincount(rows, minlength=len(texts))
    many = rows[: len(rows) - words + 1] == rows[words - 1 :] if len(rows) >= words else np.zeros(0, dtype=bool)
    at = np.flatnonzero(many)
    value = np.zeros(len(at), dtype=np.uint64)
    for k in range(words):
        value = mix64(value + hashes[at + k] + np.uint64(k + 1))
    out_rows = rows[at]
    short = np.flatnonzero((held > 0) & (held < words))
    if len(short):
        firsts = np.searchsorted(rows, short)
        extra = np.full(len(short), 0x5851F42D4C957F2D, dtype=np.uint64)
        for k in range(words - 1):
            there = k < held[short]
            step = mix64(extra + hashes[np.where(there, firsts + k, 0)] + np.uint64(100 + k))
            extra = np.where(there, step, extra)
        out_rows, value = np.concatenate([out_rows, short]), np.concatenate([value, extra])
    order = np.lexsort((value, out_rows))
    out_rows, value = out_rows[order], value[order]
    first = np.ones(len(value), dtype=bool)
    first[1:] = (out_rows[1:] != out_rows[:-1]) | (value[1:] != value[:-1])
    out_rows, value = out_rows[first], value[first]
    return value, np.searchsorted(out_rows, np.arange(len(texts) + 1))


class Levels:
    """Size classes: for each level, the number of buckets and of empty ones that are forgiven.

    Level j serves links within class j and between classes j and j + 1.
    """

    def __init__(self, units: tuple[int, int] = UNITS):
        self.part, self.whole = units
        self.bounds, self.buckets, self.spare = [1], [], []

    def _extend(self, size: int) -> None:
        while len(self.bounds) < 4 or self.bounds[-3] <= size:
            self.bounds.append(self.bounds[-1] * self.whole // self.part + 1)
        for j in range(len(self.buckets), len(self.bounds) - 2):
            k = (self.bounds[j + 1] + self.bounds[j + 2] - 2) * (self.whole - self.part) // (self.whole + self.part)
            empty = (k + 1) * np.exp(-self.bounds[j] / (k + 1))  # as many as the smallest sets of the level leave on average
            spare = 1 + int(empty + 4 * empty**0.5)
            self.buckets.append(k + 1 + spare if k else 0)
            self.spare.append(spare)

    def of(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The class of each size, and by level the numbers of buckets and of spare ones. A level without buckets links equal sets only."""
        self._extend(int(sizes.max(initial=1)))
        return np.searchsorted(self.bounds, sizes, side="right") - 1, np.array(self.buckets), np.array(self.spare)

    def largest(self, sizes: np.ndarray, below: int) -> np.ndarray:
        """The largest size that can link with a set at its own level (0), or at the level below its class (1)."""
        bounds = np.array(self.bounds)
        at = np.searchsorted(self.bounds, sizes, side="right") - 1
        return bounds[at] - 1 if below else np.minimum(bounds[at + 2] - 1, sizes * self.whole // self.part)

    def prefix(self, sizes: np.ndarray) -> np.ndarray:
        """How many of a set's smallest shingles must hold one of a linked set's."""
        return sizes - (sizes * self.part + self.whole - 1) // self.whole + 1


def bucket_tokens(values: np.ndarray, bounds: np.ndarray, levels: Levels) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate tokens of all sets one after the other, where each set's begin, and four numbers a set.

    A token's two lowest bits tell its kind: 0 and 1 for a bucket of an even and of an odd level, 2 for a
    shingle. The numbers are, for either kind of level, the buckets that are filled and the largest size
    with which the set can link there: of the filled buckets all but as many as shingles differ are equal.
    """
    sizes = np.diff(bounds)
    n = len(sizes)
    owner = np.repeat(np.arange(n), sizes)
    classes, buckets, spare = levels.of(sizes)
    spread, content = mix64(values ^ np.uint64(0xD1B54A32D192ED03)), mix64(values ^ np.uint64(0x8CB92BA72F3D8DD7))
    rows, tokens = [], []
    sparse = np.zeros(n, dtype=bool)
    room = np.zeros((n, 4), dtype=np.int64)
    kind = lambda x, tag: x & ~np.uint64(3) | tag
    for below in (0, 1):
        level = classes - below
        used = (sizes > 0) & (level >= 0)
        m = np.where(used, buckets[np.maximum(level, 0)], 0)
        base = np.cumsum(m) - m
        total = int(m.sum())
        mine = m[owner] > 0
        slot = base[owner[mine]] + ((spread[mine] >> np.uint64(32)) * m[owner[mine]].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        sums = np.zeros(total, dtype=np.uint64)
        np.add.at(sums, slot, content[mine])
        filled = np.bincount(slot, minlength=total) > 0
        who = np.repeat(np.arange(n), m)
        place = np.arange(total) - base[who]
        sparse |= np.bincount(who[~filled], minlength=n) > np.where(m > 0, spare[np.maximum(level, 0)], n + 1)
        label = mix64((level[who].astype(np.uint64) << np.uint64(32)) + place.astype(np.uint64) + np.uint64(1))
        rows.append(who[filled])
        tokens.append(kind(mix64(sums + label), (level[who] & 1).astype(np.uint64))[filled])
        odd = level & 1
        room[np.arange(n), 2 * odd] = np.bincount(who[filled], minlength=n)
        room[np.arange(n), 2 * odd + 1] = levels.largest(np.maximum(sizes, 1), below)
    some = np.flatnonzero(sparse)
    first = ragged(bounds[:-1][some], levels.prefix(sizes[some]))
    rows.append(owner[first])
    tokens.append(kind(mix64(values[first] ^ np.uint64(0xA0761D6478BD642F)), np.uint64(2)))
    rows, tokens = np.concatenate(rows), np.concatenate(tokens)
    order = np.argsort(rows, kind="stable")
    return tokens[order], np.searchsorted(rows[order], np.arange(n + 1)), room


def set_nodes(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set, by two sums over its members and its size."""
    sizes = np.diff(bounds)
    some = sizes > 0
    out = np.zeros(len(sizes), dtype=np.uint64)
    starts = bounds[:-1][some]
    if len(starts):
        one = np.add.reduceat(mix64(values + np.uint64(0x2545F4914F6CDD1D)), starts)
        two = np.add.reduceat(mix64(values ^ np.uint64(0xE7037ED1A0B428DB)), starts)
        out[some] = mix64(mix64(one) + two + sizes[some].astype(np.uint64))
    return out.view(np.int64)


def group_keys(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """KEYS keys of each set, each of two min-hashes."""
    sizes = np.diff(bounds)
    some = sizes > 0
    out = np.zeros((len(sizes), KEYS), dtype=np.uint64)
    starts = bounds[:-1][some]
    if len(starts):
        least = [np.minimum.reduceat(mix64(values ^ salt), starts) for salt in _SALTS]
        for k in range(KEYS):
            out[some, k] = mix64(least[2 * k] + mix64(least[2 * k + 1] + np.uint64(k)))
    return out.view(np.int64)


def _lists(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.view(np.int64)))


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def sketch(docs: DataFrame, words: int = WORDS, units: tuple[int, int] = UNITS) -> DataFrame:
    """doc_id, same (hash of the text), n (set size), node, keys, tokens and room of every row; keys and tokens once a node and task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = Levels(units)
        met: set[int] = set()
        for batch in chunks(batches, "text", SHINGLED_AT_ONCE):
            values, bounds = shingle_sets(batch.column("text").to_pylist(), words)
            sizes, nodes = np.diff(bounds), set_nodes(values, bounds)
            fresh = np.zeros(len(nodes), dtype=bool)
            fresh[np.unique(nodes, return_index=True)[1]] = True
            fresh &= (sizes > 0) & ~np.fromiter((x in met for x in nodes.tolist()), dtype=bool, count=len(nodes))
            met.update(nodes[fresh].tolist())
            values, bounds = values[np.repeat(fresh, sizes)], np.concatenate([[0], np.cumsum(np.where(fresh, sizes, 0))])
            tokens, cuts, room = bucket_tokens(values, bounds, levels)
            rooms = pa.ListArray.from_arrays(pa.array(np.arange(0, 4 * len(nodes) + 1, 4, dtype=np.int32)), pa.array(room.reshape(-1)))
            keys, key_cuts = group_keys(values, bounds)[fresh], np.concatenate([[0], np.cumsum(fresh * KEYS)])
            columns = [batch.column("doc_id"), batch.column("same"), pa.array(sizes), pa.array(nodes), _lists(keys.reshape(-1), key_cuts), _lists(tokens, cuts), rooms]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "same", "n", "node", "keys", "tokens", "room"])

    hashed = _plain(docs).select("doc_id", F.xxhash64("text").alias("same"), "text")
    return hashed.mapInArrow(task, "doc_id long, same long, n long, node long, keys array<long>, tokens array<long>, room array<long>")


def sets_of(docs: DataFrame, named: DataFrame, nodes: DataFrame, words: int = WORDS) -> DataFrame:
    """(node, n, set) of the wanted nodes (node), each from the text of its smallest doc_id; ``named``: node, first (that doc_id)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", SHINGLED_AT_ONCE):
            values, bounds = shingle_sets(batch.column("text").to_pylist(), words)
            yield pa.RecordBatch.from_arrays([pa.array(set_nodes(values, bounds)), pa.array(np.diff(bounds)), _lists(values, bounds)], names=["node", "n", "set"])

    # Written, so that Spark knows its size and need not shuffle the texts where it is small.
    wanted = materialise(named.join(nodes, "node", "left_semi").select("node", F.col("first").alias("doc_id")), "wanted")
    texts = _plain(docs).join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").select("text")
    found = texts.mapInArrow(task, "node long, n long, set array<long>")
    return found.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _reaches(overlap, a, b, units: tuple[int, int]):
    return overlap * units[1] >= (a + b - overlap) * units[0]


def linked(pairs: DataFrame, sets: DataFrame, units: tuple[int, int] = UNITS) -> DataFrame:
    """The pairs (u, v) that link, of ``pairs`` (u, v, part): members u of hubs v, whose sets are replicated once a part."""
    left = sets.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("set").alias("su"))
    right = sets.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("set").alias("sv"))
    hubs = pairs.select("v", "part").distinct().join(right, "v")
    met = pairs.join(left, "u").join(hubs, ["v", "part"])
    overlap = F.size(F.array_intersect("su", "sv"))
    return met.filter(_reaches(overlap, F.col("nu"), F.col("nv"), units)).select("u", "v")


def family_links(docs: DataFrame, sketched: DataFrame, named: DataFrame, words: int, units: tuple[int, int]) -> DataFrame:
    """First pass: links of nodes with the smallest node that shares a key, one hub a node."""
    keyed = sketched.select("node", F.col("n").alias("nu"), F.explode("keys").alias("key"))
    least = F.min(F.struct("node", F.col("nu").alias("n")))
    hubs = keyed.groupBy("key").agg(least.alias("hub"), F.max("node").alias("other"), F.count("*").alias("members"))
    hubs = materialise(hubs.filter("hub.node <> other").select("key", F.col("hub.node").alias("v"), F.col("hub.n").alias("nv"), "members", F.col("members").alias("rows")), "hubs")
    met = heavy_join(keyed, hubs, "key", "rows", "inner").filter("node <> v")
    met = met.filter(F.least("nu", "nv") * units[1] >= F.greatest("nu", "nv") * units[0])
    chosen = met.groupBy(F.col("node").alias("u")).agg(F.min(F.struct("v", (-F.col("members")).alias("m"))).alias("hub"))
    part = F.pmod(F.xxhash64("u"), F.ceil(-F.col("hub.m") / HUB_ROWS))
    pairs = materialise(chosen.select("u", F.col("hub.v").alias("v"), part.alias("part")), "pairs")
    wanted = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    return materialise(linked(pairs, materialise(sets_of(docs, named, wanted, words), "sets"), units), "family-links")


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> list[int]:
    """Numbers of the edges of a spanning forest of the edges (a, b) over n places."""
    root, out = list(range(n)), []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append(k)
    return out


def member_links(queries: list[int], members: list[int], sets: list[np.ndarray], groups: np.ndarray, units: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Places (u, v) of the links between queries and members of unlike families."""
    postings = np.concatenate([sets[m] for m in members])
    owner = np.repeat(np.arange(len(members)), [len(sets[m]) for m in members])
    order = np.argsort(postings, kind="stable")
    postings, owner = postings[order], owner[order]
    sizes, places = np.array([len(sets[m]) for m in members]), np.array(members)
    left, right = [], []
    for q in queries:
        own = sets[q]
        first, last = np.searchsorted(postings, own, side="left"), np.searchsorted(postings, own, side="right")
        overlap = np.bincount(owner[ragged(first, last - first)], minlength=len(members))
        hit = (overlap * units[1] >= (len(own) + sizes - overlap) * units[0]) & (groups[places] != groups[q])
        left.append(np.full(int(hit.sum()), q))
        right.append(places[hit])
    empty = np.zeros(0, dtype=np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (empty, empty)


def _sets(column: pa.Array) -> list[np.ndarray]:
    cuts, flat = np.asarray(column.offsets), np.asarray(column.values)
    return [flat[x:y] for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def _by_pair(dealt: DataFrame, marks: tuple[str, str], one, schema: str) -> DataFrame:
    """What ``one`` makes of the rows (an Arrow table) of each pair of marks; pairs are dealt over the tasks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            found = np.stack([np.asarray(batch.column(c)) for c in marks])
            cuts = np.concatenate([[0], np.flatnonzero((found[:, 1:] != found[:, :-1]).any(axis=0)) + 1, [batch.num_rows]])
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                mark = tuple(found[:, x].tolist())
                if mark != last and held:
                    yield from one(pa.Table.from_batches(held).combine_chunks())
                    held = []
                held.append(batch.slice(x, y - x))
                last = mark
        if held:
            yield from one(pa.Table.from_batches(held).combine_chunks())

    return dealt.repartition(*marks).sortWithinPartitions(*marks).mapInArrow(task, schema)


def pair_links(dealt: DataFrame, units: tuple[int, int]) -> DataFrame:
    """Links (u, v) between queries and members of opened groups, of rows (b, part, query, node, family, set); of each part a spanning forest."""

    def one(table: pa.Table) -> Iterator[pa.RecordBatch]:
        node, families, query = (np.asarray(table.column(c).combine_chunks()) for c in ("node", "family", "query"))
        sets = _sets(table.column("set").combine_chunks())
        u, v = member_links(np.flatnonzero(query).tolist(), np.flatnonzero(~query).tolist(), sets, families, units)
        if len(u):
            names, places = np.unique(node, return_inverse=True)
            tree = _roots(len(names), places[u], places[v])
            yield pa.RecordBatch.from_arrays([pa.array(node[u[tree]]), pa.array(node[v[tree]])], names=["u", "v"])

    return _by_pair(dealt.withColumn("query", F.col("query").cast("boolean")), ("b", "part"), one, "u long, v long")


def candidates(sketched: DataFrame, families: DataFrame) -> DataFrame:
    """(token, node, family, hub): the tokens that stand in several families; ``hub`` is the smallest of them."""
    entries = sketched.select("node", F.explode("tokens").alias("token"))
    same = Window.partitionBy("token")
    shared = entries.withColumn("least", F.min("node").over(same)).withColumn("most", F.max("node").over(same)).filter("least <> most")
    shared = materialise(shared.select("token", "node").distinct(), "shared")
    named = shared.join(families, "node", "left").withColumn("family", F.coalesce("component", "node")).drop("component")
    ends = named.groupBy("token").agg(F.min("family").alias("hub"), F.max("family").alias("other"), F.count("*").alias("rows")).filter("hub <> other").drop("other")
    return materialise(heavy_join(named, materialise(ends, "tokens"), "token", "rows", "inner"), "candidates")


def overlaps(cells: DataFrame, members: DataFrame) -> DataFrame:
    """(a, node, b, even, odd, single): by how many tokens of each kind the node, of group a, overlaps the stored union of group b.

    Of two groups only one asks the other. Within a group only tokens of two members count.
    """
    placed = cells.select("token", "node").join(members.select("node", "grp"), "node")
    unions = materialise(placed.groupBy("token", "grp").agg(F.count("*").alias("held")), "unions")
    kind = F.col("token").bitwiseAND(F.lit(3))
    met = placed.withColumnRenamed("grp", "a").join(unions.withColumnRenamed("grp", "b"), "token").filter("a < b or (a = b and held > 1)")
    return met.groupBy("a", "node", "b").agg(F.count_if(kind == 0).alias("even"), F.count_if(kind == 1).alias("odd"), F.count_if(kind == 2).alias("single"))


def opened(asked: DataFrame, members: DataFrame, units: tuple[int, int]) -> DataFrame:
    """``asked`` (node, b, even, odd, single) with ``open``: could group b hold a member that links with the node?"""
    known = members.select("node", "n", "room")
    tops = members.groupBy(F.col("grp").alias("b")).agg(F.max("n").alias("top"))

    def enough(overlap: str, at: int):
        filled, largest = F.col("room")[at], F.least(F.col("room")[at + 1], F.col("top"))
        differ = F.floor((F.col("n") + largest) * (units[1] - units[0]) / (units[1] + units[0]))
        return F.col(overlap) >= F.greatest(filled - differ, F.lit(1))

    return asked.join(known, "node").join(tops, "b").withColumn("open", enough("even", 0) | enough("odd", 2) | (F.col("single") > 0)).select(*asked.columns, "open")


def matrix_links(docs: DataFrame, sketched: DataFrame, named: DataFrame, families: DataFrame, words: int, units: tuple[int, int], block: int = BLOCK) -> DataFrame:
    """Second pass: links between nodes of unlike families that the token-group matrix does not rule out."""
    cells = candidates(sketched, families)
    # Nodes that meet the same hub are alike; they go into the same groups, whatever their families.
    alike = cells.groupBy("node", "family").agg(F.min("hub").alias("kind"))
    sizes = alike.groupBy("kind").agg(F.count("*").alias("members"))
    sizes = materialise(sizes.withColumn("rows", F.col("members")), "kinds")
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / block))
    members = heavy_join(alike, sizes, "kind", "rows", "inner").select("node", "family", F.xxhash64("kind", part).alias("grp"))
    rooms = sketched.filter(F.size("tokens") > 0).select("node", "n", "room").dropDuplicates(["node"])
    members = materialise(members.join(rooms, "node"), "groups")
    asked = materialise(opened(overlaps(cells, members), members, units), "opened").filter("open")
    rows = asked.groupBy("b").agg(F.count("*").alias("asked"))
    dealt = asked.join(rows, "b").select("b", F.pmod(F.xxhash64("node"), F.ceil(F.col("asked") / block)).alias("part"), "node")
    dealt = materialise(dealt, "asked")
    # Sets are looked up for the queries and for the members of the groups that are opened.
    groups = members.select("node", "family", F.col("grp").alias("b"))
    wanted = dealt.select("node").union(groups.join(dealt.select("b").distinct(), "b", "left_semi").select("node")).distinct()
    sets = materialise(sets_of(docs, named, wanted, words).select("node", "set"), "sets")
    asking = dealt.join(members.select("node", "family"), "node").join(sets, "node").select("b", "part", F.lit(True).alias("query"), "node", "family", "set")
    answering = dealt.select("b", "part").distinct().join(groups.join(sets, "node"), "b").select("b", "part", F.lit(False).alias("query"), "node", "family", "set")
    return materialise(pair_links(asking.unionByName(answering), units), "matrix-links")


def join(docs: DataFrame, words: int = WORDS, units: tuple[int, int] = UNITS) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text)."""
    return labelled(docs, words, units).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def labelled(docs: DataFrame, words: int = WORDS, units: tuple[int, int] = UNITS) -> DataFrame:
    """doc_id, same (hash of the text), n and component_id of every row of ``docs`` (doc_id, text)."""
    sketched = materialise(sketch(docs, words, units), "sketch")
    rows = sketched.select("doc_id", "same", "n", "node")
    able = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    named = materialise(rows.filter(able).groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")), "nodes")
    known = sketched.filter("n > 0").join(named.select("node"), "node", "left_semi") if rows.filter("doc_id is null and n > 0").take(1) else sketched.filter("n > 0")
    first = family_links(docs, known, named, words, units)
    families = components(first)
    second = matrix_links(docs, known, named, families, words, units)
    final = components(first.unionByName(second))
    # The smallest doc_id of every component that has several nodes, then of every node, then of every row.
    grouped = named.join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    tops = grouped.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("nodes"))
    labels = heavy_join(grouped, materialise(tops, "tops"), "component", "nodes", "inner")
    labels = materialise(labels.select("node", "component_id", "rows"), "labels")
    out = heavy_join(rows.withColumn("node", F.when(able, F.col("node"))), labels, "node", "rows")
    return out.select("doc_id", "same", "n", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, words: int = WORDS, units: tuple[int, int] = UNITS) -> DataFrame:
    """One row of each component of ``docs``, that of the smallest doc_id; rows without a doc_id or without words all stay.

    A row is judged by its doc_id and text together; of rows that repeat both, or of unlike texts with the
    smallest doc_id in one component, one of the smallest hash stays. Columns may have any names.
    """
    names = [f"c{k}" for k in range(len(docs.columns))]
    place = dict(zip(docs.columns, names, strict=True))
    key = [F.col(place["doc_id"]).cast("long").alias("doc_id"), F.xxhash64(F.col(place["text"]).cast("string")).alias("same")]
    found = materialise(labelled(docs.select("doc_id", "text"), words, units), "labelled").filter("n > 0 and doc_id is not null")
    least = found.filter("doc_id = component_id").groupBy("component_id").agg(F.min("same").alias("kept"), F.count("*").alias("rows"))
    several = materialise(least.filter("rows > 1").drop("rows"), "several")
    dropped = found.filter("doc_id <> component_id").select("doc_id", "same")
    plain = docs.toDF(*names).select("*", *key)
    if not several.take(1):
        out = plain.join(materialise(dropped.distinct(), "dropped"), ["doc_id", "same"], "left_anti")
        return out.select(*[F.col(n).alias(c) for c, n in place.items()])
    others = found.join(several, "component_id").filter("doc_id = component_id and same <> kept").select("doc_id", "same")
    out = plain.join(materialise(dropped.union(others).distinct(), "dropped"), ["doc_id", "same"], "left_anti")
    repeated = several.select(F.col("component_id").alias("doc_id"), F.col("kept").alias("same"))
    once = out.join(repeated, ["doc_id", "same"], "left_semi").dropDuplicates(["doc_id", "same"])
    out = out.join(repeated, ["doc_id", "same"], "left_anti").unionByName(once)
    return out.select(*[F.col(n).alias(c) for c, n in place.items()])
