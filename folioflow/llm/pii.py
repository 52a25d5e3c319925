r"""Operator 3: finding and sanitising personal data, in native expressions only.

Base spans are emails, IP addresses, payment cards and phone numbers. On top of them, the corpus decides
which ordinary words give a protected value away. A base span's value is an entity, and the words that
stand within ``window`` words of it are its terms. Over distinct texts,

    disclosure(term, entity) = PMI(entity; term) / IC(entity) = log2(P(e|t) / P(e)) / -log2(P(e))

says how much of the entity's information the term reveals: 1 if the term never occurs without it, 0 if
they are independent. Pairs met in ``min_support`` distinct texts at least count. Terms of at least
``remove_from`` are removed, those of at least ``generalise_from`` are replaced by their category, in the
texts that hold the entity. Copies of a text count once, so that a copied page proves nothing.

Counts cover the whole corpus and are shuffled as partial sums; nothing is collected. Texts and entities that
stand in a large share of the rows are met by a broadcast or dealt over several tasks. Patterns are
written so that Java's matcher neither recurses by the length of a match nor rescans a long run, and a text
takes time in proportion to its length and matches.

Defined results: a null text counts as empty; empty span lists give empty strings (base_sha256 is that of
the empty string); equal texts give equal values; a null doc_id stays; an empty table gives no row.
Other columns, whatever their names, are passed on by ``sanitise`` and ignored by ``find``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import heavy_join, materialise, salted_join
from folioflow.llm.native import SPANS, counted, let, piece, running, spans, text_blocks

KINDS = ("email", "ip", "card", "phone")
#: The kind of spans that the co-occurrence method adds: replaced by a category, or removed.
TERM, DROPPED = "term", "removed"
#: Stand-ins, by which separators inside a value become single characters of a class of their own.
JOINT, FOREIGN = "\x01", "\x02"

EMAIL = rf"(?:\G|(?<![A-Za-z0-9._%+{JOINT}-]))[A-Za-z0-9._%+{JOINT}-]++@[A-Za-z0-9-]++{JOINT}[A-Za-z0-9{JOINT}-]++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = rf"[0-9][0-9{JOINT}]++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
WORDS = r"[\p{L}\p{N}]{3,}"

WINDOW = 6
MIN_SUPPORT = 3
GENERALISE_FROM = 0.8
REMOVE_FROM = 0.95
#: Most terms that go to every executor (about 40 bytes each).
BROADCAST_TERMS = 200_000


def _no_spans() -> Column:
    return F.array().cast(SPANS)


def _joined(text: Column, separator: str, around: str) -> Column:
    """The text with every separator that stands between two characters of ``around`` replaced by JOINT, length unchanged."""
    plain = F.translate(text, JOINT, FOREIGN)
    return F.regexp_replace(plain, F.lit(f"(?<={around}){separator}(?={around})"), F.lit(JOINT))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, F.lit("[^0-9]"), F.lit(""))


def luhn(digits: Column) -> Column:
    """Does a string of digits pass the Luhn check?"""
    n = F.length(digits)

    def weight(i: Column) -> Column:
        digit = F.substr(digits, i, F.lit(1)).cast("int")
        twice = digit * 2
        return F.when((n - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(digit)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + weight(i))
    return total % 10 == 0


def _gates(text: Column) -> dict[str, Column]:
    """Kind -> what any text with such a span holds, found fast."""
    return {
        "email": F.contains(text, F.lit("@")),
        "ip": text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"),
        "card": text.rlike(r"(?:[0-9][ -]?){12}[0-9]"),
        "phone": F.contains(text, F.lit("+")),
    }


def base_spans(text: Column) -> dict[str, Column]:
    """Kind -> spans of a text, by the fixed patterns and checks."""

    def ip_ok(x: Column) -> Column:
        part = F.transform(F.split(x["v"], r"\."), lambda p: F.regexp_replace(p, F.lit("^0+"), F.lit("")))
        return F.forall(part, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))

    def card_ok(x: Column) -> Column:
        n = F.length(_digits(x["v"]))
        return F.when((n >= 13) & (n <= 19), luhn(_digits(x["v"]))).otherwise(F.lit(False))

    def phone_ok(x: Column) -> Column:
        n = F.length(_digits(x["v"]))
        return (n >= 9) & (n <= 15)

    none, gates = _no_spans(), _gates(text)
    found = {
        "email": spans(_joined(text, r"\.", "[A-Za-z0-9-]"), F.lit(EMAIL)),
        "ip": F.filter(spans(text, F.lit(IP)), ip_ok),
        "card": F.filter(spans(_joined(text, "[ -]", "[0-9]"), F.lit(CARD)), card_ok),
        "phone": F.filter(spans(text, F.lit(PHONE)), phone_ok),
    }
    return {kind: F.when(gates[kind], column).otherwise(none) for kind, column in found.items()}


def _listed(kind: Column | str, found: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.transform(found, lambda x: F.concat_ws(":", kind, x["s"], x["e"]))


def _listed_terms(kind: str) -> Column:
    return F.transform(F.filter("terms", lambda x: x["kind"] == kind), lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"]))


def _entities(kind: str) -> Column:
    return F.transform(kind, lambda x: F.struct(F.concat(F.lit(f"{kind}:"), x["v"]).alias("entity"), x["s"].alias("s"), x["e"].alias("e")))


def _tagged(kind: str) -> Column:
    return F.transform(kind, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(kind).alias("kind")))


def find_base(docs: DataFrame) -> DataFrame:
    """doc_id, the base spans by kind, ``same`` (a hash of the text), and ``key`` (its digest) and the text where it holds spans."""
    plain = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = plain.select("doc_id", "text", *(c.alias(kind) for kind, c in base_spans(F.col("text")).items()))
    some = F.greatest(*[F.size(k) for k in KINDS]) > 0
    return found.select("doc_id", *KINDS, F.xxhash64("text").alias("same"), F.when(some, F.md5("text")).alias("key"), F.when(some, F.col("text")).alias("text"))


def _holders(base: DataFrame) -> DataFrame:
    """One row of each distinct text that holds spans, with ``rows``, how many have it."""
    kept = [F.any_value(c).alias(c) for c in (*KINDS, "same", "text")]
    return base.filter(F.col("key").isNotNull()).groupBy("key").agg(*kept, F.count("*").alias("rows"))


def _neighbours(words: Column, found: Column, window: int) -> Column:
    """(entity, terms) of every span of ``found``: distinct lower-case words among the ``window`` ones before and after it."""
    before = counted(F.transform(words, lambda w: w["e"]), F.transform(found, lambda x: x["s"]), True)
    after = counted(F.transform(words, lambda w: w["s"]), F.transform(found, lambda x: x["e"]), False)

    def near(x: Column, n: Column) -> Column:
        left = F.slice(words, F.greatest(n["b"] - window + 1, F.lit(1)), F.least(n["b"], F.lit(window)))
        both = F.concat(left, F.slice(words, n["a"] + 1, F.lit(window)))
        return F.struct(x["entity"].alias("entity"), F.array_distinct(F.transform(both, lambda w: F.lower(w["v"]))).alias("terms"))

    return let(F.zip_with(before, after, lambda b, a: F.struct(b.alias("b"), a.alias("a"))), lambda ranks: F.zip_with(found, ranks, near))


def disclosing_terms(docs: DataFrame, base: DataFrame, holders: DataFrame, window: int = WINDOW, min_support: int = MIN_SUPPORT, generalise_from: float = GENERALISE_FROM) -> DataFrame:
    """(entity, term, disclosure) of the terms that reveal an entity of the corpus by at least ``generalise_from``. ``holders``: the texts of ``base`` with spans."""
    found = let(F.struct(spans(F.col("text"), F.lit(WORDS)).alias("w"), F.concat(*map(_entities, KINDS)).alias("x")), lambda z: _neighbours(z["w"], z["x"], window))
    mentions = materialise(holders.select("same", F.explode(found).alias("m")).select("same", "m.entity", "m.terms"), "mentions")
    met = materialise(mentions.select("entity", "same", F.explode("terms").alias("term")).distinct(), "met")
    entities = mentions.select("entity", "same").distinct().groupBy("entity").agg(F.count("*").alias("with_entity"))
    # One number, that of distinct texts, goes into every row.
    texts = F.lit(base.agg(F.count_distinct("same").alias("texts")).first()["texts"])

    def disclosure(with_term: Column) -> Column:
        p_entity = F.col("with_entity") / texts
        p_given = F.least(F.col("together") / with_term, F.lit(1.0))
        return F.when(F.col("with_entity") < texts, F.log2(p_given / p_entity) / -F.log2(p_entity)).otherwise(0.0)

    pairs = met.groupBy("entity", "term").agg(F.count("*").alias("together")).filter(F.col("together") >= min_support)
    # A term stands in as many texts at least as it stands near entities in; a pair that fails even so needs no count over the corpus.
    near = met.select("term", "same").distinct().groupBy("term").agg(F.count("*").alias("near"))
    pairs = pairs.join(entities, "entity").join(near, "term").filter(disclosure(F.col("near")) >= generalise_from).drop("near")
    pairs = materialise(pairs, "pairs")
    wanted = materialise(pairs.select("term").distinct(), "terms")
    words = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select(
        F.xxhash64("text").alias("same"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORDS), F.lit(0)))).alias("term")
    )
    held = words.join(F.broadcast(wanted), "term", "left_semi") if wanted.count() <= BROADCAST_TERMS else words.join(wanted, "term", "left_semi")
    frequency = held.distinct().groupBy("term").agg(F.count("*").alias("with_term"))
    scored = pairs.join(frequency, "term").select("entity", "term", disclosure(F.col("with_term")).alias("disclosure"))
    return materialise(scored.filter(F.col("disclosure") >= generalise_from), "disclosing")


def term_spans(holders: DataFrame, terms: DataFrame, remove_from: float = REMOVE_FROM) -> DataFrame:
    """key, terms and rows: spans (s, e, kind) of the revealing terms in the distinct texts that hold the entities they reveal."""
    held = holders.select("key", F.explode(F.array_distinct(F.transform(F.concat(*map(_entities, KINDS)), lambda x: x["entity"]))).alias("entity"))
    shares = held.groupBy("entity").agg(F.count("*").alias("texts"))
    met = salted_join(held, terms, "entity", shares, "texts", F.col("key"))
    by_text = met.groupBy("key", "term").agg(F.max("disclosure").alias("disclosure")).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("term", "disclosure"))).alias("told"))

    def located(words: Column) -> Column:
        told = lambda w: F.try_element_at("told", F.lower(w["v"]))
        kind = lambda w: F.when(told(w) >= remove_from, F.lit(DROPPED)).otherwise(F.lit(TERM))
        return F.transform(F.filter(words, lambda w: told(w).isNotNull()), lambda w: F.struct(w["s"].alias("s"), w["e"].alias("e"), kind(w).alias("kind")))

    return by_text.join(holders.select("key", "text", "rows"), "key").select("key", let(spans(F.col("text"), F.lit(WORDS)), located).alias("terms"), "rows")


def find(docs: DataFrame, **thresholds) -> DataFrame:
    """Counts, digest and spans of every row of ``docs`` (doc_id, text)."""
    base = materialise(find_base(docs), "pii")
    remove_from = thresholds.pop("remove_from", REMOVE_FROM)
    holders = materialise(_holders(base), "holders")
    extra = term_spans(holders, disclosing_terms(docs, base, holders, **thresholds), remove_from)
    everything = F.array_join(F.concat(*[_listed(k, F.col(k)) for k in KINDS]), ",")
    rows = base.select("doc_id", "key", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], everything.alias("listed"))
    # Texts without spans meet nothing, and are not shuffled.
    extra = materialise(extra, "terms")
    rows = heavy_join(rows.filter("key is not null"), extra, "key", "rows").unionByName(rows.filter("key is null"), allowMissingColumns=True)
    added = F.coalesce(F.array_join(F.concat(*map(_listed_terms, (TERM, DROPPED))), ","), F.lit(""))
    return rows.select(
        "doc_id",
        *[f"n_{k}" for k in KINDS],
        F.sha2("listed", 256).alias("base_sha256"),
        F.concat_ws(",", F.nullif("listed", F.lit("")), F.nullif(added, F.lit(""))).alias("spans"),
    )


def redact(text: Column, found: Column) -> Column:
    """The text with spans (s, e, kind), sorted by s, replaced by [KIND], or by nothing for DROPPED. Spans that overlap share one replacement."""

    def cut(z: Column) -> Column:
        ends = F.concat(F.array(F.lit(0)), running(F.transform(z["x"], lambda x: x["e"]), larger=True))
        return let(F.struct(z["x"].alias("x"), z["b"].alias("b"), ends.alias("e")), filled)

    def filled(z: Column) -> Column:
        tag = lambda x: F.when(x["kind"] == DROPPED, F.lit("")).otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
        parts = F.transform(z["x"], lambda x, i: F.when(x["s"] >= z["e"][i], F.concat(piece(z["b"], z["e"][i], x["s"]), tag(x))).otherwise(F.lit("")))
        return F.concat(F.array_join(parts, ""), piece(z["b"], F.element_at(z["e"], -1), F.length(text)))

    return let(F.struct(found.alias("x"), text_blocks(text).alias("b")), cut)


def sanitise(docs: DataFrame, text: str = "text", **thresholds) -> DataFrame:
    """``docs`` with personal data replaced in the text column (and ``n_chars``, if there, brought up to date); all else stays."""
    remove_from = thresholds.pop("remove_from", REMOVE_FROM)
    plain = docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(text).alias("text"))
    base = materialise(find_base(plain), "pii")
    holders = materialise(_holders(base), "holders")
    extra = term_spans(holders, disclosing_terms(plain, base, holders, **thresholds), remove_from)
    every = F.concat(*map(_tagged, KINDS), F.coalesce("terms", F.array().cast("array<struct<s:int,e:int,kind:string>>")))
    # Of spans that begin together the longer comes first, so that a value keeps its own tag though one of its words is a term.
    every = F.array_sort(F.transform(every, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("n"), x["e"].alias("e"), x["kind"].alias("kind"))))
    clean = holders.join(extra.drop("rows"), "key", "left").select("key", redact(F.col("text"), every).alias("clean"), "rows")
    return _replaced(docs, materialise(clean, "clean"), text)


def _replaced(docs: DataFrame, clean: DataFrame, text: str) -> DataFrame:
    """``docs`` with the texts of ``clean`` (key, clean, rows). Only texts that may hold a base span are looked up; the others are not shuffled."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    place = dict(zip(docs.columns, names, strict=True))
    plain, old = docs.toDF(*names), F.col(place[text])
    gate = F.lit(False)
    for holds in _gates(old.cast("string")).values():
        gate = gate | F.coalesce(holds, F.lit(False))
    met = heavy_join(plain.filter(gate).withColumn("key", F.md5(old.cast("string"))), clean, "key", "rows")
    out = met.drop("key").unionByName(plain.filter(~gate), allowMissingColumns=True)
    new = {place[text]: F.coalesce("clean", old)}
    if "n_chars" in place:
        kept = F.col(place["n_chars"])
        new[place["n_chars"]] = F.when(F.col("clean").isNull(), kept).otherwise(F.length("clean").cast(docs.schema["n_chars"].dataType))
    return out.select(*[new.get(n, F.col(n)).alias(c) for c, n in place.items()])
