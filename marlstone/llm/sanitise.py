"""Information-theoretic sanitisation, in DataFrame and SQL functions alone.

Protected entities are e-mail addresses, IP addresses, card numbers and phone
numbers, found by patterns. For each entity the corpus is asked how strongly the
words of its documents reveal it: with N documents, n(e) and n(t) that hold an
entity and a term and n(e, t) that hold the term anywhere outside their entities
together with the entity, a term's pointwise mutual information
log2(N n(e,t) / (n(e) n(t))) is held against the entity's information
log2(N / n(e)). A term whose mutual information is at least half of that
information discloses the entity, however few documents hold the two (an entity
that all documents hold has no information to disclose): wherever it stands in a
document with the entity, it is generalised to a class; if it is seen nowhere
else (n(e, t) = n(t), all of the information) it is removed. Terms are whole
words of any length.

A pair can only reach that if N n(e) >= n(t)^2, as n(e, t) <= n(e), so pairs
beyond are never made. For an entity of one document that is the condition
itself: such entities need no pairs at all.

Offsets are in code points, ends exclusive. A kind's matches are leftmost and do
not overlap; matches that fail their test are dropped and not tried again.

Defined results: null text counts as empty. Rows that repeat count as documents
of their own. Statistics are taken over all rows of the table that is given. Very
long texts are searched to their end; a document without entities has no terms.
An empty table gives no rows. Columns whose names begin with __ pass through
``redact`` like others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shielded, store

KINDS = ("email", "ip", "card", "phone")
#: Patterns in linear form: possessive loops, and starts only where a run of the first class starts or a match has ended.
#: A card's run of fewer than 16 digits fails at once; so does each of its rests, as those are shorter.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORD = r"\p{L}+"
CLASS_OF = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
_CHUNK = 256


def bound(value: Column, body) -> Column:
    """``body(value)``, where value is computed once: what a lambda of a higher-order function names is computed for each element."""
    return F.transform(F.array(value), body)[0]


NO_MATCH = "array<struct<start:int,match:string>>"


def placed(entries: Column) -> Column:
    """(start, match) of (gap, match), each gap the length of the text before its match.

    Sums go in two levels, so that no long array is copied again and again.
    """
    block = lambda b: F.slice(entries, b * _CHUNK + 1, F.lit(_CHUNK))
    number = F.sequence(F.lit(0), F.floor((F.size(entries) - 1) / _CHUNK).cast("int"))
    step = lambda x: x["gap"] + F.length(x["match"])
    totals = F.transform(number, lambda b: F.aggregate(block(b), F.lit(0), lambda a, x: a + step(x)))
    bases = F.aggregate(totals, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")), lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")))["all"]

    def inside(at: Column) -> Column:
        start = lambda b: F.struct(F.element_at(at, b + 1).alias("at"), F.array().cast(NO_MATCH).alias("all"))
        add = lambda a, x: F.struct((a["at"] + step(x)).alias("at"), F.concat(a["all"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), x["match"].alias("match")))).alias("all"))
        return F.flatten(F.transform(number, lambda b: F.aggregate(block(b), start(b), add)["all"]))

    return bound(bases, inside)


def matches(text: Column, pattern: Column) -> Column:
    """Array of (start, text) of the matches of ``pattern``; text between them gives the starts."""
    def starts(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        return bound(F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("match"))), placed)

    return bound(F.regexp_extract_all(text, pattern, F.lit(0)), lambda found: F.when(F.size(found) > 0, starts(found)).otherwise(F.array().cast(NO_MATCH)))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether digits read from the right, every second doubled, sum to a multiple of 10."""
    parts = F.transform(F.split(F.reverse(digits), ""), lambda d, k: d.cast("int") * (1 + F.pmod(k, F.lit(2))))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def accepted(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")).between(0, 3) & (F.coalesce(F.substring(F.regexp_replace(p, "^0+", ""), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return bound(_digits(match), lambda d: F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(False))
    return F.length(_digits(match)).between(8, 15)


def _accepts(kind: str):
    return lambda m: accepted(kind, m["match"])


def _needed(kind: str) -> str:
    """A literal without which there is no match; a cheap test before the pattern."""
    return {"email": "@", "ip": ".", "card": "", "phone": "+"}[kind]


def _found(text: Column, kind: str) -> Column:
    """Array of (start, match) of the accepted matches of a kind."""
    found = F.filter(matches(text, F.lit(PATTERNS[kind])), _accepts(kind))
    none = F.array().cast(NO_MATCH)
    return F.when(F.contains(text, F.lit(_needed(kind))), found).otherwise(none)


def find_entities(df: DataFrame) -> DataFrame:
    """``df`` with array columns __email, __ip, __card and __phone of (start, match)."""
    return df.select("*", *[_found(F.coalesce("text", F.lit("")), k).alias(f"__{k}") for k in KINDS])


def entity_list(kinds: tuple[str, ...] = KINDS) -> Column:
    """All entities of the columns by kind: (kind, start, end, value)."""
    def named(kind: str):
        value = (lambda m: F.lower(m["match"])) if kind in ("email", "ip") else (lambda m: _digits(m["match"]))
        return lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), (m["start"] + F.length(m["match"])).alias("end"), value(m).alias("value"))

    parts = [F.transform(F.col(f"__{k}"), named(k)) for k in kinds]
    return F.concat(*parts)


def span_text(entities: Column) -> Column:
    return F.array_join(F.transform(entities, lambda e: F.concat_ws(":", e["kind"], e["start"].cast("string"), e["end"].cast("string"))), ",")


def _fold(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def own_words(text: Column) -> Column:
    """Distinct whole words."""
    return F.array_distinct(F.regexp_extract_all(_fold(text), F.lit(WORD), F.lit(0)))


def replaced(text: Column, spans: Column) -> Column:
    """``text`` with the spans (start, end, to), sorted, put to ``to``; overlapping ones as one, under the first."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    folded = lambda s: F.aggregate(
        s, start,
        lambda a, x: F.when(x["start"] >= a["at"], F.struct(x["end"].alias("at"), F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, x["start"] - a["at"]), x["to"])).alias("out"))).otherwise(
            F.struct(F.greatest(a["at"], x["end"]).alias("at"), a["out"].alias("out"))),
    )
    return bound(folded(spans), lambda f: F.concat(F.array_join(f["out"], ""), F.substring(text, f["at"] + 1, F.length(text))))


def context_terms(text: Column, entities: Column) -> Column:
    """Distinct whole words of ``text`` that stand outside its entities."""
    spans = F.array_sort(F.transform(entities, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), F.lit("\n").alias("to"))))
    # a piece of a word that an entity cuts is no word
    return F.array_intersect(own_words(replaced(text, spans)), own_words(text))


def disclosing_terms(found: DataFrame, texts: DataFrame) -> DataFrame:
    """(row, term, whole) of all terms that disclose an entity of the row; whole: one that is seen only with it.

    ``found`` has row, text and entities of the rows with entities, ``texts`` the
    column text of all rows.
    """
    total = texts.count()
    # a document counts once for an entity and for an entity with a term
    held = store(found.select("row", F.explode("entities").alias("e")).select("row", "e.kind", "e.value").distinct(), "held")
    entities = held.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n_e")).filter(F.col("n_e") < total)
    entities = store(entities.withColumn("entity", F.monotonically_increasing_id()), "entities")
    most = entities.agg(F.max("n_e")).first()[0] or 0
    words = texts.select(F.explode(own_words(F.coalesce("text", F.lit("")))).alias("term"))
    # N n_e >= n_t^2 with the largest n_e; n_t is a whole number
    rare = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_t")).filter(F.col("n_t") <= math.isqrt(total * most))
    beside = found.select("row", F.explode(context_terms(F.col("text"), F.col("entities"))).alias("term"))
    near = store(beside.join(rare.hint("merge"), "term"), "near")
    placed_ = store(held.join(entities, ["kind", "value"]).select("row", "entity", "n_e"), "placed")
    big = {c: F.col(c).cast("double") for c in ("n_et", "n_e", "n_t")}
    able = F.lit(float(total)) * big["n_e"] >= big["n_t"] * big["n_t"]
    single = near.join(placed_.filter("n_e = 1").select("row", "n_e").distinct(), "row").filter(able).select("row", "term", (F.col("n_t") == 1).alias("whole"))
    pairs = store(near.join(placed_.filter("n_e > 1"), "row").filter(able), "pairs")
    counts = pairs.groupBy("entity", "term", "n_e", "n_t").agg(F.count(F.lit(1)).alias("n_et"))
    # 2 log2(N n_et / (n_e n_t)) >= log2(N / n_e), multiplied out
    reveals = F.lit(float(total)) * big["n_et"] * big["n_et"] >= big["n_e"] * big["n_t"] * big["n_t"]
    terms = store(counts.filter(reveals).select("entity", "term", (F.col("n_et") == F.col("n_t")).alias("whole")), "terms")
    return single.unionByName(pairs.select("row", "entity", "term").join(terms, ["entity", "term"]).select("row", "term", "whole"))


def term_spans(text: Column, terms: Column) -> Column:
    """(start, match) of whole-word occurrences of ``terms`` (array of words)."""
    pattern = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(F.array_sort(terms), "|"), F.lit(r")(?!\p{L})"))
    return matches(_fold(text), pattern)


def analyse(docs: DataFrame, texts: bool = True) -> DataFrame:
    """All rows and columns of ``docs``, with __entities (kind, start, end, value) and __terms (start, match, whole).

    The patterns run once and their spans are written with the rows; without
    ``texts``, text is null in rows that have no entity, and isn't written.
    """
    text = F.coalesce("text", F.lit(""))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    none = F.array().cast("array<struct<start:int,match:string,whole:boolean>>")
    spread = docs.select(*columns, *[_found(text, k).alias(f"__{k}") for k in KINDS])
    listed = spread.select(*columns, entity_list().alias("__entities"), F.monotonically_increasing_id().alias("__row"))
    some = F.size("__entities") > 0
    if not texts:
        listed = listed.withColumn("text", F.when(some, F.col("text")))
    listed = store(listed, "spans")
    found = store(listed.filter(some), "found")
    light = found.select(F.col("__row").alias("row"), text.alias("text"), F.col("__entities").alias("entities"))
    met = disclosing_terms(light, docs.select("text")).groupBy(F.col("row").alias("__row"), "term").agg(F.max("whole").alias("whole"))
    own = store(met.groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct("term", "whole"))).alias("__own")), "own")
    marked = F.transform(term_spans(text, F.map_keys("__own")), lambda m: F.struct(m["start"].alias("start"), m["match"].alias("match"), F.element_at(F.col("__own"), m["match"]).alias("whole")))
    # a term inside an entity goes with the entity
    outside = lambda t: ~F.exists("__entities", lambda e: (t["start"] < e["end"]) & (t["start"] + F.length(t["match"]) > e["start"]))
    done = found.join(own, "__row", "left").select(*columns, "__entities", F.when(F.col("__own").isNotNull(), F.filter(marked, outside)).otherwise(none).alias("__terms"))
    return done.unionByName(listed.filter(~some).select(*columns, "__entities", none.alias("__terms")))


def report(docs: DataFrame) -> DataFrame:
    """Counts, digest and spans of every row of ``docs`` (doc_id, text)."""
    done = analyse(docs.select("doc_id", "text"), texts=False)
    base = F.array_sort(F.col("__entities"), lambda a, b: _by_kind(a, b))
    base_text = span_text(base)
    terms = F.transform("__terms", lambda t: F.struct(F.lit("term").alias("kind"), t["start"].alias("start"), (t["start"] + F.length(t["match"])).alias("end")))
    count = lambda k: F.size(F.filter("__entities", lambda e: e["kind"] == k)).cast("long").alias(f"n_{k}")
    spans = F.array_join(F.filter(F.array(base_text, span_text(terms)), lambda x: x != ""), ",")
    return done.select("doc_id", *[count(k) for k in KINDS], F.sha2(base_text, 256).alias("base_sha256"), spans.alias("spans"))


def _by_kind(a: Column, b: Column) -> Column:
    place = lambda x: F.array_position(F.array(*[F.lit(k) for k in KINDS]), x["kind"]) * F.lit(1 << 33) + x["start"]
    return F.when(place(a) < place(b), -1).when(place(a) > place(b), 1).otherwise(0)


@shielded
def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with entities in text replaced by their class, disclosing terms by [TERM] or nothing.

    n_chars, where there is one, follows the new text. Overlapping spans are
    replaced as one, under the class of the first.
    """
    done = analyse(docs)
    names = F.create_map(*[F.lit(x) for kv in CLASS_OF.items() for x in kv])
    spans = F.concat(
        F.transform("__entities", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), F.element_at(names, e["kind"]).alias("to"))),
        F.transform("__terms", lambda t: F.struct(t["start"].alias("start"), (t["start"] + F.length(t["match"])).alias("end"), F.when(t["whole"], "").otherwise("[TERM]").alias("to"))),
    )
    text = F.when(F.size(spans) > 0, replaced(F.col("text"), F.array_sort(spans))).otherwise(F.col("text"))
    out = done.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("__entities") + F.size("__terms") > 0, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
