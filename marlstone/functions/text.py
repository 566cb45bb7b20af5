"""Labels, transcripts and keys as text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"\x{4E00}-\x{9FFF}"
#: Every character that counts as white space in Unicode text, and the four ASCII separators.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once: expressions in lambdas aren't compiled, and repeat what they name twice."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(value: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(value, F.lit(WHITE))


def clean(value: Column) -> Column:
    """Stripped; blank is null."""
    return F.nullif(strip(value), F.lit(""))


def binary_label(value: Column) -> Column:
    """``bonafide``, ``spoof`` or empty."""
    low = F.lower(strip(F.coalesce(value.cast("string"), F.lit(""))))
    return F.when(low.isin("bonafide", "bona_fide", "1"), "bonafide").when(low.isin("spoof", "0"), "spoof").otherwise("")


def label_int(value: Column) -> Column:
    """1 for bonafide, 0 for spoof, else null."""
    label = binary_label(value)
    return F.when(label == "bonafide", 1).when(label == "spoof", 0)


def protocol_label(value: Column) -> Column:
    """As ``binary_label``, but what is unknown is spoof."""
    return F.when(binary_label(value) == "bonafide", "bonafide").otherwise("spoof")


def english_transcript(value: Column) -> Column:
    """Word and number tokens joined by blanks; null under four tokens or with numbers alone."""
    tokens = F.regexp_extract_all(value, F.lit(r"[A-Za-z]+(?:'[A-Za-z]+)?|[0-9]+"), F.lit(0))
    numbers = F.forall(tokens, lambda t: t.rlike("^[0-9]+$"))
    return F.when((F.size(tokens) >= 4) & ~numbers, F.array_join(tokens, " "))


def spaced_transcript(value: Column) -> Column:
    """Every other token of an interleaved transcript, joined; null under four CJK characters or all digits."""
    tokens = F.filter(F.split(strip(value), r"(?U)\s+"), lambda t, i: i % 2 == 0)
    text = F.array_join(tokens, "")
    return F.when((F.length(F.regexp_replace(text, f"[^{CJK}]", "")) >= 4) & ~text.rlike(r"(?U)^\d+$"), text)


def reference_text(value: Column, language: Column) -> Column:
    """Chinese keeps CJK and alphanumerics; other languages are lower-cased ASCII words parted by one blank."""
    squeezed = strip(F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)\s+", " "))
    chinese = F.regexp_replace(squeezed, r"[^\p{L}\p{N}" + CJK + "]", "")
    other = strip(F.regexp_replace(F.regexp_replace(F.lower(squeezed), "[^a-z0-9 ]", " "), " +", " "))
    return F.when(F.coalesce(language, F.lit("")) == "zh", chinese).otherwise(other)


def word_tokens(text: Column, language: Column) -> Column:
    parts = F.when(F.coalesce(language, F.lit("")) == "zh", F.split(text, "")).otherwise(F.split(text, " "))
    return F.filter(parts, lambda t: t != "")


def char_tokens(text: Column) -> Column:
    return F.filter(F.split(F.replace(text, F.lit(" "), F.lit("")), ""), lambda t: t != "")


def sequence_distance(left: Column, right: Column) -> Column:
    """Levenshtein distance of two arrays of strings, on the JVM.

    Each distinct token becomes one character of the private planes, numbered by
    its place among the distinct tokens of both sides; then it is a text distance.
    """
    both = F.array_distinct(F.concat(left, right))

    def coded(side: Column, known: Column) -> Column:
        return F.array_join(F.transform(side, lambda t: F.decode(F.unhex(F.lpad(F.hex(F.array_position(known, t) + 0xF0000), 8, "0")), "UTF-32")), "")

    return F.transform(F.array(both), lambda known: F.levenshtein(coded(left, known), coded(right, known)))[0]


def error_rate(reference: Column, distance: Column, hypothesis: Column) -> Column:
    """distance / size of the reference; for an empty reference null if the other is empty too, else 1."""
    size = F.size(reference)
    return F.when(size > 0, distance / size).when(F.size(hypothesis) > 0, F.lit(1.0))


def word_error_rate(reference: Column, hypothesis: Column, language: Column) -> Column:
    a, b = (word_tokens(reference_text(x, language), language) for x in (reference, hypothesis))
    return error_rate(a, sequence_distance(a, b), b)


def char_error_rate(reference: Column, hypothesis: Column, language: Column) -> Column:
    a, b = (F.replace(reference_text(x, language), F.lit(" "), F.lit("")) for x in (reference, hypothesis))
    return F.when(F.length(a) > 0, F.levenshtein(a, b) / F.length(a)).when(F.length(b) > 0, F.lit(1.0))


def elapsed(seconds: Column) -> Column:
    """MM:SS, or HH:MM:SS from an hour on."""
    whole = F.greatest(F.floor(seconds), F.lit(0)).cast("long")
    h, m, s = F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60
    return F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, s)).otherwise(F.format_string("%02d:%02d", m, s))


def log_line(value: Column) -> Column:
    """A log line without its time stamp and level."""
    return F.regexp_replace(F.regexp_replace(value, r"^\[?\d{4}-\d{2}-\d{2}[ T][0-9:,.]+\]?\s*", ""), r"^\[?(DEBUG|INFO|WARNING|ERROR|CRITICAL)\]?[:\s-]*", "")


def fold_name(*parts: Column) -> Column:
    """A file-safe name: other characters become one underscore; ``fold`` if nothing is left."""
    text = F.regexp_replace(F.regexp_replace(F.concat_ws("__", *parts), r"[^A-Za-z0-9_.-]+", "_"), r"^[._-]+|[._-]+$", "")
    return F.when(text == "", "fold").otherwise(text)


def row_key(sample_id: Column, *fallback: Column) -> Column:
    """sample_id, else the first fallback that isn't blank, else all of them as JSON."""
    first = F.coalesce(clean(sample_id), *[clean(x) for x in fallback])
    return F.coalesce(first, F.to_json(F.array(*[F.coalesce(x.cast("string"), F.lit("")) for x in (sample_id, *fallback)])))


def language_name(code: Column, names: dict[str, str], default: str) -> Column:
    """A model's name of a language code, ``default`` for others."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(strip(code))), F.lit(default))


def first_of(values: Column, *keys: str) -> Column:
    """A map's value of the first key that it has, else blank."""
    return F.coalesce(*[F.try_element_at(values, F.lit(k)) for k in keys], F.lit(""))


def standard_split(split_standard: Column, split: Column) -> Column:
    """The split of a row of a task: ``split_standard`` where there is one, even if blank, else ``split``."""
    return strip(F.coalesce(split_standard, split, F.lit("")))


def requested_split(split_standard: Column, split: Column) -> Column:
    """The split by which rows are chosen: a blank ``split_standard`` counts as none."""
    return F.coalesce(clean(split_standard), strip(F.coalesce(split, F.lit(""))))
