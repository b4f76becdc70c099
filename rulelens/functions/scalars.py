"""Scalar functions by family, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# -- references and examples in running text (X12 to X18) ------------------------------------------------------------

#: ``[name: 3]``, ``[name: 3 - 5]``: chapter and verses; examples in brackets and quotes; a bare reference ``2:255`` or ``2:255-257``. Fixed shapes.
REFERENCE = r"\[\s*([^\[\]:]{2,30}?)\s*:\s*([0-9٠-٩]+(?:\s*[-–،,]\s*[0-9٠-٩]+)*)\s*\]"
BRACKETED = r"\(([^()]{3,200})\)"
QUOTED = r"(?:«([^»]+)»|﴿([^﴾]+)﴾)"
POINT = r"^\s*([0-9]+)\s*:\s*([0-9]+)(?:\s*-\s*(?:([0-9]+)\s*:\s*)?([0-9]+))?\s*$"
#: How far behind a quotation its reference may stand.
LOOKAHEAD = 80


def ascii_digits(x: Column) -> Column:
    return F.translate(x, "٠١٢٣٤٥٦٧٨٩", "0123456789")


def references(text: Column) -> Column:
    """array<struct<name, verses>> of the references in brackets, verses as numbers in order."""
    names, verses = (F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(k)) for k in (1, 2))
    return F.transform(F.arrays_zip(names.alias("name"), verses.alias("verses")), lambda r: F.struct(F.trim(r["name"]).alias("name"), verse_numbers(r["verses"]).alias("verses")))


def verse_numbers(x: Column) -> Column:
    """All numbers that ``3``, ``3-5`` or ``3, 7`` name; a range that runs backwards names its ends only."""
    parts = F.split(F.regexp_replace(ascii_digits(x), r"\s", ""), "[،,]")

    def one(p: Column) -> Column:
        ends = F.transform(F.split(p, "[-–]"), lambda e: e.cast("int"))
        low, high = F.get(ends, F.lit(0)), F.get(ends, F.size(ends) - 1)
        return F.when((F.size(ends) == 2) & (low <= high), F.sequence(low, high)).otherwise(ends)

    return F.flatten(F.transform(parts, one))


def point_or_range(x: Column) -> Column:
    """struct<from, verse, to, last> of ``2:255``, ``2:255-257`` or ``2:255-3:2``; null for anything else."""
    g = lambda k: F.regexp_extract(ascii_digits(x), POINT, k)
    number = lambda k: F.nullif(g(k), F.lit("")).cast("int")
    made = F.struct(number(1).alias("from"), number(2).alias("verse"), F.coalesce(number(3), number(1)).alias("to"), F.coalesce(number(4), number(2)).alias("last"))
    return F.when(ascii_digits(x).rlike(POINT), made)


def examples(text: Column) -> Column:
    """array<struct<type, text>>: bracketed ones that aren't references, and quoted ones, in this order."""
    bracketed = F.regexp_extract_all(text, F.lit(BRACKETED), F.lit(1))
    quoted = F.transform(F.arrays_zip(F.regexp_extract_all(text, F.lit(QUOTED), F.lit(1)).alias("a"), F.regexp_extract_all(text, F.lit(QUOTED), F.lit(2)).alias("b")), lambda q: F.concat(q["a"], q["b"]))
    tagged = lambda xs, kind: F.transform(xs, lambda x: F.struct(F.lit(kind).alias("type"), F.trim(x).alias("text")))
    return F.concat(tagged(F.filter(bracketed, lambda x: ~x.rlike(r"^[\s0-9٠-٩:–-]+$")), "bracketed"), tagged(quoted, "quoted"))


def quoted_verses(text: Column) -> Column:
    """array<struct<text, name, verses>>: quotations with a reference that follows within 80 characters."""
    both = rf"[«﴿]([^»﴾]+)[»﴾][^«﴿\[]{{0,{LOOKAHEAD}}}?{REFERENCE}"
    part = lambda k: F.regexp_extract_all(text, F.lit(both), F.lit(k))
    zipped = F.arrays_zip(part(1).alias("t"), part(2).alias("n"), part(3).alias("v"))
    return F.transform(zipped, lambda r: F.struct(F.trim(r["t"]).alias("text"), F.trim(r["n"]).alias("name"), verse_numbers(r["v"]).alias("verses")))


# -- numbers (X23 to X26) ---------------------------------------------------------------------------------------------------

#: How sure a way of matching is. Fixed values.
MATCH_CONFIDENCE = {"exact": 1.0, "prefix": 0.9, "normalized": 0.85, "stripped": 0.7, "none": 0.0}


def match_confidence(way: Column, row: Column) -> Column:
    """The smaller of what a way of matching allows and what the matched row says of itself; an unknown way allows nothing."""
    allowed = F.create_map(*[F.lit(x) for kv in MATCH_CONFIDENCE.items() for x in kv])
    return F.least(F.coalesce(F.try_element_at(allowed, way), F.lit(0.0)), F.coalesce(row, F.lit(0.0)))


def entropy(counts: Column) -> Column:
    """Bits of a distribution given by an array of counts; zero counts add nothing, no counts have none."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    each = lambda x: F.when(x > 0, -(x / total) * F.log2(x / total)).otherwise(0.0)
    return F.when(total > 0, F.aggregate(F.transform(counts, each), F.lit(0.0), lambda a, x: a + x)).otherwise(0.0)


def number_value(parts: Column) -> Column:
    """The value of a number's parts: their sum, never a product."""
    return F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x.cast("long"), F.lit(0)))


def agreement_band(n: Column) -> Column:
    """How a counted noun agrees with its number: one, two, three to ten, eleven to nineteen, tens, hundreds."""
    last = n % 100
    return (
        F.when(n.isNull() | (n < 0), "none").when(n == 0, "zero").when(n == 1, "singular").when(n == 2, "dual").when(n.between(3, 10), "plural_genitive").when(n.between(11, 99), "singular_accusative")
        .when(last == 0, "singular_genitive").when(last.between(3, 10), "plural_genitive").when(last.between(11, 99), "singular_accusative").otherwise("singular_genitive")
    )


# -- maps, JSON and digests (X9, X29, X31 to X34) ------------------------------------------------------------------------


def attribute(m: Column, key: str, otherwise: str | None = None) -> Column:
    """A map's value or a default."""
    return F.coalesce(F.try_element_at(m, F.lit(key)), F.lit(otherwise))


def canonical_json(m: Column) -> Column:
    """A string map as JSON with sorted keys and no blanks."""
    entries = F.array_sort(F.map_entries(m))
    quoted = lambda x: F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1)
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(quoted(e["key"]), F.lit(":"), quoted(e["value"]))), ","), F.lit("}"))


def seal(x: Column, prefix: str = "sha256:") -> Column:
    """A prefixed digest of a canonical text."""
    return F.concat(F.lit(prefix), F.sha2(x.cast("binary"), 256))


def level_digest(x: Column) -> Column:
    """The first six hex digits."""
    return F.left(F.sha2(x.cast("binary"), 256), F.lit(6))


def cites_no_digest(df: DataFrame, source: str) -> DataFrame:
    """``df`` unchanged; a row whose ``source`` cites a digest as its authority is an error."""
    cited = F.coalesce(F.col(source).rlike("sha256:[0-9a-f]{6,}|^[0-9a-f]{64}$"), F.lit(False))
    checked = F.when(cited, F.raise_error(F.concat(F.lit("a digest is no source: "), F.col(source)))).otherwise(F.col(source))
    return df.withColumn(source, checked)


def role_normal_form(x: Column) -> Column:
    """A role's name in lower case with single underscores, its article and suffixes of certainty gone."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), r"^(the|ال)[_ ]?", ""), r"[\s_-]+", "_"), r"_?(certificate|hypothesis|zero|\?)$", "")
