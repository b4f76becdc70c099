"""Rule tables: linguistic knowledge as rows, and literal fixtures.

Each table is stated once and rendered as a Spark relation (a local one, so it is broadcast with a known size) and as
a DuckDB ``VALUES`` clause for the oracle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def literal(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    return str(x) if isinstance(x, int | float) else "'" + str(x).replace("'", "''") + "'"


@dataclass(frozen=True)
class Table:
    name: str
    columns: str
    types: str
    rows: tuple[tuple, ...]

    @property
    def schema(self) -> str:
        return ", ".join(f"{c} {t}" for c, t in zip(self.columns.split(), self.types.split(), strict=True))

    def frame(self, spark: SparkSession) -> DataFrame:
        values = ", ".join("(" + ", ".join(map(_spark_literal, r)) + ")" for r in self.rows)
        casts = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in (x.split(" ") for x in self.schema.split(", ")))
        return spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({', '.join(self.columns.split())})")

    def sql(self) -> str:
        """A common table expression for DuckDB."""
        kinds = {"int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "bigint": "BIGINT"}
        values = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in self.rows)
        casts = ", ".join(f"{c}::{kinds[t]} AS {c}" for c, t in zip(self.columns.split(), self.types.split(), strict=True))
        return f"{self.name} AS (SELECT {casts} FROM (VALUES {values}) AS t({', '.join(self.columns.split())}))"


#: Rows up to which a rule table that was bound to a file is sent to all tasks.
MOST_ROWS = 500_000


class Rules:
    """Which rule tables are read from files or DataFrames in place of their defaults.

    ``Rules(patterns="/rules/patterns.csv")`` binds a table's name to a CSV file with a header, or to a DataFrame. The
    columns that the table has must be there, by its names or by those that ``columns`` gives; others are ignored.
    Operators that look words up take it as ``rules``; without it the literal tables stand.
    """

    def __init__(self, columns: dict[str, dict[str, str]] | None = None, **bound: str | DataFrame):
        self.bound, self.columns = bound, columns or {}

    def frame(self, spark: SparkSession, table: Table) -> DataFrame:
        """The table's rows, from where it is bound; values are trimmed, rows without any value go."""
        if table.name not in self.bound:
            return table.frame(spark)
        source = self.bound[table.name]
        rows = spark.read.csv(source, header=True, encoding="UTF-8") if isinstance(source, str) else source
        renamed = self.columns.get(table.name, {})
        wanted = [(renamed.get(c, c), c, t) for c, t in zip(table.columns.split(), table.types.split(), strict=True)]
        missing = [x for x, _, _ in wanted if x not in rows.columns]
        if missing:
            raise ValueError(f"rule table {table.name} lacks the columns {', '.join(missing)}")
        value = lambda x, t: F.nullif(F.trim(F.col(f"`{x}`").cast("string")), F.lit("")).cast(t)
        return rows.select(*[value(x, t).alias(c) for x, c, t in wanted]).dropna("all")

    def lookup(self, spark: SparkSession, table: Table, key: str) -> tuple[DataFrame, bool]:
        """The table with one row a key, and whether it is small enough to be sent to all tasks; a key that comes twice is an error."""
        rows = self.frame(spark, table)
        if table.name not in self.bound:
            return rows, True
        rows = rows.where(F.col(key).isNotNull()).cache()
        twice = rows.groupBy(key).count().where("count > 1").limit(3).collect()
        if twice:
            raise ValueError(f"rule table {table.name} has several rows for {', '.join(str(r[0]) for r in twice)}")
        return rows, rows.limit(MOST_ROWS + 1).count() <= MOST_ROWS


def _spark_literal(x: object) -> str:
    return literal(x).replace("\\", "\\\\") if isinstance(x, str) else literal(x)


#: Function words of the four document languages. Fixed values.
MARKERS = Table(
    "markers", "form lang kind meaning priority confidence", "string string string string int double",
    tuple(
        (form, lang, kind, meaning, priority, confidence)
        for lang, kind, meaning, priority, confidence, forms in (
            ("en", "preposition", "relation", 5, 0.9, "of with by for on at"), ("en", "conjunction", "joining", 6, 0.9, "and or"),
            ("en", "negation", "denial", 9, 0.95, "not no never"), ("en", "modal", "necessity", 8, 0.9, "must should"), ("en", "modal", "possibility", 8, 0.8, "may might can"),
            ("en", "pronoun", "reference", 4, 0.7, "it this that"), ("en", "copula", "being", 7, 0.9, "is are was be"),
            ("fr", "preposition", "relation", 5, 0.9, "de dans pour par sur avec"), ("fr", "conjunction", "joining", 6, 0.9, "et ou"), ("fr", "negation", "denial", 9, 0.95, "pas non"),
            ("fr", "article", "definite", 3, 0.8, "le la les"), ("de", "conjunction", "joining", 6, 0.9, "und oder"), ("de", "preposition", "relation", 5, 0.9, "von mit für zu im"),
            ("de", "negation", "denial", 9, 0.95, "nicht kein"), ("es", "preposition", "relation", 5, 0.9, "de con para por en"), ("es", "conjunction", "joining", 6, 0.9, "y o"), ("es", "negation", "denial", 9, 0.95, "no nunca"),
        )
        for form in forms.split()
    ),
)

#: Vocalised Arabic words: hits, misses, ties, ambiguous forms, an empty and a null one. NFC.
WORDS = Table(
    "words", "id word", "int string",
    tuple(enumerate((
        "كِتَابٌ", "ٱلْكِتَابُ", "آمَنَ", "قُرْآن", "اكْتُب", "الشَّمْسُ", "الْقَمَرُ", "رَحْمَـــة", "مُؤْمِنُونَ", "مِنْ", "مَنْ", "مِن", "عَلَىٰ", "إِلَى", "وَالْعَصْرِ", "فَكُلِي",
        "يَكْتُبُونَ", "كَتَبْتُمْ", "سَيَعْلَمُ", "كِتَابًا", "مَدْرَسَةٌ", "بِسْمِ", "لِلَّهِ", "أَكَلَ", "هَٰذَا", "ذَلِكَ", "لَا", "لَمْ", "لَنْ", "٢٥٥", "", None, "  كَلِمَةٌ   طَيِّبَةٌ ",
    ), 1)),
)

#: Lexicon entries: vocalised form, class, tag, root, priority, whether context is needed.
LEXICON = Table(
    "lexicon", "entry form class tag root priority needs_context", "int string string string string int boolean",
    (
        (1, "كِتَابٌ", "NOUN", "N", "كتب", 9, False), (2, "مِنْ", "PARTICLE", "PREP", None, 9, False), (3, "مَنْ", "NOUN", "REL", None, 9, True), (4, "مَنْ", "NOUN", "INTG", None, 8, True),
        (5, "كَتَبَ", "VERB", "PV", "كتب", 9, False), (6, "كُتُبٌ", "NOUN", "N", "كتب", 9, False), (7, "لَا", "PARTICLE", "NEG", None, 9, False), (8, "لَمْ", "PARTICLE", "JUS", None, 9, False), (9, "لَنْ", "PARTICLE", "SUB", None, 9, False),
        (10, "إِلَى", "PARTICLE", "PREP", None, 9, False), (11, "عَلَى", "PARTICLE", "PREP", None, 9, False), (12, "أَكَلَ", "VERB", "PV", "أكل", 9, False), (13, "هَذَا", "NOUN", "DEM", None, 9, False), (14, "ذَلِكَ", "NOUN", "DEM", None, 9, False),
        (15, "عَلِمَ", "VERB", "PV", "علم", 9, False), (16, "عِلْمٌ", "NOUN", "N", "علم", 9, False), (17, "آمَنَ", "VERB", "PV", "أمن", 9, False), (18, "مَدْرَسَةٌ", "NOUN", "N", "درس", 7, False), (19, "قَمَرٌ", "NOUN", "N", "قمر", 9, False),
        (20, "ٱكْتُبْ", "VERB", "CV", "كتب", 9, False), (21, "اكْتُبْ", "NOUN", "N", "كتب", 3, True), (22, "دَخَلَ", "VERB", "PV", "دخل", 9, False), (23, "رَسُولٌ", "NOUN", "N", "رسل", 9, False), (24, "إِذَا", "PARTICLE", "COND", None, 9, True), (25, "هُوَ", "PRON", "3MS", None, 9, False),
    ),
)
