"""Vocalised words of the documents: each token spelled in Arabic letters and marks.

The documents' languages are written in Latin letters. So that the operators on vocalised words run on whole tables, every
token is spelled by fixed rules: function words by a table, article, prefixes and endings by what stands at a word's
start and end, the rest letter by letter. Rules and conditions are stated once, as SQL text that both engines read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulelens.functions import arabic as ar
from rulelens.plans.scratch import save
from rulelens.sources.readings import READINGS_SQL, WRITTEN_SQL, readings, vocabulary, written
from rulelens.sources.rules import Rules, Table

A, M = ar.ALL_MARKS, ar.MARKS

# -- text that both engines read ----------------------------------------------------------------------------------


def match(x: str, pattern: str) -> str:
    return f"MATCH({x}, '{pattern}')"


def sub(x: str, pattern: str, to: str = "") -> str:
    """All occurrences; ``@1`` names a group."""
    return f"SUB({x}, '{pattern}', '{to}')G"


def plain(x: str) -> str:
    return sub(x, f"[{A}]")


def letters(x: str) -> str:
    return f"length({plain(x)})"


def shaddas(x: str) -> str:
    return f"(length({x}) - length(replace({x}, 'ّ', '')))"


def cascade(*rules: tuple[str, str], otherwise: str = "NULL") -> str:
    """The value of the first condition that holds."""
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in rules) + f" ELSE {otherwise} END"


def for_spark(text: str) -> str:
    text = text.replace("MATCH(", "regexp_like(").replace("SUB(", "regexp_replace(").replace(")G", ")")
    return re.sub(r"@(\d)", r"$\1", text).replace("SHA(", "sha2_256(")


def for_duck(text: str) -> str:
    text = text.replace("MATCH(", "regexp_matches(").replace("SUB(", "regexp_replace(").replace(")G", ", 'g')")
    return re.sub(r"@(\d)", r"\\\1", text).replace("SHA(", "sha256(")


# -- the spelling -----------------------------------------------------------------------------------------------------

#: Function words by their spelling: tokens, class, and tag (of times: the tense they tell). Fixed values.
FUNCTION_WORDS = (
    ("مِنْ", "of de von", "PREP", "PREP"), ("فِي", "in en im dans", "PREP", "PREP"), ("إِلَى", "to zu à", "PREP", "PREP"), ("عَلَى", "on sur auf", "PREP", "PREP"), ("مَعَ", "with avec mit con", "PREP", "PREP"),
    ("ثُمَّ", "and et und y", "CONJ", "CONJ"), ("أَوْ", "or ou oder o", "CONJ", "CONJ"), ("لَا", "not nicht pas no", "PARTICLE", "NEG"), ("لَمْ", "never kein", "PARTICLE", "JUS"), ("إِذَا", "if si se wenn", "PARTICLE", "COND"),
    ("أَنْ", "that que dass", "PARTICLE", "SUB"), ("إِنَّ", "are sind son sont", "PARTICLE", "INNA"), ("كَانَ", "is ist es est", "VERB", "KANA"), ("هَذَا", "the der el le", "DEM", "DEM"), ("ذَلِكَ", "this dieser", "DEM", "DEM"),
    ("هُوَ", "it er il él", "PRON", "3MS"), ("هِيَ", "die la elle ella", "PRON", "3FS"), ("هُمْ", "they sie ils", "PRON", "3MP"), ("أَنَا", "i ich je yo", "PRON", "1CS"), ("أَنْتَ", "you du tu", "PRON", "2MS"),
    ("الَّذِي", "which welche qui", "REL", "REL"), ("مَا", "was what para", "PARTICLE", "INTG"), ("غَدًا", "by par", "TIME", "future"), ("الْيَوْمَ", "for pour für", "TIME", "present"), ("أَمْسِ", "as comme als como", "TIME", "past"),
    ("فَ", "at", "CONJ", "ANSWER"), ("يَا", "be", "PARTICLE", "VOC"), ("قَالَ", "said on", "VERB", "SAY"),
)
_TOKENS = [(t, spelled, cls, tag) for spelled, forms, cls, tag in FUNCTION_WORDS for t in forms.split()]
_TOKENS = list({t[0]: t for t in reversed(_TOKENS)}.values())  # of a token named twice the first counts
SPELLINGS = Table("spellings", "token spelled", "string string", tuple((t, s) for t, s, _, _ in _TOKENS))
#: Spelled forms with class and tag.
CLOSED = Table("closed_forms", "form class tag", "string string string", tuple((s, c, t) for s, _, c, t in FUNCTION_WORDS))

#: What stands at a token's start and end, in order; then single letters. Fixed values.
STARTS = (("the?", "ال"), ("re", "وَ"), ("be", "بِ"), ("in", "لِ"), ("an", "يَ"), ("er", "سَيَ"), ("en", "تَ"), ("is", "نَ"), ("on", "أَ"), ("ha", "مُ"), ("st", "اسْتَ"), ("ou", "فَ"), ("ci", "كَ"))
ENDS = (("ing", "ُونَ"), ("tion", "َةٌ"), ("ed", "َتْ"), ("ly", "ًا"), ("er", "ِينَ"), ("es", "َاتٌ"), ("st", "ُوا"), ("nd", "هُمْ"), ("ea", "هَا"), ("nt", "تُمْ"), ("le", "َانِ"), ("en", "ٌ"), ("at", "ُ"), ("he", "ِ"), ("re", "ٍ"), ("sh", "هُ"), ("ti", "كُمْ"), ("or", "نَا"))
LATIN = "bcdfghjklmnpqrstvwxyzaeiouáéíóúñçßäöüèêàôîûâëï"
ARABIC = "بكدفغهجكلمنبقرستفوخيزَُُِِاةيوونشصعحئىءاؤيوآطظ"
assert len(LATIN) == len(ARABIC)


def spelling(x: str) -> str:
    for pattern, to in STARTS:
        x = sub(x, f"^{pattern}", to)
    for pattern, to in ENDS:
        x = sub(x, f"{pattern}$", to)
    return sub(f"translate({x}, '{LATIN}', '{ARABIC}')", f"^([{M}])", "ا@1")


def spelled(token: Column) -> Column:
    """A token's spelling as a column, for tokens in arrays."""
    x = token
    for pattern, to in STARTS:
        x = F.regexp_replace(x, f"^{pattern}", to)
    for pattern, to in ENDS:
        x = F.regexp_replace(x, f"{pattern}$", to)
    x = F.regexp_replace(F.translate(x, LATIN, ARABIC), f"^([{M}])", "ا$1")
    for form, tokens, _, _ in FUNCTION_WORDS:
        mine = [t for t in tokens.split() if (t, form) in SPELLINGS.rows]
        x = F.when(token.isin(mine), F.lit(form)).otherwise(x) if mine else x
    return x


def spelled_words(tokens: DataFrame) -> DataFrame:
    """(id, word): each distinct token with its spelling."""
    known = tokens.join(F.broadcast(SPELLINGS.frame(tokens.sparkSession)), "token", "left")
    return known.select(F.col("token").alias("id"), F.coalesce("spelled", F.expr(for_spark(spelling("token")))).alias("word"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary: each distinct token (id) with its spelling (word), and behind ``~`` with its reading. Tokens are found once."""
    tokens = save(vocabulary(spark, sf_dir), "vocabulary")
    return spelled_words(tokens).unionByName(readings(tokens).select("id", "word"))


def written_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``words``, the read ones as scribes may have written them."""
    tokens = save(vocabulary(spark, sf_dir), "vocabulary")
    return spelled_words(tokens).unionByName(written(save(readings(tokens).select("id", "word"), "readings")))


SPELLED_SQL = f"""{SPELLINGS.sql()}, spelled AS (SELECT t.token AS id, coalesce(spelled, {for_duck(spelling("t.token"))}) AS word FROM (SELECT DISTINCT token FROM tokens) t LEFT JOIN spellings s ON s.token = t.token)"""
WORDS_SQL = f"""{READINGS_SQL}, {SPELLED_SQL}, words AS MATERIALIZED (SELECT * FROM spelled UNION ALL SELECT * FROM read_words)"""
WRITTEN_WORDS_SQL = f"""{WRITTEN_SQL}, {SPELLED_SQL}, words AS MATERIALIZED (SELECT * FROM spelled UNION ALL SELECT * FROM written)"""


# -- queries in stages ------------------------------------------------------------------------------------------------


def _columns(select: str) -> list[str]:
    """The columns of a select list: cut at commas outside parentheses."""
    out, depth = [""], 0
    for c in select:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [c.strip() for c in out]


@dataclass(frozen=True)
class Staged:
    """Columns on words stated once: lookups in rule tables, then stages of expressions, each seeing those before.

    ``lookups``: (table, key expression, key column, {new column: its column}); keys are unique in their tables.
    """

    stages: tuple[dict[str, str], ...]
    select: str
    lookups: tuple[tuple[Table, str, str, dict[str, str]], ...] = ()
    #: Stages after which the columns so far are written: a long chain of expressions is planned in parts.
    cuts: tuple[int, ...] = ()

    def frame(self, df: DataFrame, rules: Rules | None = None) -> DataFrame:
        for table, key, column, named in self.lookups:
            rows, few = (rules or Rules()).lookup(df.sparkSession, table, column)
            small = rows.select(F.col(column).alias("_key"), *[F.col(c).alias(n) for n, c in named.items()])
            df = df.withColumn("_at", F.expr(for_spark(key))).join(F.broadcast(small) if few else small, F.col("_at") == F.col("_key"), "left").drop("_at", "_key")
        for k, stage in enumerate(self.stages):
            df = df.selectExpr("*", *[f"{for_spark(e)} AS {n}" for n, e in stage.items()])
            if k + 1 in self.cuts:
                df = save(df.drop(*[c for c in df.columns if c.startswith("_")]), "stages")
        return df.selectExpr(*_columns(self.select))

    def sql(self, ctes: str = WORDS_SQL, source: str = "words") -> str:
        tables, out = {t.name: t.sql() for t, *_ in self.lookups}, source
        for table, key, column, named in self.lookups:
            columns = ", ".join(f"l.{c} AS {n}" for n, c in named.items())
            out = f"(SELECT s.*, {columns} FROM {out} AS s LEFT JOIN {table.name} AS l ON {for_duck(key)} = l.{column})"
        for k, stage in enumerate(self.stages):
            out = f"(SELECT *, {', '.join(f'{for_duck(e)} AS {n}' for n, e in stage.items())} FROM {out})"
            if k + 1 in self.cuts:  # as the job does, so that no planner unfolds the whole chain
                tables[f"cut{k}"] = f"cut{k} AS MATERIALIZED (SELECT * FROM {out})"
                out = f"cut{k}"
        return f"WITH {', '.join([ctes, *tables.values()])} SELECT {self.select} FROM {out}"

    def query(self):
        return lambda spark, sf_dir: self.frame(words(spark, sf_dir))
