"""Readings: vocalised Arabic words for the documents' tokens, each with the analysis it was built from.

The documents are written in Latin letters. So that the operators on Arabic words have whole tables of them to run on,
every token reads as a real Arabic word: the digest of the token picks a stem with its root from a table, what stands
before it and what follows, all by tables, joined by the rules of spelling. What a word was built from is its expected
analysis, against which the operators' results are measured. Operators take any table of ids and words; nothing in them
knows of this one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulelens.functions import arabic as ar
from rulelens.functions.arrays import let
from rulelens.operators.tokens import _SQL_TOKENS, WORD, documents
from rulelens.plans.scratch import save
from rulelens.sources.rules import Table

#: Stems by kind, with roots: PV past, IV present, CV command, N nouns, T nouns in ta marbuta, F words that stand alone. Fixed values.
_STEMS = (
    ("PV", "VERB", "كَتَب:كتب نَصَر:نصر وَجَد:وجد عَلِم:علم شَرِب:شرب خَرَج:خرج دَخَل:دخل جَلَس:جلس فَتَح:فتح سَمِع:سمع ذَهَب:ذهب رَجَع:رجع عَلَّم:علم كَلَّم:كلم قَاتَل:قتل أَرْسَل:رسل أَكْرَم:كرم تَعَلَّم:علم اجْتَمَع:جمع انْكَسَر:كسر اسْتَغْفَر:غفر أَكَل:اكل"),
    ("IV", "VERB", "يَكْتُب:كتب يَعْلَم:علم يَخْرُج:خرج يَدْخُل:دخل يَفْتَح:فتح يَجْلِس:جلس يُكْرِم:كرم يُعَلِّم:علم يَسْتَغْفِر:غفر يَجْتَمِع:جمع"),
    ("CV", "VERB", "اكْتُب:كتب ادْخُل:دخل اخْرُج:خرج اجْلِس:جلس افْتَح:فتح"),
    ("N", "NOUN", "كِتَاب:كتب رَجُل:رجل قَلَم:قلم عِلْم:علم رَسُول:رسل كَرِيم:كرم عَالِم:علم كَاتِب:كتب مَكْتُوب:كتب مُعَلِّم:علم شَمْس:شمس قَمَر:قمر جَبَل:جبل حَدِيث:حدث صَبْر:صبر طَالِب:طلب دَرْس:درس نَصْر:نصر مَسْجِد:سجد بَحْر:بحر رَحِيم:رحم جِهَاد:جهد قُلُوب:قلب دُرُوس:درس"),
    ("T", "NOUN", "مَدْرَس:درس مَكْتَب:كتب شَجَر:شجر رَحْم:رحم جَنّ:جنن سَاع:سوع"),
    ("F", "PARTICLE", "مِنْ: فِي: إِلَى: عَلَى: ثُمَّ: لَا: لَمْ: لَنْ: إِذَا: أَنْ: إِنَّ: مَا: مَنْ:"),
    ("F", "PRON", "هُوَ: هِيَ: هُمْ: أَنَا: أَنْتَ:"), ("F", "DEM", "هَذَا: ذَلِكَ:"), ("F", "REL", "الَّذِي: الَّذِينَ:"), ("F", "VERB", "قَالَ: كَانَ: قُلْ: صَارَ:"),
    ("F", "PARTICLE", "يَا: أَيْنَ: مَتَى: حَيْثُ: أَيُّ:"), ("F", "TIME", "غَدًا: أَمْسِ: الْيَوْمَ:"),
)
STEMS = Table("stems", "nr kind class stem root", "int string string string string", tuple((nr, *r) for nr, r in enumerate(
    (kind, cls, *(x or None for x in ar.ordered(entry).split(":"))) for kind, cls, entries in _STEMS for entry in entries.split()
)))

#: What may stand before a stem of a kind, in parts, and which endings go with it. Fixed values.
_BEFORE = {
    "PV": (("", "a"), ("", "a"), ("", "a"), ("وَ", "a"), ("فَ", "a")),
    "IV": (("", "b"), ("", "b"), ("وَ", "b"), ("سَ", "b"), ("فَ+سَ", "b"), ("وَ+لْ", "j"), ("فَ+لْ", "j"), ("فَ+لْ", "j")),
    "CV": (("", "c"), ("وَ", "c"), ("فَ", "c")),
    "N": (("", "p"), ("", "t"), ("", "t"), ("وَ", "p"), ("بِ", "g"), ("الْ", "d"), ("الْ", "d"), ("وَ+الْ", "d"), ("بِ+الْ", "e"), ("لِ+لْ", "e")),
    "T": (("", "i"), ("الْ", "h"), ("وَ+الْ", "h"), ("بِ+الْ", "k"), ("لِ+لْ", "k")),
    "F": (("", "n"),),
}
BEFORE = Table("before_stem", "kind slot pre ending", "string int string string", tuple((k, s, p, e) for k, rows in _BEFORE.items() for s, (p, e) in enumerate(rows)))
#: Endings by group: the stem's last vowel, then suffixes in parts. Fixed values.
_ENDINGS = {
    "a": (("َ", ""), ("َ", ""), ("َ", "تْ"), ("ْ", "تُ"), ("ْ", "تُمْ"), ("ُ", "وا"), ("َ", "هُ"), ("َ", "هُمْ"), ("َ", "هَا"), ("ْ", "نَا+هُمْ")),
    "b": (("ُ", ""), ("ُ", ""), ("ُ", "ونَ"), ("ُ", "هُ"), ("ُ", "هُمْ")), "j": (("ْ", ""), ("ُ", "وا")), "c": (("ْ", ""), ("ُ", "وا")),
    "p": (("ُ", "هُمْ"), ("َ", "هَا"), ("ِ", "كُمْ"), ("ُ", "نَا"), ("ُ", "هُ")), "t": (("ٌ", ""), ("ٍ", "")), "g": (("ِ", "هِمْ"), ("ٍ", ""), ("ِ", "هَا")), "d": (("ُ", ""), ("َ", ""), ("ِ", "")), "e": (("ِ", ""),),
    "i": (("َ", "ةٌ"), ("َ", "ةٍ"), ("َ", "تُ+هُمْ")), "h": (("َ", "ةُ"), ("َ", "ةِ")), "k": (("َ", "ةِ"),), "n": (("", ""),),
}
ENDINGS = Table("endings", "ending place vowel post", "string int string string", tuple((k, s, v, p) for k, rows in _ENDINGS.items() for s, (v, p) in enumerate(rows)))
_N_BEFORE = {k: len(v) for k, v in _BEFORE.items()}
_N_ENDINGS = {k: len(v) for k, v in _ENDINGS.items()}

#: How a word may be written beside its plain form, by digest: mark before shadda, lengthened, wasla, pause sign, blanks, digits after it, hamza apart.
WAYS = ("plain", "plain", "plain", "plain", "plain", "plain", "shadda_last", "tatweel", "wasla", "pause", "blanks", "digits", "apart", "madda", "dagger", "plain")


def _size(column: str, sizes: dict[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in sizes.items()) + " END"


#: A way to build a word is one number: its stem's, then two digits each for what stands before it and for its ending.
_STEM, _SLOT = 10_000, 100


def _digested(token: Column, bind: Callable[[Column, Callable[[Column], Column]], Column], stem: int, slot: int) -> Column:
    """A token's stem, slot and place by its digest, as one number; ``bind`` names what is used several times."""
    kinds, slots = list(_BEFORE), max(_N_BEFORE.values())
    listed = lambda values: F.expr(f"array({', '.join(map(str, values))})")
    endings = [_N_ENDINGS[_BEFORE[k][s][1]] if s < _N_BEFORE[k] else 0 for k in kinds for s in range(slots)]
    # The digest's digits 2 to 16 as one number; the first seven, digits 9 to 12 and 13 to 16 are taken from it.
    digits = lambda d: F.conv(F.substring(d, 2, 15), 16, 10).cast("bigint")
    first = lambda d: F.instr(F.lit("123456789abcdef"), F.substring(d, 1, 1)).cast("bigint")

    def numbered(digits: Column, nr: Column) -> Column:
        kind = F.get(listed(kinds.index(r[1]) for r in STEMS.rows), nr)
        return bind(kind, lambda kind: bind(
            (F.shiftright(digits, 16).bitwiseAND(F.lit(0xFFFF)) % F.get(listed(_N_BEFORE[k] for k in kinds), kind)).cast("int"),
            lambda at: nr * stem + at * slot + (digits.bitwiseAND(F.lit(0xFFFF)) % F.get(listed(endings), kind * slots + at)).cast("int"),
        ))

    return bind(F.md5(token), lambda d: bind(digits(d), lambda n: bind(((F.shiftleft(first(d), 24) + F.shiftright(n, 36)) % len(STEMS.rows)).cast("int"), lambda nr: numbered(n, nr))))


def reading_code(token: Column) -> Column:
    """The number of the form (``forms``) that a token reads as, by its digest alone; null for null.

    Join by it to the left: an inner join would test for nulls first, and work out every digest again for that.
    """
    return _digested(token, lambda value, body: body(value), _STEM, _SLOT)


#: Places that a stem's forms take in an array: one digit each for what stands before it and for its ending.
_PLACES = 100
assert max(*_N_BEFORE.values(), *_N_ENDINGS.values()) <= 10


def array_place(token: Column) -> Column:
    """The place of a token's form in the array that ``by_place`` gives, for tokens that stay in their row's array."""
    return _digested(token, let, _PLACES, 10)


def by_place(told: DataFrame, *columns: str) -> DataFrame:
    """One row with one array: the ``columns`` of ``told`` (code, ...) at their form's ``array_place``, null where no form is.

    The forms are bounded whatever the documents hold, so this array can be sent to all tasks as one value (``scalar``).
    Unlike a join, a look in it leaves rows in the order in which they stand.
    """
    placed = told.select(F.expr(f"cast(code div {_STEM} * {_PLACES} + code div {_SLOT} % {_SLOT} * 10 + code % {_SLOT} as bigint)").alias("id"), F.struct(*columns).alias("_form"))
    every = told.sparkSession.range(len(STEMS.rows) * _PLACES).join(F.broadcast(placed), "id", "left")
    return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "_form"))), lambda x: x["_form"]).alias("forms"))


def read_array(spark: SparkSession, tokens: Column) -> Column:
    """The readings of an array of tokens, in the array: for tokens that stay in their row. The forms are a bounded list of words."""
    words = [""] * (len(STEMS.rows) * _PLACES)
    for r in forms(spark).select("code", "word").collect():
        words[r.code // _STEM * _PLACES + r.code // _SLOT % _SLOT * 10 + r.code % _SLOT] = r.word
    listed = F.split(F.lit("|".join(words)), "[|]")
    return F.transform(tokens, lambda x: F.get(listed, array_place(x)))


def forms(spark: SparkSession) -> DataFrame:
    """(code, word, kind, class, root, prefixes, stem, suffixes): every form that the tables can build, some thousands; bounded, whatever the documents hold."""
    drawn = STEMS.frame(spark).join(F.broadcast(BEFORE.frame(spark)), "kind").join(F.broadcast(ENDINGS.frame(spark)), "ending")
    defined, first = F.endswith("pre", F.lit("لْ")) & (F.col("kind") != "IV"), F.substring("stem", 1, 1)
    sun = defined & first.rlike(f"[{ar.SUN}]")
    pre = F.when(sun, F.regexp_replace("pre", "ْ$", "")).otherwise(F.col("pre"))
    stem = F.concat(F.when(sun, F.concat(first, F.lit("ّ"), F.expr("substr(stem, 2)"))).otherwise(F.col("stem")), F.col("vowel"))
    drawn = drawn.select((F.col("nr") * _STEM + F.col("slot") * _SLOT + F.col("place")).alias("code"), "kind", "class", "root", pre.alias("pre"), stem.alias("whole"), F.col("post").alias("suffixes"))
    # The letter of the present, unless lam commands, and the alif of a command are prefixes too.
    front = F.expr("CASE WHEN kind = 'IV' AND NOT endswith(pre, 'لْ') THEN 2 WHEN kind = 'CV' THEN 1 ELSE 0 END")
    drawn = drawn.withColumn("_front", front).withColumns({"prefixes": F.expr("concat_ws('+', nullif(pre, ''), nullif(left(whole, _front), ''))"), "stem": F.expr("substr(whole, _front + 1)")})
    return drawn.select("code", F.concat(F.replace("prefixes", F.lit("+"), F.lit("")), "stem", F.replace("suffixes", F.lit("+"), F.lit(""))).alias("word"), "kind", "class", "root", "prefixes", "stem", "suffixes")


def _read(coded: DataFrame) -> DataFrame:
    """(id, word, kind, class, root, prefixes, stem, suffixes) of ``coded`` (id, code)."""
    return coded.join(F.broadcast(forms(coded.sparkSession)), "code", "left").select("id", "word", "kind", "class", "root", "prefixes", "stem", "suffixes")


def _coded(tokens: DataFrame) -> DataFrame:
    return tokens.where("token is not null").select(F.concat(F.lit("~"), "token").alias("id"), reading_code(F.col("token")).alias("code"))


def readings(tokens: DataFrame) -> DataFrame:
    """(id, word, kind, class, root, prefixes, stem, suffixes) of each distinct ``token``; ids are the tokens behind ``~``."""
    return _read(_coded(tokens))


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' distinct tokens (``document_tokens``): a text's distinct pieces between blanks and ends of sentences.

    Edges are trimmed and letters lowered once a distinct piece, not at every place where it stands.
    """
    pieces = F.array_distinct(F.split("text", r"[.!?\x20\x09-\x0D]+"))
    distinct = documents(spark, sf_dir).select(F.explode(pieces).alias("piece")).distinct()
    return distinct.select(F.regexp_extract(F.lower("piece"), f"({WORD})", 1).alias("token")).distinct().where("token <> ''")


def read_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary's readings; the forms' numbers are written once: queries use them several times, and each use would cut all texts again."""
    return _read(save(_coded(vocabulary(spark, sf_dir)), "read-words"))


def way(id: Column) -> Column:
    return F.get(F.array(*map(F.lit, WAYS)), F.conv(F.substring(F.md5(id), 20, 1), 16, 10).cast("int"))


def written(words: DataFrame) -> DataFrame:
    """``words`` (id, word) as a scribe may have written them: marks in another order, signs, blanks, joined letters."""
    w, how = F.col("word"), way(F.col("id"))
    out = (
        F.when(how == "shadda_last", F.regexp_replace(w, "ّ([ً-ِ])", "$1ّ")).when(how == "tatweel", F.regexp_replace(w, "^(.[ً-ْ]*)", "$1ـ")).when(how == "wasla", F.regexp_replace(w, "^ا", "ٱ"))
        .when(how == "pause", F.concat(w, F.lit("ۚ"))).when(how == "blanks", F.concat(F.lit("  "), w, F.lit(" "))).when(how == "digits", F.concat(w, F.lit(" ٢٥"))).when(how == "apart", F.replace(w, F.lit("أ"), F.lit("أ")))
        .when(how == "madda", F.regexp_replace(w, "^أَ", "آ")).when(how == "dagger", F.regexp_replace(w, "َا", "َٰ")).otherwise(w)
    )
    return words.withColumn("word", out)


_DIGITS = "('0x' || substr(md5({0}), {1}, {2}))::BIGINT"
#: Common table expressions for the oracle: ``readings`` as the function gives them, ``read_words`` (id, word), ``written``.
READINGS_SQL = f"""{_SQL_TOKENS}, {STEMS.sql()}, {BEFORE.sql()}, {ENDINGS.sql()},
drawn AS (
  SELECT token, s.kind, class, stem, root, {_DIGITS.format("token", 9, 4)} AS h1, {_DIGITS.format("token", 13, 4)} AS h2
  FROM (SELECT DISTINCT token FROM tokens) t JOIN stems s ON s.nr = {_DIGITS.format("token", 1, 7)} % {len(STEMS.rows)}
), placed AS (
  SELECT d.*, b.pre, e.vowel, e.post, ends_with(b.pre, 'لْ') AND d.kind <> 'IV' AND regexp_matches(d.stem, '^[{ar.SUN}]') AS sun
  FROM drawn d JOIN before_stem b ON b.kind = d.kind AND b.slot = d.h1 % ({_size("d.kind", _N_BEFORE)}) JOIN endings e ON e.ending = b.ending AND e.place = d.h2 % ({_size("b.ending", _N_ENDINGS)})
), parts AS (
  SELECT token, kind, class, root, CASE WHEN sun THEN left(pre, length(pre) - 1) ELSE pre END AS pre, CASE WHEN sun THEN left(stem, 1) || 'ّ' || substr(stem, 2) ELSE stem END || vowel AS whole, post,
    CASE WHEN kind = 'IV' AND NOT ends_with(pre, 'لْ') THEN 2 WHEN kind = 'CV' THEN 1 ELSE 0 END AS front FROM placed
), fronted AS (SELECT '~' || token AS id, kind, class, root, concat_ws('+', nullif(pre, ''), nullif(left(whole, front), '')) AS prefixes, substr(whole, front + 1) AS stem, post AS suffixes FROM parts
), readings AS MATERIALIZED (SELECT id, replace(prefixes, '+', '') || stem || replace(suffixes, '+', '') AS word, kind, class, root, prefixes, stem, suffixes FROM fronted),
read_words AS (SELECT id, word FROM readings)"""
WRITTEN_SQL = f"""{READINGS_SQL}, how AS (SELECT id, word, [{", ".join(f"'{x}'" for x in WAYS)}][{_DIGITS.format("id", 20, 1)} + 1] AS how FROM read_words),
written AS (SELECT id, CASE how WHEN 'shadda_last' THEN regexp_replace(word, 'ّ([ً-ِ])', '\\1ّ', 'g') WHEN 'tatweel' THEN regexp_replace(word, '^(.[ً-ْ]*)', '\\1ـ') WHEN 'wasla' THEN regexp_replace(word, '^ا', 'ٱ')
  WHEN 'pause' THEN word || 'ۚ' WHEN 'blanks' THEN '  ' || word || ' ' WHEN 'digits' THEN word || ' ٢٥' WHEN 'apart' THEN replace(word, 'أ', chr(1575) || chr(1620)) WHEN 'madda' THEN regexp_replace(word, '^أَ', 'آ') WHEN 'dagger' THEN replace(word, 'َا', 'َٰ') ELSE word END AS word FROM how)"""
