"""Tiered lookups, registries and predicates (J1 to J4, A1 to A3, F1, F2, X)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rulelens.functions import arabic as ar
from rulelens.operators.morphology import M13_SQL, classes
from rulelens.plans.joins import checked_join
from rulelens.plans.scratch import save
from rulelens.sources.readings import READINGS_SQL, read_words
from rulelens.sources.rules import LEXICON, Table
from rulelens.sources.spelled import WORDS_SQL, WRITTEN_WORDS_SQL, words, written_words

_STRICT = f"regexp_replace(translate(replace({{0}}, '{ar.TATWEEL}', ''), 'ٱآإأٰؤ', 'اااااا'), '[{ar.ALL_MARKS}]', '', 'g')"
_NORM = f"translate(replace({{0}}, '{ar.TATWEEL}', ''), '{ar.WASLA}', 'ا')"
_SHADDAS = "(length({0}) - length(replace({0}, 'ّ', '')))"


def norm_key(x: Column) -> Column:
    return ar.wasla_to_alif(ar.drop_tatweel(x))


def shaddas(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit("ّ"), F.lit("")))


def index(lexicon: DataFrame, key: Column) -> DataFrame:
    """One row a key: its first entry and whether entries of several classes share it."""
    return lexicon.groupBy(key.alias("key")).agg(F.min_by(F.struct("entry", "class", "tag"), "entry").alias("best"), (F.count_distinct("class") > 1).alias("ambiguous"))


def tiered(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Exact, then normalised, then stripped; an ambiguous normalised key stops the cascade with nothing.

    The stripped tier serves verbs only and only where it is unambiguous.
    """
    exact = F.broadcast(index(lexicon, F.col("form"))).select(F.col("key").alias("k0"), F.col("best").alias("b0"))
    norm = F.broadcast(index(lexicon, norm_key(F.col("form")))).select(F.col("key").alias("k1"), F.col("best").alias("b1"), F.col("ambiguous").alias("a1"))
    strict = F.broadcast(index(lexicon, ar.strict_key(F.col("form"))).where("not ambiguous and best.class = 'VERB'")).select(F.col("key").alias("k2"), F.col("best").alias("b2"))
    j = words.join(exact, F.col("word") == F.col("k0"), "left").join(norm, norm_key(F.col("word")) == F.col("k1"), "left").join(strict, ar.strict_key(F.col("word")) == F.col("k2"), "left")
    tier = F.when(F.col("b0").isNotNull(), "exact").when(F.col("a1"), "ambiguous").when(F.col("b1").isNotNull(), "normalized").when(F.col("b2").isNotNull(), "strict").otherwise("none")
    best = F.when(F.col("b0").isNotNull(), F.col("b0")).when(F.col("a1"), None).otherwise(F.coalesce("b1", "b2"))
    return j.withColumn("tier", tier).withColumn("best", best)


def j01_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiered(written_words(spark, sf_dir), LEXICON.frame(spark)).select("id", "tier", "best.entry", "best.class", "best.tag")


def _index(name: str, key: str) -> str:
    return f"{name} AS (SELECT {key} AS key, arg_min(struct_pack(entry := entry, class := class, tag := tag), entry) AS best, count(DISTINCT class) > 1 AS ambiguous FROM lexicon GROUP BY {key})"


J01 = f"""WITH {WRITTEN_WORDS_SQL}, {LEXICON.sql()}, {_index("e", "form")}, {_index("n", _NORM.format("form"))}, {_index("s", _STRICT.format("form"))},
j AS (SELECT id, e.best AS b0, n.best AS b1, n.ambiguous AS a1, s.best AS b2 FROM words LEFT JOIN e ON word = e.key LEFT JOIN n ON {_NORM.format("word")} = n.key
  LEFT JOIN s ON {_STRICT.format("word")} = s.key AND NOT s.ambiguous AND s.best.class = 'VERB'),
b AS (SELECT id, CASE WHEN b0 IS NOT NULL THEN 'exact' WHEN a1 THEN 'ambiguous' WHEN b1 IS NOT NULL THEN 'normalized' WHEN b2 IS NOT NULL THEN 'strict' ELSE 'none' END AS tier, CASE WHEN b0 IS NOT NULL THEN b0 WHEN a1 THEN NULL ELSE coalesce(b1, b2) END AS best FROM j)
SELECT id, tier, best.entry AS entry, best.class AS class, best.tag AS tag FROM b"""


def j04_strict_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact forms, else stripped ones with as many shaddas; best priority first."""
    w, x = written_words(spark, sf_dir), LEXICON.frame(spark)
    exact = w.join(F.broadcast(x), F.col("word") == F.col("form")).withColumn("how", F.lit(0))
    plain = w.join(F.broadcast(x), (ar.strip_all(F.col("word")) == ar.strip_all(F.col("form"))) & (shaddas(F.col("word")) == shaddas(F.col("form")))).withColumn("how", F.lit(1))
    best = Window.partitionBy("id").orderBy("how", F.desc("priority"), "entry")
    return exact.unionByName(plain).withColumn("rank", F.row_number().over(best)).where("rank = 1").select("id", "how", "entry", "needs_context")


J04 = f"""WITH {WRITTEN_WORDS_SQL}, {LEXICON.sql()}, u AS (SELECT id, 0 AS how, l.* FROM words JOIN lexicon l ON word = form UNION ALL
SELECT id, 1, l.* FROM words JOIN lexicon l ON regexp_replace(word, '[{ar.ALL_MARKS}]', '', 'g') = regexp_replace(form, '[{ar.ALL_MARKS}]', '', 'g') AND {_SHADDAS.format("word")} = {_SHADDAS.format("form")})
SELECT id, how, entry, needs_context FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY how, priority DESC, entry) = 1"""

#: Order in which classes are named.
CLASS_ORDER = ("NOUN", "VERB", "PARTICLE")


def a01_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate classes of each stripped key with the certainty they allow (A1, A2, and the certainty rule).

    Candidates are the classes that the cascade gives the documents' words, with a priority by how sure it is, and the
    lexicon's entries of the same keys.
    """
    w = read_words(spark, sf_dir).select("word")
    counted = w.groupBy("word").agg(F.count("*").alias("times"))
    by_proof = F.when(F.col("proof") == "Certificate", 9).when(F.col("proof") == "Hypothesis", 7).otherwise(3)
    told = checked_join(counted, classes(counted), ["word"], "inner").select(ar.strip_all(F.col("word")).alias("key"), "class", by_proof.alias("priority"), F.lit(False).alias("needs_context"))
    told = save(told, "registry")
    listed = LEXICON.frame(spark).select(ar.strip_all(F.col("form")).alias("key"), "class", "priority", "needs_context").join(told.select("key").distinct(), "key", "left_semi")
    k = told.unionByName(listed).groupBy("key").agg(F.array_join(F.sort_array(F.collect_set("class")), "|").alias("classes"), F.count_distinct("class").alias("n"), F.max("priority").alias("priority"), F.max("needs_context").alias("context"), F.count("*").alias("sources"))
    kind = F.when((F.col("n") == 1) & ~F.col("context") & (F.col("priority") >= 8), "Certificate").otherwise("Hypothesis")
    return k.withColumn("proof", kind)


A01 = f"""WITH {LEXICON.sql()}, told AS (SELECT DISTINCT word, class, proof FROM (SELECT w.word, c.class, c.proof FROM (WITH {READINGS_SQL} SELECT id, word FROM read_words) w JOIN ({M13_SQL}) c USING (id))),
candidates AS (SELECT regexp_replace(word, '[{ar.ALL_MARKS}]', '', 'g') AS key, class, CASE proof WHEN 'Certificate' THEN 9 WHEN 'Hypothesis' THEN 7 ELSE 3 END AS priority, false AS needs_context FROM told),
both_of AS (SELECT * FROM candidates UNION ALL SELECT regexp_replace(form, '[{ar.ALL_MARKS}]', '', 'g'), class, priority, needs_context FROM lexicon WHERE regexp_replace(form, '[{ar.ALL_MARKS}]', '', 'g') IN (SELECT key FROM candidates)),
k AS (SELECT key, string_agg(DISTINCT class, '|' ORDER BY class) AS classes, count(DISTINCT class) AS n, max(priority) AS priority, bool_or(needs_context) AS context, count(*) AS sources FROM both_of GROUP BY 1)
SELECT *, CASE WHEN n = 1 AND NOT context AND priority >= 8 THEN 'Certificate' ELSE 'Hypothesis' END AS proof FROM k"""

# -- predicates compiled from tables ---------------------------------------------------------------------------------

#: Rules: label, priority, and a conjunction of atoms; the first in order of priority that holds decides.
PREDICATES = Table("predicates", "label priority condition", "string int string", (
    ("article", 1, "startswith_any:ال|ٱل AND not_endswith:ة"), ("feminine", 2, "endswith:ة|ةٌ|ة"), ("tanwin", 3, "contains_any:ً|ٌ|ٍ"), ("future", 4, "startswith_any:سَ AND contains_at:2:ي|ت|ن"),
    ("short", 5, "max_length:4 AND not_empty:"), ("sound_plural", 6, "endswith:ونَ|ينَ"), ("empty", 7, "is_empty:"), ("rest", 99, "always_true:"), ("broken", 0, "no_such_atom:x"),
))


def atom(x: Column, text: str) -> Column:
    """One atom as a column; an unknown atom never holds, and nothing but is_empty and always_true holds of an empty side (F1)."""
    name, _, rest = text.partition(":")
    values = [v for v in rest.split("|") if v]
    some = lambda f: reduce(lambda a, b: a | b, (f(F.lit(v)) for v in values), F.lit(False))
    full = x.isNotNull() & (x != "")
    place, _, letters = rest.partition(":")
    out = {
        "always_true": F.lit(True), "is_empty": ~full, "not_empty": full, "startswith_any": full & some(lambda v: F.startswith(x, v)), "not_startswith_any": full & ~some(lambda v: F.startswith(x, v)),
        "endswith": full & some(lambda v: F.endswith(x, v)), "not_endswith": full & ~some(lambda v: F.endswith(x, v)), "contains_any": full & some(lambda v: F.contains(x, v)), "not_contains_any": full & ~some(lambda v: F.contains(x, v)),
        "equals": full & some(lambda v: x == v), "not_equals": full & bool(values) & ~some(lambda v: x == v), "max_length": full & (F.length(x) <= int(rest)) if rest.isdigit() else F.lit(False),
        "contains_at": full & F.substring(x, int(place) + 1, 1).isin(letters.split("|")) if place.isdigit() else F.lit(False),
    }
    return F.coalesce(out.get(name, F.lit(False)), F.lit(False))


def holds(x: Column, condition: str) -> Column:
    """A conjunction split at `` AND ``; an empty one never holds (F2, Q11)."""
    parts = [p for p in condition.split(" AND ") if p.strip()]
    return reduce(lambda a, b: a & b, (atom(x, p) for p in parts)) if parts else F.lit(False)


def first_match(x: Column, rules: Table) -> Column:
    """The label of the first rule by priority that holds, as one ordered CASE."""
    out = None
    for label, _, condition in sorted(rules.rows, key=lambda r: r[1]):
        out = F.when(holds(x, condition), label) if out is None else out.when(holds(x, condition), label)
    return out


def f01_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).select("id", first_match(F.col("word"), PREDICATES).alias("label"))


F01 = f"""WITH {WORDS_SQL} SELECT id, CASE WHEN (starts_with(word, 'ال') OR starts_with(word, 'ٱل')) AND NOT ends_with(word, 'ة') THEN 'article' WHEN ends_with(word, 'ة') OR ends_with(word, 'ةٌ') THEN 'feminine'
WHEN regexp_matches(word, '[ً-ٍ]') THEN 'tanwin' WHEN starts_with(word, 'سَ') AND substr(word, 3, 1) IN ('ي', 'ت', 'ن') THEN 'future' WHEN word <> '' AND length(word) <= 4 THEN 'short'
WHEN ends_with(word, 'ونَ') OR ends_with(word, 'ينَ') THEN 'sound_plural' WHEN coalesce(word, '') = '' THEN 'empty' ELSE 'rest' END AS label FROM words"""

_MK = f"[{ar.ALL_MARKS}]*"


def f41_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar functions by family: last mark, letters, split at the second letter, gender and number, canonical hash."""
    w = F.coalesce("word", F.lit(""))
    plain = ar.strip_all(w)
    gender = F.when(plain.rlike("ة$"), "F").when(plain.rlike("ات$"), "F").otherwise("M")
    number = F.when(plain.rlike("ات$"), "PL").when(w.rlike("ُونَ?$"), "PL").when(w.rlike("َانِ?$"), "DU").when(w.rlike("ِينَ?$"), "PL_AMBIGUOUS").otherwise("SG")
    return words(spark, sf_dir).select("id", F.regexp_extract(w, f"([{ar.MARKS}])[^{ar.MARKS}]*$", 1).alias("last_mark"), F.length(plain).alias("letters"), F.regexp_extract(w, f"^((?:[^{ar.ALL_MARKS}]{_MK}){{2}})", 1).alias("head"), gender.alias("gender"), number.alias("number"), F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("|", "id", w), 256)).alias("seal"))


F41 = f"""WITH {WORDS_SQL}, x AS (SELECT id, coalesce(word, '') AS w, regexp_replace(coalesce(word, ''), '[{ar.ALL_MARKS}]', '', 'g') AS p FROM words)
SELECT id, regexp_extract(w, '([{ar.MARKS}])[^{ar.MARKS}]*$', 1) AS last_mark, length(p)::INT AS letters, regexp_extract(w, '^((?:[^{ar.ALL_MARKS}]{_MK}){{2}})', 1) AS head, CASE WHEN regexp_matches(p, 'ة$|ات$') THEN 'F' ELSE 'M' END AS gender,
CASE WHEN regexp_matches(p, 'ات$') THEN 'PL' WHEN regexp_matches(w, 'ُونَ?$') THEN 'PL' WHEN regexp_matches(w, 'َانِ?$') THEN 'DU' WHEN regexp_matches(w, 'ِينَ?$') THEN 'PL_AMBIGUOUS' ELSE 'SG' END AS number, 'sha256:' || sha256(id || '|' || w) AS seal FROM x"""

QUERIES = {"j01_tiered_lookup": j01_tiers, "j04_strict_resolve": j04_strict_resolve, "a01_registry": a01_registry, "f01_predicates": f01_predicates, "f41_scalars": f41_scalars}
ORACLE = {"j01_tiered_lookup": J01, "j04_strict_resolve": J04, "a01_registry": A01, "f01_predicates": F01, "f41_scalars": F41}
