"""Entries of many kinds from JSON, in one pass.

Each kind names the fields that may hold its surface, its classes and how sure they are, and which forms are ambiguous.
Lines are parsed once to variants, whatever their kind; a line that is no JSON, or holds no surface, is told as such and
counted, never silently dropped. The registry unites what all kinds say of one form: classes that differ take away the
certainty of each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulelens.functions import arabic as ar
from rulelens.operators.segmenter import CLOSED_WORDS
from rulelens.operators.tokens import _SQL_TOKENS, document_tokens
from rulelens.plans.joins import checked_join
from rulelens.plans.scratch import place, save
from rulelens.sources.readings import READINGS_SQL, readings


@dataclass(frozen=True)
class Kind:
    category: str
    fields: tuple[str, ...]
    classes: tuple[str, ...]
    priority: int
    #: A field whose text decides: (field, text, classes if it holds the text).
    told_by: tuple[str, str, tuple[str, ...]] | None = None
    #: Stripped forms that need their context, with the classes and the priority they have.
    ambiguous: tuple[str, ...] = ()
    ambiguous_classes: tuple[str, ...] = ()
    ambiguous_priority: int = 6
    needs_context: bool = False
    #: Whether only the first line of a surface counts.
    once: bool = False


BUILT, PARTICLE, RELATIVE, VERB = "ISM_MABNI", "HARF", "ISM_MAWSOOL", "FIIL"
#: The sixteen kinds; interrogatives come from two sources. Fixed values.
KINDS = (
    Kind("demonstrative", ("name",), (BUILT,), 8), Kind("relative", ("name", "relative"), (RELATIVE,), 8, ambiguous=("من", "ما"), ambiguous_classes=(RELATIVE, BUILT, PARTICLE)), Kind("pronoun", ("pronoun_form", "pronoun"), (BUILT,), 9), Kind("built_in_adverb", ("adverb",), (BUILT,), 8),
    Kind("interrogative", ("tool",), (PARTICLE,), 8, told_by=("type", "اسم", (BUILT,)), ambiguous=("من", "ما"), ambiguous_classes=(BUILT, PARTICLE, RELATIVE)), Kind("interrogative_letter", ("tool",), (BUILT,), 8, told_by=("type", "حرف", (PARTICLE,))),
    Kind("conditional", ("particle",), (BUILT,), 8, told_by=("grammatical_function", "حرف", (PARTICLE,)), ambiguous=("من", "ما", "ايا", "اينما", "حيثما"), ambiguous_classes=(BUILT, PARTICLE)), Kind("conjunction", ("letter",), (PARTICLE,), 9),
    Kind("jazm", ("tool",), (PARTICLE,), 8, ambiguous=("من", "ما", "مهما", "حيثما"), ambiguous_classes=(BUILT, PARTICLE)), Kind("naseb", ("tool",), (PARTICLE,), 8, ambiguous=("ان", "انما", "لن", "لكن"), ambiguous_classes=(PARTICLE,), ambiguous_priority=7),
    Kind("preposition", ("preposition",), (PARTICLE,), 9, once=True), Kind("vocative", ("particle",), (PARTICLE,), 9), Kind("answer_particle", ("particle",), (PARTICLE,), 8), Kind("copulative", ("copulative_particle",), (PARTICLE,), 8),
    Kind("functional_substitute", ("noun", "name", "tool"), (BUILT,), 7), Kind("kinaya", ("name",), (BUILT,), 7, needs_context=True), Kind("verb_name", ("name",), (VERB, BUILT), 7),
)
#: Classes of an ambiguous form in the order they are named. Fixed values.
ORDER = (RELATIVE, BUILT, VERB, "ISM_MUARAB", "JAMID", PARTICLE)
#: From this priority on a class can be certain.
SURE = 8


def _plain(x: Column) -> Column:
    """Without marks, hamzas on alif folded: how ambiguous forms are listed."""
    return F.translate(ar.strip_all(x), "أإآٱ", "اااا")


def entries(lines: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """(category, entry, status, surface, plain, normalized, classes, priority, needs_context, metadata) of each of the ``lines`` (category, line).

    ``status`` is ``ok``, ``malformed`` (no JSON object), ``no_surface``, ``unknown_kind``, or ``repeated`` for a later
    line of a kind that counts a surface once; only an ``ok`` entry has a surface and classes. ``entry`` is the line's id
    as text, the line's digest where it has none.
    """
    v = F.try_parse_json("line")
    fields = sorted({f for k in kinds for f in (*k.fields, *([k.told_by[0]] if k.told_by else []))} | {"id"})
    read = lines.select("category", "line", v.alias("_v")).withColumns({f"f_{x}": F.nullif(F.trim(F.try_variant_get("_v", f"$.{x}", "string")), F.lit("")) for x in fields})
    per_kind = lambda value, otherwise: _cases([(F.col("category") == k.category, value(k)) for k in kinds], otherwise)
    none = F.lit(None).cast("string")
    surface = per_kind(lambda k: F.coalesce(*[F.col(f"f_{x}") for x in k.fields]), none)
    read = read.withColumns({"surface": surface, "_object": F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))}).withColumn("_key", _plain(F.col("surface")))
    listed = lambda classes: F.array(*map(F.lit, classes))

    def classes(k: Kind) -> Column:
        told = F.when(F.contains(F.coalesce(F.col(f"f_{k.told_by[0]}"), F.lit("")), F.lit(k.told_by[1])), listed(k.told_by[2])).otherwise(listed(k.classes)) if k.told_by else listed(k.classes)
        return F.when(F.col("_key").isin(*k.ambiguous), listed(k.ambiguous_classes)).otherwise(told) if k.ambiguous else told

    asked = lambda k: (F.col("_key").isin(*k.ambiguous) if k.ambiguous else F.lit(False)) | F.lit(k.needs_context)
    priority = lambda k: F.when(F.col("_key").isin(*k.ambiguous), k.ambiguous_priority).otherwise(k.priority) if k.ambiguous else F.lit(k.priority)
    known = F.col("category").isin(*[k.category for k in kinds])
    status = F.when(~F.col("_object"), "malformed").when(~F.coalesce(known, F.lit(False)), "unknown_kind").when(F.col("surface").isNull(), "no_surface").otherwise("ok")
    told = read.withColumns({"status": status, "entry": F.coalesce(F.col("f_id"), F.sha2("line", 256))})
    # Of a kind that counts a surface once the least entry stays; minima are taken before they are shuffled.
    once = [k.category for k in kinds if k.once]
    first = save(told.where((F.col("status") == "ok") & F.col("category").isin(*once)).groupBy("category", "surface").agg(F.min("entry").alias("_first")), "json-first")
    told = checked_join(told.withColumns({"_c": F.coalesce("category", F.lit("")), "_s": F.coalesce("surface", F.lit(""))}), first.select(F.col("category").alias("_c"), F.col("surface").alias("_s"), "_first"), ["_c", "_s"])
    status = F.when((F.col("status") == "ok") & (F.col("entry") > F.col("_first")), "repeated").otherwise(F.col("status"))
    ok = lambda x: F.when(F.col("status") == "ok", x)
    return told.withColumn("status", status).select(
        "category", "entry", "status", ok(F.col("surface")).alias("surface"), ok(ar.strip_all(F.col("surface"))).alias("plain"), ok(ar.strict_key(F.col("surface"))).alias("normalized"),
        ok(per_kind(classes, F.array().cast("array<string>"))).alias("classes"), ok(per_kind(priority, F.lit(0))).alias("priority"), ok(per_kind(asked, F.lit(False))).alias("needs_context"), ok(F.to_json("_v")).alias("metadata"),
    )


def _cases(pairs: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """The value of the first condition that holds."""
    out = otherwise
    for condition, value in reversed(pairs):
        out = F.when(condition, value).otherwise(out)
    return out


def inventory(lines: DataFrame) -> DataFrame:
    """(category, lines, malformed, keys): what a source holds before anyone knows its kind."""
    keys = F.json_object_keys("line")
    each = lines.select("category", keys.alias("keys"), F.coalesce(F.schema_of_variant(F.try_parse_json("line")).startswith("OBJECT"), F.lit(False)).alias("good"))
    named = each.groupBy("category").agg(F.count("*").alias("lines"), F.sum((~F.col("good")).cast("long")).alias("malformed"), F.array_sort(F.collect_set(F.when(F.col("good"), F.array_join("keys", ",")))).alias("shapes"))
    return named.select("category", "lines", "malformed", F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform("shapes", lambda x: F.split(x, ","))))), ",").alias("keys"))


def registry(found: DataFrame) -> DataFrame:
    """Each ``ok`` entry with what all entries of its plain form say: classes, proof and blocker (A1, A2).

    A form with classes that differ between entries is a hypothesis that needs its context; so is an entry of several
    classes or one that needs its context; a low priority alone blocks certainty too.
    """
    ok = found.where("status = 'ok'")
    united = save(ok.select("plain", F.explode("classes").alias("class")).groupBy("plain").agg(F.collect_set("class").alias("all")), "json-united")
    e = checked_join(ok, united, ["plain"], "inner")
    several = F.size("all") > 1
    rank = F.array(*map(F.lit, ORDER))
    named = F.filter(rank, lambda c: F.array_contains(F.when(several, F.col("all")).otherwise(F.col("classes")), c))
    proof = F.when(several | F.col("needs_context") | (F.size("classes") > 1) | (F.col("priority") < SURE), "Hypothesis").otherwise("Certificate")
    blocker = F.when(several, F.concat(F.lit("cross_source_conflict:"), F.size("all").cast("string"), F.lit("_classes"))).when(F.col("needs_context") | (F.size("classes") > 1), "").when(F.col("priority") < SURE, F.concat(F.lit("priority_below_threshold:"), F.col("priority").cast("string"))).otherwise("")
    return e.select("category", "entry", "surface", "plain", "normalized", F.array_join(named, "|").alias("classes"), "priority", (F.col("needs_context") | several).alias("needs_context"), proof.alias("proof"), blocker.alias("blocker"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(category, line) of JSON lines under ``path``/<category>/; blank lines are none."""
    return spark.read.option("basePath", path).text(f"{path}/*").select(F.col("category"), F.col("value").alias("line")).where(F.trim("value") != "")


# -- the documents' closed words as sources ------------------------------------------------------------------------------

#: Which kind a closed word's tag feeds, and the field that holds it. Fixed values.
_SOURCES = (("PREP", "preposition", "preposition"), ("CONJ", "conjunction", "letter"), ("NEG", "answer_particle", "particle"), ("JUS", "jazm", "tool"), ("SUB", "naseb", "tool"), ("COND", "conditional", "particle"), ("INNA", "copulative", "copulative_particle"), ("MA", "interrogative", "tool"), ("DEM", "demonstrative", "name"), ("REL", "relative", "name"), ("3MS", "pronoun", "pronoun"), ("3FS", "pronoun", "pronoun_form"), ("3MP", "pronoun", "pronoun"), ("1CS", "pronoun", "pronoun_form"), ("2MS", "pronoun", "pronoun"), ("KANA", "verb_name", "name"), ("PV", "verb_name", "name"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(category, line): for each closed word that a document reads as, a JSON line of its kind, some of them broken or empty as sources have them."""
    each = document_tokens(spark, sf_dir).select("doc_id", F.explode(F.array_distinct(F.flatten("sents"))).alias("token"))
    known = save(readings(each.select("token").distinct()).where("kind = 'F'").select(F.expr("substr(id, 2)").alias("token"), "word"), "json-words")
    tags = CLOSED_WORDS.frame(spark).select(F.col("form").alias("word"), "tag")
    typed = checked_join(each, known, ["token"], "inner").join(F.broadcast(tags), "word")
    digit = F.substring(F.md5("token"), 30, 1)
    id = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "token")
    word = F.when(digit == "1", " ").otherwise(F.col("word"))
    line = _cases([(F.col("tag") == t, F.to_json(F.struct(id.alias("id"), word.alias(field), F.lit("حرف").alias("grammatical_function")))) for t, _, field in _SOURCES], F.lit(None).cast("string"))
    category = _cases([(F.col("tag") == t, F.lit(c)) for t, c, _ in _SOURCES], F.lit(None).cast("string"))
    return typed.select(category.alias("category"), F.when(digit == "0", F.substring(line, 1, 9)).otherwise(line).alias("line")).where("category is not null")


def written_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' lines, written as JSON-lines sources by kind and read back."""
    path = place(spark, "json-sources")
    document_lines(spark, sf_dir).select("category", F.col("line").alias("value")).write.partitionBy("category").text(path)
    return read_lines(spark, path)


def s18_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of each kind have each status, with what the good ones say."""
    e = save(entries(written_lines(spark, sf_dir)), "json-entries")
    return e.groupBy("category", "status", "surface", F.array_join("classes", "|").alias("classes"), "priority", "needs_context").agg(F.count("*").alias("lines"), F.min("entry").alias("first"))


def s37_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory(written_lines(spark, sf_dir))


def a02_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms by what the registry says of them, most sources first (A1, A2)."""
    r = registry(save(entries(written_lines(spark, sf_dir)), "json-entries"))
    return r.groupBy("plain", "classes", "proof", "blocker", "needs_context").agg(F.count("*").alias("entries"), F.count_distinct("category").alias("sources"))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in r) + ")" for r in rows)


_KINDS_SQL = "kinds AS (SELECT category, string_split(classes, '|') AS classes, priority::INT AS priority, context = 'True' AS context, string_split(amb, '|') AS amb, string_split(amb_classes, '|') AS amb_classes, amb_priority::INT AS amb_priority, once = 'True' AS once FROM (VALUES " + _values(
    # Lines carry the grammatical function of a particle, no other telling field.
    (k.category, "|".join(k.told_by[2] if k.told_by and k.told_by[0] == "grammatical_function" else k.classes), k.priority, k.needs_context, "|".join(k.ambiguous), "|".join(k.ambiguous_classes), k.ambiguous_priority, k.once) for k in KINDS
) + ") AS k(category, classes, priority, context, amb, amb_classes, amb_priority, once))"
_LINES_SQL = f"""{READINGS_SQL}, {CLOSED_WORDS.sql()}, sources AS (SELECT * FROM (VALUES {_values(_SOURCES)}) AS s(tag, category, field)), {_KINDS_SQL},
each_of AS (SELECT DISTINCT t.doc_id, t.token FROM tokens t),
lines AS (
  SELECT s.category, s.field, w.word, substr(md5(token), 30, 1) AS digit, coalesce(e.doc_id::VARCHAR, '') || ':' || token AS id FROM each_of e JOIN (SELECT substr(id, 2) AS token, word FROM readings WHERE kind = 'F') w USING (token) JOIN closed_words c ON c.form = w.word JOIN sources s ON s.tag = c.tag
),
stated AS (
  SELECT l.*, k.*  EXCLUDE (category, classes, priority, context), translate(regexp_replace(word, '[{ar.ALL_MARKS}]', '', 'g'), 'أإآٱ', 'اااا') AS key, CASE digit WHEN '0' THEN 'malformed' WHEN '1' THEN 'no_surface' ELSE 'ok' END AS status0, k.classes AS k_classes, k.priority AS k_priority, k.context AS k_context
  FROM lines l JOIN kinds k USING (category)
),
found AS (
  SELECT category, id, word, CASE WHEN status0 = 'ok' AND once AND id > min(CASE WHEN status0 = 'ok' THEN id END) OVER (PARTITION BY category, word) THEN 'repeated' ELSE status0 END AS status, CASE WHEN list_contains(amb, key) THEN amb_classes ELSE k_classes END AS classes,
    CASE WHEN list_contains(amb, key) THEN amb_priority ELSE k_priority END AS priority, k_context OR list_contains(amb, key) AS needs_context FROM stated
)"""
S18 = f"""WITH {_LINES_SQL} SELECT category, status, CASE WHEN status = 'ok' THEN word END AS surface, CASE WHEN status = 'ok' THEN array_to_string(classes, '|') END AS classes, CASE WHEN status = 'ok' THEN priority END AS priority, CASE WHEN status = 'ok' THEN needs_context END AS needs_context, count(*) AS lines,
  min(CASE WHEN status = 'malformed' THEN sha256('{{"id":"' || left(id, 2)) ELSE id END) AS first FROM found GROUP BY 1, 2, 3, 4, 5, 6"""
S37 = f"""WITH {_LINES_SQL} SELECT category, count(*) AS lines, count(*) FILTER (digit = '0') AS malformed, coalesce((SELECT string_agg(DISTINCT x, ',' ORDER BY x) FROM (SELECT unnest(['id', 'grammatical_function', l2.field]) AS x FROM lines l2 WHERE l2.category = l.category AND l2.digit <> '0')), '') AS keys FROM lines l GROUP BY category"""
A02 = f"""WITH {_LINES_SQL}, ok AS (SELECT *, regexp_replace(word, '[{ar.ALL_MARKS}]', '', 'g') AS plain FROM found WHERE status = 'ok'), united AS (SELECT plain, list(DISTINCT c) AS every_class FROM (SELECT plain, unnest(classes) AS c FROM ok) GROUP BY plain),
said AS (SELECT o.*, len(every_class) AS n, list_filter([{", ".join(f"'{c}'" for c in ORDER)}], lambda c: list_contains(CASE WHEN len(every_class) > 1 THEN every_class ELSE classes END, c)) AS named FROM ok o JOIN united USING (plain))
SELECT plain, array_to_string(named, '|') AS classes, CASE WHEN n > 1 OR needs_context OR len(classes) > 1 OR priority < {SURE} THEN 'Hypothesis' ELSE 'Certificate' END AS proof,
  CASE WHEN n > 1 THEN 'cross_source_conflict:' || n || '_classes' WHEN needs_context OR len(classes) > 1 THEN '' WHEN priority < {SURE} THEN 'priority_below_threshold:' || priority ELSE '' END AS blocker, needs_context OR n > 1 AS needs_context, count(*) AS entries, count(DISTINCT category) AS sources FROM said GROUP BY ALL"""

QUERIES = {"s18_entries": s18_entries, "s37_inventory": s37_inventory, "a02_conflicts": a02_conflicts}
ORACLE = {"s18_entries": S18, "s37_inventory": S37, "a02_conflicts": A02}
