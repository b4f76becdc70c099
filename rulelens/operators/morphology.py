"""Gates, verdicts and features of words over the vocabulary (F3 to F23, M13 to M22, M38, G9, G32 to G35, G44, X1 to X8 in part, N17, N23, N27, N28).

Each query states its rules once, as ordered conditions that both engines read; lookups are left joins of small rule
tables, broadcast with a known size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulelens.functions import arabic as ar
from rulelens.operators.alignment import ALIGNED_SQL, best_alignment
from rulelens.operators.segmenter import CLOSED_WORDS, ESSENCE, LIVING, PRONOUN, SEGMENTS_SQL, SINGULAR, segments
from rulelens.plans.joins import checked_join
from rulelens.plans.scratch import save
from rulelens.sources.readings import READINGS_SQL, read_words
from rulelens.sources.rules import Rules, Table
from rulelens.sources.spelled import CLOSED, Staged, cascade, letters, match, plain, shaddas, sub

A, M = ar.ALL_MARKS, ar.MARKS
L = f"[^{A}]"
MK = f"[{A}]*"

# -- rule tables ------------------------------------------------------------------------------------------------------


def _table(name: str, columns: str, types: str, rows) -> Table:
    return Table(name, columns, types, tuple(rows))


#: Closed class by stripped form: its category, and whether the form is ambiguous, so that only an exact one counts.
CLOSED_PLAIN = _table("closed_plain", "key category exact_only exact_form", "string string boolean string", (
    ("من", "PREP", True, "مِنْ"), ("في", "PREP", False, None), ("إلى", "PREP", False, None), ("على", "PREP", False, None), ("مع", "PREP", True, "مَعَ"), ("ثم", "CONJ", True, "ثُمَّ"), ("أو", "CONJ", False, None),
    ("لا", "NEG", False, None), ("لم", "JUS", True, "لَمْ"), ("إذا", "COND", False, None), ("أن", "SUB", True, "أَنْ"), ("إن", "INNA", True, "إِنَّ"), ("هذا", "DEM", False, None), ("ذلك", "DEM", False, None),
    ("هو", "PRON", False, None), ("هي", "PRON", False, None), ("هم", "PRON", True, "هُمْ"), ("أنا", "PRON", False, None), ("أنت", "PRON", True, "أَنْتَ"), ("الذي", "REL", False, None), ("ما", "INTG", True, "مَا"), ("يا", "VOC", False, None),
))
#: Verbs listed in full, and defective verbs with the relations of their topic and comment. Fixed values.
EXPLICIT = _table("explicit_verbs", "form", "string", tuple((f,) for f in "كَانَ قَالَ كَتَبَ عَلِمَ جَلَسَ فَتَحَ نِعْمَ بِئْسَ لَيْسَ أَكَلَ".split()))
DEFECTIVE = _table("defective_verbs", "key topic comment", "string string string", (("كان", "kana_topic", "kana_comment"), ("أصبح", "kana_topic", "kana_comment"), ("ظل", "kana_topic", "kana_comment"), ("ليس", "laysa_topic", "laysa_comment"), ("كاد", "kada_topic", "kada_comment")))
#: Vocalised lexica: uninflected verbs, interrogatives, foreign names, comparatives. Fixed values.
LEXICA = _table("lexica", "form kind", "string string", (("لَيْسَ", "uninflected_verb"), ("عَسَى", "uninflected_verb"), ("هَلْ", "interrogative"), ("كَيْفَ", "interrogative"), ("مَتَى", "interrogative"), ("إِبْرَاهِيمُ", "foreign_name"), ("يُوسُفُ", "foreign_name"), ("أَكْبَرُ", "comparative"), ("أَكْرَمَ", "comparative"), ("خَيْرٌ", "comparative")))
#: Labels of codes.
LABELS = _table("labels", "code label", "string string", (("PREP", "حرف جر"), ("CONJ", "حرف عطف"), ("NEG", "نفي"), ("DEM", "اسم إشارة"), ("REL", "اسم موصول"), ("COND", "شرط"), ("KANA", "فعل ناقص"), ("INNA", "حرف ناسخ"), ("VOC", "نداء"), ("INTG", "استفهام")))
#: Operators by their stripped form: id, group priority.
OPERATORS = _table("operators", "key operator grp", "string string int", (("من", "OP_MIN", 1), ("إلى", "OP_ILA", 1), ("على", "OP_ALA", 1), ("إن", "OP_INNA", 0), ("أن", "OP_AN", 0), ("لا", "OP_LA", 2), ("لم", "OP_LAM", 0), ("ثم", "OP_THUMMA", 3), ("إذا", "OP_IDHA", 2), ("ما", "OP_MA", 2)))

_CLOSED_FULL = (CLOSED, "word", "form", {"c_class": "class", "c_tag": "tag"})
_PEELED = sub("word", "^[وف]َ?")


def _first_suffix(suffixes: tuple[str, ...], least: int, name: str) -> dict[str, str]:
    """The first suffix in the list that leaves ``least`` letters."""
    ends = [(f"right(word, {len(x)}) = '{x}' AND {letters(f'left(word, greatest(0, length(word) - {len(x)}))')} >= {least}", f"'{x}'") for x in suffixes]
    return {name: cascade(*ends, otherwise="''")}


PRONOUN_ENDS = ("هُمَا", "كُمَا", "هُمْ", "هُنَّ", "كُمْ", "تُمْ", "هَا", "نَا", "كَ", "هُ", "هِ", "ي")

# -- gates ------------------------------------------------------------------------------------------------------------

#: Closed, function-word, essence, singular, living, explicit, defective and lexicon gates.
F05 = Staged(
    lookups=(
        _CLOSED_FULL, (CLOSED_PLAIN, plain("word"), "key", {"p_category": "category", "p_exact": "exact_only", "p_form": "exact_form"}), (ESSENCE, plain("word"), "key", {"e_form": "form", "e_sure": "unambiguous"}),
        (SINGULAR, plain("word"), "key", {"s_term": "term", "s_strategy": "strategy"}), (EXPLICIT, "word", "form", {"x_form": "form"}), (EXPLICIT, _PEELED, "form", {"x_peeled": "form"}),
        (DEFECTIVE, plain("word"), "key", {"d_topic": "topic"}), (DEFECTIVE, plain(_PEELED), "key", {"d_peeled": "topic"}), (LEXICA, "word", "form", {"lexicon": "kind"}), (LIVING, f"left({plain('word')}, 3)", "living", {"living_root": "living"}),
    ),
    stages=(
        {"bare": plain("word")},
        {
            "closed": cascade(("c_class IS NOT NULL", "'exact'"), ("p_category IS NOT NULL AND NOT p_exact", "'stripped'"), ("p_category IS NOT NULL", "'ambiguous'"), otherwise="'open'"),
            "function_word": cascade(
                ("c_class IS NOT NULL", "c_tag"), (match("word", "[ً-ٍ]") + " OR left(bare, 2) = 'ال' OR right(bare, 1) = 'ة'", "NULL"),
                (f"p_form IS NOT NULL AND {shaddas('word')} = {shaddas('p_form')}", "p_category"), ("NOT p_exact", "p_category"),
            ),
            "essence": cascade(("word = e_form", "'exact'"), ("e_sure", "'stripped'"), otherwise="'none'"),
            "singular": "coalesce(s_term || ':' || s_strategy, '-')",
            "explicit_verb": cascade(("x_form IS NOT NULL", "'exact'"), (match("word", "^[وف]") + " AND x_peeled IS NOT NULL", "'peeled'"), otherwise="'no'"),
            "defective": "coalesce(d_topic, d_peeled, '-')",
        },
    ),
    select="id, closed, function_word, essence, singular, explicit_verb, defective, coalesce(lexicon, '-') AS lexicon, living_root IS NOT NULL AS living",
)

#: What overrides a verb reading, in order, and broken plurals by shape.
_BROKEN = [f"^[أا]َ?{L}ْ?{MK}{L}{MK}ا{MK}{L}{MK}$", f"^{L}{MK}{L}ُ{MK}و{L}{MK}$", f"^م{MK}{L}{MK}ا{MK}{L}{MK}{L}{MK}$", f"^{L}{MK}{L}َ{MK}ا?ئ{MK}{L}{MK}$"]
F12 = Staged(
    lookups=(_CLOSED_FULL, (LEXICA, "word", "form", {"lexicon": "kind"})),
    stages=(
        {"bare": plain("word"), "broken_plural": " OR ".join(match("word", p) for p in _BROKEN), **_first_suffix(PRONOUN_ENDS, 2, "pronoun")},
        {
            "override": cascade(
                ("c_class IS NOT NULL AND c_class <> 'VERB'", "'closed'"), (match("word", "[ً-ٍ]"), "'tanwin'"), (match("bare", "^ال(ذ|ت)ي$"), "'relative'"), ("broken_plural AND pronoun <> ''", "'plural_with_pronoun'"),
                ("lexicon = 'foreign_name'", "'proper_noun'"), ("lexicon = 'comparative'", "'functional_noun'"), ("left(bare, 2) = 'ال'", "'article'"), ("right(bare, 1) = 'ة'", "'taa_marbuta'"),
                (match("word", "َانِ?$|َيْنِ?$"), "'dual'"), ("right(bare, 1) = 'ى'", "'alif_maqsura'"), (match("word", f"^تَ?{L}ْ?{MK}{L}ِي{MK}{L}{MK}$"), "'tafdeel'"), ("broken_plural", "'plural_pattern'"), otherwise="'none'",
            ),
        },
    ),
    select="id, override, broken_plural, pronoun",
)

#: The surface heuristic for verbs, with the reason.
_SURFACE = cascade(
    (match("word", "[ً-ٍ]"), "'tanwin'"), ("left(bare, 2) = 'ال'", "'article'"), (match("bare", "(ون|ين|ات)$") + " AND NOT " + match("word", "^[يتن][َُ]"), "'plural_ending'"),
    (match("word", "^سَ?[يتن][َُ]|^[يتن][َُ]") + " AND length(bare) >= 4", "'verb:imperfect'"), ("left(bare, 3) = 'است'", "'verb:istaf'"), (match("bare", "^(ان|اف)") + " AND length(bare) >= 4", "'verb:infa'"),
    (match("word", "(تُمْ|وا|َتْ|نَا)$") + " AND length(bare) >= 3", "'verb:suffix'"), (match("word", f"^{L}َ{L}[َُِ]{L}َ$"), "'verb:three_letters'"), otherwise="'none'",
)
F19 = Staged(lookups=(), stages=({"bare": plain("word")}, {"reason": _SURFACE}), select="id, reason, left(reason, 4) = 'verb' AS is_verb")

#: Atoms on the verbal pattern that a word shows, compiled; the first phase that holds decides.
F03 = Staged(
    lookups=(),
    stages=(
        {"bare": plain("word")},
        {"shown": sub("word", f"[^{A}اويتنم]", "ل")},
        {
            "atoms": "concat_ws(',', "
            + ", ".join(
                f"CASE WHEN {c} THEN '{n}' END"
                for n, c in (
                    ("starts:ya", "left(shown, 2) = 'يَ'"), ("starts_in:ytn", match("shown", "^[يتن][َُ]")), ("ends:wa", "right(shown, 2) = 'وا'"), ("plain_equals:3", "length(bare) = 3"), ("faail_with_kasra", match("shown", "^لَ?الِل")),
                    ("faail_with_fatha", match("shown", "^لَ?الَل")), ("tafdeel_afal", match("shown", "^ت?َ?لْ?لِيل|^أَلْلَل")), ("3chars_with_vowel_endings", match("shown", "^ل[َُِ]ل[َُِ]ل[َُِ]$")),
                )
            )
            + ")",
        },
        {"reading": cascade(("atoms = ''", "'unknown'"), (match("atoms", "tafdeel|faail_with_kasra"), "'nominal'"), (match("atoms", "starts|ends:wa|3chars"), "'verbal'"), (match("atoms", "faail_with_fatha"), "'verbal'"), otherwise="'ambiguous'")},
    ),
    select="id, shown, atoms, reading",
)

#: The word-class cascade with its source and kernel, aspect by tag, the closed kind by precedence. Reads
#: the words with their segments and aligned patterns.
_VERBAL_TAGS = "(LAM_AMR|FUT|IMPERF_PREF|IMP_PREF|SUBJ)"
M13 = Staged(
    lookups=(
        (CLOSED_WORDS, "word", "form", {"c_class": "class", "c_tag": "tag"}), (CLOSED_WORDS, "regexp_replace(word, '^[وف]َ', '')", "form", {"c1_class": "class", "c1_tag": "tag"}), (LEXICA, "word", "form", {"lexicon": "kind"}),
        (SINGULAR, plain("word"), "key", {"s_term": "term"}), (EXPLICIT, _PEELED, "form", {"x_form": "form"}), (ESSENCE, plain("word"), "key", {"e_form": "form", "e_sure": "unambiguous"}),
        (CLOSED_PLAIN, plain("word"), "key", {"p_category": "category", "p_exact": "exact_only"}), (DEFECTIVE, plain(_PEELED), "key", {"d_topic": "topic"}),
    ),
    stages=(
        {"bare": plain("word"), "after_and": f"c1_class IS NOT NULL AND {match('word', '^[وف]َ')}"},
        {
            "source": cascade(
                ("c_class IS NOT NULL OR after_and", "'registry'"), ("lexicon = 'comparative'", "'comparative'"), ("lexicon = 'uninflected_verb'", "'uninflected'"), ("lexicon = 'interrogative'", "'interrogative'"), ("lexicon = 'foreign_name'", "'foreign_name'"),
                ("p_category IS NOT NULL AND NOT p_exact", "'function_word'"), (match("word", f"^([وف]َ)?([بلك][َِ]|مِنْ|عَنْ|عَلَيْ|إِلَيْ|فِي|مَعَ)(?:{PRONOUN})$"), "'preposition_and_pronoun'"), ("s_term IS NOT NULL", "'singular'"), (match("word", "[ً-ٍ]ا?$"), "'tanwin'"),
                ("x_form IS NOT NULL", "'explicit_verb'"), (match("tags", "(^|[+])(DET|TAA)"), "'non_verb'"), (f"d_topic IS NOT NULL OR {match('tags', f'(^|[+]){_VERBAL_TAGS}')}", "'verb_form'"), (match("tags", "PREP"), "'non_verb'"), ("word = e_form OR e_sure", "'essence'"),
                (match("tags", "(^|[+])NUM"), "'sound_plural'"), ("kind IN ('PV', 'IV', 'CV')", "'pattern'"), ("kind = 'PV|N' AND " + match("stem", "([َْ]|َ?[اى]|ُو)$"), "'pattern'"), ("kind IS NOT NULL", "'pattern'"), (match("word", "^[يتن][َُ]|(تُمْ|وا|َتْ)$") + " AND length(bare) >= 4", "'surface_verb'"), otherwise="'default'",
            ),
        },
        {
            "participle": match("pattern", "^(مُ|فَاعِل)") + " AND source IN ('non_verb', 'sound_plural', 'pattern', 'default')",
            "verbal": "source IN ('uninflected', 'explicit_verb', 'verb_form', 'surface_verb') OR source = 'pattern' AND (kind IN ('PV', 'IV', 'CV') OR kind = 'PV|N' AND " + match("stem", "([َْ]|َ?[اى]|ُو)$") + ")",
        },
        {
            "class": cascade(
                ("source = 'registry'", "coalesce(c_class, c1_class)"), ("verbal", "'VERB'"), ("source = 'function_word'", "CASE WHEN p_category IN ('PRON', 'DEM', 'REL') THEN p_category ELSE 'PARTICLE' END"), ("source = 'interrogative'", "'PARTICLE'"), ("source = 'preposition_and_pronoun'", "'PREP'"),
                ("participle AND number_suffix <> 'اتٌ'", "'ADJ'"), otherwise="'NOUN'",
            ),
            "proof": cascade(("source IN ('registry', 'explicit_verb', 'singular', 'preposition_and_pronoun')", "'Certificate'"), ("source = 'default'", "'Zero'"), otherwise="'Hypothesis'"),
        },
        {
            "overridden": cascade(("class = 'ADJ' AND length(bare) < 3", "'NOUN'"), ("class = 'VERB' AND lexicon = 'uninflected_verb'", "'VERB'"), ("class = 'NOUN' AND s_term IS NOT NULL", "'NOUN'"), otherwise="class"),
            "aspect": cascade(("class <> 'VERB'", "'-'"), (match("tags", "IMPERF_PREF|LAM_AMR|FUT"), "'IV'"), (match("tags", "IMP_PREF") + " OR kind = 'CV'", "'CV'"), ("kind = 'IV'", "'IV'"), otherwise="'PV'"),
            "closed_kind": cascade(*[(f"coalesce(c_tag, CASE WHEN after_and THEN c1_tag END, p_category) = '{t}'", f"'{k}'") for t, k in (("PREP", "preposition"), ("JUS", "jussive"), ("SUB", "subjunctive"), ("KANA", "verb_label"), ("COND", "conditional"), ("NEG", "negation"), ("INTG", "interrogative"), ("VOC", "vocative"), ("REL", "relative"), ("DEM", "demonstrative"))], ("coalesce(c_tag, CASE WHEN after_and THEN c1_tag END, p_category) IS NOT NULL", "'built_noun'"), otherwise="'-'"),
        },
    ),
    select="word, source, class, overridden, aspect, closed_kind, proof, class || '/' || source || '/' || proof AS kernel",
)


def classes(table: DataFrame, rules: Rules | None = None, parts: DataFrame | None = None, aligned: DataFrame | None = None) -> DataFrame:
    """Each distinct ``word`` with its class, the rule that gave it, its aspect and how sure that is.

    ``parts`` and ``aligned`` are the words' ``segments`` and ``best_alignment``, where the caller has them already.
    """
    parts = (segments(table, rules) if parts is None else parts).select("word", "stem", "tags", F.col("number").alias("number_suffix"))
    aligned = (best_alignment(table, rules) if aligned is None else aligned).select("word", "pattern", "kind")
    return save(M13.frame(checked_join(parts, aligned, ["word"]), rules), "classes")


def m13_class_cascade(spark: SparkSession, sf_dir: str, rules: Rules | None = None) -> DataFrame:
    w = read_words(spark, sf_dir).select("id", "word")
    return checked_join(w, classes(w, rules), ["word"], "inner").drop("word")


def m13_word_class(spark: SparkSession, sf_dir: str, rules: Rules | None = None) -> DataFrame:
    """The class of each word, what gave it and how sure it is."""
    return m13_class_cascade(spark, sf_dir, rules).select("id", "class", "source", "proof")


_CLASSES = M13.sql(f"{ALIGNED_SQL}, described AS (SELECT g.word, g.stem, g.tags, g.number AS number_suffix, b.pattern, b.kind FROM ({SEGMENTS_SQL}) g LEFT JOIN best b ON b.word = g.word)", "described")
M13_SQL = f"SELECT w.id, r.* EXCLUDE (word) FROM ({_CLASSES}) r JOIN (WITH {READINGS_SQL} SELECT * FROM read_words) w ON w.word = r.word"

# -- words with their parts, pattern and class ------------------------------------------------------------------------


def described(table: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Each distinct ``word`` with its segments, its aligned pattern and its class."""
    whole, aligned = segments(table, rules), best_alignment(table, rules).select("word", "pattern", "kind")
    told = classes(table, rules, whole, aligned).select("word", "class", "source", "aspect")
    parts = whole.drop("proof", "split", "absorbed", "rebuilds")
    return save(checked_join(checked_join(parts, aligned, ["word"]), told, ["word"], "inner"), "described")


DESCRIBED_SQL = f"""{ALIGNED_SQL}, described AS MATERIALIZED (SELECT g.* EXCLUDE (proof, split, absorbed, rebuilds), b.pattern, b.kind, c.class, c.source, c.aspect FROM ({SEGMENTS_SQL}) g LEFT JOIN best b ON b.word = g.word JOIN ({_CLASSES}) c ON c.word = g.word)"""

#: The subject's ending of a verb, whichever rule peeled it; an object's pronoun is none.
_ENDING = "coalesce(nullif(subject, ''), nullif(subject2, ''), nullif(past_ta, ''), nullif(number, ''), nullif(pronoun2, ''), CASE WHEN pronoun = 'نَا' AND imperfect = '' THEN pronoun END, '')"
_BY_ENDING = (("تُمُو", "2", "PL", "M"), ("تُمْ", "2", "PL", "M"), ("تُمَا", "2", "DU", "C"), ("تُنَّ", "2", "PL", "F"), ("وا", "3", "PL", "M"), ("نَا", "1", "PL", "C"), ("تْ", "3", "SG", "F"), ("تَ", "2", "SG", "M"), ("تُ", "1", "SG", "C"), ("تِ", "2", "SG", "F"))

#: The prefix stack, mood and aspect, person, number and gender from affixes.
F17 = Staged(
    stages=(
        {"ending": _ENDING, "verb": "class = 'VERB'"},
        {"lead": "coalesce(nullif(left(imperfect, 1), ''), CASE WHEN lam_amr <> '' THEN left(stem, 1) END, CASE WHEN aspect = 'IV' THEN left(stem, 1) END, '')", "shape": "CASE WHEN NOT verb THEN 'none' ELSE aspect END"},
        {
            "mood": cascade(
                ("shape <> 'IV'", "'none'"), ("future <> ''", "'indicative'"), (match("word", "ْ$"), "'jussive'"), ("lam_amr = 'لْ'", "'jussive'"), (match("ending", "^(ونَ|انِ|ينَ)"), "'indicative'"), ("ending = 'وا'", "'subjunctive'"),
                (match("stem", "ُ$"), "'indicative'"), (match("stem", "ْ$"), "'jussive'"), (match("stem", "َ$"), "'subjunctive'"), otherwise="'none'",
            ),
            "person": cascade(("shape = 'none'", "'-'"), ("shape = 'CV'", "'2'"), ("shape = 'IV' AND lead = 'ي'", "'3'"), ("shape = 'IV' AND lead IN ('ن', 'أ')", "'1'"), ("shape = 'IV'", "'2'"), *[(f"ending = '{e}'", f"'{p}'") for e, p, _, _ in _BY_ENDING], otherwise="'3'"),
            "number_of": cascade(
                ("shape = 'none'", "'-'"), ("shape = 'IV' AND lead = 'ن'", "'PL'"), ("shape IN ('IV', 'CV') AND " + match("ending", "^(ونَ?|وا)$"), "'PL'"), ("shape IN ('IV', 'CV') AND " + match("ending", "^ان"), "'DU'"), ("shape IN ('IV', 'CV')", "'SG'"), *[(f"ending = '{e}'", f"'{n}'") for e, _, n, _ in _BY_ENDING], otherwise="'SG'",
            ),
            "gender": cascade(("shape = 'none'", "'-'"), ("shape = 'IV' AND lead IN ('ن', 'أ')", "'C'"), ("shape IN ('IV', 'CV') AND " + match("ending", "^ين"), "'F'"), ("shape IN ('IV', 'CV')", "'M'"), *[(f"ending = '{e}'", f"'{g}'") for e, _, _, g in _BY_ENDING], otherwise="'M'"),
        },
    ),
    select="word, conj, lam_amr AS lam, future, stem, shape AS aspect, mood, person, number_of AS number, gender",
)

#: The verb-form verdict, an ordered cascade over the gates before it; what a decision allows.
F16 = Staged(
    lookups=((DEFECTIVE, plain(_PEELED), "key", {"d_topic": "topic"}), (EXPLICIT, _PEELED, "form", {"x_form": "form"}), (LEXICA, "word", "form", {"lexicon": "kind"})),
    stages=(
        {
            "verdict": cascade(
                ("source IN ('registry', 'function_word', 'preposition_and_pronoun', 'interrogative') AND class <> 'VERB'", "'closed'"), (match("word", "[ً-ٍ]ا?$"), "'tanwin'"), ("d_topic IS NOT NULL", "'kana'"), ("x_form IS NOT NULL", "'explicit'"), ("class <> 'VERB' AND pronoun <> ''", "'possessive'"),
                (f"lexicon IN ('foreign_name', 'comparative') OR {match('tags', '(^|[+])(DET|TAA)')}", "'non_verb'"), ("pattern = 'تَفْعِيل'", "'tafdeel'"), (match("tags", "IMPERF_PREF|LAM_AMR|FUT|IMP_PREF"), "'mood'"), (match("tags", "(^|[+])SUBJ") + " OR past_ta <> ''", "'suffix'"), ("class = 'VERB'", "'strong'"), otherwise="'none'",
            ),
        },
        {"proof": cascade(("verdict IN ('kana', 'explicit')", "'Certificate'"), ("verdict IN ('mood', 'strong', 'suffix')", "'Hypothesis'"), otherwise="'Zero'")},
    ),
    select="word, pronoun, verdict, proof, proof <> 'Zero' AS allows_event, verdict IN ('kana', 'explicit', 'mood') AS allows_relation",
)

#: Patterns of broken plurals. Fixed values.
_PLURALS = ("فُعُول", "أَفْعَال", "مَفَاعِل", "مَفَاعِيل", "فَوَاعِل", "فَعَائِل", "أَفَاعِل", "فُعَلَاء", "أَفْعِلَاء", "فُعُل", "فُعَّال", "أَفْعُل")
#: Gender and number by tiers with confidence, and the singular that a plural suggests.
M20 = Staged(
    lookups=((CLOSED_WORDS, "regexp_replace(word, '^[وف]َ', '')", "form", {"c_tag": "tag"}),),
    stages=(
        {"bare": plain("stem"), "ends": "replace(suffixes, '+', '')", "nominal": "class IN ('NOUN', 'ADJ')", "plural_pattern": f"coalesce(pattern IN ({', '.join(f"{chr(39)}{p}{chr(39)}" for p in _PLURALS)}), false) AND class IN ('NOUN', 'ADJ')"},
        {
            "gender": cascade(("c_tag = '3FS'", "'F'"), ("class = 'PRON'", "'M'"), ("taa <> ''", "'F'"), ("class = 'VERB' AND past_ta = 'تْ'", "'F'"), (f"nominal AND {match('number', 'ات')}", "'F'"), ("nominal AND " + match("bare", "(اء|ى)$"), "'F'"), otherwise="'M'"),
            "gender_sure": cascade(("class = 'PRON'", "1.0"), ("taa <> '' OR class = 'VERB' AND past_ta = 'تْ'", "0.9"), (f"nominal AND {match('number', 'ات')}", "0.85"), ("nominal AND " + match("bare", "(اء|ى)$"), "0.6"), otherwise="0.3"),
            "number_of": cascade(("c_tag IN ('3MP', '2MP', '1CP')", "'PL'"), (f"nominal AND {match('number', 'ات')}", "'PL'"), (match("ends", "^(ونَ?|وا)"), "'PL'"), (match("number", "^انِ") + " OR nominal AND " + match("stem", "َانِ$"), "'DU'"), (match("number", "^ين"), "'PL_OR_DU'"), ("plural_pattern", "'PL'"), otherwise="'SG'"),
            "number_sure": cascade(("c_tag IN ('3MP', '2MP', '1CP')", "1.0"), (f"nominal AND {match('number', 'ات')}", "0.9"), (match("ends", "^(ونَ?|وا)"), "0.9"), (match("number", "^انِ") + " OR nominal AND " + match("stem", "َانِ$"), "0.85"), (match("number", "^ين"), "0.6"), ("plural_pattern", "0.55"), otherwise="0.5"),
            "singular": cascade((f"nominal AND {match('number', 'ات')}", "bare || 'ة'"), ("nominal AND taa <> ''", "bare || 'ة'"), ("nominal AND " + match("stem", "َانِ$"), "left(bare, length(bare) - 2)"), otherwise="bare"),
        },
    ),
    select="word, gender, CAST(gender_sure AS DOUBLE) AS gender_sure, number_of AS number, CAST(number_sure AS DOUBLE) AS number_sure, singular",
)


def _by_word(staged: Staged):
    """A query that works its columns out once a distinct word and gives them to every id."""

    def run(spark: SparkSession, sf_dir: str, rules: Rules | None = None) -> DataFrame:
        w = read_words(spark, sf_dir).select("id", "word")
        return checked_join(w, save(staged.frame(described(w, rules), rules), "by-word"), ["word"], "inner").drop("word")

    return run


def _by_word_sql(staged: Staged) -> str:
    return f"SELECT w.id, r.* EXCLUDE (word) FROM ({staged.sql(DESCRIBED_SQL, 'described')}) r JOIN (WITH {READINGS_SQL} SELECT * FROM read_words) w ON w.word = r.word"


_BY_WORD = {"f17_mood_person": F17, "f16_verb_verdict": F16, "m20_gender_number": M20}

#: G8, G9, X: letters and marks, the parts of words, scalar functions on vocalised words.
X01 = Staged(
    lookups=(_CLOSED_FULL, (LABELS, "coalesce(c_tag, '-')", "code", {"label": "label"})),
    stages=(
        {"bare": plain("word"), "head2": f"regexp_extract(word, '^((?:{L}{MK}){{2}})', 1)"},
        {
            "last_letter": f"regexp_extract(word, '({L}){MK}$', 1)", "last_mark": f"regexp_extract(word, '([{M}])[^{M}]*$', 1)", "vowel_before_last": f"regexp_extract(word, '([{M}]){L}{MK}$', 1)", "vowel_after_first": f"regexp_extract(word, '^{L}([{M}])', 1)",
            "tail": "substr(word, length(head2) + 1)", "clitic_off": sub("word", f"^[وفبلكس]{MK}"), "quranic": "translate(replace(word, 'ـ', ''), 'ٱآ', 'اا')", "gold_key": f"translate({plain('word')}, 'أإآؤئءى', 'اااوياي')", "no_pause": sub("word", f"[{ar.RECITATION}]"),
            "phrase": "replace(replace('{case} after {prev}', '{case}', coalesce(label, '-')), '{prev}', coalesce(c_class, '-'))", "excerpt": "left(word, 4)",
            "two_fields": "coalesce(c_class, '-') || '_vs_' || coalesce(c_tag, '-')",
        },
    ),
    select="id, head2, tail, last_letter, last_mark, vowel_before_last, vowel_after_first, clitic_off, quranic, gold_key, no_pause, phrase, excerpt, two_fields",
)

#: Prefix candidates, strip forms, compounds of prefixes and a known form, and operator lookups.
G33 = Staged(
    lookups=(
        _CLOSED_FULL, (CLOSED_PLAIN, "substr(" + plain("word") + ", 2)", "key", {"after_one": "category"}), (CLOSED_PLAIN, "substr(" + plain("word") + ", 3)", "key", {"after_two": "category"}),
        (OPERATORS, "word", "key", {"op_exact": "operator", "g0": "grp"}), (OPERATORS, plain(_PEELED), "key", {"op_peeled": "operator", "g1": "grp"}), (OPERATORS, plain("word"), "key", {"op_plain": "operator", "g2": "grp"}),
    ),
    stages=(
        {"bare": plain("word"), "prefix": f"regexp_extract(word, '^([وفبلك]{MK})', 1)"},
        {
            "stripped": "CASE WHEN prefix <> '' AND length(bare) > 2 THEN substr(word, length(prefix) + 1) ELSE word END", "strip_one": "CASE WHEN " + match("bare", "^[وفبلكس]") + " AND length(bare) >= 3 THEN substr(bare, 2) END",
            "strip_article": "CASE WHEN " + match("bare", "^(ال|وال|بال|فال|كال)") + " THEN " + sub("bare", "^[وبفك]?ال") + " END",
            "compound": cascade((match("bare", "^[وفبلك]") + " AND after_one IS NOT NULL", "left(bare, 1) || '+' || after_one"), (match("bare", "^[وف][بلك]") + " AND after_two IS NOT NULL", "left(bare, 1) || '+' || substr(bare, 2, 1) || '+' || after_two"), otherwise="'-'"),
            "demonstrative": cascade((match("bare", "^ه(ذا|ذه|ذان|ؤلاء)$"), "'ha+' || substr(bare, 2)"), (match("bare", "^(ذا|تي|أولئ)ل?ك$"), sub("bare", "ل?ك$") + " || '+k'"), ("c_class = 'DEM'", "bare"), otherwise="'-'"),
            "operator": "coalesce(op_exact, op_peeled, op_plain, '-')", "tier": cascade(("op_exact IS NOT NULL", "'exact'"), ("op_peeled IS NOT NULL AND left(word, 1) IN ('و', 'ف')", "'prefix'"), ("op_plain IS NOT NULL", "'plain'"), otherwise="'none'"),
        },
    ),
    select="id, prefix, stripped, strip_one, strip_article, compound, demonstrative, operator, tier",
)

_ALL = {
    "f05_gates": F05, "f12_overrides": F12, "f19_surface_verbs": F19, "f03_pattern_atoms": F03, 
    "x01_word_functions": X01, "g33_prefix_forms": G33,
}
QUERIES = {name: staged.query() for name, staged in _ALL.items()} | {name: _by_word(staged) for name, staged in _BY_WORD.items()} | {"m13_class_cascade": m13_class_cascade, "m13_word_class": m13_word_class}
ORACLE = {name: staged.sql() for name, staged in _ALL.items()} | {name: _by_word_sql(staged) for name, staged in _BY_WORD.items()} | {"m13_class_cascade": M13_SQL, "m13_word_class": f"SELECT id, class, source, proof FROM ({M13_SQL})"}
