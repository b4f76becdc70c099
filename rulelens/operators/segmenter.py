"""Segmentation of words (G10 to G31, M35) and the stages of their roots.

Prefixes peel in a fixed order, each at most once, then suffixes; every rule states its shape with the letters that must
remain, and what may stand before it. A peel sees the rest that the peels before it left, so each rule is one stage of
native expressions, and the parts always rebuild the word. Words are segmented once a distinct word. Peeling stops where
a closed word remains; assimilated words split by table. Roots come from aligned patterns (``alignment``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulelens.functions import arabic as ar
from rulelens.operators.alignment import ALIGNED_SQL, best_alignment
from rulelens.plans.joins import checked_join
from rulelens.plans.scratch import save
from rulelens.sources.readings import READINGS_SQL, read_words
from rulelens.sources.rules import Rules, Table
from rulelens.sources.spelled import Staged, cascade, letters, match, plain

A, M = ar.ALL_MARKS, ar.MARKS
L, MK = f"[^{A}]", f"[{A}]*"
#: Marks of a letter that carries no sukun.
UNSTOPPED = f"[ً-ّٰ{ar.RECITATION}]*"


def _least(n: int) -> str:
    return f"(?:{L}{MK}){{{n},}}"


# -- rule tables ----------------------------------------------------------------------------------------------------------

#: Closed words with class and tag: nothing is peeled from them. Fixed values.
CLOSED_WORDS = Table("closed_words", "form class tag", "string string string", tuple(
    (ar.ordered(form), cls, tag)
    for cls, tag, forms in (
        ("PREP", "PREP", "مِنْ مِنَ مِن فِي إِلَى عَلَى عَنْ مَعَ حَتَّى"), ("CONJ", "CONJ", "ثُمَّ أَوْ أَمْ بَلْ"), ("PARTICLE", "NEG", "لَا"), ("PARTICLE", "JUS", "لَمْ لَمَّا"), ("PARTICLE", "SUB", "أَنْ لَنْ كَيْ"),
        ("PARTICLE", "COND", "إِذَا إِنْ لَوْ"), ("PARTICLE", "INNA", "إِنَّ أَنَّ لَكِنَّ لَعَلَّ"), ("PARTICLE", "INTG", "هَلْ"), ("PARTICLE", "MA", "مَا"), ("PARTICLE", "FUT", "سَوْفَ"), ("PARTICLE", "CERT", "قَدْ"),
        ("PRON", "3MS", "هُوَ"), ("PRON", "3FS", "هِيَ"), ("PRON", "3MP", "هُمْ"), ("PRON", "1CS", "أَنَا"), ("PRON", "1CP", "نَحْنُ"), ("PRON", "2MS", "أَنْتَ"), ("PRON", "2MP", "أَنْتُمْ"),
        ("DEM", "DEM", "هَذَا هَذِهِ ذَلِكَ تِلْكَ هَؤُلَاءِ أُولَئِكَ"), ("REL", "REL", "الَّذِي الَّتِي الَّذِينَ مَنْ"), ("VERB", "KANA", "كَانَ"), ("VERB", "PV", "قَالَ"),
        ("VERB", "CV", "قُلْ"), ("VERB", "TRANS", "صَارَ"), ("PARTICLE", "VOC", "يَا"), ("PARTICLE", "INTG", "أَيْنَ مَتَى أَيُّ كَيْفَ"), ("PARTICLE", "LOC", "حَيْثُ"), ("TIME", "TIME", "غَدًا أَمْسِ الْيَوْمَ الْآنَ"),
    )
    for form in forms.split()
))
#: Words that are one piece though they look like several, by stripped form. Fixed values.
ATOMIC = Table("atomic_words", "key", "string", tuple((x,) for x in "الله يوم اليوم أيام سنة سيد بنت بيت ليل لبن كلب يد يمين نهار نجم تحت بين عند وراء فوق فم".split()))
#: Roots by whose first letter a word could seem to begin with a prefix. Fixed values.
INITIAL = Table("initial_roots", "key", "string", tuple((x,) for x in (
    "وجد وعد وصل وقع وضع وقف وزن ورث وسع وصف وقت وجه ولد وحد ولي وقي وفي وعي فتح فعل فهم فرح فصل فضل فكر فقد فرق فسد فلح فوز بحر برد بحث بلد بشر بصر بعد بني بيع لعب لبس لسا لقي لحم لون لفظ كتب كتا كبر كرم كفر كلم كسر كشف كون كذب "
    "سمع سجد سلم سكن سأل سفر سير سبح سبب سحر يسر يقن يتم يبس تمر ترك تبع توب تمم نصر نفس نور نظر نزل نهر نعم نجح نسي نوم"
).split()))
#: Assimilated words and their parts, by stripped form, the first part's tag; one of them splits only with a shadda. Fixed values.
ASSIMILATED = Table("assimilated", "key parts tag needs_shadda", "string string string boolean", (
    ("مما", "مِن+مَا", "PREP", False), ("عما", "عَن+مَا", "PREP", False), ("ممن", "مِن+مَن", "PREP", False), ("عمن", "عَن+مَن", "PREP", False), ("ألا", "أَن+لَا", "SUB", True), ("لئلا", "لِ+أَن+لَا", "PREP", False), ("إما", "إِن+مَا", "COND", True), ("أينما", "أَيْنَ+مَا", "ADV", False), ("كلما", "كُلَّ+مَا", "ADV", False),
))
#: Words that stand alone, with what may be joined to them. Fixed values.
SINGULAR = Table("singular_terms", "key term strategy", "string string string", tuple(
    (p + shown, term, strategy) for term, forms in (("الله", (("الله", "direct"), ("لله", "assimilated"))), ("اللهم", (("اللهم", "direct"),))) for shown, strategy in forms for p in ("", "و", "ف", "ب", "ت")
))
#: Essence nouns, which no root underlies: stripped form, vocalised form, whether all entries of the stripped form are such nouns. Fixed values.
ESSENCE = Table("essence_nouns", "key form unambiguous", "string string boolean", (
    ("شمس", "شَمْسٌ", True), ("قمر", "قَمَرٌ", True), ("جبل", "جَبَلٌ", True), ("رجل", "رَجُلٌ", False), ("بحر", "بَحْرٌ", True), ("قلم", "قَلَمٌ", True), ("أرض", "أَرْضٌ", True), ("ماء", "مَاءٌ", True), ("شجرة", "شَجَرَةٌ", True), ("كتب", "كُتُبٌ", False),
))
#: Roots with a living verb. Fixed values.
LIVING = Table("living_roots", "living", "string", tuple((r,) for r in "كتب نصر وجد علم شرب خرج دخل جلس فتح سمع ذهب رجع كلم قتل رسل كرم جمع كسر غفر اكل درس صبر طلب سجد رحم جهد حدث قول كون رجل".split()))

_TANWIN = match("word", "[ً-ٍ]")
PRONOUN = _PRON = "هُمَا|كُمَا|هُمْ|هِمْ|كُمْ|هُنَّ|هَا|نَا|نِي|هُ|هِ|كَ|ي"

#: Prefixes in order of peeling: name, shapes (group 1 is the piece, the rest says what must remain), condition. ``{r}`` is the rest.
PREFIXES = (
    ("conj", (f"^([وف]َ?)(?:{L}{UNSTOPPED}(?:{L}{MK})+|لْ[يتنأ].*)$",), f"(first_root IS NULL OR {match('word', '^[وف]َلْ[يتنأ]')}) AND NOT ({_TANWIN} AND (" + " OR ".join(match("word", f"^[وف]َ?{x}$") for x in (f"{L}{MK}{L}{MK}", "ا.*", f"{L}{MK}ي{MK}{L}{MK}", f"{L}{MK}{L}{MK}ا{MK}")) + "))"),
    ("lam_amr", (f"^(لْ)[يتنأ][َُِ]{_least(2)}$", f"^(لِ)[يتن][َُ]{L}ْ{L}{MK}(?:{L}{MK})*(?:{L}[َْ]|وا)$"), "NOT done1"),
    ("voc", (f"^(يَا){_least(3)}$",), f"conj = '' AND NOT {_TANWIN}"),
    ("interrog", (f"^(أَ)(?:أ.*|[يتن][َُ]{_least(2)}|{L}{UNSTOPPED}{L}{MK}{L}{MK}(?:تَ|تُمْ))$",), "conj = '' AND voc = '' AND lam_amr = ''"),
    ("emphatic", (f"^(لَ){L}َ{L}َ{L}َ$", f"^(لَ)(?:{L}{MK}){{3,}}[ً-ٍ]ا?$"), "NOT done1 AND lam_amr = '' AND voc = '' AND interrog = '' AND second_root IS NULL"),
    ("prep_word", (f"^(مِنْ|مِنّ|عَنْ|عَلَيْ|إِلَيْ|فِي|مَعَ|عِنْدَ|لَدَيْ)(?:{_PRON})$",), "emphatic = '' AND lam_amr = '' AND interrog = '' AND voc = ''"),
    ("prep", ("^([بلك][َِ])ال", f"^(لِ)لْ?{L}", f"^([بل]ِ){L}(?:[ً-ِْ]{MK}|){_least(2)}$", f"^([بلك][َِ]){L}"),
        f"NOT done1 AND prep_word = '' AND emphatic = '' AND lam_amr = '' AND interrog = '' AND voc = '' AND (done2 OR {match('{r}', '^[بلك][َِ]ال')} OR {match('{r}', '^لِل')} OR second_root IS NULL AND {match('{r}', f'^[بل]ِ{L}(?:[ً-ِْ]{MK}|){_least(2)}$')} AND NOT ({_TANWIN} AND {match('{r}', f'^[بل]ِ{L}{MK}ا{MK}{L}{MK}$')}))"),
    ("det", (f"^(الْ?){_least(2)}$", f"^(لْ?){L}.*$"), f"NOT done1 AND NOT done2 AND prep_word = '' AND lam_amr = '' AND interrog = '' AND ({match('{r}', '^ال')} OR prep = 'لِ' AND {match('{r}', f'^لْ?{L}{MK}{L}')} AND NOT {match('{r}', '^ل[َُِ]')})"),
    ("future", (f"^(سَ)[يتنأ][َُ]{_least(2)}$",), "NOT done1 AND det = '' AND prep = '' AND prep_word = '' AND second_root IS NULL"),
    ("imperative", (f"^(ا){L}ْ(?:[^ت{A}]{MK}|ت[ُِ])(?:{L}{MK})*(?:وا|ون{MK}|ين{MK})$", f"^(ا){L}ْ(?:[^ت{A}]{MK}|ت[ُِ])(?:{L}{MK})*{L}ْ$", f"^(ا){L}ْتَ{L}(?:ُوا|ْ)$"), f"NOT done1 AND voc = '' AND interrog = '' AND emphatic = '' AND prep = '' AND prep_word = '' AND det = '' AND future = '' AND NOT {match('{r}', f'^انْ{L}َ{L}َ')}"),
    ("imperfect", (f"^([يتن][َُ]){L}ْ{_least(2)}$", f"^([يتن]ُ){L}َ{L}ّ[َِ]{_least(1)}$", f"^([يتن][َُ]){L}[ُِ][وي]{L}{MK}", f"^([يتن][َُ]){L}[ُِ]{L}ْ$", f"^(ي[َُ])تَ{_least(3)}$", f"^([يتن][َُِ]){_least(2)}(?:ُونَ|ُوا|َانِ|ِينَ)$"),
        f"NOT done1 AND det = '' AND imperative = '' AND prep = '' AND prep_word = '' AND lam_amr = '' AND interrog = '' AND (second_root IS NULL OR future <> '') AND NOT {_TANWIN} AND NOT {match('word', '(تُمْ|تَ|تُ)$')} AND NOT {match('{r}', f'^تَ{L}َ({L}َّ|{L}ّ|ا)')}"),
)
#: Suffixes in order of peeling. ``{r}`` is the rest, from which the piece ends.
SUFFIXES = (
    ("pronoun", (f"^{_least(2)}(هُمَا|كُمَا|هُمْ|هِمْ|كُمْ|هُنَّ|هَا|نَا|نِي)$", f"^{_least(3)}(هُ|هِ|كَ)$", f"^{_least(2)}{L}ِ(ي)$", f"^{L}{MK}{L}ّ{MK}(هُ|هِ|كَ)$"), f"NOT {_TANWIN} AND imperative = ''"),
    ("subject", (f"^{_least(2)}(تُمُوا|تُمُو|تُمَا|تُمْ|تُنَّ|وا)$",), "det = ''"),
    ("past_ta", (f"^{_least(2)}{L}{MK}ْ(ت[َُِ])$", f"^{_least(2)}{L}َ(تْ)$"), "det = '' AND subject = '' AND imperfect = ''"),
    ("number", (f"^{_least(3)}(ونَ?|ينَ?|ات[ًٌٍَُِ]?)$", f"^{_least(2)}(ونَ|ينَ|انِ)$"), f"subject = '' AND past_ta = '' AND NOT (pronoun <> '' AND {match('{r}', '(ون|ين)[َ]?$')}) AND (imperfect <> '' OR {match('{r}', f'^{_least(3)}(ون|ين|ات){MK}$')} AND NOT {match('{r}', 'انِ$')})"),
    ("taa", (f"^{_least(2)}(ة{MK})$", f"^{_least(1)}{L}{MK}َ(ت[َُِ])$", f"^{L}{MK}{L}ّ?َ(ت[َُِ])$"), f"subject = '' AND past_ta = '' AND number = '' AND (pronoun <> '' OR {match('{r}', f'ة{MK}$')})"),
    ("tanwin_alif", (f"^{_least(2)}(اً)$",), "pronoun = '' AND taa = '' AND number = ''"),
    ("pronoun2", (f"^{_least(2)}(هُمَا|هُمْ|كُمْ|هَا|نَا|نِي)$",), "pronoun <> '' AND taa = '' AND number = '' AND past_ta = '' AND subject = ''"),
    ("subject2", (f"^{_least(2)}(تُمُو|تُمْ|وا)$",), "pronoun <> '' AND subject = '' AND taa = '' AND number = '' AND past_ta = ''"),
)
_NAMES = [n for n, *_ in (*PREFIXES, *SUFFIXES)]
#: Tags of pieces by rule.
TAGS = {"conj": "CONJ", "lam_amr": "LAM_AMR", "voc": "VOC", "interrog": "INTERROG", "emphatic": "EMPH", "prep_word": "PREP", "prep": "PREP", "det": "DET", "future": "FUT", "imperative": "IMP_PREF", "imperfect": "IMPERF_PREF", "pronoun": "PRON", "subject": "SUBJ", "past_ta": "PV_SUBJ", "number": "NUM", "taa": "TAA", "tanwin_alif": "TANWIN", "pronoun2": "PRON", "subject2": "SUBJ"}


def _first(shapes: tuple[str, ...], at: str) -> str:
    """The piece that the first shape to fit takes."""
    return cascade(*[(match(at, s), f"regexp_extract({at}, '{s}', 1)") for s in shapes], otherwise="''")


def _segmenting() -> tuple[dict[str, str], ...]:
    parts = "a_parts IS NOT NULL AND (NOT a_shadda OR " + match("word", "ّ") + ")"
    out: list[dict[str, str]] = [
        {"splits": f"coalesce({parts}, false)"},
        {"atomic": f"c_class IS NOT NULL OR splits OR s_term IS NOT NULL OR t_key IS NOT NULL OR {letters('word')} < 3 AND NOT {match('word', f'^[بلك][َِ](?:{_PRON})$')}", "done1": f"c1_class IS NOT NULL AND {match('word', '^[وف]َ')}", "done2": f"(c2_class IS NOT NULL OR {match('word', f'^([وف]َ)?[بلك][َِ](?:{_PRON})$')}) AND {match('word', '^([وف]َ)?[بلك][َِ]')}", "r0": "word"},
    ]
    for k, (name, shapes, condition) in enumerate(PREFIXES):
        r = f"r{k}"
        found = _first(shapes, r) if name != "prep" else cascade((f"done2 AND {match(r, shapes[3])}", f"regexp_extract({r}, '{shapes[3]}', 1)"), *[(match(r, s), f"regexp_extract({r}, '{s}', 1)") for s in shapes[:3]], otherwise="''")
        out += [{name: f"CASE WHEN NOT atomic AND {condition.replace('{r}', r)} THEN {found} ELSE '' END"}, {f"r{k + 1}": f"substr({r}, length({name}) + 1)"}]
    at = f"r{len(PREFIXES)}"
    stays = f"atomic OR prep_word <> '' OR done1 AND conj <> '' OR done2 AND prep <> '' OR {letters(at)} < 3"
    out.append({"stays": stays})
    for k, (name, shapes, condition) in enumerate(SUFFIXES):
        r = at if k == 0 else f"q{k - 1}"
        out += [{name: f"CASE WHEN NOT stays AND {condition.replace('{r}', r)} THEN {_first(shapes, r)} ELSE '' END"}, {f"q{k}": f"left({r}, length({r}) - length({name}))"}]
    joined = lambda names: "concat_ws('+', " + ", ".join(f"nullif({n}, '')" for n in names) + ")"
    behind = [n for n, *_ in reversed(SUFFIXES)]
    inner = [n for n in behind if n not in ("pronoun",)] + ["pronoun"]
    tags = ", ".join(f"CASE WHEN {n} <> '' THEN '{TAGS[n]}' END" for n in [*[p[0] for p in PREFIXES], *inner])
    out += [
        {"stem": f"q{len(SUFFIXES) - 1}", "prefixes": joined([p[0] for p in PREFIXES]), "suffixes": joined(inner), "tags": f"concat_ws('+', {tags})"},
        {
            "rebuilt": "replace(prefixes, '+', '') || stem || replace(suffixes, '+', '')", "absorbed": "det <> '' AND " + match("stem", f"^[{ar.SUN}]ّ"), "split": "CASE WHEN splits THEN a_parts ELSE '-' END",
            "proof": cascade((f"{letters('word')} < 3 AND c_class IS NULL AND NOT done2", "'Zero'"), ("atomic OR prefixes || suffixes = ''", "'Certificate'"), otherwise="'Hypothesis'"),
        },
    ]
    return tuple(out)


_PEELED = "regexp_replace(word, '^[وف]َ', '')"
#: A root at the start counts only where nothing but endings follows it.
_ENDS = "^...(?:[ةتون]|نا|وا|ون|ين|ان|ات|تم|تن)?(?:ه|ها|هم|هن|ك|كم|ي|ني|نا)?$"
_PEELED2 = "regexp_replace(word, '^([وف]َ)?[بلك][َِ]', '')"
_LOOKUPS = (
    (CLOSED_WORDS, "word", "form", {"c_class": "class", "c_tag": "tag"}), (CLOSED_WORDS, _PEELED, "form", {"c1_class": "class"}), (CLOSED_WORDS, _PEELED2, "form", {"c2_class": "class"}),
    (ASSIMILATED, plain("word"), "key", {"a_parts": "parts", "a_shadda": "needs_shadda"}), (SINGULAR, plain("word"), "key", {"s_term": "term"}), (ATOMIC, plain("word"), "key", {"t_key": "key"}),
    (INITIAL, f"CASE WHEN {match(plain('word'), _ENDS)} THEN left({plain('word')}, 3) END", "key", {"first_root": "key"}),
    (INITIAL, f"CASE WHEN {match(plain(_PEELED), _ENDS)} THEN left({plain(_PEELED)}, 3) END", "key", {"second_root": "key"}),
)
#: Stages after which the columns so far are written, so that no plan grows past what can be compiled.
_CUTS = (13, 25)
SEGMENTS = Staged(lookups=_LOOKUPS, stages=_segmenting(), select=f"word, {', '.join(_NAMES)}, prefixes, stem, suffixes, tags, split, absorbed, rebuilt = word AS rebuilds, proof", cuts=_CUTS)


def segments(table: DataFrame, rules: Rules | None = None) -> DataFrame:
    """(word, a column a rule, prefixes, stem, suffixes, tags, split, absorbed, rebuilds, proof) of each distinct ``word``.

    A null word has no row; an empty one and words of one or two letters are one piece.
    """
    distinct = table.select("word").where("word is not null").distinct()
    return save(SEGMENTS.frame(distinct, rules), "segments")


def g11_segmenter(spark: SparkSession, sf_dir: str, rules: Rules | None = None) -> DataFrame:
    """Each word with its pieces by rule, its parts and tags."""
    w = read_words(spark, sf_dir).select("id", "word")
    return checked_join(w, segments(w, rules), ["word"], "inner").drop("word")


def g10_segments(spark: SparkSession, sf_dir: str, rules: Rules | None = None) -> DataFrame:
    """Each word's prefixes, stem and suffixes; the parts rebuild the word."""
    return g11_segmenter(spark, sf_dir, rules).select("id", "prefixes", "stem", "suffixes", "rebuilds")


_WORDS = f"{READINGS_SQL}, words AS (SELECT * FROM read_words), vocab AS MATERIALIZED (SELECT DISTINCT word FROM words)"
_SEGMENTS = SEGMENTS_SQL = SEGMENTS.sql(_WORDS, "vocab")
G11 = f"SELECT w.id, g.* EXCLUDE (word) FROM ({_SEGMENTS}) g JOIN (WITH {READINGS_SQL} SELECT * FROM read_words) w ON w.word = g.word"
G10 = f"SELECT id, prefixes, stem, suffixes, rebuilds FROM ({G11})"

# -- roots ----------------------------------------------------------------------------------------------------------------

_BARE = "regexp_replace(word, '^([وف]َ)?(ال)?', '')"
#: Stages of a root (M1): what a word is decides whether a root is sought; refined display of the pattern (M11); a plain view (M2).
ROOTS = Staged(
    lookups=(
        (CLOSED_WORDS, "word", "form", {"c_class": "class"}), (CLOSED_WORDS, _PEELED, "form", {"c1_class": "class"}), (SINGULAR, plain("word"), "key", {"s_term": "term"}),
        (ESSENCE, plain(_BARE), "key", {"e_form": "form", "e_sure": "unambiguous"}), (LIVING, "root", "living", {"lives": "living"}),
    ),
    stages=(
        {"stage": cascade(("word = ''", "'empty'"), ("s_term IS NOT NULL", "'singular'"), (f"c_class IS NOT NULL OR c1_class IS NOT NULL AND {match('word', '^[وف]َ')} OR {match('word', f'^([وف]َ)?([بلك][َِ]|مِنْ|عَنْ|عَلَيْ|إِلَيْ|فِي|مَعَ|عِنْدَ|لَدَيْ)(?:{_PRON})$')}", "'closed'"), ("word = e_form OR e_sure", "'essence'"), ("root IS NOT NULL AND length(root) >= 3", "'pattern'"), otherwise="'none'")},
        {
            "found": "CASE WHEN stage IN ('essence', 'pattern') THEN root END",
            "proof": cascade(("stage IN ('singular', 'closed')", "'Certificate'"), ("stage = 'essence' AND lives IS NULL", "'Certificate'"), ("stage IN ('essence', 'pattern')", "'Hypothesis'"), otherwise="'Zero'"),
            "display": cascade(("stage NOT IN ('essence', 'pattern') OR pattern IS NULL", "'-'"), ("pattern LIKE 'افْتَع%' AND " + match("word", "ا[صضطظ]ْ?ط|از?د"), "'افْتَعَل (assimilated)'"), ("pattern IN ('فَعَال', 'فَعْلَان') AND " + match("word", "َان[ًٌٍَُِ]?$"), "'فَعْلَان'"), otherwise="pattern"),
        },
    ),
    select="word, stage, CASE WHEN stage IN ('essence', 'pattern') THEN pattern END AS pattern, CASE WHEN stage IN ('essence', 'pattern') THEN kind END AS kind, found AS root, CASE WHEN stage IN ('essence', 'pattern') THEN expansion ELSE 'none' END AS expansion, display, CAST(fits AS BIGINT) AS fits, proof, CAST(CASE proof WHEN 'Certificate' THEN 1.0 WHEN 'Hypothesis' THEN 0.7 ELSE 0.0 END AS DOUBLE) AS score",
)


def roots(table: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Each distinct ``word`` with its root by stages; no root is sought for closed words and terms that stand alone."""
    distinct = table.select("word").where("word is not null").distinct()
    aligned = checked_join(distinct, best_alignment(table, rules), ["word"]).withColumn("fits", F.coalesce("fits", F.lit(0)))
    return save(ROOTS.frame(aligned, rules), "roots")


def m01_roots(spark: SparkSession, sf_dir: str, rules: Rules | None = None) -> DataFrame:
    """The root of each word by stages; an essence noun whose root has a living verb is a hypothesis only."""
    w = read_words(spark, sf_dir).select("id", "word")
    return checked_join(w, roots(w, rules), ["word"], "inner").drop("word")


_ROOTED = ROOTS.sql(f"{ALIGNED_SQL}, rooted_words AS (SELECT v.word, pattern, kind, root, expansion, prefix, suffix, coalesce(fits, 0) AS fits FROM (SELECT DISTINCT word FROM words) v LEFT JOIN best USING (word))", "rooted_words")
M01 = f"SELECT w.id, r.* EXCLUDE (word) FROM ({_ROOTED}) r JOIN (WITH {READINGS_SQL} SELECT * FROM read_words) w ON w.word = r.word"


def a34_unique_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each root with its words, patterns and one example."""
    r = m01_roots(spark, sf_dir).where("proof <> 'Zero' and root <> ''")
    return r.groupBy("root").agg(F.count("*").alias("words"), F.count_distinct("pattern").alias("patterns"), F.min(F.struct("id", "pattern")).alias("x")).select("root", "words", "patterns", F.col("x.id").alias("example"), F.col("x.pattern").alias("example_pattern"))


A34 = f"SELECT root, count(*) AS words, count(DISTINCT pattern) AS patterns, min(id) AS example, arg_min(pattern, id) AS example_pattern FROM ({M01}) WHERE proof <> 'Zero' AND root <> '' GROUP BY root"


def a25_accuracy(spark: SparkSession, sf_dir: str, rules: Rules | None = None) -> DataFrame:
    """How often segments and roots are those that a word was built from, by kind of word, and the commonest wrong root."""
    told = read_words(spark, sf_dir).select("word", "kind", F.col("root").alias("true_root"), F.col("prefixes").alias("p"), F.col("stem").alias("s"), F.col("suffixes").alias("x"))
    counted = told.groupBy(*told.columns).agg(F.count("*").alias("n"))
    found = checked_join(checked_join(counted, segments(counted, rules).select("word", "prefixes", "stem", "suffixes"), ["word"]), roots(counted, rules).select("word", "root"), ["word"])
    right = (F.col("prefixes") == F.col("p")) & (F.col("stem") == F.col("s")) & (F.col("suffixes") == F.col("x"))
    rooted = F.col("true_root").isNotNull() & F.col("root").eqNullSafe(F.col("true_root"))
    wrong = found.where(F.col("true_root").isNotNull() & ~rooted).groupBy("kind", "true_root", F.coalesce("root", F.lit("-")).alias("told")).agg(F.sum("n").alias("n"))
    worst = wrong.groupBy("kind").agg(F.min_by(F.concat_ws(">", "true_root", "told"), F.struct(-F.col("n"), F.col("true_root"), F.col("told"))).alias("commonest_wrong"))
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    sums = found.groupBy("kind").agg(F.sum("n").alias("words"), total(right).alias("segments_right"), total(F.col("true_root").isNotNull()).alias("with_root"), total(rooted).alias("roots_right"))
    return sums.join(F.broadcast(worst), "kind", "left")


A25 = f"""WITH told AS (SELECT * FROM (WITH {READINGS_SQL} SELECT word, kind, root AS true_root, prefixes AS p, stem AS s, suffixes AS x, count(*) AS n FROM readings GROUP BY ALL)),
found AS (SELECT t.*, g.prefixes, g.stem, g.suffixes, r.root FROM told t LEFT JOIN ({_SEGMENTS}) g ON g.word = t.word LEFT JOIN ({_ROOTED}) r ON r.word = t.word),
wrong AS (SELECT kind, true_root, coalesce(root, '-') AS told, sum(n) AS n FROM found WHERE true_root IS NOT NULL AND root IS DISTINCT FROM true_root GROUP BY ALL),
worst AS (SELECT kind, true_root || '>' || told AS commonest_wrong FROM wrong QUALIFY row_number() OVER (PARTITION BY kind ORDER BY n DESC, true_root, told) = 1)
SELECT kind, sum(n)::BIGINT AS words, coalesce(sum(n) FILTER (prefixes = p AND stem = s AND suffixes = x), 0)::BIGINT AS segments_right, coalesce(sum(n) FILTER (true_root IS NOT NULL), 0)::BIGINT AS with_root, coalesce(sum(n) FILTER (true_root = root), 0)::BIGINT AS roots_right, any_value(commonest_wrong) AS commonest_wrong
FROM found LEFT JOIN worst USING (kind) GROUP BY kind"""

QUERIES = {"g11_segmenter": g11_segmenter, "g10_segments": g10_segments, "m01_roots": m01_roots, "a34_unique_roots": a34_unique_roots, "a25_accuracy": a25_accuracy}
ORACLE = {"g11_segmenter": G11, "g10_segments": G10, "m01_roots": M01, "a34_unique_roots": A34, "a25_accuracy": A25}
