"""Roots of words by aligning patterns.

A pattern is written with root letters as ف ع ل. It is tried at every offset of a word: what stands before and behind must
be known affixes, its own letters must stand in place, and its marks must agree with the word's. No word meets every
pattern: a word's cores are keyed by length and by the letters at the places where some pattern of that length has
letters of its own, so one equi-join fetches the patterns whose letters fit, however many thousands there are. Marks
are compared afterwards, on arrays. Words are aligned once a distinct word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulelens.functions import arabic as ar
from rulelens.plans.joins import checked_join
from rulelens.plans.scratch import save
from rulelens.sources.readings import READINGS_SQL, read_words
from rulelens.sources.rules import Rules, Table

A = ar.ALL_MARKS
SLOTS = "فعل"
HAMZAS = "أإآؤئءٱ"
SHADDA, SUKUN = "ّ", "ْ"

#: Patterns of verbs in the present begin with one of four letters. Fixed values.
_PRESENT = "يَفْعَل يَفْعُل يَفْعِل يُفْعَل يُفَعِّل يُفَاعِل يُفْعِل يَتَفَعَّل يَتَفَاعَل يَنْفَعِل يَفْتَعِل يَسْتَفْعِل يَفُول يَفِيل يَفَال يَفُل يَفْعُو يَفْعِي يَفْعَى يَفُعّ يَفِعّ يَفَعّ"
#: Patterns by kind: past, command, noun, and those that a past verb and a noun share. Fixed values.
_PATTERNS = {
    "PV|N": "فَعَل فَعِل فَعُل فَعّ فَال",
    "PV": "فَعَّل فَاعَل أَفْعَل تَفَعَّل تَفَاعَل انْفَعَل افْتَعَل افْعَلّ اسْتَفْعَل فَعْلَل تَفَعْلَل أَفَال اسْتَفَال افْتَال فَعَى فَعَا أَفْعَى فَعَّى تَفَعَّى افْتَعَى اسْتَفْعَى أَفَعّ اسْتَفَعّ فُعِل فِيل",
    "CV": "افْعَل افْعُل افْعِل",
    "IV": " ".join(f"{letter}{p[1:]}" for letter in "يتنأ" for p in _PRESENT.split()),
    "N": "فِعَال فَعَال فُعَال فَعِيل فَعُول فُعُول فَعْل فِعْل فُعْل فُعُل فُعَل فِعَل فَاعِل مَفْعُول مَفْعَل مَفْعِل مِفْعَل مِفْعَال مُفَعِّل مُفَعَّل مُفْعِل مُفْعَل مُفَاعِل مُسْتَفْعِل مُفْتَعِل مُنْفَعِل مُتَفَعِّل مُتَفَاعِل تَفْعِيل تَفَعُّل تَفَاعُل إِفْعَال افْتِعَال انْفِعَال اسْتِفْعَال "
    "أَفْعَال أَفْعُل فَوَاعِل مَفَاعِل مَفَاعِيل فَعَائِل أَفَاعِل فَعْلَان فُعْلَان فَعَّال فُعَّال فُعَلَاء أَفْعِلَاء فَعْلَى فُعْلَى فَعْلَاء فَعْلَة فِعْلَة فُعْلَة فَعَلَة مَفْعَلَة مَفْعِلَة فَعَالَة فِعَالَة فُعُولَة مُفَاعَلَة تَفْعِلَة فَاعِلَة فَالَة فَعَّة فِعَّة فُعَّة فِعّ فُعّ فُول فِيلَة فُولَة فَعْلَل فِعْلَال فُعْلُول",
}
_PATTERNS = {kind: [*ps.split(), *(f"{p}ْ" for p in ps.split() if kind in ("IV", "CV") and p[-1] == "ل")] for kind, ps in _PATTERNS.items()}  # jussive and command end in sukun
PATTERNS = Table("patterns", "pattern kind", "string string", tuple({p: (p, kind) for kind, ps in reversed(_PATTERNS.items()) for p in ps}.values()))

#: Letters that may stand before a pattern, in order: conjunction, then preposition or future, then article; and behind it.
BEFORE = Table("letters_before", "letters", "string", tuple((x,) for x in sorted({c + p + a for c in ("", "و", "ف") for p in ("", "ب", "ك", "ل") for a in ("", "ال")} | {c + s for c in ("", "و", "ف") for s in ("س", "لل", "أ")} | {"أ", "يا", ""})))
_PRONOUNS = ("", "ه", "ها", "هم", "هن", "هما", "ك", "كم", "كن", "كما", "ي", "ني", "نا")
AFTER = Table("letters_after", "letters", "string", tuple((x,) for x in sorted(
    {e + p for e in ("", "ت", "نا", "وا", "ون", "ين", "ان", "ات", "تم", "تمو", "تن", "ن", "ا", "و", "ي", "ة") for p in _PRONOUNS if not (p and e in ("وا", "ون", "ان", "تم", "ة")) and not (e in ("ا", "ي") and p in ("ي", "ك", "ه"))} | {"تما", "تموا"}
)))

#: How a root of too few letters is filled up (M10). Documentation of the rules below.
EXPANSIONS = Table("expansions", "expansion condition effect", "string string string", (
    ("doubled", "two root letters, one with shadda", "the letter with shadda stands twice"), ("hollow", "two root letters, a long vowel of the pattern between them", "alif and waw give waw, ya gives ya"),
    ("defective", "two root letters, a weak letter of the pattern behind the last", "alif and waw give waw, ya and alif maqsura give ya"), ("none", "otherwise", "the root letters alone"),
))


def lettered(df: DataFrame, column: str) -> DataFrame:
    """``df`` with arrays for each letter: as written, folded over hamzas, its sign (d shadda, s sukun, n none), its vowel (``-`` none).

    A final alif of nunation is part of the ending, not a letter.
    """
    cut = F.regexp_replace(F.regexp_replace(column, "اً$", "ً"), "ًا$", "ً")
    pair = f"([^{A}])([{A}]*)"
    df = df.withColumn("_cut", cut).withColumns({"letters": F.regexp_extract_all("_cut", F.lit(pair), F.lit(1)), "_marks": F.regexp_extract_all("_cut", F.lit(pair), F.lit(2))})
    sign = lambda m: F.when(F.contains(m, F.lit(SHADDA)), "d").when(F.contains(m, F.lit(SUKUN)), "s").otherwise("n")
    vowel = lambda m: F.when(m.rlike("[َُِ]"), F.regexp_extract(m, "([َُِ])", 1)).otherwise("-")
    return df.withColumns({"folded": F.transform("letters", lambda x: F.translate(x, HAMZAS, "ا" * len(HAMZAS))), "signs": F.transform("_marks", sign), "vowels": F.transform("_marks", vowel)}).drop("_cut", "_marks")


def pattern_rows(patterns: DataFrame) -> DataFrame:
    """Patterns with their key (own letters, ``.`` for root letters), mask, marks, how many letters, and the expansion of short roots."""
    p = lettered(patterns.select("pattern", "kind"), "pattern")
    slot = lambda x: F.lit(SLOTS).contains(x)
    key = F.array_join(F.transform("folded", lambda x: F.when(slot(x), F.lit(".")).otherwise(x)), "")
    p = p.select("pattern", "kind", F.size("letters").alias("n"), key.alias("key"), F.col("signs").alias("p_signs"), F.col("vowels").alias("p_vowels"))
    p = p.withColumns({"mask": F.regexp_replace("key", r"[^.]", "x"), "slots": F.length(F.regexp_replace("key", r"[^.]", ""))})
    twice = F.expr("exists(sequence(0, n - 1), i -> substr(key, i + 1, 1) = '.' AND get(p_signs, i) = 'd')")
    expansion = F.when(F.col("slots") != 2, "none").when(twice, "doubled").when(F.col("key").rlike(r"\.[اوي]\."), "hollow").when(F.col("key").rlike(r"\.[^.]*[اويى][^.]*$"), "defective").otherwise("none")
    weak = F.when(expansion == "hollow", F.regexp_extract("key", r"\.([اوي])\.", 1)).when(expansion == "defective", F.regexp_extract("key", r"([اويى])[^.اويى]*$", 1)).otherwise("")
    return p.withColumns({"expansion": expansion, "weak": F.translate(weak, "اى", "وي")})


def cores(distinct: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Every stretch of two letters or more of each word whose surroundings are known affixes; shadda of a sun letter behind the article is none."""
    w = lettered(distinct.select("word"), "word").withColumn("size", F.size("letters")).where("size >= 2")
    w = w.withColumn("first", F.explode(F.sequence(F.lit(0), F.least(F.lit(5), F.col("size") - 2))))
    w = w.withColumn("prefix", F.array_join(F.slice("folded", F.lit(1), F.col("first")), "")).join(F.broadcast(before.select(F.translate("letters", HAMZAS, "ا" * len(HAMZAS)).alias("prefix")).distinct()), "prefix")
    w = w.where(F.expr(f"forall(sequence(0, first), i -> i = first OR get(vowels, i) = '-' OR coalesce(nullif(transform(array(get(letters, i)), x -> {_BEFORE_VOWEL})[0], ''), get(vowels, i)) = get(vowels, i))"))
    w = w.where("NOT (first > 0 AND get(letters, first) = 'ل' AND get(signs, first) = 'n' AND get(vowels, first) = '-')")  # a bare lam is the article's
    w = w.withColumn("n", F.explode(F.sequence(F.lit(2), F.col("size") - F.col("first"))))
    w = w.withColumn("suffix", F.array_join(F.expr("slice(folded, first + n + 1, size)"), "")).join(F.broadcast(after.select(F.translate("letters", HAMZAS, "ا" * len(HAMZAS)).alias("suffix")).distinct()), "suffix")
    part = lambda c: F.slice(c, F.col("first") + 1, F.col("n"))
    signs = part("signs")
    sun = F.col("prefix").rlike("ا?ل$") & F.get("folded", F.col("first")).rlike(f"[{ar.SUN}]") & (F.get("signs", F.col("first")) == "d")
    signs = F.when(sun, F.concat(F.array(F.lit("n")), F.slice(signs, 2, 20))).otherwise(signs)
    return w.select("word", "prefix", "suffix", "n", part("letters").alias("core"), part("folded").alias("core_folded"), signs.alias("signs"), part("vowels").alias("vowels"))


#: Vowels that single letters before a word may have: and, so, future, whether with fatha, as with fatha, by with kasra.
_BEFORE_VOWEL = "CASE WHEN x IN ('و', 'ف', 'س', 'ك', 'أ') THEN 'َ' WHEN x = 'ب' THEN 'ِ' ELSE '' END"

#: Root letters are neither bare alif, alif maqsura nor ta marbuta; a long vowel of the pattern within it has no vowel of
#: its own in the word. Marks agree (M4); at the last letter before a suffix the pattern's vowel may be gone, and a pattern without a mark takes any (M5).
_AGREE = """forall(sequence(0, n - 1), i -> CASE
  WHEN substr(key, i + 1, 1) = '.' AND get(core, i) IN ('ا', 'ى', 'ة') THEN false
  WHEN i > 0 AND i < n - 1 AND substr(key, i + 1, 1) IN ('ا', 'و', 'ي') AND get(p_signs, i) = 'n' AND get(p_vowels, i) = '-' AND get(vowels, i) <> '-' THEN false
  WHEN i < n - 1 OR suffix = '' THEN get(p_signs, i) = get(signs, i) AND (get(p_signs, i) = 's' OR get(p_vowels, i) = '-' OR get(vowels, i) = '-' OR get(p_vowels, i) = get(vowels, i))
  WHEN (get(p_signs, i) = 'd') <> (get(signs, i) = 'd') THEN false
  WHEN get(p_signs, i) = 'n' AND get(p_vowels, i) = '-' THEN true
  WHEN get(p_signs, i) = 's' THEN get(signs, i) = 's'
  ELSE get(signs, i) <> 's' AND (get(p_vowels, i) = '-' OR get(vowels, i) = '-' OR get(p_vowels, i) = get(vowels, i)) END)"""


#: A verb has no article, no preposition but lam before it, and no nominal ending behind it.
_TAKES = "kind = 'N' OR kind = 'PV|N' OR NOT regexp_like(prefix, '[بك]|ال') AND NOT regexp_like(suffix, '^(ة|ات)')"


def alignments(table: DataFrame, rules: Rules | None = None) -> DataFrame:
    """(word, pattern, kind, root, expansion, prefix, suffix, clitics, n, own, rank): every alignment of each distinct ``word`` (L3)."""
    rules, spark = rules or Rules(), table.sparkSession
    patterns = save(pattern_rows(rules.frame(spark, PATTERNS)), "patterns")
    masks = patterns.select("n", "mask").distinct()
    c = cores(table.select("word").where("word is not null").distinct(), rules.frame(spark, BEFORE), rules.frame(spark, AFTER))
    keyed = checked_join(c, masks, ["n"], "inner").withColumn("key", F.expr("array_join(transform(sequence(0, n - 1), i -> if(substr(mask, i + 1, 1) = '.', '.', get(core_folded, i))), '')"))
    met = checked_join(keyed, patterns.drop("mask", "n"), ["key"], "inner").where(F.expr(_AGREE)).where(F.expr(_TAKES))
    taken = F.expr("array_join(filter(core, (x, i) -> substr(key, i + 1, 1) = '.'), '')")
    doubled = F.expr("array_join(transform(filter(sequence(0, n - 1), i -> substr(key, i + 1, 1) = '.'), i -> if(get(p_signs, i) = 'd', get(core, i) || get(core, i), get(core, i))), '')")
    root = F.when(F.col("expansion") == "doubled", doubled).when(F.col("expansion") == "hollow", F.concat(F.substring(taken, 1, 1), "weak", F.substring(taken, 2, 1))).otherwise(F.concat(taken, "weak"))
    met = met.select("word", "pattern", "kind", F.translate(root, HAMZAS, "ا" * len(HAMZAS)).alias("root"), "expansion", "prefix", "suffix", (F.length("prefix") + F.length("suffix")).alias("clitics"), "n", (F.col("n") - F.col("slots")).alias("own"))
    size = F.length("root")
    return met.withColumn("rank", F.when(size == 3, 0).when(size == 4, 1).when(size == 2, 2).otherwise(10))


def best_alignment(table: DataFrame, rules: Rules | None = None) -> DataFrame:
    """One row a word that aligns: root of three letters, then four, two, others; fewest clitics; longest; most own letters; name (L1, L2)."""
    met = alignments(table, rules)
    order = F.struct("rank", "clitics", (-F.col("n")).alias("n"), (-F.col("own")).alias("own"), "pattern", "prefix", "kind", "root", "expansion", "suffix")
    best = met.groupBy("word").agg(F.min(order).alias("b"), F.count("*").alias("fits"))
    return save(best.select("word", "b.pattern", "b.kind", "b.root", "b.expansion", "b.prefix", "b.suffix", "b.clitics", "fits"), "alignments")


def m03_alignment(spark: SparkSession, sf_dir: str, rules: Rules | None = None) -> DataFrame:
    """The best alignment of each word and how many alignments it has (M3 to M9, L1 to L3)."""
    w = read_words(spark, sf_dir).select("id", "word")
    return checked_join(w, best_alignment(w, rules), ["word"]).select("id", "pattern", "kind", "root", "expansion", "prefix", "suffix", "clitics", F.coalesce("fits", F.lit(0).cast("long")).alias("fits"))


def _regex(pattern: str, last: bool) -> str:
    """A pattern as a regular expression over letters of three characters each: letter, sign, vowel."""
    pairs, out = [], []
    for c in pattern:
        if c in "ًٌٍَُِّْ":
            pairs[-1][1] += c
        else:
            pairs.append([c, ""])
    for i, (c, marks) in enumerate(pairs):
        own, end = c not in SLOTS, i == len(pairs) - 1
        letter = ("ا" if c in HAMZAS else c) if own else "[^اىة]"
        sign = "d" if SHADDA in marks else "s" if SUKUN in marks else "n"
        vowel = next((x for x in marks if x in "َُِ"), "-")
        if end and last:  # before a suffix
            out.append(letter + {"n-": "[ns].", "s-": "s.", "d-": "d."}.get(sign + vowel, f"{sign}[-{vowel}]"))
        elif own and 0 < i < len(pairs) - 1 and c in "اوي" and not marks:
            out.append(f"{letter}n-")
        else:
            out.append(f"{letter}{sign}{'.' if vowel == '-' or sign == 's' else f'[-{vowel}]'}")
    return f"^{''.join(out)}$"


def _oracle_patterns() -> str:
    """Default patterns for the oracle, which tries each on every core of its length."""
    rows = []
    for pattern, kind in PATTERNS.rows:
        key = "".join("." if c in SLOTS else "ا" if c in HAMZAS else c for c in pattern if c not in "ًٌٍَُِّْ")
        slots = [i for i, c in enumerate(key) if c == "."]
        twice = len(slots) == 2 and [i for i in slots if SHADDA in _marks_of(pattern)[i]]
        between, behind = key[slots[0] + 1 : slots[-1]], [c for c in key[slots[-1] + 1 :] if c in "اويى"]
        expansion, weak = "none", ""
        if twice:
            expansion = "doubled"
        elif len(slots) == 2 and between in ("ا", "و", "ي"):
            expansion, weak = "hollow", between
        elif len(slots) == 2 and behind:
            expansion, weak = "defective", behind[-1]
        weak = {"ا": "و", "ى": "ي"}.get(weak, weak)
        rows.append((pattern, kind, len(key), len(key) - len(slots), _regex(pattern, False), _regex(pattern, True), expansion, weak, key, twice[0] if twice else -1))
    return Table("pats", "pattern kind n own whole before_suffix expansion weak pkey doubled", "string string int int string string string string string int", tuple(rows)).sql()


def _marks_of(pattern: str) -> list[str]:
    out: list[str] = []
    for c in pattern:
        if c in "ًٌٍَُِّْ":
            out[-1] += c
        else:
            out.append("")
    return out


_FOLD = f"translate({{0}}, '{HAMZAS}', '{'ا' * len(HAMZAS)}')"
_PAIR = f"([^{A}])([{A}]*)"
_ALIGNED_SQL = f"""{_oracle_patterns()}, {BEFORE.sql()}, {AFTER.sql()},
bare AS (SELECT DISTINCT word, regexp_replace(regexp_replace(word, 'اً$', 'ً'), 'ًا$', 'ً') AS cut FROM words),
lets AS (SELECT word, regexp_extract_all(cut, '{_PAIR}', 1) AS l, regexp_extract_all(cut, '{_PAIR}', 2) AS m FROM bare),
coded AS (SELECT word, l, list_transform(l, lambda x: {_FOLD.format("x")}) AS f, list_transform(m, lambda x: CASE WHEN contains(x, 'ّ') THEN 'd' WHEN contains(x, 'ْ') THEN 's' ELSE 'n' END) AS s, list_transform(m, lambda x: CASE WHEN regexp_matches(x, '[َُِ]') THEN regexp_extract(x, '([َُِ])', 1) ELSE '-' END) AS v FROM lets),
starts AS (SELECT *, unnest(range(0, least(5, len(l) - 2) + 1)) AS first FROM coded WHERE len(l) >= 2),
spans AS (SELECT *, unnest(range(2, len(l) - first + 1)) AS n FROM starts),
cored AS (
  SELECT word, n, array_to_string(f[1 : first], '') AS prefix, array_to_string(f[first + n + 1 : len(f)], '') AS suffix, l[first + 1 : first + n] AS core, v[1 : first] AS pv, l[1 : first] AS pl,
    f[first + 1 : first + n] AS cf, s[first + 1 : first + n] AS cs, v[first + 1 : first + n] AS cv FROM spans
),
fitting AS (
  SELECT * REPLACE (CASE WHEN regexp_matches(prefix, 'ا?ل$') AND regexp_matches(cf[1], '[{ar.SUN}]') AND cs[1] = 'd' THEN list_concat(['n'], cs[2 : 20]) ELSE cs END AS cs) FROM cored
  WHERE prefix IN (SELECT {_FOLD.format("letters")} FROM letters_before) AND suffix IN (SELECT {_FOLD.format("letters")} FROM letters_after)
    AND list_bool_and(list_concat([true], list_transform(range(1, len(pl) + 1), lambda i: pv[i] = '-' OR pv[i] = CASE WHEN pl[i] IN ('و', 'ف', 'س', 'ك', 'أ') THEN 'َ' WHEN pl[i] = 'ب' THEN 'ِ' ELSE pv[i] END)))
    AND NOT (len(pl) > 0 AND core[1] = 'ل' AND cs[1] = 'n' AND cv[1] = '-')
),
strings AS (SELECT *, array_to_string(list_transform(range(1, n + 1), lambda i: cf[i] || cs[i] || cv[i]), '') AS code FROM fitting),
near AS MATERIALIZED (SELECT s.*, p.* EXCLUDE (n) FROM strings s JOIN pats p ON p.n = s.n AND array_to_string(s.cf, '') LIKE replace(p.pkey, '.', '_')),
met AS (
  SELECT * FROM near WHERE regexp_matches(code, replace(CASE WHEN suffix = '' THEN whole ELSE before_suffix END, '[^اىة]', '.')) AND list_bool_and(list_transform(range(1, n + 1), lambda i: substr(pkey, i, 1) <> '.' OR core[i] NOT IN ('ا', 'ى', 'ة')))
    AND (kind IN ('N', 'PV|N') OR NOT regexp_matches(prefix, '[بك]|ال') AND NOT regexp_matches(suffix, '^(ة|ات)'))
),
rooted AS (
  SELECT word, pattern, kind, expansion, prefix, suffix, length(prefix) + length(suffix) AS clitics, n, own,
    translate(CASE WHEN expansion = 'hollow' THEN taken[1] || weak || taken[2] WHEN expansion = 'doubled' THEN array_to_string(list_transform(range(1, n + 1), lambda i: CASE WHEN substr(pkey, i, 1) <> '.' THEN '' WHEN i = doubled + 1 THEN core[i] || core[i] ELSE core[i] END), '') ELSE array_to_string(taken, '') || weak END, '{HAMZAS}', '{'ا' * len(HAMZAS)}') AS root
  FROM (SELECT *, list_filter(list_transform(range(1, n + 1), lambda i: CASE WHEN substr(pkey, i, 1) = '.' THEN core[i] ELSE '' END), lambda x: x <> '') AS taken FROM met)
),
best AS MATERIALIZED (
  SELECT *, count(*) OVER (PARTITION BY word) AS fits FROM rooted
  QUALIFY row_number() OVER (PARTITION BY word ORDER BY CASE length(root) WHEN 3 THEN 0 WHEN 4 THEN 1 WHEN 2 THEN 2 ELSE 10 END, clitics, -n, -own, pattern, prefix) = 1
)"""
ALIGNED_SQL = f"{READINGS_SQL}, words AS (SELECT * FROM read_words), {_ALIGNED_SQL}"
M03 = f"WITH {ALIGNED_SQL} SELECT w.id, pattern, kind, root, expansion, prefix, suffix, clitics::INT AS clitics, coalesce(fits, 0) AS fits FROM words w LEFT JOIN best USING (word)"

QUERIES = {"m03_alignment": m03_alignment}
ORACLE = {"m03_alignment": M03}
