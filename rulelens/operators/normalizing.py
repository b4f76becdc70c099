"""Normalisation queries (N1 to N26) over the vocabulary, documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulelens.functions import arabic as ar
from rulelens.plans.reading import spread, table
from rulelens.sources.rules import Table
from rulelens.sources.spelled import WRITTEN_WORDS_SQL, written_words

_M, _A, _R = ar.MARKS, ar.ALL_MARKS, ar.RECITATION
_MADDA = f"translate(regexp_replace({{0}}, '(^|\\s)([{_A}{ar.TATWEEL}]*)آ', '\\1\\2أَا', 'g'), 'آ', 'ا')"
# RE2 has no back references: repeats of each mark are named one by one.
_ONCE = "regexp_replace({0}, '([ً-ِْ])ّ', 'ّ\\1', 'g')"
for _mark in map(chr, range(0x64B, 0x653)):
    _ONCE = f"regexp_replace({_ONCE}, '{_mark}+', '{_mark}', 'g')"
_SHADDA = f"regexp_replace({_ONCE}, '(^|\\s)[{_A}]+', '\\1', 'g')"
_SQUEEZE = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


def n_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("word")
    return written_words(spark, sf_dir).select(
        "id", ar.nfc(w).alias("n01"), ar.squeeze(w).alias("n02"), ar.drop_tatweel(w).alias("n03"), ar.wasla_to_alif(w).alias("n04"), ar.dagger_to_alif(w).alias("n05"),
        ar.open_madda(w).alias("n06"), ar.light_fold(w).alias("n12"), ar.strong_fold(w).alias("n13"), ar.strip_marks(w).alias("n14"), ar.strip_all(w).alias("n15"),
        ar.strict_key(w).alias("n18"), ar.root_fold(w).alias("n22"), ar.ascii_digits(w).alias("n26"), ar.strip_all(ar.pause_to_space(w)).alias("n20"),
    )


N_FOLDS = f"""WITH {WRITTEN_WORDS_SQL}
SELECT id, nfc_normalize(word) AS n01, {_SQUEEZE.format("word")} AS n02, replace(word, '{ar.TATWEEL}', '') AS n03, translate(word, '{ar.WASLA}', 'ا') AS n04,
  translate(word, '{ar.DAGGER}', 'ا') AS n05, {_MADDA.format("word")} AS n06, translate(word, 'ٱآ', 'اا') AS n12, translate(word, 'ٱآإأٰؤ', 'اااااا') AS n13,
  regexp_replace(word, '[{_M}]', '', 'g') AS n14, regexp_replace(word, '[{_A}]', '', 'g') AS n15,
  regexp_replace(translate(replace(word, '{ar.TATWEEL}', ''), 'ٱآإأٰؤ', 'اااااا'), '[{_A}]', '', 'g') AS n18,
  translate(word, 'أإآؤئء', 'اااويا') AS n22, translate(word, '٠١٢٣٤٥٦٧٨٩', '0123456789') AS n26,
  regexp_replace({_SQUEEZE.format(f"regexp_replace(word, '[{_R}]', ' ', 'g')")}, '[{_A}]', '', 'g') AS n20
FROM words"""


def n10_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ar.normalize(written_words(spark, sf_dir), "word").select("id", "normalized", F.array_join("applied", ",").alias("applied"))


N10 = f"""WITH {WRITTEN_WORDS_SQL},
s1 AS (SELECT id, word AS s0, nfc_normalize(word) AS s1 FROM words),
s2 AS (SELECT *, {_SQUEEZE.format("s1")} AS s2 FROM s1), s3 AS (SELECT *, replace(s2, '{ar.TATWEEL}', '') AS s3 FROM s2),
s4 AS (SELECT *, translate(s3, '{ar.WASLA}', 'ا') AS s4 FROM s3), s5 AS (SELECT *, {_MADDA.format("s4")} AS s5 FROM s4),
s6 AS (SELECT *, {_SHADDA.format("s5")} AS s6 FROM s5)
SELECT id, s6 AS normalized, concat_ws(',', CASE WHEN s1 <> s0 THEN 'nfc' END, CASE WHEN s2 <> s1 THEN 'squeeze' END, CASE WHEN s3 <> s2 THEN 'tatweel' END,
  CASE WHEN s4 <> s3 THEN 'wasla' END, CASE WHEN s5 <> s4 THEN 'madda' END, CASE WHEN s6 <> s5 THEN 'marks' END) AS applied FROM s6"""


def n11_root_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile for root work: options on, and nunation cut."""
    w = F.col("word")
    return written_words(spark, sf_dir).select("id", ar.open_wasl(w).alias("n07"), ar.sun_lam(w).alias("n08"), ar.strip_tanwin(w).alias("n21"))


N11 = f"""WITH {WRITTEN_WORDS_SQL}
SELECT id, CASE WHEN regexp_matches(word, '^ا[^{_A}\\s][{_A}]*[^{_A}\\s][{_A}]*ُ') THEN 'أُ' || substr(word, 2)
                WHEN regexp_matches(word, '^ا[^{_A}\\s][{_A}]*[^{_A}\\s]') THEN 'إِ' || substr(word, 2) ELSE word END AS n07,
  regexp_replace(word, '^(ال)([{ar.SUN}])([{_M}]*?)ّ', '\\1\\2\\3') AS n08,
  regexp_replace(CASE WHEN ends_with(word, 'ًا') OR ends_with(word, 'اً') THEN left(word, length(word) - 2) ELSE word END, '[ً-ٍ]$', '') AS n21
FROM words"""

#: Longest first: raw text, correction, confidence. Corrections below the threshold are only suggested.
OCR = Table("ocr", "raw fixed confidence", "string string double", (("teh ", "the ", 0.95), ("  ", " ", 0.9), (" ,", ",", 0.9), ("tion tion", "tion", 0.6), ("***", "*", 0.88), ("###", "#", 0.88)))
THRESHOLD = 0.85


def n24_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with the sure corrections applied longest first, and how many were applied or only suggested."""
    rules = sorted(OCR.rows, key=lambda r: (-len(r[0]), r[0]))
    text = F.coalesce("text", F.lit(""))
    fixed = text
    for raw, to, confidence in rules:
        if confidence >= THRESHOLD:
            fixed = F.replace(fixed, F.lit(raw), F.lit(to))
    hits = lambda sure: sum((F.contains(text, F.lit(r)).cast("int") for r, _, c in rules if (c >= THRESHOLD) == sure), F.lit(0))
    docs = spread(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", F.md5(fixed).alias("fixed_md5"), hits(True).alias("applied"), hits(False).alias("suggested"))


def _n24_sql() -> str:
    fixed = "coalesce(text, '')"
    rules = sorted(OCR.rows, key=lambda r: (-len(r[0]), r[0]))
    for raw, to, confidence in rules:
        if confidence >= THRESHOLD:
            fixed = f"replace({fixed}, '{raw}', '{to}')"
    hits = lambda sure: " + ".join(["0", *[f"contains(coalesce(text, ''), '{r}')::INT" for r, _, c in rules if (c >= THRESHOLD) == sure]])
    return f"SELECT doc_id, md5({fixed}) AS fixed_md5, {hits(True)} AS applied, {hits(False)} AS suggested FROM documents"


def n25_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of a web page: scripts, styles, comments and tags out, entities in, blanks squeezed."""
    x = F.coalesce("html", F.lit(""))
    for pattern, to in ((r"(?s)<script.*?</script>", " "), (r"(?s)<style.*?</style>", " "), (r"(?s)<!--.*?-->", " "), (r"(?s)<[^>]*>", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        x = F.regexp_replace(x, pattern, to)
    title = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    return spread(table(spark, sf_dir, "pages")).select("page_id", title.alias("title"), F.md5(ar.squeeze(x)).alias("text_md5"))


def _n25_sql() -> str:
    x = "coalesce(html, '')"
    for pattern, to in ((r"(?s)<script.*?</script>", " "), (r"(?s)<style.*?</style>", " "), (r"(?s)<!--.*?-->", " "), (r"(?s)<[^>]*>", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return f"SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, md5({_SQUEEZE.format(x)}) AS text_md5 FROM pages"


QUERIES = {"n01_n26_folds": n_folds, "n10_pipeline": n10_pipeline, "n11_root_profile": n11_root_profile, "n24_ocr": n24_ocr, "n25_page_text": n25_page_text}
ORACLE = {"n01_n26_folds": N_FOLDS, "n10_pipeline": N10, "n11_root_profile": N11, "n24_ocr": _n24_sql(), "n25_page_text": _n25_sql()}
