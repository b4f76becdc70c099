"""Segments, roots and classes of real words against stated analyses, and rule tables read from files."""

import pytest

from rulelens.operators import alignment, morphology, segmenter
from rulelens.sources import readings
from rulelens.sources.rules import Rules, Table
from tests.words import rows

ROWS = rows()


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(r[0],) for r in ROWS] + [(None,), (ROWS[0][0],), ("",)], "word string").repartition(3)


def test_segments(table):
    got = {r.word: r for r in segmenter.segments(table).collect()}
    assert len(got) == len(ROWS) + 1 >= 110
    assert {w: (got[w].prefixes, got[w].stem, got[w].suffixes) for w, *_ in ROWS} == {w: (p, s, x) for w, p, s, x, *_ in ROWS}
    assert all(r.rebuilds for r in got.values()) and got[""].stem == ""


def test_tags(table):
    got = {r.word: r.tags for r in segmenter.segments(table).collect()}
    stated = {"وَلْيَكْتُبْ": "CONJ+LAM_AMR", "فَسَيَعْلَمُ": "CONJ+FUT+IMPERF_PREF", "لِلنَّاسِ": "PREP+DET", "رَزَقْنَاهُمْ": "PRON+PRON", "مَدْرَسَتُهُمْ": "TAA+PRON", "اكْتُبُوا": "IMP_PREF+SUBJ", "كَتَبَتْ": "PV_SUBJ", "هُوَ": ""}
    by_letters = {w.replace("ّ", ""): t for w, t in got.items() if w}
    assert {w: by_letters["".join(c for c in w if c != "ّ")] for w in stated} == stated


def test_roots(table):
    got = {r.word: r for r in segmenter.roots(table).collect()}
    assert {w: got[w].root or "-" for w, *_ in ROWS} == {w: root for w, *_, root, _ in ROWS}
    assert got["قَامَ"].expansion == "hollow" and got["دَعَا"].expansion == "defective"
    assert [got[w].proof for w in ("هُوَ", "كَتَبَ", "")] == ["Certificate", "Hypothesis", "Zero"]


def test_classes(table):
    got = {r.word: r for r in morphology.classes(table).collect()}
    assert {w: got[w]["class"] for w, *_ in ROWS} == {w: cls for w, *_, cls in ROWS}
    assert [got[w].aspect for w in ("كَتَبَ", "سَيَكْتُبُ", "اكْتُبْ", "كِتَابٌ")] == ["PV", "IV", "CV", "-"]
    assert [got[w].closed_kind for w in ("فِي", "لَمْ", "هَذَا", "وَهُوَ", "كِتَابٌ")] == ["preposition", "jussive", "demonstrative", "built_noun", "-"]


def test_readings_are_what_they_were_built_from(spark):
    words = readings.readings(spark.range(4000).selectExpr("concat('t', id) AS token"))
    told = {r.word: r for r in words.collect()}
    parts = {r.word: r for r in segmenter.segments(words).collect()}
    assert len(told) > 900
    assert all((parts[w].prefixes, parts[w].stem, parts[w].suffixes) == (r.prefixes, r.stem, r.suffixes) for w, r in told.items())
    found = {r.word: r.root for r in segmenter.roots(words).collect()}
    with_root = [w for w, r in told.items() if r.root and r.kind != "F"]
    assert sum(found[w] == told[w].root for w in with_root) >= 0.98 * len(with_root)


def test_all_alignments_of_a_word(spark):
    got = alignment.alignments(spark.createDataFrame([("كِتَابُهُمْ",), ("قَالَ",)], "word string")).collect()
    assert {(r.pattern, r.root) for r in got if r.word == "قَالَ"} == {("فَال", "قول")}
    assert ("فِعَال", "كتب", "", "هم") in {(r.pattern, r.root, r.prefix, r.suffix) for r in got}
    assert not [r for r in got if r.prefix == "ك"]  # as has fatha


def brute_alignments(word, patterns):
    """Patterns tried one by one at each offset, letter by letter."""
    import re

    marks = "ًٌٍَُِّْ"
    fold = str.maketrans("أإآؤئءٱ", "ااااااا")
    cut = re.sub("ًا$|اً$", "ً", word)
    pairs = [(m[1], m[2]) for m in re.finditer(f"([^{marks}])([{marks}]*)", cut)]
    before, after = {r[0].translate(fold) for r in alignment.BEFORE.rows}, {r[0].translate(fold) for r in alignment.AFTER.rows}
    sign = lambda m: "d" if "ّ" in m else "s" if "ْ" in m else "n"
    vowel = lambda m: next((c for c in m if c in "َُِ"), "-")
    need = dict.fromkeys("وفسكأ", "َ") | {"ب": "ِ"}
    out = set()
    for pattern, kind in patterns:
        own = [(m[1], m[2]) for m in re.finditer(f"([^{marks}])([{marks}]*)", pattern)]
        for first in range(min(5, len(pairs) - 2) + 1):
            core, rest = pairs[first : first + len(own)], pairs[first + len(own) :]
            prefix, suffix = "".join(c for c, _ in pairs[:first]).translate(fold), "".join(c for c, _ in rest).translate(fold)
            if len(core) < len(own) or len(own) < 2 or prefix not in before or suffix not in after:
                continue
            if any(vowel(m) not in ("-", need.get(c, vowel(m))) for c, m in pairs[:first]):
                continue
            if first and core[0][0] == "ل" and sign(core[0][1]) == "n" and vowel(core[0][1]) == "-":
                continue
            if kind not in ("N", "PV|N") and (re.search("[بك]|ال", prefix) or re.match("ة|ات", suffix)):
                continue
            signs = [sign(m) for _, m in core]
            if re.search("ا?ل$", prefix) and core[0][0] in "تثدذرزسشصضطظلن" and signs[0] == "d":
                signs[0] = "n"
            good = True
            for i, ((pc, pm), (wc, wm)) in enumerate(zip(own, core, strict=True)):
                slot, last = pc in "فعل", i == len(own) - 1
                ps, pv, ws, wv = sign(pm), vowel(pm), signs[i], vowel(wm)
                good &= wc not in "اىة" if slot else pc.translate(fold) == wc.translate(fold)
                if not slot and 0 < i < len(own) - 1 and pc.translate(fold) in "اوي" and ps == "n" and pv == "-":
                    good &= wv == "-"
                if not last or not suffix:
                    good &= ps == ws and (ps == "s" or "-" in (pv, wv) or pv == wv)
                elif (ps == "d") != (ws == "d"):
                    good = False
                elif ps == "n" and pv == "-":
                    pass
                elif ps == "s":
                    good &= ws == "s"
                else:
                    good &= ws != "s" and ("-" in (pv, wv) or pv == wv)
            if good:
                out.add((pattern, prefix, suffix))
    return out


def test_alignments_match_brute_force(spark, table):
    words = [w for w, *_ in ROWS][::3]
    got = {}
    for r in alignment.alignments(spark.createDataFrame([(w,) for w in words], "word string")).collect():
        got.setdefault(r.word, set()).add((r.pattern, r.prefix, r.suffix))
    assert {w: got.get(w, set()) for w in words} == {w: brute_alignments(w, alignment.PATTERNS.rows) for w in words}


def test_rule_tables_from_files(spark, tmp_path):
    (tmp_path / "patterns.csv").write_text("wazn,aspect\nفَعَل,PV\n مَفْعَلَة ,N\n,\n", encoding="utf-8")
    (tmp_path / "closed.csv").write_text("form,class,tag\nكَتَبَ,PARTICLE,X\n", encoding="utf-8")
    rules = Rules(patterns=str(tmp_path / "patterns.csv"), closed_words=str(tmp_path / "closed.csv"), columns={"patterns": {"pattern": "wazn", "kind": "aspect"}})
    words = spark.createDataFrame([(w,) for w in ("كَتَبَ", "مَدْرَسَةٌ", "كِتَابٌ", "مِنْ")], "word string")
    assert {r.word: r.pattern for r in alignment.best_alignment(words, rules).collect()} == {"كَتَبَ": "فَعَل", "مَدْرَسَةٌ": "مَفْعَلَة"}
    got = {r.word: r for r in morphology.classes(words, rules).collect()}
    assert (got["كَتَبَ"]["class"], got["كَتَبَ"].source) == ("PARTICLE", "registry") and got["مِنْ"].source != "registry"


def test_rule_tables_are_checked(spark):
    table = Table("t", "key value", "string int", (("a", 1),))
    bound = lambda rows, names: Rules(t=spark.createDataFrame(rows, names))
    assert [tuple(r) for r in bound([(" b ", "2", "z")], ["key", "value", "more"]).frame(spark, table).collect()] == [("b", 2)]
    with pytest.raises(ValueError, match="lacks the columns value"):
        bound([("b",)], ["key"]).frame(spark, table)
    with pytest.raises(ValueError, match="several rows for b"):
        bound([("b", 1), ("b", 2)], ["key", "value"]).lookup(spark, table, "key")
    assert Rules().lookup(spark, table, "key")[1] is True


#: word: verdict, aspect, mood, person, number, gender of the verb; gender and number of the word.
VERBS = {
    "كَتَبَ": ("explicit", "PV", "none", "3", "SG", "M"), "كَتَبَتْ": ("suffix", "PV", "none", "3", "SG", "F"), "كَتَبْتُ": ("suffix", "PV", "none", "1", "SG", "C"), "كَتَبْتُمْ": ("suffix", "PV", "none", "2", "PL", "M"), "كَتَبْنَا": ("strong", "PV", "none", "1", "PL", "C"),
    "كَتَبُوا": ("suffix", "PV", "none", "3", "PL", "M"), "كَتَبَهُمْ": ("strong", "PV", "none", "3", "SG", "M"), "اسْتَغْفَرَ": ("strong", "PV", "none", "3", "SG", "M"), "يَكْتُبُ": ("mood", "IV", "indicative", "3", "SG", "M"), "يَكْتُبُونَ": ("mood", "IV", "indicative", "3", "PL", "M"),
    "تَكْتُبُونَ": ("mood", "IV", "indicative", "2", "PL", "M"), "نَعْلَمُ": ("mood", "IV", "indicative", "1", "PL", "C"), "فَسَيَعْلَمُ": ("mood", "IV", "indicative", "3", "SG", "M"), "وَلْيَكْتُبْ": ("mood", "IV", "jussive", "3", "SG", "M"), "لِيَكْتُبَ": ("mood", "IV", "subjunctive", "3", "SG", "M"), "لِيَكْتُبْ": ("mood", "IV", "jussive", "3", "SG", "M"),
    "اكْتُبْ": ("mood", "CV", "none", "2", "SG", "M"), "اكْتُبُوا": ("mood", "CV", "none", "2", "PL", "M"), "كَانَ": ("kana", "PV", "none", "3", "SG", "M"), "وَكَانَ": ("kana", "PV", "none", "3", "SG", "M"),
}
OTHERS = {"كِتَابٌ": "tanwin", "الْكِتَابُ": "non_verb", "كِتَابُهُمْ": "possessive", "مِنْ": "closed", "هُوَ": "closed", "الَّذِي": "closed", "يَوْمَ": "none", "مَسَاجِدُ": "none", "يُوسُفُ": "non_verb", "أَكْبَرُ": "non_verb"}
NUMBERS = {"مَدْرَسَةٌ": ("F", 0.9, "SG", "مدرسة"), "مُسْلِمَاتٌ": ("F", 0.85, "PL", "مسلمة"), "قُلُوبٌ": ("M", 0.3, "PL", "قلوب"), "مُعَلِّمُونَ": ("M", 0.3, "PL", "معلم"), "رَجُلَانِ": ("M", 0.3, "DU", "رجل"), "هِيَ": ("F", 1.0, "SG", "هي"), "هُمْ": ("M", 1.0, "PL", "هم"), "الْمُؤْمِنِينَ": ("M", 0.3, "PL_OR_DU", "مؤمن")}


@pytest.fixture(scope="module")
def parts(spark):
    from rulelens.functions.arabic import ordered

    return morphology.described(spark.createDataFrame([(ordered(w),) for w in {**VERBS, **OTHERS, **NUMBERS}], "word string"))


def by_word(staged, parts):
    return {r.word: r for r in staged.frame(parts).collect()}


def test_verdicts(parts):
    from rulelens.functions.arabic import ordered

    got = by_word(morphology.F16, parts)
    assert {w: got[ordered(w)].verdict for w in VERBS | OTHERS} == {w: v[0] for w, v in VERBS.items()} | OTHERS
    assert [got[w].proof for w in ("كَانَ", "كَتَبُوا", "كِتَابٌ")] == ["Certificate", "Hypothesis", "Zero"] and got["كَتَبُوا"].allows_event and not got["كَتَبُوا"].allows_relation


def test_mood_person_number_and_gender(parts):
    from rulelens.functions.arabic import ordered

    got = by_word(morphology.F17, parts)
    assert {w: (got[ordered(w)].aspect, got[ordered(w)].mood, got[ordered(w)].person, got[ordered(w)].number, got[ordered(w)].gender) for w in VERBS} == {w: v[1:] for w, v in VERBS.items()}
    assert {got[ordered(w)].aspect for w in OTHERS} == {"none"} and (got[ordered("فَسَيَعْلَمُ")].conj, got[ordered("فَسَيَعْلَمُ")].future) == ("فَ", "سَ")


def test_gender_and_number_of_words(parts):
    from rulelens.functions.arabic import ordered

    got = by_word(morphology.M20, parts)
    assert {w: (got[ordered(w)].gender, got[ordered(w)].gender_sure, got[ordered(w)].number, got[ordered(w)].singular) for w in NUMBERS} == NUMBERS
