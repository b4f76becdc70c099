"""Analysed sentences for tests."""

from rulelens.sources.rules import Table

#: Analysed sentences: verbal and nominal ones, chains, attributes, pronouns, a question word, a repeated name.
SENTENCES = Table(
    "toks", "sent pos surface lemma class gcase definite gender number tense", "int int string string string string boolean string string string",
    (
        (1, 0, "كَتَبَ", "كتب", "VERB", None, None, "M", "SG", "past"), (1, 1, "الطَّالِبُ", "طالب", "NOUN", "NOM", True, "M", "SG", None), (1, 2, "الْجَدِيدُ", "جديد", "ADJ", "NOM", True, "M", "SG", None), (1, 3, "الدَّرْسَ", "درس", "NOUN", "ACC", True, "M", "SG", None), (1, 4, "فِي", "في", "PREP", None, None, None, None, None), (1, 5, "الْبَيْتِ", "بيت", "NOUN", "GEN", True, "M", "SG", None),
        (2, 0, "قَرَأَتْ", "قرأ", "VERB", None, None, "F", "SG", "past"), (2, 1, "مَرْيَمُ", "مريم", "NOUN", "NOM", True, "F", "SG", None), (2, 2, "كِتَابَ", "كتاب", "NOUN", "ACC", False, "M", "SG", None), (2, 3, "الْمُعَلِّمِ", "معلم", "NOUN", "GEN", True, "M", "SG", None), (2, 4, "هُوَ", "هو", "PRON", None, None, "M", "SG", None),
        (3, 0, "الْبَيْتُ", "بيت", "NOUN", "NOM", True, "M", "SG", None), (3, 1, "كَبِيرٌ", "كبير", "ADJ", "NOM", False, "M", "SG", None),
        (4, 0, "ذَهَبَ", "ذهب", "VERB", None, None, "M", "SG", "past"), (4, 1, "الرَّجُلُ", "رجل", "NOUN", "NOM", True, "M", "SG", None), (4, 2, "إِلَى", "إلى", "PREP", None, None, None, None, None), (4, 3, "السُّوقِ", "سوق", "NOUN", "GEN", True, "M", "SG", None), (4, 4, "بِـ", "ب", "PREP", None, None, None, None, None), (4, 5, "السَّيَّارَةِ", "سيارة", "NOUN", "GEN", True, "F", "SG", None), (4, 6, "ثُمَّ", "ثم", "CONJ", None, None, None, None, None), (4, 7, "يَرْجِعُ", "رجع", "VERB", None, None, "M", "SG", "present"), (4, 8, "غَدًا", "غدا", "TIME", None, None, None, None, "future"),
        (5, 0, "رَأَى", "رأى", "VERB", None, None, "M", "SG", "past"), (5, 1, "مُحَمَّدٌ", "محمد", "NOUN", "NOM", True, "M", "SG", None), (5, 2, "مُحَمَّدًا", "محمد", "NOUN", "ACC", True, "M", "SG", None), (5, 3, "هِيَ", "هي", "PRON", None, None, "F", "SG", None),
        (6, 0, "لَيْسَ", "ليس", "PARTICLE", None, None, None, None, None), (7, 0, "سَيَكْتُبُ", "كتب", "VERB", None, None, "M", "SG", "future"), (7, 1, "الْمُعَلِّمُونَ", "معلم", "NOUN", "NOM", True, "M", "PL", None), (7, 2, "هُمْ", "هم", "PRON", None, None, "M", "PL", None), (7, 3, "الْيَوْمَ", "اليوم", "TIME", None, None, None, None, "present"),
    ),
)
