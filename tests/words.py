"""Words with their stated analysis: prefixes, stem and suffixes joined by +, root (``-`` none is sought or found), class."""

WORDS = """
كَتَبَ||كَتَبَ||كتب|VERB
أَكَلَ||أَكَلَ||اكل|VERB
نَصَرَ||نَصَرَ||نصر|VERB
وَجَدَ||وَجَدَ||وجد|VERB
فَسَيَعْلَمُ|فَ+سَ+يَ|عْلَمُ||علم|VERB
لِيَكْتُبْ|لِ|يَكْتُبْ||كتب|VERB
كِتَابُهُمْ||كِتَابُ|هُمْ|كتب|NOUN
يَوْمَ||يَوْمَ||يوم|NOUN
قَالُوا||قَالُ|وا|قول|VERB
مُؤْمِنُونَ||مُؤْمِنُ|ونَ|امن|ADJ
لِلنَّاسِ|لِ+ل|نَّاسِ||نوس|NOUN
مِنْهُمْ|مِنْ|هُمْ||-|PREP
مَدْرَسَةٌ||مَدْرَسَ|ةٌ|درس|NOUN
وَلْيَكْتُبْ|وَ+لْ|يَكْتُبْ||كتب|VERB
فَلْيَكْتُبْ|فَ+لْ|يَكْتُبْ||كتب|VERB
الْكِتَابُ|الْ|كِتَابُ||كتب|NOUN
وَالْكِتَابِ|وَ+الْ|كِتَابِ||كتب|NOUN
بِالْقَلَمِ|بِ+الْ|قَلَمِ||قلم|NOUN
الشَّمْسُ|ال|شَّمْسُ||شمس|NOUN
وَالشَّمْسِ|وَ+ال|شَّمْسِ||شمس|NOUN
يَكْتُبُونَ|يَ|كْتُبُ|ونَ|كتب|VERB
تَكْتُبُونَ|تَ|كْتُبُ|ونَ|كتب|VERB
سَيَكْتُبُ|سَ+يَ|كْتُبُ||كتب|VERB
يَقُولُ|يَ|قُولُ||قول|VERB
يَقُولُونَ|يَ|قُولُ|ونَ|قول|VERB
كَتَبْتُمْ||كَتَبْ|تُمْ|كتب|VERB
كَتَبَتْ||كَتَبَ|تْ|كتب|VERB
كَتَبْتُ||كَتَبْ|تُ|كتب|VERB
كَتَبُوا||كَتَبُ|وا|كتب|VERB
كَتَبْنَا||كَتَبْ|نَا|كتب|VERB
رَزَقْنَاهُمْ||رَزَقْ|نَا+هُمْ|رزق|VERB
عَلَّمَ||عَلَّمَ||علم|VERB
يُعَلِّمُ|يُ|عَلِّمُ||علم|VERB
تَعَلَّمَ||تَعَلَّمَ||علم|VERB
قَاتَلَ||قَاتَلَ||قتل|VERB
أَرْسَلَ||أَرْسَلَ||رسل|VERB
أَرْسَلْنَا||أَرْسَلْ|نَا|رسل|VERB
انْكَسَرَ||انْكَسَرَ||كسر|VERB
اجْتَمَعَ||اجْتَمَعَ||جمع|VERB
اسْتَغْفَرَ||اسْتَغْفَرَ||غفر|VERB
يَسْتَغْفِرُونَ|يَ|سْتَغْفِرُ|ونَ|غفر|VERB
اكْتُبْ|ا|كْتُبْ||كتب|VERB
اكْتُبُوا|ا|كْتُبُ|وا|كتب|VERB
فَاكْتُبُوا|فَ+ا|كْتُبُ|وا|كتب|VERB
كِتَابٌ||كِتَابٌ||كتب|NOUN
رَسُولٌ||رَسُولٌ||رسل|NOUN
رَسُولُهُ||رَسُولُ|هُ|رسل|NOUN
عَالِمٌ||عَالِمٌ||علم|NOUN
الْعَالِمُ|الْ|عَالِمُ||علم|ADJ
كَاتِبُهُمْ||كَاتِبُ|هُمْ|كتب|ADJ
مَكْتُوبٌ||مَكْتُوبٌ||كتب|NOUN
الْمُعَلِّمُ|الْ|مُعَلِّمُ||علم|ADJ
مُسْلِمَاتٌ||مُسْلِمَ|اتٌ|سلم|NOUN
الْمُؤْمِنِينَ|الْ|مُؤْمِنِ|ينَ|امن|ADJ
مُعَلِّمُونَ||مُعَلِّمُ|ونَ|علم|ADJ
قُلُوبُهُمْ||قُلُوبُ|هُمْ|قلب|NOUN
مَسْجِدٌ||مَسْجِدٌ||سجد|NOUN
مَدْرَسَتُهُمْ||مَدْرَسَ|تُ+هُمْ|درس|NOUN
رَحْمَةٌ||رَحْمَ|ةٌ|رحم|NOUN
بِرَحْمَةٍ|بِ|رَحْمَ|ةٍ|رحم|NOUN
فِي||فِي||-|PREP
إِلَى||إِلَى||-|PREP
مِنْ||مِنْ||-|PREP
عَلَيْهِمْ|عَلَيْ|هِمْ||-|PREP
لَهُمْ|لَ|هُمْ||-|PREP
بِهِ|بِ|هِ||-|PREP
هُوَ||هُوَ||-|PRON
وَهُوَ|وَ|هُوَ||-|PRON
هَذَا||هَذَا||-|DEM
ذَلِكَ||ذَلِكَ||-|DEM
الَّذِي||الَّذِي||-|REL
وَالَّذِينَ|وَ|الَّذِينَ||-|REL
لَا||لَا||-|PARTICLE
لَمْ||لَمْ||-|PARTICLE
إِنَّ||إِنَّ||-|PARTICLE
ثُمَّ||ثُمَّ||-|CONJ
كَانَ||كَانَ||-|VERB
اللَّهُ||اللَّهُ||-|NOUN
وَاللَّهِ||وَاللَّهِ||-|NOUN
وَلَدٌ||وَلَدٌ||ولد|NOUN
وَقْتٌ||وَقْتٌ||وقت|NOUN
فَرِيقٌ||فَرِيقٌ||فرق|NOUN
وَاحِدٌ||وَاحِدٌ||وحد|NOUN
فَوْقَ||فَوْقَ||فوق|NOUN
وَجْهُهُ||وَجْهُ|هُ|وجه|NOUN
لِسَانٌ||لِسَانٌ||لسن|NOUN
بِلَادٌ||بِلَادٌ||بلد|NOUN
كَبِيرٌ||كَبِيرٌ||كبر|NOUN
سَمِعَ||سَمِعَ||سمع|VERB
سَمِعُوا||سَمِعُ|وا|سمع|VERB
فَتَحَ||فَتَحَ||فتح|VERB
وَفَتَحَ|وَ|فَتَحَ||فتح|VERB
فَفَتَحَ|فَ|فَتَحَ||فتح|VERB
نَفْسٌ||نَفْسٌ||نفس|NOUN
نُورٌ||نُورٌ||نور|NOUN
شَرِبَ||شَرِبَ||شرب|VERB
شَرِبُوهُ||شَرِبُو|هُ|شرب|VERB
رَدَّ||رَدَّ||ردد|VERB
دَعَا||دَعَا||دعو|VERB
رَمَى||رَمَى||رمي|VERB
قَالَ||قَالَ||-|VERB
قَامَ||قَامَ||قوم|VERB
يَدْعُو|يَ|دْعُو||دعو|VERB
يَرْمِي|يَ|رْمِي||رمي|VERB
خَرَجُوا||خَرَجُ|وا|خرج|VERB
تَدْخُلُ|تَ|دْخُلُ||دخل|VERB
نَعْلَمُ|نَ|عْلَمُ||علم|VERB
وَيَعْلَمُونَ|وَ+يَ|عْلَمُ|ونَ|علم|VERB
يُكْرِمُهُمْ|يُ|كْرِمُ|هُمْ|كرم|VERB
إِكْرَامٌ||إِكْرَامٌ||كرم|NOUN
تَعْلِيمٌ||تَعْلِيمٌ||علم|NOUN
اسْتِغْفَارٌ||اسْتِغْفَارٌ||غفر|NOUN
عُلَمَاءُ||عُلَمَاءُ||علم|NOUN
مِفْتَاحٌ||مِفْتَاحٌ||فتح|NOUN
كُتُبٌ||كُتُبٌ||كتب|NOUN
أَقْلَامٌ||أَقْلَامٌ||قلم|NOUN
""".strip()


def rows():
    from rulelens.functions.arabic import ordered

    return [tuple(ordered(line).split("|")) for line in WORDS.splitlines()]
