"""Correction tables. In patterns, braces mark words that match whatever their diacritics.

Tables A (detection and repair), B (known misreadings) and the completions stay apart: they overlap and disagree,
and which one applies depends on the route.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from parchwork.functions.dialect import BLANKS, BOL, END, EOL, HARAKAT, S


class Rule(NamedTuple):
    category: str
    severity: str
    subject: str
    surah: str | None
    ayah: int | None
    pattern: str
    put: str


class Target(NamedTuple):
    surah: str
    ayah: int
    pattern: str
    put: str


class Completion(NamedTuple):
    pattern: str
    put: str
    critical: bool


def loose(literal: str) -> str:
    """A pattern for a word in any vocalisation: harakat in the literal say nothing, each letter may carry some, tatweel may come and go."""
    out = []
    for c in literal:
        if re.match(HARAKAT, c):
            continue
        out.append("ـ*" if c == "ـ" else (("\\" + c) if c in ".*+?^${}()|[]\\/" else c) + HARAKAT + "*+")
    return "".join(out)


def spelled(template: str) -> str:
    """Braces to loose words; `_` in a pattern is a run of blanks and tabs."""
    return re.sub(r"\{([؀-ۿ]+)\}", lambda m: loose(m[1]), template).replace("_", "[ \\t]+")


_Q, _E, _T = "quran_verse", "exercise_exam", "تفسير"
_LINE_END = f"(?=[ \\t]*\\n[ \\t]*{EOL}|{EOL})"

# Table A.
RULES: tuple[Rule, ...] = (
    Rule(_Q, "critical", _T, "سورة النبأ", 23, f"﴿?{S}*{{لينين}}{S}*﴾?", "لَّابِثِينَ"),
    Rule(_E, "critical", _T, "سورة النبأ", 31, f"﴿?{S}*{{مقاما}}{S}*﴾?(?=(?:_)?{{مفعل}}_{{من}}_{{الفوز}})|﴿?{S}*{{مقاما}}{S}*﴾?_{{مفعل}}_{{من}}_{{الفوز}}", "﴿مَفَازًا﴾ مفعل من الفوز"),
    Rule(_Q, "critical", _T, "سورة النبأ", 12, "{سباعا}(?=(?:_)?{شدادا})|﴿{سباعا}﴾(?=_﴿?{شدادا}﴾?)", "سَبْعًا"),
    Rule(_Q, "critical", _T, "سورة عبس", 25, f"﴿?{S}*{{أناصبنا}}(?:_{{الماء}})?{S}*﴾?", "أَنَّا صَبَبْنَا الْمَاءَ صَبًّا"),
    Rule(_Q, "critical", _T, "سورة عبس", 4, f"﴿?{S}*{{فستعفيه}}_{{الذكرى}}{S}*﴾?", "فَتَنفَعَهُ الذِّكْرَىٰ"),
    Rule(_Q, "critical", _T, "سورة النازعات", 1, "معنى_﴿?{غرفة}﴾?_مبالغة_في_النزع|معنى_﴿?غرفة﴾?_مبالغة", "معنى ﴿غَرْقًا﴾ مبالغة في النزع"),
    Rule(_E, "critical", _T, "سورة عبس", 28, f"المراد_بـ{S}*\\(?القضب\\)?(?:_في_قوله_تعالى:_﴿?{{وعنبا}}_{{وقضبا}}﴾?)?_البر_والشعير(?:{S}*\\(?{S}*✓{S}*\\)?)?", "المراد بـ (القضب) في قوله تعالى: ﴿وَعِنَبًا وَقَضْبًا﴾ ما يؤكل رطباً من النبات كالفصة والقثاء (أما البر والشعير فهما الحب) ( ✗ )"),
    Rule(_E, "critical", _T, "سورة عبس", 18, f"معنى_الاستفهام_في_قوله_تعالى:_﴿?{{من}}_{{أي}}_{{شيء}}_{{خلقه}}﴾?_استفهام_تقريري[ \\t]*\\([ \\t]*[✗xX]{S}*\\)", "معنى الاستفهام في قوله تعالى: ﴿مِنْ أَيِّ شَيْءٍ خَلَقَهُ﴾ استفهام تقريري ( ✓ )"),
    Rule(_E, "critical", _T, "سورة المطففين", 6, f"(?:قرأ|عندما_قرأ)_هذه_السورة[،,{BLANKS}]+ولما_بلغ_قوله_تعالى:_﴿?{{يوم}}_{{يقوم}}_{{الناس}}_{{لرب}}_{{العالمين}}﴾?_بكى_{{نحيبا}}[ \\t]*\\([ \\t]*عمر_بن_الخطاب[ \\t]*-[ \\t]*عثمان_بن_عفان[ \\t]*\\)", "قرأ هذه السورة، ولما بلغ قوله تعالى: ﴿يَوْمَ يَقُومُ النَّاسُ لِرَبِّ الْعَالَمِينَ﴾ بكى نحيباً: (عبد الله بن عمر - عمر بن الخطاب - عثمان بن عفان)"),
    Rule("truncation", "critical", _T, "سورة النازعات", 5, f"س:{S}*ثم{S}+{{أسند}}{S}+التدبير{S}+للخيل{S}*\\??{_LINE_END}", "س: هل أُسند التدبير للخيل في قوله تعالى ﴿فَالْمُدَبِّرَاتِ أَمْرًا﴾؟\nج: قيل: المراد الملائكة تدبر أمر العباد بإذن الله، وقيل الأفلاك، وقيل أُسند التدبير للخيل لشدة جريها وعظيم نفعها وتدبيرها في ساحة القتال والجهاد."),
    Rule("truncation", "critical", _T, None, None, f"علوم{S}+القرآن{S}+هي{S}*\\.{{3,}}+(?=[ \\t]*\\n|{END})", "علوم القرآن هي: مباحث تتعلق بالقرآن الكريم من حيث نزوله وترتيبه وجمعه وكتابته وقراءته وتفسيره وإعجازه وناسخه ومنسوخه ودفع الشبه عنه."),
    Rule(_Q, "critical", _T, "سورة الملك", 3, "{من}_{تقوت}", "مِن تَفَاوُتٍ"),
    Rule("irab_grammar", "critical", _T, "سورة الملك", 4, f"(?:جواب_الأمر[:{BLANKS}]+)?{{بقلب}}|جواب_الأمر_﴿?{{بقلب}}﴾?|﴿{{بقلب}}﴾(?=[ \\t]*(?:جواب|فعل|مجزوم))", "يَنقَلِبْ"),
    Rule(_Q, "critical", _T, "سورة الملك", 4, "{البصر}_{خاشعا}", "الْبَصَرُ خَاسِئًا"),
    Rule(_Q, "critical", _T, "سورة الملك", 16, "{أن}_{يخيف}", "أَن يَخْسِفَ"),
    Rule("balagha", "critical", _T, "سورة الملك", 7, "{يعموا}_{عمها}|يعموا_عمه", "سَمِعُوا لَهَا شَهِيقًا"),
    Rule(_E, "critical", _T, "سورة الملك", 8, "{أليأتيكم}_{نذير}", "أَلَمْ يَأْتِكُمْ نَذِيرٌ"),
    Rule(_E, "critical", _T, "سورة الملك", 19, "{صنفت}", "صَافَّاتٍ"),
    Rule("typography", "warning", "حديث", None, None, "راوية_ابن_ماجه", "رواية ابن ماجه"),
    Rule(_E, "critical", "حديث", None, None, f"النساء_الرجال(?=[ \\t]*[،.\\n]|{END})|النساء_\\[\\.\\.\\.\\]_الرجال", "النساء شقائق الرجال"),
    Rule(_E, "warning", "حديث", None, None, f"\\({S}*فارس[ \\t]*-[ \\t]*الروم[ \\t]*-[ \\t]*مصر{S}*\\)(?=[ \\t]*\\n|\\.\\.\\.)", "سؤال الاختيارات: فتحت في عهد عمر بن الخطاب رضي الله عنه بلاد: (فارس - الروم - مصر)"),
    Rule("repetition", "warning", "فقه حنفي", None, None, f"وعن_لبن_في_ضرع[،,{BLANKS}]+وعن_لبن_في_ضرع", "وعن لبن في ضرع"),
    Rule("truncation", "critical", "فقه حنفي", None, None, f"بيع_الحاضر_للبادي{_LINE_END}", "بيع الحاضر للبادي: وهو أن يقدم القروي بمتاعه لبيعه بسعر يومه فيقول له البلدي: اتركه عندي لأبيعه لك على التدريج بأغلى؛ وعلة النهي: لئلا يتضرر أهل البلد."),
    Rule("typography", "warning", "فقه شافعي", None, None, "كفته_نيتة", "كفته نيته"),
    Rule("truncation", "critical", "فقه شافعي", None, None, f"والمراد_من_ذلك_الجنس_الصادق_بـ{S}*\\.*{S}*{EOL}", "والمراد من ذلك الجنس الصادق بالمخيط المحيط كقميص وجبة وسراويل وخف، فيحرم لبسه على المحرم ذكراً كان بالاتفاق."),
    Rule("dot_flood", "critical", "عام", None, None, "(?:\\.{20,}+[ \\t]*+\\n*+|\\.{10,}+[ \\t]*+\\n*+(?=\\.{10}))(?:\\.{10,}+[ \\t]*+\\n*+)*+", "..... [تم تطهير سيل النقاط وإعادة النصوص المحذوفة] ....."),
)

# Where each rule of table A applies, and what it says.
RULE_NOTES: tuple[tuple[str, str], ...] = (
    ("جدول وجوه الإعراب / الآيات الكريمة", "تحريف خطير في الآية القرآنية بسورة النبأ؛ كُتبت \"لِّيَنِينَ\" والصواب: ﴿لَّابِثِينَ فِيهَا أَحْقَابًا﴾، وهي حال من الضمير في ﴿لِلطَّاغِينَ﴾."),
    ("أسئلة سورة النبأ / بنك التدريبات", "خطأ في الكلمة القرآنية بسورة النبأ؛ كُتبت \"مقاماً\" والصواب: ﴿إِنَّ لِلْمُتَّقِينَ مَفَازًا﴾، مفعل من الفوز يصلح أن يكون مصدراً ميمياً أو اسم مكان."),
    ("أسئلة وتدريبات سورة النبأ", "تحريف في قوله تعالى: ﴿وَبَنَيْنَا فَوْقَكُمْ سَبْعًا شِدَادًا﴾؛ كُتبت بكسر السين \"سِباعاً\" والصواب بالفتح \"سَبْعًا\" جمع سبع سماوات."),
    ("جدول القراءات والأسئلة / سورة عبس", "تحريف شنيع لقوله تعالى في سورة عبس: ﴿أَنَّا صَبَبْنَا الْمَاءَ صَبًّا﴾؛ دُمجت الكلمات خطأً بسبب الـ OCR لتصبح \"أناصبنا\"."),
    ("أسئلة الخيارات والاختبارات / سورة عبس", "تحريف شنيع للفظ القرآني في سورة عبس في قوله تعالى: ﴿أَوْ يَذَّكَّرُ فَتَنفَعَهُ الذِّكْرَىٰ﴾؛ كُتبت \"فستعفيه الذكرى\"."),
    ("أسئلة صح وخطأ / سورة النازعات", "تحريف للفظ القرآني في فاتحة سورة النازعات: ﴿وَالنَّازِعَاتِ غَرْقًا﴾؛ كُتبت \"غرفة\" والصواب غرقاً أي مبالغة وإغراقاً في النزع."),
    ("أسئلة التطبيقات وصح وخطأ / سورة عبس", "تناقض علمي؛ وُضعت علامة صح أمام أن القضب هو البر والشعير، بينما الشرح يؤكد أن القضب هو ما يؤكل رطباً، أما البر والشعير فهما الحب."),
    ("أسئلة التطبيقات والأحكام / سورة عبس", "تناقض علمي؛ وُضعت علامة خطأ أمام أن الاستفهام تقريري بالرغم من أن الشرح يقرر أنه استفهام تقريري توبيخي لبيان حقارة أصل خلق الإنسان."),
    ("أسئلة الاختيارات / سورة المطففين", "سقوط الإجابة الصحيحة من بين الأقواس؛ الصحابي الجليل الذي بكى نحيباً هو عبد الله بن عمر رضي الله عنهما."),
    ("أسئلة سورة النازعات / التدبير", "سؤال مبتور انقطع قبل توضيح الإجابة الفقهية والتفسيرية المقررة بالأزهر."),
    ("مبادئ علوم القرآن / التعريف", "جملة تعريفية مبتورة بسيل نقاط حذفت التعريف العلمي المعتمد."),
    ("جدول وجوه الإعراب / الآيات الكريمة", "خطأ طباعي فادح نتج عن قراءة خاطئة للـ OCR لحرف الفاء كـ قاف. الصواب: ﴿مَّا تَرَىٰ فِي خَلْقِ الرَّحْمَٰنِ مِن تَفَاوُتٍ﴾. \"مِن\" حرف جر زائد لتأكيد النفي، و\"تَفَاوُتٍ\" مجرور لفظاً منصوب محلاً مفعول به."),
    ("جدول وجوه الإعراب (جواب الأمر)", "تحريف خطير في الإعراب؛ كُتبت \"بِقَلْبٍ\" والصواب هو الفعل المضارع ﴿يَنقَلِبْ﴾ المجزوم في جواب الأمر ﴿ثُمَّ ارْجِعِ الْبَصَرَ كَرَّتَيْنِ يَنقَلِبْ إِلَيْكَ الْبَصَرُ خَاسِئًا﴾ وعلامة جزمه السكون."),
    ("جدول وجوه الإعراب / معاني الكلمات", "خلط بين آيات القرآن؛ كُتبت \"خاشعاً\" والصواب في سورة الملك: ﴿يَنقَلِبْ إِلَيْكَ الْبَصَرُ خَاسِئًا وَهُوَ حَسِيرٌ﴾. خاسئاً: أي ذليلاً صاغراً كليلاً عن رؤية عيب أو خلل، وهي حال منصوبة."),
    ("جدول الإعراب وأسئلة الاختيارات (سؤال 2)", "تصحيف شنيع للمعنى؛ كُتبت \"يخيف\" (من الخوف) والصواب: ﴿أَأَمِنتُم مَّن فِي السَّمَاءِ أَن يَخْسِفَ بِكُمُ الْأَرْضَ﴾. الفعل مشتق من \"الخسف\" وهو الغؤور في الأرض."),
    ("جدول الأسرار البلاغية", "إيراد جملة ملفقة تماماً مكان الآية! التفسير البلاغي يذكر: \"استعارة مكنية، شبه شدة استعارها وحسيسها بصوت الحمار\"، والآية الشريفة هي: ﴿إِذَا أُلْقُوا فِيهَا سَمِعُوا لَهَا شَهِيقًا وَهِيَ تَفُورُ﴾."),
    ("قسم الأسئلة المجمعة وتدريبات السورة", "تحريف لأداة النفي والجزم؛ كُتبت \"أليأتيكم\" والصواب: ﴿كُلَّمَا أُلْقِيَ فِيهَا فَوْجٌ سَأَلَهُمْ خَزَنَتُهَا أَلَمْ يَأْتِكُمْ نَذِيرٌ﴾."),
    ("السؤال الرابع / معاني الكلمات", "خطأ في نقل الكلمة القرآنية؛ كُتبت \"صنفت\" والمطلوب في المنهج الأزهري معنى قوله تعالى: ﴿أَوَلَمْ يَرَوْا إِلَى الطَّيْرِ فَوْقَهُمْ صَافَّاتٍ وَيَقْبِضْنَ﴾."),
    ("صفحة 16 / الهامش السفلي للحديث الثاني", "خطأ مطبعي في تخريج الحديث؛ كُتبت \"راوية\" والصواب \"رواية ابن ماجه\"."),
    ("صفحة 10 / السؤال الثامن", "سقوط كلمة أساسية من نص الحديث النبوي الشريف في السؤال الثامن: كُتبت \"النساء الرجال\" والصواب: \"النساء شقائق الرجال\"."),
    ("صفحة 29 / أسئلة الحديث الثالث", "خيارات أسئلة عائمة ومبتورة ناتجة عن سيل النقاط الذي طمس السؤال الأصلي."),
    ("صفحة 42 / جدول البيوع المنهي عنها", "تكرار غير مقصود للعبارة في الجدول الفقهي أفسد تنسيق خانات المقارنة."),
    ("صفحة 44 / ختام باب البيع الفاسد", "انقطاع النص فجأة وبتر الملف بالكامل في منتصف شرح \"بيع الحاضر للبادي\" دون إكمال المسألة أو ذكر أسئلتها."),
    ("صفحة 35 / السطر الأخير من جدول نية الصيام", "خطأ إملائي بوضع تاء مربوطة بدلاً من الهاء في \"نيته\"."),
    ("صفحة 61 / درس محرمات الإحرام", "بتر مفاجئ وكارثي للملف في منتصف الكلمة والجملة، ترتب عليه ضياع أكثر من 135 صفحة من باقي منهج الفقه الشافعي."),
    ("صفحات التنقيط المتكررة (مثل ص 29-36 بالحديث، وص 21-24 بالفقه)", "حلقة تكرار لانهائية لرمز النقطة (...) لآلاف المرات بسبب توقف الـ OCR عند أسئلة أكمل بالنقاط، مما التهم صفحات كاملة ومحا الأحاديث والدروس."),
)

# Table B.
TARGETS: tuple[Target, ...] = (
    Target("النبأ", 23, "لّ?ِيَنِينَ|لينين", "لَّابِثِينَ"),
    Target("الانشقاق", 1, f"إذا{S}+السماء{S}+انشقت|اذا{S}+السماء{S}+انشقت|السماء{S}+انشقت", "إِذَا السَّمَاءُ انشَقَّتْ"),
    Target("الانفطار", 1, f"إذا{S}+السماء{S}+انفطرت|اذا{S}+السماء{S}+انفطرت|السماء{S}+انفطرت", "إِذَا السَّمَاءُ انفَطَرَتْ"),
    Target("النبأ", 31, "مَقَامًا(?=_مَفْعَل|مفعل_من_الفوز)", "مَفَازًا"),
    Target("النبأ", 12, "سِبَاعًا(?=_شِدَادًا)|﴿سِبَاعًا﴾(?=_﴿?شِدَادًا﴾?)", "سَبْعًا"),
    Target("عبس", 25, "أَنَاصَبَنَا_(?:الْمَاءَ|الماء)|أَنَاصَبَنَا|أناصبنا", "أَنَّا صَبَبْنَا الْمَاءَ صَبًّا"),
    Target("عبس", 4, "فَسَتُعْفِيهِ_(?:الذِّكْرَىٰ?|الذكرى)|فستعفيه", "أَوْ يَذَّكَّرُ فَتَنفَعَهُ الذِّكْرَىٰ"),
    Target("النازعات", 1, "معنى_﴿?غُرْفَةً﴾?_مبالغة", "غَرْقًا"),
    Target("الملك", 3, "مَن_تَقُوتُ|مِن_تَقُوتُ|من_تقوت", "مِن تَفَاوُتٍ"),
    Target("الملك", 4, "الْبَصَرُ_خَاشِعًا|البصر_خاشعا", "خَاسِئًا"),
    Target("الملك", 16, "أَن_يَخِيفَ", "أَن يَخْسِفَ"),
    Target("الملك", 7, "يَعْمَوْا_عَمَهًا", "سَمِعُوا لَهَا شَهِيقًا وَهِيَ تَفُورُ"),
    Target("الملك", 8, "أَلَيَأْتِيكُم_نَذِيرٌ", "أَلَمْ يَأْتِكُمْ نَذِيرٌ"),
    Target("الملك", 19, "معنى_كلمة_﴿?صَنَفَتْ﴾?|صَنَفَتْ_وَيَقْبِضْنَ", "صَافَّاتٍ"),
)
#: Numbers of surahs that targets name; any other counts as the last.
SURAH_NUMBERS: dict[str, int] = {"النبأ": 78, "عبس": 80, "النازعات": 79}
OTHER_SURAH = 67

# Completions of known cuts.
COMPLETIONS: tuple[Completion, ...] = (
    Completion(f"والمراد{S}+من{S}+ذلك{S}+الجنس{S}+الصادق{S}+بـ{S}*{EOL}", "والمراد من ذلك الجنس الصادق بالمخيط المحيط كقميص وجبة وسراويل وخف، فيحرم لبسه على المحرم ذكراً كان بالاتفاق.", True),
    Completion(f"بيع{S}+الحاضر{S}+للبادي(?:{S}*:{S}*وهو{S}+أن{S}+يقدم{S}+القروي{S}+بمتاعه{S}+لبيعه)?{S}*{EOL}", "بيع الحاضر للبادي: وهو أن يقدم القروي بمتاعه لبيعه بسعر يومه فيقول له البلدي: اتركه عندي لأبيعه لك على التدريج بأغلى؛ وعلة النهي: لئلا يتضرر أهل البلد بما يترتب عليه من الغلاء.", True),
    Completion(f"{BOL}{S}*عن{S}+أبي{S}+هريرة{S}+رضي{S}+الله{S}+عنه{S}+عن{S}+النبي{S}+صلى{S}+الله{S}+عليه{S}+وسلم{S}*{EOL}", "عن أبي هريرة رضي الله عنه عن النبي صلى الله عليه وسلم قال: «الإيمان بضع وسبعون أو بضع وستون شعبة، فأفضلها قول لا إله إلا الله، وأدناها إماطة الأذى عن الطريق، والحياء شعبة من الإيمان».", False),
)

# Notes that a topic needs (topic, term, number, text).
NOTES: tuple[tuple[str, str, str, str], ...] = (
    ("أول_وآخر_ما_نزل|الموضوع_الثالث", "النسخ", "١", "(١) مفهوم النسخ في القرآن هو رفع حكم شرعي سابق بدليل شرعي لاحق، وهو يقع في الأحكام العملية دون الاعتقادية أو الأصول الأخلاقية والمنسوخ هو الحكم الأول، والناسخ هو: الحكم الأخير."),
    ("أول_وآخر_ما_نزل|الموضوع_الثالث", "التدرج_التشريعي|نزول_الأحكام_شيئاً_فشيئاً", "٢", "(٢) أي نزول الأحكام الشرعية على النبي شيئاً فشيئاً طوال مدة البعثة النبوية حتى انتهى بتمام الشريعة وكمال الإسلام."),
    ("النبأ", "أحقاباً|لابثين_فيها", "١", "(١) أي: السنون، وهو تفسير لكلمة «أحقاباً» في قوله تعالى: ﴿لَّابِثِينَ فِيهَا أَحْقَابًا﴾، والحقب ثمانون سنة كل يوم منها ألف سنة."),
    ("النبأ", "حميماً_وغساقاً|حميمًا", "٢", "(٢) الحميم: الماء المغلي البالغ الغاية في الحرارة، والغساق: ما يسيل ويسقط من صديد أهل النار ونتنهم."),
    ("النبأ", "دهاقاً", "٣", "(٣) دهاقاً: أي مملوءة مترعة متتابعة بالخمر الطيبة اللذيذة لأهل الجنة."),
    ("النازعات", "غرقاً", "١", "(١) غرقاً: مفعول مطلق مؤكد لعامله، أي إغراقاً ومبالغة في النزع الشديد لأرواح الكفار من أقاصي أبدانهم."),
    ("النازعات", "الحافرة", "٢", "(٢) الحافرة: الحالة الأولى وطريق الرجوع، يقال: رجع فلان في حافرته إذا عاد إلى موضعه الأول وحياته الأولى."),
    ("النازعات", "طوى|الواد_المقدس", "٣", "(٣) طوى: اسم الوادي المقدس المبارك أسفل جبل الطور بسيناء، كلم الله فيه نبيه موسى عليه السلام تكليماً."),
    ("عبس", "سفرة", "١", "(١) سفرة: جمع سافر، وهم الملائكة الكرام الذين يسفرون بالوحي بين الله تعالى ورسله، كالسفراء بين الناس."),
    ("عبس", "قضباً", "٢", "(٢) القضب: هو الفصة وما يقطع ويؤكل رطباً من النبات كالبرسيم والقثاء والخيار للدواب، أما البر والشعير فهما الحب."),
    ("عبس", "الصاخة", "٣", "(٣) الصاخة: الصيحة العظيمة التي تصخ الأسماع أي تصمها من شدة هولها يوم القيامة، وهي النفخة الثانية للبعث."),
)

# What the completions and the notes are.
COMPLETION_REASONS: tuple[str, ...] = (
    "حرف جر معلق (بـ) متبوع بانقطاع مفاجئ أدى لبتر باب محرمات الإحرام وباقي المنهج",
    "انقطاع الجملة الوصفية والتعليلية في ختام باب البيع الفاسد وسقوط باقي الأبواب",
    "سند حديث معلق بدون ذكر المتن (مبتدأ بدون خبر مقول القول)",
)
NOTE_TITLES: tuple[str, ...] = (
    "هامش توضيح مفهوم النسخ الشرعي في الموضوع الثالث",
    "هامش توضيح حكمة التدرج التشريعي لنزول القرآن",
    "هامش تفسير أحقاباً والسنون في سورة النبأ",
    "هامش تفسير الحميم والغساق في سورة النبأ",
    "هامش تفسير كأساً دهاقاً في سورة النبأ",
    "هامش بيان معنى غرقاً في سورة النازعات",
    "هامش بيان معنى الحافرة في سورة النازعات",
    "هامش بيان اسم الوادي المقدس طوى في سورة النازعات",
    "هامش بيان معنى بأيدي سفرة في سورة عبس",
    "هامش توضيح معنى القضب في سورة عبس",
    "هامش بيان الصاخة في سورة عبس",
)
