"""Text normalisation, cleaning and classification as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parchwork.functions.dialect import ARABIC, BLANKS, BOL, EDGE, END, EOL, HARAKAT, LATIN, NOT_S, S, Step, count, rewrite, round_half_up, trim

MARKER = "---PAGE_BREAK---"

# The cleaning steps, in the order in which they apply.
MARKERS = [Step(f"{S}*+{MARKER}{S}*+", f"\n\n{MARKER}\n\n")]
BREAKS = [Step(f"(?iu)<br{S}*/?>", "\n"), Step("(?iu)</br>", "\n"), Step("(?iu)&nbsp;", " ")]
#: Only tags of the list go; the character after the name is looked at, so that img and iframe stay.
TAGS = [Step(f"(?iu)</?(?:span|div|p|b|strong|em|i)(?=[{BLANKS}/>])[^>]*>", "", sql=f"(?i)</?(?:span|div|p|b|strong|em|i)(?:>|[{BLANKS}/][^>]*>)")]
#: Without a boundary: any tag that begins with one of these letters goes too.
TAGS_UNBOUND = [Step("(?iu)</?(?:span|div|p|b|strong|em|i)[^>]*>", "")]
PAGE_NUMBERS = [Step(f"(?iu){BOL}[ \\t]*+(?:الصفحة|Page)?[ \\t]*+[0-9]++[ \\t]*+{EOL}", "", sql="(?im)^[ \\t]*(?:الصفحة|Page)?[ \\t]*[0-9]+[ \\t]*$")]
STRAY_NOTE = f"\\[\\^[{BLANKS}*]*\\]"
ARTIFACTS = [Step("\\\\text\\{([^\\}]+)\\}", "$1"), Step("\u200b", "")]
SPACING = [Step(f"[ \\t]++{EOL}", "", sql="(?m)[ \\t]+$"), Step("\\n[ \\t]++\\n", "\n\n"), Step("\\n{3,}+", "\n\n")]
RULES = [Step(f"{BOL}-{{2,}}+{EOL}", "---", sql="(?m)^-{2,}$"), Step("\\n---\\n---\\n", "\n---\n")]
DOTS_SHORT = [Step("\\.{6,}+", "....."), Step(f"{BOL}[ \\t]*+(?:\\.[ \\t]*+){{5,}}+{EOL}", ".....", sql="(?m)^[ \\t]*(?:\\.[ \\t]*){5,}$")]
DOTS = [*DOTS_SHORT, Step("(?:\\n[ \\t]*+\\.\\.\\.\\.\\.[ \\t]*+){2,}+", "\n.....\n", sql="(?:\\n[ \\t]*\\.\\.\\.\\.\\.[ \\t]*){2,}")]
BRACKETS = [Step("﴿{2,}+", "﴿"), Step("﴾{2,}+", "﴾")]
NESTED_BRACKETS = [*BRACKETS, Step(f"﴿{S}*+﴿([^﴾]+)﴾{S}*+﴾", "﴿$1﴾")]
#: Curriculum corrections of the recognition route (table C).
CURRICULUM = [
    Step(f"وعن[ \\t]+لبن[ \\t]+في[ \\t]+ضرع[،,{BLANKS}]+وعن[ \\t]+لبن[ \\t]+في[ \\t]+ضرع", "وعن لبن في ضرع"),
    Step("راوية[ \\t]+ابن[ \\t]+ماجه", "رواية ابن ماجه"),
    Step(f"النساء[ \\t]+الرجال(?=[ \\t]*[،.\\n]|{END})", "النساء شقائق الرجال", sql="النساء[ \\t]+الرجال([ \\t]*[،.\\n]|$)", sql_put="النساء شقائق الرجال\\1"),
    Step("كفته[ \\t]+نيتة", "كفته نيته"),
    Step("مَن[ \\t]+تَقُوتُ|مِن[ \\t]+تَقُوتُ", "﴿مِن تَفَاوُتٍ﴾"),
    Step(f"جواب[ \\t]+الأمر[:{BLANKS}]+﴿?بِقَلْبٍ﴾?", "جواب الأمر: ﴿يَنقَلِبْ﴾"),
    Step("الْبَصَرُ[ \\t]+خَاشِعًا|الْبَصَرُ[ \\t]+خاشعا", "الْبَصَرُ خَاسِئًا"),
    Step("أَن[ \\t]+يَخِيفَ", "أَن يَخْسِفَ"),
    Step("يَعْمَوْا[ \\t]+عَمَهًا", "سَمِعُوا لَهَا شَهِيقًا"),
    Step("أَلَيَأْتِيكُم[ \\t]+نَذِيرٌ", "أَلَمْ يَأْتِكُمْ نَذِيرٌ"),
    Step("معنى[ \\t]+كلمة[ \\t]+﴿?صَنَفَتْ﴾?", "معنى كلمة ﴿صَافَّاتٍ﴾"),
    Step("فِي[ \\t]+مَنَاكِلِهَا", "فِي مَنَاكِبِهَا"),
    Step("تَمَيَّزُ[ \\t]+مِنَ[ \\t]+الْفَيْضِ", "تَمَيَّزُ مِنَ الْغَيْظِ"),
    Step("فَصُحْقًا", "فَسُحْقًا"),
    *BRACKETS,
]
PLAIN_P1 = [
    Step(f"{BOL}---{S}*{EOL}", "\n------------------------\n", sql=f"(?m)^---{S}*$"),
    ARTIFACTS[0],
    Step(f"{BOL}#++{S}++", "", sql=f"(?m)^#+{S}+"),
    Step("\\*\\*([^*]+)\\*\\*", "$1"), Step("\\*([^*]+)\\*", "$1"), Step("_([^_]+)_", "$1"), Step("`([^`]+)`", "$1"),
    Step("\\$\\$?([^$]+)\\$\\$?", "$1"), Step("\\[([^\\]]+)\\]\\([^)]+\\)", "$1"),
    Step(f"{BOL}{S}*+[-*+]{S}++", "• ", sql=f"(?m)^{S}*[-*+]{S}+"),
]
PLAIN_P3 = [Step(f"{BOL}#++{S}++", "", sql=f"(?m)^#+{S}+")]
PLAIN_P4 = [Step(f"#++{S}++", "", sql=f"#+{S}+")]
#: Ornaments, diacritics, tatweel, letter forms and punctuation of the search key.
KEY = [
    Step("[\u06dd\u06de\u06e9\u06d6-\u06ed\u064b-\u065f\u0670\u0640]", ""),
    Step("[أإآٱ]", "ا"), Step("ى", "ي"), Step("ة", "ه"),
    Step('[.,;:؛،؟?()﴿﴾«»"\\[\\]{}!]', " "), Step(f"{S}+", " "),
]
LINE_PUNCTUATION = [
    Step(f"({ARABIC}+[^\\n?]*)\\?+{END}", "$1؟", sql=f"({ARABIC}+[^\\n?]*)\\?+$"),
    Step("([\u0600-\u06ff]),[ \\t]+", "$1، "),
    Step('([^\\\\])"([^"\\n]+)"', "$1«$2»"),
    Step(f"\\A({S}*[0-9\u0660-\u0669]+[.)])([^{BLANKS}0-9])", "$1 $2", sql=f"^({S}*[0-9\u0660-\u0669]+[.)])([^{BLANKS}0-9])"),
    Step(f"\\A({S}*[أ-ي][.\\-)])({NOT_S})", "$1 $2", sql=f"^({S}*[أ-ي][.\\-)])({NOT_S})"),
    Step(f"\\A({S}*\\([0-9\u0660-\u0669أ-ي]+\\))({NOT_S})", "$1 $2", sql=f"^({S}*\\([0-9\u0660-\u0669أ-ي]+\\))({NOT_S})"),
]
#: File-name endings: of any file, PDF, Word, download, and the page range that a chunk's name carries.
ANY_SUFFIX, PDF_SUFFIX, DOCX_SUFFIX = Step(f"\\.[^/.]+{END}", "", sql="\\.[^/.]+$"), Step(f"(?iu)\\.pdf{END}", "", sql="(?i)\\.pdf$"), Step(f"(?iu)\\.docx{END}", "", sql="(?i)\\.docx$")
DOWNLOAD_SUFFIX = [Step(f"(?iu)\\.(?:pdf|docx|md|txt){END}", "", sql="(?i)\\.(?:pdf|docx|md|txt)$"), Step("_", " ")]
PAGE_RANGE = Step(f"(?iu){S}*\\(pages{S}*[0-9]+-[0-9]+\\)", "")
ORIGIN = "<!--ext:direct-->"
SPINE = [Step("\\[\\\\u064B-\\\\u0652\\\\u0670\\]\\*?", ""), Step("[\u064b-\u0652\u0670\u065f]", "")]


# Counts and predicates -------------------------------------------------------------------------------------------
def arabic_count(text: Column) -> Column:
    return count(text, ARABIC)


def latin_count(text: Column) -> Column:
    return count(text, LATIN)


def has_arabic(text: Column) -> Column:
    return text.rlike(ARABIC)


def has_haraka(text: Column) -> Column:
    return text.rlike("[\u0610-\u065f\u0670]")


def haraka_order_problem(text: Column) -> Column:
    """The first place (from 0) where a shadda is followed by another haraka; null if there is none."""
    at = F.regexp_instr(text, F.lit(f"\u0651{HARAKAT}"))
    return F.when(at > 0, at - 1)


def is_rtl(text: Column) -> Column:
    """Arabic letters, and at least three to ten Latin ones."""
    a, n = arabic_count(text), latin_count(text)
    return (a > 0) & (a >= n * 0.3)


def is_rtl_absolute(text: Column) -> Column:
    return count(text, "[\u0600-\u06ff]") > 20


def is_rtl_preferred(text: Column, preference: Column) -> Column:
    return (preference == "rtl") | ((preference == "auto") & (arabic_count(text) >= latin_count(text) * 0.4))


def language_label(text: Column, preference: Column) -> Column:
    mixed = (arabic_count(text) > 10) & (latin_count(text) > 10)
    return F.when(mixed, "Arabic & English").when(is_rtl_preferred(text, preference), "Arabic").otherwise("English")


def has_math(text: Column) -> Column:
    return text.rlike("\\$|\\\\frac|\\\\sqrt|\\\\vec")


def has_table(text: Column) -> Column:
    return text.contains("|")


def title(text: Column, file_name: Column) -> Column:
    """The first heading, without marks, if it has 3 to 79 characters; else the file's base name."""
    head = trim(F.regexp_replace(F.regexp_extract(text, f"{BOL}#+{S}+([^\\n\\r\u2028\u2029]+)", 1), "[*_#`]", ""))
    return F.when((F.length(head) > 2) & (F.length(head) < 80), head).otherwise(rewrite(F.coalesce(file_name, F.lit("document.pdf")), [ANY_SUFFIX, PAGE_RANGE]))


def is_table_line(line: Column) -> Column:
    t = trim(line)
    return (t.startswith("|") & (F.length(t) > 1) & F.substring(t, 2, 1 << 30).contains("|")) | ((count(t, "\\|") >= 2) & ~t.startswith("#"))


NUMBERED = f"\\A(?:[0-9\u0660-\u0669]+|[أ-ي]{EDGE}|[a-zA-Z]{EDGE}|\\([^)]+\\))(?:[.\\-)]{S}+|{S}+-{S}+)[^\\n\\r\u2028\u2029]*{END}"


def is_list_line(line: Column) -> Column:
    t = trim(line)
    return t.rlike(NUMBERED) | t.rlike(f"\\A[-*+]{S}+")


def has_dot_flood(text: Column) -> Column:
    return text.rlike("\\.{30,}+|\\.{12,}+[ \\t]*+\\.{12,}+|\\.{24,}+")


def has_truncation(text: Column) -> Column:
    def lacks(file: str, part: str) -> Column:
        return text.contains(file) & ~text.contains(part)

    return text.contains("الصادق بـ") | lacks("حديث_2ث", "الحديث السادس عشر") | lacks("فقة_حنفى", "باب الإقالة") | lacks("فقة_شافعى", "كتاب البيوع")


def subject(text: Column) -> Column:
    def any_of(*words: str) -> Column:
        found = text.contains(words[0])
        for w in words[1:]:
            found = found | text.contains(w)
        return found

    return (
        F.when(any_of("سورة الملك", "تفسير"), "تفسير سورة الملك").when(any_of("حديث", "الحديث الأول"), "الحديث الشريف")
        .when(any_of("حنفى", "القدوري", "الإقالة"), "الفقه الحنفي").when(any_of("شافعى", "محرمات الإحرام"), "الفقه الشافعي").otherwise("أزهري عام")
    )


# Normalisation ----------------------------------------------------------------------------------------------------
def search_key(text: Column) -> Column:
    return trim(rewrite(F.coalesce(text, F.lit("")), KEY))


def number_stray_notes(text: Column) -> Column:
    """Notes without a number get the next one, from 1."""
    parts = F.split(text, STRAY_NOTE, -1)
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit("[^"), i.cast("string"), F.lit("]"), p))), "")


def clean_markdown(text: Column) -> Column:
    text = rewrite(text, [*MARKERS, *BREAKS, *TAGS, *PAGE_NUMBERS])
    return trim(rewrite(number_stray_notes(text), [*ARTIFACTS, *SPACING, *RULES, *DOTS, *CURRICULUM]))


def sanitize_chunk(text: Column) -> Column:
    return rewrite(text, [*DOTS, *BREAKS, *TAGS])


def plain_text(text: Column) -> Column:
    return trim(rewrite(text, PLAIN_P1))


def line_punctuation(line: Column) -> Column:
    return F.when(is_rtl(line), rewrite(line, LINE_PUNCTUATION)).otherwise(line)


def mark_origin(text: Column) -> Column:
    return F.when((text == "") | text.startswith(ORIGIN), text).otherwise(F.concat(F.lit(ORIGIN + "\n"), text))


def has_origin(text: Column) -> Column:
    return text.startswith(ORIGIN)


def strip_origin(text: Column) -> Column:
    """Without the lines that are the mark, and without the gaps that they leave."""
    lines = F.array_join(F.filter(F.split(text, "\n", -1), lambda x: trim(x) != ORIGIN), "\n")
    return F.when(text.contains(ORIGIN), F.regexp_replace(F.regexp_replace(lines, "\n{3,}+", "\n\n"), "\\A\n++", "")).otherwise(text)


def unwrap_answer(text: Column) -> Column:
    """Markdown from a model's answer: out of a code fence, and out of JSON's field of that name."""
    t = trim(text)
    fence_end = f"```{S}*+{END}"
    fenced = trim(F.regexp_replace(F.regexp_replace(t, f"(?iu)\\A```markdown{S}*+", ""), fence_end, ""))
    inner = trim(F.regexp_replace(F.regexp_replace(t, f"(?iu)\\A```[a-z]*+{S}*+", ""), fence_end, ""))
    return (
        F.when(t.startswith("```markdown"), fenced).when(t.startswith("```") & t.endswith("```"), F.coalesce(F.get_json_object(inner, "$.markdown"), inner))
        .when(t.startswith("{") & t.endswith("}"), F.coalesce(F.get_json_object(t, "$.markdown"), t)).otherwise(t)
    )


def data_url_payload(text: Column) -> Column:
    return F.regexp_replace(text, "\\Adata:[^;,]*(?:;[^,]*)?,", "")


def data_url_mime(text: Column) -> Column:
    return F.when(text.rlike("\\Adata:[^;,]+"), F.regexp_extract(text, "\\Adata:([^;,]+)", 1))


def format_bytes(n: Column) -> Column:
    """1 decimal at most, from B to TB; nothing, negative and not finite give 0 B."""
    n = n.cast("double")
    k = F.least(F.greatest(F.floor(F.ln(n) / F.ln(F.lit(1024.0))), F.lit(0)), F.lit(4)).cast("int")
    shown = F.regexp_replace(F.format_string("%.1f", n / F.pow(F.lit(1024.0), k)), "\\.0\\z", "")
    good = n.isNotNull() & ~F.isnan(n) & (n > 0) & (n < float("inf"))
    return F.when(good, F.concat_ws(" ", shown, F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB", "TB"))), k + 1))).otherwise("0 B")


def format_duration(seconds: Column) -> Column:
    seconds = seconds.cast("double")
    minutes, rest = F.floor(seconds / 60), round_half_up(seconds - F.floor(seconds / 60) * 60)
    def said(name: Column, alone: Column) -> Column:
        return F.when(rest > 0, F.concat(name, F.lit(" و "), rest.cast("string"), F.lit(" ثانية"))).otherwise(alone)

    m, about = minutes.cast("string"), F.lit("حوالي ")
    few, many = F.concat(about, m, F.lit(" دقائق")), F.concat(about, m, F.lit(" دقيقة"))
    return (
        F.when(seconds <= 0, "لحظات قليلة...").when(seconds < 6, "أقل من 5 ثوانٍ").when(seconds < 60, F.concat(about, round_half_up(seconds).cast("string"), F.lit(" ثانية")))
        .when(minutes == 1, said(F.lit("حوالي دقيقة"), F.lit("حوالي دقيقة واحدة"))).when(minutes == 2, said(F.lit("حوالي دقيقتين"), F.lit("حوالي دقيقتين")))
        .when(minutes <= 10, said(few, few)).when(minutes < 60, said(many, many))
        .otherwise(F.concat(about, F.floor(minutes / 60).cast("string"), F.lit(" ساعة و "), (minutes % 60).cast("string"), F.lit(" دقيقة")))
    )


# Guards: a rewrite that loses too much is not taken ------------------------------------------------------------------------
def pages_in(text: Column) -> Column:
    return count(text, MARKER)


def guard_client(before: Column, after: Column) -> Column:
    return F.when((F.length(before) > 5000) & (F.length(after) < F.length(before) * 0.8), before).otherwise(after)


def guard_server(before: Column, after: Column) -> Column:
    return F.when((F.length(before) > 8000) & (F.length(after) < F.length(before) * 0.75), before).otherwise(after)


def guard_pages(before: Column, after: Column) -> Column:
    return F.when(pages_in(before) != pages_in(after), before).otherwise(after)


def file_kind(name: Column, mime: Column) -> Column:
    n, m = F.lower(name), F.coalesce(F.lower(mime), F.lit(""))
    return (
        F.when(n.endswith(".pdf") | (m == "application/pdf"), "pdf").when(m.startswith("image/") | n.rlike("\\.(?:png|jpe?g|bmp|webp|gif|svg)\\z"), "image")
        .when(n.rlike("\\.docx?\\z") | m.contains("word") | m.contains("officedocument"), "word")
    )


def is_image_file(name: Column, mime: Column) -> Column:
    return F.coalesce(F.lower(mime), F.lit("")).startswith("image/") | F.lower(name).rlike("\\.(?:png|jpe?g|bmp|webp|gif|tiff?)\\z")
