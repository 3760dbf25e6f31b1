"""The structural auditor: notes, headings, numbering, repetition and completion (STR), block kinds (SNK-1a, 1b)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchwork.functions.dialect import BLANKS, BOL, EDGE, END, EOL, S, Step, rewrite, trim
from parchwork.functions.text import MARKER, has_arabic, is_table_line

# Particles that leave a sentence open, patterns of headings, phrases of running headers, corrections and messages.
PARTICLES = f"(?:بـ|في|من|إلى|عن|على|مع|أن|لأن|حيث{S}+إن|التي|الذي|الذين|بما{S}+فيها|وهو{S}+أن|كـ){S}*(?:\\.*|…){S}*{END}"
NOTE_BLOCK = f"---[ \\t]*\\n+{S}*\\*\\*الهوامش{S}+والحواشي|\\[\\^[0-9]+\\]:"
DISPLACED = f"(?:\\A|\\n)[ \\t]*(?:\\([١-٩1-9]\\)|\\[\\^[0-9]+\\])[ \\t]*(?:(?:أي|هو|وهو|يقصد|المراد|أخرجه|رواه|تفسير)[:{BLANKS}]|مفهوم{S}+النسخ|أي{S}+نزول)[^\\n]+"
ORDINALS = "الأول|الثاني|الثالث|الرابع|الخامس|السادس|السابع|الثامن|التاسع|العاشر"
CHAPTERS = "النبأ|النازعات|عبس|التكوير|الانفطار|المطففين|الانشقاق|البروج|الطارق|الأعلى|الغاشية|الفجر|البلد|الشمس|الليل|الضحى|الشرح|التين|العلق"
HEADINGS: list[tuple[str, str]] = [
    ("##", f"الموضوع{S}+(?:{ORDINALS})[^\\n:]*(?::[^\\n]*)?"), ("##", f"سورة{S}+(?:{CHAPTERS})[^\\n]*"), ("##", f"مبادئ{S}+علوم{S}+القرآن{S}+الكريم"),
    ("##", f"أول{S}+وآخر{S}+ما{S}+نزل{S}+من{S}+القرآن{S}+الكريم"),
    ("###", f"\\*{{0,2}}(?:معاني{S}+المفردات|الإعراب|اللطائف{S}+البلاغية|ما{S}+يستفاد{S}+من{S}+الآيات|الدروس{S}+المستفادة|أسئلة{S}+وتدريبات|بنك{S}+الأسئلة)\\*{{0,2}}"),
    ("###", f"المبحث{S}+(?:الأول|الثاني|الثالث|الرابع)[^\\n]*"),
]
#: Letters that headings begin with.
HEADING_LETTERS = "اأسمبل"
RUNNING = f"(سلاح{S}+الأزهري|مذكرة{S}+التفسير|تفسير{S}+القرآن{S}+الكريم)(?:[ \\t]*\\1)++"
PRINCIPLES = f"مبادئ{S}+علوم{S}+القرآن"
LETTERED = [
    Step(f"(?:\\A|\\n)[ \\t]*[أA]\\.{S}*(تعريف{S}+القرآن)", "\n1. $1"), Step(f"(?:\\A|\\n)[ \\t]*[بB]\\.{S}*(موضوع{S}+علم{S}+القرآن|موضوعه)", "\n2. $1"),
    Step(f"(?:\\A|\\n)[ \\t]*[جC]\\.{S}*(فائدة{S}+معرفة{S}+علوم{S}+القرآن|فائدته)", "\n3. $1"), Step(f"(?:\\A|\\n)[ \\t]*[دD]\\.{S}*(نشأة{S}+علوم{S}+القرآن|أول{S}+من{S}+صنف)", "\n4. $1"),
]
HORSES = f"س:{S}*ثم{S}+أُسند{S}+التدبير{S}+للخيل{S}*\\??(?=[ \\t]*(?:\\n|{END}))"
HORSES_FULL = "س: هل أُسند التدبير للخيل في قوله تعالى ﴿فَالْمُدَبِّرَاتِ أَمْرًا﴾؟\nج: قيل: المراد الملائكة تدبر أمر العباد بإذن الله، وقيل الأفلاك، وقيل أُسند التدبير للخيل لشدة جريها وعظيم نفعها وتدبيرها في ساحة القتال والجهاد."
SCIENCES = f"علوم{S}+القرآن{S}+هي{S}*\\.{{3,}}+(?=[ \\t]*(?:\\n|{END}))"
SCIENCES_FULL = "علوم القرآن هي: مباحث تتعلق بالقرآن الكريم من حيث نزوله وترتيبه وجمعه وكتابته وقراءته وتفسيره وإعجازه وناسخه ومنسوخه ودفع الشبه عنه."
DEFAULT_TITLE = "مذكرة المنهج الأزهري المقرر"
SOUND = "الهيكل التنظيمي للمستند مطابق للأصل وخالٍ من الخلل في العناوين والترقيم والهوامش."
EMPTY = "المستند فارغ."
NOTES_TITLE = "\n\n---\n\n**الهوامش والحواشي التفسيرية والتوضيحية:**\n"
BREAK_COMMENTS = ("<!-- pagebreak -->", "<!-- page_break -->", "<!--pagebreak-->")


def ends_hanging(text: Column) -> Column:
    """The text ends on a particle. No word boundary stands before it, so a word that ends like one counts."""
    return trim(text).rlike(PARTICLES)


def is_curriculum_cut(text: Column) -> Column:
    return (
        (text.contains("حديث_2ث") & ~text.contains("الحديث السادس عشر") & text.contains("....."))
        | (text.contains("فقة_حنفى") & ~text.contains("باب الإكراه") & (F.length(trim(text)) < 8000))
        | (text.contains("فقة_شافعى") & text.contains("الصادق بـ"))
    )


def numbering_gaps(df: DataFrame) -> DataFrame:
    """doc_id, position (from 1 among the numbered lines), before, num: numbers that skip one or two, in documents of three or more."""
    numbers = F.regexp_extract_all("text", F.lit(f"{BOL}[ \\t]*+([0-9]++)\\.[ \\t]++"), F.lit(1))
    rows = df.select("doc_id", F.posexplode(F.transform(numbers, lambda x: x.try_cast("bigint"))).alias("n", "num"), F.size(numbers).alias("many"))
    before = F.lag("num").over(Window.partitionBy("doc_id").orderBy("n"))
    gap = (F.col("many") >= 3) & (F.col("before") > 0) & (F.col("num") > 1) & (F.col("num") > F.col("before") + 1) & (F.col("num") - F.col("before") <= 3)
    return rows.withColumn("before", before).where(gap).select("doc_id", (F.col("n") + 1).alias("position"), "before", "num")


NUMBERED = f"\\A(?:[0-9٠-٩۰-۹]+|[أ-ي]{EDGE}|[a-zA-Z]{EDGE}|\\([^)]+\\))(?:[.\\-)]{S}+|{S}+-{S}+)[^\\n]*{END}"


def kind_of(line: Column) -> Column:
    """The first that holds: code fence, table row, page break, blank, rule, headings, numbered, bullet, quote, paragraph."""
    t = trim(line)
    kind = F.when(t.startswith("```"), "fence").when(is_table_line(line), "table").when(t.contains(MARKER) | F.lower(t).isin(*BREAK_COMMENTS), "page_break")
    kind = kind.when(t == "", "blank").when(t.isin("***", "---", "___"), "rule")
    for k in range(1, 5):
        kind = kind.when(t.startswith("#" * k + " "), f"h{k}")
    return kind.when(t.rlike(NUMBERED), "numbered").when(t.rlike(f"\\A[-*+]{S}+"), "bullet").when(t.startswith("> "), "quote").otherwise("paragraph")


def block_kinds(df: DataFrame) -> DataFrame:
    """doc_id, line_no, line, kind; lines between fences are code."""
    rows = df.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line")).withColumn("kind", kind_of(F.col("line")))
    inside = F.sum((F.col("kind") == "fence").cast("int")).over(Window.partitionBy("doc_id").orderBy("n")) % 2 == 1
    return rows.select("doc_id", (F.col("n") + 1).alias("line_no"), "line", F.when(F.col("kind") == "fence", "fence").when(inside, "code").otherwise(F.col("kind")).alias("kind"))


NOTE_LINE = f"{BOL}\\[\\^([^\\]]+)\\]:{S}*([^\\n\\r  ]*){EOL}"


def footnotes(df: DataFrame) -> DataFrame:
    """doc_id, number (from 1 in order), ref and note: definitions of notes."""
    refs, notes = (F.regexp_extract_all("text", F.lit(NOTE_LINE), F.lit(k)) for k in (1, 2))
    rows = df.select("doc_id", F.posexplode(F.arrays_zip(refs.alias("r"), notes.alias("t"))).alias("n", "x"))
    return rows.select("doc_id", (F.col("n") + 1).alias("number"), F.col("x.r").alias("ref"), trim(F.col("x.t")).alias("note"))


def without_footnotes(text: Column) -> Column:
    return trim(F.regexp_replace(text, NOTE_LINE, ""))


def displaced_notes(text: Column) -> Column:
    """Note lines that stand in the running text. Those in the last 15 % of a text with a block of notes are where they belong."""
    found = F.regexp_extract_all(text, F.lit(DISPLACED), F.lit(0))
    has_block = text.rlike(NOTE_BLOCK)
    return F.filter(F.transform(found, trim), lambda x: ~has_block | (F.position(x, text) - 1 <= F.length(text) * 0.85))


FIRST_LINE = "\\A[ \\t]*([^\\n#\\-*|]{4,60})"


def has_title(text: Column) -> Column:
    return text.rlike(f"{BOL}#[ \\t]+[^\\n#]+")


def title_parts(text: Column, file_name: Column) -> tuple[Column, Column]:
    """The first line, if a title may be made of it (else empty), and the title: the file's name, the first line or a default."""
    first = F.regexp_extract(text, FIRST_LINE, 1)
    named = F.when(file_name.isNotNull(), rewrite(file_name, [Step(f"(?iu)\\.(?:pdf|docx|md|txt){END}", ""), Step("_", " ")])).when(first != "", trim(first)).otherwise(DEFAULT_TITLE)
    return first, named


def add_title(text: Column, file_name: Column) -> Column:
    """A first-level heading, if there is none: the first line itself if it will do, else the file's name, else the first line or a default."""
    first, named = title_parts(text, file_name)
    whole = F.regexp_extract(text, FIRST_LINE, 0)
    in_place = (F.length(first) > 5) & ~first.contains("...")
    titled = F.when(in_place, F.concat(F.lit("# "), trim(first), F.substring(text, F.length(whole) + 1, F.length(text)))).otherwise(F.concat(F.lit("# "), named, F.lit("\n\n"), text))
    return F.when(has_title(text), text).otherwise(titled)


def heading_of(line: Column) -> Column:
    """The number of the first of HEADINGS that a line without a heading's mark fits, or null."""
    fit = F.lit(None).cast("int")
    for k in range(len(HEADINGS) - 1, -1, -1):
        fit = F.when(line.rlike(f"\\A[ \\t]*(?:{HEADINGS[k][1]}){END}"), k).otherwise(fit)
    # one cheap test spares the six
    return F.when(line.rlike(f"\\A[ \\t]*[*{HEADING_LETTERS}]") & ~line.rlike(f"\\A[#{BLANKS}]*#"), fit)


def bare_heading(line: Column) -> Column:
    return F.regexp_replace(trim(line), "\\A\\*++|\\*++\\z", "")


def promote_headings(text: Column) -> Column:
    """Lines that are a topic's name become headings of its level. Works on lines, so an earlier text that holds the same words stays as it is."""
    marks = F.array(*(F.lit(level + " ") for level, _ in HEADINGS))
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.struct(x.alias("line"), heading_of(x).alias("k")))
    return F.array_join(F.transform(lines, lambda x: F.when(x["k"].isNull(), x["line"]).otherwise(F.concat(F.element_at(marks, x["k"] + 1), bare_heading(x["line"])))), "\n")


def is_lettered(text: Column) -> Column:
    return text.rlike(PRINCIPLES) & text.rlike(f"(?:\\A|\\n)[ \\t]*[أA]\\.{S}*تعريف{S}+القرآن")


def renumber_letters(text: Column) -> Column:
    """Lettered main topics get numbers where the subject's principles are treated."""
    return F.when(is_lettered(text), rewrite(text, LETTERED)).otherwise(text)


def collapse_headers(text: Column) -> Column:
    """Running headers said twice are said once."""
    return F.regexp_replace(text, RUNNING, "$1")


def collapse_lines(text: Column) -> Column:
    """Lines of 5 to 50 characters that follow themselves are said once."""
    return F.regexp_replace(text, f"{BOL}([^\\n]{{5,50}})\\n++\\1{EOL}", "$1")


def complete_horses(text: Column) -> Column:
    return F.regexp_replace(text, HORSES, HORSES_FULL.replace("$", "\\$"))


def complete_sciences(text: Column) -> Column:
    return F.regexp_replace(text, SCIENCES, SCIENCES_FULL)


def complete_cuts(text: Column) -> Column:
    return complete_sciences(complete_horses(text))


def repaired(df: DataFrame, column: str = "text", file_name: str = "file_name") -> DataFrame:
    """The auditor's rewrites of `column` in their order, one projection each: title, headings, numbering, repetition, completion. Blank texts stay."""
    t = F.col(column)

    def step(done: Column) -> Column:
        return F.when(trim(t) == "", t).otherwise(done)

    out = df.withColumn(column, step(add_title(t, F.col(file_name))))
    for rewrite_step in (promote_headings, renumber_letters, collapse_headers, complete_cuts):
        out = out.withColumn(column, F.when(has_arabic(t), step(rewrite_step(t))).otherwise(t))  # they concern Arabic phrases alone
    return out.withColumn(column, step(collapse_lines(t)))
