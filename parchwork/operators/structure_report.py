"""The structural auditor's report: one row of an array for each finding, counts and a verdict (STR-1 to STR-14).

A state of text and findings goes from step to step within one expression: what a step finds is appended to the report, then the
text is rewritten, so later steps see earlier edits, and the plan doesn't grow with the steps. Findings are (id, category, severity, title, found, fixed, repaired), in the order of the steps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchwork.functions.dialect import BOL, count, trim
from parchwork.functions.text import has_arabic
from parchwork.operators import conversion, rules, structural
from parchwork.operators.rule_tables import NOTE_TITLES, NOTES

_ISSUES = "array<struct<id:string,category:string,severity:string,title:string,found:string,fixed:string,repaired:boolean>>"
_HEADER, _NUMBERS = "missing_header", "mismatched_numbering"
# Titles and snippets of the report.
DISPLACED_TITLE, DISPLACED_FIXED = "إقحام هامش تفسيري في متن النص بشكل خاطئ", "تم نقل الهامش إلى قسم الحواشي والتذييل السليم أسفل الصفحة."
MISSING_TITLE, MISSING_FOUND = ("سقوط هامش الشرح (", "): "), "[مفقود في الوورد]"
H1_TITLE, H1_FOUND = "غياب العنوان الرئيسي للمستند (Heading 1)", "[بداية المستند]"
PROMOTED_TITLE = ("تنسيق عنوان (", ") المفقود كترويسة معتمدة")
HEADING_LABELS = ("عنوان موضوع دراسي رئيسي", "عنوان سورة قرآنية كريمة", "عنوان مبحث مبادئ علوم القرآن", "عنوان مبحث أول وآخر ما نزل", "عنوان مبحث فرعي تحليلي", "عنوان مبحث فرعي")
LETTERED_TITLE = "تداخل الترقيم الأبجدي للعناصر الرئيسية والفرعية في مبادئ علوم القرآن"
LETTERED_FOUND, LETTERED_FIXED = "أ. تعريف القرآن الكريم ... أ. لغةً ... ب. اصطلاحاً", "1. تعريف القرآن الكريم ... أ. لغةً ... ب. اصطلاحاً"
SKIP_TITLE = ("قفزة في تسلسل الترقيم الرقمي (من ", " إلى ", ")")
RUNNING_TITLE, RUNNING_FOUND, RUNNING_FIXED = "إزالة تكرار طفيلي في ترويسة ومطلع الصفحات", "تكرار العنوان مرتين متتاليتين في الغلاف والرأس", "العنوان لمرة واحدة منقحة ومضبوطة"
CELL_TITLE, CELL_FOUND = "استكمال خانة القرآن المدني الساقطة في جدول المقارنة", "| القرآن المكي ... | |"
HORSES_TITLE, HORSES_FOUND, HORSES_FIXED = "استكمال سؤال مبتور حول إسناد التدبير للخيل في سورة النازعات", "س: ثم أُسند التدبير للخيل؟", "س: هل أُسند التدبير للخيل في قوله تعالى ﴿فَالْمُدَبِّرَاتِ أَمْرًا﴾؟ ..."
SCIENCES_TITLE, SCIENCES_FOUND, SCIENCES_FIXED = "استكمال التعريف المبتور لعلوم القرآن الكريم", "علوم القرآن هي .....", "علوم القرآن هي: مباحث تتعلق بالقرآن الكريم من حيث نزوله وترتيبه وجمعه..."
CONTENTS_TITLE = ("معايرة رقم صفحة الفهرس لموضوع: «", "»")
VERDICT, VERDICT_PARTS, COMMA = ("تم الفحص الهيكلي الشامل: ", " لضمان المطابقة الكاملة لأصل الـ PDF."), (("ضبط ", " هوامش سفلية"), ("تصحيح ", " ترويسات وعناوين"), ("معايرة ", " تدرجات ترقيم هرمي"), ("استكمال ", " خانات وجمل مبتورة وتطهير تكرارات طفيلية")), "، "


def _issue(stem: str, category: str, severity: str, title: Column | str, found: Column | str, fixed: Column | str | None, repaired: bool = True) -> Column:
    """A finding; a stem that ends in a dash gets its number in the report."""

    def value(x: Column | str | None) -> Column:
        return x if isinstance(x, Column) else F.lit(x).cast("string")

    return F.struct(F.lit(stem).alias("id"), F.lit(category).alias("category"), F.lit(severity).alias("severity"), value(title).alias("title"), value(found).alias("found"), value(fixed).alias("fixed"), F.lit(repaired).alias("repaired"))


def _if(condition: Column, issue: Column) -> Column:
    return F.when(condition, F.array(issue)).otherwise(F.expr(f"cast(array() as {_ISSUES})"))


def _notes(moved: Column, missing: Column) -> Column:
    displaced = F.transform(moved, lambda x: _issue("footnote-displaced-", "displaced_footnote", "critical", DISPLACED_TITLE, x, DISPLACED_FIXED))
    titles = F.create_map(*(F.lit(x) for (_, _, n, note), title in zip(NOTES, NOTE_TITLES, strict=True) for x in (note, f"{MISSING_TITLE[0]}{n}{MISSING_TITLE[1]}{title}")))
    absent = F.transform(missing, lambda x: _issue("footnote-missing-", "missing_footnote", "critical", F.element_at(titles, x), MISSING_FOUND, x))
    return F.concat(displaced, absent)


def _promoted(lines: Column) -> Column:
    """Headings by pattern, and by line within one; the first pattern that a line fits counts."""

    def of(k: int, level: str, label: str) -> Column:
        title = f"{PROMOTED_TITLE[0]}{label}{PROMOTED_TITLE[1]}"
        fits = F.filter(lines, lambda x: structural.heading_of(x) == k)
        return F.transform(fits, lambda x: _issue("header-unformatted-", _HEADER, "info", title, trim(x), F.concat(F.lit(level + " "), structural.bare_heading(x))))

    return F.concat(*(of(k, level, label) for k, ((level, _), label) in enumerate(zip(structural.HEADINGS, HEADING_LABELS, strict=True))))


def _skips(numbers: Column) -> Column:
    """Numbers that skip one or two, among three or more."""
    steps = F.transform(numbers, lambda x, i: F.struct(F.when(i > 0, F.element_at(numbers, i)).otherwise(0).alias("a"), x.alias("b")))
    gaps = F.filter(steps, lambda s: (F.size(numbers) >= 3) & (s["a"] > 0) & (s["b"] > 1) & (s["b"] > s["a"] + 1) & (s["b"] - s["a"] <= 3))
    a, between, b = SKIP_TITLE
    return F.transform(gaps, lambda s: _issue("numbering-skip-", _NUMBERS, "warning", F.concat(F.lit(a), s["a"].cast("string"), F.lit(between), s["b"].cast("string"), F.lit(b)), F.concat(s["b"].cast("string"), F.lit(".")), None, repaired=False))


def audited(df: DataFrame, column: str = "text", file_name: str = "file_name", report: str = "structure") -> DataFrame:
    """`df` with `column` repaired and `report`: sections, total, missing_headers, numbering, footnotes, repaired, issues, verdict, flawed.

    A null, empty or blank text stays as it is and has an empty report.
    """
    t, name = F.col(column), F.col(file_name)
    blank, arabic = F.col("__blank"), F.col("__arabic")
    out = df.withColumns({"__blank": F.coalesce(trim(t) == "", F.lit(True)), "__arabic": F.coalesce(has_arabic(t), F.lit(False))})
    # other texts have numbers and titles alone; displaced notes have Arabic words
    out = rules.with_notes(out, column, keep=True)
    issues = F.when(blank, F.expr(f"cast(array() as {_ISSUES})")).otherwise(_notes(F.col("__moved"), F.col("__missing")))
    out = out.withColumn("__issues", issues).drop("__moved", "__missing")

    state = F.array(F.struct(t.alias("text"), F.col("__issues").alias("issues")))  # of one element, so that a lambda can name it

    def step(only: Column, rewritten: Callable[[Column], Column] | None, found: Callable[[Column], Column] | None) -> None:
        nonlocal state

        def taken(s: Column) -> Column:
            text, issues = s["text"], s["issues"]
            return F.struct((rewritten(text) if rewritten else text).alias("text"), (F.concat(issues, found(text)) if found else issues).alias("issues"))

        state = F.transform(state, lambda s: F.when(only, taken(s)).otherwise(s))

    def untitled(x: Column) -> Column:
        first, named = structural.title_parts(x, name)
        return _if(~structural.has_title(x), _issue("header-missing-h1", _HEADER, "warning", H1_TITLE, F.when(first != "", F.substring(first, 1, 50)).otherwise(H1_FOUND), F.concat(F.lit("# "), named)))

    def skips(x: Column) -> Column:
        numbers = F.transform(F.regexp_extract_all(x, F.lit(f"{BOL}[ \\t]*+([0-9]++)\\.[ \\t]++"), F.lit(1)), lambda n: n.try_cast("bigint"))
        return F.flatten(F.transform(F.array(numbers), _skips))

    def wherever(pattern: str, issue: Column) -> Callable[[Column], Column]:
        return lambda x: _if(x.rlike(pattern), issue)

    in_arabic = ~blank & arabic
    step(~blank, lambda x: structural.add_title(x, name), untitled)
    step(in_arabic, structural.promote_headings, lambda x: _promoted(F.split(x, "\n", -1)))
    step(in_arabic, structural.renumber_letters, lambda x: _if(structural.is_lettered(x), _issue("numbering-hierarchy-mabadi", _NUMBERS, "critical", LETTERED_TITLE, LETTERED_FOUND, LETTERED_FIXED)))
    step(~blank, None, skips)
    step(in_arabic, structural.collapse_headers, wherever(structural.RUNNING, _issue("header-dedup-", _HEADER, "warning", RUNNING_TITLE, RUNNING_FOUND, RUNNING_FIXED)))
    step(~blank, structural.collapse_lines, None)
    step(in_arabic, conversion.completed_comparison, wherever(conversion.EMPTY_CELL, _issue("table-cell-madani-", _HEADER, "critical", CELL_TITLE, CELL_FOUND, f"| {conversion.MADANI} |")))
    step(in_arabic, structural.complete_horses, wherever(structural.HORSES, _issue("question-repair-khayl", _HEADER, "critical", HORSES_TITLE, HORSES_FOUND, HORSES_FIXED)))
    step(in_arabic, structural.complete_sciences, wherever(structural.SCIENCES, _issue("definition-repair-ulum-quran", _HEADER, "critical", SCIENCES_TITLE, SCIENCES_FOUND, SCIENCES_FIXED)))
    out = out.withColumn("__state", state)
    out = out.withColumns({column: F.col("__state")[0]["text"], "__issues": F.col("__state")[0]["issues"]}).drop("__state")
    out = conversion.calibrated_contents(out, column, told="__calibrated")
    before, after = CONTENTS_TITLE
    calibrated = F.transform("__calibrated", lambda e: _issue("index-mismatch-", _NUMBERS, "warning", F.concat(F.lit(before), e["topic"], F.lit(after)), e["old"], e["new"]))
    out = out.withColumn("__issues", F.concat("__issues", calibrated)).drop("__calibrated", "moved")

    numbered = F.transform("__issues", lambda x, i: x.withField("id", F.when(x["id"].endswith("-"), F.concat(x["id"], (i + 1).cast("string"))).otherwise(x["id"])))
    out = out.withColumn("__issues", numbered)

    def many(of) -> Column:
        return F.size(F.filter("__issues", of))

    out = out.withColumns({
        "__footnotes": many(lambda x: x["id"].startswith("footnote-")), "__headers": many(lambda x: (x["id"] == "header-missing-h1") | x["id"].startswith("header-unformatted-")),
        "__numbering": many(lambda x: x["id"].startswith("numbering-")), "__repaired": many(lambda x: x["repaired"]),
    })
    parts = [F.when(F.col(c) > 0, F.concat(F.lit(a), F.col(c).cast("string"), F.lit(b))) for c, (a, b) in zip(("__footnotes", "__headers", "__numbering", "__repaired"), VERDICT_PARTS, strict=True)]
    said = F.concat(F.lit(VERDICT[0]), F.concat_ws(COMMA, *parts), F.lit(VERDICT[1]))
    total = F.size("__issues")
    verdict = F.when(blank, structural.EMPTY).when(total > 0, said).otherwise(structural.SOUND)
    sections = F.when(blank, 0).otherwise(F.greatest(F.lit(1), count(t, f"{BOL}#{{1,3}}[ \\t]+")))
    struct = F.struct(
        sections.alias("sections"), total.alias("total"), F.col("__headers").alias("missing_headers"), F.col("__numbering").alias("numbering"), F.col("__footnotes").alias("footnotes"),
        F.col("__repaired").alias("repaired"), F.col("__issues").alias("issues"), verdict.alias("verdict"), (total > 0).alias("flawed"),
    )
    return out.withColumn(report, struct).drop("__blank", "__arabic", "__issues", "__footnotes", "__headers", "__numbering", "__repaired")
