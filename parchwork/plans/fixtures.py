"""Small inline relations for what the driver's tables don't hold: Arabic script, markdown, markers, dot floods.

The same rows serve the queries and, as VALUES, their SQL counterparts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchwork.functions.dialect import quoted
from parchwork.plans.session import spread

FIRST = 1_000_000_000

TEXTS: tuple[str, ...] = (
    "",
    "   \n\t ",
    "# درس في القراءة\nقال المعلم: هل قرأتم الدرس?\n1.السؤال الأول\n2. السؤال الثاني\n4. السؤال الرابع\nأ-فرع أول\n(١)بند\nكتاب, قلم, دفتر\nقال \"نعم\" ثم سكت",
    "أول الصفحة\n\n---PAGE_BREAK---\n\nآخر الصفحة\n12\nالصفحة 7\nPage 9\npage 10 of 11\n",
    "One<br>two<BR/>three</br>four&nbsp;five <b>bold</b> <span class=\"x\">s</span><img src=1><iframe></iframe><i>it</i><input> <strong>s</strong><p>para</p>",
    "a[^] b[^ ] c[^*] d[^3]\n\\text{hello} x​y   \nline with blanks   \n \n\t\n\n\n\nend\n-----\n---\n---\nlast",
    "before......\n......\n. . . . . .\n.....\n.....\n.....\nafter ....\n..",
    "dots " + "." * 35 + "\n" + "." * 14 + " " + "." * 13 + "\nend",
    "**bold** and *italic* and _under_ and `code` and $x^2$ and $$y$$ [link](http://a.b/c)\n---\n- item\n* star\n+ plus\n## Heading two\n### Heading `three`\ntext # not heading",
    "| a | b | c |\n| 1 | 2 |\n|---|:-:|---|\n|x|\nplain | with | pipes\n# head | with | pipes\n|\n||\nafter",
    "النبأ ﴿﴿عم يتساءلون﴾﴾ و ﴿ ﴿عن النبإ﴾ ﴾ ثم «قول مأثور» و﴿لا﴾",
    "بِسْمِ اللَّهِ الرَّحْمَٰنِ الرَّحِيمِ، إلى أُمّةٍ آمنة؛ هـــذا ٱلكتاب",
    "<!--ext:direct-->\nread directly\n\n\n\nmore",
    "text\n <!--ext:direct--> \n\n\nmore",
    "```markdown\n# Title\nbody\n```",
    "```json\n{\"markdown\": \"# From json\", \"x\": 1}\n```",
    "{\"markdown\": \"inline\"}",
    "{not json}",
    "```\nplain fence\n```",
    "وعن لبن في ضرع، وعن لبن في ضرع\nراوية ابن ماجه\nالنساء الرجال.\nكفته نيتة\nفَصُحْقًا",
    "صفحة من تفسير سورة الملك وفيها حديث\nالمراد من ذلك الجنس الصادق بـ",
    "ملف حديث_2ث ناقص",
    "Arabic: كلمة عربية واحدة and English words mixed together here كلمات أخرى كثيرة جدا",
    "1. one\n2. two\n5. five\n6. six\n10. ten\nrepeat line\nrepeat line\n\nrepeat line\nother",
    "(1) أي: السنون الطويلة\nنص عادي\n[^2] رواه البخاري\n\n[^1]: note one\n[^x]:   note x  \n",
    "<p>t</p><table><tr><th>A</th><th>B</th></tr>\n<tr><td>1</td></tr></table> tail",
    "    indented code\n> quote\n#### four\n***\n___\n1) first\n٢. ثانيا\n<!-- pagebreak -->\n```py\n# not heading\n```\nx",
    "Unit 1\nUnitary\nس 1 ما الجواب\n3. Question three\nالوحدة الأولى\nChapter: one\n\nLESSON",
    "سلاح الأزهري سلاح الأزهري سلاح الأزهري\nمبادئ علوم القرآن\nأ. تعريف القرآن\nب. موضوعه",
    "حرفَّ مشدد وَّ آخر ﺍﻟﺪﺭﺱ ① ½ ﬁ",
    "ختام الباب\nبيع الحاضر للبادي",
)

FILES: tuple[tuple[str, str, int], ...] = (
    ("book.pdf", "application/pdf", 10), ("BOOK.PDF", "", 20), ("scan.PNG", "", 30), ("photo", "image/heic", 40), ("memo.docx", "", 50), ("old.doc", "", 60),
    ("x.bin", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", 70), ("pic.svg", "", 80), ("pic.tiff", "", 90), ("notes.txt", "text/plain", 100),
    ("my_file (pages 3-9).pdf", "", 110), ("archive.tar.gz", "", 120), ("noext", "", 130), ("a/b.c", "", 140),
)

PAIRS: tuple[tuple[str, str], ...] = (
    ("الحمد لله رب العالمين", "الْحَمْدُ لِلَّهِ رَبِّ الْعَالَمِينَ"), ("مالك يوم الدين", "ملك يوم الدين"), ("abc", "xyz"), ("", "abc"), ("the quick brown fox", "quick brown"),
    ("kitten sitting", "sitting kitten"), ("a b c d", "a b c e"), ("same", "same"), ("نعبد وإياك نستعين", "إياك نعبد وإياك نستعين"),
)


def texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(FIRST + i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and the inline texts."""
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).unionByName(texts(spark))


def dealt(df: DataFrame, key: str, rows: tuple[tuple, ...], columns: tuple[str, ...]) -> DataFrame:
    """`df` with `columns` from `rows`, dealt in turn by `key`."""
    cells = {c: F.element_at(F.array(*(F.lit(r[k]) for r in rows)), (F.pmod(F.col(key), F.lit(len(rows))) + 1).cast("int")) for k, c in enumerate(columns)}
    return df.withColumns(cells)


def dealt_sql(table: str, key: str, rows: tuple[tuple, ...], columns: tuple[str, ...]) -> str:
    return f"(SELECT * FROM {table} JOIN {values_sql(tuple((i, *r) for i, r in enumerate(rows)), ', '.join(('dealt', *columns)))} ON {key} % {len(rows)} = dealt)"


def literal(value: object) -> str:
    return "NULL" if value is None else quoted(value) if isinstance(value, str) else str(value)


def values_sql(rows: tuple[tuple, ...], columns: str) -> str:
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) v({columns}))"


CORPUS_SQL = f"corpus AS (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id::BIGINT, text FROM {values_sql(tuple((FIRST + i, t) for i, t in enumerate(TEXTS)), 'doc_id, text')})"
