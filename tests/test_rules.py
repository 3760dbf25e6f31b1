import re

import pytest
from pyspark.sql import functions as F

from parchwork.operators import audit, fuzzy, rules, structural, structure_report
from parchwork.operators.rule_tables import COMPLETIONS, RULES, TARGETS, loose, spelled

#: A text that each rule of table A is made for, in order.
CORRUPT = [
    "لِّيَنِينَ", "مَقَامًا مفعل من الفوز", "سِبَاعًا شِدَادًا", "أناصبنا الماء", "فستعفيه الذكرى", "معنى غرفة مبالغة في النزع", "المراد بـ القضب البر والشعير", "معنى الاستفهام في قوله تعالى: من أي شيء خلقه استفهام تقريري ( x )",
    "قرأ هذه السورة، ولما بلغ قوله تعالى: يوم يقوم الناس لرب العالمين بكى نحيبا (عمر بن الخطاب - عثمان بن عفان)", "س: ثم أسند التدبير للخيل؟".replace("؟", "?"), "علوم القرآن هي ....", "من تقوت", "جواب الأمر: بقلب", "البصر خاشعا", "أن يخيف",
    "يعموا عمها", "أليأتيكم نذير", "صنفت", "راوية ابن ماجه", "النساء الرجال.", "(فارس - الروم - مصر)\n", "وعن لبن في ضرع، وعن لبن في ضرع", "بيع الحاضر للبادي", "كفته نيتة", "والمراد من ذلك الجنس الصادق بـ", "." * 25,
]


def texts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, text string")


def test_each_rule_fires_on_its_corruption(spark):
    assert len(CORRUPT) == len(RULES) == 26
    found = {r.doc_id: {e.ord for e in r.errors} for r in rules.audit(texts(spark, CORRUPT)).collect()}
    assert all(i in found[i] for i in range(len(RULES)))
    fixed = rules.repair(texts(spark, CORRUPT)).collect()
    assert all(r.fixed >= 1 for r in fixed)


def test_repair_wraps_verses_and_keeps_clean_text(spark):
    out = {r.doc_id: r for r in rules.repair(texts(spark, ["نص: من تقوت", "clean text....", ""])).collect()}
    assert out[0].text == "نص: ﴿مِن تَفَاوُتٍ﴾"
    assert out[1].text == "clean text...." and out[1].fixed == 0
    assert out[2].text == ""


def test_scores(spark):
    r = {x.doc_id: x for x in rules.audit(texts(spark, ["", "راوية ابن ماجه", "من تقوت", "." * 40, "الصادق بـ"])).collect()}
    assert [r[i].score for i in range(5)] == [100, 95, 82, 100 - 18 - 30, 60]
    assert r[0].summary == rules.EMPTY and r[1].warnings == 1 and r[2].distorted


def test_loose_words_ignore_diacritics(spark):
    df = texts(spark, ["تَقُوتُ", "تقوت", "تَفُوتُ"])
    assert [r[0] for r in df.orderBy("doc_id").select(F.col("text").rlike(f"^{loose('تقوت')}$")).collect()] == [True, True, False]
    assert "{" not in spelled("{من}_{تقوت}")


def test_targets(spark):
    rows = {r.doc_id: r for r in rules.repair_targets(texts(spark, ["معنى ﴿غُرْفَةً﴾ مبالغة", "لينين ثم لينين", "x"])).collect()}
    assert rows[0].text == "﴿غَرْقًا﴾ مبالغة"
    assert rows[1].targets[0]["count"] == 2 and rows[1].targets[0].surah_no == 78
    assert rows[2].targets == [] and len(TARGETS) == 14


def test_completions_first_occurrence_only(spark):
    cut = "بيع الحاضر للبادي"
    row = texts(spark, [f"{cut}\nx\n{cut}"]).select(rules.complete(F.col("text"))).first()[0]
    assert row.count(COMPLETIONS[1].put) == 1 and row.endswith(cut)


def test_grammar(spark):
    r = {x.doc_id: x for x in rules.grammar(texts(spark, ["", "جملة طويلة هنا. ذهب إلى", "A full sentence. Another one here.", "والمراد من ذلك الجنس الصادق بـ"])).collect()}
    assert not r[0].critical and r[1].critical and r[1].confidence == 0.9
    assert r[2].sentences == 2 and not r[2].abrupt
    assert r[3].confidence == 0.98


def test_notes_move_to_the_end_and_missing_ones_are_added(spark):
    r = {x.doc_id: x.text for x in rules.with_notes(texts(spark, ["سؤال\n(١) أي: السنون\nجواب", "سورة النبأ: لابثين فيها أحقاباً", "plain"])).collect()}
    assert "[^1]: (1) أي: السنون" in r[0] and r[0].index("جواب") < r[0].index("السنون")
    assert "الحقب ثمانون سنة" in r[1]
    assert r[2] == "plain"


def test_verification_against_a_canonical_table(spark):
    canonical = rules.keys_of(spark.createDataFrame([(1, "الْحَمْدُ لِلَّهِ رَبِّ الْعَالَمِينَ")], "ord int, text string"))
    out = rules.verify(texts(spark, ["قال: «الحمد لله رب العالمين» ثم", "none"]), canonical).collect()
    by = {r.doc_id: r for r in out}
    assert "«الْحَمْدُ لِلَّهِ رَبِّ الْعَالَمِينَ»" in by[0].text and by[0].detected == 1 and by[0].accuracy == 0
    assert by[1].accuracy == 100


@pytest.mark.parametrize(("a", "b", "score"), [("abc", "abc", 1.0), ("abcd", "abc", 0.75), ("", "x", 0.0), ("kitten", "sitting", 1 - 3 / 7)])
def test_similarity(spark, a, b, score):
    got = spark.createDataFrame([(a, b)], "a string, b string").select(fuzzy.key_similarity(F.col("a"), F.col("b"))).first()[0]
    assert abs(got - score) < 1e-12


def test_structure(spark):
    df = texts(spark, ["الموضوع الأول: تعريف\nنص", "سلاح الأزهري سلاح الأزهري x", "# T\nsame line\nsame line\nother", "text"]).withColumn("file_name", F.lit("my_file.pdf"))
    out = {r.doc_id: r.text for r in structural.repaired(df).collect()}
    assert "## الموضوع الأول: تعريف" in out[0] or out[0].startswith("# الموضوع الأول")
    assert out[1].count("سلاح الأزهري") == 1
    assert out[2].count("same line") == 1


def test_audit_keeps_pages_apart(spark):
    df = texts(spark, ["# Title\na\n\n---PAGE_BREAK---\n\nb", "", None])
    out = {r.doc_id: r for r in audit.audit(df).collect()}
    assert out[0].pages == 2 and out[0].title == "Title" and "---PAGE_BREAK---" in out[0].markdown
    assert out[1].markdown == "" and out[2].markdown == ""


def reports(spark, rows, file_name=None):
    df = texts(spark, rows).withColumn("file_name", F.lit(file_name).cast("string"))
    return {r.doc_id: r for r in structure_report.audited(df).collect()}


def test_structure_report_of_sound_and_empty_texts(spark):
    out = reports(spark, ["", "  \n", "# T\ntext of it", None])
    for k in (0, 1, 3):
        assert (out[k].structure.total, out[k].structure.sections, out[k].structure.verdict, out[k].structure.flawed) == (0, 0, structural.EMPTY, False)
    assert out[1].text == "  \n" and out[3].text is None
    assert (out[2].structure.sections, out[2].structure.issues, out[2].structure.verdict) == (1, [], structural.SOUND)


def test_structure_report_names_each_finding(spark):
    """A row for each step that finds something, in order, numbered as a whole."""
    text = "\n".join([
        "# عنوان", "س: ما معنى الآية؟", "(١) أي: السنون", "ج: كذا", "الموضوع الأول: تعريف", "**الإعراب**", "1. a", "3. b", "4. c",
        "سلاح الأزهري سلاح الأزهري", "| القرآن المكي | |", "علوم القرآن هي .....",
    ])
    r = reports(spark, [text])[0]
    found = [(x.id, x.category, x.severity, x.repaired) for x in r.structure.issues]
    assert found == [
        ("footnote-displaced-1", "displaced_footnote", "critical", True), ("header-unformatted-2", "missing_header", "info", True), ("header-unformatted-3", "missing_header", "info", True),
        ("numbering-skip-4", "mismatched_numbering", "warning", False), ("header-dedup-5", "missing_header", "warning", True), ("table-cell-madani-6", "missing_header", "critical", True),
        ("definition-repair-ulum-quran", "missing_header", "critical", True),
    ]
    assert [x.found for x in r.structure.issues][:4] == ["(١) أي: السنون", "الموضوع الأول: تعريف", "**الإعراب**", "3."]
    assert [x.fixed for x in r.structure.issues][1:4] == ["## الموضوع الأول: تعريف", "### الإعراب", None]
    s = r.structure
    assert (s.footnotes, s.missing_headers, s.numbering, s.repaired, s.total) == (1, 2, 1, 6, 7)
    assert s.verdict == "تم الفحص الهيكلي الشامل: ضبط 1 هوامش سفلية، تصحيح 2 ترويسات وعناوين، معايرة 1 تدرجات ترقيم هرمي، استكمال 6 خانات وجمل مبتورة وتطهير تكرارات طفيلية لضمان المطابقة الكاملة لأصل الـ PDF."
    assert "[^1]: (1) أي: السنون" in r.text and "\n### الإعراب\n" in r.text and "| سورة البقرة" in r.text


def test_structure_report_titles_and_contents(spark):
    out = reports(spark, ["first line of it\nmore", "- x"], "my_file.pdf")
    assert [(x.id, x.found, x.fixed) for x in out[0].structure.issues] == [("header-missing-h1", "first line of it", "# my file")] and out[0].text == "# first line of it\nmore"
    assert out[1].structure.issues[0].found == structure_report.H1_FOUND and out[1].text == "# my file\n\n- x"
    book = "# كتاب\n\n## الفهرس\n| الموضوع | الصفحة |\n|---|---|\n| سورة عبس | 9 |\n\n---PAGE_BREAK---\n## عبس\nنص"
    r = reports(spark, [book])[0]
    assert [(x.id, x.found, x.fixed) for x in r.structure.issues] == [("index-mismatch-1", "| سورة عبس | 9 |", "| سورة عبس | 3 |")] and "| سورة عبس | 3 |" in r.text


def test_rule_rows_say_where_and_why(spark):
    rows = rules.audit(texts(spark, ["قال: لينين هنا", "plain"])).collect()
    (e,) = rows[0].errors
    assert (e.category, e.location, e.surah, e.ayah, e.found) == ("quran_verse", "جدول وجوه الإعراب / الآيات الكريمة", "سورة النبأ", 23, "لينين") or e.found.strip() == "لينين"
    assert e.explanation.startswith("تحريف خطير") and rows[1].errors == []
    fixed = {r.doc_id: r for r in rules.repair(texts(spark, ["قال: لينين هنا", "dots .........", "plain"]), items="items").collect()}
    assert len(fixed[0]["items"]) == fixed[0].fixed == 1 and fixed[1].text == "dots ....." and fixed[2].text == "plain"


def test_grammar_report_says_why(spark):
    r = {x.doc_id: x for x in rules.grammar(texts(spark, ["هذا الكلام عن من", "جملة كاملة هنا.", ""])).collect()}
    assert r[0].alert == rules.ALERT and r[0].verdict == rules.CUT_VERDICT and "«من»" in r[0].reason
    assert r[1].alert is None and r[1].verdict == rules.WHOLE_VERDICT and r[2].verdict == rules.EMPTY


def test_audit_counts_add_up_and_rows_stay_apart(spark):
    df = spark.createDataFrame([(1, "قال: لينين هنا"), (1, "other text"), (None, "a\n\n---PAGE_BREAK---\n\nb"), (None, "x")], "doc_id long, text string")
    rows = audit.audit(df).collect()
    assert sorted((r.doc_id or 0, r.pages) for r in rows) == [(0, 1), (0, 2), (1, 1), (1, 1)]
    assert all(r.auto_fixed == sum(r[c] for c in audit.COUNTERS) for r in rows) and max(r.contextual_fixed for r in rows) == 1


def test_verification_goes_by_row(spark):
    canonical = rules.keys_of(spark.createDataFrame([(1, "الْحَمْدُ لِلَّهِ رَبِّ الْعَالَمِينَ")], "ord int, text string"))
    wrong = "قال: «الحمد لله رب العالمين» ثم"
    rows = [(None, wrong), (5, wrong), (5, "no quotation here"), (6, wrong), (7, None)]
    out = [(r.doc_id, r.detected, r.corrected, r.accuracy) for r in rules.verify(spark.createDataFrame(rows, "doc_id long, text string"), canonical).collect()]
    assert sorted(out, key=str) == sorted([(None, 1, 1, 0), (5, 1, 1, 0), (5, 0, 0, 100), (6, 1, 1, 0), (7, 0, 0, 100)], key=str)


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _similar(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if a in b or b in a:
        return max(0.75, min(len(a), len(b)) / max(len(a), len(b)))
    ta, tb = ({w for w in x.split(" ") if len(w) > 1} for x in (a, b))
    return max(len(ta & tb) / len(ta | tb) if ta and tb else 0.0, 1 - _distance(a, b) / max(len(a), len(b)))


def _best(key: str, passages: list[tuple[int, str]]):
    """Every passage and every window of the asked sizes."""
    w, found = len(key.split()), []
    for o, p in passages:
        parts = p.split()
        if _similar(key, p) >= 0.7:
            found.append((-_similar(key, p), o, 0, 0, 0, p))
        for rank, size in enumerate((w, w + 1, max(1, w - 1))):
            if w <= len(parts) and size <= len(parts) and not (w >= 2 and size < 2):
                windows = ((at, " ".join(parts[at : at + size])) for at in range(len(parts) - size + 1))
                found += [(-s, o, 1, rank, at, x) for at, x in windows if (s := _similar(key, x)) >= 0.78]
    return min(found)[:2] + min(found)[-1:] if found else None


def test_the_index_misses_no_match(spark):
    import random

    rng = random.Random(5)
    vocabulary = ["ab", "abc", "c", "caba", "bca", "acbcab", "bb", "cab", "bacb", "d"]
    passages = sorted({" ".join(rng.choices(vocabulary, k=rng.randint(1, 9))) for _ in range(60)})
    asked = []
    for _ in range(150):
        words = rng.choice(passages).split()
        at, size = rng.randrange(len(words)), rng.randint(1, 9)
        text = list(" ".join(words[at : at + size]))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(text) + 1)
            text[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "x", " "])
        asked.append(" ".join("".join(text).split()))
    canonical = spark.createDataFrame(list(enumerate(passages)), "ord long, normalized string")
    rows = fuzzy.best_matches(spark.createDataFrame(list(enumerate(asked)), "snippet_id long, text string"), canonical).collect()
    got = {r.snippet_id: (r.ord, r.phrase, round(r.score, 9)) for r in rows}
    want = {k: (b[1], b[2], round(-b[0], 9)) for k, key in enumerate(asked) if len(key) >= 3 and (b := _best(key, list(enumerate(passages))))}
    assert got == want and len(want) > 100


def test_matching_odd_rows(spark):
    canonical = spark.createDataFrame([(1, "river stone"), (1, "river stone"), (2, None), (3, ""), (4, "x")], "ord long, normalized string")
    asked = spark.createDataFrame([(1, "river stone"), (1, "river stone"), (None, "river stome"), (2, None), (3, ""), (4, "xx"), (5, "far away")], "snippet_id long, text string")
    assert sorted(map(str, ((r.snippet_id, r.ord, r.whole) for r in fuzzy.best_matches(asked, canonical).collect()))) == sorted(map(str, [(1, 1, True), (1, 1, True), (None, 1, True)]))
    assert fuzzy.best_matches(asked.where("false"), canonical).count() == fuzzy.best_matches(asked, canonical.where("false")).count() == 0
    plan = fuzzy.best_matches(asked, canonical)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_upsert_of_repeated_keys(spark):
    from parchwork.operators import history

    old = spark.createDataFrame([(1, 10, "a"), (2, 10, "b")], "id long, timestamp long, name string")
    new = spark.createDataFrame([(2, 11, "c"), (2, 12, "d"), (3, 5, "e"), (3, 5, "f")], "id long, timestamp long, name string")
    assert sorted(tuple(r) for r in history.upsert(old, new).collect()) == [(1, 10, "a"), (2, 12, "d"), (3, 5, "f")]


# One corruption in several vocalisations, and what each becomes.
VARIANTS = [
    ("﴿سِبَاعًا شِدَادًا﴾", "سَبْعًا"), ("﴿سِباعاً شِدَادًا﴾", "سَبْعًا"), ("﴿سِبَاعاً شِدَادًا﴾", "سَبْعًا"), ("سِباعاً شداداً", "سَبْعًا"), ("﴿مِنْ تَقُوتُ﴾", "مِن تَفَاوُتٍ"),
    ("مِنْ تَقُوتُ", "مِن تَفَاوُتٍ"), ("﴿من تقوت﴾", "مِن تَفَاوُتٍ"), ("الْبَصَرُ خَاشِعًا", "الْبَصَرُ خَاسِئًا"), ("البصر خاشعاً", "الْبَصَرُ خَاسِئًا"), ("البصر خاشعا", "الْبَصَرُ خَاسِئًا"),
]


def test_rules_take_any_vocalisation_but_no_missing_letter(spark):
    out = {r.doc_id: r.text for r in rules.repair(texts(spark, [t for t, _ in VARIANTS] + ["مِنْ تَقُتُ"])).collect()}
    assert all(want in out[i] for i, (_, want) in enumerate(VARIANTS)) and out[len(VARIANTS)] == "مِنْ تَقُتُ"


def test_grammar_stage_merges_an_assistant(spark):
    df = spark.createDataFrame([(1, "هذا الكلام عن من", "recognized"), (2, "هذا الكلام عن من", "direct"), (3, "جملة كاملة هنا.", "recognized")], "doc_id long, text string, origin string")
    said = F.expr(
        "cast(named_struct('items', array(named_struct('text', text, 'completion', 'again', 'reason', '', 'confidence', 0.5D), named_struct('text', 'other', 'completion', cast(null as string), 'reason', '', 'confidence', cast(null as double))), "
        f"'critical', true, 'abrupt', false, 'verdict', 'told', 'alert', '', 'completed', concat(text, ' more')) as {audit.ASSISTANT})"
    )
    out = {r.doc_id: r for r in audit.grammar_stage(df, said).collect()}
    assert [x.text for x in out[1]["items"]] == ["هذا الكلام عن من", "other"] and out[1].text.endswith(" more") and (out[1].verdict, out[1].alert) == ("told", rules.ALERT)
    assert (out[1]["items"][1].completion, out[1]["items"][1].reason, out[1]["items"][1].confidence) == ("", audit.ASSISTANT_REASON, audit.ASSISTANT_CONFIDENCE)
    assert len(out[2]["items"]) == 1 and out[2].text == "هذا الكلام عن من" and out[2].verdict == rules.CUT_VERDICT
    assert len(out[3]["items"]) == 2 and out[3].critical and not out[3].abrupt and out[3].alert is None
    alone = {r.doc_id: r for r in audit.grammar_stage(df).collect()}
    assert alone[3]["items"] == [] and alone[3].text == "جملة كاملة هنا."


def test_prefilter_takes_what_every_match_holds():
    from parchwork.operators import prefilter

    assert prefilter.required("{سباعا}(?=(?:_)?{شدادا})|﴿{سباعا}﴾") == {"سباعا"}
    assert prefilter.required("(?:قرأ|كتب)_هذه_السورة") == {"السورة"} and prefilter.required("لّ?ِيَنِينَ|لينين") == {"لينين"}
    assert prefilter.required("\\.{20,}+") == prefilter.required("كلمة|[ابت]+") == prefilter.required("هم?") == frozenset()
    assert all(prefilter.required(r.pattern) for r in rules.RULES if r.category != "dot_flood") and all(prefilter.required(t.pattern) for t in rules.TARGETS)


def test_prefilter_passes_every_match(spark):
    """Made texts: pieces of rules' matches, their words, diacritics and fillers in any order."""
    import random

    from parchwork.plans.fixtures import TEXTS

    rng = random.Random(4)
    words = sorted({w for r in (*rules.RULES, *rules.TARGETS) for w in re.findall("[ء-ي]{2,}", r.pattern)})
    pieces = [*words, *(t for t, _ in VARIANTS), *(x for t in TEXTS for x in t.split("\n") if x), "﴿", "﴾", "......", "\n", "plain"]
    marks = "ًَُِّْٰـ"
    made = []
    for _ in range(10_000):
        x = " ".join(rng.choices(pieces, k=rng.randint(1, 8)))
        made.append("".join(c + rng.choice(marks) if rng.random() < 0.1 else c for c in x) if rng.random() < 0.5 else x)
    df = texts(spark, [*TEXTS, *made])
    for patterns, told in ((rules.RULES, rules.RULE_WORDS), (rules.TARGETS, rules.TARGET_WORDS)):
        missed = [F.col("text").rlike(rules.spelled(r.pattern)) & ~told.may(k, F.col("w")) for k, r in enumerate(patterns)]
        hits = [F.col("text").rlike(rules.spelled(r.pattern)).cast("int") for r in patterns]
        row = df.withColumn("w", told.found(F.col("text"))).agg(*(F.max(m.cast("int")).alias(f"m{k}") for k, m in enumerate(missed)), sum(map(F.sum, hits), F.lit(0)).alias("hits"), F.sum((F.size("w") == 0).cast("int")).alias("spared")).first()
        assert not any(row[f"m{k}"] for k in range(len(patterns))) and row["hits"] > 500 and row["spared"] > 500


def test_merged_pages_are_numbered_over_ranges(spark):
    from parchwork.operators import history, ranges

    documents = spark.createDataFrame([(1, 2, "pdf"), (2, 1, "image"), (3, 0, "docx"), (4, 3, None)], "doc_id long, ord int, kind string")
    pages = spark.createDataFrame([(1, k, f"p{k}") for k in range(500)] + [(2, 1, "i"), (3, 1, "w"), (4, 1, "n"), (9, 1, "x")], "doc_id long, page_no long, page string")
    out = sorted(map(tuple, history.merged_pages(documents, pages, strict=True).collect()))
    assert [r[0] for r in out] == list(range(1, 503)) and [r[1] for r in out] == [2, *[1] * 500, 4] and [r[2] for r in out[1:501]] == list(range(500))
    with pytest.raises(ValueError, match=history.NO_PAGES):
        history.merged_pages(documents.where("kind = 'docx'"), pages, strict=True)
    assert history.merged_pages(documents.where("false"), pages).count() == 0
    sums = ranges.running(spark.createDataFrame([(None, None), (3, 5), (1, 2), (2, None)], "k int, n int"), [F.col("k")], F.col("n"), "total")
    assert sorted(((r.k, r.total) for r in sums.collect()), key=str) == [(1, 2), (2, 2), (3, 7), (None, 0)]


def test_a_failed_call_is_a_clean_report(spark):
    df = spark.createDataFrame([(1, "هذا الكلام عن من", "recognized", True), (2, "جملة كاملة هنا.", "recognized", False)], "doc_id long, text string, origin string, broke boolean")
    out = {r.doc_id: r for r in audit.grammar_stage(df, audit.answered(F.lit(None).cast(audit.ASSISTANT), F.col("broke"))).collect()}
    assert out[1].verdict == out[2].verdict == audit.FAILED_VERDICT and out[1].critical and not out[2].critical and out[2]["items"] == []
