"""Rule engines: detection, ordered rewrites, completions and verification (RUL, FUZ-5 to FUZ-7, STR-2, STR-3).

Rules are data: an array of patterns and replacements in the plan, over which rewrites are folded, so a plan doesn't grow
with its rules, and each rule sees what earlier ones left. Detection reads the text as it came, so its rules are independent of each
other. A text is searched once for the words that rules need; without any of them no rule is tried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchwork.functions.dialect import S, count, first_only, rewrite, round_half_up, trim
from parchwork.functions.text import BRACKETS, DOTS, NESTED_BRACKETS, Step, has_arabic, has_dot_flood, has_truncation, search_key, subject
from parchwork.operators import prefilter
from parchwork.operators.rule_tables import COMPLETION_REASONS, COMPLETIONS, NOTES, OTHER_SURAH, RULE_NOTES, RULES, SURAH_NUMBERS, TARGETS, spelled
from parchwork.operators.structural import NOTES_TITLE, PARTICLES, displaced_notes, ends_hanging, is_curriculum_cut
from parchwork.plans.session import materialize

#: Points off the quality score.
CRITICAL, WARNING, FLOOD, CUT = 18, 5, 30, 40
# Verdicts.
SOUND = "الملف مكتمل وسليم 100% ومطابق للمصادر الأزهرية ولا توجد نقاط متكررة أو نواقص."
MINOR = ("الملف سليم بشكل عام، مع وجود (", ") ملاحظات إملائية أو لغوية طفيفة.")
WRONG = ("تم اكتشاف (", ") أخطاء حرجة تشمل تحريفات في الآيات والأحاديث ونواقص في الجداول. يجب إصلاح الملف قبل الاعتماد.")
DAMAGED = ("الملف تالف جسيماً: يحتوي على (", ") أخطاء حرجة، مع وجود سيل نقاط متكرر أدى لمحو أجزاء واسعة وبتر المنهج قبل اكتماله. شكوى المراجع صحيحة 100%.")
EMPTY = "المستند فارغ."
ALERT = "تنبيه نحوي وأكاديمي حرج: يبدو أن الملف مبتور أو ناقص بشكل كبير في منتصف الجملة والمنهج! تم رصد انقطاع تركيبي مفتوح وسقوط صفحات كاملة."
CUT_VERDICT, WHOLE_VERDICT = "تم رصد بتر نحوي مفتوح وانقطاع في الجمل الأكاديمية", "التراكيب النحوية متصلة وخالية من البتر المفاجئ"
HANGS_ON = ("انقطاع النص فجأة على أداة أو حرف معلق («", "») بدون استكمال المعنى النحوي")
HANGING = "... [يتطلب استكمال النص بناءً على المنهج الأزهري المقرر]"


def shortened(text: Column, most: int, keep: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, keep), F.lit("..."))).otherwise(text)


def _literal(put: str) -> str:
    return put.replace("\\", "\\\\").replace("$", "\\$")


#: Which rules and targets can occur in a text; the rule on dots needs no word.
RULE_WORDS, TARGET_WORDS = prefilter.of([r.pattern for r in RULES]), prefilter.of([t.pattern for t in TARGETS])
_FLOODS = [spelled(r.pattern) for r in RULES if r.category == "dot_flood"]


def errors(text: Column) -> Column:
    """An array of (ord, category, severity, subject, location, surah, ayah, found, correct, explanation, context): the rules of table A that match."""

    def row(i: int) -> Column:
        r, (location, explanation) = RULES[i], RULE_NOTES[i]
        p = spelled(r.pattern)
        at = F.regexp_instr(text, F.lit(p)) - 1
        start = F.greatest(F.lit(0), at - 50)
        context = trim(F.regexp_replace(F.substring(text, start + 1, at + 80 - start), "\\n++", " "))
        found = F.struct(
            F.lit(i).alias("ord"), F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity"), F.lit(r.subject).alias("subject"), F.lit(location).alias("location"), F.lit(r.surah).cast("string").alias("surah"), F.lit(r.ayah).cast("int").alias("ayah"),
            shortened(F.regexp_substr(text, F.lit(p)), 40, 35).alias("found"), F.lit(r.put if len(r.put) <= 60 else r.put[:55] + "...").alias("correct"), F.lit(explanation).alias("explanation"), context.alias("context"),
        )
        return F.when(text.rlike(p), found)

    def matching(words: Column) -> Column:
        every = F.array(*(F.when(RULE_WORDS.may(i, words), row(i)) for i in range(len(RULES))))
        return F.filter(F.when(F.size(words) > 0, every).otherwise(floods), lambda x: x.isNotNull())

    floods = F.array(*(row(i) for i, r in enumerate(RULES) if r.category == "dot_flood"))
    # but for dots every rule needs Arabic letters: one test spares the others
    return F.when(has_arabic(text), F.flatten(F.transform(F.array(RULE_WORDS.found(text)), matching))).otherwise(F.filter(floods, lambda x: x.isNotNull()))


def audit(df: DataFrame) -> DataFrame:
    """doc_id, errors, critical, warnings, score (0 to 100), distorted, dot_flood, truncated, subject and summary. Blank texts are sound."""
    blank = trim(F.col("text")) == ""
    t = df.select("doc_id", blank.alias("blank"), errors(F.col("text")).alias("errors"), (has_dot_flood(F.col("text")) & ~blank).alias("dot_flood"), (has_truncation(F.col("text")) & ~blank).alias("truncated"), subject(F.col("text")).alias("subject"))

    def many(severity: str) -> Column:
        return F.size(F.filter("errors", lambda x: x["severity"] == severity))

    t = t.withColumns({"critical": many("critical"), "warning": many("warning")})
    score = 100 - CRITICAL * F.col("critical") - WARNING * F.col("warning") - F.when(F.col("dot_flood"), FLOOD).otherwise(0) - F.when(F.col("truncated"), CUT).otherwise(0)

    def said(parts: tuple[str, str], n: Column) -> Column:
        return F.concat(F.lit(parts[0]), n.cast("string"), F.lit(parts[1]))

    summary = (
        F.when(F.col("blank"), EMPTY).when(F.col("dot_flood") | F.col("truncated"), said(DAMAGED, F.col("critical"))).when(F.col("critical") > 0, said(WRONG, F.col("critical")))
        .when(F.col("warning") > 0, said(MINOR, F.col("warning"))).otherwise(SOUND)
    )
    return t.select(
        "doc_id", "errors", "critical", F.col("warning").alias("warnings"), F.least(F.lit(100), F.greatest(F.lit(0), score)).alias("score"),
        F.exists("errors", lambda x: x["category"].isin("quran_verse", "irab_grammar")).alias("distorted"), "dot_flood", "truncated", "subject", summary.alias("summary"),
    )


def repair(df: DataFrame, column: str = "text", counter: str = "fixed", items: str | None = None) -> DataFrame:
    """`df` with `column` after all rules of table A in their order, then dots and brackets; `counter` counts replacements and
    `items`, if named, holds the errors of the text as it came.

    Verses come in ornate brackets. Dots are compressed after the rules, or the flood rule would find none. Texts without Arabic
    letters meet the rule on dots alone; a text in which no rule can occur is not folded over. A null text stays null, with a count of 0.
    """
    t, text, arabic = F.col(column), F.col("__fixed.text"), F.col("__arabic")
    out = df if items is None else df.withColumn(items, errors(t))
    rules = F.array(*(F.struct(F.lit(spelled(r.pattern)).alias("p"), F.lit(_literal(f"﴿{r.put}﴾" if r.category == "quran_verse" else r.put)).alias("put"), F.lit(r.category == "dot_flood").alias("flood")) for r in RULES))
    begun = F.struct(t.alias("text"), F.lit(0).alias("n"))

    def apply(done: Column, r: Column) -> Column:
        hit = (arabic | r["flood"]) & F.rlike(done["text"], r["p"])
        return F.when(hit, F.struct(F.regexp_replace(done["text"], r["p"], r["put"]).alias("text"), (done["n"] + F.regexp_count(done["text"], r["p"])).alias("n"))).otherwise(done)

    suspect = F.lit(False)
    for p in _FLOODS:
        suspect = suspect | t.rlike(p)
    out = out.withColumn("__arabic", has_arabic(t))
    out = out.withColumn("__fixed", F.when(suspect | (arabic & (F.size(RULE_WORDS.found(t)) > 0)), F.aggregate(rules, begun, apply)).otherwise(begun))
    spaced = F.when(arabic | text.rlike("\\.{5}|\\.[ \\t]+\\.|[﴿﴾]"), rewrite(text, [*DOTS, *NESTED_BRACKETS])).otherwise(text)
    return out.withColumns({counter: F.col("__fixed.n"), column: spaced}).drop("__arabic", "__fixed")


_TARGETS = "array<struct<ord:int,surah_no:int,ayah:int,found:string,count:int>>"


def repair_targets(df: DataFrame, column: str = "text") -> DataFrame:
    """`df` with known misreadings of table B put right, and `targets`: (ord, surah_no, ayah, found, count) of those that occurred."""
    t, rows = F.col(column), []
    for i, x in enumerate(TARGETS):
        p = spelled(x.pattern)
        # of a phrase about a bracketed word, what stands after the bracket is kept
        head, _, rest = x.pattern.partition("﴾?_")
        taken = spelled(f"{head}﴾(?=_{rest})|{head}_{rest}") if rest else p
        rows.append(F.struct(F.lit(i).alias("ord"), F.lit(SURAH_NUMBERS.get(x.surah, OTHER_SURAH)).alias("surah_no"), F.lit(x.ayah).alias("ayah"), F.lit(p).alias("p"), F.lit(taken).alias("taken"), F.lit(_literal(f"﴿{x.put}﴾")).alias("put")))
    begun = F.struct(t.alias("text"), F.expr(f"cast(array() as {_TARGETS})").alias("targets"))

    def apply(done: Column, r: Column) -> Column:
        told = F.struct(r["ord"].alias("ord"), r["surah_no"].alias("surah_no"), r["ayah"].alias("ayah"), F.regexp_substr(done["text"], r["p"]).alias("found"), F.regexp_count(done["text"], r["p"]).alias("count"))
        put = F.struct(F.regexp_replace(done["text"], r["taken"], r["put"]).alias("text"), F.concat(done["targets"], F.array(told)).alias("targets"))
        return F.when(F.rlike(done["text"], r["p"]), put).otherwise(done)

    suspect = has_arabic(t) & (F.size(TARGET_WORDS.found(t)) > 0)
    out = df.withColumn("__hit", F.when(suspect, F.aggregate(F.array(*rows), begun, apply)).otherwise(begun))
    return out.withColumns({"targets": F.col("__hit.targets"), column: F.col("__hit.text")}).drop("__hit")


def complete(text: Column) -> Column:
    """Known cuts completed, the first occurrence of each. Texts without Arabic letters aren't searched."""
    done = text
    for c in COMPLETIONS:
        done = first_only(done, c.pattern, c.put)
    return F.when(has_arabic(text), done).otherwise(text)


def grammar(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, sentences, critical, abrupt, the cut that was found: cut_text, completion, reason, confidence (nulls if none), alert (null
    unless critical) and verdict; and the columns `keep` of `df`."""
    t = trim(F.col("text"))
    known = F.lit(None).cast("struct<completion:string,critical:boolean,reason:string>")
    for c, reason in reversed(list(zip(COMPLETIONS, COMPLETION_REASONS, strict=True))):
        known = F.when(t.rlike(c.pattern), F.struct(F.lit(c.put).alias("completion"), F.lit(c.critical).alias("critical"), F.lit(reason).alias("reason"))).otherwise(known)
    sentences = F.size(F.filter(F.split(t, "[.؟!;\\n]+", -1), lambda x: F.length(trim(x)) > 5))
    rows = df.select("doc_id", *keep, t.alias("t"), known.alias("known"), ends_hanging(F.col("text")).alias("hanging"), (is_curriculum_cut(F.col("text"))).alias("cut"), sentences.alias("sentences"))
    hangs = F.col("hanging") & F.col("known").isNull()
    empty = F.col("t") == ""
    tail = lambda n: F.substring(F.col("t"), F.greatest(F.lit(1), F.length("t") - n + 1), F.lit(n))
    critical = ~empty & (F.coalesce(F.col("known.critical"), F.lit(False)) | hangs | F.col("cut"))
    particle = trim(F.regexp_substr("t", F.lit(PARTICLES)))
    return rows.select(
        "doc_id", *keep, F.when(empty, 0).otherwise(F.col("sentences")).alias("sentences"), critical.alias("critical"),
        (~empty & (F.col("known").isNotNull() | hangs | F.col("cut"))).alias("abrupt"), F.when(F.col("known").isNotNull(), tail(80)).when(hangs & ~empty, tail(60)).alias("cut_text"),
        F.when(F.col("known").isNotNull(), F.col("known.completion")).when(hangs & ~empty, HANGING).alias("completion"),
        F.when(F.col("known").isNotNull(), F.col("known.reason")).when(hangs & ~empty, F.concat(F.lit(HANGS_ON[0]), particle, F.lit(HANGS_ON[1]))).alias("reason"),
        F.when(critical, ALERT).alias("alert"), F.when(empty, EMPTY).when(critical, CUT_VERDICT).otherwise(WHOLE_VERDICT).alias("verdict"), F.when(F.col("known").isNotNull(), 0.98).when(hangs & ~empty, 0.9).alias("confidence"),
    )


def truncated(text: Column) -> Column:
    """How many cuts `grammar` reports: one or none."""
    t = trim(text)
    known = F.lit(False)
    for c in COMPLETIONS:
        known = known | t.rlike(c.pattern)
    return F.when(has_arabic(text) & (known | ends_hanging(text)), 1).otherwise(0)


def missing_notes(text: Column) -> Column:
    """Notes that the text's topics need and that it lacks. A text that treats abrogation, or gradual legislation, anywhere counts as having every note of its number."""
    found = []
    for topic, term, number, note in NOTES:
        p, q = (x.replace("_", f"{S}+") for x in (topic, term))
        has = text.contains(note) | (text.contains("مفهوم النسخ") if number == "١" else text.contains("التدرج التشريعي") if number == "٢" else F.lit(False))
        found.append(F.when(text.rlike(p) & text.rlike(q) & ~has, F.lit(note)))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def with_notes(df: DataFrame, column: str = "text", keep: bool = False) -> DataFrame:
    """`df` with displaced and missing notes in a block at the end of `column`, numbered from 1; nothing changes if there are none.
    With `keep` the columns __moved and __missing hold both kinds.

    Each step is a projection of its own, so that no text is computed twice.
    """
    t = F.col(column)
    out = df.withColumn("__moved", displaced_notes(t))
    cut = F.aggregate("__moved", t, lambda x, n: F.concat(F.substring(x, F.lit(1), F.position(n, x) - 1), F.substring(x, F.position(n, x) + F.length(n), F.length(x))))
    out = out.withColumn("__without", F.when(F.size("__moved") > 0, cut).otherwise(t))
    without = F.col("__without")
    out = out.withColumn("__missing", F.when(has_arabic(without), missing_notes(without)).otherwise(F.expr("cast(array() as array<string>)")))
    out = out.withColumn("__notes", F.concat("__moved", "__missing"))
    out = out.withColumn("__bare", F.transform("__notes", lambda n: F.regexp_replace(n, f"\\A(?:\\([١-٩1-9]\\)|\\[\\^[0-9]+\\]){S}*+", "")))
    block = F.array_join(F.transform("__bare", lambda n, i: F.concat(F.lit("[^"), (i + 1).cast("string"), F.lit("]: ("), (i + 1).cast("string"), F.lit(") "), n, F.lit("\n\n"))), "")
    more = F.array_join(F.filter(F.transform("__bare", lambda n, i: F.when(~without.contains(n), F.concat(F.lit("[^fn-"), (i + 1).cast("string"), F.lit("]: "), n, F.lit("\n")))), lambda x: x.isNotNull()), "")
    noted = F.when(F.size("__notes") == 0, t).when(without.contains("**الهوامش والحواشي"), F.concat(without, more)).otherwise(F.concat(trim(without), F.lit(NOTES_TITLE), block))
    return out.withColumn(column, noted).drop("__without", "__notes", "__bare", *([] if keep else ["__moved", "__missing"]))


def accuracy(detected: Column, corrected: Column) -> Column:
    """The share of examined passages that were right, in percent; can be negative, as corrections count occurrences."""
    return F.when(detected == 0, 100).otherwise(round_half_up((detected - corrected) / detected * 100)).cast("int")


SPACED = [*BRACKETS, Step(f"([^ \\t\\n\\r﴿])(﴿)", "$1 $2"), Step(f"(﴾)([^ \\t\\n\\r﴾,.!؟])", "$1 $2")]


def verify(df: DataFrame, canonical: DataFrame) -> DataFrame:
    """doc_id, text, detected, corrected, accuracy: rules, targets, then quoted passages against `canonical` (ord, normalized, text).

    A passage whose best match reads otherwise is replaced, its first occurrence, by the canonical reading. If the canonical text
    and its search key have different numbers of words a window has no reading, and the whole passage stands for it. Rows are told apart by
    themselves, whatever their doc_id: repaired texts are written once under a number of their own, to which edits come back. A null text stays null.
    """
    from parchwork.operators.fuzzy import best_matches, passages

    fixed = repair_targets(repair(df.select("doc_id", "text"), counter="__fixed")).drop("__fixed")
    fixed = materialize(fixed.withColumn("__row", F.monotonically_increasing_id()), "verify")
    found = passages(fixed.select(F.col("__row").alias("doc_id"), "text")).select(F.col("doc_id").alias("__row"), "n", "passage").withColumn("snippet_id", F.struct("__row", "n"))
    best = best_matches(found.select("snippet_id", F.col("passage").alias("text")), canonical.select("ord", "normalized"))
    words = canonical.select("ord", F.col("text").alias("canonical_text"), "normalized")
    matched = found.join(best, "snippet_id").join(words, "ord")
    reading = F.when(F.col("whole") | (F.size(F.split("canonical_text", " ")) != F.size(F.split("normalized", " "))), F.col("canonical_text")).otherwise(
        F.array_join(F.slice(F.split("canonical_text", " "), F.size(F.split(F.substring(F.concat(F.lit(" "), F.col("normalized"), F.lit(" ")), F.lit(1), F.position(F.concat(F.lit(" "), F.col("phrase"), F.lit(" ")), F.concat(F.lit(" "), F.col("normalized"), F.lit(" ")))), " ")) - 1, F.size(F.split("phrase", " "))), " ")
    )
    edits = matched.select("__row", "n", "passage", reading.alias("reading")).groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("n", "passage", "reading"))).alias("edits"))
    out = fixed.join(edits, "__row", "left").withColumn("edits", F.coalesce("edits", F.expr("cast(array() as array<struct<n:int,passage:string,reading:string>>)")))

    def put(t: Column, e: Column) -> Column:
        at = F.position(e["passage"], t)
        return F.when((at > 0) & (e["passage"] != e["reading"]), F.concat(F.substring(t, F.lit(1), at - 1), e["reading"], F.substring(t, at + F.length(e["passage"]), F.length(t)))).otherwise(t)

    wrong = F.size(F.filter("edits", lambda e: e["passage"] != e["reading"]))
    hits = F.aggregate("targets", F.lit(0), lambda n, t: n + t["count"])
    out = out.select("doc_id", rewrite(F.aggregate("edits", F.col("text"), put), SPACED).alias("text"), (F.size("edits") + F.size("targets")).alias("detected"), (wrong + hits).alias("corrected"))
    return out.withColumn("accuracy", accuracy(F.col("detected"), F.col("corrected")))


def keys_of(canonical: DataFrame) -> DataFrame:
    """`canonical` (ord, text) with normalized, its search key."""
    return canonical.withColumn("normalized", search_key(F.col("text")))
