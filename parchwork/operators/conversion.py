"""Work that may fail row by row, and what an outside model may add (SCH-3, SCH-7, AI-1 to AI-3), tables of contents (STR-13), labels and archives.

No model comes with the engine. A model is a function of a list of texts; without one each stage keeps its input.
"""

from __future__ import annotations

import io
import time
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchwork.functions.dialect import BLANKS, END, EOL, S, trim
from parchwork.functions.text import MARKER

#: Characters of a text that the contextual and the grammar check see.
CONTEXT_HEAD, GRAMMAR_TAIL = 32_000, 15_000
MADANI = "سورة البقرة وآل عمران والنساء والمائدة (ما اشتمل على تفصيل الفرائض والحدود وأحكام التشريع والجهاد)"


def context_part(text: Column) -> Column:
    return F.substring(text, 1, CONTEXT_HEAD)


def grammar_part(text: Column) -> Column:
    return F.substring(text, F.greatest(F.lit(1), F.length(text) - GRAMMAR_TAIL + 1), F.lit(GRAMMAR_TAIL))


def server_wait(attempt: int) -> float:
    """Seconds before the next of ten rounds, without jitter."""
    return min(10.0, 1.5 + 1.2 * attempt)


#: Seconds of cooldown up to which the server waits itself; beyond, the client is told to.
OWN_WAIT = 10


def server_round(attempt: Column, cooldown: Column, jitter: Column) -> Column:
    """What a round of retries does: (pause, action, seconds). `attempt` counts from 0, `cooldown` are the seconds until the first
    model is ready (0 or less: one is), `jitter` at most half a second.

    From the second round on there is a pause. With no model ready the round waits out a short cooldown, and hands a long one
    to the client, who gets status 429 and the seconds to wait.
    """
    pause = F.when(attempt > 0, F.least(F.lit(10.0), 1.5 + 1.2 * attempt + jitter)).otherwise(F.lit(0.0))
    wait = F.greatest(F.lit(1), F.ceil(cooldown)).cast("int")
    action = F.when(cooldown <= 0, "send").when(wait <= OWN_WAIT, "wait").otherwise("delegate")
    return F.struct(pause.alias("pause"), action.alias("action"), F.when(cooldown > 0, wait + 1).alias("seconds"))


def each_row(df: DataFrame, column: str, work: Callable[[str], str] | None, attempts: int = 10, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """`df` with `answer`, `status` ('done', 'failed' or 'offline') and `error`: `work` on each row's `column`, tried again on errors.

    A row that fails is told by its status and costs no other row; rows are worked on by as many tasks as `df` has partitions.
    """
    df = df.drop("answer", "status", "error")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers, states, errors = [], [], []
            for value in batch.column(column).to_pylist():
                answer, state, error = value, "offline" if work is None else "failed", None
                for k in range(attempts if work is not None else 0):
                    try:
                        answer, state, error = work(value), "done", None
                        break
                    except Exception as e:  # noqa: BLE001  any error of the outside function is the row's
                        error = f"{type(e).__name__}: {e}"
                        if k + 1 < attempts:
                            sleep(server_wait(k))
                answers.append(answer)
                states.append(state)
                errors.append(error)
            yield batch.append_column("answer", pa.array(answers, pa.string())).append_column("status", pa.array(states, pa.string())).append_column("error", pa.array(errors, pa.string()))

    return df.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", answer string, status string, error string")


def merged_findings(own: DataFrame, assistant: DataFrame) -> DataFrame:
    """Findings (doc_id, cut_text, completion): one's own, and the assistant's whose text isn't among them."""
    return own.select("doc_id", "cut_text", "completion").unionByName(assistant.join(own.select("doc_id", "cut_text"), ["doc_id", "cut_text"], "left_anti").select("doc_id", "cut_text", "completion"))


CONTENTS = f"(?iu)#+{S}*(?:الفهرس|فهرس{S}+المحتويات|جدول{S}+المحتويات)[^\\n]*\\n+(\\|?[^\\n]+\\|\\n\\|?[-:{BLANKS}|]+\\|\\n(?:\\|[^\\n]+\\|\\n*+)++)"


def calibrated_contents(df: DataFrame, column: str = "text", told: str | None = None) -> DataFrame:
    """`df` with the page numbers of the table of contents in `column` put right, and `moved`, how many were wrong; `told` names a
    column for (old, new, topic) of each.

    A topic's page is the number of page breaks or rules between the table and its first heading or bold mention, plus 2. Topics are
    matched literally, whatever signs they hold.
    """
    t = F.col(column)
    found = df.withColumn("__table", F.when(t.rlike(CONTENTS), F.regexp_extract(t, CONTENTS, 1)).otherwise("")).withColumn("__from", F.when(t.rlike(CONTENTS), F.regexp_instr(t, F.lit(CONTENTS))))
    has = F.col("__table") != ""
    whole = F.regexp_extract(t, CONTENTS, 0)
    found = found.withColumn("__rest", F.when(has, F.substring(t, F.col("__from") + F.length(whole), F.length(t))))
    rows = F.slice(F.split(trim(F.col("__table")), "\n"), 3, 1 << 20)

    def moved(row: Column) -> Column:
        cells = F.filter(F.transform(F.split(row, "\\|", -1), trim), lambda c: c != "")
        topic, listed = F.try_element_at(cells, F.lit(1)), F.regexp_replace(F.try_element_at(cells, F.lit(2)), "[^0-9]", "").try_cast("int")
        term = trim(F.regexp_replace(topic, f"\\A(?:سورة|الموضوع{S}+{S.replace('[', '[^')}+:?|مبحث){S}*", ""))
        at = F.regexp_instr(F.col("__rest"), F.concat(F.lit(f"(?iu)(?:#+{S}*|\\*\\*{S}*)\\Q"), term, F.lit("\\E")))
        page = F.regexp_count(F.substring(F.col("__rest"), F.lit(1), at - 1), F.lit(f"(?:\\A|\\n){MARKER}|(?:\\A|\\n)---(?:\\n|\\z)")) + 2
        new = F.concat(F.lit("| "), topic, F.lit(" | "), page.cast("string"), F.lit(" |"))
        return F.when((F.size(cells) >= 2) & (at > 0) & (listed > 0) & (listed != page), F.struct(row.alias("old"), new.alias("new"), topic.alias("topic")))

    edits = F.filter(F.transform(rows, moved), lambda e: e.isNotNull())
    found = found.withColumn("__edits", F.when(has, edits).otherwise(F.expr("cast(array() as array<struct<old:string,new:string,topic:string>>)")))

    def put(text: Column, e: Column) -> Column:
        at = F.position(e["old"], text)
        return F.concat(F.substring(text, F.lit(1), at - 1), e["new"], F.substring(text, at + F.length(e["old"]), F.length(text)))

    return found.withColumns({column: F.aggregate("__edits", t, put), "moved": F.size("__edits"), told or "__edits": F.col("__edits")}).drop("__table", "__from", "__rest", "__edits")


EMPTY_CELL = f"\\|{S}*([^|\\n]*المكي[^|\\n]*)\\|{S}*\\|{S}*{EOL}"


def completed_comparison(text: Column) -> Column:
    """The empty right cell of the first row that has the left one of a known comparison."""
    return F.regexp_replace(text, f"(?s)\\A(.*?)(?:{EMPTY_CELL})", "$1| $2 | " + MADANI + " |")


# Month names, digits and the words of a date label.
MONTHS = ("يناير", "فبراير", "مارس", "أبريل", "مايو", "يونيو", "يوليو", "أغسطس", "سبتمبر", "أكتوبر", "نوفمبر", "ديسمبر")
DIGITS, TODAY = "٠١٢٣٤٥٦٧٨٩", "اليوم، "


def date_label(time_: Column, today: Column) -> Column:
    """The word for today, or day and month, and the time, in Arabic digits."""
    month = F.element_at(F.array(*map(F.lit, MONTHS)), F.month(time_))
    clock = F.concat(F.date_format(time_, "hh:mm"), F.when(F.hour(time_) < 12, " ص").otherwise(" م"))
    day = F.when(F.to_date(time_) == today, TODAY).otherwise(F.concat(F.dayofmonth(time_).cast("string"), F.lit(" "), month, F.lit("، ")))
    said = F.concat(day, clock)
    return F.translate(said, "0123456789", DIGITS)


def archives(df: DataFrame) -> DataFrame:
    """archive_id and zip: the rows (archive_id, name, content) of each archive as one file, in order of name; names that repeat get a number.

    An archive is one value: it must fit in a task's memory, as a download does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for files in batch.column("files").to_pylist():
                out, seen = io.BytesIO(), {}
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                    for f in files:
                        k = seen[f["name"]] = seen.get(f["name"], 0) + 1
                        stem, dot, end = (f["name"] or "").rpartition(".")
                        z.writestr(zipfile.ZipInfo(f["name"] if k == 1 else f"{stem} ({k}){dot}{end}", (1980, 1, 1, 0, 0, 0)), f["content"] or b"")
                made.append(out.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column("archive_id"), pa.array(made, pa.binary())], names=["archive_id", "zip"])

    grouped = df.groupBy("archive_id").agg(F.sort_array(F.collect_list(F.struct("name", "content"))).alias("files"))
    return grouped.mapInArrow(run, f"archive_id {dict(df.dtypes)['archive_id']}, zip binary")


# Lines of a package's summary.
PACKAGE_RULE, PACKAGE_LINE = "=======================================================", "-------------------------------------------------------"
PACKAGE_HEAD = ("تقرير حزمة تحويل المستندات المتتالية (Batch Word Package)", "تاريخ التصدير: ", "اتجاه المستندات: من اليمين لليسار (RTL معتمد 100%)")
PACKAGE_ITEM = (". ", ".docx — [", " صفحة] — تطابق تام 1:1 مع أصل الـ PDF")
PACKAGE_TOTALS = ("إجمالي المستندات المحولة: ", " ملف", "إجمالي عدد الصفحات: ", " صفحة", "كافة المستندات مهيأة بتنسيق Microsoft Word الأصلي مع اتجاه اليمين لليسار.")


def package_summaries(items: DataFrame, dated: Column) -> DataFrame:
    """archive_id, documents, pages, failed and summary, the text that goes with an archive, of `items` (archive_id, ord, name, pages, done).

    Only items that are done are listed, in order; one without a page count, or of none, counts as one page. `failed` are the others.
    An archive without a done item has no summary. `dated` is the date as it is shown.
    """
    done = F.coalesce(F.col("done"), F.lit(False))
    pages = F.when(F.col("pages") > 0, F.col("pages")).otherwise(1).cast("long")
    row = F.struct("ord", F.regexp_replace("name", f"\\.[^/.]+{END}", "").alias("name"), pages.alias("pages"))
    grouped = items.groupBy("archive_id").agg(F.sort_array(F.collect_list(F.when(done, row))).alias("items"), F.count(F.when(~done, 1)).alias("failed"))
    before, between, after = PACKAGE_ITEM
    lines = F.transform("items", lambda x, i: F.concat((i + 1).cast("string"), F.lit(before), x["name"], F.lit(between), x["pages"].cast("string"), F.lit(after)))
    n, total = F.size("items").cast("long"), F.aggregate("items", F.lit(0).cast("long"), lambda s, x: s + x["pages"])
    title, date, direction = PACKAGE_HEAD
    a, b, c, d, last = PACKAGE_TOTALS
    text = F.concat_ws(
        "\n", F.lit(PACKAGE_RULE), F.lit(title), F.concat(F.lit(date), dated), F.lit(direction), F.lit(PACKAGE_RULE + "\n"), F.array_join(lines, "\n"), F.lit("\n" + PACKAGE_LINE),
        F.concat(F.lit(a), n.cast("string"), F.lit(b)), F.concat(F.lit(c), total.cast("string"), F.lit(d)), F.lit(last), F.lit(PACKAGE_LINE),
    )
    return grouped.select("archive_id", n.alias("documents"), total.alias("pages"), "failed", F.when(n > 0, text).alias("summary"))


def repeated_lines(df: DataFrame) -> DataFrame:
    """doc_id, line_no, line: lines of 5 to 50 characters that follow their equal, blank lines aside."""
    lines = df.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line")).where("line <> ''")
    before = F.lag("line").over(Window.partitionBy("doc_id").orderBy("n"))
    return lines.withColumn("before", before).where((F.col("line") == F.col("before")) & F.length("line").between(5, 50)).select("doc_id", (F.col("n") + 1).alias("line_no"), "line")
