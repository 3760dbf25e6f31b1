"""Conversation structure repair: the cheapest edits that make turns alternate, and the turns that they leave.

A conversation's role initials must read (s?(ua)+)?. Keeping a row costs nothing, giving it the role that is due 3,
deleting it 4, inserting an empty turn 3; a cut-off row that stays costs 3 more, blank and repeated rows must go.
One pass from the last row to the first leaves with each row what it costs to finish behind it, in each of the
grammar's four states; one pass forward takes, of the edits on a cheapest way, the one whose letter comes first.
Both passes stream over sorted rows of one exchange: a task holds four numbers of a conversation, never its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchwork.llm._memory import tidy

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
_SPACE = " \t\n\x0b\x0c\r"
#: States: nothing yet, behind s, behind u, behind a. What a role's initial leads to, and the role that may be made up.
_KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_DUE = ((2, "user"), (2, "user"), (3, "assistant"), (2, "user"))
#: What it costs to finish behind the last row.
_END = (0, 6, 3, 0)
_FAR = 1 << 60
LEGAL = frozenset({"su", "ua", "au"})


def fault_of(text: str, repeated: bool) -> str | None:
    """A row's first fault: blank, duplicate or truncated."""
    seen = text.rstrip(_SPACE)
    return "blank" if not seen else "duplicate" if repeated else "truncated" if seen[-1] not in ".!?" else None


def before(ahead: tuple[int, ...], initial: str, fault: str | None) -> tuple[int, ...]:
    """The cost to finish in front of a row, in each state, from the cost behind it."""
    here = [DELETE + v for v in ahead]
    if fault in (None, "truncated"):
        more = TRUNCATED if fault else 0
        for s in range(4):
            here[s] = min(here[s], more + ahead[_KEEP[s, initial]] if (s, initial) in _KEEP else _FAR, REROLE + more + ahead[_DUE[s][0]])
    u, a = here[2], here[3]
    here[2], here[3] = min(u, INSERT + a), min(a, INSERT + u)
    return (min(here[0], INSERT + here[2]), min(here[1], INSERT + here[2]), here[2], here[3])


def walk(state: int, ahead: tuple[int, ...], role: str, fault: str | None) -> Iterator[tuple[str, str | None, int]]:
    """(edit, role, state behind it) of the edits at a row; the last one is the row's own."""
    here = before(ahead, role[:1], fault)
    more = TRUNCATED if fault == "truncated" else 0
    while True:
        due, made = _DUE[state]
        if here[state] == DELETE + ahead[state]:
            yield "D", None, state
            return
        if here[state] == INSERT + here[due]:
            state = due
            yield "I", made, state
            continue
        kept = _KEEP.get((state, role[:1]))
        if kept is not None and here[state] == more + ahead[kept]:
            yield "K", role, kept
        else:
            yield "R", made, due
        return


def finish(state: int) -> Iterator[tuple[str, str]]:
    while _END[state]:
        state, made = _DUE[state]
        yield "I", made


_NEW = object()


class _Turn(NamedTuple):
    conv_id: int | None
    turn: int | None
    role: str
    text: str
    copies: int
    later: bool

    def faults(self) -> list[str | None]:
        """Of each copy, in order: all but the first are repeated."""
        first = fault_of(self.text, self.later)
        return [first] + ["blank" if first == "blank" else "duplicate"] * (self.copies - 1)


_TURN = ["conv_id", "turn", "role", "text", "copies", "later"]


def _turns(batch: pa.RecordBatch) -> Iterator[_Turn]:
    return map(_Turn._make, zip(*(batch.column(name).to_pylist() for name in _TURN), strict=True))


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, cost = _NEW, _END
    for batch in batches:
        behind = []
        for row in _turns(batch):
            if row.conv_id != now:
                now, cost = row.conv_id, _END
            cost = tuple(v + DELETE * (row.copies - 1) for v in cost)  # repeated copies must go
            behind.append(cost)
            cost = before(cost, row.role[:1], fault_of(row.text, row.later))
        yield batch.append_column("ahead", pa.array(behind, pa.list_(pa.int64())))


_EDIT = pa.schema([
    ("conv_id", pa.int64()), ("step", pa.int64()), ("edit", pa.string()), ("cost", pa.int64()), ("turn", pa.int64()), ("role_before", pa.string()), ("fault", pa.string()), ("role", pa.string()), ("text", pa.string()),
])
EDIT = T.StructType([T.StructField(f.name, T.LongType() if f.type == pa.int64() else T.StringType()) for f in _EDIT])


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, state, step = _NEW, 0, 0
    for batch in batches:
        out: list[tuple] = []
        for row, ahead in zip(_turns(batch), batch.column("ahead").to_pylist(), strict=True):
            if row.conv_id != now:
                if now is not _NEW:
                    out += [(now, step + k, edit, INSERT, None, None, None, role, "") for k, (edit, role) in enumerate(finish(state))]
                now, state, step = row.conv_id, 0, 0
            for k, fault in enumerate(row.faults()):
                left = tuple(v - DELETE * k for v in ahead)
                for edit, role, state in walk(state, left, row.role, fault):  # noqa: B020
                    if edit == "I":
                        out.append((now, step, edit, INSERT, None, None, None, role, ""))
                    else:
                        cost = DELETE if edit == "D" else REROLE * (edit == "R") + TRUNCATED * (fault == "truncated")
                        out.append((now, step, edit, cost, row.turn, row.role, fault, role, None if edit == "D" else row.text))
                    step += 1
        yield _edits(out)
    if now is not _NEW:
        yield _edits([(now, step + k, edit, INSERT, None, None, None, role, "") for k, (edit, role) in enumerate(finish(state))])


def _edits(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(_EDIT)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _EDIT, strict=True)], schema=_EDIT)


def repair(df: DataFrame) -> DataFrame:
    """The edits of each conversation: conv_id, step (from 0), edit (K, R, D, I), cost, turn, role_before, fault, role, text.

    `df` has conv_id, turn, role and text; other columns are ignored. Rows go by turn, then role and text, nulls first. A null
    role or text is empty; rows of null conv_id form one conversation. What is left are the rows whose edit isn't D:
    their role and text are the repaired turns. turn, role_before and fault are null for inserted turns, role and text for
    deleted ones. A role whose initial isn't s, u or a can't be kept. A conversation's edits stand together and in order
    in one partition. Of equal rows all but one are repeated: they are counted before rows are exchanged. Texts are never held: a
    conversation of any length passes through as a stream. An empty table gives no rows.
    """
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text")}
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(c.alias(name) for name, c in text.items()))
    turns = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    # only what is said more than once in a conversation has a row here
    said = rows.groupBy("conv_id", "role", "text").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n")).where("n > 1")
    said = said.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("text").alias("t"), "first")
    on = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("text") == F.col("t"))
    later = F.coalesce(~F.col("first").eqNullSafe(F.struct("turn")), F.lit(False)) & F.col("first").isNotNull()
    keyed = turns.join(said, on, "left").select("conv_id", "turn", "role", "text", "copies", later.alias("later")).repartition("conv_id")
    costed = T.StructType([*keyed.schema.fields, T.StructField("ahead", T.ArrayType(T.LongType()))])
    down = keyed.sortWithinPartitions("conv_id", F.desc_nulls_last("turn"), F.desc("role"), F.desc("text")).mapInArrow(tidy(_backward), costed)
    return down.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text").mapInArrow(tidy(_forward), EDIT)


class _Digest:
    """What is told of a conversation, from its edits in order."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.faults, self.illegal, self.cost, self.audit = conv_id, {"blank": 0, "duplicate": 0, "truncated": 0}, 0, 0, []
        self.least = self.most = None
        self.distinct, self.last, self.hash, self.any = 0, None, hashlib.sha256(), False

    def add(self, edit: str, cost: int, turn: int | None, was: str | None, fault: str | None, role: str | None, text: str | None) -> None:
        self.audit.append(edit)
        self.cost += cost
        if edit != "I":
            if fault:
                self.faults[fault] += 1
            if self.last is not None and self.last + was[:1] not in LEGAL:
                self.illegal += 1
            self.last = was[:1]
            if turn is not None and turn != self.most:
                self.least, self.most, self.distinct = turn if self.least is None else self.least, turn, self.distinct + 1
        if edit != "D":
            self.hash.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
            self.any = True

    def row(self) -> tuple:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.distinct
        return (self.conv_id, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


_TOLD = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
_COUNTS = _TOLD[1:7]


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: _Digest | None = None
    for batch in batches:
        out = []
        for conv_id, *edit in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "edit", "cost", "turn", "role_before", "fault", "role", "text")), strict=True):
            if now is None or now.conv_id != conv_id:
                out += [] if now is None else [now.row()]
                now = _Digest(conv_id)
            now.add(*edit)
        yield _told(out)
    yield _told([] if now is None else [now.row()])


def _told(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(_TOLD)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if name in ("audit", "repaired_sha256") else pa.int64()) for name, c in zip(_TOLD, columns, strict=True)], names=_TOLD)


def digest(edits: DataFrame) -> DataFrame:
    """A row for each conversation from the edits of `repair`, which stand in order: counts, the letters and a hash of the repaired turns."""
    return edits.mapInArrow(tidy(_digest), "conv_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string")


def damage(rows: DataFrame) -> DataFrame:
    """`rows` (conv_id, turn, role, text) after the query's damage by crc32 of `conv_id:turn`; nulls are one space there and in role and text."""
    kind = F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    hit = rows.withColumn("kind", kind).select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(role).alias("role"), text.alias("text"), copies.alias("n"))
    return hit.withColumn("n", F.explode(F.array_repeat(F.lit(1), F.col("n")))).drop("n")


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired; one without rows after the damage has zeros, no letters and the empty hash."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    told = digest(repair(damage(rows))).withColumnRenamed("conv_id", "found")
    every = rows.select("conv_id").distinct().join(told, F.col("conv_id").eqNullSafe(F.col("found")), "left")
    return every.select(
        "conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _COUNTS),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


ORACLE_SQL = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT) AS b FROM conversations),
kinds AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, b), lambda h, c: xor(h >> 8, t[(xor(h, c) & 255) + 1])), 4294967295) % 20 AS kind FROM named, crc),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM kinds, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
             left(role, 1) AS c, right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) AS fin FROM damaged),
rows_ AS (SELECT *, CASE WHEN fin = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN fin NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM numbered),
costs AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000 ELSE 0 END + CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS stay FROM rows_),
back AS (
  SELECT conv_id, max(n) AS i, [0, 6, 3, 0]::BIGINT[] AS v FROM costs GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, [least(a, 3 + u, 3 + 3 + w), least(b, 3 + u, 3 + 3 + w), least(u, 3 + w), least(w, 3 + u)]
  FROM (SELECT back.conv_id, back.i - 1 AS i,
          least(4 + v[1], stay + CASE c WHEN 's' THEN v[2] WHEN 'u' THEN v[3] ELSE 1000000 END, 3 + stay + v[3]) AS a,
          least(4 + v[2], stay + CASE c WHEN 'u' THEN v[3] ELSE 1000000 END, 3 + stay + v[3]) AS b,
          least(4 + v[3], stay + CASE c WHEN 'a' THEN v[4] ELSE 1000000 END, 3 + stay + v[4]) AS u,
          least(4 + v[4], stay + CASE c WHEN 'u' THEN v[3] ELSE 1000000 END, 3 + stay + v[3]) AS w
        FROM back JOIN costs ON costs.conv_id IS NOT DISTINCT FROM back.conv_id AND costs.i = back.i)),
moves AS (SELECT b.conv_id, b.i, b.v, x.v AS ahead, c.role, c.c, c.text, c.stay FROM back b LEFT JOIN back x ON x.conv_id IS NOT DISTINCT FROM b.conv_id AND x.i = b.i + 1 LEFT JOIN costs c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND c.i = b.i + 1),
fwd AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS s, 0 AS step, '' AS edit, '' AS said FROM costs WHERE i = 1
  UNION ALL
  SELECT conv_id, i + (edit <> 'I')::INT, CASE WHEN edit = 'D' THEN s WHEN edit = 'K' AND c = 's' THEN 1 WHEN s = 2 THEN 3 ELSE 2 END, step + 1, edit,
         CASE edit WHEN 'D' THEN '' WHEN 'K' THEN role || ':' || text ELSE CASE WHEN s = 2 THEN 'assistant:' ELSE 'user:' END || CASE edit WHEN 'R' THEN text ELSE '' END END
  FROM (SELECT f.conv_id, f.i, f.s, f.step, m.role, m.c, m.text,
          CASE WHEN m.v[f.s + 1] = 4 + m.ahead[f.s + 1] THEN 'D' WHEN m.v[f.s + 1] = 3 + m.v[CASE f.s WHEN 2 THEN 4 ELSE 3 END] THEN 'I' WHEN m.ahead IS NULL THEN 'end'
               WHEN (m.c = 's' AND f.s = 0 AND m.v[1] = m.stay + m.ahead[2]) OR (m.c = 'u' AND f.s <> 2 AND m.v[f.s + 1] = m.stay + m.ahead[3]) OR (m.c = 'a' AND f.s = 2 AND m.v[3] = m.stay + m.ahead[4]) THEN 'K' ELSE 'R' END AS edit
        FROM fwd f JOIN moves m ON m.conv_id IS NOT DISTINCT FROM f.conv_id AND m.i = f.i) WHERE edit <> 'end'),
told AS (SELECT conv_id, string_agg(edit, '' ORDER BY step) AS audit, sha256(coalesce(string_agg(said, chr(10) ORDER BY step) FILTER (edit <> 'D' AND step > 0), '')) AS h FROM fwd GROUP BY conv_id),
pairs AS (SELECT *, lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS pair FROM costs),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
       coalesce(b.v[1], 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN back b ON b.conv_id IS NOT DISTINCT FROM o.conv_id AND b.i = 0
"""
