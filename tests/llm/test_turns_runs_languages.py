"""Conversation repair, periodic runs and language ID against brute force, and on odd rows."""

import hashlib
import heapq
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from parchwork.llm import conversation_repair as repair
from parchwork.llm import language_id, periodic_runs

# Conversation repair ---------------------------------------------------------------------------------------------------
STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(rows):
    """(cost, letters) by Dijkstra over (row, grammar state), letters compared as strings."""
    seen, faults = set(), []
    for role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else None)
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], {}
    while heap:
        cost, audit, i, state, turns = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done[i, state] = True
        if i == len(rows) and state in ("", "a"):
            return cost, audit, turns, faults
        due = "a" if state == "u" else "u"
        name = {"a": "assistant", "u": "user"}[due]
        heapq.heappush(heap, (cost + 3, audit + "I", i, due, (*turns, (name, ""))))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, turns))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                if (state, role[:1]) in STEP:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, STEP[state, role[:1]], (*turns, (role, text))))
                heapq.heappush(heap, (cost + more + 3, audit + "R", i + 1, due, (*turns, (name, text))))


def told(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv long, edit string").drop("conv").withColumnRenamed("edit", "cost")
    return {r.conv_id: r for r in repair.digest(repair.repair(df)).collect()}


def test_repair_is_cheapest_and_least(spark):
    rng, rows, by = random.Random(3), [], {}
    for c in range(150):
        turns = [(rng.choice(["user", "assistant", "system", "tool", "u", ""]), rng.choice(["Yes.", "No!", "cut off", " ", "", "What?\n", f"n{rng.randint(0, 9)}."])) for _ in range(rng.randint(1, 9))]
        by[c] = turns
        rows += [(c, t, role, text, 0, "x") for t, (role, text) in enumerate(turns)]
    rng.shuffle(rows)
    out = told(spark, rows)
    for c, turns in by.items():
        cost, audit, left, faults = cheapest(turns)
        r = out[c]
        assert (r.cost, r.audit) == (cost, audit), turns
        assert r.repaired_sha256 == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in left).encode()).hexdigest()
        assert (r.blank, r.duplicate, r.truncated) == tuple(faults.count(f) for f in ("blank", "duplicate", "truncated"))
        assert r.illegal == sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))


def test_repair_of_odd_rows(spark):
    rows = [(None, 1, "user", "Hi."), (None, None, "assistant", "Ho."), (1, 4, None, None), (2, 9, "user", "a."), (2, 9, "user", "a."), (2, 12, "assistant", "b." * 100_000), (3, None, "user", "x.")]
    out = told(spark, [(*r, 0, "x") for r in rows])
    assert out[None].audit == "IKKI" and out[None].gaps == 0  # the row without a turn, the assistant's, comes first
    assert (out[1].audit, out[1].blank, out[1].repaired_sha256) == ("D", 1, hashlib.sha256(b"").hexdigest())
    assert (out[2].audit, out[2].gaps, out[2].duplicate) == ("KDK", 2, 1)
    assert (out[3].audit, out[3].cost, out[3].gaps) == ("KI", 3, 0)
    assert told(spark, []) == {}
    many = [(7, t, "user" if t % 2 == 0 else "assistant", "Same.", 0, "x") for t in range(3000)]
    assert told(spark, many)[7].audit == "KK" + "D" * 2998


def test_repair_query_keeps_every_conversation(spark, tmp_path):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for c in range(80) for t in range(2)] + [(None, None, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    out = {r.conv_id: r for r in repair.op11_conversation_repair(spark, str(tmp_path)).collect()}
    assert set(out) == {*range(80), None}
    gone = [c for c in range(80) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 == 0 for t in range(2))]
    for c in range(80):
        kinds = [zlib.crc32(f"{c}:{t}".encode()) % 20 for t in range(2)]
        left = sum({0: 0, 3: 2}.get(k, 1) for k in kinds)
        assert len(out[c].audit.replace("I", "")) == left
    assert all(out[c].audit == "" and out[c].cost == 0 for c in gone)


# Periodic runs -----------------------------------------------------------------------------------------------------------
def runs_by_definition(w):
    found = set()
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(24, 3 * q) and not any(w[i : i + n - d] == w[i + d : i + n] for d in range(1, q)):
                found.add((i, n, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_by_definition():
    rng = random.Random(11)
    for k in range(300):
        n = rng.randint(0, 110)
        w = [rng.choice([b"a", b"b", b"c", b"d"][: 2 + k % 3]) for _ in range(n)]
        if n and k % 2:
            q, at = rng.randint(1, 25), rng.randrange(n)
            for i in range(at + q, n):
                w[i] = w[i - q]
        assert periodic_runs.runs_of(w) == runs_by_definition(w)
    many = [str(k).encode() for k in range(5000)]
    assert periodic_runs.runs_of(many) == [] and periodic_runs.runs_of(many[:1000] * 3) == [(0, 3000, 1000)]
    assert list(periodic_runs.groups(0b1100101)) == [(0, 1), (2, 1), (5, 2)]


def test_runs_query_by_definition(spark, tmp_path):
    rng = random.Random(2)
    rows = [(d, " ".join(rng.choices(["x", "y", "zz", "w w"], k=rng.randint(0, 200)))) for d in range(200)]
    rows += [(1000, None), (1001, ""), (1002, " \t\n "), (1003, "one"), (1004, "a " * 30_000), (None, "b " * 40), (1003, "one")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for d, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(w), zlib.crc32(str(d).encode()) if d is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = runs_by_definition(w) if n < 1000 else [(0, n, 1)]
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((d, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    got = [tuple(r) for r in periodic_runs.op12_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_runs_keep_other_columns(spark):
    df = spark.createDataFrame([(1, "a " * 24, 5, 6)], "doc_id long, text string, runs long, other long")
    r = periodic_runs.periodic_runs(df).collect()[0]
    assert (r.other, r.n_words, [tuple(x) for x in r.runs], r.collapsed) == (6, 24, [(0, 24, 1)], "a")
    assert periodic_runs.periodic_runs(df.where("false")).count() == 0


# Language ID ---------------------------------------------------------------------------------------------------------------
def test_codewords_lie_apart():
    for k in (3, 4, 5, 7, 8, 9, 16, 40):
        codes = language_id.codewords(k)
        apart = [(codes[i] != codes[j]).sum() for i in range(k) for j in range(i)]
        assert min(apart) >= (1 << (k - 2) if k <= 7 else 1 << ((k - 1).bit_length() - 1))
        assert (np.abs(codes.sum(axis=0)) < k).all()  # no bit is the same for all
    assert language_id.codewords(1).shape == (1, 0)


def test_wrong_bits_are_outvoted():
    codes = language_id.codewords(5)
    for k in range(5):
        for bad in range(codes.shape[1]):
            margins = codes[k] * 3.0
            margins[bad] *= -1
            assert language_id.decode(codes, margins[None, :], 1.0)[0].argmax() == k


SYLLABLES = {"aa": ["the", "ing", "and", "er"], "bb": ["sch", "ein", "ung", "ü"], "cc": ["eau", "que", "ç", "ment"], "dd": ["ción", "ñ", "ll", "os"], "ee": ["щ", "ой", "ть", "на"]}


def made(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, lang string, text string")


def test_languages_are_told_apart(spark, tmp_path):
    rng = random.Random(9)
    rows = []
    for d in range(1500):
        lang = rng.choice(list(SYLLABLES) + ["aa"] * 8)
        rows.append((d, lang, " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(3, 60))).title()))
    odd = [(5000, None, None), (5001, "aa", ""), (5002, None, "12 34 -- !"), (5003, None, "щой " * 300_000), (None, "zz", "the and"), (5004, None, "the ing and er the"), (5004, None, "the ing and er the")]
    made(spark, rows + odd).write.parquet(str(tmp_path / "documents.parquet"))
    out = language_id.op13_language_id(spark, str(tmp_path)).collect()
    assert len(out) == len(rows) + len(odd)
    by, lang = {r.doc_id: r for r in out}, {d: name for d, name, _ in rows}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out if r.doc_id is not None) and not by[None].held_out
    held = [r for r in out if r.held_out and r.doc_id in lang]
    assert len(held) > 300 and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.99 * len(held)
    assert {by[d].lang_pred for d in (5000, 5001, 5002)} == {"und"} and by[5000].score == 0 and by[5003].lang_pred == "ee"
    assert all(0 <= r.score <= 1 and r.lang_pred != "zz" for r in out)


def test_language_models_of_few_rows(spark):
    one = made(spark, [(1, "aa", "the and"), (2, "aa", "ing er"), (3, None, "x"), (None, "bb", "y")])
    r = language_id.identify(one, language_id.train(one)).collect()
    assert {x.lang_pred for x in r} == {"aa"} and {x.score for x in r} == {1.0} and not any(x.ambiguous for x in r)
    nothing = made(spark, [(1, None, "the and")])
    assert language_id.train(nothing) is None and language_id.identify(nothing, None).collect()[0].lang_pred == "und"
    assert language_id.identify(one.where("false"), language_id.train(one)).count() == 0
    extra = one.withColumn("score", F.lit("old"))
    assert language_id.identify(extra, None).schema["score"].dataType.simpleString() == "double"
