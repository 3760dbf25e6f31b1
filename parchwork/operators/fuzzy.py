"""Fuzzy matching of quoted passages against a canonical table (FUZ).

Candidates come from an index that misses none of the matches that the floors allow; all joins are on pieces of text or words.
Where up to t letters of two whole texts differ, the longer one is cut into t + 1 pieces, and one of them stands in the other text as
it is, shifted by no more than its number (pigeonhole). A window of a passage keeps all of the snippet's grams but those that
the tolerated letters spoil, so passages are counted by shared grams. Where a share of the words must agree, the rarest few
words of the snippet, as many as may lack and one more, have one that the other text holds (prefix filter).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchwork.functions.text import search_key

#: A whole passage, or a window of its words, is taken from these similarities on.
WHOLE, WINDOW = 0.70, 0.78
#: The same in percent.
WHOLE_PERCENT, WINDOW_PERCENT = 70, 78
#: Letters in a piece at most, and in the grams that are counted before texts are compared.
PIECE, GRAM = 4, 3


def key_similarity(a: Column, b: Column) -> Column:
    """Of search keys: 1 if equal; at least 0.75 if one holds the other; else the larger of the overlap of words of two letters and more, and the share of letters that stay."""
    la, lb = F.length(a), F.length(b)
    longest, shortest = F.greatest(la, lb), F.least(la, lb)

    def tokens(x: Column) -> Column:
        return F.array_distinct(F.filter(F.split(x, " "), lambda w: F.length(w) > 1))

    common, union = F.size(F.array_intersect(tokens(a), tokens(b))), F.size(F.array_union(tokens(a), tokens(b)))
    overlap = F.when((F.size(tokens(a)) > 0) & (F.size(tokens(b)) > 0), common / union).otherwise(0.0)
    return (
        F.when((la == 0) | (lb == 0), 0.0).when(a == b, 1.0).when(F.contains(a, b) | F.contains(b, a), F.greatest(F.lit(0.75), shortest / longest))
        .otherwise(F.greatest(overlap, 1 - F.levenshtein(a, b) / longest))
    )


def key_similarity_sql(a: str, b: str) -> str:
    tokens = "list_distinct(list_filter(string_split({}, ' '), lambda w: length(w) > 1))"
    ta, tb = tokens.format(a), tokens.format(b)
    return (
        f"CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0 WHEN {a} = {b} THEN 1.0 WHEN contains({a}, {b}) OR contains({b}, {a}) THEN greatest(0.75, least(length({a}), length({b})) / greatest(length({a}), length({b}))::DOUBLE) "
        f"ELSE greatest(CASE WHEN len({ta}) > 0 AND len({tb}) > 0 THEN len(list_intersect({ta}, {tb})) / len(list_distinct(list_concat({ta}, {tb})))::DOUBLE ELSE 0 END, 1 - levenshtein({a}, {b}) / greatest(length({a}), length({b}))::DOUBLE) END"
    )


def passages(df: DataFrame, least: int = 4) -> DataFrame:
    """doc_id, n (from 0) and passage: what stands in quotation brackets, if it has `least` letters."""
    found = F.regexp_extract_all("text", F.lit("﴿([^﴾]+)﴾|«([^»]+)»"), F.lit(0))
    rows = df.select("doc_id", F.posexplode(found).alias("n", "quoted"))
    return rows.select("doc_id", "n", F.regexp_replace("quoted", "[﴿﴾«»]", "").alias("passage")).where(F.length("passage") >= least)


def _tolerated(length: Column, percent: int) -> Column:
    """How many of `length` letters may differ at a floor of `percent`."""
    return F.floor(length * (100 - percent) / 100).cast("int")


def _pieces(text: Column, tolerated: Column) -> Column:
    """(i, at, piece): `text` cut evenly into one piece more than letters are `tolerated`, numbered from 0."""
    n, k = F.length(text), tolerated + 1

    def cut(i: Column) -> Column:
        start, end = F.floor(i * n / k).cast("int"), F.floor((i + 1) * n / k).cast("int")
        return F.struct(i.alias("i"), start.alias("at"), F.substring(text, start + 1, end - start).alias("piece"))

    return F.transform(F.sequence(F.lit(0), k - 1), cut)


def _substrings(text: Column, sizes: range) -> Column:
    """(at, piece): all substrings of these lengths."""
    n = F.length(text)

    def of(size: int) -> Column:
        every = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.struct(i.alias("at"), F.substring(text, i + 1, F.lit(size)).alias("piece")))
        return F.when(n >= size, every).otherwise(F.expr("cast(array() as array<struct<at:int,piece:string>>)"))

    return F.concat(*map(of, sizes))


def _grams(text: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - GRAM + 1)), lambda i: F.substring(text, i, F.lit(GRAM))))


def _tokens(words: Column) -> Column:
    """Distinct words of two letters and more."""
    return F.array_distinct(F.filter(words, lambda w: F.length(w) > 1))


def _same_place(longer: DataFrame, shorter: DataFrame) -> DataFrame:
    """Pairs of whole texts of which the pieces of the longer one (text, other columns) stand in the shorter one in their place.

    Take the first piece up to which no more letters differ than its number says: it is unspoilt, just that many differ to
    its left, and no more than the rest to its right.
    """
    n, m, t = F.length("long"), F.length("short"), _tolerated(F.length("long"), WHOLE_PERCENT)
    pieces = longer.select("*", F.explode(_pieces(F.col("long"), t)).alias("x")).select("*", "x.i", "x.at", "x.piece").drop("x")
    held = shorter.select("*", F.explode(_substrings(F.col("short"), range(1, PIECE + 1))).alias("y")).select("*", F.col("y.at").alias("held_at"), "y.piece").drop("y")
    shift = F.col("held_at") - F.col("at")
    return pieces.join(held, "piece").where((n >= m) & (n - m <= t) & (F.abs(shift) <= F.col("i")) & (F.abs(shift + n - m) <= t - F.col("i")))


def candidates(keys: DataFrame, passages: DataFrame) -> DataFrame:
    """key, ord and windows (whether windows count, or the whole passage alone): each pair that may reach a floor, once.

    `keys` (key, of three letters and more) and `passages` (ord, normalized, not empty) have distinct rows. Whatever passage or
    window reaches its floor by letters, by words or by holding the other is in a pair here.
    """
    a, p = F.col("key"), F.col("normalized")
    as_key, as_passage = keys.select("key", a.alias("long")), passages.select("ord", p.alias("short"))
    whole = _same_place(as_key, as_passage).unionByName(_same_place(passages.select("ord", p.alias("long")), keys.select("key", a.alias("short")))).select("key", "ord")
    # a passage that the key holds: its beginning is one of the key's substrings
    begun = passages.select("ord", "normalized", F.substring(p, 1, PIECE).alias("piece"))
    held = keys.select("key", F.explode(F.array_distinct(F.transform(_substrings(a, range(1, PIECE + 1)), lambda x: x["piece"]))).alias("piece"))
    inside = begun.join(held, "piece").where(F.contains(a, p)).select("key", "ord")
    # windows, and passages that hold the key. A window has at most 1/0.78 of the key's letters, and each letter that differs spoils GRAM grams;
    # a key too short to keep any is cut into pieces
    tolerated = F.floor(F.length(a) * (100 - WINDOW_PERCENT) / WINDOW_PERCENT).cast("int")
    kept = F.size(_grams(a)) - GRAM * tolerated
    signs = F.when(kept > 0, _grams(a)).otherwise(F.array_distinct(F.transform(_pieces(a, tolerated), lambda x: x["piece"])))
    signed = keys.select("key", F.greatest(F.lit(1), kept).alias("least"), F.explode(signs).alias("piece"))
    indexed = passages.select("ord", F.explode(F.array_distinct(F.transform(_substrings(p, range(2, PIECE + 1)), lambda x: x["piece"]))).alias("piece"))
    near = signed.join(indexed, "piece").groupBy("key", "ord", "least").agg(F.count("*").alias("hits")).where("hits >= least").select("key", "ord")
    # words: the key's rarest
    said = passages.select("ord", F.explode(_tokens(F.split(p, " "))).alias("word"))
    often = said.groupBy("word").agg(F.count("*").alias("passages"))
    words = keys.select("key", F.explode(_tokens(F.split(a, " "))).alias("word")).join(often, "word", "left")
    ranked = words.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("passages", F.lit(0)).alias("passages"), "word"))).alias("words"))
    rare = ranked.select("key", F.explode(F.slice("words", F.lit(1), _tolerated(F.size("words"), WHOLE_PERCENT) + 1)).alias("w")).select("key", "w.word")
    by_words = rare.join(said, "word").select("key", "ord")
    found = whole.unionByName(inside).withColumn("windows", F.lit(False)).unionByName(near.unionByName(by_words).withColumn("windows", F.lit(True)))
    return found.groupBy("key", "ord").agg(F.max("windows").alias("windows"))


def best_matches(snippets: DataFrame, canonical: DataFrame) -> DataFrame:
    """The canonical passage closest to each snippet: snippet_id, ord, score, whole, phrase.

    `snippets`: snippet_id, text. `canonical`: ord, normalized (its search key). Matches are whole passages from 0.70 on
    and their windows of as many words as the snippet, one more and one less, from 0.78 on; the first of the best in order of
    ord, whole before windows, that size order and place. Snippets whose key has fewer than 3 letters match nothing, nor do null texts
    or null and empty passages. Equal keys are matched once. An empty table gives no rows.

    Only passages from `candidates` are compared, so work grows with what is alike, not with the product of both tables.
    """
    asked = snippets.select("snippet_id", search_key(F.col("text")).alias("key")).where(F.length("key") >= 3)
    keys = asked.groupBy("key").count().drop("count")
    passages = canonical.select("ord", "normalized").where(F.length("normalized") > 0).groupBy("ord", "normalized").count().drop("count")
    # as many partitions as any shuffle: comparing takes far longer than the pairs' bytes, by which adaptive execution would join them, let on
    n = int(snippets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = candidates(keys, passages).join(passages, "ord").repartition(n, "key", "ord")
    parts = _parts("normalized")
    pairs = pairs.select("key", "ord", "windows", "normalized", F.size(_parts("key")).alias("words"), parts.alias("parts"), F.filter(parts, lambda w: F.length(w) < 2).alias("letters"), _tokens(F.split("key", " ")).alias("tokens"))
    w, of = F.col("words"), F.size("parts")
    # whole passages are windows of rank -1
    sizes = F.array(F.struct(F.lit(-1).alias("rank"), of.alias("size")), F.struct(F.lit(0).alias("rank"), w.alias("size")), F.struct(F.lit(1).alias("rank"), (w + 1).alias("size")), F.struct(F.lit(2).alias("rank"), F.greatest(F.lit(1), w - 1).alias("size")))
    ranked = pairs.select("*", F.explode(sizes).alias("x")).select("*", "x.rank", "x.size").drop("x").where("rank < 0 or windows and words <= size(parts) and size <= size(parts) and not (words >= 2 and size < 2)")
    rows = ranked.select("*", F.explode(F.sequence(F.lit(1), of - F.col("size") + 1)).alias("at"))
    rows = rows.withColumn("said", F.slice("parts", F.col("at"), F.col("size")))
    whole = F.col("rank") < 0
    rows = rows.select("key", "ord", "tokens", "letters", "said", (~whole).cast("int").alias("kind"), "rank", "at", F.when(whole, F.col("normalized")).otherwise(F.array_join("said", " ")).alias("phrase"), (F.col("size") == of).alias("whole"))
    a, b, la, lb = F.col("key"), F.col("phrase"), F.length("key"), F.length("phrase")
    longest, shortest = F.greatest(la, lb), F.least(la, lb)
    tolerated = F.when(F.col("kind") == 0, _tolerated(longest, WHOLE_PERCENT)).otherwise(_tolerated(longest, WINDOW_PERCENT))
    # distinct words of two letters and more, in both and in the phrase; a column each, so that either is computed once
    parted = rows.withColumns({
        "common": F.size(F.array_intersect("tokens", "said")), "own": F.size(F.array_except("said", "letters")), "held": F.contains(a, b) | F.contains(b, a),
        "far": F.when(longest - shortest <= tolerated, F.call_function("levenshtein", a, b, tolerated)),  # -1: more than tolerated
    })
    overlap = F.when((F.size("tokens") > 0) & (F.col("own") > 0), F.col("common") / (F.size("tokens") + F.col("own") - F.col("common"))).otherwise(0.0)
    near = F.when(F.col("far") >= 0, 1 - F.col("far") / longest).otherwise(0.0)
    score = F.when(a == b, 1.0).when(F.col("held"), F.greatest(F.lit(0.75), shortest / longest)).otherwise(F.greatest(overlap, near))
    scored = parted.withColumn("score", score)
    enough = F.when(F.col("score") >= F.when(F.col("kind") == 0, WHOLE).otherwise(WINDOW), F.struct((-F.col("score")).alias("least"), "ord", "kind", "rank", "at", "whole", "phrase"))
    best = scored.groupBy("key").agg(F.min(enough).alias("b")).where("b is not null")
    return asked.join(best, "key").select("snippet_id", "b.ord", (-F.col("b.least")).alias("score"), "b.whole", "b.phrase")


def _parts(column: str) -> Column:
    return F.filter(F.split(column, " "), lambda w: w != "")
