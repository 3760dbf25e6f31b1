import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parchwork.llm import chat, decontamination, html_extraction, quality, topk


def test_contamination_equals_brute_force(spark, documents, monkeypatch):
    rng = random.Random(0)
    words = ["a", "B", "ç", "d1", "e-f", "x_y", "漢", "Z"]
    say = lambda n: rng.choice([" ", ", ", "\n", " -- "]).join(rng.choice(words) for _ in range(n))
    items = [(i, say(rng.choice([0, 1, 5, 12, 30]))) for i in range(12)] + [(50, None), (51, "!!"), (52, "a B"), (52, "a B"), (None, "a")]
    rows = [(i, " ".join(filter(None, [say(10), rng.choice(items)[1], say(5)]))) for i in range(60)] + [(100, None), (101, ""), (102, "A b"), (103, "a b " * 20_000)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 22, 100):  # one automaton, and several
        monkeypatch.setattr(decontamination, "AUTOMATON_BYTES", size)
        got = {r.doc_id: r for r in decontamination.find_contamination(documents(rows), bench).collect()}
        for i, t in rows[:-1]:
            n, hit, k, _ = decontamination.brute_force(t, [x for x in items if x[0] is not None])
            r = got[i]
            assert (r.n_words, sum(x["last"] - x["first"] for x in r.ranges), len(r.items)) == (n, hit, k)
            assert all(t[s.start : s.end].strip() == t[s.start : s.end] for s in r.spans) and len(r.spans) == len(r.ranges)
        assert got[103].n_words == 40_000 and 52 in got[103].items
    clean = decontamination.decontaminate(documents(rows), bench)
    assert clean.columns == documents([]).columns and {r.doc_id for r in clean.collect()} == {i for i, r in got.items() if not r.items}
    assert decontamination.find_contamination(documents([]), bench).count() == 0
    assert all(not r.items for r in decontamination.find_contamination(documents(rows), bench.where("item_id > 99")).collect())


def test_automaton_is_not_taken_from_another_benchmark():
    import pyarrow as pa

    class Told:  # a broadcast of workers: it has no id, and its value may stand where a freed one stood
        value: dict = {}

    batch = pa.RecordBatch.from_pydict({"text": ["one two", "three four"]})
    for text, want in (("one two", [[7], []]), ("three four", [[], [7]])):
        Told.value.clear()
        Told.value.update(decontamination.windows([(7, text)], 10))
        (found,) = decontamination._scan(Told(), True)(iter([batch]))
        assert found.column("items").to_pylist() == want


PAGE = """<html><head><title>No</title><style>p{}</style></head><body><header><a href=1>Site</a></header><nav><ul><li><a href=1>A</a></li><li><a href=2>B</a></ul></nav>
<div class="ad">Buy this now and save a lot of money today.</div><article><h1>Head &amp; shoulders</h1><p>First   para <b>bold</b>&nbsp;x<br>y<p>Second.<p>A &lt; B &copy; &#233;<script>var a = "</p>";</script><!-- <p>no</p> --><section class="comments"><p>A reader said this
here.</p></section></article><aside><p>Other stories that you may like to read too.</p></aside><form><label>Mail</label><input><button>Go</button></form><footer>All rights &middot; reserved</footer>"""


def test_extraction(spark):
    assert html_extraction.main_text(PAGE) == "Head & shoulders\nFirst para bold x\ny\nSecond.\nA < B © é"
    assert html_extraction.main_text(None) == html_extraction.main_text("") == html_extraction.main_text("<html><nav>x</nav>") == ""
    for broken in ("<p title=\"a>b", "<", "<!-- x", "<script>", "<article><p>a<p>b", "</p></div>", "<p " + "x='1' " * 20_000, "<" * 50_000):
        html_extraction.main_text(broken)
    assert html_extraction.main_text("<article><p>" + "word " * 200_000 + "</article>").count("word") == 200_000
    df = spark.createDataFrame([(1, "u", PAGE, "old"), (1, "u", PAGE, "old"), (2, None, None, None)], "page_id long, url string, html string, text string")
    rows = html_extraction.extract_text(df).orderBy("page_id").collect()
    assert [r.n_chars for r in rows] == [len(html_extraction.main_text(PAGE))] * 2 + [0] and rows[2].text == ""
    assert html_extraction.extract_text(df.limit(0)).count() == 0


def test_extraction_goes_on_behind_missing_end_tags():
    said = "The river rose again in the night and by morning the lower fields lay under water as far as the mill."
    texts = lambda page: [b.text for b in html_extraction.blocks(page)]
    assert texts("<head><title>T</title><meta name=x><script>'<p>no</p>'</script><p>text") == ["text"]
    assert html_extraction.main_text(f"<!doctype html><head><title>T</title><article><p>{said}<p>{said}</article>") == f"{said}\n{said}"
    for name in ("video", "audio", "svg", "canvas", "object", "template", "noscript", "iframe"):
        assert texts(f"<p>a</p><{name}><p>b</p>") == ["a", "b"]
        assert texts(f"<p>a</p><{name}>no<!-- <{name}> --></{name}><p>b</p>") == ["a", "b"]
        assert texts(f"<p>a</p><{name} x='>'><p>b</p><{name.upper()}>no</{name}><p>c</p>") == ["a", "b", "c"]
    assert texts("<svg><svg><text>no</text></svg><svg/><text>no</text></svg><p>a</p>") == ["a"]
    assert texts("<p>a</p><script>no<p>b</p>") == ["a"] and texts("<title>T<p>b</p>")[-1] == "b"
    math = "<math><semantics><mrow><mi>x</mi><mo>=</mo><mn>1</mn></mrow><annotation encoding=TeX>x=1</annotation></semantics></math>"
    assert texts(f"<p>Let {math} hold.</p>") == ["Let x=1 hold."]
    assert texts("<p><math><mtable><mtr><mtd>1</mtd><mtd>2</mtd></mtr></mtable></math></p>") == ["1 2"]
    assert len(texts("<svg><p>b" * 20_000 + "<title>x" * 20_000)) == 40_000


def test_tree_learns_its_labels_and_link_density_alone_will_do():
    found = [html_extraction.blocks(p) for p in html_extraction.LABELLED]
    rows = [(r, b.keep) for bs in found for r, b in zip(html_extraction.features(bs), bs, strict=True)]
    assert np.mean([html_extraction.decide(html_extraction.tree(), r) == bool(k) for r, k in rows]) > 0.95
    soup = "<div><a href=1>One</a> <a href=2>Two</a></div><div>" + "Plain words in a long block of text that nobody has named. " * 3 + "</div><div><a href=3>Three</a></div>"
    assert html_extraction.main_text(soup).startswith("Plain words")


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "user", "a <|im_end|> b \\ <\\| c"), (1, 1, "assistant", "<|im_start|>x\n<"), (1, 2, "assistant", ""), (2, 1, "assistant", "late"), (2, 0, "us\ner<|im_end|>", None), (None, 0, None, "null conv"),
        (3, 0, "assistant", "tie"), (3, 0, "assistant", "tie"), *((4, k, ("user", "assistant")[k % 2], f"turn {k} é漢") for k in range(150)),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    for r in chat.format_conversations(df).collect():
        own = sorted(((t, ro or "", x or "") for c, t, ro, x in rows if c == r.conv_id))
        assert chat.parse(r.formatted) == [(ro, x) for _, ro, x in own]
        assert "".join(chat.unescape(r.formatted[s.start : s.end]) for s in r.loss_spans) == "".join(x for _, ro, x in own if ro == "assistant")
        assert r.rewrites_at == -1 and [s.start for s in r.turn_spans][1:] == [s.end for s in r.turn_spans][:-1] and r.turn_spans[-1].end == len(r.formatted)
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_templates_that_rewrite_history_are_found():
    turns = [("user", f"q{k}") if k % 2 == 0 else ("assistant", f"a{k}") for k in range(6)]
    last_only = lambda ts: "".join(t for _, t in ts[-2:])  # noqa: E731  drops what stood before
    assert chat.spans(last_only, turns)[2] == 2
    numbered = lambda ts: "".join(f"[{k}]{t}" for k, (_, t) in enumerate(ts))  # noqa: E731  a turn's form depends on its place
    whole, found, at = chat.spans(numbered, turns * 30)
    assert at == -1 and found[-1][1] == len(whole) and [whole[a:b] for a, b in found[:2]] == ["[0]q0", "[1]a1"]


def test_long_conversations_are_judged_like_short_ones(spark):
    plain = lambda ts: "".join(f"<{t}>" for _, t in ts)
    fickle = lambda ts: plain(ts).upper() if len(ts) == 21 else plain(ts)  # noqa: E731  rewrites at one prefix and back at the next
    seen = lambda ts: "".join(f"<{t}>" if k < 3 or r == "user" else f"({ts[0][1]}{t})" for k, (r, t) in enumerate(ts))  # noqa: E731  uses the first turn
    for n in (40, 65, 150):
        turns = [(("user", "assistant")[k % 2], f"t{k}") for k in range(n)]
        assert chat.spans(fickle, turns)[1:] == ([], 20)
        whole, found, at = chat.spans(seen, turns)
        assert at == -1 and len(found) == n
        for k in range(1, n, 2):
            a, b = chat.text_span(seen, turns, k, found[k], whole)
            assert whole[a:b] == f"t{k}"
    df = spark.createDataFrame([(1, k, *x) for k, x in enumerate(turns)], "conv_id long, turn long, role string, text string")
    (row,) = chat.format_conversations(df, fickle).collect()
    assert (row.rewrites_at, row.turn_spans, row.loss_spans) == (20, [], [])


def brute_top(ids, v, k):
    out = {}
    for q, x in zip(ids, v):
        if q % 20 == 0:
            scored = sorted((-int(x @ y), i) for i, y in zip(ids, v) if i != q)[:k]
            out[q] = [(i, -s) for s, i in scored]
    return out


@pytest.mark.parametrize("scale", [3, 64, 10**7])
def test_top_k_equals_brute_force(spark, scale, monkeypatch):
    for name, value in (("TREE", 150), ("LEAF", 16), ("QUERIES", 7)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(scale)
    v = np.round(rng.normal(size=(400, 8)) * scale).astype(np.int64)
    v[100:140] = v[0]
    ids = rng.permutation(1000)[:400].tolist()
    rows = [(i, x.tolist()) for i, x in zip(ids, v)] + [(None, [1] * 8), (2000, None)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = {}
    for r in topk.top_k(df, df.where("vec_id % 20 = 0 and vec_id < 1000"), 20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute_top(ids, v, 20)


def test_top_k_edges(spark):
    df = spark.createDataFrame([(0, [1.0, float("nan")], 1), (20, [0.5, -0.5], 1), (40, None, 1), (60, [1.0, None], 1), (1, [2.0], 1), (80, [float("inf"), 0.0], 1)], "vec_id long, embedding array<float>, rank int")
    v = topk.whole_vectors(df)
    rows = topk.top_k(v, v.where("vec_id % 20 = 0"), 20).collect()
    assert [(r.query_id, r.vec_id, r.score, r["rank"]) for r in rows] == [(20, 1, 32 * 128, 1)]
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0


def labelled(n, seed):
    rng = random.Random(seed)
    words = [f"wort{k}" for k in range(300)]
    rows = []
    for i in range(n):
        grade = rng.choice([0, 1, 2, 2])
        own = [rng.choice(words) for _ in range(rng.randrange(5, 80))]
        if grade == 0:
            own = [w.upper() + "!!" for w in own]
        if grade == 1:
            own[rng.randrange(len(own))] = rng.choice(["slurred", "slurs", "nasty"])
        rows.append((i, " ".join(own), grade))
    return rows


def test_quality_learns_held_out_grades(spark, documents):
    train, test = labelled(600, 1), labelled(300, 2)
    grades = spark.createDataFrame([(i, g) for i, _, g in train] + [(3, None), (None, 1), (99_999, 2)], "doc_id long, grade int")
    model = quality.train(documents([(i, t) for i, t, _ in train]), grades, sample=500)
    assert (np.diff(model.thresholds) > 0).all()
    rows = [(i, t) for i, t, _ in test] + [(1000, None), (1001, ""), (1002, "wort1 " * 30_000)]
    got = {r.doc_id: r for r in quality.classify(documents(rows), model).collect()}
    right = [(got[i].p_top >= 0.5) == (g == 2) for i, _, g in test]
    assert np.mean(right) > 0.95 and len(got) == len(rows)
    assert all(0 <= r.expected_grade <= 2 and 0 <= r.p_top <= 1 for r in got.values())
    assert got[1000].p_top == got[1001].p_top
    assert quality.classify(documents([]), model).count() == 0
    assert quality.train(documents(rows), grades.limit(0)) is None
    assert all(r.p_top is None and r.k for r in quality.classify(documents(rows[:3]), None).select("p_top", quality.kept().alias("k")).collect())


def test_grades(spark):
    df = spark.createDataFrame([(1, 0, 1), (2, 1, 1), (3, 1, 0), (4, 1, None), (5, None, 0)], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.grade for r in quality.grades(df).collect()} == {1: 0, 2: 1, 3: 2, 4: 2}


def test_every_cell_beyond_chance_is_fitted():
    """Thousands of marks of low grades, each in few texts: all get weights, and texts of held-out mixes are told apart."""
    rng = np.random.default_rng(0)
    grades = rng.integers(0, 3, 6000)
    cells = [np.unique(rng.integers(0, 50_000, 40)) if g == 2 else np.unique(np.append(rng.integers(0, 50_000, 30), 60_000 + g * 1500 + rng.integers(0, 1500, 40))) for g in grades]
    shares = rng.normal(size=(6000, len(quality.SHARES)))
    sizes = np.bincount(grades, minlength=3)
    chosen = quality.select_cells(quality.count_cells([c.astype(np.int32) for c in cells], grades, 2), sizes)
    assert len(set(chosen) & set(range(60_000, 63_000))) > 2900
    model = quality.fit(chosen, cells[:5000], shares[:5000], grades[:5000])
    assert len(model.weights) == len(chosen) + len(quality.SHARES) and (np.diff(model.thresholds) > 0).all()
    told = [int((model.reached(model.score(c, s)) >= 0.5).sum()) for c, s in zip(cells[5000:], shares[5000:], strict=True)]
    assert np.mean(np.array(told) == grades[5000:]) > 0.97


def test_slopes_of_the_likelihood():
    rng = np.random.default_rng(1)
    of = quality._Likelihood([np.array([0, 2]), np.array([], int), np.array([1]), np.array([0])], 3, rng.normal(size=(4, 2)), np.array([0, 1, 2, 2]), 0.3)
    at = of.begin() + rng.normal(size=7) / 2
    loss, gradient = of(at)
    steps = [(of(at + 1e-6 * e)[0] - loss) / 1e-6 for e in np.eye(7)]
    assert np.allclose(steps, gradient, atol=1e-4)


def test_a_grade_that_no_row_has():
    cells = [np.array([7], np.int32)] * 40 + [np.array([9], np.int32)] * 60
    grades = np.array([0] * 40 + [2] * 60)
    chosen = quality.select_cells(quality.count_cells(cells, grades, 2), np.bincount(grades, minlength=3))
    model = quality.fit(chosen, cells, np.full((100, len(quality.SHARES)), np.nan), grades)
    assert list(chosen) == [7] and model.reached(model.score(cells[0], np.zeros(6)))[1] < 0.2 < 0.8 < model.reached(model.score(cells[-1], np.zeros(6)))[1]


def test_each_query_row_is_answered(spark, tmp_path):
    """Rows that share a vec_id are queries of their own, and candidates of each other."""
    rows = [(0, [1.0]), (0, [5.0]), (1, [2.0]), (20, [-1.0]), (20, [-1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.op7_top_k(spark, str(tmp_path)).collect())
    v = [(i, int(x[0] * 64)) for i, x in rows]
    want = []
    for n, (q, x) in enumerate(v):
        if q % 20 == 0:
            found = sorted((-x * y, i) for m, (i, y) in enumerate(v) if m != n)
            want += [(q, rank, i, -s) for rank, (s, i) in enumerate(found, 1)]
    assert got == sorted(want)


def test_no_vectors_go_through_the_driver(spark, monkeypatch):
    """Queries and trees are never broadcast, and pivots are chosen on the executors, a bounded number of them collected."""
    plans, written = [], topk.materialize

    def seen(df, label):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return written(df, label)

    monkeypatch.setattr(topk, "materialize", seen)
    for name, value in (("TREE", 50), ("STRIP", 7), ("TILES", 4), ("PARTS", 2)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(3)
    ids, v = list(range(400)), rng.integers(-60, 60, (400, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, v array<long>")
    got = {}
    for r in topk.top_k(df, df.where("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute_top(ids, v, 20)
    assert "pivots" in [label for label, _ in plans]
    assert not [plan for _, plan in plans if re.search(r"BroadcastExchange.*\n.*(ObjectHashAggregate|FileScan|Scan parquet)", plan)]


@pytest.mark.parametrize("scale", [3, 40, 10**3, 10**6, 10**9])
def test_tiles_keep_the_best_outside_the_home_tree(scale, monkeypatch):
    """Over stored trees of many leaves, with copies, floors or none, and hits cut on the way."""
    for name, value in (("LEAF", 16), ("FANOUT", 4), ("QUERIES", 7), ("HITS", 100)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(scale)
    v = np.round(np.concatenate([rng.normal(size=(300, 6)), rng.normal(size=(300, 6)) * 0.01 + 1]) * scale).astype(np.int64)
    v[100:160] = v[0]
    ids, norm = rng.permutation(600), int((v**2).sum(axis=1).max())
    trees = [topk.MTree(ids[t::3], v[t::3], norm) for t in range(3)]
    part = pa.table({"tree": [0, 1, 2], "pages": pa.array([t.to_bytes() for t in trees], pa.binary())})
    asked = np.arange(0, 600, 20)
    scores = v[asked] @ v.T
    want, floors = {}, []
    for n, q in enumerate(asked):
        away = [(-s, i) for m, (s, i) in enumerate(zip(scores[n].tolist(), ids.tolist(), strict=True)) if m != q and m % 3 != q % 3]
        want[int(ids[q])] = [(i, -s) for s, i in sorted(away)[:5]]
        floors.append([None, -sorted(away)[9][0], -sorted(away)[5][0]][n % 3])
    own = pa.array(ids[asked])
    strip = pa.table({"q": np.arange(len(asked)), "vec_id": own, "own": own, "v": pa.array(v[asked].tolist()), "floor": pa.array(floors, pa.int64()), "tree": asked % 3})
    got = {}
    hits = topk._tile(5, 6)(strip, part)
    for r in sorted(hits.to_pylist(), key=lambda r: (-r["score"], r["vec_id"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == want
    assert topk._tile(5, 6)(strip.slice(0, 0), part).num_rows == topk._tile(5, 6)(strip, part.slice(0, 0)).num_rows == 0


def test_a_range_search_spares_distances():
    """In clusters the second wave computes under a quarter of all distances."""
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 16)) * 400
    v = np.round(centres[rng.integers(0, 40, 8000)] + rng.normal(size=(8000, 16)) * 6).astype(np.int64)
    tree = topk.MTree(np.arange(8000), v, int((v**2).sum(axis=1).max()))
    asked = np.arange(0, 8000, 200)
    floor = np.sort(v[asked] @ v.T, axis=1)[:, -10].astype(np.float64)
    hits = sum(len(q) for q, _, _ in tree.within(asked, v[asked], floor))
    assert hits == sum(int((v[a] @ v.T >= f).sum() - (v[a] @ v[a] >= f)) for a, f in zip(asked, floor, strict=True))
    assert tree.computed < 0.25 * len(asked) * 8000


def test_bounds_spare_distances():
    """In clusters, under a quarter of all distances is computed, and less with a floor from elsewhere; a stored tree answers alike."""
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 16)) * 400
    v = np.round(centres[rng.integers(0, 40, 8000)] + rng.normal(size=(8000, 16)) * 6).astype(np.int64)
    tree = topk.MTree(np.arange(8000), v, int((v**2).sum(axis=1).max()))
    asked = np.arange(0, 8000, 200)
    found = tree.search(asked, v[asked], 10)
    scores = v[asked] @ v.T
    for q, (s, ids), all_scores in zip(asked, found, scores, strict=True):
        best = sorted((-x, i) for i, x in enumerate(all_scores.tolist()) if i != q)[:10]
        assert [(-a, b) for a, b in best] == list(zip(s.tolist(), ids.tolist(), strict=True))
    first = tree.computed
    assert first < 0.25 * len(asked) * 8000
    again = topk.MTree.from_bytes(tree.to_bytes())
    again.computed = 0
    with_floor = again.search(asked, v[asked], 10, np.array([s[-1] for s, _ in found]))
    assert again.computed < first and all((a[0] == b[0]).all() and (a[1] == b[1]).all() for a, b in zip(found, with_floor, strict=True))


#: Pages that the tree has not seen: (page, main text).
HELD_OUT = [
    ("<div class='story legal'><h1>Mill burns down</h1><p>The old paper mill below the weir burnt down on Sunday night while the town slept.</p><p>Nobody was hurt.</p><p>The owner said that the machines were sold last year and that the walls would be left as they are for now.</p></div>",
     "Mill burns down\nThe old paper mill below the weir burnt down on Sunday night while the town slept.\nNobody was hurt.\nThe owner said that the machines were sold last year and that the walls would be left as they are for now."),
    ("<header><a href=1>Turf</a></header><div class='post form-guide'><p>The favourite sweated up before the start and was never in the race after the second bend on the far side.</p><p>Her jockey could not say why, and the vet found nothing wrong with her heart or legs in the evening.</p></div><footer>No bets under eighteen.</footer>",
     "The favourite sweated up before the start and was never in the race after the second bend on the far side.\nHer jockey could not say why, and the vet found nothing wrong with her heart or legs in the evening."),
    ("<nav><a href=1>Start</a></nav><article><h2>Cork</h2><p>A cork oak is first peeled when it is twenty-five years old, and then once every nine years.</p><section class='comments'><p>We have two of them at home and they are lovely.</p></section><p>The tree lives on.</p></article><div class='ad'>Corks for all bottles, ten for one.</div>",
     "Cork\nA cork oak is first peeled when it is twenty-five years old, and then once every nine years.\nThe tree lives on."),
    ("<div><p>The ferry will not sail before noon, for the ice is still too thick at the mouth of the river.</p></div><div id='comments'><p>They said so yesterday too, and then it sailed at nine and left all of us standing on the quay in the wind.</p><p>I have asked at the office and nobody there knows anything about it, they only read the paper like we do here.</p><p>Take the bus over the bridge, it takes an hour but at least it comes.</p></div>",
     "The ferry will not sail before noon, for the ice is still too thick at the mouth of the river."),
    ("<div class='notice'><h1>Road closed</h1><p>From Monday on Mill Lane is closed between the church and the bakery for four weeks, because pipes are laid.</p><p>Buses stop at the school and at the old gate meanwhile, as they did last summer.</p></div><form><p>Was this of use to you?</p><button>Yes</button></form>",
     "Road closed\nFrom Monday on Mill Lane is closed between the church and the bakery for four weeks, because pipes are laid.\nBuses stop at the school and at the old gate meanwhile, as they did last summer."),
    ("<main><p>Owls hear a mouse under a foot of snow, and strike at the sound without seeing anything at all.</p><div class='newsletter'><p>Owls in your letter box each week: subscribe now and get the poster for your wall as a gift.</p></div><p>One ear sits higher than the other.</p></main><aside><p>Read next how bats do it, and why moths can hear them before it is too late for the moth.</p></aside>",
     "Owls hear a mouse under a foot of snow, and strike at the sound without seeing anything at all.\nOne ear sits higher than the other."),
]


@pytest.mark.parametrize("page,want", HELD_OUT)
def test_extraction_of_pages_not_trained_on(page, want):
    assert html_extraction.main_text(page) == want


def test_deep_and_unmatched_tags_take_time_in_proportion():
    import time

    took = []
    for n in (25_000, 100_000):
        began = time.perf_counter()
        assert html_extraction.blocks("<div>" * n + "</b>" * n + "<p>word</i></div>" * n)[0].text == "word"
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0] + 1 and took[1] < 20
