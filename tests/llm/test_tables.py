"""Operators on whole tables: lines, copies, near copies, rules, pages, conversations, the pipeline."""

import random
import re
import time
from itertools import combinations
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from faultline.llm import (
    chat_pairs, exact_dedup, html_blocks, html_extract, line_dedup, quality_rules, queries, shingle_join, shingles,
)
from faultline.llm.common import table
from faultline.llm.components import components
from tests.compare import difference, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, SF), duck(SF), queries.SQL[name]) is None


def docs_of(spark, texts, extra=()):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + list(extra)
    return spark.createDataFrame(rows, "doc_id long, text string, self string, row int")


ODD = [None, "", " \n\t", "a", "a\na\na\na\na", "x y z", "é" * 3000, "w " * 60_000]


def test_odd_rows_everywhere(spark):
    docs = docs_of(spark, ODD, [(3, "a", "x", 1), (None, "a", None, None), (None, None, None, None)])
    size = docs.count()
    assert quality_rules.judge(docs).count() == size
    assert quality_rules.keep_good(docs).columns == docs.columns
    assert line_dedup.remove_repeated(docs).columns == docs.columns
    assert line_dedup.remove_repeated(docs).count() == size
    assert exact_dedup.duplicates(docs).count() == size
    assert shingle_join.similarity_components(docs).count() == size
    assert shingle_join.one_of_each(docs).columns == docs.columns
    none = docs.limit(0)
    for fn in (quality_rules.judge, quality_rules.keep_good, line_dedup.remove_repeated, exact_dedup.duplicates,
               shingle_join.similarity_components, shingle_join.one_of_each):
        assert fn(none).collect() == []


# --- quality --------------------------------------------------------------------------------------------------------


def repeated(words):
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    return len({p for i, w in enumerate(windows) if windows.count(w) > 1 for p in range(i, i + 8)})


def test_repeated_words(spark):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 60))) for _ in range(60)]
    texts += ["q " * 40, "one two three four five six seven eight " * 3, ""]
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.judge(docs_of(spark, texts)).collect()}
    assert got == {i: repeated(t.split()) for i, t in enumerate(texts)}


def test_clean_documents_stay(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = quality_rules.op10_quality_rules(spark, "/root/testdata/sf0.01").join(labels, "doc_id")
    good = judged.filter("quality = 1 and not base_failed")
    assert good.filter("not kept").count() == 0
    bad = judged.filter("quality = 0")
    assert bad.filter("kept").count() <= 0.25 * bad.count()


def test_rules_run_without_python(spark):
    plan = quality_rules.op10_quality_rules(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


# --- copies ---------------------------------------------------------------------------------------------------------


def test_copies_with_ties(spark):
    docs = docs_of(spark, ["a b", "a  b", "a\tb ", None, ""], [(0, "a b", "x", 1), (None, "a b", "x", 1), (None, "only", "x", 1)])
    rows = exact_dedup.duplicates(docs).collect()
    group = [r for r in rows if r.group_size == 4]
    assert len(group) == 4 and sum(r.kept for r in group) == 1 and {r.keep_id for r in group} == {0}
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in rows if r.group_size == 2) == [(3, 3, True), (4, 3, False)]
    assert [(r.keep_id, r.kept) for r in rows if r.doc_id is None and r.group_size == 1] == [(None, True)]


def test_frequent_digests_are_found(spark):
    many = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    rows = exact_dedup.digests(many.repartition(16), "doc_id", "text")
    hot = rows.groupBy("head").count().orderBy(F.desc("count")).first()
    assert hot["count"] == 10_000
    assert hot["head"] in [r.head for r in exact_dedup.frequent_heads(rows).collect()]
    got = exact_dedup.duplicates(many)
    assert got.filter("kept").count() == 20_001
    assert got.filter("not kept and keep_id <> 0").count() == 0


# --- lines ----------------------------------------------------------------------------------------------------------


def plain_line_dedup(texts):
    seen, out = set(), []
    for text in texts:
        lines = text.split("\n")
        places = [(i, " ".join(x.split(" "))) for i, x in enumerate(lines) if x.strip()]
        gone = set()
        for a, b, c in zip(places, places[1:], places[2:]):
            window = (a[1].strip(), b[1].strip(), c[1].strip())
            if window in seen:
                gone |= set(range(a[0], c[0] + 1))
            seen.add(window)
        out.append("\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def test_line_dedup_against_a_plain_loop(spark):
    rnd = random.Random(5)
    texts = ["\n".join(rnd.choice(["a", "b", "c", "", " d "]) for _ in range(rnd.randint(0, 25))) for _ in range(80)]
    got = {r.doc_id: r.text for r in line_dedup.remove_repeated(docs_of(spark, texts)).collect()}
    assert got == dict(enumerate(plain_line_dedup(texts)))


def test_one_copy_of_every_line_is_left(spark):
    passage = "\n".join(f"line {i} of a long passage" for i in range(8))
    texts = [f"own {i}\n{passage}\nend {i}" for i in range(50)]
    got = [r.text for r in line_dedup.remove_repeated(docs_of(spark, texts)).orderBy("doc_id").collect()]
    assert got == [texts[0]] + [f"own {i}\nend {i}" for i in range(1, 50)]


# --- near copies ----------------------------------------------------------------------------------------------------


def test_line_dedup_writes_few_files(spark, monkeypatch):
    """However many partitions a shuffle has: its small tables are a few files per core, with the same rows."""
    lines = [f"line {i}" for i in range(400)]
    docs = docs_of(spark, ["\n".join(lines[i : i + 40]) for i in range(0, 360, 20)])
    want = sorted(map(tuple, line_dedup.remove_repeated(docs).collect()))
    written, write = [], line_dedup.materialise
    monkeypatch.setattr(line_dedup, "materialise", lambda df, name: written.append(write(df, name)) or written[-1])
    odd = {"spark.sql.shuffle.partitions": "120", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in odd}
    try:
        for k, v in odd.items():
            spark.conf.set(k, v)
        assert sorted(map(tuple, line_dedup.remove_repeated(docs).collect())) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert written and all(len(w.inputFiles()) <= 4 * spark.sparkContext.defaultParallelism for w in written)


def plain_components(texts, width, percent):
    sets = {}
    for i, t in enumerate(texts):
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sets, 2):
        common = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def families(seed, count, words, edits):
    """Copies of copies: each text changes a few words of an earlier one."""
    rnd, out = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(3000)]
    for _ in range(count):
        if out and rnd.random() < 0.8:
            text = rnd.choice(out).split()
            for _ in range(rnd.randint(0, edits)):
                text[rnd.randrange(len(text))] = rnd.choice(vocabulary)
        else:
            text = [rnd.choice(vocabulary) for _ in range(rnd.choice(words))]
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_no_link_is_lost(spark, width, percent):
    texts = families(1, 150, [2, 5, 12, 30, 80, 300], 3) + families(2, 60, [60], 2) + [None, "", "A b", "a B"]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.similarity_components(docs_of(spark, texts), width=width, percent=percent).collect()}
    assert got == plain_components(texts, width, percent)


def test_crowded_segments(spark, monkeypatch):
    monkeypatch.setattr(shingle_join, "SMALL", 2)
    monkeypatch.setattr(shingle_join, "BLOCK", 8)
    monkeypatch.setattr(exact_dedup, "CANDIDATES", 5)  # few segments count as frequent: both ways are taken
    texts = families(7, 120, [90], 4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.similarity_components(docs_of(spark, texts)).collect()}
    assert got == plain_components(texts, 3, 90)


def test_chance_marks_pair_only_sets_that_fit(spark, monkeypatch):
    """Few words: the rarest shingles of a set are shared by chance. Pairs that the mark's place excludes are not tested."""
    rnd, tested = random.Random(5), []
    texts = [" ".join(f"w{rnd.randrange(14)}" for _ in range(rnd.choice([30, 60, 120, 240]))) for _ in range(150)]
    texts += [" ".join([*t.split(), "x"]) for t in texts[:20]]
    monkeypatch.setattr(shingle_join, "SMALL", len(texts))
    monkeypatch.setattr(shingle_join, "near_pairs", lambda pairs, *rest, plain=shingle_join.near_pairs: tested.append(pairs) or plain(pairs, *rest))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.similarity_components(docs_of(spark, texts)).collect()}
    assert got == plain_components(texts, 3, 90)
    assert sum(pairs.count() for pairs in tested) <= 500  # 1,563 by the marks alone


def test_sketches_bound_the_difference():
    import numpy as np

    rnd, bands = np.random.default_rng(0), shingles.Bands(80)
    for _ in range(500):
        a = np.unique(rnd.integers(0, 2**64, int(rnd.integers(1, 300)), dtype=np.uint64))
        b = np.unique(np.append(np.delete(a, rnd.integers(0, len(a))), rnd.integers(0, 2**64, int(rnd.integers(0, 9)), dtype=np.uint64)))
        if not len(b):
            continue
        whole = [shingles.sketch(x, bands) for x in (a, b)]
        assert shingles.hamming(*map(shingles.brief, whole)) <= shingles.hamming(*whole) <= len(np.setxor1d(a, b))
        if shingles.similar(a, b, 80) and len(np.setxor1d(a, b)):
            assert set(shingles.segment_keys(a, bands)) & set(shingles.segment_keys(b, bands))


@pytest.mark.parametrize("percent", [80, 90])
def test_similar_sets_share_a_rare_mark(percent):
    import numpy as np

    rnd = np.random.default_rng(1)
    for often in (np.zeros(shingles.BUCKETS, np.int64), rnd.integers(0, 9, shingles.BUCKETS)):
        for _ in range(400):
            a = np.unique(rnd.integers(0, 2**64, int(rnd.integers(1, 200)), dtype=np.uint64))
            lost, new = (int(rnd.integers(0, 1 + len(a) // 5)) for _ in "ab")
            b = np.unique(np.append(rnd.permutation(a)[lost:], rnd.integers(0, 2**64, new, dtype=np.uint64)))
            if len(np.setxor1d(a, b)) and shingles.similar(a, b, percent):
                assert set(shingles.rare_marks(a, percent, often)) & set(shingles.rare_marks(b, percent, often))


def test_a_common_passage_crowds_no_blocks(spark, monkeypatch):
    """Texts that share a passage, and little else, are not dealt out over blocks, which is quadratic in their number."""
    rnd = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [f"{passage} " + " ".join(f"w{rnd.randrange(10**6)}" for _ in range(60)) for _ in range(300)]
    texts += [t.replace(" p30 ", " q ") for t in texts[:5]]
    dealt = []
    monkeypatch.setattr(shingle_join, "BLOCK", 8)
    monkeypatch.setattr(shingle_join, "open_blocks", lambda *args, plain=shingle_join.open_blocks: dealt.append(plain(*args)) or dealt[-1])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.similarity_components(docs_of(spark, texts), width=5, percent=80).collect()}
    assert got == plain_components(texts, 5, 80)
    assert sum(d.count() for d in dealt) <= len(texts)


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (200, 201), (200, 201)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200, 201: 200}


# --- pages ----------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p><b>";</script></head>
<body class="has-sidebar"><header class=site><h2>Site</h2></header><nav><ul><li><a href="/">Home<li><a>News</ul></nav>
<div class="cookie-notice">We use cookies</div><div id="wrapper"><article><header><h1>The&nbsp;title &amp; more</h1></header>
<p>First  <b>bold<i>er</b></i>
text<br>line<p>Second &lt;p&gt; &#233;<form><input><button>Send</button></form><div class="ad">Buy</div>
<ul><li>one<li>two</ul><section class="comments"><article class="comment"><p>Nice!</p></article></section></article>
<aside>More</aside></div><footer>&copy; me</footer>"""


def test_an_article_among_frames():
    got = html_extract.main_text(html_blocks.read(PAGE), frozenset())
    assert got == "The title & more\nFirst bolder text line\nSecond <p> é\none\ntwo"


@pytest.mark.parametrize("source", ["", "<", "<<<>>>", "</p></div>", "plain", "<p", "<p a='", '<a b="' * 50, "<script>", "<!--", "&#xD800;&#0;&bogus;", "<div>" * 2000 + "deep"])
def test_broken_pages(source):
    assert isinstance(html_extract.main_text(html_blocks.read(source), frozenset()), str)


@pytest.mark.parametrize("source, want", [
    ("<body><form id=aspnetForm><div class=menu>Menu</div><article><p>a</p></article><p>b</p></form></body>", "a"),
    ("<body><form id=form1><div class=nav>Menu</div><p>the long text of a page without an article</p></form>", "the long text of a page without an article"),
    ("<div class='widget Blog'><article><p>a</p></article></div><div class='widget'>tags</div>", "a"),
    ("<div class='widget'><p>the long text of a post</p></div><div class='widget'>tags</div>", "the long text of a post"),
    ("<article><h1>Soup</h1><div class=cookies><p>Bake the cookies</p></div><div class='cookie-notice'>We use cookies</div></article>", "Soup\nBake the cookies"),
    ("<main><div id=banner><h1>Title</h1></div><p>a</p></main>", "Title\na"),
    ("<article><p>a</p><form><input><p>comment here, with quite a long text in the form</p></form></article>", "a"),
    ("<article><p>a</p></article><div class=comments><article><p>a comment that is longer than the article</p></article></div>", "a"),
])
def test_names_do_not_drop_what_holds_the_text(source, want):
    assert html_extract.main_text(html_blocks.read(source), frozenset()) == want


def near_copies(n):
    menu = "<div class=top><p>Our paper</p><p>All our pages</p></div>"
    rows = [(i, f"http://a.example/{i}", f"{menu}<article><h1>Title {i}</h1><p>Story {i} is told here at some length</p></article>") for i in range(12)]
    story = menu + "<article class=feature><h1>The long story</h1><p>It began one day in the rain.</p><p>It ended in the sun.</p><p>Viewed {} times</p></article>"
    return rows + [(100 + i, f"http://a.example/long?utm={i}", story.format(1000 + i)) for i in range(n)]


@pytest.mark.parametrize("n", [3, 8])
def test_near_copies_keep_their_article(spark, n):
    got = texts_of(spark, near_copies(n))
    story = "The long story\nIt began one day in the rain.\nIt ended in the sun.\nViewed {} times"
    assert all(got[100 + i] == story.format(1000 + i) for i in range(n))
    assert all(got[i] == f"Title {i}\nStory {i} is told here at some length" for i in range(12))


def test_depth_and_attributes_have_no_limit():
    deep = "<div><article><p>first</p>" + "<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>rest</p></article><p>out</p></div>"
    long = f"<article><p>one</p><img alt=\"{'x' * 50_000} 1 > 0 {'y>' * 50_000}\"><p title='a>b'>two</article>"
    broken = "<article><p>it's</p><a 'x>link</a><p class=\"x>three"
    for source, want in ((deep, "first\ndeep\nrest"), (long, "one\ntwo"), (broken, "it's\nlink\nthree")):
        assert html_extract.main_text(html_blocks.read(source), frozenset()) == want


@pytest.mark.parametrize("source", ["<b>x" * 100_000, "<div>x" * 100_000, "<a b=\"x' " * 100_000, "<p><b>" * 50_000, "<a='\">" * 100_000])
def test_crafted_pages_take_linear_time(source):
    start = time.process_time()
    html_extract.main_text(html_blocks.read(source), frozenset())
    assert time.process_time() - start < 20


def test_template_text_is_left_out(spark):
    frame = "<div class=box><p>Read our terms</p></div><div class=x><p>{}</p></div><p>All rights reserved, and so on</p>"
    rows = [(i, f"http://a.example/{i}", frame.format(f"Story number {i} is told here")) for i in range(12)]
    rows += [(50, "http://B.example:80/", frame.format("alone")), (51, None, None), (None, "x", "<p>y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert all(got[i] == f"Story number {i} is told here" for i in range(12))
    assert got[50] == "Read our terms\nalone\nAll rights reserved, and so on" and got[51] == "" and got[None] == "y"
    assert html_extract.extract(pages.limit(0)).collect() == []


def test_the_template_decides_inside_articles(spark):
    source = "<nav>Menu</nav><article><h1>Title {0}</h1><p>Story {0}</p><p>Read our terms</p></article><footer>Me</footer>"
    rows = [(i, f"http://a.example/{i}", source.format(i)) for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extract.extract(pages).collect()} == {i: f"Title {i}\nStory {i}" for i in range(12)}


@pytest.mark.parametrize("source, want", [
    ("<main><h1>T</h1><p>lead</p><article>story</article></main>", "T\nlead\nstory"),
    ("<article><p>one</article><article><p>two, the longer one</article>", "one\ntwo, the longer one"),
    *((f"<article><p>a</p><div class='{name}'><p>b</p></div></article>", "a\nb")
      for name in ("search-results-section", "social-history", "header-image", "alert", "form")),
    ("<article><p>a</p><div class='share-bar'>b</div><div class='x sidebar'>c</div></article>", "a"),
    ("<div><p>text</p><p><a href=x>a linked block</a></p></div>", "text\na linked block"),
    ("<div class=main-nav>menu</div><div id=main><p>a</div>", "a"),
    ("<div class='has-sidebar'><article>a</article></div>", "a"),
])
def test_nothing_else_is_dropped(source, want):
    assert html_extract.main_text(html_blocks.read(source), frozenset()) == want


def texts_of(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r.text for r in html_extract.extract(pages).collect()}


def test_each_layout_has_its_template(spark):
    one = "<div class=a><i>x</i></div><p>Terms of a</p><div class=x><p>Story {}</p></div>"
    two = "<ul class=b></ul><div class=x><p>Story {}</p></div><h6>Notes of b</h6>"
    rows = [(i, "http://a.example/", (two if i % 2 else one).format(i)) for i in range(12)]
    rows += [(20 + i, "http://small.example/", one.format(i)) for i in range(3)]
    got = texts_of(spark, rows)
    assert all(got[i] == f"Story {i}" for i in range(12)) and all(got[20 + i] == f"Story {i}" for i in range(3))


def test_copies_are_one_page(spark):
    source = "<div class=x><p>A story</p><p>told once</p></div>"
    rows = [(i, None, source) for i in range(6)] + [(10 + i, "http://a.example/", source) for i in range(7)]
    assert set(texts_of(spark, rows).values()) == {"A story\ntold once"}


def test_places_of_tokens():
    pages = {7: 9, 8: 5}
    of = {1: 7, 2: 7, 3: 7, 4: 8, 6: 8}
    nested = [1, 4, 6, 2, 3, 1, 2, 3]
    assert sorted(set(html_extract.places(nested, of, pages))) == [(1, 7, 0), (2, 7, 1), (3, 7, 2), (4, 8, 0), (6, 8, 1)]
    assert {(4, 7, 1), (6, 7, 2)} <= set(html_extract.places([1, 4, 2, 6, 3], of, pages))
    assert {(2, 7, 1), (2, 7, 2)} <= {*html_extract.places([1, 2, 3], of, pages), *html_extract.places([1, 3, 2], of, pages)}


def test_a_moving_block_is_no_template(spark):
    parts = ["<h2>Same words</h2>", "<h3>Others</h3>"]
    rows = [(i, "http://a.example/", f"<hr><div class=x>{''.join(parts[:: 1 if i % 2 else -1])}</div><p>{i}</p>") for i in range(8)]
    assert all("Same words" in text for text in texts_of(spark, rows).values())


def test_large_hosts_are_dealt_out(spark, monkeypatch):
    want = sorted(map(tuple, html_extract.op2_html_extract(spark, SF).collect()))
    monkeypatch.setattr(html_extract, "DEALT", 3)
    assert sorted(map(tuple, html_extract.op2_html_extract(spark, SF).collect())) == want


def test_pages_hold_whole_documents(spark):
    """The pages were made of documents: title, then the document's lines."""
    def plain(text):
        return "\n".join(y for x in text.split("\n") if (y := " ".join(x.split())))

    docs = {plain(r.text) for f in ("sf0.001", "sf0.01", "sf0.1") for r in table(spark, f"/root/testdata/{f}", "documents").select("text").collect()}
    texts = [r.text for r in html_extract.op2_html_extract(spark, SF).collect()]
    assert sum(t.split("\n", 1)[-1] in docs for t in texts) == len(texts)


# --- conversations --------------------------------------------------------------------------------------------------


def test_preference_pairs(spark):
    schema = "pair_id long, turn long, role string, text string, side int"
    chosen = [(1, 0, "system", "s", 0), (1, 1, "user", "q", 0), (1, 2, "assistant", "good", 0), (2, 0, "user", "same", 0), (3, 0, None, None, 0), (None, 0, "user", "x", 0), (1, 1, "user", "q", 0)]
    rejected = [(1, 0, "system", "s", 0), (1, 1, "user", "q", 0), (1, 2, "assistant", "bad", 0), (1, 3, "user", "why", 0), (2, 0, "user", "same", 0)]
    rows = chat_pairs.format_pairs(spark.createDataFrame(chosen, schema), spark.createDataFrame(rejected, schema)).collect()
    got = sorted((r.pair_id, r.part, r.turn, r.rendered, r.start, r.learn_from) for r in rows)
    assert got == [
        (1, "chosen", 2, "<|assistant|>\ngood<|end|>\n", 0, 14),
        (1, "prompt", 0, "<|system|>\ns<|end|>\n", 0, None),
        (1, "prompt", 1, "<|user|>\nq<|end|>\n", 20, None),
        (1, "rejected", 2, "<|assistant|>\nbad<|end|>\n", 0, 14),
        (1, "rejected", 3, "<|user|>\nwhy<|end|>\n", 25, None),
        (2, "prompt", 0, "<|user|>\nsame<|end|>\n", 0, None),
        (3, "chosen", 0, "<|unknown|>\n<|end|>\n", 0, None),
    ]
    none = spark.createDataFrame([], schema)
    assert chat_pairs.format_pairs(none, none).collect() == []


def test_offsets_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(chat_pairs, "BLOCK", 2)
    con = duck(SF)
    assert difference(chat_pairs.op7_chat_pairs(spark, SF), con, chat_pairs.SQL) is None


# --- pipeline -------------------------------------------------------------------------------------------------------


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        kept[name] = docs.count()
        assert docs.columns == columns and docs.filter("n_chars <> char_length(text)").count() == 0
    assert kept["quality_rules"] > kept["line_dedup"] >= kept["shingle_join"] == kept["secret_scans"] > 0
    whole = plain_components([r.text for r in docs.orderBy("doc_id").collect()], 5, 80)
    assert len({c for _, c in whole.values()}) == len(whole)
    rows = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in rows.collect()} == {r.doc_id for r in docs.collect()}


def test_the_guard_is_in_one_place():
    for path in [Path(corpus_pipeline.__file__), *Path(queries.__file__).parent.glob("*.py")]:
        assert "ImportError" not in path.read_text() and "localCheckpoint" not in path.read_text()
