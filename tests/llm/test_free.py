"""Token counts, HTML text, language ID, packing, near-duplicates, BPE and the pipeline: brute force,
exact round trips, held-out accuracy, edge rows."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import bpe, common, html_extract, language, packing, queries, simhash, token_counts

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(bpe.default_path())


# ------------------------------------------------------------------ BPE
def test_ids_and_texts_equal_the_library(spark, docs, odd, library):
    for df in (docs, odd):
        ids = bpe.encode(df, carry=["doc_id", "text"])
        for r in bpe.decode(ids.withColumnRenamed("text", "given"), carry=["doc_id", "given", "ids"]).collect():
            want = library.encode(r.given or "", add_special_tokens=False).ids
            assert r.ids == want and r.text == library.decode(want, skip_special_tokens=False)


def test_random_texts(library):
    with open(bpe.default_path(), "rb") as f:
        model = bpe.Bpe(f.read())
    rnd = random.Random(10)
    letters = "abcdeghilnorstuABC  \n\t\r\x0b\x0c\x1c\x1f\x85\xa0 　​'śd0123\xbd٣\xe9漢한\U0001f600\x00�<|>.,!_"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(rnd.choice("aab ") for _ in range(rnd.randint(0, 60))) for _ in range(500)]
    texts += ["a" * 3000, " " * 3000, "", "<|endoftext|>", "x<|endoftext|> <|endoftext|>y  ", "<|endoftext", "xyz" * 200]
    got = model.encode(texts)
    import numpy as np
    for t, g, w in zip(texts, got, library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(g, "<i4").tolist() == w.ids, t
    assert 0 < model.stats["failed"] < model.stats["proposed"]
    noise = [[rnd.randrange(50257) for _ in range(12)] for _ in range(500)]
    assert all(model.decode(x) == library.decode(x, skip_special_tokens=False) for x in noise)
    model.known.clear()
    bpe.PART_CHARS, kept = 100, bpe.PART_CHARS  # long texts go in parts
    try:
        assert model.encode(texts) == got
    finally:
        bpe.PART_CHARS = kept


def test_bpe_empty_table(none):
    assert bpe.encode(none).count() == bpe.count_tokens(none).count() == 0


# ------------------------------------------------------------------ token counts
def test_suffix_sums_match_brute_force(spark, odd, none):
    rnd = random.Random(2)
    n = [rnd.choice([0, 1, 5, 1023, 1024, 1025, 5000, rnd.randint(0, 9000)]) for _ in range(400)]
    df = spark.createDataFrame([(x,) for x in n] + [(None,)], "n_tokens long")
    n.append(0)
    hist = token_counts.length_histogram(df)
    rows = token_counts.context_report(hist).collect()
    assert sorted(r.context_limit for r in rows) == sorted(set(n))
    for r in rows:
        x = r.context_limit
        assert (r.n_docs, r.docs_from, r.tokens_from) == (n.count(x), sum(y >= x for y in n), sum(y for y in n if y >= x))
        assert r.truncated_tokens == sum(min(x, y) for y in n) and (r.all_docs, r.all_tokens) == (len(n), sum(n))
        assert r.share_fitting == pytest.approx(sum(y <= x for y in n) / len(n))
    for r in token_counts.answer_limits(hist, [0, 3, 1024, 4000, 10**6]).collect():
        assert (r.truncated_tokens, r.docs_over) == (sum(min(r.context_limit, y) for y in n), sum(y > r.context_limit for y in n))
    for r in token_counts.quantiles(hist, [0.1, 0.5, 1.0]).collect():
        assert r.length == min(x for x in set(n) if sum(y <= x for y in n) / len(n) >= r.share - 1e-12)
    assert token_counts.context_report(token_counts.length_histogram(bpe.count_tokens(none))).count() == 0


def test_token_counts_query(spark, docs, library):
    n = [len(e.ids) for e in library.encode_batch([r.text for r in docs.collect()], add_special_tokens=False)]
    rows = queries.QUERIES["op2_token_counts"](spark, SF).collect()
    assert {r.context_limit: r.n_docs for r in rows} == Counter(n) and rows[0].all_tokens == sum(n)


# ------------------------------------------------------------------ packing
def padding(bounds, hist):
    return sum(c * (min(b for b in bounds if b >= x) - x) for x, c in hist.items())


def test_boundaries_are_optimal():
    rnd = random.Random(6)
    for _ in range(300):
        hist = {x: rnd.randint(1, 9) for x in rnd.sample(range(30), rnd.randint(1, 9))}
        k, lengths = rnd.randint(1, 5), sorted(hist)
        best = min(padding((*c, lengths[-1]), hist) for r in range(k) for c in combinations(lengths[:-1], r))
        got = packing.optimal_boundaries(hist, k)
        assert len(got) <= k and padding(got, hist) == best
    assert packing.optimal_boundaries({}, 3) == []


def check_packed(rows, lengths, context, budget):
    """All tokens once, in buckets of the best boundaries, batches full but for each bucket's last."""
    cut = [(i, s, s * context, min(context, n - s * context)) for i, n in lengths for s in range(max(1, -(-n // context)))]
    assert Counter((r[0], r.segment, r.start, r.length) for r in rows) == Counter(cut)
    hist = Counter(x[3] for x in cut)
    bounds = sorted({r.bucket for r in rows})
    assert sum(r.bucket - r.length for r in rows) == padding(packing.optimal_boundaries(hist, 16), hist)
    for b in bounds:
        places = sorted((r.batch, r.slot) for r in rows if r.bucket == b)
        size = max(1, budget // max(1, b))
        assert places == [(k // size, k % size) for k in range(len(places))]


@pytest.mark.parametrize("group_rows", [3, 50_000])
def test_packing(spark, group_rows):
    rnd = random.Random(3)
    lengths = [(i, rnd.choice([0, 7, 7, 7, rnd.randint(0, 300)])) for i in range(500)] + [(1, 7), (1, 7), (None, 9), (None, 0)]
    df = spark.createDataFrame(lengths, "doc_id long, n_tokens long")
    check_packed(packing.pack(df, context=64, budget=256, group_rows=group_rows).collect(), lengths, 64, 256)


def test_packing_edges(spark, odd, none):
    assert packing.pack(bpe.count_tokens(none)).count() == 0
    assert packing.pack(bpe.count_tokens(odd)).select("doc_id").distinct().count() == odd.select("doc_id").distinct().count()
    assert packing.pack(spark.createDataFrame([(1, None)], "doc_id long, n_tokens long")).first().length == 0


# ------------------------------------------------------------------ SimHash
def brute_groups(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= 3:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprint_by_its_definition(spark):
    import xxhash
    for text in ["", None, "One", "One two", "a b c a b c", "\xc9t\xc9 \xe9 x\ty\nz A"]:
        w = [x for x in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
        h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert simhash.text_fingerprint(text) % (1 << 64) == want
    one = spark.createDataFrame([("a b c",)], "t string").select(F.xxhash64("t")).first()[0]
    assert simhash.text_fingerprint("A b c") == one


@pytest.mark.parametrize("blocks", [1, 2, 4])
def test_links_match_all_pairs(spark, blocks):
    rnd = random.Random(7)
    fps = {rnd.getrandbits(64) for _ in range(120)}
    for x in list(fps)[:40]:  # chains of near copies
        for _ in range(6):
            for _ in range(rnd.randint(1, 4)):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
    fps = sorted(fps | {0, 1, 7, 15, 2**64 - 1, 2**64 - 2})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), blocks=blocks, tile_rows=16, guest_rows=64)
    roots = {r.node: r.root for r in common.connected_components(links).collect()}
    want, got = defaultdict(set), defaultdict(set)
    for x, g in zip(signed, brute_groups(fps)):
        want[g].add(x)
        got[roots.get(x, x)].add(x)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 160)] + [(200, 200), (7, 3), (3, 7)]
    got = {r.node: r.root for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicate_groups(spark, docs, odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[7].component_id == 0 and by[1].component_id == by[2].component_id == by[5].component_id == 1
    assert by[1].fingerprint == "0" * 16 and simhash.near_duplicates(none).count() == 0
    texts = {r.doc_id: r.text for r in docs.collect()}
    order = sorted(texts)
    want = brute_groups([simhash.text_fingerprint(texts[i]) % (1 << 64) for i in order])
    got = {r.doc_id: r.component_id for r in queries.QUERIES["op7_simhash_near_dedup"](spark, SF).collect()}
    assert got == {i: order[g] for i, g in zip(order, want)}


# ------------------------------------------------------------------ language ID
def test_language_accuracy_and_edges(spark, docs, odd, none):
    strange = [(900 + k, t, d, a) for k, (t, d, a) in enumerate(
        [("Это русский текст без смысла", "en", "a.ru"), ("", "en", None), (None, None, None), ("123 ### 4", "de", "x")])]
    known = [r for r in docs.select("doc_id", "text", "lang", "source").collect()]
    held_out = [(r.doc_id, r.text, r.lang if r.doc_id % 3 else None, r.source) for r in known]
    df = spark.createDataFrame(held_out + strange, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in language.identify(df).collect()}
    unseen = [r for r in known if r.doc_id % 3 == 0]  # their language was not declared, so not trained on
    assert sum(got[r.doc_id].language == r.lang for r in unseen) >= 0.98 * len(unseen)
    assert all(got[r.doc_id].kept for r in known)
    assert all(not got[i].kept and got[i].language == "und" for i in range(900, 904))
    rows = language.identify(odd)
    assert rows.count() == odd.count() and language.identify(none).count() == 0
    kept = language.keep_documents(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_a_label_of_two_documents_takes_no_gibberish(spark, docs):
    import random
    rnd = random.Random(6)
    known = [(r.doc_id, r.text, r.lang, r.source) for r in docs.where("lang is not null").collect()]
    few = [(8000, "qaf qol", "xx", None), (8001, "zim qol", "xx", None)]
    odd = [(9000 + i, " ".join("".join(rnd.choices("bcdfghjklmnpqrstvwxz", k=7)) for _ in range(60)), None, None) for i in range(5)]
    odd += [(9005, "".join(chr(rnd.randint(0x1200, 0x1350)) for _ in range(200)), None, None)]
    df = spark.createDataFrame(known + few + odd, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in language.identify(df).collect()}
    assert [got[r[0]].language for r in odd] == ["und"] * 6
    assert [got[r[0]].language for r in few] == ["xx"] * 2


def test_no_language_is_cut_by_rank(spark):
    import random
    rnd = random.Random(9)
    names = ["q" + a + b for a in "abcdefg" for b in "abcdefghij"]
    words = {x: ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(12)] for x in names}
    text = lambda x: " ".join(rnd.choices(words[x], k=40))
    rows = [(100 * k + i, text(x), x) for k, x in enumerate(names) for i in range(4 if k < 64 else 3)]
    rows += [(10_000 + k, text(x), None) for k, x in enumerate(names)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify(df, address_col=None).collect()}
    assert [got[10_000 + k].language for k in range(len(names))] == names


def test_language_evidence_of_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = pages.select("page_id", "url", F.regexp_replace("html", "<[^>]*>", " ").alias("text"), language.markup_language(F.col("html")).alias("lang"))
    got = language.identify(rows, "page_id", "text", "lang", "url", carry=["lang"]).collect()
    assert len(got) == rows.count() and all(r.host and "." in r.host for r in got)
    assert sum(r.language == r.lang for r in got) >= 0.9 * len(got)


def test_host_prior_decides_when_the_text_does_not(spark):
    de, en = "der die und ist nicht ein haus mit wald", "the and of is not a house with wood"
    rows = [(i, f"{de} {i}", "de", "http://a.beispiel.de/x") for i in range(30)] + [(100 + i, f"{en} {i}", "en", "http://b.example.co/x") for i in range(30)]
    rows += [(500, "ok", None, "http://a.beispiel.de/y"), (501, "ok", None, "http://b.example.co/y")]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert (got[500].language, got[501].language) == ("de", "en")


# ------------------------------------------------------------------ HTML
PARTS = [
    ("<article><h1>T</h1><p>One &amp; two&nbsp;three<p>Four <b>five</b>six</article>", "T\nOne & two three\nFour fivesix"),
    ("<nav><a href=x>Home</a></nav><article><p>Text.</p><section id=comments><p>First!</p></section></article><footer>f</footer>", "Text."),
    ("<div class='cookie-banner'>We use cookies</div><div id=main><p>Hello.</p><div class=comments><p>Nice.</p></div></div>", "Hello."),
    ("<article><p>a</p><aside>no</aside><p>b</p><form><input><button>Go</button></form><script>x()</script></article>", "a\nb"),
    ("<article><!-- c --><p>x &lt;y&gt; &#233;</p>\n\n<ul><li>one<li>two</ul><style>p{}</style></article>", "x <y> \xe9\none\ntwo"),
    ("", ""), (None, ""), ("<html><body></body></html>", ""), ("<<<>>", ""), ("<article></article>", ""),
]


def test_main_text_of_labelled_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    extra = spark.createDataFrame([(10_000 + k, None, h) for k, (h, _) in enumerate(PARTS)], pages.schema)
    got = {r.page_id: r.text for r in html_extract.extract_text(pages.union(extra)).collect()}
    for k, (h, want) in enumerate(PARTS):
        assert got[10_000 + k] == want, h


def test_main_text_is_the_article(spark):
    import html
    import re
    rows = queries.QUERIES["op3_html_main_text"](spark, SF).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        body = re.search("<article>(.*)</article>", pages[r.page_id], re.S)[1]
        parts = re.split("</?(?:p|h1)>", re.sub("<br>", " ", re.sub("</?b>", "", body)))
        want = "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)
        assert r.text == want and r.n_chars == len(want)


def test_marginals_match_enumeration():
    """Sum-product against all labellings of a small tree."""
    import itertools
    import math
    counts = Counter()
    for page in html_extract.marked_pages():
        counts.update(html_extract.count_page(page))
    model = html_extract.Model(dict(counts))
    tree = html_extract.Tree("<div class=comments><p>Words here.</p><a>x</a></div><p>More, of it.</p>")
    n = len(tree.tag)
    texts = [i for i in range(n) if tree.tag[i] == "#text"]
    own = [sum(model.words.get(w, 0) for w in tree.words(i)) for i in range(n)]
    for i in texts:
        own[i] = 3 / max(3, len(texts)) * model.shapes.get(tree.shape(i), 0)
    mass = [[0.0, 0.0] for _ in range(n)]
    for y in itertools.product((0, 1), repeat=n - 1):
        y = (0, *y)
        p = 1.0
        for i in range(1, n):
            c = model.tags.get(tree.tag[i], model.any)[y[tree.parent[i]]]
            p *= (c if y[i] else 1 - c) * (math.exp(own[i]) if y[i] else 1)
        for i in range(n):
            mass[i][y[i]] += p
    for i, odds in enumerate(model.marginals(tree)):
        if i:
            assert odds == pytest.approx(math.log(mass[i][1] / mass[i][0]), abs=1e-6)


def test_formulas_fallback_text_and_open_heads_are_seen():
    from collections import Counter
    counts = Counter()
    for page in html_extract.marked_pages():
        counts.update(html_extract.count_page(page))
    model = html_extract.Model(dict(counts))
    story = ("<article><p>A long sentence of the story, with commas, and a formula <math><mi>x</mi><mspace/><mo>=</mo><mn>42</mn></math> in it.</p>"
             "<noscript><p>The figure shows a plan, in short.</p></noscript><p>Another sentence of the story, the last one.</p></article>")
    whole = model.extract(f"<html><head><title>t</title></head><body>{story}</body></html>")
    assert "formula x=42 in it." in whole and "The figure shows a plan" in whole
    assert model.extract(f"<html><head><title>t</title><meta charset=utf-8>{story}</html>") == whole
    seen = lambda page: "".join(html_extract.Tree(page).text)
    assert seen("<head><title>t</title><style>s</style><template><p>no</p></template> yes") == " yes"
    assert seen("<p><svg><path/><text>label</text></svg><object>shown</object></p>") == "labelshown"


def test_html_empty_table(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.extract_text(empty).count() == 0


# ------------------------------------------------------------------ pipeline
def test_stages_keep_columns_and_rows(spark, odd, none):
    for frame in (odd, none):
        docs = frame
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == frame.columns, name
        last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        got = sorted(r.doc_id for r in last.select("doc_id").distinct().collect() if r.doc_id is not None)
        assert got == ([0] if frame is odd else [])  # the long text repeats its windows


def test_pipeline_against_brute_force(spark, docs, library):
    rows = corpus_pipeline.run(spark, SF).collect()
    from test_native import brute_base, brute_measures
    texts = {r.doc_id: r.text for r in docs.collect()}

    def good(t):
        n, chars, symbols, dup, repeat = brute_measures(t)
        return not (n < 10 or 100 * repeat > 20 * n or 10 * symbols > n or not 2 * n <= chars <= 20 * n or 2 * dup > len(t.split("\n"))
                    or 2 * sum("A" <= c <= "Z" for c in t) > chars or 4 * t.count("!") > n)

    stay = sorted(i for i, t in texts.items() if good(t))
    groups = brute_groups([simhash.text_fingerprint(texts[i]) % (1 << 64) for i in stay])
    stay = [i for k, i in enumerate(stay) if groups[k] == k]

    def scrubbed(t):
        out, at = [], 0
        for a, _, b, _ in brute_base(t):
            if a >= at:
                out += [t[at:a], "[SECRET]"]
            at = max(at, b)
        return "".join(out) + t[at:]

    lengths = [(i, len(library.encode(scrubbed(texts[i]), add_special_tokens=False).ids)) for i in stay]
    check_packed(rows, lengths, 8192, 65536)


def test_plain_pages_keep_their_text_and_lose_menus_and_form_parts(spark):
    """Pages of one to five paragraphs without an article or telling names, under the model of the test pages."""
    import html
    rnd = random.Random(2)
    model = html_extract.train(spark.read.parquet(f"{SF}/pages.parquet"))
    whole = {k: 0 for k in ("body", "div", "br", "table")}
    texts = [r.text.split() for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text and len(r.text.split()) > 20]
    for w in texts:
        step = max(5, len(w) // rnd.randint(1, 5))
        parts = [" ".join(w[i:i + step]) for i in range(0, len(w), step)]
        safe = [html.escape(x) for x in parts]
        body, lines = "".join(f"<p>{x}</p>" for x in safe), "\n".join(parts)
        whole["body"] += model.extract(f"<html><head><title>t</title></head><body>{body}</body></html>") == lines
        whole["div"] += model.extract(f"<html><body><nav><a href=/>Home</a> <a href=x>Next</a></nav><div>{body}</div><footer>Foot</footer></body></html>") == lines
        whole["br"] += model.extract(f"<html><body>{'<br><br>'.join(safe)}</body></html>") == " ".join(parts)
        whole["table"] += model.extract(f"<table><tr><td><a href=a>Home</a><br><a href=b>News</a></td><td>{body}</td></tr></table>") == lines
    assert all(n >= 0.98 * len(texts) for n in whole.values()), (whole, len(texts))

    said = "A first long sentence of the story stands here, as it should."
    page = lambda inner: model.extract(f"<article><p>{said}</p><p>{inner}</p><p>{said}</p></article>").split("\n")[1:-1]
    for gap in ("<img src=x><br>", "<a name=q></a><br>", "<svg><path/></svg><br/>", "<br>", "<b></b><br><i></i>"):
        assert page(f"Words one{gap}two of it.") == ["Words one two of it."]
    assert page("Some text <button>Click me</button> and the rest.") == ["Some text and the rest."]
    assert page("Some text <textarea>typed</textarea><select><option>a</select> and the rest.") == ["Some text and the rest."]


def test_tags_that_name_no_language_are_no_hypothesis(spark):
    rnd = random.Random(9)
    noise = lambda: "".join(rnd.choice("qwxzjkvypfbmg ") for _ in range(300))
    rows = [(i, noise(), t, None) for i, t in enumerate(["und", "Unknown", "null", "zxx", "mul-x", "mis", "none"] * 10)]
    rows += [(1000 + i, r.text, "en", None) for i, r in enumerate(spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").collect())]
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert all((r.language, r.kept, r.declared) == ("und", False, None) for r in got if r.doc_id < 1000)
    assert sum(r.kept for r in got if r.doc_id >= 1000) >= 0.98 * (len(rows) - 70)


def brute_posteriors(rows, shrink=20.0):
    """(language, posterior) by id from the definition, in plain loops: rows are (id, text, declared, host)."""
    from math import exp, log
    names = sorted({d for _, _, d, _ in rows if d})
    buckets = {i: [int(b) for part in language.trigrams(t) for b in part] for i, t, _, _ in rows}
    sample = {x: Counter(b for i, _, d, _ in rows if d == x for b in buckets[i]) for x in names}
    space, share = language.BUCKETS, language.FLOOR_SHARE

    def soft(scores):
        top = max(scores)
        e = [exp(s - top) for s in scores]
        return [x / sum(e) for x in e]

    like, first = {}, {}
    for i, _, _, _ in rows:
        n = len(buckets[i])
        means = [sum(log((1 - share) * sample[x][b] / sum(sample[x].values()) + share / space) for b in buckets[i]) / max(n, 1) for x in names]
        like[i] = [m * n / (1 + n / language.SATURATION) for m in [*means, language.UND_TRIGRAM]]
        first[i] = soft(like[i])
    size = len(names) + 1
    suffix = lambda h: h.rsplit(".", 1)[1] if h and "." in h and h.rsplit(".", 1)[1].isalpha() else None
    domain = lambda h: ".".join(h.split(".")[-2:]) if h else None
    sums = lambda key: {v: [sum(first[r[0]][k] for r in rows if key(r) == v) for k in range(size)]
                        for v in {key(r) for r in rows} - {None}}
    declared, suffixes = sums(lambda r: r[2]), sums(lambda r: suffix(r[3]))
    domains, hosts = sums(lambda r: domain(r[3])), sums(lambda r: r[3])
    total = [sum(p[k] for p in first.values()) for k in range(size)]
    world = [(x + 1) / (sum(total) + size) for x in total]

    def shrunk(m, own, parent):
        rest = [max(a - b, 0.0) for a, b in zip(m or own, own)]
        return [(a + shrink * b) / (sum(rest) + shrink) for a, b in zip(rest, parent)]

    out = {}
    for i, _, d, h in rows:
        prior = shrunk(hosts.get(h), first[i], shrunk(domains.get(domain(h)), first[i], world))
        score = [s + log(p) for s, p in zip(like[i], prior)]
        for table, v in ((declared, d), (suffixes, suffix(h))):
            if v:
                score = [s + log((m + 1) / (t + len(table) + 1)) for s, m, t in zip(score, table[v], total)]
        post = soft(score)
        best = post.index(max(post))
        out[i] = (names[best] if best < len(names) and buckets[i] else "und", max(post))
    return out


def test_posteriors_match_brute_force(spark, docs):
    import random
    rnd = random.Random(12)
    hosts = ["a.beispiel.de", "b.beispiel.de", "example.co", "x.example.co", "local", None]
    known = docs.orderBy("doc_id").limit(90).collect()
    rows = [(r.doc_id, r.text[:rnd.choice([8, 40, 400])], rnd.choice([r.lang, r.lang, None]), rnd.choice(hosts)) for r in known]
    rows += [(8000, "", "en", "a.beispiel.de"), (8001, None, None, None), (8002, "zzqx qxzz kkwv", None, "example.co")]
    want = brute_posteriors(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: (r.language, r.posterior) for r in language.identify(df).collect()}
    assert got.keys() == want.keys()
    for i, (name, posterior) in want.items():
        assert got[i][0] == name and abs(got[i][1] - posterior) < 1e-5, (i, got[i], want[i])


def test_near_dedup_leaves_one_row_of_each_group(spark):
    from quire.llm import stages
    base = "seven plain words stand in this row and many more follow them here"
    rows = [(5, base, "a"), (3, base, "b"), (3, base, "b"), (3, base, "c"), (9, "quite another text of several words with nothing in common at all", "d"),
            (9, "quite another text of several words with nothing in common at all", "d"), (None, base, "e"), (7, "the one lone row stands apart from all of the other rows", "f")]
    got = stages.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string, gone_id string"), SF)
    assert got.columns == ["doc_id", "text", "gone_id"]
    assert sorted(r.doc_id for r in got.collect()) == [3, 7, 9]
    lone = spark.createDataFrame([(None, base, "x"), (None, base, "x")], "doc_id long, text string, gone_id string")
    assert [r.gone_id for r in stages.near_dedup(spark, lone, SF).collect()] == ["x"]
