"""Top-k search, near-duplicates, page text and revisits against brute force and on odd input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import components, impact_search, near_copies, simhash_bk, site_style, warc_revisits
from tests.llm import odd


def plain_top(rows, k):
    out = set()
    usable = {i: np.floor(64 * np.array(v, float)).astype(int) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all()}
    width = max(map(len, usable.values()))
    usable = {i: np.pad(v, (0, width - len(v))) for i, v in usable.items()}
    for q in (i for i in usable if i % 20 == 0):
        best = sorted(((-int(usable[q] @ v), i) for i, v in usable.items() if i != q))[:k]
        out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("kind", ["spread", "tied", "few", "large"])
def test_top_k(spark, monkeypatch, kind):
    monkeypatch.setattr(impact_search, "VECTOR_BLOCK", 150)
    monkeypatch.setattr(impact_search, "QUERY_BLOCK", 7)
    rnd = np.random.default_rng(1)
    n = {"few": 9, "large": 300}.get(kind, 700)
    values = rnd.normal(size=(n, 16)) if kind == "spread" else rnd.integers(-1, 2, size=(n, 16)) / 8 if kind == "tied" else rnd.normal(size=(n, 16)) * (1000 if kind == "large" else 1)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(values)]
    rows += [(1000, None), (1020, [1.0, None]), (1040, [float("nan")] * 16), (1060, [float("inf")] * 16), (None, [1.0] * 16), (1080, [0.5] * 4), (1100, [])]
    vectors = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, score string, rank int")
    got = {tuple(r) for r in impact_search.top_k(vectors, F.col("vec_id") % 20 == 0, k=20).collect()}
    assert got == plain_top(rows, 20)


def test_top_k_of_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(impact_search, "VECTOR_BLOCK", 10)
    rows = [(20, [1.0, 2.0])] * 50 + [(21, [1.0, 1.0])] * 3
    got = impact_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=2).collect()
    assert {(r["rank"], r["vec_id"], r["score"]) for r in got} == {(1, 21, 64 * 64 * 3), (2, 21, 64 * 64 * 3)} and len(got) == 2


def test_reading_stops_early_and_loses_nothing():
    rnd = np.random.default_rng(2)
    values = np.floor(64 * rnd.normal(size=(3000, 64)) / 8).astype(np.int64)
    index, queries = impact_search.ImpactIndex(values), values[:40]
    query, row, score = index.search(queries, np.zeros((3000, 40), bool), 20)
    exact = queries @ values.T
    for q in range(40):
        best = set(np.argsort(-exact[q], kind="stable")[:20].tolist())
        assert best <= set(row[query == q].tolist()) and (score[query == q] == exact[q][row[query == q]]).all()
    assert len(row) < 0.2 * 3000 * 40


def test_search_of_empty_tables(spark):
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert impact_search.top_k(vectors, F.col("vec_id") % 20 == 0, k=20).collect() == []


def plain_simhash(text):
    import xxhash

    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()]
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(prints, ids):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    least = {}
    for i, name in enumerate(ids):
        if name is not None:
            least[root(i)] = min(least.get(root(i), name), name)
    return [least.get(root(i)) for i in range(len(prints))]


def test_simhash_classes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(odd.documents(spark).select(F.col("doc_id") + 5000, "text").toDF("doc_id", "text"))
    rows = simhash_bk.classes(docs, F.col("doc_id"), F.col("text")).collect()
    prints = [plain_simhash(r["carried_1"]) for r in rows]
    assert [r["print"] % 2**64 for r in rows] == prints
    assert [r["component_id"] for r in rows] == plain_components(prints, [r["carried_0"] for r in rows])


def near(rnd, n, centres, flips):
    base = rnd.integers(0, 2**63, centres, dtype=np.uint64)[rnd.integers(0, centres, n)]
    for _ in range(flips):
        base ^= np.uint64(1) << rnd.integers(0, 64, n).astype(np.uint64)
    return np.unique(base)


def test_links_of_split_shards_connect_what_is_close(spark):
    prints = near(np.random.default_rng(3), 700, 12, 3)
    table = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "print long")
    roots = {r["node"]: r["root"] for r in components.least_members(simhash_bk.links(table, shard=16)).collect()}
    got = [roots.get(int(p), int(p)) for p in prints.view(np.int64)]
    assert got == plain_components([int(p) % 2**64 for p in prints], [int(p) for p in prints.view(np.int64)])


def test_one_of_each(spark):
    docs = odd.documents(spark)
    kept = simhash_bk.one_of_each(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    all_prints = {plain_simhash(r["text"]) for r in docs.collect()}
    classes = set(plain_components(sorted(all_prints), sorted(all_prints)))
    assert len(rows) == len(classes)
    assert {1, 5, 6} <= {r["doc_id"] for r in rows} and 2 not in {r["doc_id"] for r in rows}
    assert simhash_bk.one_of_each(odd.empty(spark)).collect() == [] and simhash_bk.classes(odd.empty(spark)).collect() == []


# --- near copies of the pipeline


def plain_kept(rows):
    """Ids that stand for their components of texts with five-word Jaccard 4/5 or more, over all pairs."""
    sets = []
    for _, text in rows:
        words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
        sets.append({b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if part[i] != part[j] and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                old = part[i]
                part = [part[j] if p == old else p for p in part]
    return sorted(min(r[0] for r, p in zip(rows, part, strict=True) if p == q) for q in set(part))


def edited(rnd, words, changes):
    out = list(words)
    for at in rnd.choice(len(out), changes, replace=False):
        out[at] = f"new{rnd.integers(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("shard", [near_copies.SHARD, 4])
def test_near_copies_of_the_pipeline_miss_no_pair(spark, sf_dir, shard):
    import corpus_pipeline

    rnd = np.random.default_rng(4)
    made = []
    for size in (4, 5, 12, 40, 150, 300):
        words = [f"w{rnd.integers(900)}" for _ in range(size)]
        made += [" ".join(words), *[edited(rnd, words, min(c, size)) for c in (0, 1, 2, 3, 4, 6)]]
        made += [f"{' '.join(words)} the same tail of many texts on this page {rnd.integers(10**6)}" for _ in range(4)]
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows += [(10_000 + i, t) for i, t in enumerate(made)] + [(20_000, None), (20_001, " \t"), (20_002, "")]
    docs = spark.createDataFrame([(*r, "p") for r in rows], "doc_id long, text string, print string")
    kept = corpus_pipeline.near_duplicates(spark, docs, sf_dir) if shard == near_copies.SHARD else near_copies.one_of_each(docs, shard=shard)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == plain_kept(rows)


def test_a_large_group_of_near_copies_beside_strays(spark):
    rnd = np.random.default_rng(6)
    base, other = ([f"{p}{rnd.integers(900)}" for _ in range(120)] for p in "wv")
    half = base[:60] + other[:60]
    texts = [edited(rnd, base, 1 + i % 4) for i in range(150)] + [edited(rnd, half, 1) for _ in range(5)] + [edited(rnd, base[:100] + other[:20], 2) for _ in range(5)] + [" ".join(other)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for shard in (near_copies.SHARD, 16):
        assert sorted(r["doc_id"] for r in near_copies.one_of_each(docs, shard=shard).collect()) == plain_kept(rows)


def test_near_copies_of_odd_rows(spark):
    got = [r["doc_id"] for r in near_copies.one_of_each(odd.documents(spark)).collect()]
    assert sorted(got) == [-8, 1, 3, 5, 6]
    assert near_copies.one_of_each(odd.empty(spark)).collect() == []


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 140)] + [(5, 5), (200, 150), (150, 200), (2, 1)]
    got = {r["node"]: r["root"] for r in components.least_members(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(2, 61)} | {i: 100 for i in range(101, 140)} | {200: 150}
    assert components.least_members(spark.createDataFrame([], "a long, b long")).collect() == []


# --- pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>Site head</header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- <p>no</p> --><div class="cookie-notice">We use cookies</div><div class="ad">Buy</div>
<article><h1>A &amp; B</h1><p><b>First   para<br>graph &lt;x&gt;<p>Second&nbsp;one</p><div class="share-tools">Share</div><form><input>Send</form><pre>kept
text</pre><table><tr><td>c1</td><td>c2</td></tr></table><button>Press</button>
<p title="a>b">Quoted</p></article><aside>Side</aside><section id="comments"><p>reader says</p></section><footer>&copy; foot</footer></body></html>"""


def plain_text(page, low=frozenset()):
    """The main text of a parsed page, with what `low` holds and, without a host, low priors left out."""
    gone = {p for p, above, prior in zip(page.paths, page.above, page.priors, strict=True) if low & set(above)}
    kept = [(zone, text) for at, zone, text in page.blocks if page.paths[at] not in gone]
    article, main, prose = ("\n".join(t for z, t in kept if z == zone) for zone in (site_style.ARTICLE, site_style.MAIN, site_style.PROSE))
    if article and len(article) >= len(main or prose):
        return article
    return "\n".join(t for z, t in kept if z in (site_style.MAIN, site_style.ARTICLE)) if main else "\n".join(t for _, t in kept)


def without_host(html):
    page = site_style.parse(html)
    return plain_text(page, frozenset(p for p, prior in zip(page.paths, page.priors, strict=True) if prior is not None and prior * site_style.UNJUDGED < site_style.LOW_IMPORTANCE))


def plain_site(pages):
    """The texts of one host's pages by a tree that is counted in plain Python."""
    told = [site_style.parse(h) for h in pages]
    different = list({h: p for h, p in zip(pages, told, strict=True)}.values())
    at, prior, branch, out = {}, {}, {}, set()
    for p in different:
        for path in {x for i, *_ in p.blocks for x in p.above[i]}:
            i = p.place[path]
            at.setdefault(path, []).append(p)
            prior.setdefault(path, []).append(p.priors[i])
    for path, holders in at.items():
        shares = {}
        for p in different:
            for i, text in {(i, t) for i, _, t in p.blocks}:
                if path in p.above[i]:
                    shares.setdefault((p.paths[i], text), []).append(len(at[p.paths[i]]))
        bits = [np.log(m[0] / len(m)) for m in shares.values() for _ in m]
        styles = [s for p in different for x, s in p.styles if x == path]
        counts = np.array([styles.count(s) for s in set(styles)]) / max(1, len(styles))
        looks = 1 - np.exp(np.sum(counts * np.log(counts))) if styles else 0.0
        branch[path] = 0.1 * looks + 0.9 * (1 - np.exp(-np.mean(bits)))
        importance = ((len(holders) - 1) * branch[path] + site_style.SAY * site_style.UNJUDGED) / (len(holders) - 1 + site_style.SAY)
        told_of = [x for x in prior[path] if x is not None]
        if told_of and importance * np.mean(told_of) < site_style.LOW_IMPORTANCE:
            out.add(path)
    return [plain_text(p, out) for p in told], branch


def extracted(spark, rows):
    pages = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, low int")
    return {r["carried_0"]: r["text"] for r in site_style.extract(pages, F.col("page_id")).collect()}


SINGLE_PAGES = {
    PAGE: "A & B\nFirst para graph <x>\nSecond one\nkept text\nc1 c2\nQuoted", None: "", "": "", "plain &amp; simple": "plain & simple", "a < b <3 c": "a < b <3 c",
    "<body><p>one<p>two<div>three</div><ul><li>a<li>b</ul>": "one\ntwo\nthree\na\nb", "<article><p>cut off <b": "cut off", "<head><title>t</title><body><p>x": "x",
    '<body class="has-sidebar ad"><div class="content no-comments"><article class="post"><p>x</p><div class="post-comments"><article class="comment"><p>y</p></article></div></article></div>': "x",
    "<main><p>m</p></main><p>o</p>": "m", "<article><p>short</p></article><p>The text of the page stands beside the article and is longer.</p>": "short\nThe text of the page stands beside the article and is longer.",
    "<!--><p>a</p><!-- <p>b</p> --><p>c</p><!-- d": "a\nc", "<p title='x>y' class=\"a>b\">q</p><p a='>r</p>": "q\nr",
}


def test_main_text(spark):
    rows = [(i, None, html) for i, html in enumerate(SINGLE_PAGES)] + [(99, None, "<p>" + "x" * 200_000)]
    got = extracted(spark, rows)
    assert got == dict(enumerate(SINGLE_PAGES.values())) | {99: "x" * 200_000}
    assert all(without_host(html) == text for html, text in SINGLE_PAGES.items())


BODY = "The harbour lay under snow for a month and the letters came late to the keeper of the light. " * 4
WRAPPED = {
    f'<body><form id="aspnetForm" method=post><input type=hidden name=v><div class=menu><a href=/>Home</a></div><h1>T of snow</h1><p>{BODY}</p><input name=q></form>': f"T of snow\n{BODY.strip()}",
    f'<div id="page-search"><article><p>{BODY}</p></article></div><footer>f</footer>': BODY.strip(),
    f'<article><p>{BODY}</p><section class="related-work"><p>Others wrote of snow too.</p></section></article>': f"{BODY.strip()}\nOthers wrote of snow too.",
    f'<article><p>{BODY}</p><div class="share-price"><p>It rose by a snow.</p></div><div class="notice-period"><p>A month of snow.</p></div></article>': f"{BODY.strip()}\nIt rose by a snow.\nA month of snow.",
    f'<article><p>{BODY}</p><div class="related-posts"><p>Read on</p></div><div class="social-share">Tell all</div><form class=f><p>Your name</p><input><input type=submit></form></article>': BODY.strip(),
    f'<div class="sidebar"><article><p>Teaser</p></article></div><main><p>{BODY}</p></main>': BODY.strip(),
    f'<article><p>{BODY}</p></article><section id="comments"><p>{BODY * 9}</p></section>': BODY.strip(),
}


def test_what_a_page_shows_overrules_names(spark):
    assert all(without_host(html) == text for html, text in WRAPPED.items())
    # The same with a host and its tree, on one page and on many.
    for n in (1, 8):
        rows = [(k * 100 + i, f"http://h{k}.example/{i}", html.replace("snow", f"snow{i}")) for k, html in enumerate(WRAPPED) for i in range(n)]
        got = extracted(spark, rows)
        assert all(got[k * 100 + i] == text.replace("snow", f"snow{i}") for k, text in enumerate(WRAPPED.values()) for i in range(n))


def test_a_tree_overrules_names_that_say_more(spark):
    page = lambda i: f"<article><p>{BODY} {i}</p><div class='related-work'><p>{'Always the same words' if i < 50 else f'Work {i}'}</p></div></article>"
    alike = extracted(spark, [(i, "http://a.example/", page(i)) for i in range(12)])
    apart = extracted(spark, [(i, "http://a.example/", page(i)) for i in range(50, 62)])
    assert all("Always" not in t for t in alike.values()) and all(f"Work {i}" in t for i, t in apart.items())


def test_parser_against_the_standard_one():
    """Words of well-formed pages in order, by an independent parser that knows no trees."""
    from html.parser import HTMLParser

    class Words(HTMLParser):
        def __init__(self):
            super().__init__()
            self.words, self.hidden = [], 0

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("script", "style")
            self.words += [" "] if tag in site_style.BLOCKS or tag in ("br", "td", "th") else []

        def handle_endtag(self, tag):
            self.hidden -= tag in ("script", "style")
            self.words += [" "] if tag in site_style.BLOCKS else []

        def handle_data(self, data):
            self.words += [] if self.hidden else [data]

    rnd = np.random.default_rng(4)

    def made(depth):
        kind = rnd.integers(9)
        if depth == 0 or kind < 3:
            return ["word ", "a &amp; b", "x &lt; y &#233;", "<b>bold</b> text", "<br>", "<!-- <p>no</p> -->", "<script>if (a < b) '<p>'</script>", "<i title='a>b'>q</i>"][rnd.integers(8)]
        tag = ["div", "p", "section", "ul", "table", "h2", "blockquote", "pre", "article"][rnd.integers(9)]
        inner = "".join(made(depth - 1) for _ in range(rnd.integers(4)))
        if tag == "ul":
            return "<ul>" + f"<li>{inner}</li>" * 2 + "</ul>"
        if tag == "table":
            return f"<table><tr><td>{rnd.integers(99)}</td><td>b</td></tr></table>"
        return f"<p>{rnd.integers(99)} p</p>" if tag in ("p", "h2", "pre") else f"<{tag} class='c{rnd.integers(3)}'>{inner}</{tag}>"

    for _ in range(300):
        html = "".join(made(4) for _ in range(4))
        told = Words()
        told.feed(html)
        told.close()
        assert " ".join(text for *_, text in site_style.parse(html).blocks).split() == "".join(told.words).split(), html


def test_hostile_pages_take_seconds():
    import time

    start = time.perf_counter()
    for html in ("<div>" * 200_000, "<a '" * 250_000, '<a ">" ' * 140_000, "<!" * 500_000, "<" * 1_000_000, "<div>" * 256 + "<p>x" * 200_000, "<svg \"" * 160_000):
        page = site_style.parse(html)
        assert max(map(len, page.above)) <= site_style.DEPTH + 1
    assert time.perf_counter() - start < 40
    assert len(site_style.parse("<div>" * 2000 + "deep").blocks) == 1


def test_self_closed_svg_and_math_are_empty():
    for icon in ("<svg/>", '<svg class="a/b" href="x>y" />', "<math display=block/>", "<SVG width='1' />"):
        assert without_host(f"<article><p>one {icon} two</p><p>three</p><svg><text>no</text></svg><p>four</p></article>") == "one two\nthree\nfour"
    assert without_host('<p>a</p><svg viewBox="0 0"><path d="M0"/><text>no</text></svg><p>b</p>') == "a\nb"


def test_teaser_articles_do_not_replace_main_text():
    body = "The whole text of the page stands here and goes on for a while."
    cards = "<article><p>Card one</p></article><article><p>Card two</p></article>"
    assert without_host(f"<main><p>{body}</p></main>{cards}").startswith(body)
    assert body in without_host(f"<main>{cards}<p>{body}</p></main>")
    assert without_host(f"<main><p>Up</p><article><p>{body}</p></article></main>") == body


def test_style_tree_drops_what_a_site_repeats(spark):
    rows = [(i, f"http://one.example/{i}", f"<body><div class=x1>Follow us on this site</div><article><p>Text {i} of its own</p><div class=tail>Ask the desk for reprints</div></article>") for i in range(12)]
    rows += [(i, "http://two.example/", rows[0][2]) for i in range(20, 40)] + [(50, None, rows[0][2]), (51, "http://one.example/x", None), (52, "http://one.example/y", "")]
    got = extracted(spark, rows)
    assert all(got[i] == f"Text {i} of its own" for i in range(12)) and len(got) == len(rows)
    assert all(got[i] == "Text 0 of its own\nAsk the desk for reprints" for i in [*range(20, 40), 50]) and got[51] == "" and got[52] == ""
    assert extracted(spark, []) == {}


def test_style_tree_against_a_plain_one(spark):
    rnd = np.random.default_rng(8)
    word = lambda k: f"w{rnd.integers(k)}"

    def made(i):
        menu = "".join(f"<li>{t}" for t in ("Home", "News", "Shop")[: 2 + i % 2])
        cells = "".join(f"<tr><td>Size<td>{word(4)}" for _ in range(rnd.integers(3)))
        return f"""<body><div class=bar><ul>{menu}</ul></div><div class=widget-{i % 3}>{word(3) if i % 2 else "Write to us"}</div><div class="text widget-body"><p>{word(999)} {i}</div>
        <main><h2>Background</h2><p>{i} {word(99)}</p><div class=tip>{word(2)}</div><table>{cells}</table><article><h2>Methods</h2><p>own {i}</p><p>All alike</p><table>{cells}</table></article></main><div>{"Seen by all" if i % 9 else word(50)}</div>"""

    for n in (4, 40):
        pages = [made(i) for i in range(n)] + [made(1)] * 3
        want, tree = plain_site(pages)
        assert extracted(spark, [(i, "http://a.example/", h) for i, h in enumerate(pages)]) == dict(enumerate(want))
        held = spark.createDataFrame([("http://a.example/", h) for h in pages], "url string, html string")
        found = {r["path"]: r["importance"] for r in site_style.style_tree(site_style.parsed(held)).collect()}
        assert found.keys() == tree.keys() and all(abs(found[p] - tree[p]) < 1e-9 for p in tree)


def test_verdicts_do_not_depend_on_the_size_of_a_host(spark):
    heads = ("Background", "Methods", "Results", "Outlook", "Sources")
    page = lambda i: f"<body><div class=strip>{('Read on', 'Follow us')[i % 20 == 0]}</div><div class=x><h3>{heads[i % 5]}</h3><div class=by>{'ABCDE'[i % 5]}</div><p>Text {i}</p></div>"
    want = lambda i: f"{heads[i % 5]}\n{'ABCDE'[i % 5]}\nText {i}"
    for n in (100, 10_000):
        got = extracted(spark, [(i, "http://a.example/", page(i)) for i in range(n)])
        assert all(got[i] == want(i) for i in range(n))


# --- revisits


def test_canonical_urls(spark):
    urls = ["http://WWW.Example.com:80/a/?b=2&a=1&utm_source=x#f", "https://example.com/a?a=1&b=2", "https://example.com/index.html", "https://example.com", "no url", None]
    got = [r[0] for r in spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").orderBy("i").select(warc_revisits.canonical_url(F.col("u"))).collect()]
    assert got == ["example.com/a?a=1&b=2", "example.com/a?a=1&b=2", "example.com", "example.com", None, None]


def test_revisits(spark):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    profile = "http://netpreserve.org/warc/1.0/revisit/server-not-modified"
    full = lambda i, h, tag, **more: (i, "http://e.org/a", t + dt.timedelta(hours=h), "response", None, 200, {"etag": tag, "content-length": "9", "content-type": "text/html", **more})
    seen = lambda i, h, url="https://www.e.org/a/", **fields: (i, url, None if h is None else t + dt.timedelta(hours=h), "revisit", profile, 304, fields)
    rows = [
        full("r1", 0, '"1"'), full("r2", 50, '"2"', **{"last-modified": "d"}), full("r3", 50, '"3"'), ("r4", "http://e.org/a", t + dt.timedelta(hours=60), "response", None, 404, {"etag": '"4"'}),
        seen("early", -1, etag='"1"'), seen("same", 0, etag='"1"'), seen("v1", 30, etag='W/"1"', **{"content-length": "0", "cache-control": "no"}), seen("v2", 55, etag='"2"'), seen("v3", 400, etag='"3"'),
        seen("plain", 2), seen("dated", 51, **{"last-modified": "d"}), seen("lost", None, etag="x"), seen("nowhere", 5, url=None, etag="x"), seen("v1", 30, etag='W/"1"', **{"content-length": "0", "cache-control": "no"}),
    ]
    records = spark.createDataFrame(rows, "record_id string, url string, time timestamp_ntz, kind string, profile string, status int, headers map<string,string>")
    got = [(r["revisit_id"], r["outcome"], r["response_id"], r["headers"]) for r in warc_revisits.resolve(records).collect()]
    told = {g[0]: g[1:3] for g in got}
    assert told == {"early": ("no_response", None), "same": ("no_response", None), "v1": ("resolved", "r1"), "v2": ("mismatch", None), "v3": ("resolved", "r3"), "plain": ("unvalidated", None), "dated": ("mismatch", None), "lost": ("no_response", None), "nowhere": ("no_response", None)}
    assert len(got) == 10
    assert next(g[3] for g in got if g[0] == "v1") == {"etag": 'W/"1"', "content-length": "9", "content-type": "text/html", "cache-control": "no"}
    assert warc_revisits.resolve(records.where("false")).collect() == []


def test_records_are_parsed_from_raw_bytes(spark):
    raw = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nWARC-Target-URI: http://e.org/\r\nWARC-Date: 2024-01-01T00:00:05Z\r\n\r\nHTTP/1.1 200 OK\r\nETag: \"1\"\r\nX: 1\r\nX: 2\r\n\r\nbody\r\n\r\nETag: no"
    row = warc_revisits.parsed(spark.createDataFrame([(raw,)], "raw string")).first()
    assert row["record_id"] == "<a>" and row["status"] == 200 and row["headers"] == {"etag": '"1"', "x": "2"} and str(row["time"]) == "2024-01-01 00:00:05"


def test_dates_with_fractions_and_repeated_fields(spark):
    head = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nWARC-Date: {}\r\n\r\nHTTP/1.1 200 OK\r\nX: 1\r\na: 2\r\nX: 3\r\nA: 0\r\n\r\n"
    dates = {"2024-01-01T00:00:05.25Z": "2024-01-01 00:00:05.250000", "2024-01-01T00:00:05.123456789Z": "2024-01-01 00:00:05.123456", "2024-01-01T00:00:05Z": "2024-01-01 00:00:05", "2024-13-01T00:00:05Z": "None", "2024-01-01": "None"}
    rows = warc_revisits.parsed(spark.createDataFrame([(head.format(d),) for d in dates], "raw string")).collect()
    assert [str(r["time"]) for r in rows] == list(dates.values()) and all(r["headers"] == {"x": "3", "a": "0"} for r in rows)


def test_many_captures_of_a_url_in_a_day(spark):
    import datetime as dt

    rnd = np.random.default_rng(5)
    start, profile = dt.datetime(2024, 1, 1), "http://netpreserve.org/warc/1.0/revisit/server-not-modified"
    rows = [(f"{i:04d}", "http://e.org/a", start + dt.timedelta(seconds=int(rnd.integers(200_000) // (1 + 99 * (i % 2)))), *(("response", None, 200) if i % 3 else ("revisit", profile, 304)), {"etag": '"1"'}) for i in range(900)]
    records = spark.createDataFrame(rows, "record_id string, url string, time timestamp_ntz, kind string, profile string, status int, headers map<string,string>")
    want = {r[0]: max(((x[2], x[0]) for x in rows if x[3] == "response" and x[2] < r[2]), default=(None, None))[1] for r in rows if r[3] == "revisit"}
    assert {r["revisit_id"]: r["response_id"] for r in warc_revisits.resolve(records).collect()} == want


def test_broken_records_are_no_records(spark):
    raw = [None, "", "WARC/1.0", "WARC/1.0\r\nWARC-Date: never\r\n\r\n", "x" * 100_000]
    rows = warc_revisits.parsed(spark.createDataFrame([(r,) for r in raw], "raw string"))
    assert rows.count() == 5 and warc_revisits.resolve(rows).collect() == []
