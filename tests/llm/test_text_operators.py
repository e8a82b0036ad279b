"""Tokens, decontamination, extraction, lines and URLs against the library, brute force or hand-made cases."""

import hashlib
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from strandline.llm import decontaminate, extract, lines, pieces, urls

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string, spans int"
ODD = ["", None, " ", "  a", "a ", "a  ", "   ", "▁", "▁a ▁ b", "\n\n", "\t a b", "日本語 テスト 🙂🙂 x", "<s> </s> <unk> <0x0A>", "a\r\nb", "x" * 5000, "ab " * 3000]


def docs_of(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, "en", sources[i] if sources else "s", len(t or ""), "clash", 1) for i, t in enumerate(texts)], DOCS)


def odd_texts(seed, n):
    rnd = random.Random(seed)
    return ["".join(rnd.choice("ab ▁ \n🙂é<s>0xTHE.") for _ in range(rnd.randint(0, 60))) for _ in range(n)]


def test_pieces_equal_the_library(spark, monkeypatch):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path(pieces.MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [*ODD, *odd_texts(1, 400)]
    got = {r.doc_id: r for r in pieces.encode_documents(docs_of(spark, texts), path).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "")
        assert (got[i].ids, got[i].decoded) == (ids, library.decode(ids)), repr(t)
    table = pieces.ChunkTable(path)
    monkeypatch.setattr(pieces, "TABLE_CHUNKS", 3)  # an emptied table changes nothing
    for t in texts[2:60]:
        assert len(table.segment([t])[0][0]) == 4 * len(library.encode(t))
    assert pieces.encode_documents(docs_of(spark, []), path).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def hits(texts, items, n=10):
    windows = {}
    for i, t in items:
        w = words(t) if i is not None else []
        for k in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for t in texts:
        w = words(t)
        mark, found = [False] * len(w), set()
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    found |= windows[tuple(w[k : k + size])]
                    mark[k : k + size] = [True] * size
        out.append((len(w), sum(mark), sorted(found)))
    return out


def contaminated_case():
    rnd = random.Random(2)
    vocab = ["der", "The", "é", "42", "sky", "Zeit", "b", "c"]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([3, 10, 11, 25])))) for i in range(12)]
    texts = [*ODD, *[" ".join(rnd.choice(vocab) for _ in range(60)) for _ in range(30)]]
    texts += [f"{rnd.choice(vocab)}... {t.upper().replace(' ', ' -- ')} , {rnd.choice(vocab)}" for _, t in items]
    return texts, [*items, (12, None), (None, "sky sky"), (13, ""), (3, items[4][1]), (14, "...")]


@pytest.mark.parametrize("block_bytes", [1 << 20, 150])
def test_decontamination_equals_brute_force(spark, block_bytes):
    texts, items = contaminated_case()
    bench = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id bigint, text string, doc_id string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs_of(spark, texts), bench, block_bytes=block_bytes).collect()}
    want = hits(texts, items)
    for i, (t, w) in enumerate(zip(texts, want)):
        assert (got[i].n_words, got[i].n_hit, got[i].items) == w, t
        assert sum(len(words(t[s["start"] : s["end"]])) for s in got[i].spans) == w[1]
    kept = {r.doc_id for r in decontaminate.drop_contaminated(docs_of(spark, texts), bench, block_bytes=block_bytes).collect()}
    assert kept == {i for i, w in enumerate(want) if not w[1]}
    assert decontaminate.decontaminate(docs_of(spark, ["a"]), bench.limit(0)).first().n_hit == 0
    assert decontaminate.decontaminate(docs_of(spark, []), bench).count() == 0


def test_one_automaton_at_a_time(spark):
    texts, items = contaminated_case()
    docs, bench = docs_of(spark, texts), spark.createDataFrame(items, "item_id bigint, text string")
    for block_bytes in (1 << 20, 120):
        kept = decontaminate.drop_contaminated(docs, bench, block_bytes=block_bytes)
        assert kept._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
        assert sorted(r.doc_id for r in kept.collect()) == [i for i, h in enumerate(hits(texts, items)) if not h[1]]


def test_spans_join_in_one_pass():
    spans = [{"start": 3 * i, "end": 3 * i + (4 if i % 2 else 2)} for i in range(200_000)]
    began = time.process_time()
    joined = decontaminate._joined(spans)
    assert time.process_time() - began < 3 and joined[:3] == [{"start": 0, "end": 2}, {"start": 3, "end": 8}, {"start": 9, "end": 14}]


PAGES = {
    "": "",
    None: "",
    "plain text": "plain text",
    "<p>a<p>b": "a\nb",
    "<p>One &lt;b&gt; &amp;amp; two&nbsp;three<br>four</p>": "One <b> &amp; two three four",
    "<body><nav><a href=x>menu</a></nav><article><h1>Title</h1><p><b>Bold.<br><p>Long   text\nhere, enough of it.</article><footer>f</footer></body>": "Title\nBold.\nLong text here, enough of it.",
    "<article><header><h1>T</h1></header><p>text text text</p><div class='comments'><p>nice</p></div><form>q<input></form></article>": "T\ntext text text",
    "<div id=sidebar><p>many words of a sidebar that go on</p></div><div id=main><h2>T</h2><p>text of some length is here</p><p>and more of it</p></div><div class='cookie-notice'>ok?</div>": "T\ntext of some length is here\nand more of it",
    "<article><p>cut off in the mid</p><p>dle of a ta</p><p cla": "cut off in the mid\ndle of a ta",
    "<article><p>a &am": "a &am",
    "<script>var a='</p>';</script><article><p>x > y</p><style>p{}</style><!-- c <p>no</p> --></article>": "x > y",
    "<ARTICLE><UL><LI>one<LI>two</UL><TABLE><TR><TD>1<TD>2</TABLE></ARTICLE>": "one\ntwo\n1\n2",
    "<nav>only a menu</nav>": "",
    "</p></div><p>stray</b>": "stray",
    "<article><section id='related-work'><p>a section of work</p></section><p>x</p></article>": "a section of work\nx",
    "<article><div class='entry-header'><h1>T</h1></div><p>long text of it all</p></article>": "T\nlong text of it all",
    "<article><p>body</p><div class='share-price'>The price is 4</div><div class='legal notice'><p>Long legal text of the body which goes on and on.</p></div></article>": "body\nThe price is 4\nLong legal text of the body which goes on and on.",
    "<article><p>Some text of the body, long enough.</p><p>And some more text of the body.</p><div class='notice'>New!</div><div class=social-share><a href=1>tw</a></div></article>": "Some text of the body, long enough.\nAnd some more text of the body.",
    "<article><p>text text text</p><section class='comments-area'><article class=comment><p>a comment as long as you please, with many words in it</p></article></section></article>": "text text text",
    "<p title=don't>hello": "hello",
    '<p title="don>hello</p> <p>x': "hello\nx",
    "<p>a < b <3 </ c> <!x> <?y?> <!--> z": "a < b <3 z",
    "<main><h1>T</h1><div class=body><p>para one is long enough to count</p><p>para two is long enough to count</p></div></main>": "T\npara one is long enough to count\npara two is long enough to count",
    "<div><h1>T</h1><div><p>para one is long enough to count</p><p>para two is long enough to count</p></div></div><div>tail</div>": "T\npara one is long enough to count\npara two is long enough to count",
}


def test_extraction(spark):
    rows = [(i, f"u{i}", h, "clash") for i, h in enumerate(PAGES)]
    got = {r.page_id: r.text for r in extract.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == list(PAGES.values())
    assert len(extract.main_text("<div>" * 30000 + "deep" + "</div>" * 30000)) == 4


BODY = "<p>The first paragraph of the body has some words, and more of them.</p><p>The second one is about as long as that, with a few words left.</p>"
BODY_TEXT = "The first paragraph of the body has some words, and more of them.\nThe second one is about as long as that, with a few words left."


@pytest.mark.parametrize("page", ["<div class='sponsored'>{}</div>", "<div class='sponsored-content'>{}</div>", "<div class='newsletter'>{}</div>", "<div id='modal-content'>{}</div>", "<div class='comment-page'>{}</div>",
                                  "<article class='menu'>{}</article>", "<a href=#>Skip</a><div id=page class=has-sidebar><div class=ad>Buy this.</div><div>{}</div></div>", "<h1></h1><div class=nav-open><div class='menu'><a href=1>One</a></div>{}</div>"])
def test_names_do_not_delete_articles(page):
    assert extract.main_text(page.format(BODY)).removeprefix("Buy this.\n").removeprefix("Skip\n") == BODY_TEXT


@pytest.mark.parametrize("name", ["reader-comments", "user-comments", "entry-comments", "responses", "commentList", "privacy-hint", "advertorial-box", "google-ad", "site-nav", "related-posts-ads"])
def test_names_speak_by_any_word(name):
    extra = f"<div class='{name}'><p>Nice post, thanks</p></div>"
    for page in (f"<article>{BODY}{extra}</article>", f"<div>{BODY}</div>{extra}", f"{extra}<main>{BODY}</main>", f"<article>{BODY}</article><section id='{name}'>{'<p>A long comment goes here.</p>' * 9}</section>"):
        assert extract.main_text(page) == BODY_TEXT


def test_comments_are_told_by_structure():
    one = "<li><span class=author>Bob</span> <time>May 1</time><p>I think this is fine.</p>{}</li>"
    for reply in ("<a href=#>Reply</a>", "<button>Antworten</button>"):
        assert extract.main_text(f"<article>{BODY}<ul>{one.format(reply) * 4}</ul></article>") == BODY_TEXT
    kept = extract.main_text(f"<article>{BODY}<ul>{one.format('') * 2}</ul></article>")
    assert kept.startswith(BODY_TEXT) and "I think this is fine." in kept


def test_articles_beside_each_other_are_kept():
    links = "<article><a href=1>One link that is long</a> <a href=2>Another link</a></article>"
    assert extract.main_text(f"<nav>x</nav><div><article>{BODY}</article>{links}<article><h2>Next</h2>{BODY}</article></div>") == f"{BODY_TEXT}\nNext\n{BODY_TEXT}"
    assert extract.main_text("<div class=ad>An advert with a good many words in it, more than the article has.</div><article><h1>Short.</h1><p>An article.</p></article>") == "Short.\nAn article."


def test_extraction_reads_hostile_pages_once():
    pages = ['<a "' * 250_000, '<a x=">" ' * 100_000, "<a x='" * 150_000, "<span>" * 60_000 + "<li>x" * 60_000, "<p><table>" + "<span>" * 60_000 + "<div></div>" * 60_000, "<!--" * 200_000, "<div class=notice>x" * 50_000]
    for page in pages:
        began = time.process_time()
        extract.main_text(page)
        assert time.process_time() - began < 10, page[:20]


def test_densest_node_equals_plain_recursion():
    rnd = random.Random(12)

    def tree(depth):
        if depth == 0 or rnd.random() < 0.2:
            return "w" * rnd.randint(1, 60)
        return "".join(f"<{t}>{tree(depth - 1)}</{t}>" for t in rnd.choices(["div", "section", "a", "b", "ul"], k=rnd.randint(1, 4)))

    def plain(node):
        """chars, tags, link chars, link tags of what is inside, by definition."""
        kids = [x for x in node.parts if not isinstance(x, str)]
        got = [plain(x) for x in kids]
        chars = sum(len(x) for x in node.parts if isinstance(x, str)) + sum(g[0] for g in got)
        tags = len(kids) + sum(g[1] for g in got)
        return chars, tags, sum(g[0] if x.tag == "a" else g[2] for x, g in zip(kids, got)), sum(1 if x.tag == "a" else g[3] for x, g in zip(kids, got))

    def density(node, share):
        chars, tags, links, link_tags = plain(node)
        links = chars if node.tag == "a" else links
        if not chars:
            return 0.0
        base = math.log(chars / max(1, chars - links) * links + share * chars + math.e)
        return chars / max(1, tags) * max(0.0, math.log(max(1.0, chars / max(1, links) * max(1, tags) / max(1, link_tags)))) / math.log(max(base, math.e / 2 + 0.2))

    for _ in range(60):
        root = extract.parse(tree(5))
        best = extract.densest(root)
        whole = plain(root)
        share = whole[2] / max(1, whole[0])
        sums = {}
        for node in extract._ordered(root):
            chars, _, links, _ = plain(node)
            assert abs(node.density - density(node, share)) < 1e-9
            if chars:
                own = sum(len(x) for x in node.parts if isinstance(x, str)) if chars > links else 0
                sums[id(node)] = own + sum(density(x, share) for x in node.parts if not isinstance(x, str))
        assert (best is None) == (not sums) and (best is None or sums[id(best)] >= max(sums.values()) - 1e-9)


@pytest.mark.parametrize(("most", "salt"), [(500_000, 1), (-1, 7)])
def test_boilerplate_lines(spark, monkeypatch, most, salt):
    monkeypatch.setattr(lines, "BROADCAST_KEYS", most)
    monkeypatch.setattr(lines, "SALT_PAGES", salt)
    texts = [f"Share this\nbody {i}\n\nShare this" if i % 2 else f" Share this \nbody {i}" for i in range(30)] + ["Share this", None, ""] + ["Share this\nx", "Share this\ny"] + ["Share this\nz"] * 3
    sources = ["a"] * 33 + ["two"] * 2 + ["three"] * 3
    rows = [(i, t, "en", s, len(t or ""), "k", 7, 8, "d") for i, (t, s) in enumerate(zip(texts, sources))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, site int, salt int, drop string")
    got = {r.doc_id: r for r in lines.drop_boilerplate(docs, counts=("_n_lines", "_n_dropped")).collect()}
    assert got[1].text == "body 1\n" and got[1]._n_dropped == 2 and got[1].n_chars == 7
    assert got[0].text == "body 0" and got[30].text == "" and got[31].text is None and got[32].text == ""
    assert got[33].text == "Share this\nx" and got[33]._n_dropped == 0  # two pages repeat nothing
    assert got[35].text == "" and got[35]._n_dropped == 2  # three do, on the smallest host
    assert all((r.kept, r.site, r.salt, r["drop"]) == ("k", 7, 8, "d") for r in got.values()) and len(got) == len(rows)
    assert lines.drop_boilerplate(docs).columns == docs.columns
    assert lines.drop_boilerplate(docs_of(spark, [])).count() == 0
    repeated = docs_of(spark, ["same\nline"] * 25, [None] * 25)
    assert {r.text for r in lines.drop_boilerplate(repeated).collect()} == {""}


def test_url_rules_and_reputation(spark):
    cases = {
        None: ("", "", None, "allow"), "no scheme": ("", "", None, "allow"), "http://A.Example.NET/en/1?x#y": ("a.example.net", "/en/1", "example.net/en/", "allow"),
        "http://example.net/fr/1": ("example.net", "/fr/1", "net/", "block"), "http://notexample.com/de/": ("notexample.com", "/de/", None, "allow"), "http://x.org/fr/": ("x.org", "/fr/", "org/fr/", "allow"),
        "http://m.example.com/de/7": ("m.example.com", "/de/7", "example.com/de/", "block"), "ftp://net?q": ("net", "", None, "allow"), "http://bad.info#x://y/": ("bad.info", "", None, "block"),
    }
    rows = [(i, u, None, "clash") for i, u in enumerate(cases)] + [(100 + i, "http://bad.info/a", None, "clash") for i in range(60)] + [(300 + i, "http://good.info/a", None, "clash") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string")
    labels = spark.createDataFrame([(100 + i, 0, 1) for i in range(60)] + [(300 + i, 1, 0) for i in range(60)] + [(300, 1, 0), (None, 0, 1), (301, None, None)], "doc_id bigint, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages, labels).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    assert got[100][3] == "block" and got[300][3] == "allow" and len(got) == len(rows)
    assert {r.verdict for r in urls.judge_urls(pages, labels.limit(0)).where("rule is null").collect()} == {"allow"}
    assert urls.judge_urls(pages.limit(0), labels).count() == 0


def test_suffixes_of_two_labels(spark):
    hosts = [f"bad{i}.co.uk" for i in range(6) for _ in range(20)] + ["www.good.co.uk", "x.com", "co.uk", "a.b.org.br", "me", "x.y.co"]
    pages = spark.createDataFrame([(i, f"http://{h}/") for i, h in enumerate(hosts)], "page_id bigint, url string")
    labels = spark.createDataFrame([(i, 0, 1) for i in range(60)], "doc_id bigint, quality int, toxic int")
    low = {r.host: r.low for r in urls.host_reputation(pages, labels).collect()}
    assert len(low) == 12 and all(0 <= x <= 1 for x in low.values())
    import duckdb

    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    con.register("labels", labels.toPandas())
    want = sorted(con.sql(urls.ORACLE).fetchall())
    assert sorted(tuple(r) for r in urls.judge_urls(pages, labels).drop("low").collect()) == want


def test_queries_derive_digests(spark, tmp_path):
    docs_of(spark, ["a b", None]).write.parquet(str(tmp_path / "documents.parquet"))
    row = {r.doc_id: r for r in pieces.query(spark, str(tmp_path)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert row[1].n_tokens == 0 and row[1].ids_sha256 == empty and row[1].decoded_sha256 == empty
    assert row[0].decoded_sha256 == hashlib.sha256(b"a b").hexdigest()
    assert F.sha2 is not None
