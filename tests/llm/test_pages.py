"""Page texts, archives and embeddings."""

import functools
import gzip
import hashlib
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colex.llm import embeddings, html_text, warc
from colex.llm.common import scratch

from ..oracle import connect, rows
from . import data

SCHEMA = "page_id long, url string, html string"


def article(title, paragraphs, extra=""):
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return (
        f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t='</p>';</script></head><body class='has-sidebar'><header>Site</header><nav><ul><li><a href='/a'>A</a></li></ul></nav>"
        f"<div class=\"cookie-notice\">We use cookies</div><article><h1>{title}</h1>{body}{extra}</article><aside>Side</aside><form><input>Sign up</form><div id='comments'><p>First!</p></div><footer>&copy; x</footer></body></html>"
    )


PAGES = [
    (1, "http://a.example/1", article("T &amp; U", ["One  <b>two</b>\n three", "Caf&eacute; &#x4e00;&nbsp;x"], "<div class='ad'>Buy</div><section class='comments'><p>Nice</p></section>")),
    (2, "http://a.example/2", article("V", ["Only"])),
    (3, "https://b.example/x", "<body><div class=top>Menu menu</div><div class=content><div><p>Long text that varies one.</p><p>More of it here.</p></div></div><div class=bottom>same words</div></body>"),
    (4, "https://b.example/y", "<body><div class=top>Menu menu</div><div class=content><div><p>Another page with other words.</p><p>And its second part.</p><p>Third.</p></div></div><div class=bottom>same words</div></body>"),
    (5, None, "plain text, no tags"),
    (6, "nonsense", None),
    (7, "http://c.example", ""),
    (8, "http://d.example/1", "<p>a<p>b <!-- no --> c<br>d<ul><li>e<li>f</ul><script>x"),
    (9, "http://a.example/1", article("T &amp; U", ["One  <b>two</b>\n three", "Caf&eacute; &#x4e00;&nbsp;x"], "<div class='ad'>Buy</div><section class='comments'><p>Nice</p></section>")),
    (2, "http://a.example/2", article("V", ["Only"])),
    (10, "http://e.example/1", "<article><p>unclosed <b>bold<br><p>next</article></p>< 3 &lt;tag&gt;"),
]
TEXT = {
    1: "T & U\nOne two three\nCafé 一 x", 2: "V\nOnly", 3: "Long text that varies one.\nMore of it here.", 4: "Another page with other words.\nAnd its second part.\nThird.", 5: "plain text, no tags",
    6: "", 7: "", 8: "a\nb c\nd\ne\nf", 9: "T & U\nOne two three\nCafé 一 x", 10: "unclosed bold\nnext\n< 3 <tag>",
}


@pytest.fixture(scope="module")
def pages(spark):
    return data.clashing(spark.createDataFrame(PAGES, SCHEMA).repartition(3)).cache()


def test_texts(pages):
    out = html_text.main_text(pages).collect()
    assert len(out) == len(PAGES)
    assert {r["page_id"]: r["text"] for r in out} == TEXT
    assert all(r["n_chars"] == len(r["text"]) for r in out)


def inferred(df):
    """host -> (expression, number of templates)."""
    hosted = df.select(F.regexp_extract(F.coalesce("url", F.lit("")), html_text.HOST, 1).alias("host"), "html")
    roots = {r["host"]: html_text.Node.unpack(json.loads(r["wrapper"])) for r in html_text.wrappers(hosted).collect()}
    return {host: (html_text.expression(root), len(html_text.templates(root))) for host, root in roots.items()}


def texts(spark, some, parts=3):
    return {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(some, SCHEMA).repartition(parts)).collect()}


def test_wrappers_are_union_free_expressions(pages):
    found = inferred(pages)
    assert found["b.example"] == ("<body><div.top>=</div><div.content><div>(<p>#</p>)+</div></div><div.bottom>=</div></body>", 2)
    assert found["a.example"] == ("<html><body.has-sidebar><article><h1>#</h1>(<p>#</p>)+</article></body></html>", 0)


def test_alignment_keeps_order_and_makes_groups():
    fold, show = html_text.fold, html_text.expression
    tree = lambda *pages: functools.reduce(html_text.align, map(fold, pages))
    a, b = "<div><p>x</p></div>", "<div><h1>t</h1><p>x</p><p>y</p></div>"
    assert show(tree(a, b)) == show(tree(a, b, a)) == "<div>(<h1>=</h1>)?(<p>#</p>)+</div>"
    assert show(fold("<ul><li>a</li><p>b</p></ul>")) == "<ul><li>=</li><p>=</p></ul>" != show(fold("<ul><p>b</p><li>a</li></ul>"))
    assert show(fold("<h2>a</h2><p>b</p><p>c</p><h2>d</h2><p>e</p><h3>f</h3>")) == "(<h2>#</h2><p>#</p>)+<h3>=</h3>"
    assert show(tree("<h1>a</h1><p>b</p>", "<p>c</p><h2>d</h2>")) == "(<h1>=</h1>)?<p>#</p>(<h2>=</h2>)?"
    assert show(tree("<p>a</p><h2>b</h2><p>c</p>", "<p>a</p><h2>b</h2><p>d</p>")) == "<p>=</p><h2>=</h2><p>#</p>"


def test_wrappers_are_bounded():
    def size(node):
        return 1 + sum(map(size, node.kids))

    name = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    one = lambda k: "<body>" + "".join(f"<div class='{name(k * 1000 + i)}'><b class=x>{i}</b><section class='{name(i)}'><p>{k}</p></section></div>" for i in range(300))
    root = html_text.fold(one(1))
    for k in range(2, 8):
        root = html_text.prune(html_text.align(root, html_text.fold(one(k))))
    assert size(root) <= html_text.NODES and all(len(n.kids) <= html_text.BREADTH for n in root.kids)
    bushy = "<body>" + "".join(f"<div class={name(i)}>" + "".join(f"<div class={name(j)}>{i}</div>" for j in range(120)) + "</div>" for i in range(120))
    assert size(html_text.fold(bushy)) <= html_text.NODES and html_text.extract(bushy).count("\n") == 120 * 120 - 1


def test_the_wrapper_decides(spark):
    """Hosts on which the text without its wrapper would be another."""
    notice = "This site may earn a commission when you buy through the links on its pages. " * 5
    div = lambda i, extra="": f"<body><div class='teasers'><article>Teaser {i}</article></div><div class='strip'>{notice}</div><div class=content><h2 id='social-impact'>Impact {i}</h2><p>{f'Body words {i}. ' * 40}</p>{extra}</div></body>"
    art = lambda i: f"<body><div class=intro>Welcome to our pages</div><article id='post-{i}'><header><h1>Title {i}</h1></header><section id='related-work'><p>Work {i} {'and more words ' * 9}</p></section><div class='hint'>Get our app</div><footer>By {i}</footer></article></body>"
    bare = lambda i: f"<body><div class=intro>Welcome to our pages</div><div class=text>Plain {i}</div></body>"
    some = [(i, f"http://div.example/{i}", div(i)) for i in range(3)]
    some += [(i, f"http://two.example/{i}", art(i)) for i in range(10, 14)] + [(i, f"http://two.example/{i}", bare(i)) for i in range(20, 22)]
    wide = "<body><article>" + "".join(f"<section class='k{i}'>s{i}</section><p>p{i}</p>" for i in range(20_000)) + "</article></body>"
    some += [(30, "http://wide.example/1", wide), (31, "http://wide.example/2", wide.replace("s7<", "other<"))]
    found = texts(spark, some, 4)
    for i in range(3):
        assert found[i] == f"Teaser {i}\nImpact {i}\n" + f"Body words {i}. " * 39 + f"Body words {i}."
        assert notice.strip() in html_text.extract(div(i))
    for i in range(10, 14):  # within an article nothing is template
        assert found[i] == f"Title {i}\nWork {i} {'and more words ' * 9}".strip() + "\nGet our app"
    for i in range(20, 22):
        assert found[i] == f"Plain {i}" and html_text.extract(bare(i)) == f"Welcome to our pages\nPlain {i}"
    assert found[30] == "\n".join(f"s{i}\np{i}" for i in range(20_000)) and found[31] == found[30].replace("s7\n", "other\n")


def test_near_copies_prove_no_template(spark):
    page = lambda title: f"<body><h1>{title}</h1><div class=text>{'The same words. ' * 30}</div></body>"
    found = texts(spark, [(1, "http://x.example/1", page("One")), (2, "http://x.example/2", page("Two"))])
    assert found[1].startswith("One\nThe same words.") and found[2].startswith("Two\nThe same words.")


def test_all_blocks_that_vary_are_kept(spark):
    long = "A sentence of this page alone. " * 12
    page = lambda i, lead: f"<body><div class=top>Home</div><div class=wrap><div class=lead>Lead {i}</div><div class=text><h2>Story</h2><p>{long}{i} <b>Note</b> end</p>{lead}</div><div class=bar>Same bar</div></div></body>"
    want = lambda i: f"Lead {i}\nStory\n{long}{i} Note end"
    two = lambda i, text: f"<body><article class=teaser><p>More {i}</p></article><article class=post><h1>Head {i}</h1><p>{text} {i}</p></article></body>"
    alone = "<body><h1>Head</h1><div class=a><p>Short one.</p></div><div class=b><p>" + long + "</p></div></body>"
    some = [
        (1, "http://lead.example/1", page(1, "")), (2, "http://lead.example/2", page(2, "")), (3, "http://lead.example/3", page(3, "<p>Only here</p>")),
        (4, "http://two.example/1", two(1, "Text")), (5, "http://two.example/2", two(2, "Text")),
        (6, "http://one.example/1", alone), (7, "http://copies.example/1", alone), (8, "http://copies.example/2", alone),
    ]
    found = texts(spark, some)
    assert found[1] == want(1) and found[2] == want(2) and found[3] == want(3) + "\nOnly here"
    assert found[4] == "More 1\nHead 1\nText 1" and found[5] == "More 2\nHead 2\nText 2"
    assert found[6] == found[7] == found[8] == "Head\nShort one.\n" + long.strip()


def test_no_line_of_an_article_is_lost(spark):
    """Constant headings, leads beside the article, a story beside a teaser, parts with text of their own."""
    words = lambda i: f"words of page {i} only " * 6
    hosts = {
        "recipe": (lambda i: f"<body><div class=top>Our site</div><h1>Dish {i}</h1><h2>Ingredients</h2><ul><li>egg {i}</li></ul><h3>Method</h3><p>{words(i)}</p></body>", lambda i: f"Dish {i}\nIngredients\negg {i}\nMethod\n{words(i).strip()}"),
        "section": (lambda i: f"<body><article><h1>T {i}</h1><p>{words(i)}</p><h2 class=sec>Conclusion</h2><p>{i}</p></article></body>", lambda i: f"T {i}\n{words(i).strip()}\nConclusion\n{i}"),
        "main": (lambda i: f"<body><main><h1>H {i}</h1><p class=lead>Lead {i}</p><article><p>{words(i)}</p></article></main></body>", lambda i: f"H {i}\nLead {i}\n{words(i).strip()}"),
        "teaser": (lambda i: f"<body><article class=teaser>{words(i)}</article><div class=story><p>Story {i} {words(i) * 3}</p></div></body>", lambda i: f"{words(i).strip()}\nStory {i} {(words(i) * 3).strip()}"),
        "alert": (lambda i: f"<body><article><p>{words(i)}</p><div class=alert>Mind {i}</div><div class=related>See {i}</div><div class=related><a href=x>Other {i}</a></div><p hidden>Hid {i}</p></article></body>", lambda i: f"{words(i).strip()}\nMind {i}\nSee {i}\nHid {i}"),
        "crumbs": (lambda i: f"<body><div class=crumbs><a href=x>Home</a> <a href=y>P {i}</a></div><article>{words(i)}</article></body>", lambda i: words(i).strip()),
    }
    for n in (2, 5):  # however many pages a host has
        some = [(1000 * h + i, f"https://{name}.example/{i}", page(i)) for h, (name, (page, _)) in enumerate(hosts.items()) for i in range(n)]
        found = texts(spark, some + some[:1])
        for h, (name, (_, want)) in enumerate(hosts.items()):
            assert [found[1000 * h + i] for i in range(n)] == [want(i) for i in range(n)], name
    for name, (page, want) in list(hosts.items())[1:]:
        assert html_text.extract(page(0)) == want(0), name


def brute_force(pages):
    """page_id -> text by html.parser and comparison of all pages of a host, for well-formed pages
    without classes to drop: what isn't in the article goes if all of the host's pages have it in its place."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.open, self.found = [], []

        def handle_starttag(self, tag, attrs):
            self.open.append((tag, dict(attrs).get("class", "")))
            self.found.append(None)

        def handle_endtag(self, tag):
            self.open.pop()
            self.found.append(None)

        def handle_data(self, text):
            if text.strip() and not {"nav", "title", "footer"} & {t for t, _ in self.open}:
                self.found.append((tuple(self.open), " ".join(text.split())))

    hosts = {}
    for i, url, page in pages:
        reader = Reader()
        reader.feed(page)
        hosts.setdefault(url.split("/")[2], {})[i] = [f for f in reader.found if f]
    out = {}
    for found in hosts.values():
        same = set.intersection(*map(set, found.values())) if len(found) > 1 else set()
        for i, blocks in found.items():
            out[i] = "\n".join(text for path, text in blocks if ("article", "") in path or (path, text) not in same)
    return out


def test_against_brute_force(spark, monkeypatch):
    """Random hosts, some of one page and one of many, with pre-aggregation in several levels."""
    monkeypatch.setattr(html_text, "FAN_IN", 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rng = np.random.default_rng(5)
    word = lambda n: " ".join("w%x" % x for x in rng.integers(0, 1 << 30, n))
    some = []
    for h, n in enumerate([1, 2, 3, 10, 120]):
        fixed = {c: word(3) for c in "abcdef"}
        bar = lambda c: f"<div class='{c}'>{fixed[c]}</div>"  # noqa: B023, E731
        for k in range(n):
            parts = [f"<p>{word(30)}</p>" if rng.random() < 0.8 else f"<h2>{word(2)}</h2><ul><li>{word(9)}</li><li>{word(4)}</li></ul>" for _ in range(rng.integers(1, 9))]
            story = f"<article><h1>{word(3)}</h1>{''.join(parts)}</article>" if h % 2 else f"<div class='story'>{''.join(parts)}<p>{word(20)}</p></div>"
            page = f"<html><head><title>{word(2)}</title></head><body>{bar('a')}<nav><ul><li>{word(1)}</li></ul></nav><section class='s'>{bar('b')}{bar('c')}</section>{story}{bar('d')}<footer>{word(4)}</footer></body></html>"
            some.append((len(some), f"http://h{h}.example/{k}", page))
    try:
        assert texts(spark, some, 8) == brute_force(some)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_awkward_rows(spark):
    some = [(None, None, None), (None, "http://a.example", "<p>x</p>"), (1, "http://a.example", "<p>x</p>"), (1, "http://a.example", "<p>y</p>"), (2, "//a.example/b", "")]
    out = html_text.main_text(data.clashing(spark.createDataFrame(some, SCHEMA))).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in out) == [(0, "", 0), (0, "x", 1), (1, "x", 1), (1, "y", 1), (2, "", 0)]
    assert html_text.main_text(spark.createDataFrame([], SCHEMA)).collect() == []


def test_broken_markup_takes_linear_time():
    import time

    began = time.time()
    assert html_text.extract("<p>a</p><b " + "x" * 1_000_000) == "a"
    assert html_text.extract("<p title='open>a</p><p>b</p>") == "a\nb"
    assert html_text.extract("<" + "a" * 1_000_000) == ""
    assert html_text.extract("a < b " * 100_000).startswith("a < b a < b")
    assert html_text.extract("<script>" * 1000 + "x") == ""
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    tree = html_text.align(html_text.fold(deep), html_text.fold(deep + "<p>x</p>"))
    assert html_text.extract(deep) == "deep" and html_text.expression(tree).count("<div>") == html_text.DEPTH
    assert time.time() - began < 20


def test_archives_against_sql(spark, pages):
    path = scratch(spark, "test-warc")
    warc.write_archives(pages, path, per_file=3)
    back = warc.read_archives(spark, path)
    con = connect("/nowhere")
    con.register("pages", pd.DataFrame(PAGES, columns=["page_id", "url", "html"]))
    assert rows(back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").toPandas()) == rows(con.execute(warc.OP10_SQL).df())
    stored = {r["record_id"]: r for r in back.collect()}
    for r in stored.values():  # every revisit resolves to a stored payload with its digest
        whole = stored[r["refers_record"]] if r["record_type"] == "revisit" else r
        assert whole["record_type"] == "response" and hashlib.sha256(whole["payload"]).hexdigest() == r["payload_digest"]
    assert len(stored) == len(PAGES)


def test_long_payloads_have_archives_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 16)
    monkeypatch.setattr(warc, "RECORD_BYTES", 1000)
    sizes = [10, 900, 1001, 8000, 8001, 60_000, 3_000_000] * 3
    some = [(i, f"http://x.example/{i}", "é" + "x" * (n - 2) if i % 2 else str(i % 7) * n) for i, n in enumerate(sizes)]
    path = scratch(spark, "test-warc")
    warc.write_archives(spark.createDataFrame(some, SCHEMA).coalesce(1), path, per_file=16)
    back = {r["page_id"]: r for r in warc.read_archives(spark, path).collect()}
    assert len(back) == len(some) and all(back[i]["payload_bytes"] == len(h.encode()) for i, _, h in some)
    first = {}
    for i, _, h in some:
        assert back[i]["refers_to"] == (first.get(h) if len(h) > 10 else None) and (back[i]["payload"] is None or back[i]["payload"].decode() == h)
        first.setdefault(h, i)
    held = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).collect()
    classes = {}
    for f in held:
        classes.setdefault(int(f["path"].split("/")[-2]), []).append(len(list(warc.parse(f["content"]))))
    assert {c: sum(n) for c, n in classes.items()} == {0: 6, 1: 6, 2: 9} and max(classes[1]) <= 2 and max(classes[2]) == 1


def test_archive_bytes():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 9\r\n\r\nab\r\n\r\ncde\r\n\r\n"
    for archive in (record * 2, gzip.compress(record * 2), gzip.compress(record) * 2):
        assert [(h["warc-type"], b) for h, b in warc.parse(archive)] == [("response", b"ab\r\n\r\ncde")] * 2
    with pytest.raises(ValueError):
        list(warc.parse(record[:-12]))


def test_large_tables_take_the_shuffle(spark, pages, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(html_text, "BROADCAST_HOSTS", 0)
    path = scratch(spark, "test-warc")
    warc.write_archives(pages, path)
    assert warc.read_archives(spark, path).where("record_type = 'revisit'").count() == 2
    assert {r["page_id"]: r["text"] for r in html_text.main_text(pages).collect()} == TEXT


def test_empty_pages(spark, pages):
    none = pages.limit(0)
    assert html_text.main_text(none).count() == 0
    path = scratch(spark, "test-warc")
    warc.write_archives(none, path)
    assert warc.read_archives(spark, path).count() == 0


# ---------------------------------------------------------------- embeddings

LAST = (1 << 63) - 1


def vectors(n=300, d=16):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((n, d))
    for i in range(60, 140):  # a group of near copies, and pairs around the threshold
        base[i] = base[60] + 0.06 * rng.standard_normal(d)
    base[10], base[11] = base[9], 3 * base[9]
    rows_ = [[i, base[i].astype(np.float32).tolist(), int(i % 3 == 0)] for i in range(n)]
    rows_[20][1], rows_[21][1], rows_[22][1] = None, [0.0] * d, [float("nan")] * d
    rows_[23][1], rows_[24][1], rows_[25][2] = [None] * d, [float("inf")] * d, None
    rows_[26][1] = rows_[27][1][:8]
    rows_.append(list(rows_[60]))
    rows_.append([400, rows_[60][1], rows_[60][2]])
    return [tuple(r) for r in rows_]


def brute(rows_, threshold=0.98):
    links = []
    sound = [r[1] is not None and r[2] is not None and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1]) for r in rows_]
    for i, a in enumerate(rows_):
        for j in range(i):
            b = rows_[j]
            if sound[i] and sound[j] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                    links.append((j, i))
    group = data.components(range(len(rows_)), links)
    least, count = {}, [0] * len(rows_)
    for i, r in enumerate(rows_):
        least[group[i]] = min(least.get(group[i], r[0]), r[0])
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return sorted((r[0], count[i], least[group[i]], r[0] == least[group[i]]) for i, r in enumerate(rows_))


def test_vectors_with_null_and_shared_ids(spark):
    """Ids play no part in what links: near and far vectors share one, and many have none."""
    rng = np.random.default_rng(31)
    base = rng.standard_normal((60, 12))
    base[20:40] = base[:20] + 0.02 * rng.standard_normal((20, 12))
    names = [5 if i in (0, 20, 41, 42) else None if i % 4 == 1 else 7 if i in (2, 3, 22) else i for i in range(60)]
    rows_ = [(names[i], base[i].tolist(), 1) for i in range(60)] + [(None, base[1].tolist(), 1), (None, base[1].tolist(), 1), (9, None, 1), (None, None, 1)]
    ids = [LAST if r[0] is None else r[0] for r in rows_]
    expected = brute([(i, *r[1:]) for i, r in zip(ids, rows_, strict=True)])
    found = [tuple(r) for r in embeddings.near_duplicates(spark.createDataFrame(rows_, "vec_id long, embedding array<double>, label int").repartition(3)).collect()]
    assert sorted((LAST if a is None else a, n, LAST if c is None else c, kept) for a, n, c, kept in found) == expected


def test_recall_on_planted_pairs(spark):
    """Of a table's planted pairs from the threshold on nearly all are found, and nothing else is."""
    rng = np.random.default_rng(77)
    n, d = 20_000, 24
    base = rng.standard_normal((n, d))
    base /= np.linalg.norm(base, axis=1)[:, None]
    noise = rng.standard_normal((n // 2, d))
    noise -= (noise * base[: n // 2]).sum(axis=1)[:, None] * base[: n // 2]
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    cosine = rng.uniform(0.97, 1, n // 2)
    base[n // 2 :] = cosine[:, None] * base[: n // 2] + np.sqrt(1 - cosine**2)[:, None] * noise
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(base.tolist())], "vec_id long, embedding array<double>, label int").repartition(4)
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(df).collect()}
    exact = (base[: n // 2] * base[n // 2 :]).sum(axis=1)
    linked = np.array([found[i + n // 2] == (1, i) for i in range(n // 2)])
    assert linked[exact >= 0.98 + 1e-12].mean() >= 0.999 and not linked[exact < 0.98 - 1e-12].any()


@pytest.mark.parametrize("block", [8192, 16])
def test_near_vectors_against_all_pairs(spark, block):
    df = data.clashing(spark.createDataFrame(vectors(), "vec_id long, embedding array<float>, label int").repartition(3))
    found = [tuple(r) for r in embeddings.near_duplicates(df, block=block).select("vec_id", "n_links", "component_id", "kept").collect()]
    assert sorted(found) == brute(vectors())


def test_cosine_in_double_precision(spark):
    """Doubles that floats can't tell apart or hold, on both sides of the threshold; two dimensions."""
    angle = np.arccos(0.98)
    rows_ = [(i, [float(np.cos(a)), float(np.sin(a))], 1) for i, a in enumerate((0, angle - 1e-9, angle + 1e-9, angle / 2 + 1e-12, 2.0))]
    rows_ += [(10, [1e-200, 1e-200], 1), (11, [1e200, 1e200 * (1 + 1e-9)], 1), (12, [1e-320, 0.0], 2), (13, [3.0, 0.0], 2)]
    found = [tuple(r) for r in embeddings.near_duplicates(spark.createDataFrame(rows_, "vec_id long, embedding array<double>, label int")).collect()]
    links = {r[0]: r[1] for r in found}
    assert links == {0: 2, 1: 3, 2: 2, 3: 3, 4: 0, 10: 1, 11: 1, 12: 1, 13: 1}
    assert {r[0]: r[2] for r in found} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 10: 10, 11: 10, 12: 12, 13: 12}


def test_a_cosine_of_exactly_the_threshold_links_however_it_is_rounded(spark):
    """Of n ones, all but a fiftieth stand at the same places: the cosine is 49/50, and just below it where one more is moved."""
    rows_, sizes = [], (50, 250, 400)
    for g, n in enumerate(sizes):
        for v, moved in enumerate((0, n // 50, -n // 50 - 1)):
            x = np.zeros(1300)
            x[400 + moved : 400 + moved + n] = 3.0
            rows_.append((10 * g + v, x.tolist(), g))
    df = spark.createDataFrame(rows_, "vec_id long, embedding array<float>, label int")
    found = sorted(tuple(r) for r in embeddings.near_duplicates(df).select("vec_id", "n_links", "component_id").collect())
    assert found == [r for g in range(len(sizes)) for r in ((10 * g, 1, 10 * g), (10 * g + 1, 1, 10 * g), (10 * g + 2, 0, 10 * g + 2))]


def test_a_pair_counts_where_both_were_kept(spark):
    """Two equal-bucket vectors of which the first table kept only one are counted in the second table."""
    x = np.array([[1.0, 0.0], [1.0, 0.01]])
    frame = lambda kept: pd.DataFrame({
        "label": [1, 1], "tab": [1, 1], "bucket": [7, 7], "one": [0, 0], "other": [0, 0], "block": [0, 0], "cls": [3, 4], "weight": [1, 1],
        "embedding": list(x), "kept": [np.array(k, dtype=np.int64) for k in kept],
    })
    one, both = (embeddings._compare(frame(k), 0.98) for k in (([0, 5, 1, 7], [1, 7]), ([0, 5, 1, 7], [0, 5, 1, 7])))
    assert one["links"].tolist() == [1, 1] and one["root"].tolist() == [3, 3]
    assert both["links"].tolist() == [0] and both["root"].tolist() == [3]


def test_sketches_of_near_vectors():
    rng = np.random.default_rng(3)
    x = embeddings.unit(rng.standard_normal((3000, 64)))
    y = embeddings.unit(0.98 * x + np.sqrt(1 - 0.98**2) * embeddings.unit(rng.standard_normal((3000, 64)) - (rng.standard_normal((3000, 64)) * x).sum(axis=1)[:, None] * x))
    near = (x * y).sum(axis=1) >= 0.98
    differ = np.bitwise_count((embeddings.sketches(x) ^ embeddings.sketches(y)).view(np.uint64))
    assert near.sum() > 300 and (differ[near] <= embeddings.far()).all() and embeddings.far() < 24


def test_empty_vectors(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_tables_follow_from_the_recall():
    for largest in (10, 10**4, 10**8):
        bits, tables = embeddings.shape(largest)
        assert 1 - (1 - (1 - np.arccos(0.98) / np.pi) ** bits) ** tables >= embeddings.RECALL
