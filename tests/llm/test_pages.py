"""Archive and page operators, and the pipeline, on tables with nulls, repeats and clashing names."""

import base64
import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm import html_extraction as H
from millrace.llm import warc

from .data import frame

SCHEMA = "page_id long, url string, html string, digest string, payload string, bytes long, template string, host string, id long"


def row(i, u, h):
    return (i, u, h, "d", "p", 1, "t", "x", 9)


PAGES = [
    (1, "http://a.example/1", "<p>one</p>"), (2, "http://a.example/2", "<p>one</p>"), (3, None, None), (4, "", ""), (5, "not a url", "<p>ünï</p>"), (6, "http://a.example/\r\nX: y", "<p>one</p>"),
    (10, "http://x/\u2028Content-Length: 3\u2029", "<p>two</p>"), (11, "http://x/\x85WARC-Type: revisit\r\n\r\n", "<p>three</p>"), (2**53 + 1, "http://x/\nWARC-Type: revisit", "<p>three</p>"),
    (6, "http://a.example/6", "<p>one</p>"), (None, "http://b.example", "<p>no id</p>"), (7, "http://c.example", "x" * 100_000), (7, "http://c.example", "x" * 100_000), (8, "u", "a\r\n\r\nb"), (9, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\n"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([row(*p) for p in PAGES], SCHEMA).repartition(3)


def digest(h):
    return base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()


def test_archive(pages, spark, tmp_path):
    got = Counter(tuple(r) for r in warc.round_trip(pages).collect())
    top = {}
    for i, _, h in PAGES:
        top.setdefault(h or "", []).append(i)
    want = Counter()
    for h, ids in top.items():
        best = max((i for i in ids if i is not None), default=None)
        for k, i in enumerate(sorted(ids, key=lambda x: (x is not None, x), reverse=True)):
            want[(i, len(h.encode()), digest(h), "response" if k == 0 else "revisit", None if k == 0 else best)] += 1
    assert got == want
    assert (11, 12, digest("<p>three</p>"), "revisit", 2**53 + 1) in got
    path = str(tmp_path / "archive")
    warc.write_archive(pages, path, least=20)
    stored = spark.read.parquet(f"{path}/payloads")
    assert stored.count() == len(top)
    parsed = warc.parse_records(warc.read_records(spark, path)).collect()
    assert len(parsed) == len(PAGES)
    bodies = Counter(bytes(r["payload"]) for r in parsed if r["record_type"] == "response")
    assert bodies[b"<p>one</p>"] == 4 and bodies[b"x" * 100_000] == 1  # shorter than least: all responses
    record = warc.read_records(spark, path).collect()
    assert all(bytes(r["record"]).startswith(b"WARC/1.1\r\nWARC-Type: ") and bytes(r["record"]).endswith(b"\r\n\r\n") for r in record)


def test_archive_rejects_damage(pages, spark, tmp_path):
    path = str(tmp_path / "archive")
    warc.write_archive(pages, path)
    bad = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.encode(F.lit("changed"), "UTF-8"))
    bad.write.parquet(f"{path}/other")
    (tmp_path / "archive/payloads").rename(tmp_path / "archive/old")
    (tmp_path / "archive/other").rename(tmp_path / "archive/payloads")
    with pytest.raises(Exception, match="does not match"):
        warc.read_records(spark, path).collect()


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert warc.round_trip(none).count() == 0
    assert H.extract_text(none).count() == 0


CHROME = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><header><a href=/>Site</a></header><nav><ul><li>Menu</ul></nav>"
    "<div class='cookie-notice'>We use cookies</div><div id=sidebar>Side <p>bar</div>{body}<div class='comments'><article>I disagree</article></div><form>Name <input></form><footer>&copy; me</footer></body></html>"
)


def test_extract():
    body = "<article><header><h1>A &amp; B</h1></header><p>First\n <b>bold</b>&nbsp;text<br>more<p>Second<aside>Aside</aside><ul><li>x<li>y</ul><div class=ad>Buy</div></article>"
    assert H.extract(CHROME.replace("{body}", body)) == "A & B\nFirst bold text more\nSecond\nx\ny"
    assert H.extract(CHROME.replace("{body}", "<main><p>Only main</main>")) == "Only main"
    assert H.extract(CHROME.replace("{body}", "<div><p>Plain &lt;text&gt;</p></div>")) == "Plain <text>"
    assert H.extract("") == "" and H.extract("<p>") == "" and H.extract("a < b <c") == "a < b <c"
    assert H.extract("<article><p>cut off <b>here") == "cut off here"
    assert H.extract("<article><p>a</p><!-- <p>no</p> --><script>x</script><p>b</article>") == "a\nb"


def test_furniture_does_not_swallow_the_page():
    story = "<article><p>The story that the page is about</p></article>"
    for name in ("class='layout with-sidebar'", "class='no-comments'", "id='share-root'", "class=widget", "id=modal"):
        assert H.extract(f"<body><nav>Menu</nav><div {name}>{story}</div></body>") == "The story that the page is about"
    assert H.extract("<body><div class=overlay><main><p>Text</p></main></div><p>More</p></body>") == "Text\nMore"
    assert H.extract("<body><div class='sidebar'>Side</div><p>Text</p></body>") == "Text"
    for raw in ("<svg viewBox='0 0 1 1'/>", "<canvas/>", "<object data=x />", "<video src='x'/>", "<datalist><option>A<option>B</datalist>", "<canvas>", "<svg><text>no</text></svg>"):
        assert H.extract(f"<article><p>Before</p>{raw}<p>After</p></article>") == "Before\nAfter"
    assert H.extract("<article><p>Let <math><mi>x</mi></math> be</p></article>") == "Let x be"
    assert H.extract("<article><p>Before</p><script>never closed <p>no") == "Before"


def test_templates(spark, pages):
    """Text that most pages of a host share goes, but not from an article; a small host has no template."""
    rows = [row(100 + k, f"http://big.example/{k}", f"<html><body><div>Same everywhere</div><div><p>Own text {k}</p><p>Other {k}</p></div></body></html>") for k in range(8)]
    rows += [row(200 + k, f"http://copy.example/{k}", "<html><body><article><p>Copied article</p></article></body></html>") for k in range(8)]
    rows += [row(300 + k, "http://small.example/", "<div>Same</div><p>x</p>") for k in range(2)]
    got = {r["page_id"]: r["text"] for r in H.extract_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[100 + k] == f"Own text {k}\nOther {k}" for k in range(8))
    assert all(got[200 + k] == "Copied article" for k in range(8))
    assert got[300] == "Same\nx"
    all_ = H.extract_text(pages).collect()
    assert Counter(r["page_id"] for r in all_) == Counter(p[0] for p in PAGES)
    assert all(r["n_chars"] == len(r["text"]) for r in all_)


def test_template_decides_in_articles(spark):
    """Text outside a teaser's article stays, and what a host repeats in its articles or its main element goes."""
    teaser = "<html><body><article><p>Join us</p></article><div><p>A long story of page {k}</p></div></body></html>"
    inside = "<html><body><main><article><p>Own text {k}</p><div><p>About the author</p></div></article></main></body></html>"
    rows = [row(100 + k, f"http://teaser.example/{k}", teaser.format(k=k)) for k in range(8)]
    rows += [row(200 + k, f"http://inside.example/{k}", inside.format(k=k)) for k in range(8)]
    rows += [row(300, "http://alone.example/", teaser.format(k=0))]
    got = {r["page_id"]: r["text"] for r in H.extract_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[100 + k] == f"A long story of page {k}" for k in range(8))
    assert all(got[200 + k] == f"Own text {k}" for k in range(8))
    assert got[300] == "Join us\nA long story of page 0"


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    frame(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(1, 24)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns)
    assert out.count() > 0
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, none, str(tmp_path))
        assert got.count() == 0, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert got.columns == docs.columns, name


def test_tokens_follow_html():
    article = "<article>{}</article>"
    for raw, want in (
        ("<p>a</p><svg-icon></svg-icon><p>b</p>", "a\nb"), ("<p>a</p><video-js><p>b</p>", "a\nb"), ("<p title='the hidden valley'>b</p>", "b"), ("<p hidden>a</p><p aria-hidden=true>c</p><p>b</p>", "b"),
        ("<a title=it's href=x>link</a><p>b don't go</p>", "link\nb don't go"), ("<svg class='i'/><p>b</p>", "b"), ("<datalist><option>x<option>y</datalist><p>b</p>", "b"),
        ("<p data-x='a > b'>c</p>", "c"), ('<p title="a>c</p><p>d', "c\nd"), ("<span class=hidden>x<span>y</span>z</span><p>b", "b"), ("<script-x>a</script-x><p>b", "a\nb"), ("<!--><p>a<!-- b --!> c -->", "a"),
    ):
        assert H.extract(article.format(raw)) == want, raw
    assert H.extract("<main>text</main><article>teaser</article>") == "text\nteaser"
    assert H.extract("<body><div class='layout has-sidebar'><article>text</article></div>") == "text"


def test_hostile_pages_take_linear_time():
    import time

    n = 2**20
    for part in ('<a "', "<a x='>'", "<!", "<div>", "<div></p>", "<canvas>", "<svg>", "<!--", "<a", "<a =", "<p a=b ", "<td><span hidden>", "</div>", "<a b=\""):
        began = time.time()
        H.extract(part * (n // len(part)))
        assert time.time() - began < 5, part


def host_rows(first, n, page):
    return [row(first + k, f"http://h{first}.example/{k}", page(k)) for k in range(n)]


def test_slots_decide_without_names(spark):
    """Of pages of nothing but div elements, what the host has in its slots tells menu, advert, article and footer apart."""
    def page(k):
        menu = "".join(f"<div><a href=/{k}{j}>item {k} {j}</a></div>" for j in range(5))
        text = "".join(f"<div>Sentence {k} {j} of a story that is long enough to be one.</div>" for j in range(4))
        return f"<html><body><div>{menu}</div><div>Buy now {k}</div><div><h1>Title {k}</h1>{text}</div><div>Written by {k}</div></body></html>"

    got = {r["page_id"]: r["text"] for r in H.extract_text(spark.createDataFrame(host_rows(100, 9, page), SCHEMA)).collect()}
    for k in range(9):
        assert got[100 + k] == "\n".join([f"Title {k}", *[f"Sentence {k} {j} of a story that is long enough to be one." for j in range(4)]])


def test_slots_decide_on_the_given_pages(spark):
    """All names of elements and classes taken away, the pages of the table give the same text, by their templates."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    bare = pages.withColumn("html", F.regexp_replace(F.regexp_replace("html", "<(nav|article|footer)>", "<div>"), "</(nav|article|footer)>", "</div>"))
    bare = bare.withColumn("html", F.replace("html", F.lit('<div class="ad">'), F.lit("<div>")))
    want = {r["page_id"]: r["text"] for r in H.extract_text(pages).collect()}
    got = {r["page_id"]: r["text"] for r in H.extract_text(bare).collect()}
    assert got == want
    alone = sum(H.extract(r["html"]) == want[r["page_id"]] for r in bare.limit(100).collect())
    assert alone == 0  # the elements alone don't tell


def test_a_standfirst_is_text_however_short(spark):
    """A page-level element of twelve words beside one of three hundred: nothing but its size speaks against it."""
    def page(k):
        lead = " ".join(f"lead{k}w{j}" for j in range(11)) + f" end{k}."
        body = "".join(f"<p>{' '.join(f'word{k}n{j}m{i}' for i in range(30))}.</p>" for j in range(10))
        return f'<html><body><div class="x"><a href=/>home {k}</a></div><div class="abstract">{lead}</div><div class="content">{body}</div></body></html>'

    got = {r["page_id"]: r["text"] for r in H.extract_text(spark.createDataFrame(host_rows(300, 10, page), SCHEMA)).collect()}
    for k in range(10):
        lines = got[300 + k].split("\n")
        assert len(lines) == 11 and lines[0].endswith(f"end{k}.") and "home" not in got[300 + k]


def test_repeated_text_in_the_flow_of_an_article_is_text(spark):
    """A heading and a credit that every article has stay; what stands in an element of its own, or around it, goes."""
    def page(k):
        first, second = (" ".join(f"word{k}p{j}n{i}" for i in range(40)) for j in range(2))
        return (
            "<html><body><div>Read by a million people every single day.</div><div>"
            f"<h1>Title {k}</h1><p>{first}.</p><h2>Background</h2><p>Reporting by the city desk.</p><div>Share this with all your friends now.</div><p>{second}.</p></div>"
            "<div>All rights of this text are reserved by us.</div></body></html>"
        )

    got = {r["page_id"]: r["text"] for r in H.extract_text(spark.createDataFrame(host_rows(400, 8, page), SCHEMA)).collect()}
    for k in range(8):
        lines = got[400 + k].split("\n")
        assert lines[0] == f"Title {k}" and lines[2:4] == ["Background", "Reporting by the city desk."] and len(lines) == 5


def test_classes_against_brute_force(spark):
    import random

    rng = random.Random(4)
    parts = ["<div class=a>{}</div>", "<section><p>{}</p></section>", "<ul><li>{}<li>x</ul>", "<aside>same</aside>", "<div><div>{}</div></div>"]
    rows = []
    for host in range(4):
        for k in range(rng.randint(3, 12)):
            body = "".join(p.format(rng.randint(0, 3)) for p in parts if rng.random() < 0.9)
            rows.append((f"h{host}", 100 * host + k, f"<html><body>{body}</body></html>"))
    got = {(r["host"], r["token"], r["pages"], r["n"], r["chars"]) for r in H.valid_tokens(spark.createDataFrame(rows, "host string, id long, body string")).collect()}
    got, again = {r for r in got if r[1][:1] != "#"}, {r for r in got if r[1][:1] == "#"}
    holders, leads, sizes = {}, {}, Counter()
    for h, key, body in rows:
        for b in H.parse(body)[0]:
            holders.setdefault(b.text, set()).add((h, key))
            leads.setdefault((h, *b.text.split(" ", 3)[:3]), set()).add(key)
    for h, key, body in rows:
        for b in H.parse(body)[0]:
            if len(holders[b.text]) > 1 or len(leads[h, *b.text.split(" ", 3)[:3]]) >= H.LEAST:
                sizes[h, "#" + b.key[: len(b.key) - len(b.text) - 1]] += len(b.text)
    assert {(r[0], r[1], r[4]) for r in again} == {(*k, n) for k, n in sizes.items()}
    want = set()
    for host in {r[0] for r in rows}:
        of_page = {}
        chars = Counter()
        for _, key, body in (r for r in rows if r[0] == host):
            blocks, elements = H.parse(body)
            of_page[key] = Counter([e.path for e in elements] + [H.key_of(b) for b in blocks])
            for token, n in [(e.path, e.chars) for e in elements] + [(H.key_of(b), len(b.text)) for b in blocks]:
                chars[token] += n
        tokens = {t for c in of_page.values() for t in c}
        vector = {t: tuple(of_page[k][t] for k in sorted(of_page)) for t in tokens}
        for t, v in vector.items():
            mates = [u for u in tokens if vector[u] == v]
            pages = sum(map(bool, v))
            if pages >= max(H.LEAST, H.SHARE * len(of_page)) and len(mates) > 1 and any("#" not in u for u in mates):
                want.add((host, t, pages, sum(v), chars[t]))
    assert got == want and want


def test_ids_beside_nulls(spark):
    rows = [row(2**53 + 1, "u", "<p>a"), row(None, "u", "<p>b"), row(5, "u", None)]
    got = H.extract_text(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()
    assert {(r["page_id"], r["text"]) for r in got} == {(2**53 + 1, "a"), (None, "b"), (5, "")}
