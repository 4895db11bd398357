import base64
import hashlib
import time
from collections import defaultdict

from plumbline.llm import archives, extraction, url_lists

PAGES = "page_id long, url string, html string, text string, digest int"


def rows():
    texts = [None, "", "<p>a</p>", "<p>a</p>", "x\r\n\r\nWARC/1.1\r\n\r\n", "http://x 0.0.0.0 19700101000000 text/html 3\nabc\n", "é" * 3000, "", "<p>a</p>", "\n\n", "end\n"]
    return [(i * 3 + 1, None if i == 2 else f"http://h{i}.example.com/a b", t, "t", 1) for i, t in enumerate(texts)]


def check(got, given):
    groups = defaultdict(list)
    for i, _, t, *_ in given:
        groups[(t or "").encode()].append(i)
    assert len(got) == len(given)
    by = {r.page_id: r for r in got}
    for raw, ids in groups.items():
        for i in ids:
            r = by[i]
            assert r.payload_bytes == len(raw)
            assert r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
            assert (r.record_type, r.refers_to) == (("response", None) if i == min(ids) else ("revisit", min(ids)))


def test_archives_round_trip(spark, monkeypatch):
    check(archives.round_trip(spark.createDataFrame(rows(), PAGES)).collect(), rows())
    monkeypatch.setattr(archives, "ARCHIVE_BYTES", 10)
    check(archives.round_trip(spark.createDataFrame(rows(), PAGES).repartition(2)).collect(), rows())
    assert archives.round_trip(spark.createDataFrame([], PAGES)).collect() == []


def test_arc_versions_are_parsed():
    for version in (1, 2):
        data = archives.arc_head(version, "n.arc")
        data += archives.arc_record(version, "n.arc", len(data), "http://a/", "20200102030405", b"HTTP/1.0 200 OK\r\n\r\nbody")
        ((at, head, block),) = archives.arc_records(data)
        assert head["URL"] == "http://a/" and block.endswith(b"body") and data[at:].startswith(b"http://a/")
    record = archives.warc_record("response", "http://a/", "20200102030405", "i", b"body", block, 1, None)
    assert b"WARC-Date: 2020-01-02T03:04:05Z" in record and next(archives.warc_records(record))[1] == block


def test_main_text(spark):
    html = (
        "<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>a</a></li></ul></nav><!-- ad -->"
        "<div class='ad'>Buy now.</div><article><h1>Title &amp; more</h1><p><b>Some   text,\n of the article.<br><p>It goes on&hellip; and <i>on</i>ward &am"
        "<aside>Not this, it is only related.</aside><section class='comments'><p>Nice post, really good.</p></section></article><footer>&copy; me</footer>"
    )
    given = [(1, "u", html, "t", 1), (2, None, None, "t", 1), (3, "u", "", "t", 1), (4, "u", "<div>" * 3000 + "x", "t", 1)]
    got = {r.page_id: r for r in extraction.main_text(spark.createDataFrame(given, PAGES)).collect()}
    assert got[1].text == "Title & more Some text, of the article. It goes on… and onward &am"
    assert got[1].n_chars == len(got[1].text)
    assert got[2].text == "" and got[3].n_chars == 0 and 4 in got
    assert extraction.main_text(spark.createDataFrame([], PAGES)).collect() == []


def test_marginals_equal_enumeration():
    import itertools
    import math

    model = extraction.trained()
    tree = extraction.Tree("<body><article><p>One two, three.</p><div class='ad'>x</div></article><footer>f</footer></body>")
    n = len(tree.parent)
    weight = [0.0] * n
    total = 0.0
    for states in itertools.product((0, 1), repeat=n):
        p = 1.0
        for i in range(n):
            p *= math.exp(states[i] * (model.bias + sum(model.weights[f] for f in extraction._features(tree, i))))
            if i:
                pull = model.pulls[extraction._KIND.get(tree.tag[i], extraction._OTHER)]
                p *= math.exp(pull if states[i] == states[tree.parent[i]] else -pull)
        total += p
        for i in range(n):
            weight[i] += p * states[i]
    for a, b in zip(model.marginals(tree), weight):
        assert abs(a - b / total) < 1e-6


def test_url_lists(spark):
    day = 86_400
    log = [("domain:x.org", "add", 10 * day), ("domain:x.org", "remove", 50 * day), ("domain:x.org", "add", 50 * day), ("domain:x.org", "add", 90 * day), ("path:y.com/bad", "add", 0), (None, "add", 1), ("domain:z", None, 1)]
    seen = [(1, "http://a.x.org/", 9 * day), (2, "http://a.X.org:80/q", 10 * day), (3, "https://u@x.org", 50 * day), (4, "http://x.org", 400 * day), (5, "http://y.com/bad/2?x", 5), (5, "http://y.com/badly", 5), (6, None, 5), (7, "http://x.org", None), (8, "nonsense", 3)]
    run = lambda c, e: sorted((r.page_id, r.blocked, r.n_active, r.entry) for r in url_lists.url_filter(spark.createDataFrame(c, "page_id long, url string, fetched_at long"), spark.createDataFrame(e, "value string, action string, at long")).collect())
    assert [(i, b) for i, b, _, _ in run(seen, log)] == [(1, False), (2, True), (3, False), (4, True), (5, False), (5, True), (6, False), (7, False), (8, False)]
    assert not any(b for _, b, _, _ in run(seen, []))
    assert run([], log) == []


TEXT = "First the river rose, then it fell. Nobody in the town had seen the like of it."
MORE = "By evening the bridge was open again, and the carts went over it."
LAYOUTS = [
    ("{a} {b}", []),
    ("<p>{a}</p><p>{b}</p>", []),
    ("<body>{a}<br>{b}</body>", []),
    ("<html><body><h1>Head line</h1><p>{a}</p><p>{b}</p></body></html>", ["Head line"]),
    ("<html><body><div><div><p>{a}</p></div><div><p>{b}</p></div></div></body></html>", []),
    ("<html><body><table><tr><td><p>{a}</p><p>{b}</p></td></tr></table></body></html>", []),
    ("<body><div id=content><p>{a}</p><p>{b}</p></div></body>", []),
    ("<body><main><h2>Head line</h2><p>{a}</p><p>{b}</p></main></body>", ["Head line"]),
    ("<body><div class='post'><p>{a}</p><p>{b}</p></div></body>", []),
    ("<body><article><section><p>{a}</p></section><section><p>{b}</p></section></article></body>", []),
]
CLUTTER = [
    "",
    "<nav><ul><li><a href='/'>home</a></li><li><a href='/n'>news</a></li></ul></nav>",
    "<footer><p>All rights are ours, of course.</p></footer>",
    "<div class='sidebar'><p>You may also like this, or that.</p></div>",
    "<script>var a = '<p>no</p>';</script><style>p {{}}</style>",
    "<div class='comments'><p>What a story, I liked it.</p></div>",
]


def test_layouts():
    """Ten layouts with six kinds of clutter, text known."""
    model = extraction.trained()
    for page, head in LAYOUTS:
        for clutter in CLUTTER:
            for html in (page, page.replace("<body>", "<body>" + clutter, 1), page.replace("</body>", clutter + "</body>")):
                assert model.text(html.replace("{a}", TEXT).replace("{b}", MORE)) == " ".join([*head, TEXT, MORE]), html


def test_scanner_is_linear():
    began = time.time()
    for page in ("<a " * 350_000, '<a x="' * 170_001, "<!--" * 250_000, "<" * 1_000_000, "<a '>" * 200_000, "&" * 1_000_000, "<b>" * 300_000):
        extraction.Tree(page)
    assert time.time() - began < 60
