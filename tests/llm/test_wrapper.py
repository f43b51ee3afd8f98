"""Wrapper induction: pages of known texts, matching against a plain recursion, odd rows."""

import random
from functools import cache

from umbra.llm import wrapper

SCHEMA = "page_id long, url string, html string"


def found(spark, rows):
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", text string, th long")
    return {r["page_id"]: r for r in wrapper.extract(d).collect()}


def test_named_parts_go(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a><li>B</ul></nav><!-- note --><div class="ad">Buy</div><div class="cookie-notice">We use cookies</div>
<article class="post comments-open"><header><h1>Tea &amp; cake</h1></header><p>One <b>bo</b>ld&nbsp;word<br>and&#33; more<p>Two
 lines <img alt="a > b"><form><input><label>Mail</label></form><table><tr><td>x<td>y</table><pre>a   b</pre><ul><li>item</ul><footer>tags</footer>
<div class="ShareBar social">Share</div></article><aside>Side</aside><section id="comments"><article class="comment"><p>First!</p></article></section><noscript>no</noscript><footer>&copy; 2020</footer>"""
    got = found(spark, [(1, "https://a.example/x", page)])
    assert got[1]["text"] == "Tea & cake One bold word and! more Two lines x y a b item" and got[1]["n_chars"] == len(got[1]["text"])


def test_wrapper_decides_where_nothing_is_named(spark):
    """Without telling names: constant nodes go, varying ones stay, on a site of enough pages."""
    rng = random.Random(13)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    rows, want = [], {}
    for i in range(400):
        host = "hot.example" if i < 300 else f"h{i % 10}.example"
        paras = [words(20) for _ in range(rng.randint(1, 6))]
        title = words(4)
        rows.append((i, f"http://{host}/{i}", f'<html><body><div class="x1">Daily {host}</div><div class="x2"><div><div class="t{i}">{title}</div>{"".join(f"<p>{p}</p>" for p in paras)}</div><div class="x5"><a href=1>{words(2)}</a> <a href=2>{words(3)}</a></div></div><div class="x3">All rights {host}</div></body></html>'))
        want[i] = " ".join([title, *paras])
    rows.append((1000, "http://single.example/", "<html><body><div>lone head</div><p>lone text</p></body></html>"))
    got = found(spark, rows)
    assert all(got[i]["text"] == want[i] for i in want) and got[1000]["text"] == "lone head lone text"


def test_copies_are_no_evidence(spark):
    """Pages of one article under varying adverts keep it; so do articles that share passages."""
    page = lambda i, title, body: f'<body><nav>n{i}</nav><div class="ad">a{i}</div><article><h1>{title}</h1>{body}</article></body>'
    rows = [(i, "http://a.example/p", page(i, "Same", "<p>same text</p>")) for i in range(5)] + [(10 + i, "http://b.example/p", page(i, "Title", f"<p>shared passage</p><p>own {i}</p>")) for i in range(5)]
    rows += [(20 + i, "http://c.example/p", f"<body><div>own words {i // 2}</div></body>") for i in range(2)]
    got = found(spark, rows)
    assert {got[i]["text"] for i in range(5)} == {"Same same text"} and got[12]["text"] == "Title shared passage own 2" and got[20]["text"] == got[21]["text"] == "own words 0"


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "no url", ""), (3, "http:///x", "just text & no tags"), (4, "http://e.example", "<div" + " <div>" * 5000 + "deep" + "</div>" * 5000), (5, "http://e.example", "<p>" * 20_000 + "many"), (None, None, "<p>a</p><p>b"), (7, "x", "<!-- open <p>gone"), (8, "x", "<script>never closed <p>gone"), (9, "http://e.example", "<ul>" + "<li>i<h2>j</h2>" * 5000), (9, "http://e.example", "<ul>" + "<li>i<h2>j</h2>" * 5000), (10, "x", "<p title='un\"closed>text</p>"), (11, "x", "&am"), (12, "x", " \n\t ")]
    d = spark.createDataFrame(rows, SCHEMA)
    got = wrapper.extract(d).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert (by[1]["text"], by[1]["n_chars"], by[2]["text"], by[3]["text"], by[None]["text"], by[7]["text"], by[8]["text"], by[11]["text"], by[12]["text"]) == ("", 0, "", "just text & no tags", "a b", "", "", "&am", "")
    assert by[4]["text"].endswith("deep") and by[5]["text"] == "many" and by[9]["text"] == " ".join(["i j"] * 5000)
    assert wrapper.extract(d.limit(0)).count() == 0


def test_matching_is_largest():
    rng = random.Random(14)

    def grown(n):
        nodes = [(-1, "r")]
        for _ in range(n):
            nodes.append((rng.randrange(max(0, len(nodes) - 4), len(nodes)), rng.choice("ab")))
        order = sorted(range(len(nodes)), key=lambda i: (nodes[i][0], i))
        place = {o: k for k, o in enumerate(order)}
        return [(place[nodes[o][0]] if o else -1, nodes[o][1]) for o in order]

    for _ in range(200):
        a, b = grown(rng.randint(0, 9)), grown(rng.randint(0, 9))
        kids = lambda t, i: [j for j, x in enumerate(t) if x[0] == i]

        @cache
        def plain(x, y):
            if a[x][1] != b[y][1]:
                return 0
            p, q = kids(a, x), kids(b, y)

            @cache
            def best(i, j):
                return 0 if i == len(p) or j == len(q) else max(best(i + 1, j), best(i, j + 1), best(i + 1, j + 1) + plain(p[i], q[j]))

            return 1 + best(0, 0)

        pairs = wrapper.matched(a, b)
        assert len(set(pairs.values())) == len(pairs) and all(a[i][1] == b[j][1] for j, i in pairs.items())
        assert all(pairs[b[j][0]] == a[i][0] for j, i in pairs.items() if j)
        assert len(pairs) == plain(0, 0)


def test_long_lists():
    """Lists of over 500 by 500 siblings are matched in full, as short ones are, ties included."""

    def page(kinds):
        out = [(-1, "")]
        for k in kinds:
            out.append((0, k[0]))
            out += [(len(out) - 1, x) for x in k[1:2]]
        return out

    # the ends differ, the middle agrees but for a few nodes
    a = page(["x", *(["d", f"p{i % 3}"] for i in range(700)), "y"])
    b = page(["u", *(["d", f"p{i % 3}"] for i in range(700) if i % 100 != 7), "v"])
    pairs = wrapper.matched(a, b)
    assert len(pairs) == 1 + 2 * 693
    rng = random.Random(4)
    p, q = ([rng.randrange(12) for _ in range(n)] for n in (90, 70))
    weight = lambda u, v: (u * v) % 5 if u % 4 == v % 4 else 0
    try:
        whole, wrapper.WIDE = wrapper.WIDE, 1
        fast = wrapper._aligned_lists(p, q, weight, True)
        wrapper.WIDE = 1 << 30
        assert fast == wrapper._aligned_lists(p, q, weight, True) and len(fast[1]) > 20
    finally:
        wrapper.WIDE = whole
