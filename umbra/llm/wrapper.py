"""Main text of web pages by wrapper induction.

A page becomes a tree of its block elements (tag, class, id without digits; siblings of one kind that hold text
alone are one node) with a hash of each node's text.  Of each host the page of the smallest id is the pilot; the trees of all other
pages of that host are aligned with it by simple tree matching: the largest set of pairs of nodes of one kind that
keeps order and parents.  Over all pages of the host each pilot node counts how many pages have it, where its text
is the pilot's, where it is named as something other than the article, where it lies in an article element, and how
much of its text is links.  The sums make the wrapper: nodes of one and the same text are template, nodes named or
linked out are, varying nodes are content, and in an article element (or one so named) everything but such nodes.
A page's node takes the role of the pilot node that it is aligned with; one that has none, its own evidence.

A page whose largest node is the pilot's is a copy and says nothing about what is constant; constancy takes EVIDENCE
other pages, and never removes paragraphs, headings, lists and tables of an article element.

Trees move, not pages: (host, tree) is some hundred bytes a page.  Where the wrapper overrules a page's own
evidence, the nodes in question travel to the page by its id and hash; pages move only if those are many.

Character references are decoded, runs of white space become a blank, blocks are joined by a blank in page order.
Null and empty pages have an empty text; a null or hostless url makes a page a site of its own.  A null id is the
smallest.  Repeated rows are pages of one text; ties of pilots go to the smaller tree.  Elements nested deeper than DEEP count
as part of the one above them.  Unclosed comments, scripts and tags end with the page.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import html
import marshal
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mapped, stored

#: Other pages that must have shown a node for it to be constant, the share of them with the pilot's text, depth.
EVIDENCE, AGREE, DEEP = 2, 0.9, 60
#: Sibling lists of so many pairs are compared row by row in arrays: equal results, sooner.
WIDE = 1_000

# fixed values: elements of HTML by what they do
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SKIPPED = frozenset("script style noscript template title textarea select button iframe object svg canvas audio video head math".split())
NAMED = frozenset("nav footer aside form dialog menu".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd pre blockquote table thead tbody tr td th figure figcaption".split())
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: An open element that a start tag ends, unless one of the others is in between.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Parts of class names and ids that name what isn't the article, headers apart, and that name the article.
WORDS_OUT = frozenset("""ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promos promotion nav navbar navigation menu
breadcrumb breadcrumbs sidebar aside widget widgets footer masthead topbar cookie cookies consent gdpr notice notices notification alert popup modal overlay
newsletter subscribe subscription signup login comment comments reply replies disqus respond share sharing social related recommended recommendations
pagination pager search form copyright disclaimer toolbar paywall""".split())
WORDS_HEADER = frozenset("header head topbar".split())
WORDS_IN = frozenset("article articlebody post entry story content main maincontent".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|itemprop|hidden|style|aria-hidden)(?![\w-])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_AFFIRM = re.compile(r"(?:has|no|with|without|is)[-_]|.*[-_](?:open|closed)$", re.I)
_END = {t: re.compile(rf"</{t}(?=[\s/>])|</{t}\Z", re.I) for t in SKIPPED}


def _looked_at(tag: str, attributes: str) -> tuple[str, bool, bool, bool]:
    """Kind of an element, and whether it names itself as not the article, as a header, as the article."""
    a: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes):
        a.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    names = [x for x in f"{a.get('class', '')} {a.get('id', '')}".split() if not _AFFIRM.match(x)]
    kind = ".".join([tag, *sorted({re.sub(r"\d+", "", x) for x in a.get("class", "").split()}), *(["#" + re.sub(r"\d+", "", a["id"])] if a.get("id") else [])])
    parts = [{p.lower() for p in _PARTS.findall(x)} for x in names]
    words = set().union(*parts)
    role = a.get("role", "").lower()
    inside = tag in ("article", "main") or role in ("main", "article") or a.get("itemprop", "").lower() == "articlebody"
    hidden = "hidden" in a or "display:none" in a.get("style", "").replace(" ", "").lower() or a.get("aria-hidden", "").lower() == "true"
    out = hidden or tag in NAMED or role in ROLES or bool(words & WORDS_OUT)
    if inside and not hidden and words & WORDS_IN:
        out = role in ROLES  # an article that mentions its comments
    if not inside and not out and tag in ("div", "section", "td") and words & WORDS_IN and not words & (WORDS_HEADER | {"meta", "title", "list"}):
        inside = True
    return kind, out, not inside and (tag == "header" or bool(words & WORDS_HEADER) and not words & WORDS_IN), inside and not out


_KINDS: dict[tuple[str, str], tuple[str, bool, bool, bool]] = {}


def _seen(tag: str, attributes: str) -> tuple[str, bool, bool, bool]:
    if not attributes or attributes.isspace() or attributes == "/":
        attributes = ""
    if (got := _KINDS.get((tag, attributes))) is None:
        if len(_KINDS) > 20_000 or len(attributes) > 2_000:
            _KINDS.clear()
        got = _KINDS[tag, attributes] = _looked_at(tag, attributes)
    return got


def parsed(page: str) -> tuple[list[tuple[int, str, bool, bool, bool]], list[tuple[int, str, int]]]:
    """Elements (parent, kind, out, header, inside), parents first, and blocks (element, text, characters of links)."""
    elements: list[tuple[int, str, bool, bool, bool]] = [(-1, "", False, False, False)]
    blocks: list[tuple[int, str, int]] = []
    stack: list[tuple[str, int]] = [("", 0)]
    count: dict[str, int] = {}
    held: list[str] = []
    links = inside_a = pos = 0

    def flush() -> None:
        nonlocal links
        if held:
            text = " ".join("".join(held).split())
            if text:
                blocks.append((stack[-1][1], text, min(links, len(text))))
            held.clear()
            links = 0

    def pop() -> None:
        tag, _ = stack.pop()
        count[tag] -= 1

    while pos < len(page):
        m = _TOKEN.search(page, pos)
        text = page[pos : m.start()] if m else page[pos:]
        if text:
            if "&" in text:
                text = html.unescape(text)
            held.append(text)
            if inside_a:
                links += len(text)
        if not m:
            break
        pos = m.end()
        end, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag == "a":
            inside_a = 0 if end else 1
        if tag in INLINE:
            continue
        if tag == "br":
            held.append(" ")
            continue
        flush()
        if end:
            if count.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in SKIPPED:
            if tag == "head":
                continue
            if not attributes.endswith("/") or tag not in ("svg", "math"):
                found = _END[tag].search(page, pos)
                pos = found.start() if found else len(page)
            continue
        if tag in VOID:
            continue
        if tag in ENDS_P and count.get("p"):
            while stack[-1][0] != "p":
                pop()
            pop()
        if tag in ENDS:
            which, walls = ENDS[tag]
            k = len(stack) - 1
            while k > 0 and len(stack) - k < 8 and stack[k][0] not in which and stack[k][0] not in walls:
                k -= 1
            if stack[k][0] in which:
                del_to = k
                while tag == "tr" and stack[del_to][0] in ("td", "th") and stack[del_to - 1][0] in which:
                    del_to -= 1
                while len(stack) > del_to:
                    pop()
        at = stack[-1][1]
        if len(stack) < DEEP:
            elements.append((at, *_seen(tag, attributes)))
            at = len(elements) - 1
        inside_a = 0
        stack.append((tag, at))
        count[tag] = count.get(tag, 0) + 1
    flush()
    return elements, blocks


def tree(page: str) -> tuple[list[tuple], list[tuple[int, str]], bool]:
    """Nodes (parent, kind, hash, characters, of links, out, inside, prose), parents first, of elements that hold text; blocks
    (node, text); whether the page has an article element."""
    elements, blocks = parsed(page)
    n = len(elements)
    article = [False] * n  # an article below
    used = [False] * n
    for e, _, _ in blocks:
        while e >= 0 and not used[e]:
            used[e] = True
            e = elements[e][0]
    out, inside = [False] * n, [False] * n
    for e in range(n - 1, 0, -1):
        if article[e] or elements[e][4]:
            article[elements[e][0]] = True
    for e in range(1, n):
        up, _, named, header, ins = elements[e]
        out[e] = out[up] or ((named or header and not inside[up]) and not article[e])
        inside[e] = (inside[up] or ins) and not out[e]
    whole = any(used[e] and inside[e] for e in range(n))
    childless = [True] * n
    for e in range(1, n):
        if used[e]:
            childless[elements[e][0]] = False
    nodes: list[list] = []
    number = [0] * n
    open_run: dict[int, tuple[str, int, int]] = {}
    for e in range(n):
        if not used[e]:
            continue
        up, kind = elements[e][:2]
        run = open_run.get(up)
        if e and childless[e] and run and run[0] == kind and nodes[run[1]][5] == out[e]:
            number[e] = run[1]
            continue
        number[e] = len(nodes)
        nodes.append([number[up] if e else -1, kind + "+" if childless[e] else kind, 0, 0, 0, out[e], inside[e], kind.split(".")[0] in PROSE])
        if e:
            open_run[up] = (kind if childless[e] else "\0", number[e], e)
    placed = []
    for e, text, link in blocks:
        x = nodes[number[e]]
        x[2] = zlib.crc32(text.encode("utf-8", "surrogatepass"), x[2])
        x[3] += len(text)
        x[4] += link
        placed.append((number[e], text))
    return [tuple(x) for x in nodes], placed, whole


def _shapes(t: list[tuple], known: dict[tuple, int]) -> tuple[list[int], list[list[int]]]:
    """Number of each node's shape (its kind and its children's shapes), and its children."""
    kids: list[list[int]] = [[] for _ in t]
    for i, x in enumerate(t):
        if x[0] >= 0:
            kids[x[0]].append(i)
    shape = [0] * len(t)
    for i in range(len(t) - 1, -1, -1):
        shape[i] = known.setdefault((t[i][1], *[shape[j] for j in kids[i]]), len(known))
    return shape, kids


def _aligned_lists(p: list[int], q: list[int], weight, path: bool) -> tuple[int, list[tuple[int, int]]]:
    """The largest sum of weights of pairs (of p and q, in order) and, if asked for, their places; of equal sums that which leaves out
    the later nodes of p, then of q."""
    if len(p) * len(q) < WIDE:
        m = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
        for i, u in enumerate(p):
            row, above = m[i + 1], m[i]
            for j, v in enumerate(q):
                row[j + 1] = max(above[j + 1], row[j], above[j] + weight(u, v))
        pairs, i, j = [], len(p), len(q)
        while path and i and j:
            if m[i][j] == m[i - 1][j]:
                i -= 1
            elif m[i][j] == m[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((i, j))
        return m[-1][-1], pairs
    kinds, at = np.unique(np.array(q), return_inverse=True)
    weights = {u: np.array([weight(u, v) for v in kinds.tolist()], np.int32)[at] for u in set(p)}

    def rows(i: int, j: int, row: np.ndarray) -> Iterator[np.ndarray]:
        for u in p[i:j]:
            new = np.zeros_like(row)
            np.maximum.accumulate(np.maximum(row[1:], row[:-1] + weights[u]), out=new[1:])
            row = new
            yield row

    # every step-th row is kept, those between are made again on the way back
    step = int(len(p) ** 0.5) + 1
    kept = {0: np.zeros(len(q) + 1, np.int32)}
    row = kept[0]
    for i, row in enumerate(rows(0, len(p), kept[0]), 1):
        if i % step == 0:
            kept[i] = row
    pairs, i, j = [], len(p), len(q)
    while path and i and j:
        low = (i - 1) // step * step
        m = [kept[low], *rows(low, i, kept[low])]
        while i > low and j:
            if m[i - low][j] == m[i - low - 1][j]:
                i -= 1
            elif m[i - low][j] == m[i - low][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((i, j))
    return int(row[-1]), pairs


def matched(a: list[tuple], b: list[tuple]) -> dict[int, int]:
    """Simple tree matching: pairs (node of b: node of a) of one kind, in order, below paired parents, as many as there can be.

    Subtrees of one shape score alike, so each pair of shapes is scored once; lists of any length are aligned in full."""
    if not a or not b or a[0][1] != b[0][1]:
        return {}
    known: dict[tuple, int] = {}
    (shape_a, kids_a), (shape_b, kids_b) = _shapes(a, known), _shapes(b, known)
    shapes = list(known)
    found: dict[tuple[int, int], int] = {}
    back: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def below(x: int, y: int, path: bool) -> tuple[int, list[tuple[int, int]]]:
        p, q = shapes[x][1:], shapes[y][1:]
        if not p or not q:
            return 0, []
        kinds = [shapes[i][0] for i in p]
        if kinds == [shapes[j][0] for j in q] and (len(set(kinds)) == len(kinds) or not any(len(shapes[i]) > 1 or len(shapes[j]) > 1 for i, j in zip(p, q))):
            return sum(score(i, j) for i, j in zip(p, q)), list(zip(range(len(p)), range(len(q))))
        return _aligned_lists(list(p), list(q), score, path)

    def score(x: int, y: int) -> int:
        if shapes[x][0] != shapes[y][0]:
            return 0
        if (got := found.get((x, y))) is None:
            got = found[x, y] = 1 + below(x, y, False)[0]
        return got

    pairs, todo = {}, [(0, 0)]
    while todo:
        x, y = todo.pop()
        pairs[y] = x
        both = shape_a[x], shape_b[y]
        if both not in back:
            back[both] = below(*both, True)[1]
        todo += [(kids_a[x][i], kids_b[y][j]) for i, j in back[both]]
    return pairs


def content(prose: bool, pages: int, outs: int, insides: int, whole: int, chars: int, links: int, evidence: int = 0, agree: int = 0) -> bool:
    """Whether a node is content, by its sums over pages."""
    constant = evidence >= EVIDENCE and agree >= AGREE * evidence
    if 2 * outs > pages:
        return False
    if 2 * insides > pages:
        return prose or not constant
    return 2 * whole <= pages and not constant and 2 * links <= chars


def _own(nodes: list[tuple], whole: bool) -> list[bool]:
    return [content(x[7], 1, x[5], x[6], whole, x[3], x[4]) for x in nodes]


_ALIGNED: dict[tuple, dict[int, int]] = {}


def _aligned(pilot: list[tuple], nodes: list[tuple]) -> dict[int, int]:
    """matched(), which sees only parents and kinds; pages of a site repeat them."""
    key = (tuple(x[:2] for x in pilot), tuple(x[:2] for x in nodes))
    if (got := _ALIGNED.get(key)) is None:
        got = matched(pilot, nodes)
        if len(nodes) <= 200 and len(pilot) <= 200:
            if len(_ALIGNED) >= 2_000:
                _ALIGNED.clear()
            _ALIGNED[key] = got
    return got


def _main(nodes: list[tuple]) -> int:
    """Hash of the largest node that isn't named as something else."""
    return max(((x[3], x[2]) for x in nodes if not x[5]), default=(0, 0))[1]


HOST = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def trees(pages: DataFrame) -> DataFrame:
    """(page_id, th, host, tree binary) of pages with text, host null where the url has none; th: hash of the page."""
    d = pages.select(F.col("page_id").cast("long").alias("page_id"), F.xxhash64("html").alias("th"), F.lower(F.nullif(F.regexp_extract("url", HOST, 1), F.lit(""))).alias("host"), F.col("html").cast("string").alias("html"))

    def f(b: pa.RecordBatch) -> dict:
        out = []
        for x in b.column("html"):
            nodes, _, whole = tree(x.as_py())
            out.append(zlib.compress(marshal.dumps((nodes, whole)), 1))
        return {"page_id": b.column("page_id"), "th": b.column("th"), "host": b.column("host"), "tree": out}

    return mapped(d.where("html <> ''"), f, "page_id long, th long, host string, tree binary")


def _read(data: bytes) -> tuple[list[tuple], bool]:
    return marshal.loads(zlib.decompress(data))


_SUMS = ("pages", "outs", "insides", "whole", "chars", "links", "evidence", "agree")


def wrappers(trees: DataFrame) -> DataFrame:
    """(host, pilot binary, roles array<boolean>): whether each node of each host's pilot is content."""
    pilots, _ = stored(trees.where("host is not null").groupBy("host").agg(F.min(F.struct("page_id", "tree")).alias("p"), F.count("*").alias("pages")).where("pages > 1").select("host", F.col("p.tree").alias("pilot")), "pilots")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], list[int]] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.int32()), *(pa.array([v[i] for v in sums.values()], pa.int64()) for i in range(len(_SUMS)))], names=["host", "node", *_SUMS])

        for b in batches:
            for host, data, pilot in zip(*(b.column(c).to_pylist() for c in ("host", "tree", "pilot"))):
                (nodes, whole), (model, _) = _read(data), _read(pilot)
                other = data != pilot and _main(nodes) != _main(model)
                for j, i in _aligned(model, nodes).items():
                    x = nodes[j]
                    s = sums.setdefault((host, i), [0] * len(_SUMS))
                    for k, v in enumerate((1, x[5], x[6], whole, x[3], x[4], other and x[3] > 0, other and x[3] > 0 and x[2] == model[i][2])):
                        s[k] += v
            if len(sums) > 100_000:
                yield out()
                sums = {}
        if sums:
            yield out()

    joined = trees.join(pilots, "host").select("host", "tree", "pilot")
    schema = "host string, node int, " + ", ".join(f"{c} long" for c in _SUMS)
    sums = joined.mapInArrow(count, schema).groupBy("host", "node").agg(*[F.sum(c).alias(c) for c in _SUMS])
    return pilots.join(sums.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("node", *_SUMS))).alias("sums")), "host")


def overruled(trees: DataFrame, wrappers: DataFrame) -> DataFrame:
    """(page_id, th, flips array<int>): nodes whose role by the wrapper isn't that of their own evidence."""

    def f(b: pa.RecordBatch) -> dict:
        ids, ths, flips = [], [], []
        for page, th, data, pilot, sums in zip(*(b.column(c).to_pylist() for c in ("page_id", "th", "tree", "pilot", "sums"))):
            (nodes, whole), (model, _) = _read(data), _read(pilot)
            role = {s["node"]: content(model[s["node"]][7], *(s[c] for c in _SUMS)) for s in sums}
            own = _own(nodes, whole)
            flip = [j for j, i in _aligned(model, nodes).items() if nodes[j][3] and role[i] != own[j]]
            if flip:
                ids.append(page)
                ths.append(th)
                flips.append(flip)
        return {"page_id": ids, "th": ths, "flips": flips}

    joined = trees.join(wrappers, "host").select("page_id", "th", "tree", "pilot", "sums")
    return mapped(joined, f, "page_id long, th long, flips array<int>").dropDuplicates(["page_id", "th"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of (page_id, url, html)."""
    t, _ = stored(trees(pages), "trees")
    w, _ = stored(wrappers(t), "wrappers")
    flips, _ = stored(overruled(t, w), "overruled")
    d = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), F.xxhash64("html").alias("th"))
    other = flips.select(F.col("page_id").alias("umbra_page"), F.col("th").alias("umbra_th"), "flips")
    d = d.join(other, F.expr("page_id <=> umbra_page and th = umbra_th"), "left").select("page_id", "url", "html", "flips")

    def f(b: pa.RecordBatch) -> dict:
        texts = []
        for page, flips in zip(b.column("html"), b.column("flips").to_pylist()):
            nodes, blocks, whole = tree(page.as_py() or "")
            keep = _own(nodes, whole)
            for j in flips or ():
                keep[j] = not keep[j]
            texts.append(" ".join(text for j, text in blocks if keep[j]))
        return {"page_id": b.column("page_id"), "url": b.column("url"), "text": texts, "n_chars": [len(x) for x in texts]}

    return mapped(d, f, "page_id long, url string, text string, n_chars long")
