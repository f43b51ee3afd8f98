"""Personal data in texts: high-recall generators, boosted trees, calibrated thresholds.  SQL expressions alone.

Base spans follow four fixed patterns and their checks and are always kept.  Generators then propose
further spans, overlapping ones too: cards within longer runs of digits, national and 00-prefixed
phone numbers, spelled-out addresses, IPv6.  Format and context features of a candidate go through
boosted trees, which stand in the plan as CASE expressions.  Scores are calibrated by kind (Platt: a
logistic curve through held-out candidates), and a kind's threshold is the least score whose calibrated
probability, and whose precision on held-out candidates, is PRECISION.  Of overlapping candidates the
best-scored one stays, then the best of those that it leaves, and so on.

The trees learn from two sorts of candidates.  Those of the corpus, from at most about SAMPLE documents
drawn by a hash of the text: every generator's and base pattern's matches before any check, overlaps
included, with the check's outcome as weak label (Luhn, parts and digit counts; what overlaps a checked
span of its kind is one; other generators' matches that no check speaks on are left out).  And TRAINING made-up ones over spark.range, a fixed bound: known formats in
telling and misleading contexts, for formats that a corpus may lack.  Features are counted by distinct
vector before they reach the driver.  measured() gives precision and recall on held-out candidates.

Java's matcher recurses in repeated groups.  So that long runs can't exhaust its stack, single
characters that join the repeated parts are first replaced, one for one, by a private character, and
the patterns become runs of a character class; positions stay as they are.

Nulls count as empty texts: no spans.  Repeated rows and ids, null ids too, are judged row by row; an
empty table gives no rows.  Positions count code points from 0, ends are exclusive.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh

KINDS = ("email", "ip", "card", "phone")
#: Made-up candidates, documents of the corpus that candidates are learned from; rounds, depth, rate; precision of a threshold.
TRAINING, SAMPLE, ROUNDS, DEPTH, RATE, PRECISION = 8192, 8192, 24, 3, 0.3, 0.95
#: Characters of context before a candidate; matches that are placed at once; characters of a piece of a text.
CONTEXT, FEW, PIECE = 32, 64, 1024

#: Stand-ins: for a separator between digits, for a dot between label characters, for these in a text.
_SEP, _DOT, _OTHER = "\ue000", "\ue001", "\ue002"

_LOCAL = "A-Za-z0-9._%+\\-" + _DOT
_BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9\-]++{_DOT}[A-Za-z0-9\-{_DOT}]*+",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": rf"(?<![0-9{_SEP}])[0-9{_SEP}]{{13,37}}+(?![0-9{_SEP}])",
    "phone": r"\+[0-9][\x20().0-9\-]+[0-9]",
}
#: Generators of further candidates: kind and pattern.
_MORE = (
    ("card", r"(?<![0-9])[0-9]{13,19}+(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{4}([ \-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}+(?![0-9])"),
    ("phone", r"(?<![0-9A-Za-z+])\(?[0-9]{3}\)?[ .\-]{1,2}[0-9]{3}[ .\-][0-9]{4}(?![0-9A-Za-z])"),
    ("phone", r"(?<![0-9A-Za-z])00[1-9][0-9]{0,2}+[ .\-]?[0-9]{2,4}+[ .\-][0-9]{2,4}+(?:[ .\-][0-9]{2,4}+){0,3}(?![0-9])"),
    ("email", r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}+ ?[(\[] ?at ?[)\]] ?[A-Za-z0-9\-]{1,63}+(?:(?:\.| ?[(\[] ?dot ?[)\]] ?)[A-Za-z0-9\-]{1,63}+){1,8}"),
    ("ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){5,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
)
#: Words before a candidate that speak for its kind, or against any.
_FOR = {"email": "mail|contact|write|reach", "ip": "ip|host|server|client|addr", "card": "card|visa|master|amex|credit|debit|pay", "phone": "tel|phone|call|fax|mobile|cell|text|whatsapp|reach|ring"}
_AGAINST = r"order|invoice|isbn|issn|ref|version|build|serial|sku|lot|part|no\.|#|total|sum|=|hash|token"


def _literal(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(text: str, pattern: str) -> str:
    """SQL: array of (start, end, m) of the pattern's matches.

    Lengths of what lies between matches, and of these, add up to positions: first for FEW at once,
    then within these, so that no array grows longer than its share."""
    p = _literal(pattern)
    pairs = f"zip_with(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), (s, m) -> named_struct('s', length(s), 'm', m))"
    parts = f"transform(array({pairs}), z -> transform(sequence(0, (size(z) - 1) div {FEW}), i -> slice(z, i * {FEW} + 1, {FEW})))[0]"
    starts = "aggregate(z, named_struct('at', 0, 'out', cast(array() as array<int>)), (a, part) -> named_struct('at', a.at + aggregate(part, 0, (n, x) -> n + x.s + coalesce(length(x.m), 0)), 'out', array_append(a.out, a.at)), a -> a.out)"
    placed = (
        "zip_with(z, " + starts + ", (part, at) -> aggregate(part, named_struct('at', at, 'out', cast(array() as array<struct<start: int, end: int, m: string>>)),"
        " (a, x) -> if(x.m is null, a, named_struct('at', a.at + x.s + length(x.m), 'out', array_append(a.out, named_struct('start', a.at + x.s, 'end', a.at + x.s + length(x.m), 'm', x.m)))), a -> a.out))"
    )
    return f"flatten(transform(array({parts}), z -> {placed})[0])"


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _luhn(digits: str) -> str:
    """SQL: whether a string of digits passes; false for the empty string."""
    return (
        f"(length({digits}) > 0 and aggregate(split(reverse({digits}), ''), named_struct('i', 0, 's', 0), (a, d) -> if(d = '', a,"
        f" named_struct('i', a.i + 1, 's', a.s + if(a.i % 2 = 0, int(d), if(int(d) > 4, 2 * int(d) - 9, 2 * int(d)))))).s % 10 = 0)"
    )


_OK = {
    "email": "true",
    "ip": r"forall(split(x.m, '[.]'), p -> length(trim(leading '0' from p)) <= 3 and coalesce(try_cast(concat('0', trim(leading '0' from p)) as int), 0) <= 255)",
    "card": f"length({_digits('x.m')}) between 13 and 19 and {_luhn(_digits('x.m'))}",
    "phone": f"length({_digits('x.m')}) between 9 and 15",
}
#: Cheap tests that a text must pass before a pattern is tried.
_GATE = {"email": "contains(t, '@')", "ip": r"t rlike '[0-9][.][0-9]'", "card": "t rlike '[0-9](?:[ \\\\-]?[0-9]){12}'", "phone": "contains(t, '+')"}
_MORE_GATE = ("gc", "gc", r"t rlike '[0-9]{3}[)]?[ .\\-]{1,2}[0-9]{3}[ .\\-][0-9]{4}'", "contains(t, '00')", "contains(t, 'at)') or contains(t, 'at]') or contains(t, 'at )') or contains(t, 'at ]')", "contains(t, ':')")
_EMPTY = "cast(array() as array<struct<start: int, end: int, m: string>>)"

#: Features of a candidate, as SQL over kind, m, before, after (all small whole numbers).
FEATURES = {
    "kind": "kind",
    "digits": f"length({_digits('m')})",
    "separators": "least(9, length(m) - length(regexp_replace(m, '[ .:()\\\\[\\\\]\\\\-]', '')))",
    "same_separator": "int(size(array_distinct(filter(split(m, ''), c -> c in (' ', '.', '-', ':')))) <= 1)",
    "parenthesis": "int(contains(m, '('))",
    "luhn": f"int({_luhn(_digits('m'))})",
    "first": "coalesce(try_cast(substring(m, 1, 1) as int), 10)",
    "one_digit": f"int(size(array_distinct(filter(split({_digits('m')}, ''), c -> c <> ''))) = 1)",
    "sign": r"case when contains(m, '@') then 1 when startswith(m, '+') then 2 when m rlike '^[0-9]+(?:[.][0-9]+){3}$' then 3 else 0 end",
    "name": "int(m rlike '[.)\\] ][A-Za-z]{2,}$')",
    "pairs": "int(m rlike '^(?:[0-9A-Fa-f]{2}:)+[0-9A-Fa-f]{2}$')",
    "glued": "int(before rlike '[A-Za-z0-9_/=]$' or after rlike '^[A-Za-z0-9_/=]')",
    "for": "int(lower(before) rlike element_at(array(" + ", ".join(_literal(_FOR[k]) for k in KINDS) + "), kind + 1))",
    "against": f"int(lower(before) rlike {_literal(_AGAINST)})",
}


def _training(spark: SparkSession) -> DataFrame:
    """Made-up candidates: kind, m, before, after, label, fold."""
    h = lambda k: f"pmod(xxhash64(id, {k}), 1000000)"
    num = lambda n, k: f"lpad(cast(pmod(xxhash64(id, {k}), {10**n}) as string), {n}, '0')"
    pick = lambda xs, k: f"element_at(array({', '.join(map(_literal, xs))}), cast(pmod(xxhash64(id, {k}), {len(xs)}) as int) + 1)"
    card = f"concat({pick(('3', '4', '5', '6'), 1)}, {num(14, 2)})"
    valid = f"concat({card}, element_at(filter(transform(sequence(0, 9), d -> string(d)), d -> {_luhn(f'concat({card}, d)')}), 1))"
    grouped = "concat_ws(' ', substring(c, 1, 4), substring(c, 5, 4), substring(c, 9, 4), substring(c, 13))"
    phone = [f"concat('(', {num(3, 3)}, ') ', {num(3, 4)}, '-', {num(4, 5)})", f"concat_ws('-', {num(3, 3)}, {num(3, 4)}, {num(4, 5)})", f"concat_ws('.', {num(3, 3)}, {num(3, 4)}, {num(4, 5)})", f"concat_ws(' ', {num(3, 3)}, {num(3, 4)}, {num(4, 5)})", f"concat('0044 ', {num(3, 3)}, ' ', {num(4, 4)}, ' ', {num(3, 5)})"]
    group = lambda k: f"hex(pmod(xxhash64(id, {k}), 65536))"
    pair = lambda k: f"lpad(hex(pmod(xxhash64(id, {k}), 256)), 2, '0')"
    m = (
        f"case kind when 0 then if(not truth, concat({pick(('noon', 'sold', 'look', 'stop', 'x'), 6)}, {pick((' (at) ', '[at]', ' [at] '), 7)}, {pick(('10.30', '3.50', '7.5', 'all.2', '99.9'), 8)}), concat({pick(('jo.doe', 'anna', 'sales99', 'm_k'), 6)}, {pick((' (at) ', '[at]', ' [at] '), 7)}, {pick(('mail', 'example', 'corp-x'), 8)}, {pick(('.com', ' (dot) org', '[dot]net'), 9)}))"
        f" when 1 then if(truth, concat_ws(':', {', '.join(group(20 + i) for i in range(8))}), concat_ws(':', {', '.join(pair(20 + i) for i in range(6))}))"
        f" when 2 then if(style = 0, {grouped}, c) else case style {' '.join(f'when {i} then {x}' for i, x in enumerate(phone))} end end"
    )
    before = f"if(truth and {h(10)} < 500000, element_at(array('please e-mail ', 'client ip ', 'my card is ', 'call me: '), kind + 1), if(not truth and {h(11)} < 700000, {pick(('order ', 'invoice no. ', 'ISBN ', 'token = ', 'serial '), 12)}, {pick(('and then ', 'it was ', 'over the '), 13)}))"
    d = spark.range(TRAINING).selectExpr("id", "int(id % 4) as kind", f"{h(14)} < 500000 as truth", f"int({h(15)} % 5) as style", f"{h(16)} % 5 = 0 as fold")
    d = d.withColumn("c", F.expr(f"if(truth, {valid}, concat({num(2, 17)}, {num(14, 18)}))"))
    return d.selectExpr("kind", f"{m} as m", f"{before} as before", "' in the' as after", f"int(truth or kind = 2 and {h(11)} >= 700000 and {_luhn('c')}) as label", "fold")  # by chance a card, and nothing against it


class Trees:
    """Boosted regression trees for log odds, over whole-number features, as an SQL expression."""

    def __init__(self, rows: list[tuple[tuple[int, ...], float, float]], names: list[str]):
        """rows: (features, weight of positives, weight of negatives)."""
        self.names, self.trees = names, []
        p, n = sum(r[1] for r in rows), sum(r[2] for r in rows)
        self.base = math.log((p + 1) / (n + 1))
        score = [self.base] * len(rows)
        for _ in range(ROUNDS):
            odds = [1 / (1 + math.exp(-s)) for s in score]
            g = [r[1] - q * (r[1] + r[2]) for r, q in zip(rows, odds)]
            w = [q * (1 - q) * (r[1] + r[2]) for r, q in zip(rows, odds)]
            tree = self._grow(rows, g, w, list(range(len(rows))), DEPTH)
            self.trees.append(tree)
            score = [s + self._value(tree, r[0]) for s, r in zip(score, rows)]

    def _grow(self, rows, g, w, at, depth):
        total, weight = sum(g[i] for i in at), sum(w[i] for i in at)
        leaf = RATE * total / (weight + 1)
        if not depth:
            return leaf
        best = None
        for f in range(len(self.names)):
            by: dict[int, list[float]] = {}
            for i in at:
                x = by.setdefault(rows[i][0][f], [0.0, 0.0])
                x[0] += g[i]
                x[1] += w[i]
            a = b = 0.0
            for v in sorted(by)[:-1]:
                a += by[v][0]
                b += by[v][1]
                gain = a * a / (b + 1) + (total - a) ** 2 / (weight - b + 1) - total**2 / (weight + 1)
                if gain > 1e-6 and (best is None or gain > best[0]):
                    best = (gain, f, v)
        if best is None:
            return leaf
        _, f, v = best
        return f, v, self._grow(rows, g, w, [i for i in at if rows[i][0][f] <= v], depth - 1), self._grow(rows, g, w, [i for i in at if rows[i][0][f] > v], depth - 1)

    def _value(self, tree, x) -> float:
        while isinstance(tree, tuple):
            tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
        return tree

    def score(self, x: tuple[int, ...]) -> float:
        return self.base + sum(self._value(t, x) for t in self.trees)

    def sql(self, row: str) -> str:
        """The score of a struct of features."""

        def case(t) -> str:
            return f"(case when {row}.`{self.names[t[0]]}` <= {t[1]} then {case(t[2])} else {case(t[3])} end)" if isinstance(t, tuple) else f"{t!r}D"

        return f"({self.base!r}D + " + " + ".join(map(case, self.trees)) + ")"


def _sources(docs: DataFrame, text_col: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with what the patterns are matched on, and the columns' names by purpose."""
    names = dict(zip("xtgec", fresh(docs, "umbra_x", "umbra_t", "umbra_g", "umbra_e", "umbra_c")))
    x, t, g, e, c = names.values()
    d = docs.withColumn(x, F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    own = " or ".join(f"contains({x}, {_literal(y)})" for y in (_SEP, _DOT))
    d = d.withColumn(t, F.expr(f"if({own}, translate({x}, {_literal(_SEP + _DOT)}, {_literal(_OTHER * 2)}), {x})"))
    d = d.withColumn(g, F.expr(_gated(_GATE["card"], names)))
    d = d.withColumn(e, F.expr(f"if({_gated(_GATE['email'], names)}, regexp_replace({t}, {_literal(r'(?<=[A-Za-z0-9-])[.](?=[A-Za-z0-9-])')}, {_literal(_DOT)}), '')"))
    d = d.withColumn(c, F.expr(f"if({g}, regexp_replace({t}, {_literal(r'(?<=[0-9])[ -](?=[0-9])')}, {_literal(_SEP)}), '')"))
    return d, names


def _gated(test: str, names: dict[str, str]) -> str:
    return names["g"] if test == "gc" else test.replace("t rlike", names["t"] + " rlike").replace("(t,", f"({names['t']},")


def _matched(kind: str, names: dict[str, str]) -> str:
    """SQL: (start, end, m) of a base pattern's matches, before its check."""
    source = {"email": names["e"], "ip": names["t"], "card": names["c"], "phone": names["t"]}[kind]
    test = names["g"] if kind == "card" else _gated(_GATE[kind], names)
    return f"if({test}, {_spans(source, _BASE[kind])}, cast(array() as array<struct<start: int, end: int, m: string>>))"


_CANDIDATE = "cast(array() as array<struct<kind: int, start: int, end: int, m: string, before: string, after: string>>)"


def _piece(start: str, length: str) -> str:
    """SQL: `length` characters (at most PIECE) from `start` of the text whose pieces are w: a substring of the text
    itself would count from its beginning each time."""
    return f"substring(concat(coalesce(get(w, ({start}) div {PIECE}), ''), coalesce(get(w, ({start}) div {PIECE} + 1), '')), ({start}) % {PIECE} + 1, {length})"


def _with_context(i: int, spans: str, names: dict[str, str], m: str = "x.m") -> str:
    context = f"'before', {_piece(f'greatest(0, x.start - {CONTEXT})', f'least(x.start, {CONTEXT})')}, 'after', {_piece('x.end', '1')}"
    found = f"transform(y, x -> named_struct('kind', {i}, 'start', x.start, 'end', x.end, 'm', {m}, {context}))"
    pieces = f"regexp_extract_all({names['t']}, '(?s).{{1,{PIECE}}}', 0)"
    return f"transform(array({spans}), y -> if(size(y) = 0, {_CANDIDATE}, transform(array({pieces}), w -> {found})[0]))[0]"


def _proposed(names: dict[str, str]) -> str:
    """SQL: the further generators' candidates."""
    found = [f"if({_gated(g, names)}, {_with_context(KINDS.index(k), _spans(names['t'], p), names)}, {_CANDIDATE})" for (k, p), g in zip(_MORE, _MORE_GATE)]
    return f"concat({', '.join(found)})"


def _of_corpus(docs: DataFrame, text_col: str) -> DataFrame:
    """Candidates of a bounded sample of documents: kind, m, before, after, label, fold."""
    n = docs.count()
    share = min(1 << 30, -(-(SAMPLE << 30) // max(1, n)))
    d = docs.select(F.col(f"`{text_col}`").alias("text")).where(F.col("text").isNotNull()).where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share)
    d, names = _sources(d, "text")
    for i, k in enumerate(KINDS):
        d = d.withColumn(f"base_{k}", F.expr(f"transform({_matched(k, names)}, x -> named_struct('start', x.start, 'end', x.end, 'm', x.m, 'ok', {_OK[k]}))"))
    whole = {"card": _piece("x.start", "x.end - x.start"), "email": f"translate(x.m, {_literal(_DOT)}, '.')"}
    own = "concat(" + ", ".join(_with_context(i, f"base_{k}", names, whole.get(k, "x.m")) for i, k in enumerate(KINDS)) + ")"
    d = d.withColumn("right", F.expr("array(" + ", ".join(f"transform(filter(base_{k}, b -> b.ok), b -> named_struct('start', b.start, 'end', b.end))" for k in KINDS) + ")"))
    both = F.expr(f"concat(transform({own}, x -> named_struct('c', x, 'checked', true)), transform({_proposed(names)}, x -> named_struct('c', x, 'checked', false)))")
    d = d.select(F.xxhash64("text").alias("th"), "right", F.explode(both).alias("both")).select("th", "right", "both.c", "both.checked")
    near = "exists(element_at(right, c.kind + 1), b -> b.start < c.end and c.start < b.end)"
    d = d.withColumn("x", F.col("c")).withColumn("label", F.expr(f"int(if(c.kind = {KINDS.index('card')}, {_OK['card']}, {near}))"))
    d = d.where(f"checked or label = 1 or c.kind = {KINDS.index('card')}")
    return d.selectExpr("c.kind", "c.m", "c.before", "c.after", "label", "pmod(th, 5) = 0 as fold")


def _counted(candidates: DataFrame) -> list[tuple[bool, tuple[int, ...], float, float]]:
    """(held out, features, positives, negatives) by distinct vector."""
    d = candidates.selectExpr(*[f"{x} as `{k}`" for k, x in FEATURES.items()], "label", "fold")
    counts = d.groupBy(*[f"`{k}`" for k in FEATURES], "fold").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n")).collect()
    k = len(FEATURES)
    return sorted((bool(r[k]), tuple(r[:k]), float(r["p"]), float(r["n"])) for r in counts)


def _platt(held: list[tuple[float, float, float]]) -> tuple[float, float]:
    """(a, b) of the logistic curve 1 / (1 + exp(-(a * score + b))) through (score, positives, negatives),
    with Platt's smoothed targets, by Newton's steps."""
    positives, negatives = sum(p for _, p, _ in held), sum(n for _, _, n in held)
    high, low = (positives + 1) / (positives + 2), 1 / (negatives + 2)
    a, b = 1.0, 0.0
    for _ in range(50):
        ga = gb = haa = hab = hbb = 0.0
        for s, p, n in held:
            q = 1 / (1 + math.exp(-max(-500.0, min(500.0, a * s + b))))
            g, w = p * high + n * low - q * (p + n), q * (1 - q) * (p + n)
            ga, gb, haa, hab, hbb = ga + g * s, gb + g, haa + w * s * s, hab + w * s, hbb + w
        haa, hbb = haa + 1e-3, hbb + 1e-3
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a + max(-1.0, min(1.0, da)), b + max(-1.0, min(1.0, db))
        if abs(da) + abs(db) < 1e-9:
            break
    return a, b


class Model:
    """Trees, each kind's threshold (infinite where no score is good enough) and what they reach: of held-out
    candidates, by kind, (positives, selected, selected positives)."""

    def __init__(self, rows: list[tuple[bool, tuple[int, ...], float, float]]):
        self.trees = Trees([r[1:] for r in rows if not r[0]], list(FEATURES))
        self.thresholds, self.reached = [], []
        for kind in range(len(KINDS)):
            held = sorted(((self.trees.score(x), p, n) for fold, x, p, n in rows if fold and x[0] == kind), reverse=True)
            a, b = _platt(held) if held else (1.0, 0.0)
            best, right, wrong = math.inf, 0.0, 0.0
            for i, (s, p, n) in enumerate(held):
                right, wrong = right + p, wrong + n
                last = i + 1 == len(held) or held[i + 1][0] < s
                if last and right >= PRECISION * (right + wrong) and 1 / (1 + math.exp(-(a * s + b))) >= PRECISION:
                    best = s
            self.thresholds.append(best)
            chosen = [(p, n) for s, p, n in held if s >= best]
            self.reached.append((sum(p for _, p, _ in held), sum(p + n for p, n in chosen), sum(p for p, _ in chosen)))


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    """Learns from candidates of docs and made-up ones."""
    return Model(_counted(_training(docs.sparkSession).unionByName(_of_corpus(docs, text_col))))


def measured(model: Model) -> list[tuple[str, float, float]]:
    """(kind, precision, recall) on held-out candidates; 1 where nothing is selected, or there is nothing to find."""
    return [(k, right / chosen if chosen else 1.0, right / all_ if all_ else 1.0) for k, (all_, chosen, right) in zip(KINDS, model.reached)]


def _apart(more: str, base: str) -> str:
    """SQL: candidates that overlap no base span.  Base spans in the order of their starts are looked at in
    stretches of FEW, of which only those that reach a candidate are entered."""
    stretches = f"transform(sequence(0, (size(z) - 1) div {FEW}), i -> slice(z, i * {FEW} + 1, {FEW}))"
    bounds = "transform(s, b -> named_struct('lo', b[0].start, 'hi', array_max(transform(b, y -> y.end)), 'spans', b))"
    z = f"array_sort(transform({base}, b -> named_struct('start', b.start, 'end', b.end)))"
    far = "filter({more}, x -> not exists(w, b -> b.lo < x.end and x.start < b.hi and exists(b.spans, y -> y.start < x.end and x.start < y.end)))".format(more=more)
    return f"if(size({base}) = 0 or size({more}) = 0, {more}, transform(array({z}), z -> transform(array({stretches}), s -> transform(array({bounds}), w -> {far})[0])[0])[0])"


def _best(more: str) -> str:
    """SQL: of candidates (start, end, kind, score), cluster by cluster of those that overlap in a chain, the
    best-scored one, then the best of those that don't overlap it, and so on; equal scores by start, end, kind."""
    kept = "array<struct<start: int, end: int, kind: int, score: double>>"
    # cuts: where, in the order of starts, a candidate begins that none before it reaches
    cuts = (
        "aggregate(transform(z, (x, i) -> named_struct('i', i, 'x', x)), named_struct('end', -1, 'at', cast(array() as array<int>)),"
        " (a, y) -> named_struct('end', greatest(a.end, y.x.end), 'at', if(y.x.start >= a.end, array_append(a.at, y.i), a.at)), a -> array_append(a.at, size(z)))"
    )
    ranked = "array_sort(c, (p, q) -> case when p.score > q.score then -1 when p.score < q.score then 1 when p.start <> q.start then p.start - q.start when p.end <> q.end then p.end - q.end else p.kind - q.kind end)"
    greedy = f"aggregate({ranked}, cast(array() as {kept}), (a, x) -> if(exists(a, b -> b.start < x.end and x.start < b.end), a, array_append(a, x)))"
    clusters = f"transform(slice(k, 1, size(k) - 1), (from, i) -> transform(array(slice(z, from + 1, k[i + 1] - from)), c -> if(size(c) = 1, c, {greedy}))[0])"
    return f"if(size({more}) = 0, cast(array() as {kept}), transform(array(array_sort({more})), z -> transform(array({cuts}), k -> flatten({clusters}))[0])[0])"


COLUMNS = ("umbra_text", "umbra_base", "umbra_spans")


def find(docs: DataFrame, text_col: str = "text", model: Model | None = None, columns: tuple[str, str, str] = COLUMNS) -> DataFrame:
    """docs with three more columns, named by `columns` (such columns of docs give way): the text (never
    null), base spans and all spans, arrays of (kind, start, end) ordered by kind and start; all spans also
    hold what the trees select."""
    model = model or fit(docs, text_col)
    docs = docs.drop(*(c for c in columns if c != text_col))
    text, base, spans = columns
    d, names = _sources(docs, text_col)
    more, taken = fresh(d, "umbra_more", "umbra_taken")
    empty = "cast(array() as array<struct<kind: int, start: int, end: int>>)"
    found = [f"transform(filter({_matched(k, names)}, x -> {_OK[k]}), x -> named_struct('kind', {i}, 'start', x.start, 'end', x.end))" for i, k in enumerate(KINDS)]
    d = d.withColumn(base, F.expr(f"concat({empty}, {', '.join(found)})"))
    d = d.withColumn(more, F.expr(_proposed(names)))
    d = d.withColumn(more, F.expr(_apart(more, base)))
    # features stand under x.: the names kind, m, before, after become x.kind and so on
    feature = lambda e: re.sub(r"(?<![\w'`.])(kind|m|before|after)(?![\w(`'])", r"x.\1", e)
    vector = ", ".join(f"'{k}', {feature(e)}" for k, e in FEATURES.items())
    d = d.withColumn(more, F.expr(f"transform({more}, x -> named_struct('start', x.start, 'end', x.end, 'f', named_struct({vector})))"))
    limit = "element_at(array(" + ", ".join("double('infinity')" if x == math.inf else f"{x!r}D" for x in model.thresholds) + "), x.kind + 1)"
    d = d.withColumn(more, F.expr(f"filter(transform({more}, x -> named_struct('start', x.start, 'end', x.end, 'kind', x.f.kind, 'score', {model.trees.sql('x.f')})), x -> x.score >= {limit})"))
    chosen = _best(more)
    d = d.withColumn(spans, F.expr(f"array_sort(concat({base}, transform({chosen}, x -> named_struct('kind', x.kind, 'start', x.start, 'end', x.end))))"))
    return d.withColumn(base, F.array_sort(base)).withColumn(text, F.col(names["x"])).drop(*names.values(), more, taken)


def as_text(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', element_at(array({', '.join(map(_literal, KINDS))}), x.kind + 1), x.start, x.end)), ',')")


def redact(docs: DataFrame, text_col: str = "text", model: Model | None = None) -> DataFrame:
    """docs with [EMAIL], [IP], [CARD] or [PHONE] in place of each span; of overlapping ones the one that
    starts first names them all.  Null texts stay null."""
    text, base, spans = fresh(docs, *COLUMNS)
    d = find(docs, text_col, model, (text, base, spans))
    merged = (
        f"aggregate(array_sort(transform({spans}, x -> named_struct('start', x.start, 'end', x.end, 'kind', x.kind))),"
        " cast(array() as array<struct<start: int, end: int, kind: int>>), (a, x) ->"
        " if(size(a) = 0 or a[size(a) - 1].end <= x.start, array_append(a, x),"
        " array_append(slice(a, 1, size(a) - 1), named_struct('start', a[size(a) - 1].start, 'end', greatest(a[size(a) - 1].end, x.end), 'kind', a[size(a) - 1].kind))))"
    )
    names = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    # what lies before each span: from the end of the one before it
    pieces = (
        f"array_join(transform(array({merged}), a -> concat(transform(a, (x, i) -> concat(substring({text}, if(i = 0, 0, a[i - 1].end) + 1, x.start - if(i = 0, 0, a[i - 1].end)), element_at(array({names}), x.kind + 1))),"
        f" array(substring({text}, a[size(a) - 1].end + 1))))[0], '')"
    )
    return d.withColumn(text_col, F.when(F.size(spans) > 0, F.expr(pieces)).otherwise(F.col(f"`{text_col}`"))).drop(text, base, spans)
