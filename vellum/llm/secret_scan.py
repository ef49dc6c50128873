"""Secret scanning with a trigram inverted index, in Spark SQL expressions only.

A rule is a regular expression. From its syntax tree a Boolean query over trigrams is derived: every
match must contain one of some strings, and a string all of its trigrams. The index is a table of
postings, one row per (trigram, document) for the trigrams the rules ask for; a document is named by
a 64-bit hash of its id and text (an equal hash of another row only adds a candidate). A conjunction
of a query intersects its trigrams' postings: they are grouped by (document, conjunction), and the
documents that hold all its trigrams remain. The rules with a satisfied conjunction are one bitmap
per candidate document, joined back to the documents, and only those rules' expressions are run. A
rule without mandatory trigrams (a run of hexadecimal digits) scans every document. All texts are
scanned whole. No group holds more rows than the rules have trigrams.

Spans come from built-in functions: matches are wrapped in two control characters, the text is split
at the first, and the lengths of the pieces (in code points) give the places. The two characters are
first replaced by a third of the same length in the searched copy; no rule can match any of them.
Pieces are folded in blocks of ``BLOCK``, so the growing arrays are copied once per block.

Defined cases: null text counts as empty and has no spans; overlapping spans of different kinds are
all listed; repeated rows are scanned each; an empty table gives no rows; other columns pass through
(``doc_id`` may be missing or null).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as C
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_STRINGS = 64  # alternatives followed through the syntax tree
BLOCK = 256  # matches of one text folded at a time
OPEN, CLOSE, OTHER = "\x01", "\x02", "\x03"


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # the group whose length is tested
    least: int = 1  # characters it must have
    any_case: bool = False


# The base rules, then the rules this operator adds.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
    Rule("payment", r"sk_live_[A-Za-z0-9]{16,}"),
)

# A query is a tuple of alternatives, each a frozenset of trigrams that must all occur; None: no filter.
Query = tuple[frozenset, ...] | None


def _strings(tree) -> set[str] | None:
    """All strings the tree can match, or None when they are too many."""
    out = {""}
    for op, arg in tree:
        nxt = _node_strings(op, arg)
        if nxt is None or len(out) * len(nxt) > MAX_STRINGS:
            return None
        out = {a + b for a in out for b in nxt}
    return out


def _node_strings(op, arg) -> set[str] | None:
    if op is C.LITERAL:
        return {chr(arg)}
    if op is C.IN and all(o is C.LITERAL for o, _ in arg):
        return {chr(a) for _, a in arg}
    if op is C.SUBPATTERN:
        return _strings(arg[3])
    if op is C.BRANCH:
        parts = [_strings(t) for t in arg[1]]
        return None if None in parts else set().union(*parts)
    if op is C.MAX_REPEAT and arg[1] != C.MAXREPEAT and arg[1] <= 4:
        one = _strings(arg[2])
        if one is None or sum(len(one) ** k for k in range(arg[0], arg[1] + 1)) > MAX_STRINGS:
            return None
        out, power = set(), {""}
        for k in range(arg[1] + 1):
            if k >= arg[0]:
                out |= power
            power = {a + b for a in power for b in one}
        return out
    return None


def _all_of(strings: set[str]) -> Query:
    """The query of "one of these strings occurs"; None when one is too short to have a trigram."""
    if any(len(s) < 3 for s in strings):
        return None
    sets = {frozenset(s[i: i + 3] for i in range(len(s) - 2)) for s in strings}
    return tuple(sorted((s for s in sets if not any(o < s for o in sets)), key=sorted))


def _and(a: Query, b: Query) -> Query:
    """Both must hold; with alternatives on both sides the more selective one stands for both."""
    if a is None or b is None:
        return b if a is None else a
    if len(a) == 1 or len(b) == 1:
        return tuple(x | y for x in a for y in b)
    return a if min(map(len, a)) >= min(map(len, b)) else b


def trigram_query(pattern: str, any_case: bool = False) -> Query:
    """The Boolean trigram query that every match of ``pattern`` satisfies (None: no condition)."""
    def of(tree) -> Query:
        query, held = None, {""}
        for op, arg in tree:
            strings = _node_strings(op, arg)
            if strings is not None and len(held) * len(strings) <= MAX_STRINGS:
                held = {a + b for a in held for b in strings}
                continue
            query, held = _and(query, _all_of(held)), {""}
            if strings is not None:
                held = strings
            elif op is C.SUBPATTERN:
                query = _and(query, of(arg[3]))
            elif op is C.BRANCH:
                parts = [of(t) for t in arg[1]]
                if None not in parts:
                    query = _and(query, tuple(dict.fromkeys(x for p in parts for x in p)))
            elif op is C.MAX_REPEAT and arg[0] > 0:
                query = _and(query, of(arg[2]))
        return _and(query, _all_of(held))

    return of(parser.parse(pattern.lower() if any_case else pattern))


def postings(texts: DataFrame, as_is: list[str], lowered: list[str]) -> DataFrame:
    """The inverted index of ``texts`` (``__doc``, ``__searched``): distinct (gram, low, __doc) rows,
    for grams of the text as it is (``low`` false) and with letters lowered (``low`` true)."""
    def held(text: Column, grams: list[str], low: bool) -> Column:
        listed = F.array(*map(F.lit, grams)).cast("array<string>")
        return F.transform(F.filter(listed, lambda g: F.contains(text, g)),
                           lambda g: F.struct(g.alias("gram"), F.lit(low).alias("low")))

    text = F.col("__searched")
    each = texts.select("__doc", F.explode(F.concat(held(text, as_is, False), held(F.lower(text), lowered, True))).alias("p"))
    return each.select("p.gram", "p.low", "__doc").distinct()


def candidates(index: DataFrame, rules: tuple[Rule, ...], queries: dict[str, Query]) -> DataFrame:
    """(__doc, __rules): a bit per rule of which some conjunction has all its trigrams in the document."""
    needs = [F.struct(F.lit(i).alias("rule"), F.lit(j).alias("part"), F.lit(g).alias("gram"),
                      F.lit(r.any_case).alias("low"), F.lit(len(s)).alias("size"))
             for i, r in enumerate(rules) for j, s in enumerate(queries[r.kind] or ()) for g in sorted(s)]
    wanted = index.sparkSession.range(1).select(F.inline(F.array(*needs)))
    met = (index.join(F.broadcast(wanted), ["gram", "low"])  # one row per trigram of the rules
           .groupBy("__doc", "rule", "part", "size").agg(F.count("*").alias("n")).where("n = size"))
    return met.groupBy("__doc").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("__rules"))


def _blocks(array: Column, first: int) -> Column:
    """``array`` from its place ``first`` (1-based) on, as an array of arrays of ``BLOCK``."""
    rest = F.size(array) - (first - 1)
    starts = F.when(rest > 0, F.sequence(F.lit(0), F.floor((rest - 1) / BLOCK).cast("int"))).otherwise(
        F.array().cast("array<int>"))
    return F.transform(starts, lambda b: F.slice(array, b * BLOCK + first, F.lit(BLOCK)))


_SPANS = "array<struct<start:bigint,end:bigint,kind:string,hit:string>>"


def _marked(text: Column, rule: Rule) -> tuple[Column, str]:
    """The pieces of ``text`` cut before each match, matches closed by a mark; and the expression used."""
    pattern = rule.pattern
    if rule.group == 0 and pattern.endswith("]+") and pattern.count("[") == 1:
        # a literal and a run of one class: matching only long enough runs finds the same spans
        lead = len(pattern[: pattern.index("[")])
        pattern = f"{pattern[:-1]}{{{max(rule.least - lead, 1)},}}"
    if rule.any_case:
        pattern = "(?i)" + pattern
    return F.split(F.regexp_replace(text, pattern, OPEN + "$0" + CLOSE), OPEN), pattern


def _found(pieces: Column, rule: Rule, pattern: str) -> Column:
    """array<struct<start, end, kind, hit>> of the rule's matches that are long enough."""
    kind, empty = F.lit(rule.kind), F.array().cast(_SPANS)

    def step(acc, piece):
        size = (F.instr(piece, CLOSE) - 1).cast("bigint")
        span = F.struct(acc["at"].alias("start"), (acc["at"] + size).alias("end"), kind.alias("kind"),
                        F.substring_index(piece, CLOSE, 1).alias("hit"))
        return F.struct((acc["at"] + F.char_length(piece) - 1).cast("bigint").alias("at"),
                        F.concat(acc["spans"], F.array(span)).alias("spans"))

    def block(part):  # places from the start of the block
        return F.aggregate(part, F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("spans")), step)

    def joined(acc, part):
        moved = F.transform(part["spans"], lambda s: F.struct(
            (acc["at"] + s["start"]).alias("start"), (acc["at"] + s["end"]).alias("end"), s["kind"].alias("kind"),
            s["hit"].alias("hit")))
        return F.struct((acc["at"] + part["at"]).alias("at"), F.concat(acc["spans"], moved).alias("spans"))

    start = F.struct(F.char_length(pieces[0]).cast("bigint").alias("at"), empty.alias("spans"))
    spans = F.aggregate(F.transform(_blocks(pieces, 2), block), start, joined)["spans"]
    if rule.group:
        tested = lambda s: F.char_length(F.regexp_extract(s["hit"], pattern, rule.group))
    else:
        tested = lambda s: s["end"] - s["start"]
    return F.when(F.size(pieces) > 1, F.filter(spans, lambda s: tested(s) >= rule.least)).otherwise(empty)


def with_spans(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED, column: str = "__spans") -> DataFrame:
    """All columns of ``docs`` and the spans of all rules, by start, then in the rules' order."""
    queries = {r.kind: trigram_query(r.pattern, r.any_case) for r in rules}
    vocab = {low: sorted({g for r in rules if r.any_case == low for s in queries[r.kind] or () for g in s})
             for low in (False, True)}
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), OPEN + CLOSE, OTHER + OTHER)
    named = [F.col("doc_id").cast("string")] if "doc_id" in docs.columns else []
    rows = docs.withColumn("__searched", text).withColumn("__doc", F.xxhash64(*named, "__searched"))
    if any(queries.values()):
        index = postings(rows.select("__doc", "__searched"), vocab[False], vocab[True])
        rows = rows.join(candidates(index, rules, queries), "__doc", "left")
    else:
        rows = rows.withColumn("__rules", F.lit(None).cast("long"))
    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)])
    pieces, parts = {}, []
    for i, r in enumerate(rules):
        hit = F.lit(True) if queries[r.kind] is None else F.coalesce(
            F.col("__rules").bitwiseAND(F.lit(1 << i)) != 0, F.lit(False))
        # a rule without candidates searches the empty string
        pieces[f"__pieces_{i}"], pattern = _marked(F.when(hit, F.col("__searched")).otherwise(F.lit("")), r)
        parts.append(_found(F.col(f"__pieces_{i}"), r, pattern))
    ranked = F.transform(F.concat(*parts), lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("rank"),
                                                              s["end"].alias("end"), s["kind"].alias("kind")))
    kept = [F.col(f"`{c}`") for c in docs.columns]
    return rows.withColumns(pieces).select(*kept, F.sort_array(ranked).alias(column))


def span_list(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """``kind:start:end`` of the spans (of some kinds), comma-joined."""
    some = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    rows = with_spans(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("__spans", lambda s: s["kind"] == kind)).cast("long")
    base = tuple(r.kind for r in BASE)
    return rows.select("doc_id", *[count(k).alias("n_" + k) for k in base],
                       F.sha2(span_list(F.col("__spans"), base).cast("binary"), 256).alias("base_sha256"),
                       span_list(F.col("__spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span (overlapping ones as one) replaced by its first kind in brackets;
    ``n_chars``, where present, follows the changed text. Texts without spans stay as they are."""
    rows = with_spans(docs)
    text = F.col("text")
    empty = F.array().cast("array<string>")

    def block(acc, spans):
        # the text up to the block's last span is taken once; its pieces are cut from that
        taken = F.struct(F.substring(text, (acc["at"] + 1).cast("int"), (F.element_at(spans, -1)["start"] - acc["at"]).cast(
            "int")).alias("text"), acc["at"].alias("from"))

        def step(lead):
            def one(a, s):
                before = F.substring(lead["text"], (a["at"] - lead["from"] + 1).cast("int"),
                                     (s["start"] - a["at"]).cast("int"))
                return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(
                    s["start"] >= a["at"], F.concat(a["out"], F.array(before, F.concat(F.lit("["), s["kind"], F.lit("]"))))
                ).otherwise(a["out"]).alias("out"))
            return F.aggregate(spans, F.struct(lead["from"].alias("at"), empty.alias("out")), one)

        # transform over a single element names a value that is used more than once
        part = F.transform(F.array(taken), step)
        return F.transform(part, lambda p: F.struct(p["at"].alias("at"), F.concat(acc["out"], p["out"]).alias("out")))[0]

    start = F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("out"))
    rows = rows.withColumn("__done", F.aggregate(_blocks(F.col("__spans"), 1), start, block))
    changed = F.when(F.size("__spans") > 0, F.concat(F.array_join("__done.out", ""), F.substring(
        text, (F.col("__done.at") + 1).cast("int"), F.char_length(text)))).otherwise(text)
    out = rows.withColumn("__changed", changed)
    cols = {"text": F.col("__changed")}
    if "n_chars" in docs.columns:
        cols["n_chars"] = F.when(F.size("__spans") > 0, F.char_length("__changed").cast(
            docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.select(*[cols[c].alias(c) if c in cols else F.col(f"`{c}`") for c in docs.columns])
