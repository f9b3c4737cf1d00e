"""Secret scans over a trigram inverted index.

From each rule's regular expression a Boolean query is derived: alternatives (OR) of mandatory trigrams (AND), of each
alternative at most FEW, those of the least common letters. One pass over a text (lower-cased) finds which of the asked
trigrams it has; the index holds a posting (text, trigram) for each. A rule's candidates come from intersecting postings, as
sets of bits per text. They are joined back to the documents, without moving a text as long as they are few enough to
broadcast. Candidates, and for rules without mandatory trigrams all documents, are verified by the expression itself. Only
Spark's own functions run.

Base rules: assign, access, hex. Further rules add spans: private key headers, and tokens of known services.

Defined results: null texts are empty; a null id, repeated rows and extra columns are carried along, but for a column
``secrets``, which the result replaces; documents without secrets have empty spans.
"""

import re
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native_spans import fresh, joined, redacted, spans
from .textcols import saved, small


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: str = ""  # the verified part, as an expression over the match; empty: all of it
    least: int = 0

    def ok(self, match: Column) -> Column:
        return F.length(F.regexp_extract(match, self.group, 1) if self.group else match) >= self.least


KEYWORD = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?"
BASE = (
    Rule("assign", KEYWORD + r"[A-Za-z0-9+/_.=-]++", "^" + KEYWORD + r"([A-Za-z0-9+/_.=-]++)", 6),
    Rule("access", r"AKIA[A-Z0-9]++", "", 20),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}+", "", 24),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]++", "", 40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]++", "", 20),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++", "", 40),
)
RULES = BASE + MORE
MOST = 64
FEW = 4
COMMON = set(" -aeinorst")


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives of mandatory trigrams, in lower case; empty if the expression may match without any."""
    State = tuple[frozenset, str]  # trigrams so far, the literal run that ends here

    def add(states: set[State], chars: list[str]) -> set[State]:
        out = set()
        for got, tail in states:
            for c in chars:
                run = (tail + c.lower())[-3:]
                out.add((got | {run} if len(run) == 3 else got, run[-2:]))
        return out

    def cut(states: set[State]) -> set[State]:
        return {(got, "") for got, _ in states}

    def walk(states: set[State], nodes) -> set[State]:
        for op, arg in nodes:
            name = str(op)
            if name == "LITERAL":
                states = add(states, [chr(arg)])
            elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg) and len(arg) <= 8:
                states = add(states, [chr(c) for _, c in arg])
            elif name == "BRANCH":
                states = set().union(*(walk(states, x) for x in arg[1]))
            elif name == "SUBPATTERN":
                states = walk(states, arg[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                low, high, body = arg
                if (low, int(high)) == (0, 1):
                    states = states | walk(states, body)
                else:
                    for _ in range(min(low, 3)):
                        states = walk(states, body)
                    if low > 3 or low != high:
                        states = cut(states)
            elif name == "ATOMIC_GROUP":
                states = walk(states, arg)
            elif name not in ("AT", "ASSERT", "ASSERT_NOT"):
                states = cut(states)
            if len(states) > MOST:
                states = cut(states)
            if len(states) > MOST:  # still too many: keep what all of them need
                states = {(frozenset.intersection(*(g for g, _ in states)), "")}
        return states

    found = {got for got, _ in walk({(frozenset(), "")}, parser.parse(pattern))}
    if any(not g for g in found):
        return []
    return sorted((g for g in found if not any(h < g for h in found)), key=sorted)


def chosen(clause: frozenset[str]) -> list[str]:
    """The trigrams of an alternative that are looked up."""
    return sorted(clause, key=lambda t: (sum(c in COMMON for c in t), t))[:FEW]


def any_of(words: list[str]) -> str:
    """An expression for one of ``words`` (of one length) that tries each next character once."""
    by = {}
    for w in words:
        by.setdefault(w[0], []).append(w[1:])
    return "|".join(re.escape(c) + (f"(?:{any_of(rest)})" if rest[0] else "") for c, rest in sorted(by.items()))


def candidates(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """key, rules: the kinds of the rules whose trigram query each text of ``texts`` (key, text) answers; none for others."""
    clauses = [(r.kind, k, chosen(c)) for r in rules for k, c in enumerate(trigram_query(r.pattern))]
    asked = sorted({t for _, _, ts in clauses for t in ts})
    if not asked:
        return texts.select("key", F.array().cast("array<string>").alias("rules")).limit(0)
    starts = "".join(sorted({re.escape(t[0]) for t in asked}))
    pattern = f"(?=[{starts}])(?=({any_of(asked)}))"  # looks ahead, so that trigrams that overlap are all found
    postings = texts.select("key", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(1)))).alias("trigram"))
    entries = [F.struct(F.lit(t).alias("trigram"), F.lit(kind).alias("kind"), F.lit(k).alias("clause"), F.lit(1 << i).alias("bit"), F.lit((1 << len(ts)) - 1).alias("need")) for kind, k, ts in clauses for i, t in enumerate(ts)]
    table = texts.sparkSession.range(1).select(F.inline(F.array(*entries)))  # as long as the rules
    met = postings.join(F.broadcast(table), "trigram").groupBy("key", "kind", "clause").agg(F.bit_or("bit").alias("got"), F.first("need").alias("need")).filter("got = need")
    return met.groupBy("key").agg(F.collect_set("kind").alias("rules"))


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """``docs`` with a column secrets: spans (kind, start, end, value) by start, then in the rules' order."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    key = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))  # of a text; equal texts share their candidates
    its_key, its_rules = fresh(docs, "text_key"), fresh(docs, "text_rules")
    found = small(saved(candidates(docs.select(key.alias("key"), text.alias("text")), rules)))
    both = docs.withColumn(its_key, key).join(found.withColumnsRenamed({"key": its_key, "rules": its_rules}), its_key, "left")
    scanned = {r.kind: F.lit(True) if not trigram_query(r.pattern) else F.coalesce(F.array_contains(its_rules, r.kind), F.lit(False)) for r in rules}
    columns = [spans(text, r.kind, r.pattern, r.ok, scanned[r.kind]) for r in rules]
    order = F.create_map(*(F.lit(x) for k, r in enumerate(rules) for x in (r.kind, k)))
    rank = lambda x: x["start"] * 100 + order[x["kind"]]
    every = F.array_sort(F.concat(*columns), lambda x, y: F.signum(rank(x) - rank(y)).cast("int"))
    return both.withColumn("secrets", every).drop(its_key, its_rules)


def redact_secrets(scanned: DataFrame, mark: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    return scanned.withColumn(text_col, F.when(F.size("secrets") > 0, redacted(F.col(text_col), F.col("secrets"), mark)).otherwise(F.col(text_col)))


def digest(scanned: DataFrame) -> list[Column]:
    base = [r.kind for r in BASE]
    of = lambda kinds: F.filter("secrets", lambda x: x["kind"].isin(*kinds))
    return [*(F.size(of([k])).cast("long").alias(f"n_{k}") for k in base), F.sha2(joined(of(base)).cast("binary"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans")]
