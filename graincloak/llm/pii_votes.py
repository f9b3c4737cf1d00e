"""Personal data by weak supervision: labelers vote on spans, EM weighs the labelers, a span classifier decides.

Candidates are the strict matches of four kinds (email, ip, card, phone: the base, always kept) and loose ones (addresses
with spelt-out signs, phone numbers without a country code, card numbers that fail a check). On each of them, strict or
loose alike, vote
* the regex labeler, on the form: a well-formed network address, a right check digit, a country code or like separators;
* the gazetteer labeler, on lists: domain endings, card issuers, calling and area codes, special-use networks;
* the context labeler: words for or against in the 40 characters before.
A labeler says yes, no, or nothing where it does not know.

Votes are counted per pattern (a few hundred patterns at most, whatever the input). Expectation-maximisation over these
counts estimates each labeler's reliability (its votes given the truth; all begin alike, as somewhat better than chance,
which weighs as much as STRENGTH candidates) and each pattern's posterior. A naive Bayes span
classifier (kind, votes, length class, whether the span stands free) is trained on the posteriors and adds the loose spans
that it accepts. All work on rows is done by Spark's own functions.

Defined results: null texts are empty; a null id and repeated rows are carried along; documents without candidates have
empty spans; an empty table gives none; extra columns are dropped.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native_spans import joined, none, spans
from .textcols import saved

KINDS = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"
STRICT = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[(\[]dot[)\]])\x20?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9])",
}
FORM = {
    "email": r"@|[(\[]dot[)\]]",
    "ip": r"^(?:0|[1-9][0-9]*)(?:\.(?:0|[1-9][0-9]*)){3}$",
    "phone": r"^\+|^\([0-9]{3}\)\x20|^[0-9]{3}([\x20.-])[0-9]{3}\1",
}
GAZETTEER = {
    "email": r"\.(?:com|org|net|edu|gov|io|de|fr|es|uk|info|eu)$",
    "ip": r"^(?!(?:0|10|127|22[4-9]|2[3-5][0-9])\.|169\.254\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.)",
    "card": r"^(?:4|5[1-5]|3[47]|6011|65)",
    "phone": r"^\+(?:1|30|31|32|33|34|39|4[0-9]|5[1-8]|6[0-6]|7|8[146]|9[0-5])|^\(?[2-9][0-8][0-9]\)?[\x20.-][2-9][0-9]{2}",
}
FOR = {
    "email": r"e-?mail|contact|write|reach|correo|courriel",
    "ip": r"\bip\b|host|server|address|adresse",
    "card": r"card|visa|credit|amex|karte|carte|tarjeta",
    "phone": r"phone|call|\btel|mobile|fax|telefon",
}
AGAINST = r"version|isbn|chapter|figure|\bfig\.|serial|order|invoice|part no"
START = {("-1", 0): 0.2, ("-1", 1): 0.2, ("0", 0): 0.56, ("0", 1): 0.24, ("1", 0): 0.24, ("1", 1): 0.56}  # a vote, given the truth
STRENGTH = 10


def luhn(digits: Column) -> Column:
    def add(s, i):
        x = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return s + F.when(i % 2 == 0, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def valid(kind: str):
    digits = lambda x: F.regexp_replace(x, r"[^0-9]++", "")
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return {
        "email": lambda x: F.lit(True),
        "ip": lambda x: F.rlike(x, F.lit(rf"^{part}(?:\.{part}){{3}}$")),
        "card": lambda x: F.length(digits(x)).between(13, 19) & luhn(digits(x)),
        "phone": lambda x: F.length(digits(x)).between(9, 15),
    }[kind]


def strict(text: Column) -> dict[str, Column]:
    maybe = {"email": F.contains(text, F.lit("@")), "ip": F.rlike(text, F.lit(r"[0-9]\.[0-9]")), "card": F.rlike(text, F.lit(r"[0-9](?:[\x20-]?[0-9]){12}")), "phone": F.contains(text, F.lit("+"))}
    return {k: spans(text, k, STRICT[k], valid(k), maybe[k]) for k in KINDS}


def loose(text: Column) -> list[Column]:
    low = F.lower(text)
    maybe = {"email": F.contains(low, F.lit("at)")) | F.contains(low, F.lit("at]")), "phone": F.rlike(text, F.lit(r"[0-9]{3}[\x20.-][0-9]{4}")), "card": F.rlike(text, F.lit(r"[0-9](?:[\x20-]?[0-9]){12}"))}
    return [spans(text, k, p, lambda x: F.lit(True), maybe[k]) for k, p in LOOSE.items()]


def patterns(text: Column, found: Column) -> Column:
    """Spans with what the labelers and the classifier see: kind, three votes, length class, whether it stands free."""

    def one(x):
        pick = lambda table: F.coalesce(*(F.when(x["kind"] == k, F.lit(p)) for k, p in table.items()))
        before = F.lower(F.substring(text, F.greatest(x["start"] - 39, F.lit(1)).cast("int"), F.least(x["start"], F.lit(40)).cast("int")))
        context = F.when(F.rlike(before, pick(FOR)), 1).when(F.rlike(before, F.lit(AGAINST)), 0).otherwise(-1)
        form = F.when(x["kind"] == "card", luhn(F.regexp_replace(x["value"], r"[^0-9]++", ""))).otherwise(F.rlike(x["value"], pick(FORM)))
        form, listed = (F.when(yes, 1).when(x["kind"] == "email", -1).otherwise(0) for yes in (form, F.rlike(x["value"], pick(GAZETTEER))))
        free = (F.length(before) == 0) | F.rlike(before, F.lit(r"[\s,;:(\[\"']$"))
        size = F.least(F.floor(F.length(x["value"]) / 8), F.lit(5)).cast("int")
        key = F.concat_ws("|", x["kind"], form.cast("string"), listed.cast("string"), context.cast("string"), size.cast("string"), free.cast("int").cast("string"))
        return F.struct(*(x[c].alias(c) for c in ("kind", "start", "end", "value")), key.alias("pattern"))

    return F.transform(found, one)


def fit_votes(counts: dict[str, int], rounds: int = 30) -> dict[str, float]:
    """EM over vote patterns (Dawid-Skene with two classes and a prior for each kind): the posterior of each pattern."""
    rows = [(p.split("|"), n) for p, n in counts.items()]
    kinds = {r[0] for r, _ in rows}
    prior = dict.fromkeys(kinds, 0.5)
    told = {(j, v, y): p for j in range(3) for (v, y), p in START.items()}
    post: dict[str, float] = {}
    for _ in range(rounds):
        for r, _ in rows:
            yes, no = prior[r[0]], 1 - prior[r[0]]
            for j in range(3):
                yes, no = yes * told[j, r[1 + j], 1], no * told[j, r[1 + j], 0]
            post["|".join(r)] = yes / (yes + no)
        for k in kinds:
            mine = [(post["|".join(r)], n) for r, n in rows if r[0] == k]
            prior[k] = (1 + sum(p * n for p, n in mine)) / (2 + sum(n for _, n in mine))
        for j in range(3):
            for y in (0, 1):
                mass = {v: STRENGTH * START[v, y] for v in ("-1", "0", "1")}
                for r, n in rows:
                    mass[r[1 + j]] += n * (post["|".join(r)] if y else 1 - post["|".join(r)])
                for v, m in mass.items():
                    told[j, v, y] = m / sum(mass.values())
    return post


def fit_spans(counts: dict[str, int], post: dict[str, float]) -> dict[str, float]:
    """A naive Bayes classifier of spans trained on the posteriors: its probability for each pattern."""
    seen: dict[tuple, float] = {}
    total = [1.0, 1.0]
    for p, n in counts.items():
        for y, w in ((1, post[p] * n), (0, (1 - post[p]) * n)):
            total[y] += w
            for j, v in enumerate(p.split("|")):
                seen[j, v, y] = seen.get((j, v, y), 0.0) + w
    out = {}
    for p in counts:
        odds = math.log(total[1] / total[0])
        for j, v in enumerate(p.split("|")):
            odds += math.log((seen[j, v, 1] + 1) / (total[1] + 6)) - math.log((seen[j, v, 0] + 1) / (total[0] + 6))
        out[p] = 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))
    return out


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """id, base (strict spans) and added (loose spans that the classifier accepts, clear of base spans) of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    apart = lambda x, others: ~F.exists(others, lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"]))
    base = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.concat(*strict(text).values()).alias("base"), F.concat(*loose(text)).alias("rest"))
    rest = F.when(F.size("rest") > 0, F.filter("rest", lambda x: apart(x, F.col("base")))).otherwise(none())
    seen = base.select("id", patterns(F.col("text"), F.col("base")).alias("base"), patterns(F.col("text"), rest).alias("rest"))
    seen = saved(seen)
    rows = seen.select(F.explode(F.concat("base", "rest")).alias("x")).groupBy("x.pattern").count().collect()  # a few hundred patterns
    counts = {r["pattern"]: r["count"] for r in rows}
    chance = fit_spans(counts, fit_votes(counts))
    good = [p for p, c in chance.items() if c >= least]
    plain = lambda c: F.transform(c, lambda x: F.struct(*(x[k].alias(k) for k in ("kind", "start", "end", "value"))))
    added = F.filter("rest", lambda x: x["pattern"].isin(good)) if good else F.filter("rest", lambda x: F.lit(False))
    return seen.select(F.col("id").alias(id_col), plain(F.col("base")).alias("base"), plain(added).alias("added"))


def digest(found: DataFrame) -> list[Column]:
    rank = F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)))
    key = lambda x: F.struct(rank[x["kind"]].alias("rank"), *(x[c].alias(c) for c in ("start", "end", "kind")))
    every = F.array_sort(F.transform(F.concat("base", "added"), key))
    of = lambda kind: F.filter("base", lambda x: x["kind"] == kind)
    n = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return [*n, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(every).alias("spans")]
