"""Spans of regular-expression matches, by Spark's own functions.

``regexp_replace`` puts a separator (U+FFFF, which no pattern here can match) around every match, ``split`` cuts there, and
a fold over the pieces adds up their lengths in code points; every second piece is a match. Work is linear in the text.
Patterns must use possessive quantifiers for repeated groups, so that Java's matcher neither recurses nor backtracks on
very long runs.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "￿"
OTHER = "\ufffe"  # stands for a text's own separators: no pattern here accepts it either
SPAN = "array<struct<kind:string,start:bigint,end:bigint,value:string>>"


def none() -> Column:
    return F.array().cast(SPAN)


def spans(text: Column, kind: str, pattern: str, ok: Callable[[Column], Column], maybe: Column) -> Column:
    """Matches of ``pattern`` that pass ``ok``, in order, where ``maybe`` holds; code points, end exclusive."""
    clean = F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, OTHER)).otherwise(text)
    cut = F.split(F.regexp_replace(clean, pattern, f"{MARK}$0{MARK}"), MARK, -1)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(False).alias("match"), none().alias("found"))

    def step(s, piece):
        n = F.length(piece).cast("bigint")
        one = F.struct(F.lit(kind).alias("kind"), s["at"].alias("start"), (s["at"] + n).alias("end"), piece.alias("value"))
        return F.struct((s["at"] + n).alias("at"), (~s["match"]).alias("match"), F.when(s["match"] & ok(piece), F.concat(s["found"], F.array(one).cast(SPAN))).otherwise(s["found"]).alias("found"))

    return F.when(maybe, F.aggregate(cut, start, step, lambda s: s["found"])).otherwise(none())


def joined(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, found: Column, mark: str) -> Column:
    """The text with every stretch that spans cover replaced by ``mark``."""
    ordered = F.array_sort(F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(s, x):
        new = x["start"] >= s["at"]
        put = F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit(mark))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(new, put).otherwise(s["out"]).alias("out"))

    return F.aggregate(ordered, start, step, lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.lit(2**31 - 1))))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name
