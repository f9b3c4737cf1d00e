"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and works on all that its predecessor kept.

quality_rules and decontamination drop documents, near_duplicates keeps one document of each group, secret_scan puts a
mark in place of every secret, packing returns the packed pieces of what is left. Parameters are those that the stages
below name; near duplicates are texts whose sets of five-word shingles have a similarity of 0.8 or more. A document with
the smallest id of its group stays. Rows that repeat an id are one document: they share a group, one row stays if the id does,
and all go if any of them is a copy of a document with a smaller id, different texts too. Documents without an id are never
near duplicates.
"""

import public_tokenizers
from pyspark.sql import Window
from pyspark.sql import functions as F

from graincloak.llm.bestfit_pack import best_fit_pack
from graincloak.llm.bm25_decontam import decontaminate
from graincloak.llm.ngram_join import jaccard_components
from graincloak.llm.repetition_rules import repetition_rules
from graincloak.llm.textcols import saved, small
from graincloak.llm.trigram_secrets import redact_secrets, scan_secrets

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark, docs, sf_dir):
    return repetition_rules(docs.select(*COLUMNS)).filter("kept").select(*COLUMNS)


def near_duplicates(spark, docs, sf_dir):
    groups = saved(jaccard_components(docs.select("doc_id", "text"), n=5, num=80, den=100))
    copies = groups.filter("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(small(saved(copies)), "doc_id", "left_anti").select(*COLUMNS)
    again = groups.filter("doc_id IS NOT NULL AND n_shingles > 0").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    again = saved(again)
    if again.isEmpty():
        return kept
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    some = kept.join(small(again), "doc_id", "left_semi").withColumn("rank", F.row_number().over(first)).filter("rank = 1")
    return kept.join(small(again), "doc_id", "left_anti").select(*COLUMNS).unionByName(some.select(*COLUMNS))


def decontamination(spark, docs, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs.select(*COLUMNS), items).filter(F.size("matches") == 0).select(*COLUMNS)


def secret_scan(spark, docs, sf_dir):
    clean = redact_secrets(scan_secrets(docs.select(*COLUMNS)))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark, docs, sf_dir):
    return best_fit_pack(docs, public_tokenizers.path("word_bpe_49k.json"), size=2048, end_id=0)


STAGES = [(f.__name__, f) for f in (quality_rules, near_duplicates, decontamination, secret_scan, packing)]
ORACLE_SQL = None  # tokenisation and suffix arrays have no SQL form; tests compare with a brute-force version


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs)
    return docs
