"""The registered queries of this subpackage."""

import public_tokenizers
from pyspark.sql import functions as F

from . import pii_votes, trigram_secrets
from .bestfit_pack import best_fit_pack
from .bm25_decontam import decontaminate
from .chat_parts import PARTS, digests, format_turns
from .collocations import collocations
from .ftrl_quality import fit, labelled_rows, score
from .hard_negatives import hard_negatives
from .ngram_join import jaccard_components
from .repetition_rules import repetition_rules
from .rlz_dedup import rlz_dedup
from .suffix_dedup import suffix_dedup
from .vp_trees import nearest_neighbours


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii_votes(spark, sf_dir):
    found = pii_votes.find_pii(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *pii_votes.digest(found))


def op2_repetition_rules(spark, sf_dir):
    return repetition_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op3_chat_parts(spark, sf_dir):
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    fixed = spark.createDataFrame([(-1, t, r, "</s>[INST] ok [/INST]") for t, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    part = F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"), *(F.lit(None).cast(t).alias(c) for c, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))))
    return digests(format_turns(said.unionByName(fixed).withColumn("parts", F.array(part).cast(PARTS))))


def op4_bm25_decontam(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("matches").alias("m"))
    return found.select("doc_id", "m.*")


def op5_ftrl_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    labels = table(spark, sf_dir, "labels").filter(~held_out).select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    scored = score(docs, fit(labelled_rows(docs.withColumnRenamed("doc_id", "id"), labels)))
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_suffix_dedup(spark, sf_dir):
    out = suffix_dedup(table(spark, sf_dir, "documents"), width=400, keep_first=False)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_best_fit_pack(spark, sf_dir):
    return best_fit_pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), size=2048, end_id=0)


def op8_rlz_dedup(spark, sf_dir):
    out = rlz_dedup(table(spark, sf_dir, "documents"), width=35, keep_first=False)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op9_trigram_secrets(spark, sf_dir):
    found = trigram_secrets.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *trigram_secrets.digest(found))


def op10_ngram_join(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op11_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


def op12_vp_trees(spark, sf_dir):
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op13_slot_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


def queries():
    """Name to query, for every op here and the pipeline's."""
    import corpus_pipeline

    ops = {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
    return dict(sorted(ops.items(), key=lambda kv: int(kv[0][2:].split("_")[0]))) | {"pipeline": corpus_pipeline.run}


# fixed values: the control strings that the chat template breaks up
_CONTROL = r"<(\||/?s>)|\[/?INST\]"
_SAID = """(SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')"""


def collocation_sql():
    """Phrases counted by their words, all of them; the frequent ones cut, and left out where a longer one covers them."""
    grams = " UNION ALL ".join(f"SELECT lang, array_to_string(list_slice(w, i, i + {n - 1}), ' ') AS phrase, {n} AS k FROM (SELECT lang, w, unnest(range(1, len(w) - {n - 2})) AS i FROM cut WHERE len(w) >= {n})" for n in range(1, 5))
    return f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n-\r]')) AS piece FROM documents),
cut AS MATERIALIZED (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
words AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM cut GROUP BY lang),
f AS MATERIALIZED (SELECT lang, phrase, any_value(k) AS k, count(*) AS a FROM ({grams}) GROUP BY lang, phrase HAVING count(*) >= 30),
long AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
tried AS (SELECT lang, phrase, a, i, array_to_string(w[:i], ' ') AS one, array_to_string(w[i + 1:], ' ') AS two FROM (SELECT *, unnest(range(1, k)) AS i FROM long)),
scored AS (SELECT t.lang, t.phrase, t.a, i, x.a AS l, y.a AS r, CAST((2000000::HUGEINT * t.a) // (x.a + y.a) AS BIGINT) AS score
  FROM tried t JOIN f x ON x.lang = t.lang AND x.phrase = t.one JOIN f y ON y.lang = t.lang AND y.phrase = t.two),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
held AS (SELECT lang, array_to_string(list_slice(w, s, s + m - 1), ' ') AS phrase, max(a) AS outer_a
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS s FROM (SELECT *, unnest(range(2, k)) AS m FROM long)) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN held h USING (lang, phrase) WHERE outer_a IS NULL OR 100 * outer_a < 80 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN words USING (lang) QUALIFY rank <= 2000"""


_VECTORS = "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def oracle_sql():
    slashes = lambda c: f"length({c}) - length(replace({c}, chr(92), ''))"
    escaped = lambda c: f"length({c}) + {slashes(c)} + len(regexp_extract_all({c}, '{_CONTROL}'))"
    said = f"(SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM {_SAID})"
    return {
        "op3_chat_parts": f"""
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(8 + {escaped("role")} + 1 + {escaped("text")} + 8) AS BIGINT) AS formatted_chars
FROM {said} GROUP BY conv_id""",
        "op11_collocations": collocation_sql(),
        "op12_vp_trees": f"""
WITH rows AS (SELECT vec_id, v FROM ({_VECTORS}) WHERE vec_id IS NOT NULL AND len(list_filter(v, lambda x: x <> 0)) > 0),
met AS (SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.v, c.v) AS score FROM rows q JOIN rows c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM met QUALIFY rank <= 10""",
        "op13_slot_negatives": f"""
WITH rows AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(v, lambda x: floor(256 * x)) AS v FROM ({_VECTORS}) WHERE vec_id IS NOT NULL AND label IS NOT NULL),
met AS MATERIALIZED (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score FROM rows a JOIN rows c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM met WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN met USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score QUALIFY rank <= 5""",
    }
