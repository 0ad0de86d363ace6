"""The queries of this folder's operators and, where SQL can say it, their DuckDB SQL.

Only __spark_entry__.py imports this module, and only if the folder is there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dnsketch.llm.common import Scratch, bounded, table

TOKENIZERS = "/opt/tokenizers"


def tokenizer_path(name: str, folder: str = TOKENIZERS) -> str:
    """The file of a public tokenizer; its folder is a parameter."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return f"{folder}/{name}"


def op1_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dnsketch.llm import piece_bpe

    bounded(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_bpe.digests(piece_bpe.encode_decode(docs, tokenizer_path("piece_bpe_32k.model")))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dnsketch.llm import langid

    bounded(spark)
    docs = table(spark, sf_dir, "documents")
    known = langid.learn(docs, ~langid.held_out(), Scratch(spark))
    found = langid.identify(docs.select("doc_id", "text"), known)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dnsketch.llm import toxicity

    bounded(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), Scratch(spark))
    return toxicity.grade(docs, model).select("doc_id", "severity", "toxic_p", "grade", F.col("rejected").alias("toxic"), (~F.col("rejected")).alias("kept"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dnsketch.llm import minhash

    bounded(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs, Scratch(spark))


def op5_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dnsketch.llm import hnsw

    bounded(spark)
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"), Scratch(spark))


def op6_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dnsketch.llm import kdshard

    return kdshard.shard(table(spark, sf_dir, "documents"), Scratch(spark))


def op7_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dnsketch.llm import mtree

    bounded(spark)
    return mtree.top(table(spark, sf_dir, "embeddings"), Scratch(spark))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dnsketch.llm import packing

    bounded(spark)
    parts = packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), memo=300_000)
    return packing.pack(parts, Scratch(spark))


def op9_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dnsketch.llm import template

    bounded(spark)
    return template.extract(table(spark, sf_dir, "pages"), Scratch(spark)).select("page_id", "url", "text", "n_chars")


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dnsketch.llm import linededup

    bounded(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = linededup.without_repeats(docs, Scratch(spark))
    gone = F.aggregate("removed", F.lit(0), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "text", F.size("removed").alias("n_removed"), gone.cast("long").alias("chars_removed"), F.transform("removed", lambda s: F.concat_ws("-", s["start"], s["end"])).alias("spans"), F.transform("repeated", lambda s: F.concat_ws("-", s["start"], s["end"])).alias("short_repeats"), F.array_distinct(F.flatten("removed.kept_in")).alias("kept_in"))


QUERIES = {
    "op1_piece_bpe": op1_piece_bpe,
    "op2_language": op2_language,
    "op3_toxicity": op3_toxicity,
    "op4_minhash": op4_minhash,
    "op5_hnsw": op5_hnsw,
    "op6_kd_shards": op6_kd_shards,
    "op7_mtree": op7_mtree,
    "op8_packing": op8_packing,
    "op9_template": op9_template,
    "op10_lines": op10_lines,
}

#: The rows that two recursive steps below reach: every node with all nodes of its component.
_REACH = "reach AS (SELECT id, id AS other FROM node UNION SELECT r.id, l.b FROM reach r JOIN link l ON l.a = r.other)"

SQL: dict[str, str] = {
    "op4_minhash": f"""WITH RECURSIVE w AS (
  SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS x FROM documents),
s AS (SELECT DISTINCT id, unnest(CASE WHEN len(x) >= 5 THEN list_transform(range(1, len(x) - 3), lambda i: array_to_string(x[i:i + 4], ' ')) WHEN len(x) > 0 THEN [array_to_string(x, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
hit AS (SELECT p.id AS a, q.id AS b, count(*) AS k FROM s p JOIN s q ON p.g = q.g AND p.id <> q.id GROUP BY ALL),
link AS (SELECT a, b FROM hit JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
node AS (SELECT id FROM w),
{_REACH}
SELECT id AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(other) AS component_id, id = min(other) AS kept FROM reach LEFT JOIN n USING (id) GROUP BY id""",
    "op5_hnsw": f"""WITH RECURSIVE v AS (
  SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT p.id AS a, q.id AS b FROM v p JOIN v q ON p.id <> q.id AND len(p.e) = len(q.e) WHERE list_cosine_similarity(p.e, q.e) >= 0.95),
node AS (SELECT vec_id AS id FROM embeddings),
{_REACH},
n AS (SELECT a AS id, count(*) AS n FROM link GROUP BY a)
SELECT id AS vec_id, coalesce(any_value(n.n), 0) AS n_links, min(other) AS component_id, id = min(other) AS kept FROM reach LEFT JOIN n USING (id) GROUP BY id""",
    "op7_mtree": """WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q))
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s QUALIFY rank <= 5""",
}
