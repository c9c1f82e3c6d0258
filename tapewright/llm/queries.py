"""The queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .mixing import Plan, mix, mix_sql


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hilbert import shards

    return shards(_table(spark, sf_dir, "documents"), 8)


def op2_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .cover_tree import top_products

    return top_products(_table(spark, sf_dir, "embeddings"), 50, 5)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import token_files

    return token_files(_table(spark, sf_dir, "documents"), tokenizer_path())


#: Production weights of the mixing query.
MIX = Plan(domains={"web": 4.0, "books": 2.0}, languages={"en": 3.0}, budget=0.5, epochs=2, seed=17)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"), MIX, ["doc_id"])


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(_table(spark, sf_dir, "pages"))


def op7_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .parity_join import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), 3, 4, 5)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import write_and_read

    return write_and_read(_table(spark, sf_dir, "pages"))


def op9_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collision import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), 100, 10)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_decode

    return encode_decode(_table(spark, sf_dir, "documents"), tokenizer_path())


def op11_dual_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .dual_lloyd import lloyd

    return lloyd(_table(spark, sf_dir, "embeddings"), 8, 10)


def op12_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .storage import small_batches, written
    from .token_counts import over, prefix_table

    with small_batches(spark, 2000):
        table = written(prefix_table(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")), "prefixes")
    return table.select("doc_id", "n_bytes", "n_tokens", over(4096).alias("over_limit"))


def op13_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .impact_search import rank

    return rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), 10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hilbert_shards": op1_hilbert_shards,
    "op2_cover_tree": op2_cover_tree,
    "op3_toxicity": op3_toxicity,
    "op4_token_files": op4_token_files,
    "op5_mixing": op5_mixing,
    "op6_html_text": op6_html_text,
    "op7_parity_join": op7_parity_join,
    "op8_warc": op8_warc,
    "op9_collision": op9_collision,
    "op10_bpe": op10_bpe,
    "op11_dual_lloyd": op11_dual_lloyd,
    "op12_prefix_counts": op12_prefix_counts,
    "op13_impact_search": op13_impact_search,
}

_TOP_PRODUCTS = """WITH usable AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
  scored AS (SELECT q.vec_id AS query_id, d.vec_id, max(CAST(list_inner_product(q.v, d.v) AS BIGINT)) AS score
    FROM usable q JOIN usable d ON d.vec_id <> q.vec_id AND len(d.v) = len(q.v) WHERE q.vec_id % 50 = 0 GROUP BY 1, 2)
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5"""

_RANKED = r"""WITH words AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
  docs AS (SELECT doc_id, r, t, CAST(len(t) AS BIGINT) AS n FROM words WHERE len(t) > 0),
  total AS (SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM docs),
  tf AS (SELECT r, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, doc_id, n, unnest(t) AS term FROM docs) GROUP BY ALL),
  w AS (SELECT term, CAST(floor(1000 * ln((2 * max(big_n) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, total GROUP BY term),
  asked AS (SELECT item_id, term, CAST(count(*) AS BIGINT) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
  scored AS (SELECT item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l)))) AS BIGINT) AS score
    FROM asked JOIN tf USING (term) JOIN w USING (term), total GROUP BY ALL)
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0 AND doc_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10"""



def _lloyd_sql(rounds: int) -> str:
    """Each round as two tables: the nearest centroid of each vector, and the means rounded down."""
    nearest = """r{i} AS MATERIALIZED (SELECT r, CAST(best % 8 AS INTEGER) AS cluster, best // 8 AS distance FROM (SELECT r,
    min(CAST(list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(kept.v, c{i}.v)]) AS BIGINT) * 8 + cluster) AS best FROM kept, c{i} GROUP BY r))"""
    means = """c{j} AS MATERIALIZED (SELECT c{i}.cluster, coalesce(m.v, c{i}.v) AS v FROM c{i} LEFT JOIN (SELECT cluster, list(mean ORDER BY j) AS v FROM
    (SELECT cluster, j, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS mean FROM (SELECT cluster, j, sum(x) AS s, count(*) AS n FROM
    (SELECT cluster, unnest(range(1, 65)) AS j, unnest(v) AS x FROM r{i} JOIN kept USING (r)) GROUP BY cluster, j)) GROUP BY cluster) m USING (cluster))"""
    steps = [part.format(i=i, j=i + 1) for i in range(rounds) for part in (nearest, means)] + [nearest.format(i=rounds)]
    return f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
  c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS cluster, v FROM (SELECT sha256('3:' || vec_id) AS h, v FROM kept ORDER BY h, v LIMIT 8)),
  {", ".join(steps)}
  SELECT vec_id, r{rounds}.cluster, distance, CAST(sum(distance) OVER (PARTITION BY r{rounds}.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256 FROM r{rounds} JOIN kept USING (r) JOIN c{rounds} ON c{rounds}.cluster = r{rounds}.cluster"""


ORACLE_SQL: dict[str, str] = {"op2_cover_tree": _TOP_PRODUCTS, "op5_mixing": mix_sql(MIX), "op11_dual_lloyd": _lloyd_sql(10), "op13_impact_search": _RANKED}
