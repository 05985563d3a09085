"""The corpus operators as queries over the test tables, with SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import alignment, centroids, chroma, exact_dedup, jaccard, mixing, packing, piece_codec, quality, suffix_dedup, token_files, url_filter, warc

def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup.exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.archive_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_file("word_bpe_49k.json"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings made from the embeddings, aligned."""
    return chroma.align(chroma.recordings(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.piece_report(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_file("piece_bpe_32k.model"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_file("byte_bpe_50k.json"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_report(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _ = alignment.align(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))
    return docs.withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_exact_dedup, op2_warc, op3_packing, op4_url_filter, op5_chroma, op6_quality, op7_suffix_dedup, op8_pieces, op9_jaccard_join, op10_token_files, op11_mixing, op12_centroids, op13_alignment)
    return {f.__name__: f for f in ops}


def _clusters_sql(k: int = 16, rounds: int = 3) -> str:
    """Plain k-means over (vector, component) rows."""
    steps = """kept AS (
                SELECT row_number() OVER () AS v, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings
                WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
            c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS c, x AS m FROM (SELECT * FROM kept ORDER BY sha256('1:' || vec_id), x LIMIT {k}))""".format(k=k)
    for r in range(rounds + 1):
        steps += f""",
            far{r} AS (SELECT v, c, list_sum(list_transform(list_zip(x, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM kept, c{r}),
            near{r} AS (SELECT v, c, d FROM far{r} QUALIFY row_number() OVER (PARTITION BY v ORDER BY d, c) = 1)"""
        if r < rounds:
            steps += f""",
            sums{r} AS (SELECT c, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM (SELECT c, x, unnest(range(1, 65)) AS i FROM near{r} JOIN kept USING (v)) GROUP BY c, i),
            means{r} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM sums{r} GROUP BY c),
            c{r + 1} AS (SELECT c, coalesce(n.m, o.m) AS m FROM c{r} AS o LEFT JOIN means{r} AS n USING (c))"""
    return f"""
            WITH {steps}
            SELECT vec_id, c::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
                   sha256(array_to_string(m, ',')) AS centroid_sha256
            FROM near{rounds} JOIN kept USING (v) JOIN c{rounds} USING (c)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
        "op2_warc": """
            WITH of AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
            dig AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS hex FROM of),
            five AS (SELECT page_id, n, hex, unnest(range(8)) AS k FROM dig),  -- 20 bits, four base32 letters
            num AS (SELECT page_id, n, hex, k, ('0x' || substr(hex, 5 * k::INT + 1, 5))::BIGINT AS v FROM five),
            word AS (SELECT page_id, n, hex, string_agg(list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> s & 31)::INT + 1, 1) for s in [15, 10, 5, 0]], 'string_agg', ''), '' ORDER BY k) AS digest
                     FROM num GROUP BY page_id, n, hex)
            SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = min(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
                   CASE WHEN page_id <> min(page_id) OVER w THEN min(page_id) OVER w END AS refers_to
            FROM word WINDOW w AS (PARTITION BY hex, n)""",
        "op4_url_filter": """
            WITH parts AS (
                SELECT page_id,
                       translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                       regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
                FROM pages),
            rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                                            ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
            fits AS (
                SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
                FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
            SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (page_id)""",
        "op11_mixing": r"""
            WITH rows AS (
                SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                       ('0x' || substr(md5('1:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS chance
                FROM documents),
            of AS (SELECT source, sum(size)::BIGINT AS s, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM rows GROUP BY source),
            weighed AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM of),
            ranked AS (  -- sources by how soon a common level takes them to their limit
                SELECT *, (SELECT sum(s) FROM of) - coalesce(sum(3 * s) OVER before, 0) AS left_over, sum(w) OVER (ORDER BY 3.0 * s / w DESC, place DESC) AS free
                FROM weighed WINDOW before AS (ORDER BY 3.0 * s / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
            stops AS (SELECT coalesce(sum(3 * s) FILTER (WHERE 3 * s * free <= w * left_over), 0) AS held, sum(w) FILTER (WHERE 3 * s * free > w * left_over) AS free, sum(s) AS words FROM ranked),
            targets AS (SELECT of.source, of.s, least(w * ((words - held)::DOUBLE / stops.free::DOUBLE), (3 * of.s)::DOUBLE) AS target FROM weighed AS of, stops),
            rates AS (SELECT *, CASE WHEN s > 0 THEN target / s ELSE 0 END AS rate FROM targets)
            SELECT doc_id, size::BIGINT AS size, s AS source_size, target, (size * (floor(rate) + (chance < rate - floor(rate))::INT))::BIGINT AS taken
            FROM rows JOIN rates ON rows.source IS NOT DISTINCT FROM rates.source""",
        "op12_centroids": _clusters_sql(),
    }
