"""One query per operator over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, hard_negatives, langid, licenses, mixing, near_dedup, packing, quality, resample, sharding, topk, toxicity
from .common import table, tokenizer_path

SHARDS = 16


def op1_exact_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").where(topk.usable())
    vectors = rows.select("vec_id", topk.quantised().alias("v"))
    return topk.search(vectors, F.col("vec_id") % 50 == 0, 5)


def op2_bpe(spark: SparkSession, d: str) -> DataFrame:
    import hashlib

    import pandas as pd

    def digests(keys: list, raws: list[bytes], texts: list[str]) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "doc_id": pd.Series(keys, dtype="Int64"),
                "n_tokens": [len(r) // 4 for r in raws],
                "ids_sha256": [hashlib.sha256(r).hexdigest() for r in raws],
                "decoded_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in texts],
            }
        )

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    vocabulary = bpe.read_vocabulary(tokenizer_path())
    return bpe.encode_blocks(spark, table(spark, d, "documents"), vocabulary, digests, schema)


def op3_quality(spark: SparkSession, d: str) -> DataFrame:
    found = quality.assess(table(spark, d, "documents"), table(spark, d, "labels"))
    return found.select("doc_id", "lang", "n", "perplexity", "low", "high", "kept")


def op4_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    return near_dedup.find(table(spark, d, "documents"))


def op5_language(spark: SparkSession, d: str) -> DataFrame:
    return langid.identify(table(spark, d, "pages"), table(spark, d, "documents"))


def op6_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    model = toxicity.train(docs, table(spark, d, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        (toxicity.fold() == 0).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op7_sharding(spark: SparkSession, d: str) -> DataFrame:
    return sharding.shard_documents(table(spark, d, "documents"), [1.0] * SHARDS)


def op8_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return exact_dedup.verdicts(table(spark, d, "documents"))


def op9_licenses(spark: SparkSession, d: str) -> DataFrame:
    return licenses.scan(table(spark, d, "documents"))


def op10_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(spark, table(spark, d, "documents"), tokenizer_path())


def op11_mixing(spark: SparkSession, d: str) -> DataFrame:
    found = mixing.take(table(spark, d, "documents"), (3, 1, 2), 1.5, 2.0)
    return found.select("doc_id", "size", "source_size", "target", "taken", "source")


def op12_resampling(spark: SparkSession, d: str) -> DataFrame:
    scored = resample.scores(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return resample.draw_ranks(scored, 5).select("doc_id", "n_features", "weight", "score", "rank")


def op13_hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").where(topk.usable())
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = rows.select("vec_id", label.alias("label"), topk.quantised().alias("v"))
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0, 5, 10, 30, 90)


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_topk, op2_bpe, op3_quality, op4_near_dedup, op5_language,
        op6_toxicity, op7_sharding, op8_exact_dedup, op9_licenses, op10_packing,
        op11_mixing, op12_resampling, op13_hard_negatives,
    )
}


def _shard_score(shard: str) -> str:
    head = f"substr(md5(coalesce(cast(doc_id as varchar), 'null') || ':' || {shard}), 1, 13)"
    return f"-1.0 / ln((cast(cast('0x' || {head} as bigint) as double) + 0.5) / 4503599627370496.0)"


ORACLES = {
    "op1_exact_topk": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
            from embeddings
            where embedding is not null and vec_id is not null
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), scored as (
            select q.vec_id as query_id, c.vec_id as vec_id, cast(list_sum(list_transform(
                list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
            from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
        ), ranked as (
            select *, row_number() over (partition by query_id order by score desc, vec_id) as r from scored
        )
        select query_id, cast(r as integer) as rank, vec_id, score from ranked where r <= 5
    """,
    "op7_sharding": f"""
        with bits as (
            select list(c order by n) as crc_table from (
                select n, list_reduce(list_prepend(n, range(8)), lambda c, i:
                    case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
                from range(256) t(n)
            )
        ), docs as (
            select doc_id, cast(strlen(coalesce(text, '')) + 1 as bigint) as size,
                list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
                    lambda h: cast('0x' || h as bigint))) as body
            from documents
        ), sums as (
            select doc_id, size, xor(4294967295, list_reduce(body, lambda c, b:
                xor(c >> 8, crc_table[(xor(c, b) & 255) + 1]))) as text_crc32
            from docs, bits
        ), s as (
            select doc_id, arg_max(i, {_shard_score("i")}) filter (i < {SHARDS}) as shard,
                arg_max(i, {_shard_score("i")}) as grown_shard
            from (select distinct doc_id from documents), range({SHARDS + 1}) t(i) group by doc_id
        ), rows as (
            select doc_id, size, cast(text_crc32 as bigint) as text_crc32, 'key' as law,
                cast(shard as integer) as shard, cast(grown_shard as integer) as grown_shard
            from sums join s using (doc_id)
        )
        select *, row_number() over (partition by shard order by md5(concat_ws('|', doc_id, size, text_crc32, law,
            shard, grown_shard)), doc_id) - 1 as slot
        from rows
    """,
    "op8_exact_dedup": """
        with n as (
            select doc_id,
                sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256
            from documents
        ), g as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from n group by text_sha256)
        select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, text_sha256
        from n join g using (text_sha256)
    """,
    "op11_mixing": """
        with d as (
            select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from documents
        ), s as (
            select source, cast(sum(size) as bigint) as source_size,
                [3, 1, 2][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight
            from d group by source
        ), o as (
            select *, 2.0 * source_size / weight as ratio,
                row_number() over (order by 2.0 * source_size / weight, source) as k,
                sum(2.0 * source_size) over (order by 2.0 * source_size / weight, source rows unbounded preceding) as caps,
                sum(weight) over (order by 2.0 * source_size / weight, source rows unbounded preceding) as used
            from s
        ), levels as (
            select k, (1.5 * sum(source_size) over () - caps) / nullif(sum(weight) over () - used, 0) as level,
                lead(ratio) over (order by k) as next_ratio from o
            union all
            select 0, 1.5 * sum(source_size) / sum(weight), min(ratio) from o
        ), t as (
            select source, source_size, least(2.0 * source_size, weight * coalesce(
                (select level from levels where next_ratio > level order by k limit 1), 0)) as target
            from s
        ), n as (
            select doc_id, size, d.source as d_source, source_size, target, target / nullif(source_size, 0) as rate,
                row_number() over (partition by doc_id, d.source, size) as number
            from d join t on d.source is not distinct from t.source
        ), u as (
            select *, (cast(cast('0x' || substr(md5(concat('mix:', coalesce(cast(doc_id as varchar), 'null'), ':', number)), 1, 13)
                as bigint) as double) + 0.5) / 4503599627370496.0 as draw
            from n
        )
        select doc_id, size, source_size, cast(target as double) as target, d_source as source,
            cast(size * coalesce(floor(rate) + if(draw < rate - floor(rate), 1, 0), 0) as bigint) as taken
        from u
    """,
    "op13_hard_negatives": """
        with v as (
            select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
            from embeddings
            where embedding is not null and vec_id is not null and label is not null
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), scored as (
            select a.vec_id as anchor_id, c.vec_id as vec_id, a.label = c.label as same, cast(list_sum(list_transform(
                list_zip(a.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
            from v a join v c on a.vec_id <> c.vec_id where a.vec_id % 100 = 0
        ), positives as (
            select anchor_id, vec_id as positive_id, score as positive_score from scored where same
            qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
        ), ranked as (
            select p.*, n.vec_id as negative_id, n.score as negative_score,
                row_number() over (partition by p.anchor_id, positive_id order by n.score desc, n.vec_id) as r
            from positives p join scored n on p.anchor_id = n.anchor_id and not n.same
                and 30 * positive_score <= 100 * n.score and 100 * n.score <= 90 * positive_score
        )
        select anchor_id, positive_id, cast(r as integer) as rank, negative_id, positive_score, negative_score
        from ranked where r <= 10
    """,
}
