"""The subpackage's queries over the driver's tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import contaminated
from .extract import main_text
from .minhash import near_duplicates
from .packing import pack
from .secrets import secret_spans
from .substrings import repeated_passages
from .topk import top_k
from .toxicity import toxicity
from .urlfilter import url_verdicts
from .warc import archived


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return archived(table(spark, sf_dir, "pages")).select(columns)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), every=50, k=5)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash_near_dedup, op2_decontamination, op3_url_filter, op4_best_fit_packing, op5_html_extraction, op6_toxicity, op7_warc_round_trip, op8_secret_scan, op9_substring_dedup, op10_exact_top_k)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash_near_dedup": r"""
            with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
            s as (select distinct doc_id, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2])) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as shingle from w),
            n as (select doc_id, count(*) as n from s group by doc_id),
            c as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by all),
            l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
            e as (select a, b from l union all select b, a from l),
            r as (select doc_id as node, doc_id as other from documents union select r.node, e.b from r join e on e.a = r.other),
            m as (select node, min(other) as component_id from r group by node)
            select d.doc_id, coalesce(n.n, 0) as n_shingles, m.component_id, d.doc_id = m.component_id as kept from documents d left join n using (doc_id) join m on m.node = d.doc_id
        """,
        "op7_warc_round_trip": """
            with p as (select page_id, html, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest, url from pages),
            f as (select *, min(page_id) over (partition by payload_digest) as first_id from p)
            select page_id, payload_bytes, payload_digest, case when payload_bytes >= 100 and page_id > first_id then 'revisit' else 'response' end as record_type,
                   case when payload_bytes >= 100 and page_id > first_id then first_id end as refers_to from f
        """,
        "op10_exact_top_k": """
            with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as double)) as v from embeddings
                       where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
            s as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
                  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
            r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
            select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5
        """,
    }
