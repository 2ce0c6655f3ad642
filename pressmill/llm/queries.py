"""The operators on their whole tables, and the DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.llm.common import table
from pressmill.llm.divergence import AUDIT_SQL, audit
from pressmill.llm.drift_means import cluster_digest, rounds_sql
from pressmill.llm.html_blocks import extracted
from pressmill.llm.lines import DIGEST_SQL, line_digest
from pressmill.llm.mtree import largest_products, quantised
from pressmill.llm.multi_index import nearest
from pressmill.llm.nbest import n_best_digest
from pressmill.llm.packing import packing_digest
from pressmill.llm.phrase_index import CONTAMINATED_SQL, contaminated
from pressmill.llm.repeats import removal_digest
from pressmill.llm.simhash import simhash_classes
from pressmill.llm.tool_calls import LINKED_SQL, SCHEMAS, linked, read_turns
from pressmill.llm.toxicity import toxicity
from pressmill.llm.vectors import valid

#: Files of the installed public vocabularies: for packing, and for N-best encoding.
TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


@query
def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_classes(table(spark, folder, "documents"))


@query
def op10_suffix_array(spark: SparkSession, folder: str) -> DataFrame:
    return removal_digest(table(spark, folder, "documents"))


@query
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op8_hilbert_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing_digest(table(spark, folder, "documents"), tokenizer_path())


@query
def op9_template_lines(spark: SparkSession, folder: str) -> DataFrame:
    return line_digest(table(spark, folder, "documents"))


ORACLES["op9_template_lines"] = DIGEST_SQL


@query
def op1_html_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return extracted(table(spark, folder, "pages"))


@query
def op2_mtree(spark: SparkSession, folder: str) -> DataFrame:
    vectors = quantised(valid(table(spark, folder, "embeddings")))
    return largest_products(vectors, vectors.where("vec_id % 50 = 0"))


ORACLES["op2_mtree"] = """
    with v as (
        select vec_id, [floor(cast(x as double) * 256) for x in embedding] as v
        from embeddings
        where vec_id is not null and len(embedding) > 0
          and len([x for x in embedding if x is null or not isfinite(x)]) = 0
    ),
    scored as (
        select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
        from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 50 = 0
    )
    select query_id, cast(rank as integer) as rank, vec_id, score
    from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
    where rank <= 5"""


@query
def op6_multi_index(spark: SparkSession, folder: str) -> DataFrame:
    vectors = valid(table(spark, folder, "embeddings"), nonzero=True)
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))


@query
def op3_n_best(spark: SparkSession, folder: str) -> DataFrame:
    return n_best_digest(table(spark, folder, "documents"), tokenizer_path(PIECES))


@query
def op5_tool_calls(spark: SparkSession, folder: str) -> DataFrame:
    calls, results = read_turns(table(spark, folder, "conversations"))
    return linked(calls, results, SCHEMAS).withColumn("errors", F.array_join("errors", "; "))


ORACLES["op5_tool_calls"] = LINKED_SQL


@query
def op11_drift_means(spark: SparkSession, folder: str) -> DataFrame:
    return cluster_digest(table(spark, folder, "embeddings"))


ORACLES["op11_drift_means"] = rounds_sql()


@query
def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return audit(table(spark, folder, "documents"))


ORACLES["op12_source_divergence"] = AUDIT_SQL


@query
def op13_phrase_index(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


ORACLES["op13_phrase_index"] = CONTAMINATED_SQL
