"""One query per operator over the driver tables, with production parameters, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm.common import documents, tokenizer_file
from pulsegrid.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The bytes of white space and the letters that change case, as DuckDB expressions.
_SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package()
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return fn

    return register


@query(
    "op1_line_dedup",
    f"""
    with lines as (
        select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i
        from documents),
    keyed as (select doc_id, i, line, {_LOWER.format(f"trim(line, {_SPACE})")} as k from lines),
    often as (select k, max(doc_id) as top from keyed where length(k) >= 20 group by k having count(distinct doc_id) >= 3),
    marked as (select doc_id, i, line, top is not null and top <> doc_id as gone from keyed left join often using (k))
    select doc_id, count(*)::bigint as n_lines, (count(*) filter (gone))::bigint as n_dropped,
           sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
    from marked group by doc_id""",
)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.line_dedup import digest_rows

    return digest_rows(documents(spark, sf_dir))


@query("op2_token_files")
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from pulsegrid.llm.byte_bpe import tokenizer_json
    from pulsegrid.llm.token_files import token_file_rows

    return token_file_rows(documents(spark, sf_dir), tokenizer_json(tokenizer_file("byte_bpe_50k.json")), public_tokenizers.PATTERN, 50_257)


@query("op3_mixing")
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.mixing import mix

    return mix(documents(spark, sf_dir).select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


@query("op4_quality")
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.quality import scored_rows

    return scored_rows(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


@query("op5_embedding_dedup")
def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.near_vectors import near_vectors

    return near_vectors(documents(spark, sf_dir, "embeddings"))


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.toxicity import scored_rows

    return scored_rows(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


@query(
    "op7_exact_dedup",
    f"""
    with d as (select doc_id, sha256({_LOWER.format("coalesce(text, '')")}) as text_sha256 from documents)
    select doc_id, max(doc_id) over (partition by text_sha256) as keep_id,
           count(*) over (partition by text_sha256) as group_size,
           doc_id = max(doc_id) over (partition by text_sha256) as kept, text_sha256
    from d""",
)
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.exact_dedup import dedup_exact

    return dedup_exact(documents(spark, sf_dir))


@query("op8_licences")
def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.licences import licence_rows

    return licence_rows(documents(spark, sf_dir))


@query("op9_byte_bpe")
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from pulsegrid.llm.byte_bpe import encode_decode, tokenizer_json

    return encode_decode(documents(spark, sf_dir).select("doc_id", "text"), tokenizer_json(tokenizer_file("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)


@query("op10_simhash")
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.simhash import near_rows

    return near_rows(documents(spark, sf_dir))


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.periodic_runs import run_rows

    return run_rows(documents(spark, sf_dir))


@query("op12_secret_scan")
def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.secrets import secret_rows

    return secret_rows(documents(spark, sf_dir))


@query("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from pulsegrid.llm.byte_bpe import tokenizer_json
    from pulsegrid.llm.token_alignment import alignment_rows

    with open(tokenizer_file("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    return alignment_rows(documents(spark, sf_dir), tokenizer_json(tokenizer_file("byte_bpe_50k.json")), public_tokenizers.PATTERN, model)
