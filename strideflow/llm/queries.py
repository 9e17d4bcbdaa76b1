"""One registered query per operator: whole tables, production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import of_session, shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def vocabulary(name: str) -> str:
    """Place of a vocabulary file; ``STRIDEFLOW_VOCABULARIES`` names another folder."""
    folder = os.environ.get("STRIDEFLOW_VOCABULARIES")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op7_packing")
def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    pieces = pack(of_session(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padded_length"
    )


@query("op10_mixing")
def mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(of_session(spark, sf_dir, "documents")).select("row.doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query("op4_toxicity")
def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, held_out, score

    documents = of_session(spark, sf_dir, "documents")
    weights = fit(documents, of_session(spark, sf_dir, "labels"))
    scored = score(documents, weights).select("row.doc_id", "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op6_simhash")
def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(of_session(spark, sf_dir, "documents"))


@query("op9_rules")
def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rules import judge

    judged = judge(of_session(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


@query("op2_warc", """
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
    d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS x FROM p),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY x, payload_bytes) AS first FROM d)
    SELECT page_id, payload_bytes,
        translate(upper(list_aggregate(list_transform(range(8), lambda i: to_base(('0x' || substr(x, 1 + 5 * i, 5))::BIGINT, 32, 4)), 'string_agg', '')),
            '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
        CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id <> first THEN first END AS refers_to
    FROM f""")
def warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_archives, sha1_base32, write_archives

    path = shared_path(spark, "warc")
    write_archives(of_session(spark, sf_dir, "pages"), path)
    records = read_archives(spark, path)
    revisit = F.col("type") == "revisit"
    page = lambda name: F.regexp_extract(name, r"<urn:page:(-?\d+)>", 1).try_cast("long")
    return records.select(
        page("record_id").alias("page_id"), F.when(revisit, F.col("payload_length")).otherwise(F.octet_length("payload")).cast("long").alias("payload_bytes"),
        F.when(revisit, F.replace("digest", F.lit("sha1:"), F.lit(""))).otherwise(sha1_base32(F.col("payload"))).alias("payload_digest"),
        F.col("type").alias("record_type"), page("refers_to").alias("refers_to"),
    )


#: A conversation of its own whose texts look like the template's control strings.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def _hidden(column: str) -> str:
    """SQL for the escapes of the chat template."""
    out = rf"replace({column}, '\', '\\')"
    for i, control in enumerate(("### ", "</turn>", ": ")):
        out = rf"replace({out}, '{control}', '\{chr(97 + i)}')"
    return out


@query("op1_chat", f"""
    WITH t AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '{CONTROL_TEXT}'), (-7, 1, 'assistant', '{CONTROL_TEXT}'))),
    f AS (SELECT *, '### ' || {_hidden('role')} || ': ' || {_hidden('text')} || '</turn>' || chr(10) AS formatted FROM t)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
        sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(length(formatted))::BIGINT AS formatted_chars
    FROM f GROUP BY conv_id""")
def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_conversations, read_back

    turns = of_session(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(turns.unionByName(control)))


@query("op3_substring")
def substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import repeated_passages

    return repeated_passages(of_session(spark, sf_dir, "documents"))


@query("op5_topk", """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(of_session(spark, sf_dir, "embeddings"))


@query("op8_tokens")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenfiles import document_digests, read_tokens, write_tokens

    path = shared_path(spark, "tokens")
    write_tokens(of_session(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"))
    return document_digests(read_tokens(spark, path))


@query("op13_whitening")
def whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    rows = whiten(of_session(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


@query("op12_bestfit")
def bestfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bestfit import pack_whole

    pieces = pack_whole(of_session(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


#: Terms of a text: A-Z lower-cased, all other ASCII but letters and digits between them.
_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""


@query("op11_lexical", f"""
    WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS terms FROM documents),
    g AS (SELECT *, len(terms) AS n FROM d WHERE len(terms) > 0),
    s AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM g),
    q AS (SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
    p AS (
        SELECT row, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT row, doc_id, n, unnest(terms) AS term FROM g)
        WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
    x AS (
        SELECT item_id, row, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // total))))::BIGINT AS score
        FROM q JOIN w USING (term) JOIN p USING (term), s GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM x WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20""")
def lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical import ranked_search

    return ranked_search(of_session(spark, sf_dir, "benchmark"), of_session(spark, sf_dir, "documents"))
