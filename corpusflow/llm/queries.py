"""Registered queries of the operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import (
    bag_search,
    block_naming,
    chat,
    chosen_path,
    fill_middle,
    hilbert_ann,
    html_paths,
    line_dedup,
    mixing,
    pii,
    quality,
    tiling,
    warc,
)
from corpusflow.llm.common import table
from corpusflow.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text freed of repeated passages."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "lines", "removed_lines", "removed_chars", "text")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    names = F.array(*[F.lit(k) for k in (*pii.KINDS, "id")])

    def listed(spans: str) -> Column:
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ","
        )

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        F.col("doc_id").cast("long"),
        *[count(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)],
        F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.filter(F.array(listed("base"), listed("added")), lambda s: s != ""), ",").alias("spans"),
    )


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of every hundredth vector."""
    return hilbert_ann.nearest(table(spark, sf_dir, "embeddings"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every page."""
    return html_paths.extract_main_text(table(spark, sf_dir, "pages"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read back from all conversations once formatted, and from one that holds control strings."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = r"\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], given.schema)
    out = chat.format_conversations(chat.text_turns(given.unionByName(added)))
    read = out.withColumn("turns", chat.read_turns()).withColumn("learned", F.array_join(chat.read_loss(), ""))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest.cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of the archives written from all pages."""
    path = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items they cover."""
    return tiling.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("version")


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mixture of all sources takes of every document."""
    return mixing.mixture_shares(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near copies of every document, and its number of links."""
    return chosen_path.similar_classes(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document."""
    scored = quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select(
        F.col("doc_id").cast("long"), "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document that stays of each group of equal ones, for every document."""
    out = block_naming.group_copies(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best documents for every benchmark item."""
    return bag_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the fill-in-the-middle form of every document and of the text rebuilt from it."""
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    both = fill_middle.restore(made.withColumn("output_sha256", F.sha2(F.col("output").cast("binary"), 256)))
    return both.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        "output_sha256",
        F.sha2(F.col("text").cast("binary"), 256).alias("restored_sha256"),
    )


QUERIES: dict[str, Query] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_pii": op2_pii,
    "op3_neighbours": op3_neighbours,
    "op4_main_text": op4_main_text,
    "op5_decontaminate": op5_decontaminate,
    "op6_chat": op6_chat,
    "op7_warc": op7_warc,
    "op8_mix": op8_mix,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_quality": op10_quality,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_ranked_search": op12_ranked_search,
    "op13_fill_in_middle": op13_fill_in_middle,
}
_ESCAPED = r"length({0}) + length({0}) - length(replace({0}, chr(92), '')) + length({0}) - length(replace(replace({0}, '<', ''), '>', ''))"

ORACLES: dict[str, str] = {
    "op6_chat": f"""
with rows as (
    select conv_id, turn, coalesce(role, '') as role, coalesce("text", '') as body from conversations
    union all select -7, 0, 'user', chr(92) || '### Assistant: </turn> ok'
    union all select -7, 1, 'assistant', chr(92) || '### Assistant: </turn> ok'
)
select conv_id,
    count(*) as n_turns,
    sha256(string_agg(role || chr(10) || body || chr(10), '' order by turn, role, body)) as turns_sha256,
    cast(sum(case when role = 'assistant' then length(body) else 0 end) as bigint) as loss_chars,
    sha256(coalesce(string_agg(case when role = 'assistant' then body end, '' order by turn, role, body), ''))
        as loss_sha256,
    cast(sum(16 + {_ESCAPED.format("role")} + {_ESCAPED.format("body")}) as bigint) as formatted_chars
from rows group by conv_id""",
    "op7_warc": """
with rows as (
    select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as n from pages
), hashed as (
    select page_id, n, sha1(html) as digest from rows
), latest as (
    select *, max(page_id) over (partition by digest, n >= 1000) as top from hashed
)
select page_id, cast(n as bigint) as payload_bytes, digest as payload_digest,
    case when n >= 1000 and page_id is distinct from top then 'revisit' else 'response' end as record_type,
    case when n >= 1000 and page_id is distinct from top then top end as refers_to
from latest""",
    "op11_exact_dedup": r"""
with bare as (
    select doc_id, length(coalesce("text", '')) as chars,
        regexp_replace(coalesce("text", ''), '[\x20\x09-\x0D]+', '', 'g') as body
    from documents
), grouped as (
    select doc_id, first_value(doc_id) over (partition by body order by chars desc, doc_id) as keep_id,
        count(*) over (partition by body) as group_size, sha256(body) as text_sha256
    from bare
)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from grouped""",
    "op12_ranked_search": r"""
with words as (
    select doc_id, unnest(regexp_extract_all("text", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as word
    from documents
), counted as (
    select doc_id, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term, count(*) as tf
    from words group by all
), sizes as (
    select doc_id, cast(sum(tf) as bigint) as n from counted group by doc_id
), totals as (
    select cast(count(*) as bigint) as docs, cast(sum(n) as bigint) as terms from sizes
), asked as (
    select distinct item_id, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term
    from (
        select item_id, unnest(regexp_extract_all("text", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as word
        from benchmark
    )
), weights as (
    select term, cast(floor(1000 * ln((2 * max(docs) + 2) / (2 * count(*) + 1))) as bigint) as w
    from counted, totals where term in (select term from asked) group by term
), scored as (
    select item_id, doc_id,
        cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms)))) as bigint) as score
    from counted join asked using (term) join weights using (term) join sizes using (doc_id), totals
    group by item_id, doc_id
), ranked as (
    select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank,
        doc_id, score
    from scored where score > 0
)
select item_id, rank, doc_id, score from ranked where rank <= 50""",
    "op13_fill_in_middle": r"""
with given as (
    select doc_id, coalesce("text", '') as body, sha256('1:' || doc_id) as h,
        regexp_extract_all(coalesce("text", ''), '[A-Za-z]+|[^A-Za-z]') as u
    from documents
), hashed as (
    select doc_id, body, u, cast(len(u) as bigint) as n,
        cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2,
        cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4
    from given
), formed as (
    select *, least(h1 % (n + 1), h2 % (n + 1)) as low, greatest(h1 % (n + 1), h2 % (n + 1)) as high,
        case when body = '' or contains(body, '<P>') or contains(body, '<S>') or contains(body, '<M>')
            or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form
    from hashed
), parts as (
    select doc_id, n, form, body, array_to_string(u[1:low], '') as p, array_to_string(u[low + 1:high], '') as m,
        array_to_string(u[high + 1:n], '') as s
    from formed
)
select doc_id, n, form,
    case when form <> 'plain' then cast(length(p) as bigint) end as prefix_chars,
    case when form <> 'plain' then cast(length(m) as bigint) end as middle_chars,
    sha256(case form when 'plain' then body when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
        else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
    sha256(body) as restored_sha256
from parts""",
}
