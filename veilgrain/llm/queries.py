"""The registered queries of the operators for training data, with the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrain.llm import (
    boilerplate,
    decontaminate,
    fingerprints,
    languages,
    licenses,
    ngram_join,
    packing,
    prefix_trie,
    quality,
    secrets,
    simhash,
    suffix_dedup,
    token_links,
)

Q, SQL = {}, {}


def query(fn):
    Q[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op8_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_groups(table(spark, folder, "documents"), n=4, percent=85)


@query
def op9_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, folder, "documents"), length=200)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op10_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, folder, "documents"))


def _joined(spans: F.Column) -> F.Column:
    """kind:start:end of each span, by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


@query
def op4_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, folder, "documents"))

    def of(kind: str) -> F.Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")

    count = [of(k).alias(f"n_{k}") for k in secrets.KINDS]
    base = F.filter("spans", lambda x: x["kind"] != "format")
    return found.select("doc_id", *count, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


@query
def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.drop("text_key")


@query
def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = boilerplate.drop_boilerplate(table(spark, folder, "documents"))
    return out.select("doc_id", "source", "n_lines", "n_dropped", "text")


SQL["op2_line_dedup"] = r"""
with l as (select doc_id, source, text, string_split(text, chr(10)) as lines from documents),
p as (select source, count(*) as pages from documents group by source),
u as (select distinct doc_id, source, unnest(lines) as line from l),
bad as (
  select u.source, list(line) as lines from (
    select source, line, count(*) as pages_on from u where line <> '' group by source, line having count(*) >= 3
  ) u join p on u.source is not distinct from p.source where pages_on > 0.05 * pages group by u.source),
k as (
  select l.doc_id, l.source, l.lines,
    list_filter(l.lines, lambda x: not coalesce(list_contains(bad.lines, x), false)) as kept
  from l left join bad on l.source is not distinct from bad.source)
select doc_id, source, coalesce(len(lines), 0) as n_lines, coalesce(len(lines) - len(kept), 0) as n_dropped,
  array_to_string(kept, chr(10)) as text
from k
"""


@query
def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents")).drop("text_key")


@query
def op5_language(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with all evidence, and documents with the evidence that they have: text and source."""
    docs = table(spark, folder, "documents")
    model = languages.text_model(languages.learning_rows(docs))
    pages = languages.identify(languages.page_rows(table(spark, folder, "pages")), model, ["page_id"])
    own = languages.identify(languages.document_rows(docs), model, ["doc_id"], markup=False)
    return own.withColumn("page_id", F.lit(None).cast("long")).unionByName(pages.withColumn("doc_id", F.lit(None).cast("long")))


@query
def op6_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, folder, "documents"))


@query
def op11_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_groups(table(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op12_token_links(spark: SparkSession, folder: str) -> DataFrame:
    return token_links.align_documents(table(spark, folder, "documents"))


@query
def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    keys = prefix_trie.conversation_keys(table(spark, folder, "conversations"))
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(keys))


SQL["op13_prefix_trie"] = r"""
with crc_table as (
  select list_transform(range(0, 256), lambda n: list_reduce(range(0, 8),
    lambda c, k: case when c & 1 = 1 then xor(3988292384::bigint, c >> 1) else c >> 1 end, n)) as steps),
own as (
  select conv_id, list({'role': role, 'text': text} order by turn nulls first, role, text) as turns
  from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null)
  group by conv_id),
heads as (
  select conv_id, turns, xor(4294967295::bigint, list_reduce(
    list_transform(range(1, length(conv_id::varchar) + 1), lambda i: ascii((conv_id::varchar)[i])::bigint),
    lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]), 4294967295::bigint)) % 9 as h
  from own, crc_table),
rebuilt as (
  select c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) as seq
  from heads c left join own b on b.conv_id = c.conv_id - c.conv_id % 5),
members as (
  select conv_id, d, seq[1:d] as p, len(seq) = d as here
  from (select conv_id, seq, unnest(range(0, len(seq) + 1)) as d from rebuilt)),
nodes as (
  select p, d, min(conv_id) as conv_id, count(*) as n,
    coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (here), '') as ends
  from members group by p, d),
kids as (select p[1:d - 1] as p, count(*) as n from nodes where d > 0 group by 1),
sized as (
  select nodes.p, nodes.d, coalesce(kids.n, 0) as n_children,
    case when nodes.d = 0 then 0 else (nodes.n - 1) * strlen(nodes.p[nodes.d].text) end as saved
  from nodes left join kids on nodes.p = kids.p),
below as (
  select p[1:e] as p, count(*) filter (n_children = 0) as n_leaves, sum(saved) as saved
  from (select p, n_children, saved, unnest(range(0, d + 1)) as e from sized) group by 1)
select nodes.conv_id, nodes.d as depth, parent.conv_id as parent_conv_id, nodes.n as n_convs, n_children, n_leaves,
  below.saved::bigint as saved_tokens, sha256(nodes.ends) as ends_sha256
from nodes join sized on nodes.p = sized.p join below on nodes.p = below.p
  left join nodes parent on nodes.d > 0 and parent.p = nodes.p[1:nodes.d - 1] and parent.d = nodes.d - 1
"""

