"""Registered queries of the text operators and, where SQL can say it, their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from peerscreen.llm import bpe, chat, decontaminate, hard_negatives, html_text, jaccard, kmeans_tree, quality_classifier, quality_rules, secrets, toxicity, warc, whitening
from peerscreen.llm.common import fresh_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = f"list_filter(string_split_regex({LOW}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

OP7_SQL = f"""
with d as (select doc_id, row_number() over () as r, {WORDS} as w from documents),
i as (select item_id, {WORDS} as w from benchmark),
iw as (
  select distinct item_id, least(10, len(w)) as n, list_slice(w, p, p + least(10, len(w)) - 1) as g
  from (select *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as p from i where len(w) > 0)),
ns as (select distinct n from iw),
dw as (
  select r, n, p, list_slice(w, p, p + n - 1) as g
  from (select d.*, n, unnest(range(1, len(w) - n + 2)) as p from d, ns where len(w) >= n)),
h as (select r, dw.n, p, item_id from dw join iw on dw.n = iw.n and dw.g = iw.g),
hit as (select r, count(*) as n_hit from (select distinct r, unnest(range(p, p + n)) as q from h) group by r),
its as (
  select r, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct r, cast(item_id as varchar) as item from h) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (r) left join its using (r)
"""


@query("op7_winnowing", OP7_SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    df = decontaminate.decontaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"), carry=["doc_id"])
    ids = F.array_sort(F.array_distinct(F.transform("item_ids", lambda x: x.cast("string"))))
    return df.select(
        "doc_id", "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), "contaminated"
    )


ASSIGN_SQL = r"""[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]"""
VALUE_SQL = r"""["'']?\x20*[:=]\x20*["'']?"""
#: A mark that no text has splits each text at its matches.
SPANS_SQL = {
    "assign": (f"((?:{ASSIGN_SQL}){VALUE_SQL}[A-Za-z0-9+/_.=-]+)", f"length(regexp_extract(piece, '(?:{ASSIGN_SQL}){VALUE_SQL}([A-Za-z0-9+/_.=-]+)', 1)) >= 6"),
    "access": ("(AKIA[A-Z0-9]+)", "length(piece) >= 20"),
    "hex": ("([0-9a-f]+)", "length(piece) >= 24"),
}


def spans_sql(kind: str, rank: int) -> str:
    pattern, test = SPANS_SQL[kind]
    return f"""
select r, '{kind}' as kind, {rank} as k, s, s + length(piece) as e from (
  select r, piece, i, coalesce(sum(length(piece)) over (partition by r order by i rows between unbounded preceding and 1 preceding), 0)::bigint as s
  from (select r, unnest(p) as piece, generate_subscripts(p, 1) as i from (
    select r, string_split(regexp_replace(t, '{pattern}', chr(1) || '\\1' || chr(1), 'g'), chr(1)) as p from d)))
where i % 2 = 0 and {test}"""


OP9_SQL = f"""
with d as (select doc_id, row_number() over () as r, coalesce(text, '') as t from documents),
a as ({" union all ".join(spans_sql(k, i) for i, k in enumerate(SPANS_SQL))}),
g as (
  select r, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access,
    count(*) filter (kind = 'hex') as n_hex, string_agg(kind || ':' || s || ':' || e, ',' order by s, k) as spans
  from a group by r)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans
from d left join g using (r)
"""


@query("op9_blob_ledger", OP9_SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger knows the English blobs from an earlier run; the second run scans what it lacks."""
    docs = table(spark, folder, "documents")
    path = fresh_path(spark, "secret-ledger")
    secrets.begin(spark, path)
    secrets.scan(docs.where("lang = 'en'"), path)
    found = secrets.findings(docs.select("doc_id", "text"), secrets.scan(docs, path)).drop("text")
    told = secrets.label(F.col("spans"))
    return found.select(
        "doc_id",
        *[secrets.count_of(F.col("spans"), k).alias(f"n_{k}") for k in secrets.KINDS],
        F.sha2(told, 256).alias("base_sha256"),
        told.alias("spans"),
    )


SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP10_SQL = f"""
with d as (
  select doc_id, source, row_number() over () as r, coalesce(text, '') as t,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, {SPACES}) <> '') as lines
  from documents),
g as (select r, p, list_slice(w, p, p + 4) as g from (select r, w, unnest(range(1, len(w) - 3)) as p from d)),
rep as (
  select r, count(distinct q) as n from (
    select r, unnest(range(p, p + 5)) as q from (select r, p, count(*) over (partition by r, g) as c from g) where c > 1)
  group by r),
m as (
  select doc_id, source, cast(len(w) as bigint) as n_words,
    cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
    cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, cast(coalesce(n, 0) as bigint) as n_repeat_words
  from d left join rep using (r)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m),
h as (select source, count(*) as n, sum(base_failed::int) as f from b where source is not null group by source),
p as (select sum(f) / sum(n) as mean from h),
v as (select max(mean) as mean, sum(n * pow(f / n - mean, 2)) / sum(n) as var from h, p),
s as (select mean, case when var > 0 then greatest(1.0, mean * (1 - mean) / var - 1) else 1.0 end as strength from v),
verdict as (select source, (f + mean * strength) / (n + strength) > {quality_rules.MAX_HOST_RATE} as rejected from h, s)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not coalesce(rejected, false) as kept
from b left join verdict using (source)
"""


@query("op10_host_rules", OP10_SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    df = quality_rules.judge(table(spark, folder, "documents"), carry=["doc_id"])
    return df.select("doc_id", *quality_rules.MEASURES, "kept")


@query("op1_trie_bpe")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    both = bpe.round_trip(table(spark, folder, "documents").select("doc_id", "text"), path)
    return both.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op6_tree_scoring")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    df = html_text.extracted(table(spark, folder, "pages").select("page_id", "url", "html"))
    return df.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op8_subword_bags")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.trained(docs, table(spark, folder, "labels"))
    df = toxicity.scored(docs.select("doc_id", "text"), model)
    held = F.coalesce(toxicity.held_out(F.col("doc_id")), F.lit(False))
    return df.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


OP3_SQL = f"""
with recursive d as (select doc_id, {WORDS} as w from documents),
s as (
  select distinct doc_id, list_slice(w, p, p + least(5, len(w)) - 1) as g
  from (select *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as p from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
links as (
  select a, b from common join n x on a = x.doc_id join n y on b = y.doc_id
  where c * 1.8 >= 0.8 * (x.n + y.n) - 0.000001),
reach as (select a as doc_id, b as other from links union select r.doc_id, l.b from reach r join links l on r.other = l.a),
class as (select doc_id, least(doc_id, min(other)) as class_id from reach group by doc_id)
select doc_id, coalesce(class_id, doc_id) as class_id, coalesce(k, 0) as n_links
from documents left join class using (doc_id) left join (select a as doc_id, count(*) as k from links group by a) using (doc_id)
"""


@query("op3_bayes_lsh", OP3_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.joined(table(spark, folder, "documents")).select("doc_id", "class_id", "n_links")


OP4_SQL = """
with p as (
  select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as h,
    min(page_id) over (partition by coalesce(html, '')) as first from pages)
select page_id, cast(payload_bytes as bigint) as payload_bytes,
  list_aggregate(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(
    ((('0x' || substr(h, (j // 4) * 5 + 1, 5))::bigint >> (15 - 5 * (j % 4))) & 31) + 1 as bigint), 1)), 'string_agg', '') as payload_digest,
  case when page_id > first then 'revisit' else 'response' end as record_type,
  case when page_id > first then first end as refers_to
from p
"""


@query("op4_capture_histories", OP4_SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    df = warc.histories(table(spark, folder, "pages"))
    return df.select(
        F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to")
    )


OP2_SQL = """
with t as (select distinct conv_id, turn, role, text from conversations),
c as (
  select conv_id, list({'turn': turn, 'role': role, 'text': text} order by turn, role, text) as l,
    string_agg('<|im_start|>' || replace(coalesce(role, 'unknown'), '<|', '< |') || chr(10)
      || replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10), '' order by turn, role, text) as text
  from t group by conv_id),
p as (select distinct list_slice(l, 1, k) as l from (select l, unnest(range(1, len(l))) as k from c)),
m as (select l, min(conv_id) as conv_id, count(*) as n_copies from c where l not in (select l from p) group by l)
select m.conv_id, 0::bigint as segment, cast(len(m.l) as bigint) as n_turns, n_copies, c.text from m join c on c.conv_id is not distinct from m.conv_id
"""


@query("op2_snapshot_collapse", OP2_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return chat.whole(table(spark, folder, "conversations"))


@query("op5_site_bayes")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    df = quality_classifier.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))
    held = F.coalesce(quality_classifier.held_out(F.col("doc_id")), F.lit(False))
    return df.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), (F.col("score") >= 0.5).alias("kept"))


@query("op11_block_whitening")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    df = whitening.whitened(table(spark, folder, "embeddings"))
    each = df.select("vec_id", "n", "deviation", F.posexplode("whitened").alias("at", "whitened"), "explained", "identity_error")
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.get("explained", F.col("at")).alias("explained"), "identity_error")


@query("op12_kmeans_tree")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return kmeans_tree.neighbours(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


OP13_SQL = """
with r as (
  select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
t as (select * from r where len(v) = (select len(v) from r group by 1 order by count(*) desc, 1 desc limit 1)),
n as (select *, row_number() over () as row from t),
s as (
  select a.row as anchor, a.vec_id as anchor_id, a.label = x.label as same, x.vec_id, x.row, cast(list_inner_product(a.v, x.v) as bigint) as score
  from n a join n x on a.vec_id <> x.vec_id or a.label <> x.label where a.vec_id % 100 = 0),
p as (
  select anchor, anchor_id, vec_id as positive_id, score as positive_score, row_number() over (partition by anchor order by score desc, vec_id) as place
  from s where same qualify place <= 5)
select anchor_id, positive_id, cast(row_number() over (partition by p.anchor, place order by score desc, vec_id) as int) as rank,
  vec_id as negative_id, positive_score, score as negative_score
from p join s using (anchor, anchor_id)
where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify rank <= 10
"""


@query("op13_segment_bounds", OP13_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(table(spark, folder, "embeddings"), F.col("id") % 100 == 0, label=label)
