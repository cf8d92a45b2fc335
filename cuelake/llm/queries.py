"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm import htmltext, kmeans, langid, mixing, nndescent, packing, pii, repeats, sharding, simhash, spans, spelling, topk
from cuelake.llm.common import table

SHARDS, SLOTS, ENTROPY_SHARE, SEED = [f"shard-{k:02d}" for k in range(32)], 3203, 0.97, 17
CLUSTERS, DIMS, ROUNDS = 16, 64, 3


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id", "source"), SHARDS, SLOTS).select("doc_id", "source", "slot", "shard", "shard_name")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, x: n + (x["last"] - x["first"]))
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans.drop_repeated_spans(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words_removed", "n_pieces_removed", F.length("text").cast("bigint").alias("n_chars_kept"), F.md5(F.col("text").cast("binary")).alias("kept_md5"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.visible_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    plan = mixing.mixing_plan(docs, entropy_share=ENTROPY_SHARE, seed=SEED)
    return mixing.mix(docs, plan, seed=SEED).select("doc_id", "source", "block", mixing.permutation_key(F.col("doc_id"), SEED).alias("permutation_key"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.cluster(table(spark, sf_dir, "embeddings"), CLUSTERS, DIMS, ROUNDS).drop("n_scans")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), every=31).select("word", "form", "root", "n", "n_near", "form_n")


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")))


SHARDING_SQL = f"""
with recursive names as (
  select cast(k as integer) as shard, 'shard-' || lpad(cast(k as varchar), 2, '0') as shard_name from range({len(SHARDS)}) r(k)
), prefs as (
  select shard, shard_name,
         cast('0x' || substr(md5(shard_name || ':offset'), 1, 12) as bigint) % {SLOTS} as pos,
         cast('0x' || substr(md5(shard_name || ':step'), 1, 12) as bigint) % {SLOTS - 1} + 1 as step
  from names
), lists as (
  select list([pos, step] order by shard) as pref from prefs
), turns as (
  select cast(0 as bigint) as turn, cast([] as bigint[]) as claimed
  union all
  select turn + 1,
         list_append(claimed, list_filter(list_transform(range({SLOTS}), lambda j: (pref[turn % {len(SHARDS)} + 1][1] + j * pref[turn % {len(SHARDS)} + 1][2]) % {SLOTS}),
                                          lambda s: not list_contains(claimed, s))[1])
  from turns, lists where turn < {SLOTS}
), filled as (
  select unnest(claimed) as slot, unnest(range({SLOTS})) % {len(SHARDS)} as shard from turns where turn = {SLOTS}
)
select d.doc_id, d.source, f.slot, cast(f.shard as integer) as shard, n.shard_name
from documents d
join filled f on f.slot = cast('0x' || substr(md5(coalesce(cast(d.doc_id as varchar), '')), 1, 12) as bigint) % {SLOTS}
join names n on n.shard = f.shard
"""

MIXING_SQL = f"""
with recursive sized as (
  select doc_id, source, md5(coalesce(cast(doc_id as varchar), '') || ':{SEED}') as key,
         coalesce(len(regexp_extract_all(text, '[^ \\t\\r\\n]+')), 0) as tokens
  from documents
), totals as (
  select source, cast(sum(tokens) as bigint) as tokens from sized group by source having sum(tokens) > 0
), shares as (
  select list(tokens / cast((select sum(tokens) from totals) as double) order by source) as s from totals
), bisect as (
  select 0 as step, cast(0.0 as double) as low, cast(1.0 as double) as high
  union all
  select step + 1,
         case when ln(list_sum(list_transform(s, lambda x: pow(x, (low + high) / 2)))) - (low + high) / 2
                   * list_sum(list_transform(s, lambda x: pow(x, (low + high) / 2) * ln(x))) / list_sum(list_transform(s, lambda x: pow(x, (low + high) / 2)))
                   >= {ENTROPY_SHARE} * ln(len(s)) then (low + high) / 2 else low end,
         case when ln(list_sum(list_transform(s, lambda x: pow(x, (low + high) / 2)))) - (low + high) / 2
                   * list_sum(list_transform(s, lambda x: pow(x, (low + high) / 2) * ln(x))) / list_sum(list_transform(s, lambda x: pow(x, (low + high) / 2)))
                   >= {ENTROPY_SHARE} * ln(len(s)) then high else (low + high) / 2 end
  from bisect, shares where step < {mixing.STEPS}
), chosen as (
  select case when ln(list_sum(s)) - list_sum(list_transform(s, lambda x: x * ln(x))) / list_sum(s) >= {ENTROPY_SHARE} * ln(len(s))
              then 1.0 else round((select low from bisect where step = {mixing.STEPS}), 6) end as alpha
  from shares
), weights as (
  select source, tokens, pow(tokens / cast((select sum(tokens) from totals) as double), alpha) as p from totals, chosen
), plan as (
  select source, tokens, cast(floor(p / (select sum(p) from weights) * (select sum(tokens) from totals)) as bigint) as budget from weights
), keyed as (
  select source, key, sum(tokens) as tokens from sized group by source, key
), placed as (
  select source, key, coalesce(sum(tokens) over (partition by source order by key rows between unbounded preceding and 1 preceding), 0) as before from keyed
), used as (
  select p.source, k.key, cast(p.budget // p.tokens as integer) + case when k.before < p.budget % p.tokens then 1 else 0 end as uses
  from plan p join placed k on k.source = p.source
)
select d.doc_id, d.source, cast(unnest(range(u.uses)) as integer) as block, d.key as permutation_key
from sized d join used u on u.source = d.source and u.key = d.key where u.uses > 0
"""

TOPK_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v
  from embeddings
  where embedding is not null and vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(cast(q.v as double[]), cast(c.v as double[])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 20 = 0
), ranked as (
  select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 20
"""

def _nearest(r: int) -> str:
    """Vectors assigned to the centroids of round ``r``, and what these become."""
    return f"""
), a{r} as materialized (
  select r, vec_id, v, c, d from (
    select v.*, c.c, d, row_number() over (partition by v.r order by d, c.c) as k
    from v, c{r} c, lateral (select cast(list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as bigint) as d) x
  ) where k = 1"""


def _moved(r: int) -> str:
    return f"""
), s{r} as (
  select c, i, cast(sum(x) as bigint) as total, count(*) as n from (select c, unnest(v) as x, unnest(range({DIMS})) as i from a{r}) group by c, i
), c{r + 1} as materialized (
  select c.c, coalesce(m.v, c.v) as v from c{r} c
  left join (select c, list((total - ((total % n) + n) % n) // n order by i) as v from s{r} group by c) m on m.c = c.c"""


CLUSTER_SQL = (
    f"""
with v as materialized (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v
  from embeddings
  where embedding is not null and len(embedding) = {DIMS} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), c0 as materialized (
  select cast(row_number() over (order by h, v) - 1 as integer) as c, v
  from (select v, sha256('1:' || cast(vec_id as varchar)) as h from v order by h, v limit {CLUSTERS})"""
    + "".join(_nearest(r) + _moved(r) for r in range(ROUNDS))
    + _nearest(ROUNDS)
    + f"""
)
select a.vec_id, a.c as cluster, a.d as distance, cast(sum(a.d) over (partition by a.c) as bigint) as cluster_inertia,
       cast(sum(a.d) over () as bigint) as inertia, sha256(array_to_string(c.v, ',')) as centroid_sha256
from a{ROUNDS} a join c{ROUNDS} c on c.c = a.c
"""
)

#: the checksum is taken byte by byte over a table of 256 numbers, which is made here by its rule
SPELLING_SQL = """
with recursive bits as (
  select cast(i as bigint) as i, cast(i as bigint) as x, 0 as step from range(256) t(i)
  union all
  select i, case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end, step + 1 from bits where step < 8
), crc as (
  select list(x order by i) as t from bits where step = 8
), runs as (
  select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run
  from documents
), counted as (
  select coalesce(cast(doc_id as varchar), '') || ':' || run as line, run, count(*) as n from runs where length(run) >= 7 group by all
), hashed as (
  select run, n, xor(list_reduce(list_transform(range(octet_length(encode(line))), lambda i: cast('0x' || hex(encode(line))[2 * i + 1 : 2 * i + 2] as bigint)),
                                 lambda acc, b: xor(acc >> 8, t[(xor(acc, b) & 255) + 1]), cast(4294967295 as bigint)), 4294967295) as h
  from counted, crc
), spelt as (
  select case when h % 31 = 0 then substr(run, 1, cast(h % length(run) as bigint)) || substr(run, cast(h % length(run) as bigint) + 2) else run end as word, n from hashed
), words as materialized (
  select word, cast(sum(n) as bigint) as n from spelt where length(word) >= 7 group by word having sum(n) >= 2
), cut as (
  select word, n, i, substr(word, 1, i) || substr(word, i + 2) as rest from words, lateral (select unnest(range(length(word))) as i) x
), near as (
  select a.word, b.word as near, b.n from cut a join cut b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union
  select a.word, b.word, b.n from cut a join words b on a.rest = b.word
  union
  select b.word, a.word, a.n from cut a join words b on a.rest = b.word
), best as (
  select word, count(*) as n_near, first(near order by n desc, encode(near)) as near, max(n) as near_n from near group by word
), formed as materialized (
  select w.word, w.n, coalesce(b.n_near, 0) as n_near, case when b.near_n >= 10 * w.n then b.near end as form, case when b.near_n >= 10 * w.n then b.near_n end as form_n
  from words w left join best b on b.word = w.word
), chain as (
  select word, word as here, 0 as step from formed
  union all
  select c.word, f.form, step + 1 from chain c join formed f on f.word = c.here where f.form is not null
)
select f.word, f.form, r.root, f.n, f.n_near, f.form_n
from formed f join (select word, arg_max(here, step) as root from chain group by word) r on r.word = f.word
"""

QUERIES = {f.__name__: f for f in (op1_language_id, op2_packing, op3_simhash_dedup, op4_sharding, op5_embedding_dedup, op6_suffix_dedup, op7_span_dedup, op8_html_text, op9_exact_topk, op10_mixing, op11_centroid_clusters, op12_spelling_variants, op13_personal_data)}

ORACLES = {"op4_sharding": SHARDING_SQL, "op9_exact_topk": TOPK_SQL, "op10_mixing": MIXING_SQL, "op11_centroid_clusters": CLUSTER_SQL, "op12_spelling_variants": SPELLING_SQL}
