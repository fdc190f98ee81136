"""The queries of the operators in this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import hard_negatives, language, license_scan, mixing, near_dup, piece_bpe, quality, repeats, resample, token_files, url_filter, vectors
from ledgerline.llm.common import shared_dir


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The rules of op2: (verdict, host, path).
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents")).drop("blocks")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.digests(piece_bpe.encode(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"), decoded=True))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write(_table(spark, sf_dir, "documents"), path, _tokenizer("byte_bpe_50k.json"))
    return token_files.read(spark, path).select("doc_id", "start", "n_tokens", token_files.ids_crc32(F.col("ids")).alias("ids_crc32"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id", "source", F.xxhash64("text").alias("hash"))
    return mixing.mix(rows, tie="hash").select("doc_id", "source", "block", "slot", "position")


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.exact_top(_table(spark, sf_dir, "embeddings"), vectors.every(20), k=20)


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(_table(spark, sf_dir, "embeddings"), vectors.every(50), k=5)


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(repeats.remove_repeats(_table(spark, sf_dir, "documents")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").withColumn("label", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)"))
    return hard_negatives.mine(rows, vectors.every(100))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predictions(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_url_filter, op3_sentencepiece, op4_quality_classifier, op5_token_files, op6_source_mixing, op7_exact_topk, op8_minhash_near_dedup,
        op9_vantage_point_search, op10_suffix_array_dedup, op11_hard_negatives, op12_importance_resampling, op13_language_id,
    )
}

ORACLES: dict[str, str] = {
    "op2_url_filter": r"""
with parts as (
  select page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path
  from pages),
rules(v, h, p) as (values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
urls as (select distinct host, path from parts),
ranked as (
  select host, path, v, h || p as rule, row_number() over (partition by host, path order by length(h) desc, length(p) desc) as r
  from urls join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p))
select page_id, parts.host, parts.path, rule, coalesce(v, 'allow') as verdict
from parts left join ranked on parts.host = ranked.host and parts.path = ranked.path and r = 1
""",
    "op6_source_mixing": """
with recursive roots as (select source, cast(round(sqrt(count(*))) as bigint) as root from documents group by source),
weights as (select source, greatest(1, root * 1000 // (select sum(root) from roots))::bigint as p from roots),
listed as (
  select list(source order by source is not null, source) as s, list(p order by source is not null, source) as p, sum(p)::bigint as w from weights),
run(t, done, pick) as (
  select 0::bigint, list_transform(p, lambda x: 0::bigint), 0::bigint from listed
  union all
  select t + 1, list_transform(done, lambda n, i: n + case when i = k then 1 else 0 end), k
  from (
    select t, done, w, (list_min(list_filter(list_transform(p, lambda x, i:
      case when done[i] * w // x <= t then (((done[i] + 1) * w + x - 1) // x) * 100000 + i end), lambda y: y is not null)) % 100000)::bigint as k
    from run, listed) where t < w),
slots as (select s[pick] as source, p[pick] as p, w, t - 1 as place, row_number() over (partition by pick order by t) - 1 as j from run, listed where t > 0),
rows_ as (select doc_id, source, row_number() over (partition by source order by doc_id nulls first) - 1 as n from documents)
select doc_id, r.source, n // 64 as block, (n // 64) // p * w + place as slot, ((n // 64) // p * w + place) * 64 + n % 64 as position
from rows_ r join slots s on r.source is not distinct from s.source and (n // 64) % p = j
""",
    "op7_exact_topk": """
with usable as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
ranked as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score,
    row_number() over (partition by q.vec_id order by list_inner_product(q.v, c.v) desc, c.vec_id) as rank
  from usable q join usable c on q.vec_id != c.vec_id where q.vec_id % 20 = 0)
select query_id, rank::int as rank, vec_id, score from ranked where rank <= 20
""",
    "op11_hard_negatives": """
with usable as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where label is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (
  select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, list_inner_product(a.v, c.v)::bigint as score
  from usable a join usable c on a.vec_id != c.vec_id where a.vec_id % 100 = 0),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scores where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
ranked as (
  select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as rank, vec_id as negative_id, positive_score, score as negative_score
  from positives join scores using (anchor_id) where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from ranked where rank <= 10
""",
    "op12_importance_resampling": r"""
with recursive crc(b, k, c) as (
  select b, 0, b from range(256) r(b) union all select b, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from crc where k < 8),
byte as (select list(c order by b) as t from crc where k = 8),
docs as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as x from documents),
goals as (select translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as x from benchmark),
both_ as (select x, count(*) as copies, 0 as goals from docs group by x union all select x, 0, count(*) from goals group by x),
classes as (select row_number() over () as id, x, sum(copies)::bigint as copies, sum(goals)::bigint as goals from both_ group by x),
words as (select id, regexp_extract_all(x, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from classes),
flat as (select id, unnest(w) as a, unnest(range(0, len(w))) as pos from words),
runs as (
  select id, a, a || ' ' || lead(a, 1) over d as b, a || ' ' || lead(a, 1) over d || ' ' || lead(a, 2) over d as c
  from flat window d as (partition by id order by pos)),
grams as (select id, unnest([a, b, c]) as g from runs),
counted as (select id, g, count(*) as n from grams where g is not null group by id, g),
names as (select distinct g from counted),
codes as (
  select g, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, octet_length(encode(g))), lambda i: ('0x' || substr(hex(encode(g)), 2 * i + 1, 2))::bigint)),
    lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295::bigint) % 10000 as bucket from names, byte),
features as (select id, bucket, sum(n)::bigint as n from counted join codes using (g) group by 1, 2),
buckets as (select bucket, sum(n * copies)::bigint as s, sum(n * goals)::bigint as t from features join classes using (id) group by 1),
totals as (select coalesce(sum(s), 0)::double as s_all, coalesce(sum(t), 0)::double as t_all from buckets),
gains as (select bucket, floor(1000 * ln((t + 1)::double * (s_all + 10000) / ((s + 1)::double * (t_all + 10000))))::bigint as gain from buckets, totals),
weights as (select id, sum(n)::bigint as n_features, sum(n * gain)::bigint as weight from features join gains using (bucket) group by 1),
scored as (
  select doc_id, len(w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score
  from docs join classes using (x) join words using (id) left join weights using (id)),
ranked as (select doc_id, row_number() over (order by score desc, doc_id) as r, 5 * count(*) over () // 100 as drawn from scored where n_words >= 20)
select doc_id, n_features::bigint as n_features, weight::bigint as weight, score::bigint as score, case when r <= drawn then r end as rank
from scored left join ranked using (doc_id)
""",
    "op8_minhash_near_dedup": r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
flat as (select doc_id, len(w) as m, unnest(w) as x, unnest(range(0, len(w))) as pos from words),
grams as (
  select doc_id, m, pos, concat_ws(' ', x, lead(x, 1) over d, lead(x, 2) over d, lead(x, 3) over d, lead(x, 4) over d) as g
  from flat window d as (partition by doc_id order by pos)),
shingles as (select distinct doc_id, md5_number(g) as g from grams where pos <= m - 5 or (m < 5 and pos = 0)),
sets as (select doc_id, coalesce(list_sort(list(g) filter (where g is not null)), []) as s from words left join shingles using (doc_id) group by doc_id),
classes as (select min(doc_id) as node, s, len(s) as n from sets where len(s) > 0 group by s),
each as (select node, n, unnest(s) as g from classes),
links as (
  select a.node as u, b.node as v from each a join each b on a.g = b.g and a.node != b.node group by a.node, b.node, a.n, b.n
  having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach(node, root) as (select node, node from classes union select v, root from reach join links on u = node),
found as (select node, min(root) as component from reach group by node)
select doc_id, len(sets.s) as n_shingles, coalesce(component, doc_id) as component_id, coalesce(component, doc_id) = doc_id as kept
from sets left join classes on sets.s = classes.s left join found using (node)
""",
    "op10_suffix_array_dedup": """
with bytes as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
pieces as (select doc_id, c, substr(h, 128 * c + 1, 226) as part from (select doc_id, h, unnest(range(0, (length(h) + 127) // 128)) as c from bytes)),
windows as (
  select doc_id, 64 * c + j as p, md5_number(substr(part, 2 * j + 1, 100)) as s
  from (select doc_id, c, part, unnest(range(0, 64)) as j from pieces) where length(part) >= 2 * j + 100),
firsts as (select s, min(doc_id) as least from windows group by s),
hits as (select doc_id, p, lag(p) over (partition by doc_id order by p) as before from windows join firsts using (s) where least < doc_id),
runs as (select doc_id, p, sum(case when before is null or p > before + 50 then 1 else 0 end) over (partition by doc_id order by p) as run from hits),
spans as (select doc_id, min(p) as lo, max(p) + 50 as hi from runs group by doc_id, run),
gaps as (select doc_id, lo, hi, coalesce(lag(hi) over (partition by doc_id order by lo), 0) as rest from spans),
kept as (
  select doc_id, count(*) as n_spans, sum(hi - lo)::bigint as n_removed, string_agg(substr(h, 2 * rest + 1, 2 * (lo - rest)), '' order by lo) as front, max(hi) as last
  from gaps join bytes using (doc_id) group by doc_id)
select doc_id, length(h) // 2 as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(coalesce(front || substr(h, 2 * last + 1), h))) as kept_sha256
from bytes left join kept using (doc_id)
""",
}


def _license_sql() -> str:
    """Phrases, lines and word windows as SQL, with the operator's own phrases and templates."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    phrases = ", ".join(f"({quoted(p.split())}, '{label}')" for p, label in license_scan.PHRASES.items())
    templates = ", ".join(f"({i}, {quoted(t.split())}, '{label}')" for i, (t, label) in enumerate(license_scan.TEMPLATES.items()))
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    return f"""
with phrases(p, label) as (values {phrases}), templates(id, w, label) as (values {templates}),
wanted as (select id, label, len(list_distinct(w)) as n, ceil(0.8 * len(list_distinct(w)) - 1e-9) as need, ceil(len(w) / 0.8 - 1e-9) as span from templates),
vocabulary as (select distinct id, unnest(w) as word from templates),
docs as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
words as (select doc_id, t, regexp_extract_all(t, {word}) as w from docs),
places as (
  select doc_id, label, unnest(list_filter(range(0, len(w) - len(p) + 1), lambda i: w[i + 1 : i + len(p)] = p)) as pos
  from words join phrases on contains(' ' || array_to_string(w, ' ') || ' ', ' ' || array_to_string(p, ' ') || ' ')),
base as (select doc_id, count(*) as n_base, min(pos) as first_word, max(pos) as last_word from places group by 1),
hits as (select doc_id, id, word, pos from (select doc_id, unnest(w) as word, unnest(range(0, len(w))) as pos from words) join vocabulary using (word)),
able as (select doc_id, id, n, span, need from (select doc_id, id, count(distinct word) as d from hits group by 1, 2) join wanted using (id) where d >= need),
windows as (
  select doc_id, id, n, need, a.pos, count(distinct b.word) as d from able join hits a using (doc_id, id) join hits b using (doc_id, id)
  where b.pos >= a.pos and b.pos < a.pos + span group by 1, 2, 3, 4, 5),
lines as (select doc_id, unnest(range(0, len(l))) as line, unnest(l) as text from (select doc_id, string_split(t, chr(10)) as l from words where doc_id in (select doc_id from able))),
line_words as (select distinct doc_id, line, unnest(regexp_extract_all(text, {word})) as word from lines),
line_hits as (select doc_id, id, n, need, line, count(*) as d from line_words join vocabulary using (word) join able using (doc_id, id) group by 1, 2, 3, 4, 5),
met as (
  select doc_id, id, max(d) / any_value(n) as c from (select doc_id, id, n, need, d from windows union all select doc_id, id, n, need, d from line_hits) where d >= need group by 1, 2),
best as (select doc_id, max(c) as c from met group by 1),
all_labels as (select doc_id, label from places union select doc_id, label from met join wanted using (id)),
joined as (select doc_id, string_agg(label, ',' order by label) as labels from all_labels group by 1),
base_joined as (select doc_id, string_agg(distinct label, ',' order by label) as base_labels from places group by 1)
select doc_id, len(w) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
  case when n_base > 0 then 1.0::double else coalesce(c, 0.0)::double end as score
from words left join base using (doc_id) left join best using (doc_id) left join joined using (doc_id) left join base_joined using (doc_id)
"""


ORACLES["op1_license_scan"] = _license_sql()
