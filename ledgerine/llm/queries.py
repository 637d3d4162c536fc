"""The registered queries of this subpackage and their SQL. Each applies an operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, linededup, minhash, mixing, mjpeg, negatives, packing, pieces, pivots, runs, sharding, suffix, urlfilter


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_binary(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), keep_ids=False)


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "inherited")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return sharding.shuffle_shards(docs, 16).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, ~langid.held_out())
    return langid.predict(docs.select("doc_id", langid.held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op8_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_path("piece_bpe_32k.model")
    out = pieces.decode_pieces(pieces.encode_sampled(table(spark, sf_dir, "documents"), model), model)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


def op10_media_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mjpeg.decode_avi(mjpeg.to_avi(table(spark, sf_dir, "documents")))
    firsts = F.array_join(F.transform("shots", lambda s: s["start_frame"].cast("string")), ",")
    feature = F.concat(F.lit("frames="), F.col("frames"), F.lit(";seconds="), F.format_string("%.2f", "seconds"), F.lit(";shots="), F.size("shots"), F.lit(";starts_md5="), F.md5(firsts.cast("binary")))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_, label = F.col("vec_id"), F.col("label").cast("long")
    moved = F.when(id_ % 7 == 0, (label + 1) % 10).otherwise(label)
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), id_ % 100 == 0)


def repeating(text: Column, doc_id: Column) -> Column:
    """Every tenth document by hash ends with words that repeat with one period."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[ \t-\r]+"), lambda x: x != "")
    n = F.greatest(F.size(words), F.lit(1))  # a text without words is left alone below
    start = (g % n).cast("int")
    period = (1 + F.floor((n - start) / (3 + g % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, start + 1, period), F.ceil((n - start) / period).cast("int")))
    own = F.concat(F.slice(words, F.lit(1), start), F.slice(again, F.lit(1), n - start))
    return F.when((h % 10 == 0) & text.rlike(r"[^ \t-\r]"), F.array_join(own, " ")).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", repeating(F.col("text"), F.col("doc_id")).alias("text"))
    out = runs.collapse_runs(docs)
    longest = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(0))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(F.lit(""))
    out = out.withColumn("r", longest).withColumns({"start": F.col("r.start"), "length": -F.col("r.n"), "period": F.col("r.period")})
    digest = lambda c: F.sha2(F.encode(F.coalesce(c, F.lit("")), "UTF-8"), 256)
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "start", "length", "period", F.floor(1000 * F.col("length") / F.col("period")).alias("exponent_milli"), digest(listed).alias("runs_sha256"), digest(F.col("text")).alias("collapsed_sha256"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.rates(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_packing, op2_embedding_dedup, op3_url_filter, op4_suffix_dedup, op5_sharding, op6_minhash_dedup, op7_language_id, op8_piece_sampling, op9_line_dedup, op10_media_avi, op11_hard_negatives, op12_periodic_runs, op13_mixing)
}

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOW = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

SQL: dict[str, str] = {
    "op2_embedding_dedup": """
with recursive v as (
  select vec_id, label, cast(embedding as double[]) as e from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
low as (select a, least(a, min(b)) as c from reach group by a),
n as (select a, count(*) as n from links group by a)
select e.vec_id, cast(coalesce(n.n, 0) as bigint) as n_links, coalesce(low.c, e.vec_id) as component_id, coalesce(low.c, e.vec_id) = e.vec_id as kept
from embeddings e left join low on low.a = e.vec_id left join n on n.a = e.vec_id""",
    # The tables' pages declare no canonical links or redirects, so no verdict is inherited there.
    "op3_url_filter": f"""
with p as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as r from pages),
q as (select page_id, translate(regexp_extract(r, '^[^/?#]*'), {_LOW}) as host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from p),
rules(h, p, v) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
best as (
  select q.page_id, arg_max(h || p, length(h || p)) as rule, arg_max(v, length(h || p)) as v from q join rules
  on (q.host = h or ends_with(q.host, '.' || h)) and starts_with(q.path, p) group by q.page_id)
select q.page_id, q.host, q.path, best.rule, coalesce(best.v, 'allow') as verdict, false as inherited from q left join best using (page_id)""",
    "op6_minhash_dedup": f"""
with recursive w as (select doc_id, regexp_extract_all(translate(text, {_LOW}), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (
  select doc_id, unnest(list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end)) as s from w),
n as (select doc_id, count(*) as n from s group by doc_id),
both_ as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
half as (select a, b from both_ join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 85 * (x.n + y.n - i)),
links as (select a, b from half union all select b, a from half),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
low as (select a, least(a, min(b)) as c from reach group by a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(low.c, d.doc_id) as component_id, coalesce(low.c, d.doc_id) = d.doc_id as kept
from documents d left join n on n.doc_id = d.doc_id left join low on low.a = d.doc_id""",
    "op9_line_dedup": f"""
with d as (select doc_id, str_split(coalesce(text, ''), chr(10)) as l from documents),
x as (select doc_id, unnest(range(1, len(l) + 1)) as i, unnest(l) as line from d),
k as (select doc_id, i, line, translate(trim(line, {_SPACE}), {_LOW}) as key from x),
often as (select key, max(doc_id) as last from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
m as (select k.doc_id, k.i, k.line, o.key is not null and o.last <> k.doc_id as gone from k left join often o on o.key = k.key)
select doc_id, count(*) as n_lines, cast(sum(gone::int) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from m group by doc_id""",
    "op11_hard_negatives": """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, cast(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) as bigint) as score
  from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id and len(a.q) = len(b.q)),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, cast(row_number() over w as integer) as rank, s.vec_id as negative_id, positive_score, s.score as negative_score
from p join s using (anchor_id) where not same and 80 * positive_score <= 100 * s.score and 100 * s.score <= 100 * positive_score
window w as (partition by anchor_id, positive_id order by s.score desc, s.vec_id) qualify row_number() over w <= 5""",
    # The water level in closed form: sources stop in the order of their bound over their weight.
    "op13_mixing": """
with d as (select doc_id, source, text, cast(len(list_filter(str_split_regex(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '')) as bigint) as size from documents),
s as (select source, cast(sum(size) as bigint) as n, row_number() over (order by source nulls last) as i from d group by source),
w as (select *, (i - 1) % 3 + 1 as w, 3 * n / ((i - 1) % 3 + 1) as stop from s),
c as (select *, (select sum(n) from s) - coalesce(sum(3 * n) over (order by stop, i rows between unbounded preceding and 1 preceding), 0) as rest,
  sum(w) over (order by stop, i rows between current row and unbounded following) as weights from w),
first as (select rest, weights from c where rest * w <= 3 * n * weights order by stop, i limit 1),
t as (select source, n, least(cast(cast(w * (select rest from first) as bigint) as double) / cast((select weights from first) as double), cast(3 * n as double)) as target from w),
r as (select *, case when n > 0 then least(target / n, 3.0::double) else 0.0::double end as rate from t)
select doc_id, size, n as source_size, target, size * cast(floor(rate) + (cast(cast('0x' || substr(md5('0/' || coalesce(cast(doc_id as varchar), '') || '/' || coalesce(text, '')), 1, 13) as bigint) as double) / 4503599627370496.0::double < rate - floor(rate))::int as bigint) as taken
from d join r on d.source is not distinct from r.source""",
}
