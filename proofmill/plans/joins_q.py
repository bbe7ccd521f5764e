"""J: joins and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes, vectors as V
from ..functions import text as X
from ..functions.numeric import row_count
from ..operators import matching as M
from ..operators import rules as R
from ..operators import similarity as S
from ..operators.skew import Sequenced
from ..sources import load
from .common import OBS_DUCK, observations
from .registry import query



@query("j01_fk_rollout", """
select o.o_orderkey, c.c_name, count(l.l_orderkey) as analyses, count(*) filter (where l_returnflag = 'R') as completed,
  count(distinct l_suppkey) as engines, round(coalesce(sum(l_quantity), 0), 2) as total
from orders o left join customer c on o_custkey = c_custkey left join lineitem l on l_orderkey = o_orderkey group by all""")
def fk_rollout(spark, d):
    child = load(spark, d, "lineitem").groupBy("l_orderkey").agg(
        row_count().alias("analyses"), F.count_if(F.col("l_returnflag") == "R").alias("completed"),
        F.countDistinct("l_suppkey").alias("engines"), F.sum("l_quantity").alias("total"))
    orders, customer = load(spark, d, "orders"), load(spark, d, "customer")
    out = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left") \
        .join(child, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return out.select("o_orderkey", "c_name", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("analyses", "completed", "engines")],
                      F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"))


@query("j02_pair_totals", """
select a.s_nationkey, (select count(*) from supplier s where s.s_nationkey = a.s_nationkey) as items, count(*) as pairs,
  round(sum(abs(a.s_acctbal - b.s_acctbal)), 2) as abs_diff_sum, round(sum(a.s_acctbal * b.s_acctbal), 2) as product_sum
from supplier a join supplier b on a.s_nationkey = b.s_nationkey and a.s_suppkey < b.s_suppkey group by all""")
def pair_totals(spark, d):
    out = M.pair_totals(load(spark, d, "supplier"), ["s_nationkey"], "s_acctbal", "s_suppkey").where("pairs > 0")
    return out.select("s_nationkey", "items", "pairs", F.round("abs_diff_sum", 2).alias("abs_diff_sum"),
                      F.round("product_sum", 2).alias("product_sum"))


@query("j03_exact_duplicates", """
with g as (select sha256(text) as h, min(doc_id) as item_a, count(*) as group_size from documents group by 1 having count(*) > 1)
select item_a, doc_id as item_b, group_size, 'EXACT_BITSTREAM' as relation_kind from documents join g on sha256(text) = h where doc_id > item_a""")
def exact_duplicates(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return M.duplicate_links(docs, "doc_id", "h")


_ONES = ", ".join(f"sum((v >> {b}) & 1) as o{b}" for b in range(64))
_BITS = ", ".join(f"case when 2 * o{b} >= shingles then '1' else '0' end" for b in range(64))
SIGNATURE_SQL = f"""with wd as (select doc_id, n_chars, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
hd as (select doc_id, n_chars, len(w) as words, list_transform(w, lambda x: md5_number_lower(x)) as h from wd where len(w) > 0),
sh as (select doc_id, n_chars, words, unnest(list_distinct(list_transform(range(1, greatest(words - 2, 1) + 1), lambda i: xor(h[i], xor(
  coalesce((h[i + 1] >> 43) | ((h[i + 1] & 8796093022207) << 21), 0::ubigint), coalesce((h[i + 2] >> 22) | ((h[i + 2] & 4194303) << 42), 0::ubigint)))))) as v from hd),
on1 as (select doc_id, n_chars, words, count(*) as shingles, {_ONES} from sh group by 1, 2, 3),
bits as (select doc_id, n_chars::double / words as aspect, concat({_BITS}) as h from on1 where shingles >= 8),
rep as (select h, aspect, min(doc_id) as id, count(*) as copies from bits group by all)"""
NEAR_SQL = f"""{SIGNATURE_SQL}
select a.id as item_a, b.id as item_b, hamming(a.h, b.h)::integer as distance, a.copies as copies_a, b.copies as copies_b,
  'POSSIBLE_DERIVATIVE' as relation_kind
from rep a join rep b on a.id < b.id and hamming(a.h, b.h) <= 3
  and abs(a.aspect - b.aspect) / greatest(a.aspect, b.aspect, 1e-6) <= 0.015"""


def document_signatures(spark, d):
    """doc_id, 64-bit signature of word shingles, aspect (characters per word), texture (distinct shingles)."""
    docs = load(spark, d, "documents").select("doc_id", "n_chars", S.shingle_signature(F.col("text")).alias("s"))
    return docs.select("doc_id", F.col("s.h").alias("h"), (F.col("n_chars") / F.col("s.words")).alias("aspect"), F.col("s.shingles").alias("texture"))


def near_documents(spark, d, hot=5_000, signatures=None):
    sig = document_signatures(spark, d).where("texture >= 8") if signatures is None else signatures
    reps = S.collapse(sig, "doc_id", ["h", "aspect"])
    reps = reps.withColumn("aspect_band", S.ratio_band(F.col("aspect"), 0.015))
    pairs = S.hamming_pairs(reps, "doc_id", "h", ["aspect", "copies"], max_dist=3, hot=hot, band="aspect_band")
    return pairs.where(boxes.aspect_delta(F.col("aspect_a"), F.col("aspect_b")) <= 0.015) \
        .select("item_a", "item_b", "distance", "copies_a", "copies_b", F.lit("POSSIBLE_DERIVATIVE").alias("relation_kind"))


@query("j04_near_duplicate_documents", NEAR_SQL)
def near_duplicate_documents(spark, d):
    return near_documents(spark, d)


DHASH_SQL = """with b as (select vec_id, list_transform(range(0, 16), lambda i: embedding[4 * i + 1]::double + embedding[4 * i + 2]::double
    + embedding[4 * i + 3]::double + embedding[4 * i + 4]::double) as g from embeddings),
h as (select min(vec_id) as id, count(*) as copies, list_aggregate(list_transform(range(1, 16), lambda i: case when g[i + 1] >= g[i] then '1' else '0' end), 'string_agg', '') as h
  from b group by 3)"""


@query("j04_near_duplicate_vectors", f"""{DHASH_SQL}
select a.id as item_a, b.id as item_b, hamming(a.h, b.h)::integer as distance, a.copies as copies_a, b.copies as copies_b
from h a join h b on a.id < b.id and hamming(a.h, b.h) <= 3""")
def near_duplicate_vectors(spark, d):
    """Vectors reduced to 16 block sums, then a 15-bit difference hash: at most 32,768 distinct values."""
    e = F.col("embedding")
    sums = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: sum(
        (F.element_at(e, 4 * i + j).cast("double") for j in (2, 3, 4)), F.element_at(e, 4 * i + 1).cast("double")))
    hashes = load(spark, d, "embeddings").select("vec_id", sums.alias("g")).select("vec_id", V.difference_hash(F.col("g")).alias("h"))
    return S.hamming_pairs(S.collapse(hashes, "vec_id", ["h"]), "vec_id", "h", ["copies"], max_dist=3)


@query("j05_match_class", """
select kind, count(*) as n, sum(l_orderkey)::bigint as key_sum from (select l_orderkey,
  case when l_returnflag = 'R' and l_quantity = 50 then 'EXACT_BITSTREAM' when l_quantity >= 12 and l_discount * 5 >= 0.35 then 'LIKELY_DERIVATIVE'
    when l_linenumber <= 3 and l_tax / 4 <= 0.015 and l_extendedprice / 1000 >= 8 then 'POSSIBLE_DERIVATIVE' else 'NONE' end as kind from lineitem) group by all""")
def match_class(spark, d):
    kind = M.classify_match((F.col("l_returnflag") == "R") & (F.col("l_quantity") == 50), F.col("l_quantity"), F.col("l_discount") * 5,
                            F.col("l_linenumber"), F.col("l_tax") / 4, F.col("l_extendedprice") / 1000)
    return load(spark, d, "lineitem").groupBy(F.coalesce(kind, F.lit("NONE")).alias("kind")).agg(row_count().alias("n"), F.sum("l_orderkey").alias("key_sum"))


CLUSTER_SQL = """with c as (select p_brand, p_type, p_size, count(*) as members, min(p_partkey) as first_member, max(p_partkey) as last_member
  from part group by 1, 2, 3 having count(*) >= 2)
select c.*, printf('CAM-CLUSTER-%03d', row_number() over (order by first_member)) as cluster_id from c"""


@query("j06_shared_hardware", CLUSTER_SQL)
def shared_hardware(spark, d):
    parts = load(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    return M.shared_key_clusters(parts.withColumn("p_size", F.col("p_size").cast("string")), "p_partkey",
                                 ["p_brand", "p_type", "p_size"]).withColumn("p_size", F.col("p_size").cast("int"))


@query("j06_shared_hardware_members", f"""select p_partkey, cluster_id from part p join ({CLUSTER_SQL}) c
  on p.p_brand = c.p_brand and p.p_type = c.p_type and p.p_size = c.p_size""")
def shared_hardware_members(spark, d):
    parts = load(spark, d, "part").select("p_partkey", "p_brand", "p_type", F.col("p_size").cast("string").alias("p_size"))
    clusters = M.shared_key_clusters(parts, "p_partkey", ["p_brand", "p_type", "p_size"])
    return parts.join(clusters.select("p_brand", "p_type", "p_size", "cluster_id"), ["p_brand", "p_type", "p_size"]).select("p_partkey", "cluster_id")


def positioned(spark, d):
    """Embeddings as descriptors on a 25-wide lattice with step 8."""
    return load(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), "embedding", "label", (F.col("vec_id") % 25 * 8).alias("x"),
        F.floor(F.col("vec_id") / 25).alias("y_cell")).withColumn("y", F.col("y_cell") * 8)


POS_SQL = "select vec_id as id, embedding::double[] as v, vec_id % 25 * 8 as x, vec_id // 25 * 8 as y from embeddings"


@query("j07_knn_ratio", f"""
with p as ({POS_SQL}), d as (select a.id as q, b.id as n, list_distance(a.v, b.v) as dist, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) as sp
  from p a join p b on a.id <> b.id),
r as (select *, row_number() over (partition by q order by dist, n) as rn, lead(dist) over (partition by q order by dist, n) as d2 from d)
select least(q, n) as item_a, greatest(q, n) as item_b, round(min(dist), 6) as distance, round(min(d2), 6) as second
from r where rn = 1 and dist < 0.95 * d2 and sp >= 16 group by 1, 2""")
def knn_ratio(spark, d):
    items = positioned(spark, d).select("id", F.col("embedding").alias("vec"), "x", "y")
    out = S.ratio_matches(items, 0.95, min_spatial=16.0)
    return out.select("item_a", "item_b", F.round("distance", 6).alias("distance"), F.round("second", 6).alias("second"))


@query("j08_mutual_nearest", """
with h as (select vec_id, label, list_aggregate(list_transform(range(1, 65), lambda i: case when embedding[i] >= 0 then '1' else '0' end), 'string_agg', '') as h from embeddings),
p as (select a.label as la, b.label as lb, a.vec_id as a, b.vec_id as b, hamming(a.h, b.h) as dist from h a join h b on a.label < b.label),
fa as (select *, row_number() over (partition by lb, a order by dist, b) as ra, row_number() over (partition by la, b order by dist, a) as rb from p)
select la as set_a, lb as set_b, count(*) as shared, case when count(*) > 20 then 'ELEVATED' else 'MODERATE' end as confidence
from fa where ra = 1 and rb = 1 and dist < 26 group by all having count(*) > 8""")
def mutual_nearest(spark, d):
    items = load(spark, d, "embeddings").select(F.col("label").alias("set"), F.col("vec_id").alias("id"), V.sign_hash(F.col("embedding")).alias("bits"))
    sets = items.select("set").distinct()
    pairs = sets.select(F.col("set").alias("set_a"), F.lit(0).alias("case")).join(
        sets.select(F.col("set").alias("set_b"), F.lit(0).alias("case")), "case").where("set_a < set_b").drop("case")
    shared = S.mutual_nearest(items, pairs, 26).groupBy("set_a", "set_b").agg(row_count().alias("shared")).where("shared > 8")
    return shared.withColumn("confidence", F.when(F.col("shared") > 20, "ELEVATED").otherwise("MODERATE"))


SORTED_SQL = f"""with p as ({POS_SQL}), u as (select id, x, y, list_transform(v, lambda e: e / sqrt(list_inner_product(v, v))) as v from p),
s as (select *, row_number() over (order by v, id) as rn from u),
q as (select a.id as ai, a.x as ax, a.y as ay, b.id as bi, b.x as bx, b.y as by_, list_inner_product(a.v, b.v) as sim,
  sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) as sp from s a join s b on b.rn between a.rn + 1 and a.rn + 15),
m as (select case when ax < bx or (ax = bx and ay <= by_) then [ai, ax, ay, bi, bx, by_] else [bi, bx, by_, ai, ax, ay] end as w, sim, sp from q where sp >= 32 and sim >= 0.1)"""


def sorted_pairs(spark, d):
    items = positioned(spark, d).select("id", V.unit(F.col("embedding")).alias("vec"), "x", "y")
    return S.sorted_neighbours(items, window=15, min_spatial=32.0, min_similarity=0.1)


@query("j09_sorted_neighbours", f"{SORTED_SQL} select w[1] as source, w[4] as target, round(sim, 4) as similarity, round(sp, 2) as spatial from m")
def sorted_neighbours(spark, d):
    return sorted_pairs(spark, d).select(F.col("src.id").alias("source"), F.col("dst.id").alias("target"),
                                         F.round("similarity", 4).alias("similarity"), F.round("spatial", 2).alias("spatial"))


@query("j10_displacement_votes", f"""{SORTED_SQL},
b as (select (round((w[5] - w[2]) / 8.0) * 8)::bigint as bin_x, (round((w[6] - w[3]) / 8.0) * 8)::bigint as bin_y, * from m),
g as (select bin_x, bin_y, count(*) as support, round(avg(sim), 6) as mean_similarity, min(w[2]) as src_x1, min(w[3]) as src_y1,
  max(w[2]) + 16 as src_x2, max(w[3]) + 16 as src_y2, min(w[5]) as dst_x1, min(w[6]) as dst_y1, max(w[5]) + 16 as dst_x2, max(w[6]) + 16 as dst_y2 from b group by 1, 2)
select *, round((select max(support) from g)::double / (select sum(support) from g), 6) as consistency from g where support >= 3""")
def displacement_votes(spark, d):
    out = S.displacement_votes(sorted_pairs(spark, d), step=8, minimum=3, block=16)
    return out.withColumn("mean_similarity", F.round("mean_similarity", 6)).withColumn("consistency", F.round("consistency", 6))


@query("j11_paired_versions", """
with a as (select *, l_extendedprice as va from lineitem where l_linenumber <> 7),
b as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice * (1 - l_discount) * (1 + l_tax) as vb from lineitem where l_linenumber <> 1),
j as (select a.va, b.vb from a full join b on a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber and a.l_partkey = b.l_partkey and a.l_suppkey = b.l_suppkey)
select count(*) filter (where va is not null and vb is not null) as both_sides, count(*) filter (where vb is null) as only_a, count(*) filter (where va is null) as only_b,
  round(avg(abs(va - vb)), 4) as mean_abs_change, round(max(abs(va - vb)), 6) as max_abs_change from j""")
def paired_versions(spark, d):
    li = load(spark, d, "lineitem")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    a = li.where("l_linenumber <> 7").withColumn("v", F.col("l_extendedprice"))
    b = li.where("l_linenumber <> 1").withColumn("v", F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")))
    j = M.paired(a, b, keys, "v")
    va, vb = F.col("value_a"), F.col("value_b")
    return j.agg(F.count_if(va.isNotNull() & vb.isNotNull()).alias("both_sides"), F.count_if(vb.isNull()).alias("only_a"),
                 F.count_if(va.isNull()).alias("only_b"), F.round(F.avg(F.abs(va - vb)), 4).alias("mean_abs_change"),
                 F.round(F.max(F.abs(va - vb)), 6).alias("max_abs_change"))  # a product of three two-decimal values has six decimals


BOX_SQL = """with e as (select event_id, user_id, event_type, epoch_us(ts) / 6e7 as x1, value as y1 from events),
p as (select * from e where event_type in ('view', 'click')), t as (select * from e where event_type in ('purchase', 'signup')),
i as (select p.event_id, greatest(least(p.x1, t.x1) + 720 - greatest(p.x1, t.x1), 0) * greatest(least(p.y1, t.y1) + 40 - greatest(p.y1, t.y1), 0) as inter
  from p join t on p.user_id = t.user_id),
u as (select event_id, inter / (2 * 720 * 40 - inter) as iou from i)"""


def event_boxes(spark, d):
    """Every event as a box of 12 hours by 40 units on its user's plane."""
    e = load(spark, d, "events")
    x1, y1 = X.epoch_us(F.col("ts")) / 6e7, F.col("value")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("item"), "event_type",
                    boxes.corners(x1, y1, x1 + 720.0, y1 + 40.0).alias("box"))


@query("j12_box_matches", f"""{BOX_SQL}
select p.event_id as id, p.user_id as item, round(coalesce(max(iou), 0), 6) as best_iou, count(*) filter (where iou > 0.3) as matches,
  coalesce(max(iou), 0) > 0.3 as matched from p left join u on p.event_id = u.event_id group by all""")
def box_matches(spark, d):
    b = event_boxes(spark, d)
    out = M.box_matches(b.where(F.col("event_type").isin("view", "click")), b.where(F.col("event_type").isin("purchase", "signup")))
    return out.withColumn("best_iou", F.round("best_iou", 6))


RANK_SQL = """with x as (select vec_id, label, unnest(embedding::double[]) as v, unnest(range(1, 65)) as pos from embeddings),
ref as (select label, pos, avg(v) as m from x group by 1, 2),
s as (select x.vec_id, any_value(x.label) as own, r.label, corr(x.v, r.m) as score from x join ref r on x.pos = r.pos group by x.vec_id, r.label),
k as (select *, row_number() over (partition by vec_id order by score desc, label) as rn, lead(score) over (partition by vec_id order by score desc, label) as second from s)"""


def label_means(spark, d):
    """One mean pattern per label, as an array."""
    x = load(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "v"))
    means = x.groupBy("label", "pos").agg(F.avg("v").alias("m"))
    return means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("p")).select("label", F.col("p.m").alias("vec"))


@query("j13_reference_ranking", f"""{RANK_SQL}
select vec_id, label as top_reference, round(score, 4) as score, round(second, 4) as second_score, round(score - second, 4) as gap,
  case when score >= 0.35 then 'CONSISTENT' when score >= 0.245 then 'INCONCLUSIVE' else 'INCONSISTENT' end as status from k where rn = 1""")
def reference_ranking(spark, d):
    q = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), V.standardised(F.col("embedding")).alias("vec"))
    refs = label_means(spark, d).select(F.col("label").cast("long").alias("id"), V.standardised(F.col("vec")).alias("vec"))
    nn = S.knn_join(q, refs, 2)
    score = 1.0 - F.col("dist") * F.col("dist") / 2.0
    top = nn.withColumn("score", score).groupBy(F.col("q").alias("id")).agg(
        F.max(F.when(F.col("rank") == 1, F.col("n"))).alias("ref"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("score"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"))
    status = R.first_rule([(F.col("score").isNull(), "NOT_ESTIMATED"), (F.col("score") >= 0.35, "CONSISTENT"),
                           (F.col("score") >= 0.245, "INCONCLUSIVE")], "INCONSISTENT")
    return q.select("id").join(top, "id", "left").select(
        F.col("id").alias("vec_id"), F.col("ref").cast("int").alias("top_reference"), F.round("score", 4).alias("score"),
        F.round("second", 4).alias("second_score"), F.round(F.col("score") - F.col("second"), 4).alias("gap"), status.alias("status"))


@query("j14_integrity_diff", """
select case when doc_id % 10 = 3 then doc_id + 1000000000 else doc_id end as doc_id,
  case doc_id % 10 when 0 then 'MISSING' when 1 then 'MODIFIED' when 2 then 'MALFORMED' when 3 then 'UNEXPECTED' end as kind
from documents where doc_id % 10 in (0, 1, 2, 3)""")
def integrity_diff(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    m = F.col("doc_id") % 10
    changed = docs.where(m != 0).withColumn("sha", F.when(m == 1, F.sha2("sha", 256)).when(m == 2, F.substring("sha", 1, 40)).otherwise(F.col("sha")))
    extra = docs.where(m == 3).withColumn("doc_id", F.col("doc_id") + 1_000_000_000)
    return M.integrity_diff(docs, changed.unionByName(extra), "doc_id", "sha")


@query("j15_dangling_keys", """
select 'orders.custkey' as fk, o_orderkey as child_id, o_custkey as missing_key from orders where o_custkey not in (select c_custkey from customer where c_custkey % 7 <> 0)
union all select 'lineitem.orderkey', l_orderkey, l_orderkey from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderkey % 11 <> 0)
union all select 'customer.nationkey', c_custkey, c_nationkey from customer where c_nationkey not in (select n_nationkey from nation where n_nationkey <> 3)""")
def dangling_keys(spark, d):
    orders, customer, nation = load(spark, d, "orders"), load(spark, d, "customer"), load(spark, d, "nation")
    return M.dangling({
        "orders.custkey": (orders, "o_orderkey", "o_custkey", customer.where("c_custkey % 7 <> 0"), "c_custkey"),
        "lineitem.orderkey": (load(spark, d, "lineitem"), "l_orderkey", "l_orderkey", orders.where("o_orderkey % 11 <> 0"), "o_orderkey"),
        "customer.nationkey": (customer, "c_custkey", "c_nationkey", nation.where("n_nationkey <> 3"), "n_nationkey"),
    })


@query("j16_remap", """
with m as (select o_orderkey as old_id, 500000 + row_number() over (order by o_orderkey) - 1 as new_id from orders)
select 'order' as entity, m.new_id, (select string_agg(k.new_id, ',' order by t.pos) from (select unnest([o_orderkey + 1, o_orderkey, -1, o_orderkey - 1]) as old_id, unnest([1, 2, 3, 4]) as pos) t
  join m k on k.old_id = t.old_id) as links, 1::bigint as n from orders join m on m.old_id = o_orderkey
union all select 'line', m.new_id, null, count(*) from lineitem join m on m.old_id = l_orderkey group by m.new_id""")
def remap_q(spark, d):
    orders, lines = load(spark, d, "orders"), load(spark, d, "lineitem")
    mapping = M.surrogate_map(orders, "o_orderkey", 500_000)
    k = F.col("o_orderkey")
    linked = orders.select("o_orderkey", F.array(k + 1, k, F.lit(-1).cast("long"), k - 1).alias("links"))
    parents = M.remap(M.remap_array(linked, "o_orderkey", "links", mapping), "o_orderkey", mapping)
    children = M.remap(lines.groupBy("l_orderkey").agg(row_count().alias("n")), "l_orderkey", mapping)
    return parents.select(F.lit("order").alias("entity"), F.col("o_orderkey").alias("new_id"), F.concat_ws(",", "links").alias("links"), F.lit(1).cast("long").alias("n")) \
        .unionByName(children.select(F.lit("line").alias("entity"), F.col("l_orderkey").alias("new_id"), F.lit(None).cast("string").alias("links"), "n"))


LATEST_SQL = f"""select *, concat_ws('-', l_linenumber, l_partkey, l_suppkey) as ref from ({OBS_DUCK})
  qualify row_number() over (partition by item_id, modality order by l_linenumber desc, l_partkey desc, l_suppkey desc) = 1"""
RELATIONS_SQL = f"""with l as ({LATEST_SQL}), w as (select a.item_id, a.modality as ma, a.observation_type as ta, a.direction as da, a.ref as ra,
  b.modality as mb, b.direction as db, b.ref as rb from l a join l b on a.item_id = b.item_id)
select item_id, ra as obs_a, rb as obs_b, case when ma = 'COPY_MOVE' then 'INDEPENDENT' else 'CONTEXTUAL' end as relation_type, 'MODERATE' as strength from w
where (ma = 'ELA' and mb = 'JPEG_DCT') or (ma = 'METADATA' and ta = 'SOFTWARE_SIGNATURE' and da = 'present' and mb = 'ELA' and db = 'elevated')
  or (ma = 'COPY_MOVE' and da = 'candidate' and mb = 'METADATA' and db = 'absent')"""


def latest(spark, d):
    obs = observations(spark, d).withColumn("ref", F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey"))
    return R.latest_per_modality(obs, ["l_linenumber", "l_partkey", "l_suppkey"], ["observation_type", "direction", "ref"])


@query("j17_observation_relations", RELATIONS_SQL)
def observation_relations(spark, d):
    return R.relations(latest(spark, d))


@query("j18_newest_after", """
with n as (select user_id, max(ts) as ts, arg_max(event_id, (ts, event_id)) as id from events where event_type = 'purchase' group by 1)
select v.event_id, v.user_id, case when n.ts >= v.ts then n.id end as match_id from events v left join n on v.user_id = n.user_id where event_type = 'view'""")
def newest_after(spark, d):
    e = load(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    out = M.newest_after(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"), "user_id", "ts", "ts", "event_id")
    return out.select("event_id", "user_id", "match_id")


@query("j18_next_after", """
select v.event_id, v.user_id, p.event_id as match_id from (select * from events where event_type = 'view') v
asof left join (select * from events where event_type = 'purchase') p on v.user_id = p.user_id and v.ts <= p.ts""")
def next_after(spark, d):
    e = load(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    return M.next_after(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"), "user_id", "ts", "event_id", "ts", "event_id") \
        .select("event_id", "user_id", "match_id")


@query("j19_proximity_runs", """
with g as (select event_id, user_id, epoch_us(ts) as us, epoch_us(ts) - lag(epoch_us(ts)) over w as gap from events window w as (partition by user_id order by ts, event_id))
select event_id, user_id, round(gap / 1e6, 2) as gap_s, coalesce(gap <= 7200000000, false) as close,
  (sum(case when gap <= 7200000000 then 0 else 1 end) over (partition by user_id order by us, event_id))::bigint as run_no from g""")
def proximity_runs(spark, d):
    """Events of a user no more than two hours after their predecessor belong to one run."""
    e = load(spark, d, "events").select("event_id", "user_id", "ts")
    gaps = Sequenced(e, ["user_id"], ["ts", "event_id"]).shift({"prev": "ts"}, -1)
    gap = X.epoch_us(F.col("ts")) - X.epoch_us(F.col("prev"))
    marked = gaps.select("event_id", "user_id", "ts", gap.alias("gap"), F.when(gap <= 7_200_000_000, 0).otherwise(1).cast("long").alias("starts"))
    runs = Sequenced(marked, ["user_id"], ["ts", "event_id"], sizing=e).running_sum({"run_no": "starts"})
    return runs.select("event_id", "user_id", F.round(F.col("gap") / 1e6, 2).alias("gap_s"),
                       F.coalesce(F.col("gap") <= 7_200_000_000, F.lit(False)).alias("close"), "run_no")


@query("j20_record_diff", """
with l as (select l_partkey, count(*) as n from lineitem group by 1), p as (select part.*, coalesce(n, 0) as n_lines from part left join l on l_partkey = p_partkey)
select a.p_partkey as item_a, b.p_partkey as item_b, a.p_brand = b.p_brand as same_brand, a.p_type = b.p_type as same_type, a.p_name = b.p_name as same_name,
  abs(a.p_size - b.p_size) as diff_size, round(abs(a.p_retailprice - b.p_retailprice), 2) as diff_price, abs(a.n_lines - b.n_lines) as diff_n_lines
from p a join p b on b.p_partkey = a.p_partkey + 1""")
def record_diff(spark, d):
    """Every part beside the next one."""
    lines = load(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(row_count().alias("n"))
    p = load(spark, d, "part").join(lines, "p_partkey", "left").select(
        "p_partkey", F.struct(F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_name").alias("name"), F.col("p_size").alias("size"),
                              F.col("p_retailprice").alias("price"), F.coalesce("n", F.lit(0)).alias("n_lines")).alias("r"))
    nxt = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_partkey").alias("item_b"), F.col("r").alias("b"))
    pairs = p.withColumnRenamed("r", "a").join(nxt, "p_partkey").withColumnRenamed("p_partkey", "item_a")
    return M.record_diff(pairs, ["brand", "type", "name"], ["size", "price", "n_lines"]).drop("a", "b").withColumn("diff_price", F.round("diff_price", 2))


@query("j21_safe_delete", """
select doc_id, upper(concat(source, '/', doc_id)) as path from documents where doc_id % 4 <> 1
  and lower(upper(concat(source, '/', doc_id))) not in (select lower(concat(source, '/', doc_id)) from documents where doc_id % 3 = 0)""")
def safe_delete(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.concat_ws("/", "source", "doc_id").alias("path"))
    pending = docs.where("doc_id % 4 <> 1").withColumn("path", F.upper("path"))
    return M.unreferenced(pending, "path", docs.where("doc_id % 3 = 0"), "path")
