"""S: scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..session import fresh_dir
from ..sources import label_from_path, load, load_all, read_manifest, scan_corpus
from ..sources import sinks
from ..sources.scans import CASIA_KINDS, CASIA_RULES, COLUMBIA_RULES, NameRule
from ..schemas import TABLES
from .common import OBS_DUCK, observations
from .registry import query


@query("s01_corpus_scan")
def corpus_scan(spark, d):
    files = scan_corpus(spark, d, ["parquet"])
    return files.select(X.file_name(F.col("path")).alias("file"), "length", "format", "sha256", "copies", "is_first")


@query("s01_page_files", """with f as (select page_id % 64 as bucket, sha256(string_agg(coalesce(html, '') || chr(10), '' order by page_id)) as sha256, sum(strlen(coalesce(html, '')) + 1)::bigint as length from pages group by 1),
c as (select *, count(*) over (partition by sha256) as copies, bucket = min(bucket) over (partition by sha256) as is_first from f)
select bucket::integer as bucket, length, 'TXT' as format, sha256, copies, is_first from c""")
def page_files(spark, d):
    """Pages written as 64 text files in shared folders, then crawled: digests, copies, and the first file of each content."""
    path = fresh_dir(spark, "pages")
    pages = load(spark, d, "pages").select(F.format_string("%02d", F.col("page_id") % 64).alias("bucket"), "page_id", F.coalesce("html", F.lit("")).alias("value"))
    pages.repartition("bucket").sortWithinPartitions("bucket", "page_id").select("bucket", "value").write.partitionBy("bucket").text(path)
    files = scan_corpus(spark, path, ["txt"])
    return files.select(F.regexp_extract("path", "bucket=([0-9]+)", 1).cast("int").alias("bucket"), "length", "format", "sha256", "copies", "is_first")


@query("s03_manifest_scan", """
select lang as format, case when source is null then 'UNKNOWN' else source end as source, count(*) as images,
  sum(n_chars)::bigint as width_sum, count(distinct sha256(text)) as hashes
from documents group by all""")
def manifest_scan(spark, d):
    """Write one image record per document, read them back through the manifest schema."""
    path = fresh_dir(spark, "manifest")
    docs = load(spark, d, "documents")
    docs.select(
        F.concat(F.lit("img_"), F.col("doc_id").cast("string")).alias("image_id"), F.lit("docs").alias("dataset_id"),
        "source", F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("filename"),
        F.sha2("text", 256).alias("sha256"), F.col("lang").alias("format"),
        F.col("n_chars").cast("int").alias("width")).write.json(path)
    records = read_manifest(spark, path, layout="records")
    return records.groupBy("format", F.coalesce("source", F.lit("UNKNOWN")).alias("source")).agg(
        F.count(F.lit(1)).alias("images"), F.sum("width").alias("width_sum"),
        F.countDistinct("sha256").alias("hashes"))


WEB_RULES = (
    NameRule("folder", "contains", "spam-farm", "MANIPULATED", "SPLICING"),
    NameRule("name", "regex", r"\.html($|[?#])", "AUTHENTIC", "NONE"),
    NameRule("folder", "contains", "//m.", "MANIPULATED", "COPY_MOVE"),
    NameRule("name", "prefix", "7", "MANIPULATED", "UNKNOWN"),
)


@query("s04_label_rules", """
with p as (select page_id, lower(url) as u, regexp_replace(lower(url), '/?[^/]*$', '') as folder,
  regexp_extract(lower(url), '([^/]*)$', 1) as name from pages)
select page_id,
  case when starts_with(name, 'au_') or contains(folder, 'authentic') then 'AUTHENTIC'
       when starts_with(name, 'tp_') or contains(folder, 'tampered') or contains(folder, 'casia') then 'MANIPULATED'
       else 'UNKNOWN' end as casia_label,
  case when starts_with(name, 'au_') or contains(folder, 'authentic') then 'NONE' when casia_label = 'MANIPULATED' and contains(name, '_d_') then 'COPY_MOVE'
       when casia_label = 'MANIPULATED' and contains(name, '_s_') then 'SPLICING' else 'UNKNOWN' end as casia_manipulation_type,
  case when contains(folder, 'authentic') or contains(name, 'auth') then 'NONE' when contains(folder, 'spliced') or contains(name, 'splice') then 'SPLICING' else 'UNKNOWN' end as columbia_manipulation_type,
  case when contains(folder, 'authentic') or contains(name, 'auth') then 'AUTHENTIC'
       when contains(folder, 'spliced') or contains(name, 'splice') then 'MANIPULATED' else 'UNKNOWN' end as columbia_label,
  case when contains(folder, 'spam-farm') then 'MANIPULATED' when regexp_matches(name, '\\.html($|[?#])') then 'AUTHENTIC'
       when contains(folder, '//m.') or starts_with(name, '7') then 'MANIPULATED' else 'UNKNOWN' end as web_label,
  case when contains(folder, 'spam-farm') then 'SPLICING' when regexp_matches(name, '\\.html($|[?#])') then 'NONE'
       when contains(folder, '//m.') then 'COPY_MOVE' else 'UNKNOWN' end as web_manipulation_type
from p""")
def label_rules(spark, d):
    pages = load(spark, d, "pages").select("page_id", "url")
    out = label_from_path(pages, "url", CASIA_RULES, "casia_", CASIA_KINDS)
    out = label_from_path(out, "url", COLUMBIA_RULES, "columbia_")
    out = label_from_path(out, "url", WEB_RULES, "web_")
    return out.select("page_id", "casia_label", "casia_manipulation_type", "columbia_label", "columbia_manipulation_type", "web_label", "web_manipulation_type")


@query("s05_entity_scan", " union all ".join(
    f"select '{t}' as entity, count(*) as n_rows, count(distinct {s[0].name}) as n_keys, "
    f"cast(sum({s[0].name}) as bigint) as key_sum from {t}" for t, s in TABLES.items()))
def entity_scan(spark, d):
    parts = []
    for name, df in load_all(spark, d).items():
        key = TABLES[name][0].name
        parts.append(df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(key).alias("n_keys"),
                            F.sum(key).cast("long").alias("key_sum"))
                     .select(F.lit(name).alias("entity"), "n_rows", "n_keys", "key_sum"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def list_cases(df, owner, term, skip, limit):
    """Open cases of an owner class whose id or priority mentions `term`, newest first."""
    return (df.where((F.col("owner") == owner) & (F.upper("status") != "CLOSED")
                     & (F.col("title").ilike(f"%{term}%") | F.col("case_id").ilike(f"%{term}%")))
            .orderBy(F.desc("created"), F.desc("id")).offset(skip).limit(limit))


@query("s06_case_page", """
select o_orderkey as id, o_orderpriority as title, o_orderstatus as status, epoch_us(o_orderdate) as created_us
from orders where o_custkey % 3 = 1 and o_orderstatus <> 'F'
  and (o_orderpriority ilike '%high%' or concat('FS-', o_orderkey) ilike '%high%')
order by o_orderdate desc, o_orderkey desc limit 50 offset 25""")
def case_page(spark, d):
    orders = load(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("FS-"), F.col("o_orderkey").cast("string")).alias("case_id"),
        F.col("o_orderpriority").alias("title"), (F.col("o_custkey") % 3).alias("owner"),
        F.when(F.col("o_orderstatus") == "F", "CLOSED").otherwise(F.col("o_orderstatus")).alias("status"),
        F.col("o_orderdate").alias("created"))
    page = list_cases(orders, 1, "high", 25, 50)
    return page.select("id", "title", "status", X.epoch_us(F.col("created")).alias("created_us"))


@query("s07_observation_jsonl", f"""
select modality, direction, count(*) as n, round(sum(normalized_value), 4) as total from ({OBS_DUCK}) group by all""")
def observation_jsonl(spark, d):
    path = fresh_dir(spark, "obs-jsonl")
    obs = observations(spark, d).select("item_id", "modality", "direction", "normalized_value")
    sinks.write_observations(obs, path)
    back = spark.read.schema(obs.schema).json(path)
    return back.groupBy("modality", "direction").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("normalized_value"), 4).alias("total"))


@query("s08_replace_partitions", """
select year(o_orderdate) as o_year, count(*) as n,
  round(sum(case when year(o_orderdate) = 1997 then o_totalprice * 2 else o_totalprice end), 2) as total
from orders group by all""")
def replace_partitions_q(spark, d):
    """First load, then a re-run of one year with changed values: no row is doubled."""
    path = fresh_dir(spark, "by-year")
    orders = load(spark, d, "orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").cast("long").alias("o_year"))
    sinks.replace_partitions(orders, path, ["o_year"])
    rerun = orders.where("o_year = 1997").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    sinks.replace_partitions(rerun, path, ["o_year"])
    sinks.replace_partitions(rerun, path, ["o_year"])
    back = spark.read.schema(orders.schema).parquet(path)
    return back.groupBy("o_year").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("s09_upsert", """
select c_custkey, c_name,
  case when c_custkey % 3 = 2 then c_acctbal * 2 when c_custkey % 3 = 1 then c_acctbal * 2 else c_acctbal end as c_acctbal,
  case when c_custkey % 3 = 2 then 'NEW' else c_mktsegment end as c_mktsegment,
  case c_custkey % 3 when 0 then 'KEPT' when 1 then 'UPDATED' else 'INSERTED' end as upsert_action
from customer""")
def upsert_q(spark, d):
    customer = load(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    k = F.col("c_custkey") % 3
    target = customer.where(k != 2)
    updates = customer.where(k != 0).withColumn("c_acctbal", F.col("c_acctbal") * 2).withColumn("c_mktsegment", F.lit("NEW"))
    return sinks.upsert(target, updates, ["c_custkey"], keep=["c_mktsegment"])


def digest_sql(hash_expr: str, lead: str) -> str:
    words = ", ':', ".join(f"sum(('0x' || substr({hash_expr}, {1 + 8 * i}, 8))::bigint)::bigint" for i in range(sinks.WORDS))
    return f"sha256(concat({lead}, ':', {words}))"


@query("s10_snapshot", f"""
select count(*) as entries, sum(n_chars)::bigint as total_bytes,
  {digest_sql("h", "count(*), ':', sum(n_chars)::bigint")} as digest
from (select n_chars, sha256(concat(doc_id, ':', sha256(text))) as h from documents)""")
def snapshot(spark, d):
    _, manifest = sinks.make_snapshot(load(spark, d, "documents"), "doc_id", "text", "n_chars")
    return manifest


ENTRY = {
    "customer": ("c_custkey", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]),
    "orders": ("o_custkey", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]),
    "lineitem": ("o_custkey", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"]),
}


def _entry_sql(table: str) -> str:
    key, cols = ENTRY[table]
    json = "concat('{', " + ", ',', ".join(
        (f"'\"{c}\":\"', {c}, '\"'" if c in ("c_name", "c_mktsegment", "o_orderstatus", "o_orderpriority", "l_returnflag")
         else f"'\"{c}\":', {c}") for c in sorted(cols)) + ", '}')"
    src = "lineitem join orders on l_orderkey = o_orderkey" if table == "lineitem" else table
    h = "sha256(j)"
    return (f"select case_key, '{table}' as table_name, count(*) as entries, sum(length(j))::bigint as total_bytes, "
            f"{digest_sql(h, 'count(*), chr(58), sum(length(j))::bigint')} as digest "
            f"from (select {key} as case_key, {json} as j from {src}) group by case_key")


@query("s11_case_export", " union all ".join(_entry_sql(t) for t in ENTRY))
def case_export(spark, d):
    """Entry manifest of every case bundle: per case and table, rows, bytes and digest."""
    t = load_all(spark, d)
    frames = {
        "customer": t["customer"], "orders": t["orders"],
        "lineitem": t["lineitem"].join(t["orders"].select("o_orderkey", "o_custkey"),
                                       F.col("l_orderkey") == F.col("o_orderkey")),
    }
    out = None
    for name, (key, cols) in ENTRY.items():
        body = X.canonical_json({c: F.col(c) for c in cols})
        rows = frames[name].select(F.col(key).alias("case_key"), body.alias("j"))
        part = sinks.set_digest(rows, ["case_key"], F.sha2("j", 256), F.length("j")) \
            .withColumn("table_name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
