"""F: projections, filters, predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import rules as R
from ..sources import load, load_all
from .common import OBS_DUCK, observations
from .registry import query

SEARCH_SQL = " union all ".join(
    f"(select '{e}' as entity, {k}::bigint as id, {t} as title, substr({b}, 1, 80) as snippet from {tab} "
    f"where {t} ilike '%ti%' or {b} ilike '%ti%' order by id limit 10)"
    for e, tab, k, t, b in [("customer", "customer", "c_custkey", "c_name", "c_mktsegment"),
                            ("supplier", "supplier", "s_suppkey", "s_name", "s_name"),
                            ("part", "part", "p_partkey", "p_name", "p_type"),
                            ("document", "documents", "doc_id", "source", "text"),
                            ("nation", "nation", "n_nationkey", "n_name", "n_name"),
                            ("region", "region", "r_regionkey", "r_name", "r_name")])


@query("f01_keyword_search", f"select * from ({SEARCH_SQL}) order by entity, id limit 40")
def keyword_search(spark, d):
    t = load_all(spark, d)
    specs = [
        R.SearchSpec("customer", t["customer"], "c_custkey", "c_name", ("c_mktsegment",)),
        R.SearchSpec("supplier", t["supplier"], "s_suppkey", "s_name", ("s_name",)),
        R.SearchSpec("part", t["part"], "p_partkey", "p_name", ("p_type",)),
        R.SearchSpec("document", t["documents"], "doc_id", "source", ("text",)),
        R.SearchSpec("nation", t["nation"], "n_nationkey", "n_name", ("n_name",)),
        R.SearchSpec("region", t["region"], "r_regionkey", "r_name", ("r_name",)),
    ]
    return R.search(specs, "ti", per_entity=10, limit=40)


@query("f02_evidence_list", """
select d.doc_id, d.source, d.lang, sha256(d.text) as sha256,
  case when count(l.doc_id) = 0 then '' else 'quality,toxic' end as completed_types,
  coalesce(bool_or(l.toxic = 1), false) as has_artifact
from documents d left join labels l on d.doc_id = l.doc_id
where contains(d.lang, 'e') and (contains(d.source, '1') or starts_with(sha256(d.text), 'ab'))
group by all""")
def evidence_list(spark, d):
    docs = load(spark, d, "documents").withColumn("sha256", F.sha2("text", 256)) \
        .where(F.contains("lang", F.lit("e")) & (F.contains("source", F.lit("1")) | F.startswith("sha256", F.lit("ab")))) \
        .select("doc_id", "source", "lang", "sha256")
    done = load(spark, d, "labels").groupBy("doc_id").agg(
        F.max(F.col("quality").isNotNull()).alias("q"), F.max(F.col("toxic").isNotNull()).alias("t"),
        F.bool_or(F.col("toxic") == 1).alias("art"))
    types = F.concat_ws(",", F.when(F.col("q"), F.lit("quality")), F.when(F.col("t"), F.lit("toxic")))
    return docs.join(done, "doc_id", "left").select(
        "doc_id", "source", "lang", "sha256", types.alias("completed_types"),
        F.coalesce("art", F.lit(False)).alias("has_artifact")).orderBy(F.desc("doc_id"))


AUDIT_SQL = """select event_id as id, user_id as case_id, epoch_us(ts) as timestamp,
  case event_type when 'signup' then 'CASE_OPENED' when 'purchase' then 'EVIDENCE_UPLOADED' when 'error' then 'JOB_FAILED'
    when 'view' then 'ANALYSIS_COMPLETED' else 'FINDING_REVIEWED' end as event_type from events"""


def audit_events(spark, d):
    e = F.col("event_type")
    kind = (F.when(e == "signup", "CASE_OPENED").when(e == "purchase", "EVIDENCE_UPLOADED")
            .when(e == "error", "JOB_FAILED").when(e == "view", "ANALYSIS_COMPLETED").otherwise("FINDING_REVIEWED"))
    return load(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("case_id"), X.epoch_us(F.col("ts")).alias("timestamp"),
        kind.alias("event_type"))


@query("f03_audit_category", f"""
select * from ({AUDIT_SQL}) where starts_with(event_type, 'ANALYSIS_') or starts_with(event_type, 'JOB_')
order by timestamp desc, id desc limit 100""")
def audit_category(spark, d):
    return R.audit_filter(audit_events(spark, d), "ANALYSIS", 100)


@query("f03_audit_contains", f"select event_type, count(*) as n from ({AUDIT_SQL}) where contains(lower(event_type), 'view') group by all")
def audit_contains(spark, d):
    """A category that is no fixed one: its text anywhere in the event type."""
    kept = R.audit_filter(audit_events(spark, d), "view")
    return kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


APPLICABILITY = (
    {"engine": "ELA", "formats": ["LARGE", "STANDARD"], "min_dim": 1, "max_dim": 50},
    {"engine": "NOISE", "formats": ["LARGE", "STANDARD", "SMALL", "PROMO"], "min_dim": 8, "max_dim": 50},
    {"engine": "FOURIER", "formats": ["SMALL", "MEDIUM", "ECONOMY"], "min_dim": 16, "max_dim": 40},
    {"engine": "HISTOGRAM", "formats": ["LARGE", "STANDARD", "SMALL", "PROMO", "MEDIUM", "ECONOMY"], "min_dim": 1, "max_dim": 32},
)


def rule_values(rows, name):
    """A fixed rule table as a VALUES list for the checking SQL."""
    def lit(v):
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(lit(x) for x in v) + "]" + ("" if v else "::varchar[]")
        return ("true" if v else "false") if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else str(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r.values()) + ")" for r in rows)
    return f"(values {body}) {name}({', '.join(rows[0])})"


@query("f04_applicability", f"""
select engine, reason, reason = 'APPLICABLE' as applicable, count(*) as n, sum(p_partkey)::bigint as part_sum from (
  select engine, p_partkey, case when not list_contains(formats, p_type) then 'FORMAT_NOT_SUPPORTED'
    when p_size < min_dim then 'BELOW_MINIMUM_SIZE' when p_size > max_dim then 'ABOVE_MAXIMUM_SIZE'
    else 'APPLICABLE' end as reason
  from part, {rule_values(APPLICABILITY, 'e')}) group by all""")
def applicability_q(spark, d):
    items = load(spark, d, "part").select("p_partkey", F.col("p_type").alias("format"), F.col("p_size").alias("dim"))
    return R.applicability(items, APPLICABILITY).groupBy("engine", "reason", "applicable").agg(
        F.count(F.lit(1)).alias("n"), F.sum("p_partkey").alias("part_sum"))


# The 23 engines, which need a prerequisite, which need a JPEG stream, and their target classes.
_JPEG, _DOUBLE, _CLONE = [0, 1, 2, 3], [3], [4, 5, 10]
DISPATCH = tuple(
    {"engine": name, "needs_prereq": prereq, "jpeg_only": jpeg, "targets": targets}
    for name, prereq, jpeg, targets in (
        ("METADATA", False, False, []), ("ELA", False, True, _JPEG), ("JPEG_DCT", False, True, _JPEG),
        ("JPEG_QT", False, True, _JPEG), ("JPEG_STRUCTURE", False, True, _JPEG), ("JPEG_HUFFMAN", False, True, _JPEG),
        ("JPEG_GHOST", False, True, _DOUBLE), ("ADJPEG", False, True, _DOUBLE), ("NADJPEG", False, True, _DOUBLE),
        ("BLOCKING_ARTIFACT", False, True, _JPEG), ("COPY_MOVE", False, False, _CLONE),
        ("CLONE_BLOCK", False, False, _CLONE), ("CLONE_KEYPOINT", False, False, _CLONE),
        ("NOISE", False, False, [5, 10, 7, 6]), ("ADVANCED_NOISE", False, False, [5, 10, 7, 6]),
        ("RESAMPLING", False, False, [8, 5]), ("COLOR_CHANNEL", False, False, [9]),
        ("FOURIER", False, False, [5, 8, 7, 10]), ("HISTOGRAM", False, False, [5, 0, 1, 2, 9]),
        ("PRNU", False, False, [5, 7]), ("CAMERA_ID", True, False, []), ("GEOMETRY_PERSPECTIVE", True, False, []),
        ("PHYSICS_LIGHTING", True, False, [])))
_DISPATCH_SQL = rule_values([{**r, "targets": [int(x) for x in r["targets"]]} for r in DISPATCH], "e").replace(
    "[]::varchar[]", "[]::integer[]")


@query("f05_dispatch", f"""
select engine, decision, count(*) as n, sum(p_partkey)::bigint as part_sum from (
  select engine, p_partkey, case when needs_prereq then 'SKIP (Prereq)'
    when jpeg_only and p_partkey % 11 > 3 then 'SKIP (Format)'
    when len(targets) > 0 and not list_contains(targets, (p_partkey % 11)::integer) then 'SKIP (Target)'
    else 'RUN' end as decision
  from part, {_DISPATCH_SQL}) group by all""")
def dispatch_q(spark, d):
    """Parts stand in for eleven target classes; the first four are JPEG streams."""
    cls = F.pmod("p_partkey", F.lit(11)).cast("int")
    items = load(spark, d, "part").select(
        "p_partkey", cls.alias("target"), F.when(cls <= 3, "JPEG").otherwise("PNG").alias("format"))
    out = R.dispatch(items, DISPATCH)
    return out.groupBy("engine", "decision").agg(F.count(F.lit(1)).alias("n"), F.sum("p_partkey").alias("part_sum"))


@query("f06_safe_path", r"""
with p as (select page_id, url, regexp_replace(url, '^https?://[^/]+', '') as path from pages),
v as (select page_id, 'url' as form, url as s from p union all select page_id, 'absolute', path from p
  union all select page_id, 'relative', substr(path, 2) from p union all select page_id, 'parent', concat('../', substr(path, 2)) from p
  union all select page_id, 'drive', concat('C:', path) from p union all select page_id, 'empty', '' from p)
select page_id, form, (s <> '' and not contains(s, '..') and not regexp_matches(s, '^[/\\]')
  and not regexp_matches(s, '^[a-zA-Z]:')) as safe from v""")
def safe_path(spark, d):
    p = load(spark, d, "pages").select("page_id", "url", F.regexp_replace("url", "^https?://[^/]+", "").alias("path"))
    rel = F.expr("substring(path, 2)")
    forms = {"url": F.col("url"), "absolute": F.col("path"), "relative": rel, "parent": F.concat(F.lit("../"), rel),
             "drive": F.concat(F.lit("C:"), F.col("path")), "empty": F.lit("")}
    v = p.select("page_id", F.explode(F.array(*[F.struct(F.lit(k).alias("form"), c.alias("s")) for k, c in forms.items()])).alias("v"))
    return v.select("page_id", "v.form", X.is_safe_path(F.col("v.s")).alias("safe"))


@query("f07_canonical_key", """
select upper(replace(lower(p_type) || '-' || replace(p_name, ' ', '-'), '-', '_')) as engine_key, count(*) as n
from part group by all""")
def canonical_key(spark, d):
    raw = F.concat(F.lower("p_type"), F.lit("-"), F.translate(F.col("p_name"), " ", "-"))
    return load(spark, d, "part").groupBy(X.canonical_key(raw).alias("engine_key")).agg(F.count(F.lit(1)).alias("n"))


@query("f08_best_time", """
with e as (select event_id, ts, cast(json_extract_string(props, '$.k') as integer) as k from events),
f as (select event_id, ts, case when k % 4 = 0 then strftime(ts - interval 1 day, '%Y:%m:%d %H:%M:%S') when k % 4 = 1 then 'not a date' end as a,
  case when k % 3 = 0 then strftime(ts - interval 2 day, '%Y-%m-%dT%H:%M:%S') end as b from e),
g as (select *, try_strptime(a, '%Y:%m:%d %H:%M:%S') as ta, try_strptime(b, '%Y-%m-%dT%H:%M:%S') as tb from f)
select event_id, epoch_us(coalesce(ta, tb, ts)) as best_us,
  case when ta is not null then 'capture' when tb is not null then 'digitized' else 'ingest' end as time_source from g""")
def best_time(spark, d):
    e = load(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    day = F.expr("interval 1 day")
    a = F.when(F.col("k") % 4 == 0, F.date_format(F.col("ts") - day, "yyyy:MM:dd HH:mm:ss")).when(F.col("k") % 4 == 1, "not a date")
    b = F.when(F.col("k") % 3 == 0, F.date_format(F.col("ts") - day - day, "yyyy-MM-dd'T'HH:mm:ss"))
    value, tag = X.first_present([("capture", X.parse_time(a)), ("digitized", X.parse_time(b))], "ingest")
    return e.select("event_id", X.epoch_us(F.coalesce(value, F.col("ts").cast("timestamp"))).alias("best_us"), tag.alias("time_source"))


# Editor names looked for in metadata.
EDITORS = ("photoshop", "gimp", "paint", "canva", "adobe", "lightroom")
STAND_IN_WORDS = ("license", "copyright", "http", "email", "and the", "eaux")


@query("f09_keyword_flag", f"""
select lang, count(*) as docs, count(*) filter (where regexp_matches(lower(text), '{"|".join(EDITORS)}')) as editor_docs,
  count(*) filter (where regexp_matches(lower(text), '{"|".join(STAND_IN_WORDS)}')) as word_docs from documents group by all""")
def keyword_flag(spark, d):
    t = F.col("text")
    return load(spark, d, "documents").groupBy("lang").agg(
        F.count(F.lit(1)).alias("docs"), F.count_if(X.mentions_any(t, EDITORS)).alias("editor_docs"),
        F.count_if(X.mentions_any(t, STAND_IN_WORDS)).alias("word_docs"))


@query("f10_active_directions", f"""
select modality, direction, count(*) as n, sum(item_id)::bigint as item_sum from ({OBS_DUCK})
where direction in ('elevated', 'suppressed', 'present', 'candidate') group by all""")
def active_directions(spark, d):
    return R.active_only(observations(spark, d)).groupBy("modality", "direction").agg(
        F.count(F.lit(1)).alias("n"), F.sum("item_id").alias("item_sum"))


@query("f11_review_queue", """
select o_orderkey, case o_orderstatus when 'O' then 'GENERATED' else 'REVIEW_REQUIRED' end as status, o_orderpriority as severity
from orders where o_orderstatus in ('O', 'P')""")
def review_queue(spark, d):
    o = load(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "GENERATED").when(F.col("o_orderstatus") == "P", "REVIEW_REQUIRED").otherwise("CONFIRMED_BY_ANALYST")
    return o.select("o_orderkey", status.alias("status"), F.col("o_orderpriority").alias("severity")) \
        .where(F.col("status").isin("GENERATED", "REVIEW_REQUIRED"))


@query("f12_due_rows", """
select o_orderkey as id, (o_custkey % 12 + 1)::bigint as attempt, least(300.0, pow(2.0, least(o_custkey % 12 + 1, 8)))::double as delay_s
from orders where o_orderstatus <> 'F' and o_orderdate <= timestamp '1998-01-01' order by id limit 200""")
def due_rows_q(spark, d):
    o = load(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("dispatched_at"),
        F.col("o_orderdate").alias("next_attempt_at"), (F.col("o_custkey") % 12).alias("attempt_count"))
    out = R.due_rows(o, F.lit("1998-01-01 00:00:00").cast("timestamp_ntz"), 200)
    return out.select("id", "attempt", "delay_s")


@query("f13_visible_regions", """
select event_id as id, event_type as layer, value as intensity from events
where event_type in ('view', 'click') and value is not null and not isnan(value) order by value desc, event_id limit 50""")
def visible_regions_q(spark, d):
    e = load(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("layer"), F.col("value").alias("intensity"),
                                        (F.hour("ts") / 24.0).alias("x"), F.col("value").alias("y"))
    return R.visible_regions(e, ["view", "click"], 50).select("id", "layer", "intensity")
