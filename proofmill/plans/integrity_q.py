"""I: integrity and quality jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import jsonx
from ..functions import text as X
from ..functions.numeric import row_count
from ..operators import digests as D
from ..operators import integrity as G
from ..operators import matching as M
from ..session import cut
from ..sources import load
from .common import MODALITIES
from .registry import query, r
from .stats_q import rounded

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"

CHAIN_SQL = """p as (select event_id as id, user_id as case_id, row_number() over (partition by user_id order by ts, event_id) as seq,
  concat('{"actor":"system","case_id":', user_id, ',"event_type":"', event_type, '","evidence_id":null,"id":', event_id, ',"previous_hash":"') as head,
  concat('","safe_metadata":"', replace(props, '"', '\\"'), '","sequence_number":') as mid, concat(',"timestamp":"', strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '"}') as tail from events),
ch as (select case_id, id, seq, repeat('0', 64) as prev, sha256(concat(head, repeat('0', 64), mid, seq, tail)) as hash from p where seq = 1
  union all select p.case_id, p.id, p.seq, ch.hash, sha256(concat(p.head, ch.hash, p.mid, p.seq, p.tail)) from ch join p on p.case_id = ch.case_id and p.seq = ch.seq + 1)"""


def audit_rows(spark, d):
    return load(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("case_id"), F.lit(None).cast("string").alias("evidence_id"), "event_type",
        F.date_format("ts", ISO).alias("timestamp"), F.lit("system").alias("actor"), F.col("props").alias("safe_metadata"), "ts")


def chained(spark, d):
    """The audit events of every user with their chain, written once so that checks read a table."""
    rows = audit_rows(spark, d)
    return rows, cut(G.build_chain(rows, ["ts", "id"]).join(rows, ["case_id", "id"]))


@query("i01_chain_build", f"with recursive {CHAIN_SQL} select case_id, id, seq as sequence_number, prev as previous_hash, hash as event_hash from ch")
def chain_build(spark, d):
    return G.build_chain(audit_rows(spark, d), ["ts", "id"])


TAMPER_SQL = f"""{CHAIN_SQL}, tm as (select ch.case_id, ch.id, ch.seq, case when ch.id % 103 = 0 then repeat('f', 64) else ch.prev end as prev, ch.hash,
  case when ch.id % 97 = 0 then replace(head, '"event_type":"', '"event_type":"x') else head end as head, mid, tail from ch join p on p.id = ch.id where ch.id % 101 <> 0),
lk as (select *, lag(seq) over w as pseq, lag(hash) over w as phash from tm window w as (partition by case_id order by seq)),
vi as (select case_id, id, seq, 'SEQUENCE_GAP' as violation from lk where seq <> coalesce(pseq, 0) + 1 union all
  select case_id, id, seq, 'PREVIOUS_HASH_MISMATCH' from lk where prev <> coalesce(phash, repeat('0', 64)) union all
  select case_id, id, seq, 'EVENT_HASH_MISMATCH' from lk where hash <> sha256(concat(head, prev, mid, seq, tail)))"""


def tampered(spark, d):
    """The chain with altered rows, removed rows and broken links."""
    _, events = chained(spark, d)
    return events.where("id % 101 <> 0").withColumn("event_type", F.when(F.col("id") % 97 == 0, F.concat(F.lit("x"), "event_type")).otherwise(F.col("event_type"))) \
        .withColumn("previous_hash", F.when(F.col("id") % 103 == 0, F.lit("f" * 64)).otherwise(F.col("previous_hash")))


@query("i02_chain_verify", f"with recursive {TAMPER_SQL} select case_id, id, seq as sequence_number, violation from vi")
def chain_verify(spark, d):
    return G.verify_chain(tampered(spark, d))


@query("i02_chain_status", f"""with recursive {TAMPER_SQL} select case_id, count(*) as events, (select count(*) from vi where vi.case_id = tm.case_id) as violations, max(seq) as head_sequence, arg_max(hash, seq) as head_hash,
  case when (select count(*) from vi where vi.case_id = tm.case_id) > 0 then 'BROKEN' else 'VERIFIED' end as status from tm group by 1""")
def chain_status(spark, d):
    events = tampered(spark, d)
    return G.chain_status(events, G.verify_chain(events))


def custody_rows(spark, d):
    """Documents as items; some files are gone, changed or unreadable."""
    docs = load(spark, d, "documents").select("doc_id", F.col("source").alias("case_id"), F.sha2("text", 256).alias("recorded"))
    m = F.col("doc_id") % 20
    stored = docs.where(m != 3).select("doc_id", F.when(m == 5, None).when(m == 7, F.sha2("recorded", 256)).otherwise(F.upper("recorded")).alias("actual"))
    return G.custody_check(docs, stored, "doc_id")


CUSTODY_SQL = """cu as (select doc_id, source as case_id, case doc_id % 20 when 3 then 'FILE_MISSING' when 5 then 'READ_ERROR' when 7 then 'TAMPER_OR_BITROT_DETECTED' else 'VERIFIED_INTACT' end as status from documents)"""


@query("i03_custody_items", f"with {CUSTODY_SQL} select doc_id, case_id, status, status = 'VERIFIED_INTACT' as intact from cu")
def custody_items(spark, d):
    return custody_rows(spark, d).select("doc_id", "case_id", "status", "intact")


@query("i03_custody_cases", f"""with {CUSTODY_SQL} select case_id, count(*) as items, bool_and(status = 'VERIFIED_INTACT') as all_intact, count(*) filter (where status = 'FILE_MISSING') as missing,
  count(*) filter (where status = 'TAMPER_OR_BITROT_DETECTED') as tampered from cu group by 1""")
def custody_cases(spark, d):
    return custody_rows(spark, d).groupBy("case_id").agg(row_count().alias("items"), F.bool_and("intact").alias("all_intact"), F.count_if(F.col("status") == "FILE_MISSING").alias("missing"),
                                                         F.count_if(F.col("status") == "TAMPER_OR_BITROT_DETECTED").alias("tampered"))


@query("i03_custody_timeline", """select event_id, user_id as case_id, event_type, epoch_us(ts) as at_us, case when event_id % 10 = 0 then concat('{"raw":"', replace(substr(props, 1, 4), '"', '\\"'), '"}') else props end as details,
  coalesce(d.source, json_extract_string(props, '$.k')) as file_name from events left join documents d on d.doc_id = event_id % 1500""")
def custody_timeline(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "source")
    text = F.when(F.col("event_id") % 10 == 0, F.substring("props", 1, 4)).otherwise(F.col("props"))
    e = load(spark, d, "events").withColumn("doc_id", F.col("event_id") % 1500).join(docs, "doc_id", "left")
    return e.select("event_id", F.col("user_id").alias("case_id"), "event_type", X.epoch_us(F.col("ts")).alias("at_us"), jsonx.or_raw(text).alias("details"),
                    F.coalesce("source", jsonx.path_text(F.col("props"), ["$.k"])).alias("file_name"))


@query("i04_replay_verdict", f"""with {CUSTODY_SQL}, ca as (select distinct source as case_id from documents union select concat('empty', r_regionkey) from region), c as (select case_id, count(*) as items, count(*) filter (where status = 'VERIFIED_INTACT') as ok from cu where doc_id % 4 <> 3 group by 1)
select ca.case_id, coalesce(items, 0) as items, coalesce(ok, 0) as intact_items, case when items is null then 'EMPTY_CASE' when items = ok then 'VERIFIED' else 'INTEGRITY_VIOLATION' end as verdict from ca left join c on ca.case_id = c.case_id""")
def replay_verdict(spark, d):
    cases = load(spark, d, "documents").select(F.col("source").alias("case_id")).distinct() \
        .unionByName(load(spark, d, "region").select(F.concat(F.lit("empty"), F.col("r_regionkey").cast("string")).alias("case_id")))
    return G.replay_verdict(cases, custody_rows(spark, d).where("doc_id % 4 <> 3"), "case_id")


@query("i05_snapshot_verification", """select 'item' as part, doc_id, case when doc_id % 9 = 0 then 'MISSING' else 'MODIFIED' end as kind from documents where doc_id % 9 = 0 or doc_id % 9 = 4
union all select 'label', doc_id, 'MODIFIED' from labels where quality = 0 and toxic = 1""")
def snapshot_verification(spark, d):
    """Item digests and label digests of a snapshot against the current tables."""
    docs = load(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    m = F.col("doc_id") % 9
    items = M.integrity_diff(docs, docs.where(m != 0).withColumn("sha", F.when(m == 4, F.sha2("sha", 256)).otherwise(F.col("sha"))), "doc_id", "sha")
    lab = load(spark, d, "labels")
    label_hash = F.sha2(F.concat_ws(":", F.col("quality").cast("string"), F.col("toxic").cast("string")), 256)
    now = lab.withColumn("toxic", F.when((F.col("quality") == 0) & (F.col("toxic") == 1), 0).otherwise(F.col("toxic")))
    labels = M.integrity_diff(lab.select("doc_id", label_hash.alias("sha")), now.select("doc_id", label_hash.alias("sha")), "doc_id", "sha")
    return items.select(F.lit("item").alias("part"), "doc_id", "kind").unionByName(labels.select(F.lit("label").alias("part"), "doc_id", "kind"))


RULE_SQL = """rl as (select p_partkey as key, unnest(list_filter([case when p_size <= 0 or p_size > 45 then 'SIZE_OUT_OF_RANGE' end, case when p_name is null or p_name = '' or upper(p_name) in ('UNKNOWN', 'TBD', 'TODO') then 'NAME_MISSING' end,
  case when not regexp_matches(p_brand, '^Brand#[1-9]$|^Brand#1[0-9]$') then 'BRAND_FORMAT' end, case when p_retailprice >= 1050 then 'PRICE_LIMIT' end,
  case when p_partkey % 29 = 0 then 'BAD_DIGEST' end, case when p_partkey % 31 = 0 then 'UNSAFE_PATH' end], lambda x: x is not null)) as rule from part
  union all select p_partkey, 'DUPLICATE_FINGERPRINT' from part where concat(p_brand, p_type, p_size, p_name) in (select concat(p_brand, p_type, p_size, p_name) from part group by 1 having count(*) > 1))"""


def registration(spark, d):
    parts = load(spark, d, "part").select(
        "*", F.concat("p_brand", "p_type", F.col("p_size").cast("string"), "p_name").alias("fingerprint"),
        F.when(F.col("p_partkey") % 29 == 0, "abc").otherwise(F.sha2("p_name", 256)).alias("digest"),
        F.concat(F.when(F.col("p_partkey") % 31 == 0, "../").otherwise(""), "p_name").alias("path"))
    rules = {
        "SIZE_OUT_OF_RANGE": (F.col("p_size") <= 0) | (F.col("p_size") > 45),
        "NAME_MISSING": F.upper(F.trim("p_name")).isin("", "UNKNOWN", "TBD", "TODO"),
        "BRAND_FORMAT": ~F.col("p_brand").rlike("^Brand#[1-9]$|^Brand#1[0-9]$"),
        "PRICE_LIMIT": F.col("p_retailprice") >= 1050,
        "BAD_DIGEST": G.bad_digest(F.col("digest")),
        "UNSAFE_PATH": ~X.is_safe_path(F.col("path")),
    }
    return parts, G.validate(parts, "p_partkey", rules, unique=["fingerprint"])


@query("i06_registration_errors", f"with {RULE_SQL} select key, rule from rl")
def registration_errors(spark, d):
    return registration(spark, d)[1]


@query("i06_registration_verdict", f"with {RULE_SQL} select (select count(*) from part) as rows, count(distinct key) as bad_rows, count(*) as errors, 'INVALID' as status from rl")
def registration_verdict(spark, d):
    return G.verdict(*registration(spark, d))


INTAKE_SQL = """select n_chars, case when source = 'src7' then 'CASE_CLOSED' when doc_id % 11 = 0 then 'UNSUPPORTED_EXTENSION' when doc_id % 13 = 0 then 'UNSUPPORTED_MIME' when n_chars > 9000 then 'TOO_LARGE'
  when n_chars * 100 > 600000 then 'TOO_MANY_PIXELS' when lang = 'de' and doc_id % 5 = 0 then 'TYPE_MISMATCH' when lang = 'fr' and doc_id % 5 = 1 then 'EXTENSION_MISMATCH' else 'ACCEPTED' end as reason from documents"""


@query("i07_intake_validation", f"select reason, count(*) as n, sum(n_chars)::bigint as bytes from ({INTAKE_SQL}) group by 1")
def intake_validation(spark, d):
    """Languages stand in for the image types; some uploads lie about theirs."""
    i, lang = F.col("doc_id"), F.col("lang")
    actual = F.when(lang == "en", "JPEG").when(lang == "fr", "PNG").otherwise("WEBP")
    honest = F.when(lang == "en", "image/jpeg").when(lang == "fr", "image/png").otherwise("image/webp")
    declared = F.when(i % 13 == 0, "text/html").when((lang == "de") & (i % 5 == 0), "image/png").otherwise(honest)
    ext = F.when(i % 11 == 0, ".exe").when(lang == "en", ".jpg").when((lang == "fr") & (i % 5 == 1), ".webp").when(lang == "fr", ".png").otherwise(".webp")
    case = F.when(F.col("source") == "src7", " Closed ").otherwise("OPEN")
    docs = load(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    reason = G.intake_reason(ext, declared, actual, F.col("n_chars"), F.col("n_chars") * 100, case, 9000, 600_000)
    return docs.groupBy(reason.alias("reason")).agg(row_count().alias("n"), F.sum("n_chars").alias("bytes"))


REQ_SQL = """rq as (select event_id, user_id, event_type, ts, sha256(concat('{"case_id":"', user_id, '","case_title":null,"file_sha256":"', sha256((cast(json_extract_string(props, '$.k') as integer) % 3)::varchar),
  '","intake_context":', case when event_type = 'view' then '{}' else concat('{"kind":"', event_type, '"}') end, '}')) as fp from events)"""


def requests_of(e):
    """Events as upload requests with their fingerprint; the same for a table and a stream."""
    k = F.get_json_object("props", "$.k").cast("int") % 3
    kind = F.when(F.col("event_type") == "view", "   ").otherwise(F.concat(F.lit(" "), "event_type"))
    fp = G.request_fingerprint(F.upper(F.sha2(k.cast("string"), 256)), F.col("user_id").cast("string"), F.lit(" "), {"kind": kind, "note": F.lit(None).cast("string")})
    return e.select("event_id", "user_id", "event_type", *[c for c in ("ts", "ts_us") if c in e.columns], fp.alias("fp"))


def intake_requests(spark, d):
    return requests_of(load(spark, d, "events"))


@query("i08_idempotent_intake", f"""with {REQ_SQL}, f as (select user_id, event_type, arg_min(fp, (ts, event_id)) as fp, arg_min(event_id, (ts, event_id)) as first_id from rq group by 1, 2)
select rq.event_id, rq.fp, case when rq.event_id = f.first_id then 'NEW' when rq.fp = f.fp then 'REPLAY' else 'CONFLICT' end as resolution from rq join f on rq.user_id = f.user_id and rq.event_type = f.event_type""")
def idempotent_intake(spark, d):
    return G.resolve_intake(intake_requests(spark, d), ["user_id", "event_type"], ["ts", "event_id"], "fp").select("event_id", "fp", "resolution")


@query("i09_outstanding_work", f"""with m(modality) as (values {", ".join(f"('{m}')" for m in MODALITIES)}), b as (select distinct o_custkey as item_id, case o_orderkey % 5 {" ".join(f"when {i} then '{m}'" for i, m in enumerate(MODALITIES))} end as modality from orders where o_orderpriority <> '1-URGENT')
select c_custkey as item_id, m.modality, sha256(concat('{{"item_id":', c_custkey, ',"modality":"', m.modality, '"}}')) as request_hash from customer, m where not exists (select 1 from b where b.item_id = c_custkey and b.modality = m.modality)""")
def outstanding_work(spark, d):
    items = load(spark, d, "customer").select(F.col("c_custkey").alias("item_id"))
    names = F.array(*[F.lit(m) for m in MODALITIES])
    status = F.when(F.col("o_orderpriority") == "1-URGENT", "FAILED").when(F.col("o_orderstatus") == "P", "RUNNING").when(F.col("o_orderstatus") == "O", "QUEUED").otherwise("COMPLETED")
    existing = load(spark, d, "orders").select(F.col("o_custkey").alias("item_id"), F.element_at(names, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("modality"), status.alias("status"))
    return G.outstanding_work(items, MODALITIES, existing)


@query("i10_orphans", """select 'lineitem.order' as fk, count(*) as orphans from lineitem where l_orderkey % 7 = 0 union all select 'lineitem.part', count(*) from lineitem where l_partkey % 9 = 0
union all select 'nation.region', count(*) from nation where n_regionkey = 2 union all select 'orders.customer', count(*) from orders where o_custkey % 5 = 0""")
def orphans(spark, d):
    """Children left behind after parents were removed, counted per foreign key."""
    li, o, n = load(spark, d, "lineitem"), load(spark, d, "orders"), load(spark, d, "nation")
    bad = M.dangling({
        "lineitem.order": (li, "l_orderkey", "l_orderkey", o.where("o_orderkey % 7 <> 0"), "o_orderkey"),
        "lineitem.part": (li, "l_orderkey", "l_partkey", load(spark, d, "part").where("p_partkey % 9 <> 0"), "p_partkey"),
        "orders.customer": (o, "o_orderkey", "o_custkey", load(spark, d, "customer").where("c_custkey % 5 <> 0"), "c_custkey"),
        "nation.region": (n.withColumn("n_nationkey", F.col("n_nationkey").cast("long")).withColumn("n_regionkey", F.col("n_regionkey").cast("long")), "n_nationkey", "n_regionkey",
                          load(spark, d, "region").where("r_regionkey <> 2"), "r_regionkey"),
    })
    return bad.groupBy("fk").agg(row_count().alias("orphans"))


def run_rows(spark, d, second=False):
    li = load(spark, d, "lineitem")
    flag = F.col("l_returnflag")
    if second:  # a re-run in which some results changed and some are missing
        flag = F.when(F.col("l_partkey") % 50 == 0, F.lit("N")).otherwise(flag)
        li = li.where("l_partkey % 77 <> 0")
    item = F.format_string("%d-%d-%d", "l_orderkey", "l_linenumber", "l_partkey")
    return li.select(item.alias("item"), (F.col("l_suppkey") % 23).alias("engine"), "l_suppkey", flag.alias("status"))


RUNS_SQL = """ra as (select concat(l_orderkey, '-', l_linenumber, '-', l_partkey) as item, l_suppkey % 23 as engine, l_suppkey, l_returnflag as status from lineitem),
rb as (select concat(l_orderkey, '-', l_linenumber, '-', l_partkey) as item, l_suppkey % 23 as engine, l_suppkey, case when l_partkey % 50 = 0 then 'N' else l_returnflag end as status from lineitem where l_partkey % 77 <> 0)"""


def _fp(table):
    words = ", ':', ".join(f"sum(('0x' || substr(h, {1 + 8 * i}, 8))::bigint)::bigint" for i in range(8))
    return f"select engine, count(*) as rows, sha256(concat(count(*), ':', {words})) as fingerprint from (select engine, sha256(concat_ws('|', item, engine, status)) as h from {table}) group by 1"


@query("i11_run_fingerprint", f"with {RUNS_SQL} select a.engine, a.rows, a.fingerprint, a.fingerprint = b.fingerprint as repeated from ({_fp('ra')}) a join ({_fp('rb')}) b on a.engine = b.engine")
def run_fingerprint(spark, d):
    """Both runs in one scan: the second has no status where it lost a result."""
    flag = F.col("l_returnflag")
    again = F.when(F.col("l_partkey") % 77 != 0, F.when(F.col("l_partkey") % 50 == 0, F.lit("N")).otherwise(flag))
    rows = load(spark, d, "lineitem").select(F.format_string("%d-%d-%d", "l_orderkey", "l_linenumber", "l_partkey").alias("item"),
                                             (F.col("l_suppkey") % 23).alias("engine"), flag.alias("first"), again.alias("again"))
    out = G.run_fingerprints(rows, ["engine"], {"a": F.col("first"), "b": F.col("again")}).where("rows_a > 0 and rows_b > 0")
    return out.select("engine", F.col("rows_a").alias("rows"), F.col("fingerprint_a").alias("fingerprint"), (F.col("fingerprint_a") == F.col("fingerprint_b")).alias("repeated"))


_FRAMED = lambda cols: "concat(" + ", ".join(f"coalesce(length({c}::varchar) || ':' || {c}::varchar, '-')" for c in cols) + ")"
_TREE_SQL = f"""rc as (select sha256({_FRAMED(["p_partkey"])}) as path, sha256({_FRAMED(["p_partkey", "p_name", "p_size"])}) as content, count(*) as entries from part group by all),
l2 as (select path[:2] as node, sha256(string_agg(path || ':' || content || '*' || entries || ';', '' order by path, content)) as digest, sum(entries)::bigint as entries from rc group by 1),
l1 as (select node[:1] as node, sha256(string_agg(node || ':' || digest || ';', '' order by node)) as digest, sum(entries)::bigint as entries from l2 group by 1),
l0 as (select '' as node, sha256(string_agg(node || ':' || digest || ';', '' order by node)) as digest, sum(entries)::bigint as entries from l1)"""


@query("i05_digest_tree", f"with {_TREE_SQL} select 0 as level, * from l0 union all select 1, * from l1 union all select 2, * from l2")
def digest_tree(spark, d):
    """Root, inner nodes and parts of the tree over all parts of the catalogue."""
    tree = D.digest_tree(load(spark, d, "part"), ["p_partkey"], ["p_name", "p_size"], depth=2)
    return reduce(lambda a, b: a.unionByName(b), [level.select(F.lit(k).alias("level"), "node", "digest", "entries") for k, level in enumerate(tree.levels)])


@query("i05_tree_difference", """select p_partkey, case when p_partkey % 200 = 3 then 'REMOVED' else 'CHANGED' end as kind from part where p_partkey % 200 = 3 or p_partkey % 150 = 7
union all select p_partkey + 10000000, 'ADDED' from part where p_partkey % 300 = 5""")
def tree_difference(spark, d):
    """A custody copy in which some records are gone, some are changed and some are new, found from the two trees."""
    k = F.col("p_partkey")
    before = load(spark, d, "part").select("p_partkey", "p_name", "p_size")
    after = before.where(k % 200 != 3).withColumn("p_size", F.when(k % 150 == 7, F.col("p_size") + 1).otherwise(F.col("p_size"))) \
        .unionByName(before.where(k % 300 == 5).withColumn("p_partkey", k + 10_000_000))
    depth = D.depth_for(before.count(), 50)
    made = [D.digest_tree(t, ["p_partkey"], ["p_name", "p_size"], depth) for t in (before, after)]
    return D.tree_difference(*made)


@query("i11_repeatability", f"""with {RUNS_SQL}, j as (select coalesce(ra.engine, rb.engine) as engine, coalesce(ra.status = rb.status, false) as same from ra full join rb on ra.item = rb.item and ra.l_suppkey = rb.l_suppkey)
select engine, count(*) as compared, count(*) filter (where same) as matching, {r('avg(same::integer)')} as match_rate from j group by 1""")
def repeatability(spark, d):
    return rounded(G.repeatability(run_rows(spark, d), run_rows(spark, d, True), ["item", "engine", "l_suppkey"]))


STATES = {"signup": "GENERATED", "view": "REVIEW_REQUIRED", "click": "ACKNOWLEDGED", "purchase": "CONFIRMED_BY_ANALYST", "error": "DISMISSED"}
STATE_SQL = "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in STATES.items()) + " end"
ALLOWED_SQL = ", ".join(f"('{a}', '{b}')" for a, bs in G.TRANSITIONS.items() for b in bs)


def states_of(e):
    table = F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])
    return e.select("event_id", "user_id", *[c for c in ("ts", "ts_us") if c in e.columns], F.element_at(table, F.col("event_type")).alias("status"))


def states(spark, d):
    return states_of(load(spark, d, "events"))


@query("i12_bad_transitions", f"""with s as (select event_id, user_id, {STATE_SQL} as status, lag({STATE_SQL}) over (partition by user_id order by ts, event_id) as old_status from events)
select event_id, user_id, old_status, status from s where old_status is not null and (old_status, status) not in (values {ALLOWED_SQL})""")
def bad_transitions(spark, d):
    return G.bad_transitions(states(spark, d), "user_id", ["ts", "event_id"], "status").select("event_id", "user_id", "old_status", "status")


@query("i13_lineage_review", """with x as (select o_orderkey as key, o_orderkey as a, o_orderkey + 1 as b, case o_orderstatus when 'O' then 'EXACT_BITSTREAM' else 'LIKELY_DERIVATIVE' end as kind,
  case when o_orderkey % 17 = 0 then 'MAYBE' when o_orderkey % 3 = 0 then 'REJECTED' else 'CONFIRMED_RELATION' end as st, case o_custkey % 4 when 0 then null when 1 then o_orderkey when 2 then o_orderkey + 1 else o_custkey + 10000000 end as parent from orders)
select key, 'UNKNOWN_STATUS' as rule from x where st = 'MAYBE' union all select key, 'PARENT_NOT_IN_PAIR' from x where st = 'CONFIRMED_RELATION' and parent is not null and parent not in (a, b)
union all select key, 'PARENT_REQUIRED' from x where st = 'CONFIRMED_RELATION' and kind <> 'EXACT_BITSTREAM' and parent is null""")
def lineage_review(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey") % 4
    rel = load(spark, d, "orders").select(
        k.alias("relation_id"), k.alias("item_a"), (k + 1).alias("item_b"), F.when(F.col("o_orderstatus") == "O", "EXACT_BITSTREAM").otherwise("LIKELY_DERIVATIVE").alias("relation_kind"),
        F.when(k % 17 == 0, "MAYBE").when(k % 3 == 0, "REJECTED").otherwise("CONFIRMED_RELATION").alias("review_status"),
        F.when(c == 1, k).when(c == 2, k + 1).when(c == 3, F.col("o_custkey") + 10_000_000).alias("parent_id"))
    return G.lineage_review_errors(rel)
