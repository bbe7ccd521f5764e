"""opN_ queries: the given tables mapped to the operators' records, and their results mapped back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import load
from .common import BLANKS, pieces, whole_text
from .containment import containment_search
from .context_tree import context_tree_scores
from .cross_parsing import language_of
from .license_scan import TEMPLATES, license_scan
from .merkle import merkle_manifest
from .mixing import layout_topic, mixture, token_count
from .near_duplicates import near_duplicates
from .periodic_runs import periodic_runs
from .personal_data import KINDS, personal_data
from .quality_rules import quality_rules
from .repeated_passages import repeated_passages
from .toxicity import toxicity
from .trusted_text import trusted_text_quality

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as intake records."""
    return load(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("evidence_id"), F.col("text").alias("intake_notes"), F.col("lang").alias("language"), F.col("source").alias("source_platform"))


def license_sql() -> str:
    """Plain search for every unchanged template; a notice with changed words (score below 1) occurs in none of the given tables."""
    base = " or ".join("(" + " and ".join(f"w[i + {k + 1}] = '{word}'" for k, word in enumerate(t.text.split())) + ")" for t in TEMPLATES if t.base)

    def labels(chosen):
        cases = ", ".join(f"case when contains(t, ' {t.text} ') then '{t.label}' end" for t in chosen)
        return f"array_to_string(list_sort(list_distinct(list_filter([{cases}], lambda x: x is not null))), ',')"
    return f"""
with w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from documents),
p as (select doc_id, w, concat(' ', array_to_string(w, ' '), ' ') as t, list_filter(range(0, len(w)), lambda i: coalesce({base}, false)) as spots from w)
select doc_id, len(w)::bigint as n_words, len(spots)::bigint as n_base, list_min(spots)::bigint as first_word, list_max(spots)::bigint as last_word,
  {labels([t for t in TEMPLATES if t.base])} as base_labels, {labels(TEMPLATES)} as labels, case when labels <> '' then 1.0::double else 0.0::double end as score from p"""


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(intake(spark, sf_dir)).withColumnRenamed("evidence_id", "doc_id")


def span_text(spans) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query
def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return personal_data(intake(spark, sf_dir)).select(
        F.col("evidence_id").alias("doc_id"), *[count(k.name) for k in KINDS if k.base], F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"), F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("top_score"))


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(intake(spark, sf_dir)).select(
        F.col("evidence_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


@query
def op8_containment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("reference_id"), F.col("text").alias("reference_text"))
    return containment_search(intake(spark, sf_dir), items).select(F.col("evidence_id").alias("doc_id"), F.col("reference_id").alias("item_id"),
                                                                   "n_shingles", "n_shared", "containment")


@query
def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(intake(spark, sf_dir), shingle=2).withColumnRenamed("evidence_id", "doc_id")


@query
def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return repeated_passages(intake(spark, sf_dir)).select(
        F.col("evidence_id").alias("doc_id"), "n_bytes", length.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept_bytes", 256).alias("kept_sha256"))


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = load(spark, sf_dir, "labels").select(F.col("doc_id").alias("evidence_id"), "toxic")
    return toxicity(intake(spark, sf_dir), labels).withColumnRenamed("evidence_id", "doc_id")


@query
def op10_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("intake_notes")
    records = intake(spark, sf_dir).select("evidence_id", "source_platform", "language", layout_topic(text).alias("topic"), token_count(text).alias("n_tokens"))
    return mixture(records).select(F.col("evidence_id").alias("doc_id"), F.col("source_platform").alias("source"), F.col("language").alias("lang"), "topic",
                                   "n_tokens", "weight", "probability", "sampled")


@query
def op6_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree_scores(intake(spark, sf_dir)).withColumnRenamed("evidence_id", "doc_id")


@query
def op9_trusted_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = load(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("evidence_id"))
    return trusted_text_quality(intake(spark, sf_dir), trusted, stored=True).withColumnsRenamed({"evidence_id": "doc_id", "language": "lang"})


def with_planted_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as intake records; where crc32(doc_id as text) ends in 0, the words from place g % n on repeat their first 1 + (n - a) / (3 + g % 8) (g: the crc's other digits)."""
    words = pieces(whole_text(F.col("text")), BLANKS)
    crc = F.crc32(F.col("doc_id").cast("string"))
    rows = load(spark, sf_dir, "documents").select("doc_id", "text", crc.alias("h"), F.floor(crc / 10).alias("g"), F.when(crc % 10 == 0, words).alias("w"))
    n = F.size("w").cast("long")
    a = F.col("g") % n
    period = (1 + F.floor((n - a) / (3 + F.col("g") % 8))).cast("long")
    tail = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get("w", F.when(i < a, i).otherwise(a + (i - a) % period).cast("int")))
    planted = F.when(F.size("w") > 0, F.array_join(tail, " ")).otherwise(F.col("text"))
    return rows.select(F.col("doc_id").alias("evidence_id"), planted.alias("intake_notes"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    rows = periodic_runs(with_planted_tail(spark, sf_dir)).withColumn("best", best)
    return rows.select(F.col("evidence_id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.n").alias("length"),
                       (-F.col("best.p")).alias("period"), F.floor(1000 * F.col("best.n") / -F.col("best.p")).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"),
                       F.sha2("collapsed", 256).alias("collapsed_sha256"))


# Levels by recursion over pairs, siblings by the flipped last bit of a place, crc32 bit by bit.
MERKLE_SQL = """
with recursive d as (select doc_id, lang, coalesce('=' || lang, '-') as tree, n_chars,
    concat_ws('', coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-')) as head,
    coalesce(strlen(text) || ':' || text, '-') as tail,
    xor(list_reduce([4294967295::bigint] || list_transform(range(0, strlen(doc_id::varchar)), lambda i: ord(substr(doc_id::varchar, i::int + 1, 1))::bigint),
        lambda c, b: list_reduce([xor(c, b)] || list_transform(range(0, 8), lambda i: 0::bigint), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) as crc from documents),
f as (select doc_id, tree, sha256(concat(head, coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-'), tail)) as leaf,
    case when crc % 7 = 0 then sha256(concat(head, coalesce(strlen((n_chars + 1)::varchar) || ':' || (n_chars + 1), '-'), tail)) end as found from d),
leaves as (select doc_id, tree, leaf, coalesce(found, leaf) as found, row_number() over w - 1 as pos, count(*) over (partition by tree) as n from f
    window w as (partition by tree order by doc_id nulls first, leaf, found)),
up(tree, lvl, pos, n, h) as (select tree, 0, pos, n, leaf from leaves
    union all select tree, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' order by pos)) from up where n > 1 group by tree, lvl, pos // 2, n),
subs as (select tree, h, row_number() over (order by tree) - 1 as pos, count(*) over () as n from up where n = 1),
top(lvl, pos, n, h) as (select 0, pos, n, h from subs
    union all select lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' order by pos)) from top where n > 1 group by lvl, pos // 2, n),
near as (select l.doc_id, l.leaf, l.found, l.tree, l.pos, 0 as part, u.lvl, u.h, (l.pos >> u.lvl) % 2 as own from leaves l join up u on u.tree = l.tree and u.pos = xor(l.pos >> u.lvl, 1) and u.n > 1
    union all select l.doc_id, l.leaf, l.found, l.tree, l.pos, 1, t.lvl, t.h, (s.pos >> t.lvl) % 2 from leaves l join subs s on s.tree = l.tree join top t on t.pos = xor(s.pos >> t.lvl, 1) and t.n > 1),
lone as (select tree, pos, part, lvl from (select l.tree, l.pos, 0 as part, u.lvl from leaves l join up u on u.tree = l.tree and u.pos = l.pos >> u.lvl and u.n > 1
    union all select l.tree, l.pos, 1, t.lvl from leaves l join subs s on s.tree = l.tree join top t on t.pos = s.pos >> t.lvl and t.n > 1)),
steps as (select o.tree, o.pos, list(coalesce(n.own || n.h, '0') order by o.part, o.lvl) as steps, string_agg(coalesce(n.h, ''), '' order by o.part, o.lvl) as proof
    from lone o left join near n on n.tree = o.tree and n.pos = o.pos and n.part = o.part and n.lvl = o.lvl group by o.tree, o.pos),
res as (select l.doc_id, l.leaf, s.h as subroot, (select h from top where n = 1) as root, sha256(coalesce(w.proof, '')) as proof_sha256,
    list_reduce([l.found] || coalesce(w.steps, []), lambda h, x: sha256(case when x[1] = '1' then x[2:] || h else h || x[2:] end)) as folded_root
    from leaves l join subs s on s.tree = l.tree left join steps w on w.tree = l.tree and w.pos = l.pos)
select doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root as verified from res"""


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("evidence_id"), F.col("source").alias("source_platform"), F.col("lang").alias("case_id"),
                                                      F.col("n_chars").alias("file_size"), F.col("text").alias("intake_notes"))
    tampered = F.when(F.crc32(F.col("evidence_id").cast("string")) % 7 == 0, F.col("file_size") + 1).otherwise(F.col("file_size"))
    proof = F.sha2(F.array_join(F.transform("siblings", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    return merkle_manifest(records, presented={"file_size": tampered}).select(
        F.col("evidence_id").alias("doc_id"), "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", "verified")


@query
def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_of(intake(spark, sf_dir)).withColumnsRenamed({"evidence_id": "doc_id", "language": "lang_pred"})


ORACLES["op1_license_scan"] = license_sql()
ORACLES["op12_merkle_manifest"] = MERKLE_SQL
