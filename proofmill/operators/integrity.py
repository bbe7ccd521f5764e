"""Hash chains, custody, snapshots, intake rules, idempotency, transitions, fingerprints."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import null_safe_join
from ..functions.numeric import row_count
from ..functions.text import GENESIS_HASH, canonical_json, is_sha256
from ..session import cut, fresh_dir
from ..sources.sinks import WORDS, digest_sums, digest_text
from .skew import Sequenced

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of this package



def chain_text(df: DataFrame) -> DataFrame:
    """Add the fixed parts of the canonical payload around previous hash and sequence number.

    Needs id, case_id, evidence_id, event_type, timestamp, actor, safe_metadata.
    Keys are sorted, nulls printed, nothing padded: head + previous + middle + sequence + tail.
    """
    first = canonical_json({c: F.col(c) for c in ("actor", "case_id", "event_type", "evidence_id", "id")})
    meta = canonical_json({"safe_metadata": F.col("safe_metadata")})
    time = canonical_json({"timestamp": F.col("timestamp")})
    inner = lambda c: F.substring(c, F.lit(2), F.length(c) - 2)  # noqa: E731 - drop the braces
    return df.withColumn("__head", F.concat(F.lit("{"), inner(first), F.lit(',"previous_hash":"'))) \
        .withColumn("__mid", F.concat(F.lit('",'), inner(meta), F.lit(',"sequence_number":'))) \
        .withColumn("__tail", F.concat(F.lit(","), inner(time), F.lit("}")))


def event_hash(previous: Column, sequence: Column) -> Column:
    """Hash of a row prepared by `chain_text`."""
    return F.sha2(F.concat("__head", previous, "__mid", sequence.cast("string"), "__tail"), 256)


CHAIN_SEGMENT = 2_000_000


def build_chain(df: DataFrame, order: Sequence[str], segment: int = CHAIN_SEGMENT) -> DataFrame:
    """Number the events of every case and link them by hash: (case_id, id, sequence_number, previous_hash, event_hash).

    Each hash needs the one before it, so only the linking of one case is
    sequential; texts and sequence numbers are made in parallel. Rows stream
    through tasks that keep one hash. A case longer than `segment` is linked
    segment by segment, each written before the next starts from its head, so
    no task ever holds a whole long case and a lost executor costs one segment.
    """
    kind = df.schema["case_id"].dataType.simpleString()
    schema = f"case_id {kind}, id long, sequence_number long, previous_hash string, event_hash string"

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        case, prev = None, GENESIS_HASH
        for pdf in batches:
            prevs, hashes = [], []
            for c, seq, start, head, mid, tail in zip(*[pdf[n] for n in ("case_id", "seq", "start", "head", "mid", "tail")]):
                if c != case:
                    case, prev = c, start
                prevs.append(prev)
                prev = hashlib.sha256(f"{head}{prev}{mid}{seq}{tail}".encode()).hexdigest()
                hashes.append(prev)
            yield pd.DataFrame({"case_id": pdf["case_id"], "id": pdf["id"], "sequence_number": pdf["seq"], "previous_hash": prevs, "event_hash": hashes})

    def linked(part: DataFrame) -> DataFrame:
        return part.repartition("case_id").sortWithinPartitions("case_id", "seq") \
            .select("case_id", "id", "seq", "start", "head", "mid", "tail").mapInPandas(link, schema)

    text = chain_text(df).select("case_id", "id", *[c for c in order if c not in ("case_id", "id")], *[F.col(f"__{c}").alias(c) for c in ("head", "mid", "tail")])
    ready = Sequenced(text, ["case_id"], order).ordinal("seq").withColumn("start", F.lit(GENESIS_HASH))
    longest = df.groupBy("case_id").agg(row_count().alias("n")).agg(F.max("n")).first()[0] or 0
    if longest <= segment:
        return linked(ready)
    path = fresh_dir(df.sparkSession, "chain")
    ready = ready.withColumn("part", F.floor((F.col("seq") - 1) / segment))
    ready.write.partitionBy("part").parquet(path)
    stored = df.sparkSession.read.schema(ready.schema).parquet(path)
    parts, heads = [], None
    for i in range(-(-longest // segment)):
        part = stored.where(F.col("part") == i)
        if heads is not None:
            part = null_safe_join(part.drop("start"), heads, ["case_id"])
        parts.append(cut(linked(part)))
        heads = parts[-1].where(F.col("sequence_number") == (i + 1) * segment).select("case_id", F.col("event_hash").alias("start"))
    return reduce(DataFrame.unionByName, parts)


def verify_chain(events: DataFrame) -> DataFrame:
    """Every violation of every row: sequence gap, wrong link, wrong hash. Fully parallel; texts are hashed where they are read and stay there."""
    wrong = F.col("event_hash") != event_hash(F.col("previous_hash"), F.col("sequence_number"))
    narrow = chain_text(events).select("case_id", "id", "sequence_number", "previous_hash", "event_hash", wrong.alias("__wrong"))
    linked = Sequenced(narrow, ["case_id"], ["sequence_number", "id"]).shift({"__pseq": "sequence_number", "__phash": "event_hash"}, -1)
    checks = [
        (F.col("sequence_number") != F.coalesce(F.col("__pseq"), F.lit(0)) + 1, "SEQUENCE_GAP"),
        (F.col("previous_hash") != F.coalesce(F.col("__phash"), F.lit(GENESIS_HASH)), "PREVIOUS_HASH_MISMATCH"),
        (F.col("__wrong"), "EVENT_HASH_MISMATCH"),
    ]
    found = F.array_compact(F.array(*[F.when(c, name) for c, name in checks]))
    return linked.select("case_id", "id", "sequence_number", F.explode(found).alias("violation"))


def chain_status(events: DataFrame, violations: DataFrame) -> DataFrame:
    """Per case: NOT_PRESENT, PARTIAL, BROKEN or VERIFIED, with its head."""
    full = F.col("sequence_number").isNotNull() & F.col("previous_hash").isNotNull() & F.col("event_hash").isNotNull()
    one = events.groupBy("case_id").agg(
        row_count().alias("events"), F.count_if(full).alias("__full"), F.max("sequence_number").alias("head_sequence"),
        F.max_by("event_hash", "sequence_number").alias("head_hash"))
    bad = violations.groupBy("case_id").agg(row_count().alias("violations"))
    status = (F.when(F.col("__full") == 0, "NOT_PRESENT").when(F.col("__full") < F.col("events"), "PARTIAL")
              .when(F.col("violations") > 0, "BROKEN").otherwise("VERIFIED"))
    return one.join(bad, "case_id", "left").withColumn("violations", F.coalesce("violations", F.lit(0)).cast("long")) \
        .select("case_id", "events", "violations", "head_sequence", "head_hash", status.alias("status"))


def custody_check(items: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Recorded against recomputed digest. items: key, recorded; stored: key, actual (NULL when unreadable)."""
    j = items.join(stored.withColumn("__there", F.lit(True)), key, "left")
    status = (F.when(F.col("__there").isNull(), "FILE_MISSING").when(F.col("actual").isNull(), "READ_ERROR")
              .when(F.lower("actual") == F.lower(F.coalesce("recorded", F.lit(""))), "VERIFIED_INTACT").otherwise("TAMPER_OR_BITROT_DETECTED"))
    return j.withColumn("status", status).withColumn("intact", F.col("status") == "VERIFIED_INTACT").drop("__there")


def replay_verdict(cases: DataFrame, checked: DataFrame, case: str) -> DataFrame:
    """VERIFIED, EMPTY_CASE or INTEGRITY_VIOLATION per case with counts."""
    c = checked.groupBy(case).agg(row_count().alias("items"), F.count_if("intact").alias("intact_items"))
    j = cases.join(c, case, "left").fillna(0, ["items", "intact_items"])
    return j.withColumn("verdict", F.when(F.col("items") == 0, "EMPTY_CASE").when(F.col("items") == F.col("intact_items"), "VERIFIED")
                        .otherwise("INTEGRITY_VIOLATION"))


def validate(df: DataFrame, key: str, rules: Mapping[str, Column], unique: Sequence[str] = ()) -> DataFrame:
    """Error rows (key, rule): a rule is a column that is true when the row breaks it.

    `unique` columns add DUPLICATE_<col> for every row of a repeated value.
    """
    hits = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(True)), name) for name, cond in rules.items()]))
    out = df.select(F.col(key).alias("key"), F.explode(hits).alias("rule"))
    for c in unique:
        repeated = df.groupBy(c).agg(row_count().alias("__n")).where("__n > 1").select(c)
        out = out.unionByName(df.join(repeated, c, "left_semi").select(F.col(key).alias("key"), F.lit(f"DUPLICATE_{c.upper()}").alias("rule")))
    return out


def verdict(df: DataFrame, errors: DataFrame) -> DataFrame:
    """One row: rows checked, rows with errors, errors, VALID or INVALID."""
    total = df.agg(row_count().alias("rows"))
    bad = errors.agg(F.countDistinct("key").alias("bad_rows"), row_count().alias("errors"))
    return total.join(F.broadcast(bad)).withColumn("status", F.when(F.col("errors") == 0, "VALID").otherwise("INVALID"))


# Accepted types, their extensions and MIME names.
TYPES = {"JPEG": ((".jpg", ".jpeg"), "image/jpeg"), "PNG": ((".png",), "image/png"), "WEBP": ((".webp",), "image/webp")}


def intake_reason(extension: Column, declared: Column, actual: Column, size: Column, pixels: Column, case_status: Column,
                  max_size: int, max_pixels: int) -> Column:
    """First reason to refuse an upload, or ACCEPTED, in the order the checks are made."""
    exts = [e for es, _ in TYPES.values() for e in es]
    mimes = [m for _, m in TYPES.values()]
    expected = F.lit(None).cast("string")
    fits_ext = F.lit(False)
    for name, (es, mime) in TYPES.items():
        expected = F.when(actual == name, mime).otherwise(expected)
        fits_ext = fits_ext | ((actual == name) & extension.isin(*es))
    return (F.when(F.lower(F.trim(case_status)) == "closed", "CASE_CLOSED").when(~extension.isin(*exts), "UNSUPPORTED_EXTENSION")
            .when(~declared.isin(*mimes), "UNSUPPORTED_MIME").when(size > max_size, "TOO_LARGE").when(size == 0, "EMPTY")
            .when(pixels > max_pixels, "TOO_MANY_PIXELS").when(expected.isNull() | (expected != declared), "TYPE_MISMATCH")
            .when(~fits_ext, "EXTENSION_MISMATCH").otherwise("ACCEPTED"))


def request_fingerprint(file_hash: Column, case_id: Column, title: Column, context: Mapping[str, Column]) -> Column:
    """Digest of the logical request: trimmed non-empty fields only, keys sorted."""
    def clean(c: Column) -> Column:
        t = F.trim(c.cast("string"))
        return F.when(t != "", t)
    ctx = F.to_json(F.struct(*[clean(context[k]).alias(k) for k in sorted(context)]))  # null fields drop out
    body = F.concat(
        F.lit('{"case_id":'), F.coalesce(F.concat(F.lit('"'), clean(case_id), F.lit('"')), F.lit("null")),
        F.lit(',"case_title":'), F.coalesce(F.concat(F.lit('"'), clean(title), F.lit('"')), F.lit("null")),
        F.lit(',"file_sha256":"'), F.lower(F.trim(file_hash)), F.lit('","intake_context":'), ctx, F.lit("}"))
    return F.sha2(body, 256)


def resolve_intake(requests: DataFrame, keys: Sequence[str], order: Sequence[str], fingerprint: str) -> DataFrame:
    """NEW, REPLAY or CONFLICT against the first request of each key (min by order, then one join)."""
    first = requests.groupBy(*keys).agg(F.min(F.struct(*order, fingerprint)).alias("__f"))
    j = requests.join(first, list(keys))
    is_first = F.struct(*order) == F.struct(*[F.col(f"__f.{c}") for c in order])
    return j.withColumn("resolution", F.when(is_first, "NEW").when(F.col(fingerprint) == F.col(f"__f.{fingerprint}"), "REPLAY").otherwise("CONFLICT")).drop("__f")


def outstanding_work(items: DataFrame, modalities: Sequence[str], existing: DataFrame) -> DataFrame:
    """Item x modality requests not yet queued, running or completed, each with its request hash."""
    grid = items.select("item_id", F.explode(F.array(*[F.lit(m) for m in modalities])).alias("modality"))
    body = canonical_json({"item_id": F.col("item_id"), "modality": F.col("modality")})
    hashed = grid.withColumn("request_hash", F.sha2(body, 256))
    busy = existing.where(F.col("status").isin("QUEUED", "RUNNING", "COMPLETED")).select("item_id", "modality").distinct()
    return hashed.join(busy, ["item_id", "modality"], "left_anti")


SHARDS = 16


def run_fingerprint(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Order-free digest of (item, engine, status) rows per key."""
    row = F.sha2(F.concat_ws("|", F.col("item").cast("string"), F.col("engine").cast("string"), "status"), 256)
    return results.groupBy(*keys).agg(row_count().alias("rows"), *digest_sums(row)).select(*keys, "rows", digest_text(F.col("rows")).alias("fingerprint"))


def run_fingerprints(results: DataFrame, keys: Sequence[str], runs: Mapping[str, Column]) -> DataFrame:
    """Order-free digests of several runs over one table, in one scan: rows_{run} and fingerprint_{run} per key.

    `runs` gives each run's status of a row, null where the run has no such
    row. A status equal to the first run's is not hashed again. Hash words are
    added as whole numbers in a few shards of a key and only those sums as
    decimals, so any number of rows fits.
    """
    names = list(runs)
    item = F.concat_ws("|", F.col("item").cast("string"), F.col("engine").cast("string"))
    rows = results.select(*keys, item.alias("__item"), *[status.alias(f"__s{i}") for i, status in enumerate(runs.values())])
    rows = rows.withColumn("__shard", F.pmod(F.xxhash64("__item"), F.lit(SHARDS)))
    hashed = lambda i: F.sha2(F.concat_ws("|", "__item", F.col(f"__s{i}")), 256)
    rows = rows.withColumn("__h0", hashed(0))
    for i in range(1, len(names)):
        rows = rows.withColumn(f"__h{i}", F.when(F.col(f"__s{i}").eqNullSafe(F.col("__s0")), F.col("__h0")).otherwise(hashed(i)))
    word = lambda i, w: F.conv(F.substring(f"__h{i}", 1 + 8 * w, 8), 16, 10).cast("long")
    rows = rows.withColumns({f"__w0_{w}": word(0, w) for w in range(WORDS)})
    for i in range(1, len(names)):
        rows = rows.withColumns({f"__w{i}_{w}": F.when(F.col(f"__s{i}").eqNullSafe(F.col("__s0")), F.col(f"__w0_{w}")).otherwise(word(i, w)) for w in range(WORDS)})
    there = lambda i, c: F.when(F.col(f"__s{i}").isNotNull(), c)
    some = rows.groupBy(*keys, "__shard").agg(*[F.count(f"__s{i}").alias(f"__n{i}") for i in range(len(names))],
                                              *[F.sum(there(i, F.col(f"__w{i}_{w}"))).alias(f"__w{i}_{w}") for i in range(len(names)) for w in range(WORDS)])
    sums = some.groupBy(*keys).agg(*[F.sum(f"__n{i}").alias(f"__n{i}") for i in range(len(names))],
                                   *[F.sum(F.col(f"__w{i}_{w}").cast("decimal(38,0)")).alias(f"__w{i}_{w}") for i in range(len(names)) for w in range(WORDS)])
    text = lambda i: F.concat_ws(":", F.col(f"__n{i}").cast("string"), *[F.coalesce(F.col(f"__w{i}_{w}"), F.lit(0)).cast("string") for w in range(WORDS)])
    return sums.select(*keys, *[c for i, name in enumerate(names) for c in (F.col(f"__n{i}").alias(f"rows_{name}"), F.sha2(text(i), 256).alias(f"fingerprint_{name}"))])


def repeatability(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of (item, engine) results equal in two runs, per engine; unmatched rows count against it."""
    a = first.withColumnRenamed("status", "__a")
    b = second.withColumnRenamed("status", "__b")
    same = F.coalesce(F.col("__a") == F.col("__b"), F.lit(False))
    return a.join(b, list(keys), "full_outer").groupBy("engine").agg(
        row_count().alias("compared"), F.count_if(same).alias("matching"), F.avg(same.cast("double")).alias("match_rate"))


# Allowed status changes of a finding.
TRANSITIONS = {
    "GENERATED": ("REVIEW_REQUIRED", "ACKNOWLEDGED", "CONFIRMED_BY_ANALYST", "DISMISSED", "INCONCLUSIVE"),
    "REVIEW_REQUIRED": ("ACKNOWLEDGED", "CONFIRMED_BY_ANALYST", "DISMISSED", "INCONCLUSIVE"),
    "ACKNOWLEDGED": ("CONFIRMED_BY_ANALYST", "DISMISSED", "INCONCLUSIVE", "REVIEW_REQUIRED"),
    "CONFIRMED_BY_ANALYST": ("DISMISSED", "INCONCLUSIVE", "REVIEW_REQUIRED"),
    "DISMISSED": ("REVIEW_REQUIRED", "ACKNOWLEDGED", "CONFIRMED_BY_ANALYST"),
    "INCONCLUSIVE": ("REVIEW_REQUIRED", "ACKNOWLEDGED", "CONFIRMED_BY_ANALYST", "DISMISSED"),
}


def allowed_change(old: Column, new: Column) -> Column:
    table = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    return F.coalesce(F.array_contains(F.element_at(table, old), new), F.lit(False))


def bad_transitions(df: DataFrame, key: str, order: Sequence[str], status: str) -> DataFrame:
    """Status changes the table does not allow (the first status of a key is not a change)."""
    out = Sequenced(df, [key], order).shift({"old_status": status}, -1)
    return out.where(F.col("old_status").isNotNull() & ~allowed_change(F.col("old_status"), F.col(status)))


def lineage_review_errors(df: DataFrame) -> DataFrame:
    """Reviews that break the rules: parent outside the pair, or a non-exact confirmation without parent."""
    confirmed = F.col("review_status") == "CONFIRMED_RELATION"
    parent = F.col("parent_id")
    return validate(df, "relation_id", {
        "UNKNOWN_STATUS": ~F.col("review_status").isin("CONFIRMED_RELATION", "REJECTED", "INCONCLUSIVE"),
        "PARENT_NOT_IN_PAIR": confirmed & parent.isNotNull() & ~((parent == F.col("item_a")) | (parent == F.col("item_b"))),
        "PARENT_REQUIRED": confirmed & (F.col("relation_kind") != "EXACT_BITSTREAM") & parent.isNull(),
    })


def bad_digest(col: Column) -> Column:
    return ~F.coalesce(is_sha256(col), F.lit(False))
