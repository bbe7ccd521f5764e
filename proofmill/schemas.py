"""Declared schemas. Nothing is inferred when a table is read."""

from __future__ import annotations

from pyspark.sql import types as T

_L, _I, _D, _S, _TS = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.TimestampNTZType()


def struct(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in cols.items()])


TABLES: dict[str, T.StructType] = {
    "region": struct(r_regionkey=_I, r_name=_S),
    "nation": struct(n_nationkey=_I, n_name=_S, n_regionkey=_I),
    "customer": struct(c_custkey=_L, c_name=_S, c_nationkey=_I, c_acctbal=_D, c_mktsegment=_S),
    "supplier": struct(s_suppkey=_L, s_name=_S, s_nationkey=_I, s_acctbal=_D),
    "part": struct(p_partkey=_L, p_name=_S, p_brand=_S, p_type=_S, p_size=_I, p_retailprice=_D),
    "orders": struct(o_orderkey=_L, o_custkey=_L, o_orderstatus=_S, o_totalprice=_D, o_orderdate=_TS,
                     o_orderpriority=_S),
    "lineitem": struct(l_orderkey=_L, l_partkey=_L, l_suppkey=_L, l_linenumber=_I, l_quantity=_D,
                       l_extendedprice=_D, l_discount=_D, l_tax=_D, l_returnflag=_S, l_linestatus=_S,
                       l_shipdate=_TS),
    "events": struct(event_id=_L, ts=_TS, user_id=_L, event_type=_S, value=_D, props=_S),
    "documents": struct(doc_id=_L, text=_S, lang=_S, source=_S, n_chars=_L),
    "embeddings": struct(vec_id=_L, embedding=T.ArrayType(T.FloatType()), label=_I),
    "pages": struct(page_id=_L, url=_S, html=_S),
    "benchmark": struct(item_id=_L, text=_S),
    "labels": struct(doc_id=_L, quality=_I, toxic=_I),
    "conversations": struct(conv_id=_L, turn=_L, role=_S, text=_S),
}

OBSERVATION = struct(
    item_id=_L, obs_id=_L, modality=_S, observation_type=_S, metric_name=_S, raw_value=_S,
    normalized_value=_D, direction=_S,
)

AUDIT_EVENT = struct(
    id=_L, case_id=_S, event_type=_S, timestamp=_S, actor=_S, safe_metadata=_S,
    sequence_number=_L, previous_hash=_S, event_hash=_S,
)

MANIFEST_IMAGE = T.StructType([
    T.StructField("image_id", _S), T.StructField("dataset_id", _S), T.StructField("source", _S),
    T.StructField("source_license", _S), T.StructField("filename", _S), T.StructField("sha256", _S),
    T.StructField("format", _S), T.StructField("width", _I), T.StructField("height", _I),
    T.StructField("color_mode", _S), T.StructField("authentic_or_manipulated", _S),
    T.StructField("manipulation_type", _S), T.StructField("ground_truth_mask", _S),
    T.StructField("ground_truth_availability", _S), T.StructField("compression_history_status", _S),
    T.StructField("known_dataset_limitations", T.ArrayType(_S)),
    T.StructField("expected_applicable_engines", T.ArrayType(_S)), T.StructField("notes", _S),
])

MANIFEST = T.StructType([
    T.StructField("manifest_version", _S), T.StructField("dataset_id", _S), T.StructField("dataset_version", _S),
    T.StructField("dataset_name", _S), T.StructField("dataset_type", _S), T.StructField("description", _S),
    T.StructField("creation_date", _S), T.StructField("provenance", T.MapType(_S, _S)),
    T.StructField("images", T.ArrayType(MANIFEST_IMAGE)),
])
