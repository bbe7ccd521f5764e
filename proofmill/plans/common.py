"""Stand-in views: the given tables seen as the entities the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import load

MODALITIES = ("METADATA", "ELA", "NOISE", "JPEG_DCT", "COPY_MOVE")

# lineitem as the long observation table; same text serves as the checking view.
DIRECTION_SQL = """case pmod(l_partkey, 5)
    when 0 then case when l_returnflag = 'R' then 'present' when l_returnflag = 'A' then 'absent'
                     else 'informational' end
    when 1 then case when l_quantity > 40 then 'elevated' else 'informational' end
    when 2 then case when l_quantity > 45 then 'elevated' else 'informational' end
    when 3 then case when l_discount < 0.02 then 'suppressed' else 'informational' end
    else case when l_tax >= 0.07 then 'candidate' else 'absent' end end"""
MODALITY_SQL = ("case pmod(l_partkey, 5) when 0 then 'METADATA' when 1 then 'ELA' when 2 then 'NOISE' "
                "when 3 then 'JPEG_DCT' else 'COPY_MOVE' end")
OBS_SQL = f"""select l_orderkey as item_id, l_linenumber, l_partkey, l_suppkey,
    {MODALITY_SQL} as modality,
    case when pmod(l_partkey, 5) = 0 then 'SOFTWARE_SIGNATURE' else 'MEASUREMENT' end as observation_type,
    {DIRECTION_SQL} as direction, l_quantity as normalized_value, l_extendedprice, l_discount, l_tax, l_returnflag
    from lineitem"""
OBS_DUCK = OBS_SQL.replace("pmod(l_partkey, 5)", "l_partkey % 5")


def observations(spark: SparkSession, d: str) -> DataFrame:
    item = load(spark, d, "lineitem")
    m = F.pmod("l_partkey", F.lit(5))
    modality = F.lit(MODALITIES[4])
    for i in (3, 2, 1, 0):
        modality = F.when(m == i, MODALITIES[i]).otherwise(modality)
    return item.select(
        F.col("l_orderkey").alias("item_id"), "l_linenumber", "l_partkey", "l_suppkey",
        modality.alias("modality"),
        F.when(m == 0, "SOFTWARE_SIGNATURE").otherwise("MEASUREMENT").alias("observation_type"),
        F.expr(DIRECTION_SQL).alias("direction"), F.col("l_quantity").alias("normalized_value"),
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
