"""Column helpers shared by the corpus operators (all native expressions)."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

BLANKS = "[\\x20\\x09-\\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over a value that is computed once (a lambda variable), however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def whole_text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character stays as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def pieces(text: Column, separator: str) -> Column:
    """Non-empty pieces between separators."""
    return F.array_remove(F.split(text, separator), "")


def steps(n: Column) -> Column:
    """0 .. n-1, empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def starts_of(lengths: Column, block: int = 64) -> Column:
    """Sum of all lengths before each place, without a quadratic walk: sums of blocks first, then inside a block."""
    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)

    def blocks(a: Column) -> Column:
        return F.transform(steps(F.ceil(F.size(a) / block)), lambda b: F.slice(a, b * block + 1, block))

    def inside(part: Column, base: Column) -> Column:
        return F.transform(steps(F.size(part)), lambda i: base + total(F.slice(part, F.lit(1), i)))

    def placed(a: Column) -> Column:
        return let(blocks(a), lambda bs: let(F.transform(bs, total), lambda sums: F.flatten(F.zip_with(
            bs, F.transform(steps(F.size(sums)), lambda b: total(F.slice(sums, F.lit(1), b))), inside))))

    return let(lengths, placed)


def shingle_hashes(words: Column, n: int) -> Column:
    """64-bit hashes of all runs of n words, in order; empty with fewer words.

    Runs are built by doubling, so the work per word does not grow with n.
    """
    def shifted(left: Column, right: Column, by: int) -> Column:
        size = F.greatest(F.size(right) - by, F.lit(0))
        return let(F.slice(right, by + 1, size), lambda tail: F.zip_with(F.slice(left, F.lit(1), F.size(tail)), tail, lambda a, b: F.xxhash64(a, b)))

    def grow(single: Column, power: Column, width: int, done: Column | None, rest: int, have: int) -> Column:
        # power: hashes of runs of `width`; done: hashes of runs of `have` words; rest: words still to add
        if rest & width:
            joined = power if done is None else shifted(done, power, have)
            left = rest - width
            if not left:
                return joined
            return let(joined, lambda d: let(shifted(power, power, width), lambda p: grow(single, p, width * 2, d, left, have + width)))
        return let(shifted(power, power, width), lambda p: grow(single, p, width * 2, done, rest, have))

    first = F.transform(words, lambda w: F.xxhash64(w))
    return let(first, lambda h: grow(h, h, 1, None, n, 0))


def keyed(df: DataFrame, *cols: str) -> DataFrame:
    """Add k1, k2: 128 hash bits over `cols`, an identity that is never null; equal rows share it."""
    return df.withColumns({"k1": F.xxhash64(F.lit(1), *cols), "k2": F.xxhash64(*cols, F.lit(2))})


def sized(df: DataFrame, most_rows: int = 200_000) -> tuple[DataFrame, bool]:
    """`df` written once, with a broadcast hint where it has at most `most_rows` rows; joins beyond that shuffle."""
    written = cut(df)
    small = written.limit(most_rows + 1).count() <= most_rows
    return (F.broadcast(written), True) if small else (written, False)


FILTER_BITS = 1 << 26


def bit_filter(keys: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """A bitmap of the remainders of k1: (bucket, bitmap), at most `bits` / 8 bytes in all, 8 MB as it is."""
    place = F.pmod("k1", F.lit(bits))
    return cut(keys.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap")))


def may_hold(rows: DataFrame, bitmap: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """`rows` with __may: whether k1 may be among the filter's keys. True for every key in it, so a join behind the filter loses nothing."""
    place = F.pmod("k1", F.lit(bits))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("bitmap", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    known = F.broadcast(bitmap.withColumnRenamed("bucket", "__bucket"))
    found = rows.withColumn("__bucket", F.bitmap_bucket_number(place)).join(known, "__bucket", "left")
    hit = F.coalesce(F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1, F.lit(False))
    return found.withColumn("__may", hit).drop("__bucket", "bitmap")
