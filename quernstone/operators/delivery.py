"""Exactly one copy of each message that was delivered at least once, without shuffling payloads.

Only the identifier, the order of delivery and the row's place (file, row in the file) are shuffled. The winners become
keep bits, gathered per file in blocks of 32,768 rows; what a block lacks is its deletion vector. Payloads are then read where
they lie, each row testing its own bit. Blocks are broadcast in slices of files whose vectors have a checked size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quernstone.plans.session import checkpointed

#: Rows that one bitmap holds (Spark's bitmap functions fix it) and its bytes.
BLOCK_ROWS, BLOCK_BYTES = 32768, 4096
#: Bytes of deletion vectors that may be broadcast at once: vectors of some 4e8 rows.
SLICE_BYTES = 48 << 20


def placed(df: DataFrame) -> DataFrame:
    """A file scan with each row's place: ``__file`` (hash of its path), ``__row`` (its position in that file)."""
    return df.withColumns({"__file": F.xxhash64(F.col("_metadata.file_path")), "__row": F.col("_metadata.row_index")})


def blank_to_null(c: Column) -> Column:
    """Identifiers as they are compared: white space around them removed, nothing left means no identifier."""
    trimmed = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.when(trimmed != "", trimmed)


def winners(df: DataFrame, ident: Column, order: list[Column]) -> DataFrame:
    """One place per identifier: the least by ``order``, then by place.

    A minimum is combined before the shuffle, so an identifier with a third of all rows costs one row a task.
    """
    keyed = placed(df).select(blank_to_null(ident).alias("__id"), F.struct(*order, F.col("__file"), F.col("__row")).alias("__at"))
    best = keyed.where(F.col("__id").isNotNull()).groupBy("__id").agg(F.min("__at").alias("__at"))
    return best.select(F.col("__at")["__file"].alias("__file"), F.col("__at")["__row"].alias("__row"))


def keep_bits(win: DataFrame) -> DataFrame:
    """Bitmaps of the places to keep: (__file, __block, __bits)."""
    position = F.col("__row") + 1  # bitmap_bucket_number counts from 1
    return win.groupBy("__file", F.bitmap_bucket_number(position).alias("__block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(position)).alias("__bits"))


def _kept(scan: DataFrame, bits: DataFrame) -> Column:
    """Whether a row's bit is set; ``scan`` must be joined with ``bits``."""
    bit = F.bitmap_bit_position(F.col("__row") + 1)
    byte = F.substring(F.col("__bits"), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))
    return F.coalesce((F.conv(F.hex(byte), 16, 10).cast("int").bitwiseAND(F.expr("shiftleft(1, cast(pmod(bitmap_bit_position(__row + 1), 8) as int))"))) != 0, F.lit(False))


def mark_deliveries(df: DataFrame, ident: str, order: list[str]) -> DataFrame:
    """``df`` (a file scan) with ``is_surplus``: true on every copy of a message but the earliest.

    Least by ``order`` counts as earliest; exact repeats of a row are told apart by their place, so one stays. In ``order``
    a null comes first. Rows whose identifier is null or blank are no messages and are not surplus. An empty scan gives no
    rows. Columns named __file, __row, __block, __bits, __id, __at or is_surplus raise.
    """
    if clash := {"__file", "__row", "__block", "__bits", "__id", "__at", "is_surplus"} & {*df.columns}:
        raise ValueError(f"column names in the way: {sorted(clash)}")
    bits = checkpointed(keep_bits(winners(df, F.col(ident), [F.col(c) for c in order])))
    per_file = bits.groupBy("__file").count()
    total = bits.count() * BLOCK_BYTES
    slices = -(-total // SLICE_BYTES)
    scan = placed(df).withColumn("__block", F.bitmap_bucket_number(F.col("__row") + 1))

    def applied(part: DataFrame, vectors: DataFrame) -> DataFrame:
        joined = part.join(F.broadcast(vectors), ["__file", "__block"], "left")
        surplus = blank_to_null(F.col(ident)).isNotNull() & ~_kept(joined, vectors)
        return joined.select(*df.columns, surplus.alias("is_surplus"))

    if slices <= 1:
        return applied(scan, bits)
    # files are packed into slices of checked size; a file is scanned in one slice only
    groups: list[list[tuple[str, int]]] = []
    room = 0
    sizes = {r["__file"]: r["count"] * BLOCK_BYTES for r in per_file.collect()}
    files = df.select(F.col("_metadata.file_path").alias("n")).distinct().select("n", F.xxhash64("n").alias("h")).collect()  # a row per file, no column is read
    for r in sorted(files):
        n = sizes.get(r["h"], 0)
        if not groups or room + n > SLICE_BYTES:
            groups.append([])
            room = 0
        groups[-1].append((r["n"], r["h"]))
        room += n
    out = None
    for group in groups:
        part = scan.where(F.col("_metadata.file_path").isin([n for n, _ in group]))
        done = applied(part, bits.where(F.col("__file").isin([h for _, h in group])))
        out = done if out is None else out.unionAll(done)
    return out


def deduplicated(df: DataFrame, ident: str, order: list[str]) -> DataFrame:
    """One copy of each message, and every row without an identifier, with the columns of ``df``. See mark_deliveries."""
    return mark_deliveries(df, ident, order).where(~F.col("is_surplus")).drop("is_surplus")
