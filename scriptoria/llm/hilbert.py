"""Hilbert-curve sharding: order rows along a space-filling curve and cut the order into runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.llm.scratch import stored


def hilbert_index(dims: list[Column], bits: int) -> Column:
    """Position on the Hilbert curve of a point with integer coordinates below ``2**bits``.

    Skilling's axes-to-transpose transform ("Programming the Hilbert curve",
    2004), written as one fold over (bit, axis) steps so that the expression
    grows with neither the number of bits nor of axes. A null coordinate counts as 0.
    """
    n = len(dims)
    if not dims or bits * n > 62:
        raise ValueError("dims must be given, and bits * dims stay below 63")
    steps = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def turn(x: Column, s: Column) -> Column:
        low, here, first = s["q"] - 1, F.get(x, s["i"]), F.get(x, F.lit(0))
        swap = first.bitwiseXOR(here).bitwiseAND(low)
        set_ = here.bitwiseAND(s["q"]) != 0
        return F.transform(
            x,
            lambda v, k: F.when(set_, F.when(k == 0, v.bitwiseXOR(low)).otherwise(v)).otherwise(
                F.when((s["i"] != 0) & ((k == 0) | (k == s["i"])), v.bitwiseXOR(swap)).otherwise(v)
            ),
        )

    start = F.array(*[F.coalesce(d, F.lit(0)).cast("int") for d in dims])
    turned = F.aggregate(steps, start, turn) if bits > 1 else start
    none = F.array().cast("array<int>")
    gray = F.aggregate(turned, none, lambda out, v: F.concat(out, F.array(v.bitwiseXOR(F.coalesce(F.get(out, F.size(out) - 1), F.lit(0))))))
    masks = F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)]) if bits > 1 else none
    flip = F.aggregate(masks, F.lit(0), lambda t, q: F.when(F.get(gray, F.lit(n - 1)).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
    spots = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])
    held = F.struct(gray.alias("x"), flip.alias("t"))
    return F.aggregate(
        spots,
        F.struct(F.lit(0).cast("long").alias("h"), held.alias("p")),
        lambda a, s: F.struct(
            (a["h"] * 2 + F.when(F.get(a["p"]["x"], s["i"]).bitwiseXOR(a["p"]["t"]).bitwiseAND(s["q"]) != 0, 1).otherwise(0)).alias("h"), a["p"].alias("p")
        ),
        lambda a: a["h"],
    )


def numbered(df: DataFrame, order: list[str], tag: str, partitions: int) -> DataFrame:
    """``df`` with rank, each row's place from 0 in the order of the columns ``order``, and total, the number of rows.

    One range shuffle; the rank is a row's number within its partition plus the sizes of the partitions before, and
    only that list, one row a partition, is broadcast. ``df`` must read a stored table, as the ranges are found by a scan of their own.
    """
    placed = df.repartitionByRange(partitions, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = stored(placed, tag)  # its numbers must not be drawn again by another sampling of ranges
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    return placed.withColumn("part", part).join(F.broadcast(counts), "part").withColumn("rank", F.col("before") + within).drop("at", "part", "before")


def rank_bucket(df: DataFrame, column: str, bits: int, partitions: int) -> Column:
    """The place of a text column's value among its sorted different values, on a scale of ``2**bits``; null counts as empty.

    Neighbouring buckets hold neighbouring values, so that a run of the curve has a narrow range of them. With more values than buckets,
    each bucket has a range of values. Only the buckets' least values come to the driver.
    """
    value = F.coalesce(F.col(column).cast("string"), F.lit(""))
    values = stored(df.select(value.alias("v")).distinct(), "values")
    bucket = F.expr(f"rank * {1 << bits} div total")
    cuts = sorted((r["v"], r["b"]) for r in numbered(values, ["v"], "ranks", partitions).groupBy(bucket.alias("b")).agg(F.min("v").alias("v")).collect())
    if not cuts:
        return F.lit(0)
    least = F.array(*[F.lit(v) for v, _ in cuts])
    at = F.size(F.filter(least, lambda v: v <= value)) - 1
    return F.get(F.array(*[F.lit(int(b)) for _, b in cuts]), F.greatest(at, F.lit(0))).cast("int")


def hilbert_shards(docs: DataFrame, shards: int = 16, bits: int = 6, partitions: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Deal ``docs`` into ``shards`` runs of the Hilbert order whose row counts are at most one apart.

    ``docs`` needs doc_id, text, lang and source; other columns are ignored, unless ``carry`` names them (or text, lang, source).
    Returns doc_id, size, text_crc32, hilbert, shard, slot (gapless from 0
    in each shard) and ``carry``, whose names must not be among the others (ValueError). The curve's axes are half octaves of size (none is cut off:
    64 of them reach 4 GB) and the places of lang and source among their sorted values. Equal texts take the least index that any of them has, so
    that they lie next to each other whatever their metadata; the cut between two shards may divide one group of them. A hot cell
    or a hot text is split among range partitions by doc_id and row. Nulls: a null text has size 1 and
    crc 0, null lang or source count as empty, a null doc_id sorts first. Repeated rows
    each get a slot of their own. An empty table gives no rows. Very long texts are hashed where they are read.

    Texts are read once; shuffles move some 60 bytes a row, and ``carry``.
    """
    own = ["doc_id", "size", "text_crc32", "hilbert", "shard", "slot"]
    if set(carry) & {*own, "digest", "row", "rank", "total", "least"}:
        raise ValueError("carry has a name of the result")
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(docs["text"], F.lit(""))
    size = F.octet_length(text).cast("long") + 1
    octave = F.least(F.floor(F.log2(size.cast("double")) * 2), F.lit((1 << bits) - 1)).cast("int")
    place = hilbert_index([octave, rank_bucket(docs, "lang", bits, n), rank_bucket(docs, "source", bits, n)], bits)
    keyed = docs.select(docs["doc_id"].alias("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), place.alias("hilbert"), F.xxhash64(text).alias("digest"), F.monotonically_increasing_id().alias("row"), *carry)
    keyed = stored(keyed, "keyed")
    same = ["digest", "size", "text_crc32"]
    least = stored(keyed.groupBy(*same).agg(F.min("hilbert").alias("least"), F.max("hilbert").alias("most")).where("least <> most").drop("most"), "equal")
    keyed = keyed.join(least, same, "left").withColumn("hilbert", F.coalesce("least", "hilbert")).drop("least")
    ranked = numbered(stored(keyed, "placed"), ["hilbert", "digest", "text_crc32", "doc_id", "row"], "hilbert", n)
    ranked = ranked.withColumn("shard", F.expr(f"rank * {shards} div total").cast("int"))
    first = F.expr(f"(cast(shard as bigint) * total + {shards - 1}) div {shards}")
    return ranked.withColumn("slot", F.col("rank") - first).select(*own, *carry)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One Parquet file for each shard, in the order of its slots, in a folder shard=N below ``path``; rows stream through one task a shard, so
    choose the number of shards by the size of file wanted. Readers skip files by the ranges in their footers."""
    n = sharded.agg(F.max("shard")).first()[0]
    sharded.repartition(1 if n is None else n + 1, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_ranges(sharded: DataFrame, columns: list[str]) -> DataFrame:
    """(shard, rows, and least_ and most_ of each column): what a reader needs to skip shards."""
    ends = [f(c).alias(f"{name}_{c}") for c in columns for name, f in (("least", F.min), ("most", F.max))]
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), *ends)


def op1_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = hilbert_shards(docs, 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")
