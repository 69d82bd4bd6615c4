"""Numeric band join: the lines whose unit price lies near an item's price, by equal-width buckets on cents.

Unit prices are whole cents, so lines are summed up per cent before anything is dealt out: a line group keeps
one bucket of the grid, an item's price goes to every bucket its interval touches, both meet in a shuffle
equi-join on (bucket, salt), and an exact integer check follows. Buckets are WIDTH cents wide below 10^6 cents
and ten times as wide for every further digit, so that no interval touches more than some hundred of them. A
bucket of more than HOT line groups is salted: its groups are dealt by a hash of their cent, prices are copied
to each salt. Nothing is broadcast or collected.

The nearest lines: per cent at most 2 k lines are kept, k of any one item at most, which hold the first k lines
of other items whatever item asks. A price takes cents by (gap, cent) until at least k lines are there that no
single item can claim. Lines of the asking item itself are summed per (item, bucket) and subtracted.

Defined cases: lines null in sale_id, item_id, quantity or amount, lines of quantity 0 and amounts or prices that
are not finite or 4e16 and more never pair. Items null in price or item_id pair with nothing and give their one
row of rank 0. Every row of items gives rows of its own, repeated ones too; repeated lines count and are
ranked each. A null line_no sorts first and is empty in the checksum. Empty tables and extra columns are fine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hopweave.llm._common import stored, table

#: Cents of a bucket below 10^6 cents, line groups of a bucket from which it is salted, copies of a price's row.
WIDTH, HOT, COPIES = 100, 2_000, 8


def cents(x: Column) -> Column:
    """floor(100 x + 0.5) in doubles; null where x is null, not finite or too large for 64 bits."""
    return F.when(F.abs(x) < 4e16, F.floor(F.lit(100.0) * x + F.lit(0.5)).cast("long"))


def bucket(u: Column) -> Column:
    """The bucket of a number of cents; rises with it, without gaps."""
    zone = F.when(u >= 1_000_000, F.length(u.cast("string")) - 6).otherwise(0)
    width = F.lit(WIDTH) * F.pow(F.lit(10), zone).cast("long")
    return zone * (900_000 // WIDTH) + F.call_function("div", u - F.pmod(u, width), width)


def near(u: Column, p: Column) -> Column:
    """|u - p| at most 50, or 1000 |u - p| at most 5 min(u, p), without a product that could overflow."""
    gap, least = F.abs(u - p), F.least(u, p)
    return (gap <= 50) | ((least > 0) & (gap <= F.call_function("div", least, F.lit(200).cast("long"))))


def interval(p: Column) -> tuple[Column, Column]:
    """The least and the largest cent near p."""
    part = lambda n: F.call_function("div", F.greatest(p, F.lit(0)), F.lit(n).cast("long"))
    return p - F.greatest(F.lit(50), part(201)), p + F.greatest(F.lit(50), part(200))


def pairing(lines: DataFrame) -> DataFrame:
    """The lines that can pair, with u = floor((2 amount + quantity) / (2 quantity)) in whole cents: u, sale_id, line_no, line_item_id."""
    can = lines.where("sale_id is not null and item_id is not null and quantity <> 0 and abs(cast(amount as double)) < 4e16")
    ids = [F.col("sale_id").cast("long").alias("sale_id"), F.col("line_no").cast("long").alias("line_no"), F.col("item_id").cast("long").alias("line_item_id")]
    q, kept = F.col("quantity").cast("long"), ["sale_id", "line_no", "line_item_id"]
    both = can.select(*ids, (2 * F.floor(F.lit(100.0) * F.col("amount").cast("double") + F.lit(0.5)) + q).alias("n"), (2 * q).alias("d"))
    upright = both.select(*kept, F.when(F.col("d") < 0, -F.col("n")).otherwise(F.col("n")).alias("n"), F.abs("d").alias("d"))
    # Whole division cuts towards zero: below zero it starts from the last of its step.
    return upright.select(*kept, F.call_function("div", F.when(F.col("n") < 0, F.col("n") - F.col("d") + 1).otherwise(F.col("n")), F.col("d")).alias("u"))


def summed(found: DataFrame) -> DataFrame:
    """Lines of one item and cent in one row: line_item_id, u, n, crc (sum of the checksums)."""
    shown = F.concat_ws(",", "sale_id", F.coalesce(F.col("line_no").cast("string"), F.lit("")), "line_item_id")
    return found.groupBy("line_item_id", "u").agg(F.count("*").alias("n"), F.sum(F.crc32(shown.cast("binary"))).alias("crc"))


def first_lines(found: DataFrame, k: int) -> DataFrame:
    """Per cent u: its lines in order, at most k of an item and 2 k in all, and how many of them no single item can claim."""
    order = ["sale_id", "line_no", "line_item_id"]
    few = found.withColumn("r", F.row_number().over(W.partitionBy("u", "line_item_id").orderBy(*order))).where(F.col("r") <= k)
    few = few.withColumn("r", F.row_number().over(W.partitionBy("u").orderBy(*order))).where(F.col("r") <= 2 * k)
    lists = few.groupBy("u").agg(F.sort_array(F.collect_list(F.struct("r", *order))).alias("lines"))
    same = F.transform("lines", lambda x: F.size(F.filter("lines", lambda y: y["line_item_id"] == x["line_item_id"])))
    return lists.select("u", F.transform("lines", lambda x: F.struct(*[x[c].alias(c) for c in order])).alias("lines"), (F.size("lines") - F.array_max(same)).alias("free"))


def touched(prices: DataFrame) -> DataFrame:
    """One row for every bucket that the interval of p touches."""
    low, high = interval(F.col("p"))
    return prices.withColumn("b", F.explode(F.sequence(bucket(low), bucket(high))))


def salted_join(groups: DataFrame, prices: DataFrame, hot: int = HOT) -> DataFrame:
    """Line groups (u, b, ...) and prices (p, b) of the same bucket that are near; hot buckets are dealt by salts."""
    salts = groups.groupBy("b").agg(F.ceil(F.count("*") / hot).cast("int").alias("salts"))
    left = groups.join(salts, "b").withColumn("s", F.pmod(F.xxhash64("u"), F.col("salts")).cast("int")).drop("salts")
    right = prices.join(salts, "b").withColumn("s", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    return left.join(right, ["b", "s"]).where(near(F.col("u"), F.col("p"))).drop("b", "s")


def band_join(lines: DataFrame, items: DataFrame, k: int = 10, hot: int = HOT) -> DataFrame:
    """Per row of items: item_id, p, nearest (array of its first k pairs), n_pairs, gap_sum, lines_crc."""
    found = pairing(lines)
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.when(F.col("item_id").isNotNull(), cents(F.col("price").cast("double"))).alias("p"))
    prices = touched(asked.where("p is not null").select("p").distinct())
    gap = F.abs(F.col("u") - F.col("p"))

    # All lines near a price, and the cents that hold its first lines.
    by_item = stored(summed(found), "by_item")
    sums = by_item.groupBy("u").agg(F.sum("n").alias("n"), F.sum("crc").alias("crc"))
    firsts = stored(first_lines(found, k), "firsts")
    groups = sums.join(firsts.select("u", "free"), "u").withColumn("b", bucket(F.col("u")))
    before = F.coalesce(F.sum("free").over(W.partitionBy("p").orderBy("gap", "u").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    pairs = salted_join(groups, prices, hot).withColumn("gap", gap).withColumn("before", before)
    summed_up = pairs.groupBy("p").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("gap")).alias("g"), F.sum("crc").alias("crc"),
        F.collect_list(F.when(F.col("before") < k, F.struct("gap", "u"))).alias("cents"),
    )
    near_price = stored(summed_up, "near_price")

    # The first lines of a price: at most k of an item and 2 k in all, as for a cent.
    order = ["gap", "u", "sale_id", "line_no", "line_item_id"]
    open_lines = near_price.select("p", F.explode("cents").alias("c")).select("p", "c.gap", "c.u").join(firsts.select("u", "lines"), "u")
    open_lines = open_lines.select("p", "gap", "u", F.explode("lines").alias("l")).select("p", "gap", "u", "l.*")
    few = open_lines.withColumn("r", F.row_number().over(W.partitionBy("p", "line_item_id").orderBy(*order))).where(F.col("r") <= k)
    few = few.withColumn("r", F.row_number().over(W.partitionBy("p").orderBy(*order))).where(F.col("r") <= 2 * k)
    lists = few.groupBy("p").agg(F.sort_array(F.collect_list(F.struct("r", *order))).alias("lines"))
    # Many items may have one price: its row is copied, and items are dealt to the copies.
    by_price = near_price.drop("cents").join(lists, "p").withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))

    # An item's own lines near its price, by (item, bucket), so that no item is one task's.
    own = by_item.select(F.col("line_item_id").alias("item_id"), "u", "n", "crc", bucket(F.col("u")).alias("b"))
    own = own.join(touched(asked.where("p is not null").distinct()), ["item_id", "b"]).where(near(F.col("u"), F.col("p")))
    own = own.groupBy("item_id", "p").agg(F.sum("n").alias("own_n"), F.sum(F.col("n") * gap).alias("own_g"), F.sum("crc").alias("own_crc"))

    # A null price is dealt by its id instead: null keys would all go to one task.
    dealt = asked.withColumn("s", F.pmod(F.xxhash64("item_id"), F.lit(COPIES)).cast("int"))
    joined = dealt.where("p is not null").join(by_price, ["p", "s"], "left").join(own, ["item_id", "p"], "left")
    others = F.filter("lines", lambda x: x["line_item_id"] != F.col("item_id"))
    nearest = F.transform(F.slice(others, 1, k), lambda x: F.struct(*[x[c].alias(c) for c in order]))
    less = lambda a, b: (F.coalesce(F.col(a), F.lit(0)) - F.coalesce(F.col(b), F.lit(0))).cast("long")
    full = joined.select("item_id", "p", nearest.alias("nearest"), less("n", "own_n").alias("n_pairs"), less("g", "own_g").alias("gap_sum"), less("crc", "own_crc").alias("lines_crc"))
    none = [F.lit(0).cast("long").alias(c) for c in ("n_pairs", "gap_sum", "lines_crc")]
    return full.unionByName(asked.where("p is null").select("item_id", "p", F.lit(None).cast(full.schema["nearest"].dataType).alias("nearest"), *none))


def op13_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, rank, gap, u, sale_id, line_no, line_item_id, n_pairs, gap_sum, lines_crc."""
    found = band_join(table(spark, sf_dir, "sale_lines"), table(spark, sf_dir, "items"))
    rows = found.select("item_id", "n_pairs", "gap_sum", "lines_crc", F.posexplode_outer("nearest").alias("i", "l"))
    return rows.select("item_id", F.coalesce(F.col("i") + 1, F.lit(0)).cast("int").alias("rank"), "l.*", "n_pairs", "gap_sum", "lines_crc")


#: The same rows in SQL; crc32 has no function there, so its table of 256 is built from its polynomial.
OP13_SQL = """
WITH crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), cents AS (
  SELECT sale_id, line_no, item_id, quantity::BIGINT AS q, CAST(floor(100 * amount + 0.5) AS BIGINT) AS a
  FROM sale_lines WHERE sale_id IS NOT NULL AND item_id IS NOT NULL AND quantity > 0 AND amount IS NOT NULL
), lines AS (
  SELECT sale_id, line_no::BIGINT AS line_no, item_id AS line_item_id, (2 * a + q) // (2 * q) AS u, concat(sale_id, ',', line_no, ',', item_id) AS s FROM cents
), summed AS (
  SELECT lines.* EXCLUDE s, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(s) + 1), lambda j: ascii(s[j])::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM lines, crc_table
), prices AS (
  SELECT row_number() OVER () AS row_id, item_id, CAST(floor(100 * price + 0.5) AS BIGINT) AS p FROM items
), pairs AS (
  SELECT row_id, i.item_id, abs(u - p) AS gap, u, sale_id, line_no, line_item_id, crc
  FROM prices i JOIN summed l ON l.u BETWEEN i.p - greatest(50, i.p // 200) AND i.p + greatest(50, i.p // 200)
  WHERE l.line_item_id <> i.item_id AND (abs(u - p) <= 50 OR 1000 * abs(u - p) <= 5 * least(u, p))
), totals AS (
  SELECT row_id, count(*) AS n_pairs, sum(gap)::BIGINT AS gap_sum, sum(crc)::BIGINT AS lines_crc FROM pairs GROUP BY row_id
), firsts AS (
  SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY gap, u, sale_id, line_no NULLS FIRST, line_item_id) AS r FROM pairs QUALIFY r <= 10
)
SELECT i.item_id, coalesce(f.r, 0)::INT AS rank, f.gap, f.u, f.sale_id, f.line_no, f.line_item_id,
  coalesce(t.n_pairs, 0) AS n_pairs, coalesce(t.gap_sum, 0) AS gap_sum, coalesce(t.lines_crc, 0) AS lines_crc
FROM prices i LEFT JOIN totals t USING (row_id) LEFT JOIN firsts f USING (row_id)
"""
