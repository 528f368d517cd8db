"""Splits and samples over the orders: status is the stage, customer the unit, priority the label."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import splits as S
from ...registry import query, table

STAGE_SQL = "CASE o_orderstatus WHEN 'F' THEN 'PREFLOP' WHEN 'O' THEN 'POSTFLOP' ELSE 'UNKNOWN' END"


def staged_orders(spark, sf):
    stage = F.when(F.col("o_orderstatus") == "F", "PREFLOP").when(F.col("o_orderstatus") == "O", "POSTFLOP").otherwise("UNKNOWN")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.col("o_orderpriority").alias("label"),
        stage.alias("stage_group"),
        F.concat(F.lit("orders:hand:"), F.col("o_custkey").cast("string")).alias("split_unit"),
    )


STAGE_SPLIT_CTE = f"""
WITH staged AS (
  SELECT o_orderkey, o_orderpriority AS label, {STAGE_SQL} AS stage_group,
         'orders:hand:' || o_custkey AS split_unit FROM orders),
ranked AS (
  SELECT stage_group, split_unit,
         row_number() OVER (PARTITION BY stage_group ORDER BY sha256('17:' || split_unit), split_unit) AS r,
         count(*) OVER (PARTITION BY stage_group) AS n
  FROM (SELECT DISTINCT stage_group, split_unit FROM staged WHERE stage_group <> 'UNKNOWN')),
sized AS (
  SELECT *, greatest(1, CAST(round_even(n * 0.2, 0) AS BIGINT)) AS test_n,
         greatest(1, CAST(round_even(n * 0.1, 0) AS BIGINT)) AS val_n FROM ranked),
chosen AS (
  SELECT split_unit, stage_group,
         CASE WHEN n < 3 OR r <= greatest(1, n - test_n - val_n) THEN 'train'
              WHEN r <= greatest(1, n - test_n - val_n) + val_n THEN 'validation' ELSE 'test' END AS split
  FROM sized),
answer AS (
  SELECT split_unit, coalesce(max(CASE WHEN stage_group = 'POSTFLOP' THEN split END),
                              max(CASE WHEN stage_group = 'PREFLOP' THEN split END)) AS split
  FROM chosen GROUP BY split_unit)
"""


@query("stage_hash_split", "W4 J4 P31 P32 F21 O7", STAGE_SPLIT_CTE + """
SELECT o_orderkey, stage_group, split_unit, coalesce(split, '') AS split
FROM staged LEFT JOIN answer USING (split_unit)
""")
def stage_hash_split(spark, sf):
    return S.stage_split(staged_orders(spark, sf)).select("o_orderkey", "stage_group", "split_unit", "split")


@query("stage_split_label_counts", "W4 A2 A29 K4", STAGE_SPLIT_CTE + """
SELECT stage_group, coalesce(split, '') AS split, label, count(*) AS n
FROM staged LEFT JOIN answer USING (split_unit) GROUP BY 1, 2, 3
""")
def stage_split_label_counts(spark, sf):
    return S.stage_split(staged_orders(spark, sf)).groupBy("stage_group", "split", "label").agg(F.count(F.lit(1)).alias("n"))


def labelled_orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("label"))


def _remainder_sql(src, n, total, out):
    return f"""
  SELECT * EXCLUDE (ideal, fl), fl + CASE WHEN row_number() OVER (ORDER BY ideal - fl DESC, label)
         <= {total} - CAST(sum(fl) OVER () AS BIGINT) THEN 1 ELSE 0 END AS {out}
  FROM (SELECT *, CAST(floor(ideal) AS BIGINT) AS fl FROM (
          SELECT *, CAST({n} AS DOUBLE) / CAST(sum({n}) OVER () AS DOUBLE) * CAST({total} AS DOUBLE) AS ideal FROM {src}))"""


@query("stratified_three_way_split", "M1 A29", f"""
WITH c0 AS (SELECT o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1),
c1 AS (SELECT *, CAST(sum(n) OVER () AS BIGINT) AS total,
       CAST(sum(n) OVER () AS BIGINT) - CAST(ceil(sum(n) OVER () * 0.2::DOUBLE) AS BIGINT) AS keep_total FROM c0),
c2 AS ({_remainder_sql('c1', 'n', 'keep_total', 'kept')}),
c3 AS (SELECT *, keep_total - CAST(ceil(keep_total * (0.1::DOUBLE / (1.0::DOUBLE - 0.2::DOUBLE))) AS BIGINT) AS train_total FROM c2),
c4 AS ({_remainder_sql('c3', 'kept', 'train_total', 'train_n')}),
r AS (SELECT o_orderkey, o_orderpriority AS label,
      row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('17:' || o_orderkey), o_orderkey) AS r FROM orders)
SELECT o_orderkey, label, CASE WHEN r <= train_n THEN 'train' WHEN r <= kept THEN 'validation' ELSE 'test' END AS split
FROM r JOIN c4 USING (label)
""")
def stratified_three_way_split(spark, sf):
    return S.stratified_three_way(labelled_orders(spark, sf), "label", "o_orderkey").select("o_orderkey", "label", "split")


@query("stratified_two_way_split", "M2", f"""
WITH c0 AS (SELECT o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1),
c1 AS (SELECT *, CAST(sum(n) OVER () AS BIGINT) - CAST(ceil(sum(n) OVER () * 0.25::DOUBLE) AS BIGINT) AS keep_total FROM c0),
c2 AS ({_remainder_sql('c1', 'n', 'keep_total', 'train_n')}),
r AS (SELECT o_orderkey, o_orderpriority AS label,
      row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('17:' || o_orderkey), o_orderkey) AS r FROM orders)
SELECT o_orderkey, label, CASE WHEN r <= train_n THEN 'train' ELSE 'test' END AS split, CAST(NULL AS VARCHAR) AS split_warning
FROM r JOIN c2 USING (label)
""")
def stratified_two_way_split(spark, sf):
    return S.stratified_two_way(labelled_orders(spark, sf), "label", "o_orderkey").select(
        "o_orderkey", "label", "split", "split_warning"
    )


@query("random_split_fallback", "M2", """
WITH src AS (SELECT p_partkey, CASE WHEN p_partkey = (SELECT max(p_partkey) FROM part) THEN 'lonely' ELSE p_type END AS label FROM part),
c AS (SELECT count(*) AS n FROM src),
r AS (SELECT p_partkey, label, row_number() OVER (ORDER BY sha256('17:' || p_partkey), p_partkey) AS r FROM src)
SELECT p_partkey, label,
       CASE WHEN r <= n - CAST(ceil(n * 0.25::DOUBLE) AS BIGINT) THEN 'train' ELSE 'test' END AS split,
       'stratified_split_unavailable_used_random_split' AS split_warning
FROM r CROSS JOIN c
""")
def random_split_fallback(spark, sf):
    part = table(spark, sf, "part")
    top = part.agg(F.max("p_partkey").alias("p_partkey")).withColumn("lonely", F.lit(True))
    rows = part.join(top, "p_partkey", "left").select(
        "p_partkey", F.when(F.col("lonely"), F.lit("lonely")).otherwise(F.col("p_type")).alias("label")
    )
    return S.stratified_two_way(rows, "label", "p_partkey").select("p_partkey", "label", "split", "split_warning")


@query("grouped_label_split", "M3", """
WITH src AS (SELECT o_orderkey, o_orderpriority AS label, o_custkey AS grp FROM orders),
g AS (SELECT label, grp, row_number() OVER (PARTITION BY label ORDER BY sha256('17:' || label || ':' || grp), grp) AS r,
             count(*) OVER (PARTITION BY label) AS n FROM (SELECT DISTINCT label, grp FROM src))
SELECT o_orderkey, label, grp,
       CASE WHEN n > 1 AND r <= greatest(1, CAST(round_even(n * 0.25, 0) AS BIGINT)) THEN 'test' ELSE 'train' END AS split
FROM src JOIN g USING (label, grp)
""")
def grouped_label_split(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("label"), F.col("o_custkey").alias("grp"))
    return S.grouped_split(rows, "label", "grp").select("o_orderkey", "label", "grp", "split")


@query("fixed_size_sample", "M4", """
SELECT l_orderkey, l_linenumber, l_partkey FROM (
  SELECT *, row_number() OVER (ORDER BY sha256('17:' || k), k) AS r FROM (
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_extendedprice || '-' || l_shipdate AS k
    FROM lineitem)) WHERE r <= 2000
""")
def fixed_size_sample(spark, sf):
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", key.alias("k"))
    return S.fixed_sample(rows, "k", 2000).select("l_orderkey", "l_linenumber", "l_partkey")


@query("stratified_fraction_sample", "M4 M10", """
WITH r AS (SELECT o_orderkey, o_orderpriority AS label,
           row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('17:' || o_orderkey), o_orderkey) AS r,
           count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT o_orderkey, label FROM r WHERE r <= greatest(1, CAST(round_even(n * 0.15, 0) AS BIGINT))
""")
def stratified_fraction_sample(spark, sf):
    return S.stratified_fraction(labelled_orders(spark, sf), "label", "o_orderkey", 0.15).select("o_orderkey", "label")


@query("balanced_resample_jitter", "M5 U2", """
WITH src AS (SELECT c_custkey, c_mktsegment AS label, c_acctbal AS amount FROM customer),
lab AS (SELECT label, count(*) AS n, row_number() OVER (ORDER BY label) - 1 AS i FROM src GROUP BY label),
tot AS (SELECT 2 * count(*) AS wanted FROM src),
tgt AS (SELECT label, n, wanted // 5 + CASE WHEN i < wanted % 5 THEN 1 ELSE 0 END AS target FROM lab CROSS JOIN tot),
num AS (SELECT c_custkey, label, amount, row_number() OVER (PARTITION BY label ORDER BY sha256('17:' || label || ':' || c_custkey), c_custkey) AS r FROM src),
draw AS (SELECT label, n, slot, sha256('17:' || label || ':' || slot) AS d FROM (
          SELECT label, n, unnest(generate_series(n, target - 1)) AS slot FROM tgt WHERE target > n)),
pickd AS (SELECT label, slot, CAST('0x' || substr(d, 1, 13) AS BIGINT) % n + 1 AS r,
          greatest(0.92, least(1.08, 1.0 + 0.025 * sqrt(-2.0 * ln(greatest(CAST('0x' || substr(d, 1, 13) AS BIGINT) / 4503599627370496.0, 2.220446049250313e-16)))
             * cos(6.283185307179586 * (CAST('0x' || substr(d, 14, 13) AS BIGINT) / 4503599627370496.0)))) AS f FROM draw)
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, label, amount, 'real_imported' AS generation_method
FROM num JOIN tgt USING (label) WHERE r <= target
UNION ALL
SELECT c_custkey || ':aug:' || slot, label, round(greatest(0.0, amount * f), 6), 'resampled_jitter'
FROM pickd JOIN num USING (label, r)
""")
def balanced_resample_jitter(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("label"), F.col("c_acctbal").alias("amount"))
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    out = S.balanced_resample(rows, "label", segments, "c_custkey", 2.0, ["amount"])
    return out.select("c_custkey", "label", "amount", "generation_method")


@query("resample_jitter_ratios", "M5 U2", """
WITH src AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'RAISE' WHEN o_orderkey % 5 < 2 THEN 'CALL' ELSE 'FOLD' END AS label, o_totalprice AS pot,
  CASE WHEN o_custkey % 6 > 0 THEN (o_custkey % 6 * 1000)::DOUBLE END AS price, CASE WHEN o_custkey % 7 > 0 THEN o_custkey % 7 / 8.0 END AS equity FROM orders),
lab AS (SELECT label, count(*) AS n, row_number() OVER (ORDER BY label) - 1 AS i FROM src GROUP BY label),
tot AS (SELECT 2 * count(*) AS wanted FROM src),
tgt AS (SELECT label, n, wanted // 3 + CASE WHEN i < wanted % 3 THEN 1 ELSE 0 END AS target FROM lab CROSS JOIN tot),
num AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha256('17:' || label || ':' || o_orderkey), o_orderkey) AS r FROM src),
draw AS (SELECT label, n, slot, sha256('17:' || label || ':' || slot) AS d FROM (SELECT label, n, unnest(generate_series(n, target - 1)) AS slot FROM tgt WHERE target > n)),
pickd AS (SELECT label, slot, CAST('0x' || substr(d, 1, 13) AS BIGINT) % n + 1 AS r,
  greatest(0.92, least(1.08, 1.0 + 0.025 * sqrt(-2.0 * ln(greatest(CAST('0x' || substr(d, 1, 13) AS BIGINT) / 4503599627370496.0, 2.220446049250313e-16)))
    * cos(6.283185307179586 * (CAST('0x' || substr(d, 14, 13) AS BIGINT) / 4503599627370496.0)))) AS f FROM draw),
shaken AS (SELECT o_orderkey || ':aug:' || slot AS id, label, round(pot * f, 6) AS pot, round(price * f, 6) AS price, equity FROM pickd JOIN num USING (label, r)),
priced AS (SELECT *, CASE WHEN price IS NOT NULL THEN round(price / pot, 6) ELSE -1.0 END AS pot_share, round(coalesce(price, 0.0) / (pot + coalesce(price, 0.0)), 6) AS required FROM shaken)
SELECT CAST(o_orderkey AS VARCHAR) AS id, label, round(pot, 2) AS pot, -1.0::DOUBLE AS pot_share, -1.0::DOUBLE AS required, -1.0::DOUBLE AS gap FROM num JOIN tgt USING (label) WHERE r <= target
UNION ALL SELECT id, label, round(pot, 2), pot_share, required, round(coalesce(equity, 0.0) - required, 6) FROM priced
""")
def resample_jitter_ratios(spark, sf):
    """Drawn rows get their ratios from the shaken amounts; originals keep what they had (here -1). Amounts are
    compared to two digits: logarithm and cosine of the two engines differ in their last bit."""
    k, c, old = F.col("o_orderkey"), F.col("o_custkey"), F.lit(-1.0)
    label = F.when(F.col("o_orderstatus") == "P", "RAISE").when(k % 5 < 2, "CALL").otherwise("FOLD")
    price, equity = F.when(c % 6 > 0, (c % 6 * 1000).cast("double")), F.when(c % 7 > 0, c % 7 / 8.0)
    rows = table(spark, sf, "orders").select(
        k.alias("id"), label.alias("label"), F.col("o_totalprice").alias("pot"), price.alias("price"), equity.alias("equity"), old.alias("pot_share"), old.alias("required"), old.alias("gap")
    )
    ratios = S.price_ratios("pot", "price", "equity", "pot_share", "required", "gap")
    out = S.balanced_resample(rows, "label", ["CALL", "FOLD", "RAISE"], "id", 2.0, ["pot", "price"], derived=ratios)
    return out.select("id", "label", F.round("pot", 2).alias("pot"), "pot_share", "required", "gap")
