"""The solved-spot table, set operations, keyed joins, histograms and buckets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import cards as C
from ...operators import clustering as B
from ...operators import equity as E
from ...operators import library as L
from ...operators import normalize as N
from ...operators.ranges import compatible
from ...registry import query, table
from ...session import stored
from ...functions.keys import content_id, short_id
from .cards import deals
from .sqlcards import DECK_CTE, PAIRS_CTE, deal_cte


def spots(spark, sf):
    """Orders as solved spots: status is the street, total the value, date the creation."""
    street = F.when(F.col("o_orderstatus") == "F", "flop").when(F.col("o_orderstatus") == "O", "turn").otherwise("river")
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        k.alias("spot_id"), F.col("o_custkey"), street.alias("street"), F.col("o_orderpriority").alias("label"), F.concat(F.lit("v"), (k % 3).cast("string")).alias("solver_version"),
        (F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) * 100000 + k).alias("created_at"), (k % 200).cast("int").alias("stack_bb"), F.concat(F.lit("As"), F.substring("o_orderpriority", 3, 3)).alias("board_signature"),
        F.col("o_totalprice").alias("game_value"),
    )


SPOT_CTE = """
WITH sp AS (SELECT o_orderkey AS spot_id, o_custkey, CASE o_orderstatus WHEN 'F' THEN 'flop' WHEN 'O' THEN 'turn' ELSE 'river' END AS street, o_orderpriority AS label, 'v' || (o_orderkey % 3) AS solver_version,
  CAST(epoch(o_orderdate) AS BIGINT) * 100000 + o_orderkey AS created_at, CAST(o_orderkey % 200 AS INT) AS stack_bb, 'As' || substr(o_orderpriority, 3, 3) AS board_signature, o_totalprice AS game_value FROM orders)
"""


@query("library_listing", "O1 X5 O7", SPOT_CTE + "SELECT spot_id, street, stack_bb, created_at FROM sp WHERE street = 'turn' AND stack_bb >= 20 AND stack_bb <= 150 AND regexp_matches(label, '^[1-3]-') AND regexp_matches(board_signature, 'URG|HIG|MED') ORDER BY created_at DESC, spot_id LIMIT 500 OFFSET 20")
def library_listing(spark, sf):
    out = L.listing(spots(spark, sf), limit=500, offset=20, street="turn", stack_min=20, stack_max=150, label_pattern="^[1-3]-", board_pattern="URG|HIG|MED")
    return out.select("spot_id", "street", "stack_bb", "created_at")


@query("library_statistics", "A21", SPOT_CTE + """
SELECT CASE grouping_id(street, solver_version) WHEN 3 THEN 'all' WHEN 1 THEN 'street' ELSE 'version' END AS level, coalesce(street, solver_version, '') AS key, count(*) AS n, CAST(sum(length(label) + length(board_signature)) AS BIGINT) AS bytes,
  min(created_at) AS oldest, max(created_at) AS newest FROM sp GROUP BY GROUPING SETS ((), (street), (solver_version))
""")
def library_statistics(spark, sf):
    return L.statistics(spots(spark, sf), F.length("label") + F.length("board_signature"))


@query("library_upsert", "K9 T3", SPOT_CTE + """
, old AS (SELECT * FROM sp WHERE stack_bb < 120), new AS (SELECT * REPLACE (game_value + 1 AS game_value, created_at + 5 AS created_at) FROM sp WHERE stack_bb >= 80)
SELECT spot_id, game_value, created_at FROM new UNION ALL SELECT spot_id, game_value, created_at FROM old WHERE spot_id NOT IN (SELECT spot_id FROM new)
""")
def library_upsert(spark, sf):
    old = spots(spark, sf).filter("stack_bb < 120")
    new = spots(spark, sf).filter("stack_bb >= 80").withColumns({"game_value": F.col("game_value") + 1, "created_at": F.col("created_at") + 5})
    return L.upsert(old, new).select("spot_id", "game_value", "created_at")


@query("library_insert_only", "K9", SPOT_CTE + """
, old AS (SELECT * FROM sp WHERE stack_bb < 120), new AS (SELECT * FROM sp WHERE stack_bb >= 80)
SELECT 'table' AS part, count(*) AS rows, round(sum(game_value), 2) AS total FROM (SELECT * FROM old UNION ALL SELECT * FROM new WHERE spot_id NOT IN (SELECT spot_id FROM old))
UNION ALL SELECT 'rejected', count(*), round(sum(game_value), 2) FROM new WHERE spot_id IN (SELECT spot_id FROM old)
""")
def library_insert_only(spark, sf):
    kept, rejected = L.insert_only(spots(spark, sf).filter("stack_bb < 120"), spots(spark, sf).filter("stack_bb >= 80"))
    parts = [df.agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("game_value"), 2).alias("total")).select(F.lit(name).alias("part"), "rows", "total") for name, df in (("table", kept), ("rejected", rejected))]
    return parts[0].unionByName(parts[1])


@query("library_delete", "K10", SPOT_CTE + ", gone AS (SELECT o_custkey * 7 AS spot_id FROM sp GROUP BY 1) SELECT 'kept' AS part, count(*) AS n FROM sp WHERE spot_id NOT IN (SELECT spot_id FROM gone) UNION ALL SELECT 'absent', count(*) FROM gone WHERE spot_id NOT IN (SELECT spot_id FROM sp)")
def library_delete(spark, sf):
    rows = spots(spark, sf)
    kept, absent = L.delete(rows, rows.select((F.col("o_custkey") * 7).alias("spot_id")))
    return kept.agg(F.count(F.lit(1)).alias("n")).select(F.lit("kept").alias("part"), "n").unionByName(absent.agg(F.count(F.lit(1)).alias("n")).select(F.lit("absent").alias("part"), "n"))


@query("library_pending_requests", "J5 S12", SPOT_CTE + """
, req AS (SELECT c_custkey AS spot_id, c_acctbal < 0 AS bad FROM customer), done AS (SELECT DISTINCT spot_id FROM sp)
SELECT CASE WHEN bad THEN 'error' WHEN spot_id IN (SELECT spot_id FROM done) THEN 'skip' ELSE 'dry_run' END AS outcome, count(*) AS n FROM req GROUP BY 1
""")
def library_pending_requests(spark, sf):
    errors = F.when(F.col("c_acctbal") < 0, F.array(F.lit("negative"))).otherwise(F.array().cast("array<string>"))
    requests = table(spark, sf, "customer").select(F.col("c_custkey").alias("spot_id"), errors.alias("errors"))
    return L.outcome_counts(requests, spots(spark, sf), dry_run=True)


@query("pending_and_skipped_keys", "J5", SPOT_CTE + ", done AS (SELECT spot_id FROM sp) SELECT c_custkey AS spot_id, CASE WHEN c_custkey IN (SELECT spot_id FROM done) THEN 'skipped' ELSE 'pending' END AS state FROM customer")
def pending_and_skipped_keys(spark, sf):
    requests = table(spark, sf, "customer").select(F.col("c_custkey").alias("spot_id"))
    todo, skipped = L.pending(requests, spots(spark, sf))
    return todo.withColumn("state", F.lit("pending")).unionByName(skipped.withColumn("state", F.lit("skipped")))


def described_spots(spark, sf):
    d = deals(spark, sf, "customer", "c_custkey", 3)
    k = F.col("c_custkey")
    return d.select("c_custkey", F.col("board"), F.when(k % 2 == 0, F.array(F.lit(1.0), F.lit(0.33))).otherwise(F.array(F.lit(0.33), F.lit(1.0))).alias("bet_sizes"), (k % 7 * 100).alias("pot"), F.concat(F.lit("spot "), k.cast("string")).alias("label"))


SPOT_ID_CTE = f"""
WITH {DECK_CTE}, {deal_cte('customer', 'c_custkey')}, fl AS (SELECT c_custkey, unnest(d[5:7]) AS c FROM dealt), sb AS (SELECT c_custkey, list(c ORDER BY rk, su) AS b FROM fl JOIN deckc USING (c) GROUP BY 1),
sid AS (SELECT c_custkey, array_to_string(b, '') AS board_signature, sha256('{{"bet_sizes":[0.33,1.0],"board":["' || array_to_string(b, '","') || '"],"pot":' || (c_custkey % 7 * 100) || '}}') AS spot_id FROM sb)
"""


@query("spot_identity", "F21 F22", SPOT_ID_CTE + "SELECT c_custkey, board_signature, spot_id, substr(sha256('{\"bet_size_fractions\":[0.33,1.0]}'), 1, 16) AS menu FROM sid")
def spot_identity(spark, sf):
    out = L.spot_identity(described_spots(spark, sf), ["pot"])
    return out.select("c_custkey", "board_signature", "spot_id", F.col("bet_menu_hash").alias("menu"))


@query("portable_record_round_trip", "K11 F23 F17", SPOT_ID_CTE + "SELECT c_custkey % 10 = 0 AS mismatch, count(*) AS records, count(DISTINCT spot_id) AS ids FROM sid GROUP BY 1")
def portable_record_round_trip(spark, sf):
    known = L.spot_identity(described_spots(spark, sf), ["pot"])
    strategy = F.create_map(F.lit("root"), F.array(F.lit(0.25), F.lit(0.75)))
    claimed = known.withColumn("average_strategy", strategy).withColumn("spot_id", F.when(F.col("c_custkey") % 10 == 0, F.lit("stale")).otherwise(F.col("spot_id")))
    # Stored, or the test of what comes back moves below the dealing step's exchange and deals every deck there, in one task.
    records = stored(L.portable(claimed, ["board", "bet_sizes", "pot"], ["average_strategy"], ["label", "board_signature"]), "records")
    back = L.import_portable(records, "board array<string>, bet_sizes array<double>, pot bigint", "average_strategy map<string,array<double>>", ["pot"])
    whole = back.filter(F.get(F.col("average_strategy")["root"], F.lit(1)) == 0.75)
    return whole.groupBy("mismatch").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("spot_id").alias("ids"))


@query("strategy_blob_round_trip", "F23 K11", """
SELECT l_orderkey, count(*) AS lines, round(sum(l_discount), 6) AS discount, round(sum(l_tax), 6) AS tax, TRUE AS gzip_marks FROM lineitem GROUP BY 1
""")
def strategy_blob_round_trip(spark, sf):
    """Strategies packed and unpacked; the numbers that come back are summed."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", F.create_map(F.lit("root"), F.array("l_discount", "l_tax")).alias("strategy"))
    packed = rows.select("l_orderkey", L.strategy_blob(F.col("strategy")).alias("blob"))
    back = packed.select("l_orderkey", "blob", L.strategy_of(F.col("blob"))["root"].alias("p"))
    share = lambda i: F.round(F.sum(F.get("p", F.lit(i))), 6)
    marks = F.bool_and(F.hex(F.substring("blob", 1, 2)) == "1F8B")
    return back.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"), share(0).alias("discount"), share(1).alias("tax"), marks.alias("gzip_marks"))


@query("content_ids", "F21", "SELECT o_orderkey, sha256('{\"o_orderkey\":' || o_orderkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}') AS id, substr(sha256('{\"o_orderkey\":' || o_orderkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}'), 1, 16) AS short FROM orders")
def content_ids(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", content_id("o_orderkey", "o_orderstatus").alias("id"))
    return rows.withColumn("short", short_id(F.col("id")))


@query("strategy_coverage", "J9 U4", """
WITH a AS (SELECT l_partkey, l_suppkey, avg(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2), b AS (SELECT l_partkey, l_suppkey, avg(l_quantity) AS v FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2)
SELECT count(a.v) AS left_keys, count(b.v) AS right_keys, count(*) FILTER (a.v IS NOT NULL AND b.v IS NOT NULL) AS overlap, max(abs(a.v - b.v)) AS max_delta, round(avg(a.v - b.v), 6) AS mean_delta,
  round(count(*) FILTER (a.v IS NOT NULL AND b.v IS NOT NULL) / count(a.v)::DOUBLE, 8) AS coverage FROM a FULL JOIN b USING (l_partkey, l_suppkey)
""")
def strategy_coverage(spark, sf):
    items = table(spark, sf, "lineitem")
    kept = F.col("l_returnflag") == "N"
    sides = [items.filter(side).groupBy("l_partkey", "l_suppkey").agg(F.avg("l_quantity").alias("v")) for side in (kept, ~kept)]
    out = L.coverage(sides[0], sides[1], ["l_partkey", "l_suppkey"], "v")
    return out.withColumns({"mean_delta": F.round("mean_delta", 6), "coverage": F.round("coverage", 8)})


@query("glued_exports", "J2 S13 U1", "SELECT o_orderkey AS source_row_id, o_orderstatus AS street, o_totalprice / 100 AS pot_bb, o_orderpriority AS raw_action FROM orders")
def glued_exports(spark, sf):
    o = table(spark, sf, "orders")
    features = o.select(F.col("o_orderkey").alias("source_row_id"), F.col("o_orderstatus").alias("street"), (F.col("o_totalprice") / 100).alias("pot_bb"))
    model_input = o.select(F.col("o_orderkey").alias("source_row_id"), F.lit("other").alias("street"), F.col("o_orderpriority").alias("raw_action"))
    return L.glue(model_input, features).select("source_row_id", "street", "pot_bb", "raw_action")


@query("merged_sources_union", "U1 U2 J4 P32 S13", """
SELECT 'customer' AS source_dataset, CASE WHEN c_custkey % 4 = 0 THEN 'customer:row:' || c_custkey ELSE 'customer:hand:' || c_nationkey END AS split_unit, c_mktsegment AS segment, c_acctbal AS amount FROM customer
UNION ALL SELECT 'supplier', CASE WHEN s_suppkey % 4 = 0 THEN 'supplier:row:' || s_suppkey ELSE 'supplier:hand:' || s_nationkey END, NULL, s_acctbal FROM supplier
""")
def merged_sources_union(spark, sf):
    c = table(spark, sf, "customer").select(F.lit("customer").alias("source_dataset"), F.col("c_custkey").alias("row_id"), F.when(F.col("c_custkey") % 4 == 0, F.lit(" ")).otherwise(F.col("c_nationkey").cast("string")).alias("hand_id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("amount"))
    s = table(spark, sf, "supplier").select(F.lit("supplier").alias("source_dataset"), F.col("s_suppkey").alias("row_id"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_nationkey").cast("string")).alias("hand_id"), F.col("s_acctbal").alias("amount"))
    both = c.unionByName(s, allowMissingColumns=True)
    return both.select("source_dataset", N.split_unit(F.col("source_dataset"), F.col("hand_id"), F.col("row_id")).alias("split_unit"), "segment", "amount")


@query("source_snapshot_keys", "P32 M3 A30", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'job' || o_custkey WHEN o_orderkey % 3 = 1 THEN 'seen' || o_custkey ELSE 'snap' || o_custkey END AS source FROM orders
""")
def source_snapshot_keys(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    key = N.source_snapshot(
        F.when(k % 3 == 0, "solver_generated").otherwise("resampled_jitter"), F.when(k % 3 == 0, F.concat(F.lit("job"), c)), F.when(k % 3 == 1, F.concat(F.lit("seen"), c)), F.concat(F.lit("snap"), c, F.lit(":aug:"), k.cast("string"))
    )
    return table(spark, sf, "orders").select("o_orderkey", key.alias("source"))


@query("first_seen_values", "W8", "SELECT conv_id, string_agg(role, ',' ORDER BY f) AS roles FROM (SELECT conv_id, role, min(turn) AS f FROM conversations GROUP BY 1, 2) GROUP BY 1")
def first_seen_values(spark, sf):
    first = table(spark, sf, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("f"))
    ordered = first.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("f", "role"))).alias("r"))
    return ordered.select("conv_id", F.array_join(F.array_distinct(F.col("r.role")), ",").alias("roles"))


@query("excluded_combo_choices", "J8 U3", f"""
WITH {DECK_CTE}, {PAIRS_CTE}, {deal_cte('customer', 'c_custkey')}, aces AS (SELECT a.m | b.m AS m FROM deckc a JOIN deckc b ON a.m < b.m WHERE a.rk >= 13 AND b.rk >= 13)
SELECT c_custkey, count(*) AS left_over FROM dealt JOIN aces ON (aces.m & (dm[1]|dm[2]|dm[5]|dm[6]|dm[7])) = 0 GROUP BY 1
""")
def excluded_combo_choices(spark, sf):
    masks = [(1 << a) | (1 << b) for a in range(52) for b in range(a + 1, 52) if a % 13 >= 11 and b % 13 >= 11]
    held = deals(spark, sf, "customer", "c_custkey", 3).withColumns({"excluded": F.col("hero_mask").bitwiseOR(F.col("board_mask")), "combos": F.expr("array(" + ",".join(f"{m}L" for m in masks) + ")")})
    return held.select("c_custkey", F.size(compatible(held, "combos", "excluded")).cast("bigint").alias("left_over"))


# ---- histograms and buckets ------------------------------------------------------------------


def embedding_histograms(spark, sf):
    values = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    return table(spark, sf, "embeddings").select("vec_id", "label", E.l1_normalized(values).alias("h"))


@query("histogram_normalization", "F29", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))) / list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))), 8) AS total, round(abs(embedding[1]::DOUBLE) / list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))), 8) AS first_share FROM embeddings")
def histogram_normalization(spark, sf):
    total = F.aggregate("h", F.lit(0.0), lambda a, x: a + x)
    return embedding_histograms(spark, sf).select("vec_id", F.round(total, 8).alias("total"), F.round(F.get("h", F.lit(0)), 8).alias("first_share"))


EMD_CTE = """
WITH n AS (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings), s AS (SELECT vec_id, sum(abs(x::DOUBLE)) AS t FROM n GROUP BY 1), p AS (SELECT vec_id, label, i, abs(x::DOUBLE) / t AS v FROM n JOIN s USING (vec_id)),
c AS (SELECT *, sum(v) OVER (PARTITION BY vec_id ORDER BY i) AS cum FROM p)
"""


@query("histogram_distance", "W7", EMD_CTE + """
, z AS (SELECT label, i, avg(v) AS v FROM p GROUP BY 1, 2), zc AS (SELECT label, i, sum(v) OVER (PARTITION BY label ORDER BY i) AS cum FROM z)
SELECT vec_id, round(avg(abs(c.cum - zc.cum)), 8) AS distance FROM c JOIN zc ON c.label IS NOT DISTINCT FROM zc.label AND c.i = zc.i GROUP BY 1
""")
def histogram_distance(spark, sf):
    """Every histogram's distance to the mean histogram of its label."""
    rows = embedding_histograms(spark, sf)
    places = rows.select("label", F.posexplode("h").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("v"))
    means = places.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda p: p["v"]).alias("mean"))
    both = rows.alias("r").join(means.alias("m"), F.expr("r.label <=> m.label"))
    return both.select("vec_id", F.round(E.emd(F.col("h"), F.col("mean")), 8).alias("distance"))


@query("histogram_clusters", "M15 X3")
def histogram_clusters(spark, sf):
    rows = embedding_histograms(spark, sf).select("vec_id", "h")
    found = B.kmeans_emd(rows, "vec_id", "h", 4, seed=42)
    return B.assign(rows, "h", found.centroids).select("vec_id", "cluster", F.round("distance", 8).alias("distance"))


def river_spots(spark, sf):
    held = deals(spark, sf, "supplier", "s_suppkey", 5)
    canon = held.withColumn("_c", C.canonical_board(F.col("board")))
    return canon.select("s_suppkey", "hero_mask", "board_mask", F.col("_c.key").alias("board_key"), C.canonical_hand(F.col("hero"), F.col("_c.permutation")).alias("hand_key"))


@query("bucket_abstraction", "M17 U6 A25")
def bucket_abstraction(spark, sf):
    seen = river_spots(spark, sf)
    reps = seen.groupBy("board_key", "hand_key").agg(F.min_by(F.struct("hero_mask", "board_mask"), F.col("s_suppkey")).alias("r")).select("board_key", "hand_key", "r.*")
    equities = E.equity_vs_uniform(reps, ["board_key", "hand_key"], "hero_mask", "board_mask", 0)
    return B.bucket_table(E.equity_histogram(equities, ["board_key", "hand_key"]), "board_key", "hand_key", "histogram", 4)


BUCKETS = f"""
WITH {DECK_CTE}, {deal_cte('customer', 'c_custkey')}, {deal_cte('supplier', 's_suppkey', name='known')}, keyed AS (SELECT c_custkey, d[5] || d[6] AS board_key, d[1] AS hand_key FROM dealt),
tab AS (SELECT d[5] || d[6] AS board_key, d[1] AS hand_key, min(s_suppkey) % 9 AS bucket FROM known GROUP BY 1, 2)
SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN -1 ELSE bucket END AS bucket, CASE WHEN c_custkey % 5 <> 0 AND bucket IS NULL THEN 'canonical_key_missing' END AS error FROM keyed LEFT JOIN tab USING (board_key, hand_key)
"""


@query("bucket_lookup", "J7", BUCKETS)
def bucket_lookup(spark, sf):
    """The hands of customers in a table of the hands of suppliers."""

    def keyed(name, key):
        board = F.concat(F.get("board", F.lit(0)), F.get("board", F.lit(1)))
        return deals(spark, sf, name, key, 3).select(key, board.alias("board_key"), F.get("hero", F.lit(0)).alias("hand_key"))

    known = keyed("supplier", "s_suppkey").groupBy("board_key", "hand_key").agg((F.min("s_suppkey") % 9).alias("bucket"))
    return B.lookup_bucket(keyed("customer", "c_custkey"), known, ["board_key", "hand_key"], F.col("c_custkey") % 5 == 0).select("c_custkey", "bucket", "error")
