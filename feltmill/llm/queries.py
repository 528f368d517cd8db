"""Registered queries of this subpackage: name -> callable, and the DuckDB twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feltmill.llm import (
    attention_quality,
    hilbert_negatives,
    language_filters,
    line_dedup,
    mincut_extraction,
    multiset_fingerprint,
    piece_transducer,
    sign_hash_links,
    simhash_tiles,
    spaced_seeds,
    suffix_groups,
    turn_alignment,
    warc,
)
from feltmill.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"

Query = Callable[[SparkSession, str], DataFrame]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def fold(divisor: int):  # noqa: ANN201
    """crc32 of doc_id as text modulo `divisor`; a missing doc_id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


LINE_DEDUP_SQL = """
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
    FROM documents
), keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), held AS (
    SELECT key, min(doc_id) AS holder FROM keyed WHERE length(key) >= 10 GROUP BY key
), judged AS (
    SELECT doc_id, line, place, coalesce(doc_id > holder, FALSE) AS gone FROM keyed LEFT JOIN held USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@query("op2_line_dedup", LINE_DEDUP_SQL)
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.marked(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("__row.doc_id", "n_lines", "n_dropped", F.sha2(F.encode("__row.text", "UTF-8"), 256).alias("kept_sha256"))


TOKENS_SQL = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"


def _seed_sql(mask: str, number: int, row: str) -> str:
    chosen = ", ".join(f"{row}[p + {k}]" for k, m in enumerate(mask) if m == "1")
    return f"list_transform(range(1, greatest(len({row}) - {len(mask)} + 2, 1)), lambda p: {{'p': p, 's': concat_ws(' ', {number}, {chosen})}})"


def _seeds_sql(row: str) -> str:
    return "list_concat(list_concat({}, {}), {})".format(*[_seed_sql(m, i, row) for i, m in enumerate(spaced_seeds.MASKS)])


DECONTAMINATION_SQL = f"""
WITH items AS (
    SELECT min(item_id) AS item_id, item FROM (SELECT item_id, {TOKENS_SQL} AS item FROM benchmark) WHERE len(item) >= 5 GROUP BY item
), texts AS (
    SELECT DISTINCT doc_id, toks FROM (SELECT doc_id, {TOKENS_SQL} AS toks FROM documents)
), item_seeds AS (
    SELECT item_id, item, x.p AS ip, x.s AS s FROM (SELECT item_id, item, unnest({_seeds_sql("item")}) AS x FROM items)
), text_seeds AS (
    SELECT doc_id, toks, x.p AS dp, x.s AS s FROM (SELECT doc_id, toks, unnest({_seeds_sql("toks")}) AS x FROM texts)
), sites AS (
    SELECT DISTINCT doc_id, toks, item_id, item, dp - ip AS start FROM text_seeds JOIN item_seeds USING (s)
), aligned AS (
    SELECT doc_id, item_id, start, greatest(-start, 0) AS skip, least(len(item), {spaced_seeds.STRETCH}) AS width,
           list_transform(range(greatest(-start, 0) + 1, least(len(item), len(toks) - start) + 1),
                          lambda i: CASE WHEN item[i] = toks[start + i] THEN 1 ELSE 0 END) AS same
    FROM sites
), judged AS (
    SELECT *, list_max(list_transform(range(1, len(same) - width + 2), lambda i: list_sum(same[i:i + width - 1]))) AS best
    FROM aligned WHERE len(same) >= width
), ranked AS (
    SELECT doc_id, item_id, start + skip AS doc_start, len(same) AS n_aligned, list_sum(same) AS n_matched,
           row_number() OVER (PARTITION BY doc_id, item_id ORDER BY best / width DESC, list_sum(same) DESC, start) AS r
    FROM judged WHERE best >= {spaced_seeds.LIKENESS} * width
)
SELECT doc_id, item_id, doc_start::BIGINT AS doc_start, n_aligned::BIGINT AS n_aligned, n_matched::BIGINT AS n_matched,
       n_matched / n_aligned AS similarity
FROM ranked WHERE r = 1
"""


@query("op3_spaced_seed_decontamination", DECONTAMINATION_SQL)
def op3_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each contaminated document and benchmark text: where its best overlap lies and how well it agrees."""
    found = spaced_seeds.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("__doc", "doc_id").drop("__text_key")


@query("op4_simhash_tiles")
def op4_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_tiles.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash_tiles.hex_digits(F.col("__fp")).alias("fingerprint"), "component_id")


@query("op5_language_filters")
def op5_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold(4) == 2)
    model = language_filters.learn(docs.filter(~F.col("held_out")))
    return language_filters.predict(docs, model, "doc_id", "held_out")


@query("op10_piece_transducer")
def op10_piece_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, how many are byte pieces, and whether decoding gives the text again."""
    model = piece_transducer.compile_model(PIECE_MODEL)
    return piece_transducer.encode_texts(table(spark, sf_dir, "documents"), model, "doc_id").withColumn("n_ids", F.size("ids").cast("long"))


@query("op1_attention_quality")
def op1_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", fold(3) == 1)
    labels = table(spark, sf_dir, "labels").filter(fold(3) != 1)
    model = attention_quality.learn(docs, labels)
    found = attention_quality.scores(docs, model, "doc_id", "held_out")
    return found.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "n_passages")


WARC_SQL = """
WITH p AS (
    SELECT page_id, sha1(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, '')) AS payload_bytes FROM pages
), m AS (
    SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS largest FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < largest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < largest THEN largest END AS refers_to
FROM m
"""


@query("op6_warc", WARC_SQL)
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"))
    found = warc.without_gaps(warc.read_archives(spark, manifest, with_payload=False))
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d*)>$", 1).try_cast("long")
    return found.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


@query("op7_multiset_fingerprint")
def op7_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("digests", multiset_fingerprint.piece_digests(F.col("text"))).select("doc_id", "text", multiset_fingerprint.fingerprint(F.col("digests")).alias("words"))
    both = multiset_fingerprint.with_successor(own, F.struct("text", "words"))
    text = F.col("__row.text")
    half = F.floor(F.length(text) / 2).cast("int")
    edited = F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring("__next.text", F.lit(1), half))
    both = both.select(
        "__row.doc_id", "__row.words", F.length(text).cast("long").alias("n_chars"), F.col("__next.words").alias("next_words"), edited.alias("edited")
    )
    both = both.withColumn("digests", multiset_fingerprint.piece_digests(F.col("edited"))).withColumn("edited_words", multiset_fingerprint.fingerprint(F.col("digests")))
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        multiset_fingerprint.digits(F.col("words")).alias("fingerprint"),
        multiset_fingerprint.digits(F.col("edited_words")).alias("edited_fingerprint"),
        multiset_fingerprint.likeness(F.col("words"), F.col("edited_words")).alias("near_edited"),
        multiset_fingerprint.likeness(F.col("words"), F.col("next_words")).alias("near_next"),
    )


@query("op8_mincut_extraction")
def op8_mincut_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mincut_extraction.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op9_suffix_groups")
def op9_suffix_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_groups.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


EMBEDDING_LINKS_SQL = f"""
WITH RECURSIVE v AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS one, b.vec_id AS two FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= {sign_hash_links.THRESHOLD}
), reach AS (
    SELECT vec_id AS node, vec_id AS other FROM embeddings
    UNION
    SELECT node, two FROM reach JOIN links ON other = one
), least AS (
    SELECT node, min(other) AS component_id FROM reach GROUP BY node
), counted AS (
    SELECT one, count(*) AS n FROM links GROUP BY one
)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON node = vec_id LEFT JOIN counted ON one = vec_id
"""


@query("op11_sign_hash_links", EMBEDDING_LINKS_SQL)
def op11_sign_hash_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sign_hash_links.link_vectors(table(spark, sf_dir, "embeddings"))
    return found.select("__row.vec_id", "n_links", "component_id", "kept")


def _least_sql(*options: str) -> str:
    return f"list_min([{', '.join(options)}])"


def _edit_sql(letter: str, cost: str, line: str | None, rest: str) -> str:
    """An edit before the struct `rest` of (cost, audit, lines)."""
    lines = f"{rest}.lines" if line is None else f"list_prepend({line}, {rest}.lines)"
    return f"{{'cost': {cost} + {rest}.cost, 'audit': '{letter}' || {rest}.audit, 'lines': {lines}}}"


def _take_sql(role: str, rest: str) -> str:
    keep, rename = _edit_sql("K", "cut", "role || ':' || text", rest), _edit_sql("R", "1 + cut", f"'{role}:' || text", rest)
    return f"CASE WHEN gone THEN NULL WHEN role[1] = '{role[0]}' THEN {keep} ELSE {rename} END"


def _insert_sql(role: str, rest: str) -> str:
    return _edit_sql("I", "5", f"'{role}:'", rest)


CONVERSATIONS_SQL = f"""
WITH RECURSIVE crc_table AS (
    SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS crcs
    FROM range(256) t(n)
), keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
    FROM conversations
), faulted AS (
    SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(key) + 1), lambda i: ascii(key[i])::BIGINT)),
                              lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS fault
    FROM keyed, crc_table
), damaged AS (
    SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
           CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
           unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM faulted WHERE fault <> 0
), ordered AS (
    SELECT *, row_number() OVER w AS k, role[1] AS letter, lag(role[1]) OVER w AS before,
           rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
    FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, unhex(md5(text)), copy)
), turns AS (
    SELECT *, bare = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again, NOT regexp_matches(bare, '[.!?]$') AS short
    FROM ordered
), marked AS (
    SELECT *, blank OR again AS gone, CASE WHEN short THEN 5 ELSE 0 END::BIGINT AS cut FROM turns
), counted AS (
    SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again AND NOT blank) AS duplicate,
           count(*) FILTER (WHERE short AND NOT gone) AS truncated,
           count(*) FILTER (WHERE before IS NOT NULL AND before || letter NOT IN ('su', 'ua', 'au')) AS illegal
    FROM marked GROUP BY conv_id
), walk AS (
    -- the cheapest rest by what comes next: anything, u after s, a, u or the end
    SELECT conv_id, n AS k, {{'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]}} AS start,
           {{'cost': 10::BIGINT, 'audit': 'II', 'lines': ['user:', 'assistant:']}} AS after_s,
           {{'cost': 5::BIGINT, 'audit': 'I', 'lines': ['assistant:']}} AS a, {{'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]}} AS u
    FROM counted
    UNION ALL
    SELECT conv_id, k - 1, {_least_sql("start", _insert_sql("user", "a"))}, {_least_sql("after_s", _insert_sql("user", "a"))}, a, u
    FROM (
        SELECT conv_id, k, start, after_s, {_least_sql("a", _insert_sql("assistant", "u"))} AS a, {_least_sql("u", _insert_sql("user", "a"))} AS u
        FROM (
            SELECT w.conv_id, w.k,
                   {_least_sql(_edit_sql("D", "2", None, "w.start"), _take_sql("user", "w.a"), "CASE WHEN NOT gone AND role[1] = 's' THEN " + _edit_sql("K", "cut", "role || ':' || text", "w.after_s") + " END")} AS start,
                   {_least_sql(_edit_sql("D", "2", None, "w.after_s"), _take_sql("user", "w.a"))} AS after_s,
                   {_least_sql(_edit_sql("D", "2", None, "w.a"), _take_sql("assistant", "w.u"))} AS a,
                   {_least_sql(_edit_sql("D", "2", None, "w.u"), _take_sql("user", "w.a"))} AS u
            FROM walk w JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.k = w.k
        )
    )
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(start.cost, 0) AS cost, coalesce(start.audit, '') AS audit,
       sha256(coalesce(array_to_string(start.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN walk w ON w.conv_id IS NOT DISTINCT FROM o.conv_id AND w.k = 0
"""


def damaged_conversations(df: DataFrame) -> DataFrame:
    """Turns with faults by crc32(conv_id:turn) % 20: dropped, emptied, without end marks, repeated or of another role."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    text, fault = named("text"), F.pmod(F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")), F.lit(20))
    kept = df.select("conv_id", "turn", named("role").alias("role"), text.alias("text"), fault.alias("fault")).filter("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return kept.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


@query("op12_turn_alignment", CONVERSATIONS_SQL)
def op12_turn_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_conversations(table(spark, sf_dir, "conversations"))


def repaired_conversations(df: DataFrame) -> DataFrame:
    found = turn_alignment.repair_digests(damaged_conversations(df))
    named = df.select("conv_id").distinct().select("conv_id", turn_alignment.with_null(F.col("conv_id")).alias("__conv"), F.col("conv_id").isNotNull().alias("__known"))
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in turn_alignment.COUNTS]
    digest = F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")
    return named.join(found, ["__conv", "__known"], "left").select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), digest)


NEGATIVES_SQL = f"""
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor({hilbert_negatives.SCALE} * x::DOUBLE)) AS q
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {hilbert_negatives.POSITIVES}
)
SELECT anchor_id, positive_id, row_number() OVER w AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND {hilbert_negatives.SHARE} * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= {hilbert_negatives.NEGATIVES}
"""


def anchor_rows(df: DataFrame) -> DataFrame:
    """Usable rows with whole-number vectors; where vec_id is divisible by 7, the label is the next of ten."""
    rows = df.filter(hilbert_negatives.usable(F.col("vec_id"), F.col("embedding"), F.col("label")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.select(F.col("vec_id").alias("__id"), hilbert_negatives.whole_numbers(F.col("embedding")).alias("__vector"), label.alias("__label"))


@query("op13_hilbert_negatives", NEGATIVES_SQL)
def op13_hilbert_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_negatives.hard_negatives(anchor_rows(table(spark, sf_dir, "embeddings")), F.col("__id") % 100 == 0)
