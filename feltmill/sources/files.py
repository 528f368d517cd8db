"""File scans: JSONL, CSV, JSON documents, Parquet splits, hand records and text histories."""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cards as C
from ..functions.rules import all_reasons
from ..functions.values import strip, to_double, to_flag, to_int
from ..operators.profile import variant_kind
from ..schemas import BOOTSTRAP_NUMERIC, FEATURE_ALIASES, check_training_columns

BOM = "﻿"


def numbered_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Text lines with their file and 0-based line number.

    A file may be scanned by many tasks. Lines are numbered inside each file split, and the number
    of lines in the splits before it is added, so no file has to pass through one task.
    """
    raw = spark.read.text(paths if isinstance(paths, str) else list(paths)).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_start"), "value", F.monotonically_increasing_id().alias("_id")
    )
    sizes = raw.groupBy("path", "_start").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("path", "_start", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("path", "_start").orderBy("_id")
    numbered = raw.withColumn("_row", F.row_number().over(inside) - 1).join(offsets, ["path", "_start"])
    return numbered.select("path", (F.col("_row") + F.col("_before")).alias("line"), F.regexp_replace("value", f"^{BOM}", "").alias("value"))


def _existing(spark: SparkSession, paths: Sequence[str]) -> tuple[list[str], list[str]]:
    """(readable paths, warnings about the others)."""
    good, warnings = [], []
    for path in paths:
        try:
            spark.read.text(path).schema
            good.append(path)
        except AnalysisException as exc:
            warnings.append(f"{path}:{type(exc).__name__}:{exc.getCondition()}")
    return good, warnings


def json_lines(spark: SparkSession, paths: Sequence[str], schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """(records, load warnings). Blank lines are skipped, bad lines become warnings, nothing raises."""
    good, unreadable = _existing(spark, paths)
    missing = spark.createDataFrame([(w,) for w in unreadable], "warning string")
    if not good:
        return spark.createDataFrame([], schema), missing
    lines = numbered_lines(spark, good).filter(F.length(strip(F.col("value"))) > 0)
    lines = lines.withColumn("_doc", F.try_parse_json("value"))
    kind = F.when(F.col("_doc").isNull(), "invalid_json").when(variant_kind(F.col("_doc")) != "object", "non_object")
    judged = lines.withColumn("_problem", kind)
    records = judged.filter(F.col("_problem").isNull()).select(F.from_json("value", schema).alias("r")).select("r.*")
    where = F.concat(F.col("path"), F.lit(":line_"), F.col("line").cast("string"), F.lit(":"), F.col("_problem"))
    return records, judged.filter(F.col("_problem").isNotNull()).select(where.alias("warning")).unionByName(missing)


def run_records(spark: SparkSession, paths: Sequence[str], schema: T.StructType) -> DataFrame:
    """Run-result JSONL in which a blank, broken or non-object line stays as a failed record with `invalid` true."""
    lines = numbered_lines(spark, list(paths)).withColumn("_doc", F.try_parse_json("value"))
    blank = F.length(strip(F.col("value"))) == 0
    problem = (
        F.when(blank, "jsonl_empty_line").when(F.col("_doc").isNull(), "JSONDecodeError").when(variant_kind(F.col("_doc")) != "object", "jsonl_record_must_be_object")
    )
    read = lines.withColumns({"_problem": problem, "_r": F.from_json("value", schema)})
    bad = F.col("_problem").isNotNull()
    replaced = {
        "record_type": F.lit("solver_run_result"), "solver_status": F.lit("failed"), "error": F.col("_problem"),
        "quality": F.struct(F.lit(None).cast("bigint").alias("iterations"), F.lit(None).cast("double").alias("exploitability_last"), F.lit(False).alias("is_label_candidate"), F.lit("jsonl_invalid").alias("exclusion_reason")),
        "warnings": F.array(F.concat(F.lit("path:"), F.col("path")), F.concat(F.lit("line_index:"), F.col("line").cast("string"))),
    }
    return read.select(
        *[F.when(bad, replaced.get(f.name, F.lit(None)).cast(f.dataType)).otherwise(F.col(f"_r.{f.name}")).alias(f.name) for f in schema.fields], F.coalesce(bad, F.lit(False)).alias("invalid")
    )


def selected_lines(spark: SparkSession, path: str, start_index: int, max_jobs: int, largest: int | None = None) -> DataFrame:
    """A window of lines by number with `load_error` for blank and broken ones. The bounds are checked before any read.

    With `largest`, a wider window is refused.
    """
    if max_jobs <= 0:
        raise ValueError("max_jobs_must_be_positive")
    if largest is not None and max_jobs > largest:
        raise ValueError(f"max_jobs_exceeds_limit:{largest}")
    if start_index < 0:
        raise ValueError("start_index_must_be_nonnegative")
    lines = numbered_lines(spark, path).filter(F.col("line").between(start_index, start_index + max_jobs - 1))
    blank = F.length(strip(F.col("value"))) == 0
    return lines.select("line", F.col("value").alias("raw"), F.when(blank, "jsonl_empty_line").when(F.try_parse_json("value").isNull(), "JSONDecodeError").alias("load_error"))


def snapshots(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Snapshot JSONL, objects only; a byte order mark does no harm."""
    lines = spark.read.text(path).select(strip(F.regexp_replace("value", f"^{BOM}", "")).alias("value")).filter("value <> ''")
    objects = lines.filter(variant_kind(F.try_parse_json("value")) == "object")
    return objects.select(F.from_json("value", schema).alias("r")).select("r.*")


def reference_schema(spark: SparkSession, path: str) -> T.StructType:
    """Schema of an example file, used as a contract."""
    return spark.read.json(path).schema


def scenario_csv(spark: SparkSession, paths: Sequence[str], line_breaks_in_cells: bool = False) -> DataFrame:
    """Scenario CSV files as text with `source_file`; an unnamed first column becomes `row_index`.

    Files are read in pieces unless cells hold line breaks, which ties a file to one task.
    """
    df = spark.read.option("header", True).option("escape", '"').option("multiLine", line_breaks_in_cells).csv(list(paths))
    return df.select(
        *[F.col(f"`{c}`").alias("row_index" if c in ("_c0", "", BOM) else c.lstrip(BOM)) for c in df.columns],
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("source_file"),
    )


# Scenario columns, each with the older names it is read from.
SCENARIO_ALIASES = {
    "correct_decision": ("correct_decision", "label", "answer", "output", "correct_action"),
    "available_moves": ("available_moves", "legal_actions", "actions"),
    "pot_size": ("pot_size", "pot"),
    "hero_pos": ("hero_pos", "hero_position"),
    "prev_line": ("prev_line", "action_history", "history"),
    "postflop_action": ("postflop_action", "action_history"),
    "evaluation_at": ("evaluation_at", "street"),
    **{c: (c,) for c in ("row_index", "hero_holding", "holding", "preflop_action", "board_flop", "board_turn", "board_river", "num_players", "num_bets", "hero_position")},
}


def scenario_json(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """JSON documents (a list, or the first non-empty of data / rows / examples) with the older column names filled in."""
    doc = spark.read.option("wholetext", True).text(list(paths)).select(
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("source_file"), F.try_parse_json("value").alias("_doc")
    )
    lists = [F.try_variant_get("_doc", path, "array<variant>") for path in ("$", "$.data", "$.rows", "$.examples")]
    items = F.coalesce(*[F.when(F.size(items) > 0, items) for items in lists])
    rows = doc.select("source_file", F.posexplode(items).alias("_position", "_item")).filter(variant_kind(F.col("_item")) == "object")

    def field(names: Sequence[str]) -> Column:
        return F.coalesce(*[F.nullif(F.try_variant_get("_item", f"$.{n}", "string"), F.lit("")) for n in names], F.lit(None).cast("string"))

    filled = {name: field(names) for name, names in SCENARIO_ALIASES.items()}
    filled["row_index"] = F.coalesce(filled["row_index"], F.col("_position").cast("string"))
    filled["pot_size"] = F.coalesce(filled["pot_size"], F.lit("0"))
    for name in ("prev_line", "postflop_action"):
        filled[name] = F.coalesce(filled[name], F.lit(""))
    early = F.when(F.col("source_file").startswith("preflop"), "PREFLOP").otherwise("UNKNOWN")
    filled["evaluation_at"] = F.coalesce(filled["evaluation_at"], early)
    return rows.select("source_file", *[c.alias(n) for n, c in filled.items()])


# Scenario file names in the order they are looked for.
SCENARIO_CSV = ("preflop_60k_train_set_game_scenario_information.csv", "postflop_10k_test_set_game_scenario_information.csv")
SCENARIO_CSV_GLOB = "*game_scenario_information.csv"
SCENARIO_JSON = ("preflop_1k_test_set_prompt_and_label.json", "postflop_10k_test_set_prompt_and_label.json")


def scenario_paths(data_dir: str) -> list[str]:
    """The two named CSV files, else any scenario CSV, else the JSON files, else an error."""
    named = [os.path.join(data_dir, n) for n in SCENARIO_CSV]
    if all(os.path.exists(p) and os.path.getsize(p) > 0 for p in named):
        return named
    found = sorted(glob.glob(os.path.join(data_dir, SCENARIO_CSV_GLOB)))
    if found:
        return found
    fallback = [os.path.join(data_dir, n) for n in SCENARIO_JSON if os.path.exists(os.path.join(data_dir, n))]
    if fallback:
        return fallback
    raise FileNotFoundError(f"missing_scenario_sources:{data_dir}")


def candidate_csv(spark: SparkSession, path: str) -> DataFrame:
    """Candidate CSV: known numbers through their older names, `excluded` as boolean, empty labels as null."""
    df = spark.read.option("header", True).csv(path)
    check_training_columns(df.columns)
    have = set(df.columns)
    numbers = {}
    for feature in BOOTSTRAP_NUMERIC:
        named = [n for n in (feature, *FEATURE_ALIASES.get(feature, ())) if n in have]
        if named:
            numbers[feature] = to_double(F.col(f"`{named[0]}`"), "blank", bool_words=True)
    label = F.nullif(strip(F.col("bootstrap_label")), F.lit(""))
    return df.withColumns({**numbers, "excluded": to_flag(F.col("excluded")) if "excluded" in have else F.lit(False), "bootstrap_label": label})


def parquet_splits(spark: SparkSession, root: str, splits: Sequence[str], config: str) -> DataFrame:
    """Staged Parquet below split=... folders, tagged with split, config and the row number inside its file."""
    df = spark.read.option("basePath", root).parquet(*[f"{root}/split={s}" for s in splits])
    return df.select(*[c for c in df.columns if c != "split"], F.col("_metadata.row_index").alias("_source_row_idx"), F.col("split").cast("string").alias("_source_split"), F.lit(config).alias("_source_config"))


HAND_RECORD = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("hand_id", T.StringType()),
        T.StructField("variant", T.StringType()),
        T.StructField("actions", T.ArrayType(T.StringType())),
        T.StructField("blinds", T.ArrayType(T.DoubleType())),
        T.StructField("antes", T.ArrayType(T.DoubleType())),
        T.StructField("stacks", T.ArrayType(T.DoubleType())),
        T.StructField("players", T.ArrayType(T.StringType())),
    ]
)


def hand_records(spark: SparkSession, path: str) -> DataFrame:
    """Hand-record files (.phh, .phhs) below a folder: one row per hand, whatever the number of hands in a file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{phh,phhs}").load(path).select("path", "content")

    def numbers(value: object) -> list[float]:
        return [float(x) if isinstance(x, (int, float)) else 0.0 for x in value] if isinstance(value, list) else []

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tomllib

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                doc = tomllib.loads(bytes(content).decode("utf-8"))
                stem = os.path.splitext(os.path.basename(name))[0]
                hands = [(stem, doc)] if "actions" in doc else [(k, v) for k, v in doc.items() if isinstance(v, dict) and "actions" in v]
                rows = [
                    (name, str(h.get("hand") or key), h.get("variant"), [str(a) for a in h["actions"]], numbers(h.get("blinds_or_straddles")), numbers(h.get("antes")), numbers(h.get("starting_stacks")),
                     [str(p) for p in h.get("players") or []])
                    for key, h in hands
                ]
                yield pd.DataFrame(rows, columns=HAND_RECORD.names)

    return files.mapInPandas(read, HAND_RECORD)


# Fixed patterns: where a hand of a text history begins, and its whole header.
SECTION_START = r"(?i)(?=##\s*Game:)"
SECTION_OPENS = r"(?i)^##\s*Game:"
SECTION_HEAD = r"(?i)^##\s*Game:\s*[0-9]+\s*\|\s*Hand:\s*[0-9]+\s*##"


def history_sections(spark: SparkSession, path: str) -> DataFrame:
    """Text histories cut into hands: (path, section_id, text), sections counted from 1 in each file.

    A header begins a section wherever it stands, in any case and with any blanks. Headers are counted inside each
    file split and the headers of the splits before are added, so one large file is shared by many tasks and a hand
    that lies across two splits stays whole.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_start"), "value", F.monotonically_increasing_id().alias("_id")
    )
    pieces = raw.select("path", "_start", "_id", F.posexplode(F.split("value", SECTION_START)).alias("_piece", "value"))
    opens = F.when(F.col("value").rlike(SECTION_OPENS), 1).otherwise(0)
    totals = pieces.groupBy("path", "_start").agg(F.sum(opens).alias("_n"))
    before = Window.partitionBy("path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("path", "_start", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("path", "_start").orderBy("_id", "_piece").rowsBetween(Window.unboundedPreceding, 0)
    counted = pieces.withColumn("_own", F.sum(opens).over(inside)).join(offsets, ["path", "_start"])
    lines = counted.withColumn("section_id", F.col("_own") + F.col("_before")).filter("section_id > 0")
    whole = lines.groupBy("path", "section_id").agg(F.array_sort(F.collect_list(F.struct("_start", "_id", "_piece", "value"))).alias("_lines"))
    text = strip(F.array_join(F.transform("_lines", lambda x: x["value"]), "\n"))
    return whole.select("path", "section_id", text.alias("text")).filter(F.col("text").rlike(SECTION_HEAD))


def split_sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """Hands of texts that are already rows: (key, section, text)."""
    parts = df.select(key, F.posexplode(F.split(F.col(text), SECTION_START)).alias("section", "text"))
    return parts.filter(F.col("text").rlike(SECTION_HEAD)).withColumn("text", strip(F.col("text")))


# Columns of a solve request and the streets it may start on.
REQUEST_COLUMNS = ("name", "starting_street", "initial_board", "stacks_bb", "bet_sizes", "abstraction_path", "iterations")
REQUEST_STREETS = ("flop", "turn", "river")


def parse_requests(df: DataFrame) -> DataFrame:
    """Solve requests as text to typed columns with an `errors` list; boards in any of three notations."""
    missing = [c for c in REQUEST_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing!r}")
    street = F.lower(F.trim("starting_street"))
    board = F.trim(F.regexp_replace(F.coalesce("initial_board", F.lit("")), ",", " "))
    cards = F.when(board == "", F.array().cast("array<string>")).when(F.instr(board, F.lit(" ")) > 0, F.split(board, r"\s+")).otherwise(C.split_cards(board, keep_tail=True))
    sizes = F.filter(F.transform(F.split(F.coalesce("bet_sizes", F.lit("")), ","), F.trim), lambda s: s != "")
    staged = df.withColumns({"_cards": cards, "_sizes": sizes})
    errors = all_reasons(
        [
            (F.coalesce(F.length(F.trim("name")), F.lit(0)) == 0, "'name' is empty"),
            (street == "preflop", "'preflop' rejected"),
            (~street.isin("preflop", *REQUEST_STREETS), F.concat(F.lit("starting_street not accepted:"), F.coalesce(street, F.lit("")))),
            (to_int(F.col("stacks_bb")).isNull(), F.concat(F.lit("stacks_bb not an integer:"), F.coalesce("stacks_bb", F.lit("")))),
            (F.exists("_sizes", lambda s: to_double(s).isNull()), "invalid bet_sizes"),
            (to_int(F.col("iterations")).isNull(), F.concat(F.lit("iterations not an integer:"), F.coalesce("iterations", F.lit("")))),
            (F.exists("_cards", lambda c: C.strict_card(c).isNull()), "invalid initial_board"),
        ]
    )
    return staged.select(
        F.trim("name").alias("name"), street.alias("starting_street"), F.transform("_cards", C.strict_card).alias("board"), to_int(F.col("stacks_bb")).alias("stacks_bb"),
        F.transform("_sizes", lambda s: to_double(s)).alias("bet_sizes"), F.trim("abstraction_path").alias("abstraction_path"), to_int(F.col("iterations")).alias("iterations"), errors.alias("errors"),
    )


def solve_requests(spark: SparkSession, path: str) -> DataFrame:
    return parse_requests(spark.read.option("header", True).option("inferSchema", False).csv(path))


def merge_sources(spark: SparkSession, paths: dict[str, str]) -> tuple[dict[str, DataFrame], list[str]]:
    """CSV sources by key, with warnings for missing ones."""
    frames, warnings = {}, []
    for key, path in paths.items():
        good, _ = _existing(spark, [path])
        if not good:
            warnings.append(f"missing_source:{key}:{path}")
            continue
        frames[key] = spark.read.option("header", True).csv(path)
    if not frames:
        raise FileNotFoundError("no_merge_sources_available")
    return frames, warnings
