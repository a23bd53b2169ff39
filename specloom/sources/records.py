"""Readers and writers of the pipeline's files, each with an explicit schema."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from specloom.functions.text import SLOTS, blank, clean_description, decimals, is_non_atomic, preclean, safe_id, safe_int, slot_value, truthy
from specloom.operators.smells import SMELLS

# Column and field names of the stored files.
GOLD_COLUMNS = (
    ["reqId", "phase", "order", "nlText", "nlDescription", *(f"gold_{s}" for s in SLOTS), "gold_conditionType", "gold_overallIncomplete", "gold_hadDisagreement", "annotatorUsername", "rimayText", *(f"slot_{s}" for s in SLOTS)]
    + ["conditionType", "nonAtomic", "overallIncomplete", "notes"]
)
SLOT_STRUCT = T.StructType([T.StructField(s, T.StringType()) for s in SLOTS])
SMELL_STRUCT = T.StructType([T.StructField(c, T.StringType()) for c in ("segment_id", "smell", "value")])


def manifest_schema(checker: str = "tool") -> T.StructType:
    """Fields of a conversion record as files hold them; those of the smell checker begin with its name there."""
    return T.StructType(
        [T.StructField(c, T.StringType()) for c in ("reqId", "strategy", "rimay", "rimay_stripped")]
        + [T.StructField("llm_slots", SLOT_STRUCT), T.StructField("is_non_atomic", T.BooleanType()), T.StructField(f"{checker}_passed", T.BooleanType()), T.StructField(f"{checker}_smells", T.ArrayType(SMELL_STRUCT))]
        + [T.StructField(c, T.StringType()) for c in (f"{checker}_error", "model")]
        + [T.StructField(c, T.LongType()) for c in ("latency_ms", "input_tokens", "output_tokens")]
    )


SMELL_COLUMNS = ["req_id", "segment_id", "segment", *SMELLS, "pattern", "template"]


def _strings(names) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """The gold CSV as text columns in the file's own order of columns; absent ones read as empty. Adds line."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if "reqId" not in raw.columns:
        raise ValueError("the gold file has no reqId column")
    return raw.select(*[blank(F.col(f"`{c}`") if c in raw.columns else F.lit("")).alias(c) for c in GOLD_COLUMNS], F.monotonically_increasing_id().alias("line"))


def gold_requirements(rows: DataFrame) -> DataFrame:
    """One row per requirement: the adjudicated values of its first row and all annotations in file order."""
    first = [c for c in GOLD_COLUMNS if c.startswith("gold_") or c in ("phase", "nlText", "nlDescription", "order")]
    annotation = F.struct("line", F.col("annotatorUsername").alias("annotator"), F.col("rimayText").alias("rimay"), *[slot_value(F.col(f"slot_{s}")).alias(s) for s in SLOTS], slot_value(F.col("conditionType")).alias("condition_type"), truthy(F.col("nonAtomic")).alias("non_atomic"), truthy(F.col("overallIncomplete")).alias("overall_incomplete"), "notes")
    out = rows.groupBy(F.col("reqId").alias("req_id")).agg(F.min_by(F.struct(*first), "line").alias("f"), F.min("line").alias("ordinal"), F.array_sort(F.collect_list(annotation)).alias("annotations"))
    slots = [slot_value(F.col(f"f.gold_{s}")).alias(f"gold_{s}") for s in SLOTS]
    return out.select("req_id", "ordinal", "f.phase", F.col("f.nlText").alias("nl_text"), F.col("f.nlDescription").alias("nl_description"), safe_int(F.col("f.order")).alias("order"), *slots, slot_value(F.col("f.gold_conditionType")).alias("gold_condition_type"), truthy(F.col("f.gold_overallIncomplete")).alias("gold_incomplete"), truthy(F.col("f.gold_hadDisagreement")).alias("had_disagreement"), "annotations")


def conversion_inputs(gold: DataFrame) -> DataFrame:
    """req_id, nl_text of every requirement, by its ordinal."""
    return gold.select("req_id", "nl_text", "ordinal")


def slots_map(df: DataFrame, prefix: str, name: str) -> DataFrame:
    """Adds the map slot -> value of the slot columns that begin with ``prefix``; absent columns count as empty."""
    cells = [x for s in SLOTS for x in (F.lit(s), slot_value(F.col(f"{prefix}{s}")) if f"{prefix}{s}" in df.columns else F.lit(""))]
    return df.withColumn(name, F.create_map(*cells))


def to_convert(inputs: DataFrame, exemplars: DataFrame, n_samples: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Inputs to be converted, and those skipped as exemplars or blank. A sample is cut first, by ordinal."""
    head = inputs if n_samples is None else inputs.orderBy("ordinal").limit(n_samples)
    marked = head.join(exemplars.select("req_id").distinct().withColumn("known", F.lit(True)), "req_id", "left")
    skip = F.col("known").isNotNull() | (blank(F.col("nl_text")) == "")
    return marked.where(~skip).drop("known"), marked.where(skip).drop("known")


def read_manifest(spark: SparkSession, path: str, checker: str = "tool") -> DataFrame:
    """Conversion records, one JSON object a line; blank lines are skipped and the last record of an id wins.

    The checker's fields come out as check_passed, check_smells and check_error."""
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("line", F.monotonically_increasing_id())
    rec = lines.select("line", F.from_json("value", manifest_schema(checker)).alias("r"))
    last = rec.groupBy(F.col("r.reqId").alias("id")).agg(F.max_by("r", "line").alias("r")).select("r.*")
    return last.withColumnsRenamed({f"{checker}_{c}": f"check_{c}" for c in ("passed", "smells", "error")})


def write_manifest(df: DataFrame, path: str, checker: str = "tool") -> None:
    df.withColumnsRenamed({f"check_{c}": f"{checker}_{c}" for c in ("passed", "smells", "error")}).write.mode("overwrite").json(path)


def _file(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """The run's metadata, one row; a row without columns where there is no such file."""
    p, fs = _file(spark, path)
    return spark.read.option("multiLine", True).json(path) if fs.exists(p) else spark.range(1).select()


def write_json(row: DataFrame, path: str) -> None:
    """A frame of one row as one JSON file, indented, nulls kept; run discovery reads it."""
    text = row.select(F.to_json(F.struct(*row.columns), {"pretty": "true", "ignoreNullFields": "false"}).alias("j")).first()["j"]
    write_text(row.sparkSession, path, text + "\n")


def run_meta(spark: SparkSession, counts: DataFrame, **values) -> DataFrame:
    """One row of metadata: the given values, then n_processed, n_skipped and skipped_ids of ``counts``."""
    return counts.select(*[(F.lit(v) if v is not None else F.lit(None).cast("bigint")).alias(k) for k, v in values.items()], "n_processed", "n_skipped", "skipped_ids")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, written by the driver wherever Spark's file systems reach."""
    p, fs = _file(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def discover_runs(spark: SparkSession, root: str) -> DataFrame:
    """All results below a folder, by path; a run is named by its folder, whatever the file says."""
    raw = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "results.json").json(root)
    path = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+/[^/]+)/scoring/results\.json$", 1)
    return raw.withColumn("run", path).where("run <> ''").orderBy("run")


def read_smell_report(spark: SparkSession, path: str) -> DataFrame:
    """The smell CSV: its rows have one field more than its header names, so the schema is given. Adds ordinal."""
    raw = spark.read.schema(_strings(SMELL_COLUMNS)).option("sep", ";").option("header", True).option("enforceSchema", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).csv(path)
    return raw.withColumn("ordinal", F.monotonically_increasing_id()).where(F.trim(F.coalesce("req_id", F.lit(""))) != "").fillna("")


def write_smell_report(df: DataFrame, path: str) -> None:
    """Requirement-level values and the pattern stand on a requirement's first segment only."""
    once = [*SMELLS[:5], "pattern", "template"]
    first = F.col("ordinal") == F.min("ordinal").over(Window.partitionBy("req_id"))
    cells = [F.when(first, F.col(f"`{c}`")).otherwise("").alias(c) if c in once else F.col(f"`{c}`") for c in SMELL_COLUMNS]
    df.select(*cells).write.mode("overwrite").option("sep", ";").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


#: The header of the experiment's report, the codes of its smells and the flags they stand for, in order.
EXPERIMENT_HEADER = ["Req ID", "Segment ID", "Req Segment", *SMELLS, "Rimay Pattern "]
EXPERIMENT_CODES = (
    ("non_atomic", "1"), ("incomplete", "2"), ("incorrect_order", "3"), ("coordination", "4"), ("not_requirement", "5"),
    ("no_actor_cond", "6"), ("no_verb_cond", "6"), ("no_actor_resp", "7"), ("no_modal_resp", "7"), ("no_verb_resp", "7"), ("", "8"),
    ("passive_cond", "9"), ("passive_resp", "9"), ("vague_cond", "10"), ("vague_resp", "10"),
)
EXPERIMENT_PATTERN_HEADER = ["Req ID", "Segment ID", "Req Segment", "03", "04", "05", "Rimay Pattern"]


def experiment_rows(flags: DataFrame) -> DataFrame:
    """req_id, segment_id, segment and 15 cells of codes, from segments with a flag column for each (absent: never set).

    Codes of requirements (1 to 5) stand on a requirement's first segment; code 8 is not in use. A row that could not
    be classified (``classified`` false) holds single blanks."""
    first = F.col("ordinal") == F.min("ordinal").over(Window.partitionBy("req_id"))
    known = F.coalesce(F.col("classified"), F.lit(True)) if "classified" in flags.columns else F.lit(True)
    cells = []
    for k, (name, code) in enumerate(EXPERIMENT_CODES, 3):
        on = F.coalesce(F.col(name), F.lit(False)) if name in flags.columns else F.lit(False)
        cells.append(F.when(~known, " " if k < 17 else None).when(on & (first if k < 8 else F.lit(True)), code).otherwise("").alias(f"c{k:02}"))
    return flags.select("req_id", "segment_id", "segment", *cells, "ordinal")


def experiment_patterns(segments: DataFrame) -> DataFrame:
    """The pattern form: seven fields, the pattern on a requirement's first segment."""
    first = F.col("ordinal") == F.min("ordinal").over(Window.partitionBy("req_id"))
    return segments.select("req_id", "segment_id", "segment", *[F.lit("").alias(f"c{k:02}") for k in range(3, 6)], F.when(first, F.col("pattern")).otherwise("").alias("pattern"), "ordinal")


def write_experiment(rows: DataFrame, path: str) -> None:
    """Rows of either form below its header, which for smells names fewer fields than the rows have; ordered by ordinal.

    Lines are built as text, since a CSV writer takes as many names as fields."""
    header = EXPERIMENT_PATTERN_HEADER if "pattern" in rows.columns else EXPERIMENT_HEADER
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    fields = [quoted(F.col(c).cast("string")) for c in rows.columns if c != "ordinal"]
    line = F.concat_ws(";", *fields)
    spark = rows.sparkSession
    head = spark.createDataFrame([(-1, ";".join(f'"{h}"' for h in header))], "ordinal bigint, value string")
    head.union(rows.select(F.col("ordinal").cast("bigint"), line.alias("value"))).orderBy("ordinal").select("value").write.mode("overwrite").text(path)


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    """Parse-tree lines split at the quoted separator: the id loses its quotes, the last field keeps its closing one."""
    f = F.split("value", '";"')
    lines = spark.read.text(path).where("value <> ''").withColumn("ordinal", F.monotonically_increasing_id())
    return lines.select(F.replace(f[0], F.lit('"'), F.lit("")).alias("req_id"), f[1].alias("req"), f[2].alias("tree"), f[3].alias("tokenized"), "ordinal")


def write_trees(df: DataFrame, path: str) -> None:
    df.select("req_id", preclean(F.col("req")).alias("req"), "tree", "tokenized").write.mode("overwrite").option("sep", ";").option("quoteAll", True).csv(path)


def read_examples(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """The worked examples of a JSON array, or its first ``n``; an error if it has fewer."""
    every = spark.read.schema(_strings(["id", "source_reqId", "nl", "rimay", "note"])).option("multiLine", True).json(path)
    if n is None:
        return every
    first = every.withColumn("k", F.monotonically_increasing_id()).orderBy("k").limit(n)
    if (found := first.count()) < n:
        raise ValueError(f"{n} examples are asked for, the file has {found}")
    return first.drop("k")


def exemplar_ids(examples: DataFrame) -> DataFrame:
    return examples.select(F.explode(F.array("id", "source_reqId")).alias("req_id")).where("req_id IS NOT NULL AND trim(req_id) <> ''").distinct()


def write_texts(df: DataFrame, path: str) -> None:
    """One text file per requirement, in a folder named by its safe id."""
    df.select(safe_id(F.col("req_id")).alias("id"), F.col("rimay").alias("value")).write.mode("overwrite").partitionBy("id").text(path)


def write_comparison(df: DataFrame, path: str) -> None:
    """Comparison rows as CSV: four decimals, booleans as 0 and 1, null as empty."""
    cells = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = decimals(c, 4)
        elif isinstance(f.dataType, T.BooleanType):
            c = c.cast("int")
        cells.append(F.coalesce(c.cast("string"), F.lit("")).alias(f.name))
    df.select(*cells).write.mode("overwrite").option("header", True).csv(path)


def non_atomic_rows(df: DataFrame) -> DataFrame:
    return df.withColumn("is_non_atomic", is_non_atomic(F.col("rimay")))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: What marks a section and a table of requirements, the text column, an empty cell, the extract's columns.
SECTIONS = ("functional requirements", "non-functional requirements", "transition requirements", "transition/cutover requirements")
ID_COLUMN, TEXT_COLUMN, EMPTY = "req. id", "description", "<blank>"
EXTRACT = ["Header", "Req ID", "Descr. After Regex", "Regex", " Descr. Before Regex", "List", "# Words", "Rationale"]


def _tables(content: bytes) -> list[tuple[str, bool, int, int, list[str], list[str], list[str]]]:
    """(heading, in a section of requirements, table, row, cells, the table's first row, list formats) of a word file's tables.

    A heading of requirements opens a section, the next heading of the first level that is none closes it."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    out, heading, inside, n = [], "", False, 0
    for e in body if body is not None else ():
        if e.tag == f"{_W}p":
            style = e.find(f"{_W}pPr/{_W}pStyle")
            name = "" if style is None else style.get(f"{_W}val", "").lower().replace(" ", "")
            if name.startswith("heading"):
                heading = text(e)
                inside = heading.lower().strip() in SECTIONS or inside and name != "heading1"
        elif e.tag == f"{_W}tbl":
            n, first = n + 1, []
            for k, r in enumerate(e.findall(f"{_W}tr")):
                cells, formats = [], []
                for c in r.findall(f"{_W}tc"):
                    lines = list(c.iter(f"{_W}p"))
                    listed = [p.find(f"{_W}pPr/{_W}numPr") is not None for p in lines]
                    cells.append("<lb>".join(("<bullet>" if mark else "") + text(p) for p, mark in zip(lines, listed, strict=True)))
                    formats.append("bullet" if any(listed) else "no")
                first = cells if k == 0 else first
                out.append((heading, inside, n, k, cells, first, formats))
    return out


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """path, header, inside, table, row, cells, columns, formats of the tables of word files."""

    def run(frames):
        for f in frames:
            rows = [(p, *r) for p, c in zip(f["path"], f["content"], strict=True) for r in _tables(bytes(c))]
            yield pd.DataFrame(rows, columns=["path", "header", "inside", "table", "row", "cells", "columns", "formats"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, header string, inside boolean, table int, row int, cells array<string>, columns array<string>, formats array<string>")


def docx_requirements(tables: DataFrame) -> DataFrame:
    """Rows of requirement tables in sections of requirements: header, req_id, after, changed, before, list, n_words, rationale.

    A requirement table has an id column in its first row; rows of empty cells alone are left out."""
    names = F.transform("columns", lambda c: F.lower(blank(c)))
    shown = F.transform("cells", lambda c: F.when(blank(c) == "", EMPTY).otherwise(c))
    rows = tables.where(F.col("inside") & (F.col("row") > 0) & F.exists("columns", lambda c: F.lower(c) == ID_COLUMN) & F.exists("cells", lambda c: blank(c) != ""))
    at = F.array_position(names, TEXT_COLUMN).cast("int") - 1
    rows = rows.withColumns({"shown": shown, "k": F.when(at >= 0, at).otherwise(1)}).withColumn("before", F.get("shown", F.col("k")))
    rows = rows.withColumn("c", clean_description(F.coalesce("before", F.lit(""))))
    words = F.when(F.trim("c.text") == "", 0).otherwise(F.size(F.split(F.trim("c.text"), " ")))
    return rows.select("header", F.trim(F.get("shown", F.lit(0))).alias("req_id"), F.col("c.text").alias("after"), F.col("c.changed").alias("changed"), "before", F.get("formats", F.col("k")).alias("list"), words.alias("n_words"), F.get("shown", F.col("k") + 1).alias("rationale"))


def write_extract(requirements: DataFrame, path: str) -> None:
    """The rows of :func:`docx_requirements` under the eight names of the extract."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in zip(("header", "req_id", "after", "changed", "before", "list", "n_words", "rationale"), EXTRACT, strict=True)]
    requirements.select(*cells).write.mode("overwrite").option("sep", ";").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
