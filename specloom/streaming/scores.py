"""Running scores over a stream of conversion records."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.functions.text import SLOTS, is_missing
from specloom.sources.records import manifest_schema


def stream_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Records as their files arrive in a folder."""
    return spark.readStream.schema(manifest_schema()).json(folder)


def unpivot(records: DataFrame) -> DataFrame:
    """req_id, slot, llm: a row for each slot of a record."""
    cells = F.array(*[F.struct(F.lit(s).alias("slot"), F.col(f"llm_slots.{s}").alias("llm")) for s in SLOTS])
    return records.select(F.col("reqId").alias("req_id"), F.explode(cells).alias("c")).select("req_id", "c.slot", "c.llm")


def running_confusion(records: DataFrame, gold: DataFrame) -> DataFrame:
    """tp, fp, fn, tn per slot so far; ``gold`` (req_id, slot, gold) is a static table joined to each batch. Every record counts:
    where records may come again or be superseded, see :func:`confusion_changes`."""
    j = unpivot(records).join(gold, ["req_id", "slot"])
    g, p = is_missing(F.col("gold")), is_missing(F.col("llm"))
    return j.groupBy("slot").agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn"))


#: What one record says: its place in the order of records, and each slot's cell.
_STATE = "place bigint, " + ", ".join(f"{s} string" for s in SLOTS)


def placed(spark: SparkSession, folder: str) -> DataFrame:
    """Records as their files arrive, with place, their order: a record of a later file supersedes one of the same requirement."""
    files = spark.readStream.schema(manifest_schema()).option("maxFilesPerTrigger", 100).json(folder)
    return files.withColumn("place", F.unix_micros("_metadata.file_modification_time"))


def _supersede(key, frames, state):
    """The slots of a requirement's last record (sign 1) and of the one that it takes the place of (sign -1)."""
    old = tuple(state.get) if state.exists else None
    best = old
    for f in frames:
        # of one place the greatest cells, so that the choice depends on the records alone
        for row in f[["place", *SLOTS]].astype(object).where(f[["place", *SLOTS]].notna(), None).itertuples(index=False):
            new = (int(row[0]), *row[1:])
            if best is None or (new[0], [x or "" for x in new[1:]]) >= (best[0], [x or "" for x in best[1:]]):
                best = new
    if best is None or best == old:
        return
    state.update(best)
    rows = [(key[0], s, v, 1) for s, v in zip(SLOTS, best[1:], strict=True)]
    if old is not None:
        rows += [(key[0], s, v, -1) for s, v in zip(SLOTS, old[1:], strict=True)]
    yield pd.DataFrame(rows, columns=["req_id", "slot", "llm", "sign"])


def latest_changes(records: DataFrame) -> DataFrame:
    """req_id, slot, llm, sign of a stream of records with place: what each record changes. One state row per requirement.

    A record sent again changes nothing, one that comes late (of a smaller place) neither; records without reqId are left out."""
    cells = records.where("reqId IS NOT NULL").select(F.col("reqId").alias("req_id"), "place", *[F.col(f"llm_slots.{s}").alias(s) for s in SLOTS])
    return cells.groupBy("req_id").applyInPandasWithState(_supersede, "req_id string, slot string, llm string, sign int", _STATE, "append", "NoTimeout")


def confusion_changes(records: DataFrame, gold: DataFrame) -> DataFrame:
    """slot, tp, fp, fn, tn: what each record adds to the counts and, where it takes the place of one, subtracts."""
    j = latest_changes(records).join(gold, ["req_id", "slot"])
    g, p = is_missing(F.col("gold")), is_missing(F.col("llm"))
    cell = lambda hit: F.when(hit, F.col("sign")).otherwise(0)
    return j.select("slot", cell(g & p).alias("tp"), cell(~g & p).alias("fp"), cell(g & ~p).alias("fn"), cell(~g & ~p).alias("tn"))


def totals(changes: DataFrame) -> DataFrame:
    """tp, fp, fn, tn per slot of all changes written so far."""
    return changes.groupBy("slot").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])
