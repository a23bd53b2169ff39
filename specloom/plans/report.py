"""Overview of runs and the static page that shows it."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.sources.records import write_text

_PAGE = """<!doctype html><meta charset="utf-8"><title>Runs</title><h1>Runs</h1><table id="runs"></table><div id="each"></div><script>
const data = %s;
const cell = v => "<td>" + (v === null || v === undefined ? "" : String(v).replace(/&/g, "&amp;").replace(/</g, "&lt;")) + "</td>";
const table = rows => { const cols = rows.length ? Object.keys(rows[0]) : [];
  return "<tr>" + cols.map(c => "<th>" + c + "</th>").join("") + "</tr>" + rows.map(r => "<tr>" + cols.map(c => cell(r[c])).join("") + "</tr>").join(""); };
document.getElementById("runs").innerHTML = table(data.runs);
const runs = [...new Set(data.requirements.map(r => r.run))];
document.getElementById("each").innerHTML = runs.map(n => "<h2>" + n + "</h2><table>" + table(data.requirements.filter(r => r.run === n)) + "</table>").join("");
</script>"""


def overview(results: DataFrame, checker: str = "tool") -> DataFrame:
    """One row per run with its main figures; ``checker`` is the smell checker's name in the files."""
    cq, fa = F.col("conversion_quality"), F.col("field_accuracy")
    sim = cq["similarity"]
    return results.select(
        "run", F.col("counts.evaluated").alias("evaluated"), fa["macro"]["f1"].alias("macro_f1"), fa["overall_verdict"]["agreement_rate"].alias("agreement"),
        sim["llm_vs_human"]["seq_ratio"]["mean"].alias("seq_ratio"), sim["llm_vs_human"]["jaccard"]["mean"].alias("jaccard"), sim["human_human"]["seq_ratio"]["mean"].alias("ceiling"), cq[checker]["pass_rate"].alias("pass_rate"),
    )


def requirements(results: DataFrame) -> DataFrame:
    """One row per run and requirement, for drilling down."""
    return results.select("run", F.explode("requirements").alias("r")).select("run", "r.*")


def batches(results: DataFrame) -> DataFrame:
    """The distinct folders that runs stand in."""
    return results.select(F.regexp_extract("run", "^([^/]+)", 1).alias("batch")).distinct()


def page(runs: DataFrame, each: DataFrame | None = None) -> str:
    """The page: a row for every run, and below it the runs' requirements if they are given. Rows come one by one."""
    lines = lambda df: [] if df is None else [json.loads(x) for x in df.toJSON().toLocalIterator()]
    return _PAGE % json.dumps({"runs": lines(runs), "requirements": lines(each)}, ensure_ascii=False).replace("</", "<\\/")


def write_page(html: str, spark: SparkSession, path: str) -> None:
    write_text(spark, path, html)
