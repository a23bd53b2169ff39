import io
import json
import zipfile

from pyspark.sql import functions as F

from specloom.operators import smells
from specloom.plans import report
from specloom.sources import records as R
from specloom.streaming import scores


def test_gold(spark, tmp_path):
    p = tmp_path / "gold.csv"
    p.write_text('reqId,order,nlText,gold_actor,gold_overallIncomplete,annotatorUsername,rimayText,slot_actor\nb,2.0,"x, y", Missing ,TRUE,u1,first,present\nb,9,z,present,false,u2,,\na,n/a,t,,,u1,r,\n')
    g = {r.req_id: r for r in R.gold_requirements(R.read_annotations(spark, str(p))).collect()}
    assert g["b"].gold_actor == "missing" and g["b"].gold_incomplete and g["b"].order == 2 and g["b"].nl_text == "x, y"
    assert [a.rimay for a in g["b"].annotations] == ["first", ""] and g["a"].order == 0 and g["a"].gold_scope == ""


def test_manifest_last_record_wins(spark, tmp_path):
    p = tmp_path / "m.jsonl"
    rec = {"reqId": "a", "rimay": "one", "llm_slots": {"actor": "missing"}, "tool_passed": None}
    p.write_text(json.dumps(rec) + "\n\n" + json.dumps(rec | {"rimay": "two", "tool_smells": [{"segment_id": "1", "smell": "s", "value": "v"}]}) + "\n")
    (r,) = R.read_manifest(spark, str(p)).collect()
    assert r.rimay == "two" and r.check_passed is None and r.llm_slots.actor == "missing" and r.check_smells[0].smell == "s"
    R.write_manifest(R.read_manifest(spark, str(p)), str(tmp_path / "out"))
    assert R.read_manifest(spark, str(tmp_path / "out")).count() == 1


def test_smell_report_keeps_the_unnamed_field(spark, tmp_path):
    p = tmp_path / "s.csv"
    head = ["Req ID", "Segment ID", "Req Segment", *smells.SMELLS, "Pattern "]
    rows = [["r1", "r1_1", "When x", "m", "", "", "", "", " ", "", "", "", "5. S", 'The? "T"'], ["r1", "r1_2", "y", "", "", "", "", "", "", "", "p", "", "", ""], ["", "", "", *[""] * 11]]
    q = lambda v: '"' + v.replace('"', '""') + '"'
    p.write_text("\n".join(";".join(map(q, r)) for r in [head, *rows]) + "\n")
    df = R.read_smell_report(spark, str(p))
    assert df.count() == 2 and df.orderBy("ordinal").first().template == 'The? "T"'
    assert smells.fired(df).count() == 2
    R.write_smell_report(df, str(tmp_path / "out"))
    assert R.read_smell_report(spark, str(tmp_path / "out")).count() == 2


def test_trees_keep_the_last_quote(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text('"r1";"a b";"(S (NN a))";"a b"\n')
    r = R.read_trees(spark, str(p)).first()
    assert (r.req_id, r.req, r.tree, r.tokenized) == ("r1", "a b", "(S (NN a))", 'a b"')


def test_examples(spark, tmp_path):
    p = tmp_path / "e.json"
    p.write_text(json.dumps([{"id": "e1", "source_reqId": "r1"}, {"id": "e2", "source_reqId": " "}]))
    assert {r.req_id for r in R.exemplar_ids(R.read_examples(spark, str(p))).collect()} == {"e1", "e2", "r1"}


def test_comparison_sink(spark, tmp_path):
    df = spark.createDataFrame([("a", True, 0.5, None)], "id string, ok boolean, v double, p boolean")
    R.write_comparison(df, str(tmp_path / "c"))
    assert spark.read.text(str(tmp_path / "c")).where(F.col("value").startswith("a")).first().value in ("a,1,0.5000,", 'a,1,0.5000,""')


def test_runs_are_named_by_folder(spark, tmp_path):
    for s in ("x", "y"):
        d = tmp_path / "run1" / s / "scoring"
        d.mkdir(parents=True)
        (d / "results.json").write_text(json.dumps({"run": "other", "counts": {"evaluated": 1}, "requirements": [{"reqId": "</script>"}]}))
    runs = R.discover_runs(spark, str(tmp_path))
    assert [r.run for r in runs.collect()] == ["run1/x", "run1/y"]
    page = report.page(runs.select("run"), report.requirements(runs))
    assert "<\\/script>" in page and page.count("</script>") == 1


def test_docx(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    cell = lambda *t: "<w:tc>" + "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in t) + "</w:tc>"
    body = f'<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Functional requirements</w:t></w:r></w:p><w:tbl><w:tr>{cell("Req. ID")}{cell("Description")}</w:tr><w:tr>{cell("R1")}{cell("The app", "must act")}</w:tr></w:tbl>'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    (tmp_path / "a.docx").write_bytes(buf.getvalue())
    (r,) = R.docx_requirements(R.read_docx(spark, str(tmp_path))).collect()
    assert r.req_id == "R1" and r.after == r.before == "The app<lb>must act" and r.header == "Functional requirements" and (r.changed, r.list, r.n_words, r.rationale) == (False, "no", 3, None)


def test_streamed_confusion(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text(json.dumps({"reqId": "a", "llm_slots": {"actor": "missing", "scope": "filled"}}) + "\n")
    gold = spark.createDataFrame([("a", "actor", "missing"), ("a", "scope", "missing")], "req_id string, slot string, gold string")
    q = scores.running_confusion(scores.stream_manifest(spark, str(src)), gold).writeStream.outputMode("complete").format("memory").queryName("conf").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.slot: (r.tp, r.fn) for r in spark.table("conf").collect()} == {"actor": (1, 0), "scope": (0, 1)}
