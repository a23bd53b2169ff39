"""Running counts over a stream in which records come again, are superseded, and come late."""

import json
import os
import random

from specloom.functions.text import SLOTS
from specloom.streaming import scores


def plain(latest, gold):
    out = {}
    for (r, s), g in gold.items():
        if r in latest:
            hit, said = g == "missing", latest[r].get(s) == "missing"
            cell = ("tp" if said else "fn") if hit else ("fp" if said else "tn")
            out.setdefault(s, dict.fromkeys(("tp", "fp", "fn", "tn"), 0))[cell] += 1
    return out


def test_counts_follow_the_last_record_of_each_requirement(spark, tmp_path):
    r = random.Random(4)
    src, out, check = tmp_path / "in", tmp_path / "out", tmp_path / "check"
    src.mkdir()
    gold = {(f"r{k}", s): r.choice(["missing", "present", "implied"]) for k in range(8) for s in SLOTS}
    table = spark.createDataFrame([(*k, v) for k, v in gold.items()], "req_id string, slot string, gold string")
    latest, places = {}, {}
    # each batch: the place of its file and its records; the third repeats the first, the fourth is older than all
    batches = [(200, ["r0", "r1", "r2"]), (300, ["r1", "r3", "none"]), (400, None), (100, ["r0", "r4"]), (500, ["r0", "r1", "r2", "r3", "r4", "r5"])]
    first = None
    for n, (place, names) in enumerate(batches):
        records = {x: {s: r.choice(["missing", "filled", None]) for s in SLOTS} for x in names} if names else first
        first = first or records
        f = src / f"{n}.json"
        f.write_text("".join(json.dumps({"reqId": x, "llm_slots": v}) + "\n" for x, v in records.items()) + json.dumps({"reqId": None, "llm_slots": {}}) + "\n")
        os.utime(f, (place, place))
        for x, v in records.items():
            if place >= places.get(x, 0):
                latest[x], places[x] = v, place
        q = scores.confusion_changes(scores.placed(spark, str(src)), table).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(check)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        got = {x.slot: {c: x[c] for c in ("tp", "fp", "fn", "tn")} for x in scores.totals(spark.read.parquet(str(out))).collect()}
        assert got == plain(latest, gold), n
