"""Stored responses and the rolling audit log."""

import json
import os

from pyspark.sql import functions as F

from lodestone.operators import ingest
from lodestone.sources import shared, tables


def test_response_rules(spark):
    big = "é" * (5 << 20) + "x"
    rows = [
        (0, 200, "text/plain; charset=x", "a", ""), (1, 404, "text/plain", "gone", ""), (2, None, "text/plain", "?", None), (3, 204, "", None, ""), (4, 200, "application/JSON; q", '{"a":1}', ""), (5, 200, "text/x", "{bad", "json"),
        (6, 200, "TEXT/html ;x", "<p>hi <b>you</b></p>", ""), (7, 200, "text/plain", "<html><body><p>look</p></body></html>", "markdown"), (8, 200, "text/html", "<p>raw</p>", "html"), (9, 200, "text/html", "x", "pdf"),
        (10, 200, "text/plain", big, ""), (11, 200, "application/json", big, ""), (12, 299, ";x", "odd", "markdown"), (13, 300, "text/plain", "x", ""), (14, 200, "text/html", big, "html"),
    ]
    frame = spark.createDataFrame(rows, "k int, status int, content_type string, body string, format string").withColumn("url", F.lit("u"))
    got = {r["k"]: r for r in ingest.response_texts(frame).collect()}
    content = {0: "a", 3: "", 5: "{bad", 7: "look", 8: "<p>raw</p>", 10: "é" * (5 << 20), 12: "odd", 14: "é" * (5 << 20)}
    assert {k: got[k]["content"] for k in content} == content and json.loads(got[4]["content"]) == {"a": 1} and "\n" in got[4]["content"] and "**you**" in got[6]["content"]
    errors = {1: "HTTP 404", 2: "HTTP ?", 9: "unknown format: pdf", 11: "JSON was cut at the size limit", 13: "HTTP 300"}
    assert {k: r["error"] for k, r in got.items() if r["error"]} == errors and all(got[k]["content"] is None for k in errors)
    assert {k for k, r in got.items() if r["truncated"]} == {10, 11, 14}
    assert got[0]["content_type"] == "text/plain" and got[6]["content_type"] == "TEXT/html" and got[12]["content_type"] == ";x"


def test_rolling_log(spark, tmp_path):
    calls = spark.range(500).select(F.format_string("2024-01-01T%05d", 500 - F.col("id")).alias("timestamp"), F.col("id").alias("output_len"), F.repeat(F.lit("x"), (F.col("id") % 90).cast("int")).alias("tool"))
    folder = f"{tmp_path}/log"
    for _ in range(2):  # a batch that is written again
        tables.write_rolled(calls.repartition(5), folder, 0, ["timestamp"], 2000)
    tables.write_rolled(calls.limit(3), folder, 1, ["timestamp"], 2000)
    files = {}
    for top, _, names in os.walk(f"{folder}/batch=0"):
        for n in names:
            if n.startswith("part"):
                files[int(top.split("generation=")[1])] = (os.path.getsize(f"{top}/{n}"), open(f"{top}/{n}").read().splitlines())
    assert sorted(files) == list(range(len(files))) and len(files) > 10
    longest = max(len(line) + 1 for _, lines in files.values() for line in lines)
    assert all(2000 - longest < size <= 2000 + longest for g, (size, _) in files.items() if g < len(files) - 1)
    stamps = [json.loads(line)["timestamp"] for g in sorted(files) for line in files[g][1]]
    assert stamps == sorted(stamps) and len(stamps) == 500
    assert tables.read_audit(spark, folder).count() == 503
    assert tables.generations(calls.limit(0), ["timestamp"]).count() == 0


def test_a_cluster_must_name_a_shared_folder(spark):
    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getConf(self):
            return {}

    class Session:
        conf, sparkContext = {}, Context()

    try:
        shared.shared_folder(Session())
        raise AssertionError("no error")
    except RuntimeError as e:
        assert shared.CHECKPOINT_KEY in str(e)
    Session.sparkContext.master = "local[2]"
    assert os.path.isdir(shared.shared_folder(Session()))
