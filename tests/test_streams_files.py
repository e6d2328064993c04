"""Streams, files, text functions, and the entry module."""

import importlib.util
import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.sources import files as S
from loomgraph.streaming import watch

HOME = Path(__file__).resolve().parents[1]


def test_a_stream_gives_the_bursts_of_a_table(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("path"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), F.col("event_type").alias("event"))
    e.coalesce(1).write.json(str(tmp_path / "in"))
    stream = watch.source(spark, str(tmp_path / "in"))
    q = watch.bursts(stream, "2 hours").writeStream.format("memory").queryName("bursts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    table = watch.bursts(e.withColumn("ts", F.col("ts").cast("timestamp")), "2 hours")
    key = lambda df: sorted((r["path"], r["start"], r["end"], r["events"]) for r in df.collect())
    assert key(spark.table("bursts")) == key(table)


def test_micro_batches_are_scoped_or_full(spark, tmp_path):
    rows = [("a", "2024-01-01T00:00:00", "change"), ("a", "2024-01-01T00:00:01", "delete"), ("b", "2024-01-01T00:00:00", "change")]
    spark.createDataFrame(rows, "path string, ts string, event string").coalesce(1).write.json(str(tmp_path / "in"))
    seen = []
    for name, most in (("x", 500), ("y", 1)):
        q = watch.run(watch.source(spark, str(tmp_path / "in")), lambda p: seen.append({r["path"]: r["event"] for r in p.collect()}), lambda: seen.append("full"), str(tmp_path / name), most)
        q.awaitTermination(120)
    assert seen == [{"a": "delete", "b": "change"}, "full"]


def test_pending_paths_leave_when_their_burst_is_over(spark, tmp_path):
    rows = [[("a", "2024-01-01T00:00:00"), ("a", "2024-01-01T00:00:01")], [("b", "2024-01-01T01:00:00")], [("c", "2024-01-01T03:00:00")]]
    folder = tmp_path / "in"
    folder.mkdir()
    for i, part in enumerate(rows):
        (folder / f"{i}.json").write_text("\n".join(json.dumps({"path": p, "ts": t, "event": "x"}) for p, t in part))
        os.utime(folder / f"{i}.json", (10**9 + i, 10**9 + i))  # files come in order of their time
    stream = spark.readStream.schema("path string, ts timestamp, event string").option("maxFilesPerTrigger", 1).json(str(folder))
    q = watch.pending_state(stream).writeStream.format("memory").queryName("state").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(180)
    got = {r["path"]: r["events"] for r in spark.table("state").collect()}
    assert got.get("a") == 2 and "c" not in got


def test_pauses():
    assert [watch.backoff_ms(2000, n) for n in (1, 2, 5, 9)] == [2000, 4000, 30000, 30000]


def test_scan_and_extract(spark, tmp_path):
    for path, text in {"a/m.py": "class A:\n  def run(self):\n    helper()\n", "b/x.ts": "app.get('/home', index)", "node_modules/z.js": "function no() {}", "c/n.txt": "no"}.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(text)
    got = S.scan(spark, str(tmp_path))
    assert {(r["path"], r["language"]) for r in got.collect()} == {("a/m.py", "python"), ("b/x.ts", "typescript")}
    rows = {(r["rule"], r["what"], r["kind"], r["name"], r["line"]) for r in S.extract(got).collect()}
    assert {("definitions", "node", "class", "A", 1), ("definitions", "node", "function", "run", 2), ("definitions", "reference", "calls", "helper", 3), ("routes", "node", "route", "/home", 1), ("routes", "reference", "references", "index", 1)} <= rows
    assert S.nodes_of(S.extract(got)).count() == 3
    assert S.records(got).filter("indexed_at is not null").count() == 2


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "got, want",
    [
        (lambda: X.normal_path(F.lit("a/./b/../../c/d.ts")), "c/d.ts"), (lambda: X.normal_path(F.lit("../x")), "../x"), (lambda: X.pascal(F.lit("my-fancy-tag")), "MyFancyTag"), (lambda: X.last_two(F.lit("a::b::c")), "b::c"),
        (lambda: X.last_two(F.lit("c")), "c"), (lambda: X.last_qualifier(F.lit("a.b/c")), "c"), (lambda: X.dirname(F.lit("x.ts")), "."), (lambda: X.camel_split(F.lit("getHTTPServer")), "get HTTP Server"), (lambda: X.truncated_at_line(F.lit("ab\ncd\nef"), 7), "ab\ncd"),
        (lambda: X.truncated(F.lit("abcdef"), 3), "abc…"), (lambda: X.proximity(F.lit("a/b/c/x"), F.lit("a/b/d/y")), 30), (lambda: X.proximity(F.lit("x"), F.lit("y")), 0), (lambda: X.json_list(F.lit("[1")), None), (lambda: X.language_of(F.lit("a.h"), F.lit("class X {")), "cpp"),
        (lambda: X.language_of(F.lit("a.h"), F.lit("@interface X")), "objc"), (lambda: X.language_of(F.lit("a.h"), F.lit("int x;")), "c"), (lambda: X.path_globs(F.lit("A/B.ts"), ("*.TS",), ("b/**",)), True), (lambda: X.is_test(F.lit("src/latest.kt")), False),
    ],
)
def test_functions(spark, got, want):
    assert one(spark, got()) == want


def test_globs():
    import re

    assert re.search(X.glob_regex("src/**/*.{ts,js}"), "src/a/b/c.js") and not re.search(X.glob_regex("src/*.ts"), "src/a/b.ts")
    assert re.search(X.glob_regex("b*c", anchored=False), "a/bxxc/d") and re.search(X.wildcard_regex("A::*?"), "A::bc")


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_the_rest_works_without_the_optional_part(tmp_path):
    home = tmp_path / "repo"
    shutil.copytree(HOME, home, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(n.startswith('op') for n in q) and len(q) > 100; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=home, check=True, env={"PATH": "/usr/bin:/bin"})
    assert importlib.util.find_spec("loomgraph") is not None
