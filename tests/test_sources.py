import json
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from ashlar import plugins
from ashlar.operators.graph import Graph
from ashlar.sources.store import GraphStore
from ashlar.sources import readers as r
from ashlar.sources import writers as w
from ashlar.streaming import updates as up


def test_tree(spark, tmp_path):
    for name, text in {"a/b.py": "x", "a/.hidden/c.py": "x", "venv/d.py": "x", "tool": "#!/bin/bash\n", "e.go": "package e", "skip/f.py": "x", "logs/g.log": "x"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    files = r.read_tree(spark, str(tmp_path), ["skip/*"], "*.log\n# note\n/logs\n").cache()
    assert {x.path for x in files.collect()} >= {"a/b.py", "tool", "e.go"}
    assert not files.where("path LIKE 'skip%' OR path LIKE 'logs%'").count()
    assert [x.path for x in r.sources(files, "python").collect()] == ["a/b.py"]
    assert [x.path for x in r.sources(files, "shell").collect()] == ["tool"]
    assert {x.language for x in r.languages(files).collect()} == {"python", "go"}


def test_coverage(spark, tmp_path):
    (tmp_path / "c.xml").write_text('<?xml version="1.0"?><coverage><packages><package><classes><class filename="src/main.py" line-rate="1.0"/><class filename="src/utils.py" line-rate="0.0"/></classes></package></packages></coverage>')
    (tmp_path / "j.xml").write_text('<report name="x"><package name="com/a"><sourcefile name="B.java"><counter type="BRANCH" missed="9" covered="0"/><counter type="LINE" missed="5" covered="5"/></sourcefile></package></report>')
    (tmp_path / "go.out").write_text("mode: set\nx/a.go:1.1,2.2 2 1\nx/b.go:1.1,2.2 10 0\n")
    rates = lambda name: {x.path: x.rate for x in r.coverage(spark, str(tmp_path / name)).collect()}
    assert rates("c.xml") == {"src/main.py": 1.0, "src/utils.py": 0.0}
    assert rates("j.xml") == {"com/a/B.java": 0.5}
    assert rates("go.out") == {"x/a.go": 1.0, "x/b.go": 0.0}


def test_git_log(spark, tmp_path):
    (tmp_path / "log").write_text("c1\t1700000000\ta@x\na.py\nb.py\n\nc2\t1700000100\tb@x\na.py\n")
    found = {(x.path, x.author) for x in r.read_git_log(spark, str(tmp_path / "log")).collect()}
    assert found == {("a.py", "a@x"), ("b.py", "a@x"), ("a.py", "b@x")}


def test_snapshot(spark, tmp_path):
    document = {"metadata": {"version": "v1", "project_name": "p"}, "files": [{"path": "a.py", "risk": {"risk_score": 0.9, "level": "high"}, "issues": [{"rule_id": "r", "severity": "error", "location": {"line": 50}}]}, {"path": "b.py", "risk": {"risk_score": 0.2, "level": "low"}, "issues": [{"id": "own", "rule_id": "r", "severity": "warning"}]}], "dependencies": {"edges": [{"src": "a.py", "dst": "b.py"}]}}
    (tmp_path / "s.json").write_text(json.dumps(document))
    tables = r.snapshot_tables(r.read_snapshot(spark, str(tmp_path / "s.json")))
    assert {(x.path, x.id) for x in tables["issues"].collect()} == {("a.py", "r:a.py:50"), ("b.py", "own")}
    assert tables["deps"].count() == 1 and tables["files"].count() == 2
    yaml = pytest.importorskip("yaml")
    (tmp_path / "s.yaml").write_text(yaml.safe_dump(document))
    assert r.snapshot_tables(r.read_snapshot(spark, str(tmp_path / "s.yaml")))["files"].count() == 2


def test_versions_and_graph_store(spark, tmp_path):
    files = spark.createDataFrame([("a.py", 0.5)], "path string, score double")
    root = str(tmp_path / "v")
    assert [w.write_version(files, root, "p"), w.write_version(files, root, "p"), w.write_version(files, root, "q")] == ["v1", "v2", "v1"]
    assert r.read_version(spark, root, "v2").count() == 1 and r.read_version(spark, root, "v9").count() == 0
    graph = Graph(spark.createDataFrame([("a", "file"), ("b", "function")], "id string, type string"), spark.createDataFrame([("a", "b", "contains")], "source string, target string, type string"))
    store = str(tmp_path / "g")
    w.save_graph(graph, store)
    more = Graph(spark.createDataFrame([("c", "function")], "id string, type string"), spark.createDataFrame([("b", "c", "calls"), ("b", "nowhere", "calls")], "source string, target string, type string"))
    after = w.upsert(spark, store, 0, more)
    assert (after.nodes.count(), after.edges.count(), up.newest(spark, store)) == (3, 2, 1)


def test_history_and_documents(spark, tmp_path):
    files = spark.createDataFrame([("a.py", "python", 0.999, "high", 1, 1, 0, 0)], "path string, language string, score double, level string, total long, errors long, warnings long, ord int")
    issues = spark.createDataFrame([("a.py", "r<1>", "error", 1)], "path string, rule_id string, severity string, ord int")
    w.write_history(str(tmp_path / "h"), "p", "s1", "2024-01-01", files, issues)
    assert spark.read.parquet(str(tmp_path / "h/snapshots")).first().risk_score == 99
    assert 'failures="1"' in w.junit_xml(issues) and "r&lt;1&gt;" in w.junit_xml(issues)
    from ashlar.operators.report import project_report

    report = project_report(files, issues)
    assert json.loads(w.report_json(report, files))["project_summary"]["high_risk_files"] == 1
    assert "| a.py | 1.00 | high | 1 |" in w.report_markdown(report, files)
    with pytest.raises(Exception):
        w.write_json(files, str(tmp_path / "x"), "path int, gone string")


def test_config():
    merged = r.merged({"a": {"b": 1, "c": [1, 2]}}, {"a": {"c": [3]}}, None)
    assert merged == {"a": {"b": 1, "c": [3]}}
    assert r.get_dotted(r.set_dotted(merged, "a.d.e", 5), "a.d.e") == 5 and r.get_dotted(merged, "a.x", 7) == 7


def test_stream(spark, tmp_path):
    node, edge = "id string, type string, name string", "source string, target string, type string"
    graph = Graph(spark.createDataFrame([("file:a.py", "file", "a.py"), ("function:a.py:f", "function", "f"), ("file:b.py", "file", "b.py"), ("function:b.py:g", "function", "g")], node), spark.createDataFrame([("file:a.py", "function:a.py:f", "contains"), ("file:b.py", "function:b.py:g", "contains")], edge))
    store, events = str(tmp_path / "g"), tmp_path / "e"
    GraphStore(spark, store).save(graph)
    events.mkdir()
    rows = [("a.py", "modify", "2024-01-01T00:00:00"), ("a.py", "modify", "2024-01-01T00:00:00.500"), ("b.py", "create", "2024-01-01T00:00:00"), ("b.py", "delete", "2024-01-01T00:00:00.200"), ("z.txt", "modify", "2024-01-01T01:00:00"), ("late.py", "modify", "2024-01-01T02:00:00")]
    (events / "1.json").write_text("\n".join(json.dumps(dict(zip(("path", "change_type", "ts"), row))) for row in rows))

    def build(paths):
        own = paths.where("path = 'a.py'")
        nodes = own.select(F.explode(F.array(F.struct(F.lit("file:a.py").alias("id"), F.lit("file").alias("type"), F.lit("a.py").alias("name")), F.struct(F.lit("function:a.py:h").alias("id"), F.lit("function").alias("type"), F.lit("h").alias("name")))).alias("n")).select("n.*")
        return Graph(nodes, own.select(F.lit("file:a.py").alias("source"), F.lit("function:a.py:h").alias("target"), F.lit("contains").alias("type")))

    query = up.maintain(up.read_events(spark, str(events)), store, build, str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    found = GraphStore(spark, store).graph
    assert {x.id for x in found.nodes.collect()} == {"file:a.py", "function:a.py:h"}
    assert {x.target for x in found.edges.collect()} == {"function:a.py:h"}


def test_plugins(spark, tmp_path):
    (tmp_path / "good.py").write_text("def register(registry):\n    registry.rule('x', lambda path, content, context: [('high', 1, 'm')] if 'x' in content else [])\n")
    (tmp_path / "bad.py").write_text("raise ValueError('no')\n")
    registry = plugins.Registry().load(str(tmp_path))
    assert list(registry.errors) == ["bad"]
    found = plugins.run_rules(spark.createDataFrame([("a", "x"), ("b", None)], "path string, content string"), registry).collect()
    assert [(x.path, x.rule_id, x.severity) for x in found] == [("a", "x", "error")]


def test_without_the_llm_folders(tmp_path):
    """The entry point imports, with the other queries, where the training-data operators are gone."""
    import os
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/ashlar", tmp_path / "ashlar", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'phase0_find' in e.queries() and not any(q.startswith('op') or q == 'pipeline' for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
