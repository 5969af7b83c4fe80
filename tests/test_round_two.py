"""Real token counts, negated ignore lines, sniffed reports, suffix matches, budgets that stream, exports of a stream."""

import random

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ashlar import catalog
from ashlar.functions.tokens import token_count
from ashlar.operators import dependencies, tasks
from ashlar.sources import readers, writers
from tests.oracle import DATA

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_token_count(spark):
    plain, said = Tokenizer.from_file(PATH), ["", "two words", "é ü", "x" * 5000, None]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, text string")
    found = dict(rows.select("i", token_count(PATH)("text")).collect())
    assert found == {i: len(plain.encode(s or "", add_special_tokens=False).ids) for i, s in enumerate(said)}


def test_token_window(spark):
    plain, turns = Tokenizer.from_file(PATH), {}
    for r in spark.read.parquet(f"{DATA}/conversations.parquet").where("text IS NOT NULL").orderBy("conv_id", "turn").collect():
        turns.setdefault(f"c{r.conv_id}", []).append((r.turn, r.text))
    wanted = set()
    for project, own in turns.items():
        left = 300
        for turn, text in own:
            cost = len(plain.encode(text, add_special_tokens=False).ids)
            if left >= 0 and cost <= left:
                wanted.add((project, turn, text, True))
            elif left > 50:
                wanted.add((project, turn, text[: left * 3], False))
            left -= cost
    assert {tuple(r) for r in catalog.QUERIES["r15_token_window"](spark, DATA).collect()} == wanted


def test_ignore_lines(spark):
    paths = ["a.log", "keep.log", "build/x.py", "src/build/y.py", "src/a.py"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    kept = [r.path for r in rows.where(~readers.ignored(F.col("path"), "# logs\n*.log\n!keep.log\n/build\n")).collect()]
    assert kept == ["keep.log", "src/build/y.py", "src/a.py"]


def test_sniffed_after_a_long_comment(spark, tmp_path):
    counter = '<counter type="LINE" missed="1" covered="3"/>'
    text = '<?xml version="1.0"?>\n' + "<!-- licence -->\n" * 50 + f'<report name="r"><package name="p/q"><sourcefile name="Own.java">{counter}</sourcefile></package></report>'
    (tmp_path / "report.xml").write_text(text)
    assert readers.coverage(spark, str(tmp_path / "report.xml")).columns == readers.jacoco(spark, str(tmp_path / "report.xml")).columns
    (tmp_path / "cover.out").write_text("mode: set\nx/y.go:1.1,2.2 3 1\n")
    assert readers.coverage(spark, str(tmp_path / "cover.out")).first().rate == 1.0


def test_imports_of_a_shared_name(spark):
    files = spark.createDataFrame([(f"p{i}/sub/__init__.py",) for i in range(300)] + [("p7/sub/one.py",)], "path string")
    imports = spark.createDataFrame([("main.py", f"p{i}.sub.__init__") for i in range(300)] + [("main.py", "sub.one"), ("main.py", "ub.one")], "file string, path string")
    symbols = spark.createDataFrame([], "file string, name string, type string, scope string, is_exported boolean")
    found = {r.path: r.defined_in for r in dependencies.resolve_imports(imports, files, symbols).collect()}
    assert found == {**{f"p{i}.sub.__init__": f"p{i}/sub/__init__.py" for i in range(300)}, "sub.one": "p7/sub/one.py"}


def test_budget_streams(spark):
    rng = random.Random(2)
    rows = [(f"p{i % 3}", f"f{i}", rng.choice([0.1, 0.5, 0.9]), i, rng.randint(1, 9), rng.randint(10, 60), rng.randint(60, 300)) for i in range(300)]
    files = spark.createDataFrame(rows, "project string, path string, score double, ord int, signature_cost int, skeleton_cost int, full_cost int")
    found = {r.path: r.strategy for r in tasks.budget_allocation(files, 4000).collect()}
    for project in ("p0", "p1", "p2"):
        own = sorted((r for r in rows if r[0] == project), key=lambda r: (-r[2], r[3]))
        left, chosen = 4000 - sum(r[4] for r in own), dict.fromkeys((r[1] for r in own), "signature")
        for before, better, at in (("signature", "skeleton", 5), ("skeleton", "full", 6)):
            for r in own:
                if chosen[r[1]] == before and r[at] - r[at - 1] <= left:
                    chosen[r[1]], left = better, left - (r[at] - r[at - 1])
        assert {p: s for p, s in found.items() if p in chosen} == chosen


def test_export_of_a_stream(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([(i, "warn" if i % 2 else "block") for i in range(10)], "id long, kind string")
    rows.write.json(source)
    for _ in range(2):  # a second run finds nothing new
        writers.stream_export(spark.readStream.schema(rows.schema).json(source), out, "kind", str(tmp_path / "state")).awaitTermination()
    assert sorted(map(tuple, spark.read.schema(rows.schema).json(out).collect())) == sorted(map(tuple, rows.collect()))
