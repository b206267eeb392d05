"""Sources, sinks and streams on small inputs of our own."""

import subprocess

from pyspark.sql import functions as F

from tessera.operators import inherit, memory
from tessera.sources import exports, files, history, manifests
from tessera.streaming import events as streams


def test_manifests_of_each_kind():
    assert manifests.parse("a/requirements-dev.txt", "# x\nFoo_Bar[z]>=1.2 # y\n-r other.txt\n") == [("pip", "foo-bar", ">=1.2", "runtime")]
    assert manifests.parse("go.mod", "module m\nrequire (\n a/b v1.0 // indirect\n)\nrequire c/d v2\n") == [("go", "a/b", "v1.0", "indirect"), ("go", "c/d", "v2", "runtime")]
    assert manifests.parse("Cargo.toml", '[dependencies]\na = "1"\nb = {version = "2"}\n') == [("cargo", "a", "1", "runtime"), ("cargo", "b", "2", "runtime")]
    assert manifests.parse("pom.xml", "<project xmlns='u'><dependency><groupId>g</groupId><artifactId>a</artifactId></dependency></project>") == [("maven", "g:a", None, "runtime")]
    assert manifests.parse("pyproject.toml", '[project]\ndependencies = ["x>1"]\n') == [("pip", "x", ">1", "runtime")]
    assert manifests.parse("x.csproj", '<Project><PackageReference Include="N" Version="3"/></Project>') == [("nuget", "N", "3", "runtime")]
    assert manifests.parse("Gemfile", "gem 'rails', '~> 7'\n") == [("gem", "rails", "~> 7", "runtime")]
    assert manifests.parse("build.gradle", "testImplementation 'g:a:1'\n") == [("maven", "g:a", "1", "test")]
    assert manifests.parse("package.json", "{broken") == [] and manifests.parse("notes.txt", "x") == []


def test_history_reads_every_slice_once(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    git("init", "-q")
    for k in range(5):
        (tmp_path / "a b.txt").write_text("x\n" * (k + 1))
        (tmp_path / f"f{k}.bin").write_bytes(b"\0\1")
        git("add", "-A")
        git("commit", "-q", "-m", f"step {k}")
    history.register(spark)
    got = spark.read.format("git_history").option("path", str(tmp_path)).option("commits_per_partition", "2").load()
    assert got.count() == 10 and got.select("sha").distinct().count() == 5
    assert got.filter("path = 'a b.txt'").agg(F.sum("added")).first()[0] == 5 and got.filter("added is null").count() == 5


def test_state_is_kept_across_batches(spark, tmp_path):
    rows = [(1, 7, "2024-01-01 00:00:00", "fail"), (2, 7, "2024-01-01 00:01:00", "edit"), (3, 7, "2024-01-01 00:02:00", "pass"), (4, 7, "2024-01-01 00:03:00", "fail"), (5, 7, "2024-01-01 01:00:00", "pass"), (6, None, "2024-01-01 01:00:00", "pass"), (7, 8, "2024-01-01 00:00:00", "fail"), (8, 8, "2024-01-01 00:30:00", "pass"), (9, 8, "2024-01-01 00:10:00", "edit")]
    df = spark.createDataFrame(rows, "id long, scope long, ts string, kind string").withColumn("ts", F.col("ts").cast("timestamp"))
    for k in range(1, 10):  # a file a row, so that each micro-batch holds one event
        df.filter(F.col("id") == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = streams.drained(streams.fail_fix(streams.read(spark, str(tmp_path / "in/*.parquet"), 1), "fail", ("edit",), "pass"))
    assert {tuple(r) for r in got.collect()} == {(7, 1, 3, 1, "observation"), (8, 7, 8, 0, "flaky"), (8, None, 9, None, "late")}


def test_exports_are_whole_files(spark, tmp_path):
    nodes = spark.createDataFrame([(2, "T", 'a"b&c'), (1, "T", None)], "id long, node_type string, name string")
    edges = spark.createDataFrame([(1, 2, "X|Y")], "src long, dst long, edge_type string")
    for form in ("mermaid", "dot", "cypher", "json", "graphml"):
        exports.write_lines(exports.lines(nodes, edges, form), str(tmp_path / form))
    text = lambda form: "".join(p.read_text() for p in sorted((tmp_path / form).glob("part-*")))
    assert text("mermaid") == 'graph TD\n  v1(["T: "])\n  v2(["T: a#34;b#38;c"])\n  v1 -- "X#124;Y" --> v2\n'
    assert text("dot") == 'digraph {\n  1 [label="", class="T"]\n  2 [label="a\\"b&c", class="T"]\n  1 -> 2 [class="X|Y"]\n}\n'
    import xml.etree.ElementTree as ET

    assert [d.text for d in ET.fromstring(text("graphml").encode()).iter("{http://graphml.graphdrawing.org/xmlns}data")][2] == 'a"b&c'


def test_chase_ends_at_cycles_and_forks(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (5, 4), (6, 7), (6, 8)], "src long, dst long")
    assert {tuple(r) for r in inherit.chase(df).collect()} == {(1, 3, 2), (2, 3, 1)}


def test_renamed_anchors(spark):
    anchors = spark.createDataFrame([(1, "f", "old", 9, [1, 2, 3, 4]), (2, "f", "gone", 8, [50, 60])], "fact long, file string, name string, fp long, sketch array<long>")
    now = spark.createDataFrame([("f", "new", 5, [1, 2, 3, 7])], "file string, name string, fp long, sketch array<long>")
    assert {tuple(r) for r in memory.revalidate(anchors, now, 0.5).collect()} == {(1, "renamed"), (2, "orphaned")}


def test_walk_says_why(spark, tmp_path):
    for name, data in {"a.py": b"x = 1\n", "img.png": b"x", "node_modules/b.js": b"x", "blob": b"a\0b", "empty.txt": b"", "latin.txt": b"caf\xe9"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[-1]: (r["reason"], r["content"]) for r in files.walk(spark, str(tmp_path)).collect()}
    assert got == {"a.py": ("kept", "x = 1\n"), "img.png": ("binary", None), "b.js": ("dir_segment", None), "blob": ("binary", None), "latin.txt": ("kept", "caf\ufffd")}


def test_config_entries_of_each_kind():
    assert files.entries("a.json", '{"a": {"b": [1, null, true]}}') == [("a.b[0]", "1"), ("a.b[1]", None), ("a.b[2]", "true")]
    assert files.entries("a.properties", "# c=1\nx.y = 2=3\n\n") == [("x.y", "2=3")]
    assert files.entries(".editorconfig", "root = true\n[*.py]\nindent = 4\n") == [("root", "true"), ("*.py.indent", "4")]
    assert files.entries("a.json", "{") == [] and files.entries("a.bin", "x") == []


def test_coverage_and_json_lines(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"f.js": {"statementMap": {"0": {"start": {"line": 3}}, "1": {"start": {"line": 3}}}, "s": {"0": 0, "1": 5}}}')
    (tmp_path / "t.jsonl").write_text('{"a": 1}\nbroken\n')
    assert [tuple(r) for r in files.coverage(spark, str(tmp_path / "c.json")).collect()] == [("f.js", 3, 5)]
    assert [(r["a"], r["_broken"]) for r in files.json_lines(spark, str(tmp_path / "t.jsonl"), "a long").collect()] == [(1, None), (None, "broken")]


def test_session_windows_close_behind_the_watermark(spark, tmp_path):
    rows = [(1, 7, "2024-01-01 00:00:00"), (2, 7, "2024-01-01 00:20:00"), (3, 7, "2024-01-01 02:00:00"), (4, 8, "2024-01-02 00:00:00")]
    df = spark.createDataFrame(rows, "id long, scope long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    for k in range(1, 5):
        df.filter(F.col("id") == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = streams.drained(streams.session_counts(streams.read(spark, str(tmp_path / "in/*.parquet"), 1))).collect()
    assert sorted((r["scope"], r["n"]) for r in got) == [(7, 1), (7, 2)]  # the last session is still open
