import json

from pyspark.sql import functions as F

from graphloom import schemas
from graphloom.functions import text as T
from graphloom.graph import Graph
from graphloom.operators import prune
from graphloom.sources import files
from graphloom.streaming import incremental

GRAPH = {
    "graph": {"root": "r"},
    "nodes": [{"id": "r", "title": "Root", "pages": []}, {"id": "a", "title": "A", "pages": [{"id": "1", "title": "t", "abstract": "x"}]}, {"id": "b", "title": "B", "pages": []}],
    "links": [{"source": "r", "target": "a"}, {"source": "a", "target": "b", "weight": 2}],
}


def test_graph_files(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps(GRAPH))
    g = files.read_graph(spark, f"{tmp_path}/g.json")
    assert g.root == "r" and {(r["src"], r["dst"], r["weight"]) for r in g.edges.collect()} == {("r", "a", 1.0), ("a", "b", 2.0)}
    assert files.read_graph(spark, f"{tmp_path}/g.json", 1).edges.count() == 1
    assert files.read_graphs(spark, [f"{tmp_path}/g.json"] * 2).count() == 2
    files.write_graph(g, f"{tmp_path}/out", 2, spark.createDataFrame([("a",)], "id string"))
    again = files.read_tables(spark, f"{tmp_path}/out")
    assert again.root == "r" and {r["id"] for r in again.vertices.collect()} == {"r", "a"}
    files.write_depths(g, f"{tmp_path}/depths", (1, 2))
    assert {r["max_depth"]: r["count"] for r in spark.read.parquet(f"{tmp_path}/depths").groupBy("max_depth").count().collect()} == {1: 1, 2: 2}
    assert len(json.loads(files.graph_json(g).first()["value"])["links"]) == 2


def test_record_files(spark, tmp_path):
    (tmp_path / "x.txt.conll").write_text("w\ncat|||animal|||such as\n")
    assert tuple(files.read_tagged(spark, str(tmp_path)).first()) == ("cat", "animal", "such as")
    (tmp_path / "c.json").write_text('{"a": 2, "b": 1}')
    counts = files.read_concepts(spark, f"{tmp_path}/c.json")
    assert {tuple(r) for r in counts.collect()} == {("a", 2), ("b", 1)}
    assert json.loads(files.concepts_json(counts).first()["value"]) == {"a": 2, "b": 1}
    (tmp_path / "p.tsv").write_text("hypo\thyper\tsim\tis_oov\na\tb\t0.5\t0\nc\td\t0.1\tTrue\n")
    assert [tuple(r) for r in files.read_scored_pairs(spark, f"{tmp_path}/p.tsv").collect()] == [("a", "b", 0.5)]
    files.append_lines(counts, f"{tmp_path}/lines")
    files.append_lines(counts, f"{tmp_path}/lines")
    assert files.read_lines(spark, "concept string, n bigint", f"{tmp_path}/lines").count() == 4
    files.write_text_shards(counts, F.col("concept"), f"{tmp_path}/shards", 1, "concept")
    assert spark.read.text(f"{tmp_path}/shards").count() == 2


def test_resume_runs_each_once(spark, tmp_path):
    rows = lambda *ids: spark.createDataFrame([(str(i), "t", "Main topic classifications -> A") for i in ids], "id string, title string, hierarchy string")
    out, mark = f"{tmp_path}/out", f"{tmp_path}/mark"
    for part in (rows(1, 2), rows(2, 3)):
        part.write.mode("append").json(f"{tmp_path}/in")
        incremental.resume(incremental.new_rows(spark, schemas.PATH_OUTPUTS, f"{tmp_path}/in"), lambda f: f.select("id"), out, mark)
    assert sorted(r["id"] for r in spark.read.schema("id string").json(out).collect()) == ["1", "2", "3"]


def test_running_edges(spark, tmp_path):
    spark.createDataFrame([("1", "Main topic classifications -> A"), ("2", "Main topic classifications -> A -> B")], "id string, hierarchy string").write.json(f"{tmp_path}/in")
    stream = incremental.running_edges(incremental.new_rows(spark, "id string, hierarchy string", f"{tmp_path}/in"), T.parse_paths(F.col("hierarchy"))["relations"])
    q = stream.writeStream.format("memory").queryName("edges_now").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["src"], r["dst"]): r["weight"] for r in spark.table("edges_now").collect()} == {(T.ROOT, "A"): 2, ("A", "B"): 1}


def test_post_process_takes_more_with_a_higher_share(spark):
    e = spark.createDataFrame([(f"n{i % 5}", f"n{(i * 7) % 11}", float(i)) for i in range(30)], "src string, dst string, weight double").dropDuplicates(["src", "dst"])
    left = [prune.post_process(Graph.of(e), prune.Settings(a, 1.0, add_root=False)).edges.count() for a in (0.0, 0.3, 0.6, 1.0)]
    assert left == sorted(left, reverse=True) and left[-1] == 0
