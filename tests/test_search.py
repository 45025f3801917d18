"""Search, manifests, evaluation, streaming and sources."""

import numpy as np
from pyspark.sql import functions as F

from corvane.operators import evaluate, incremental, search
from corvane.sources import files


def test_exact_search_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    x[5] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0, 2.0])], "id long, v array<double>")
    got = {(r["query"], r["key"]): r["rank"] for r in search.exact_search(df, df.where("id in (0, 5, 7, 901)"), "id", "v", k=4, least=0.1, groups=3).collect()}
    u = x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
    expected = {(901, 901): 1}
    for q in (0, 7):
        s = u @ u[q]
        best = [int(k) for k in np.argsort(-s, kind="stable")[:4] if s[k] >= 0.1]
        expected |= {(q, k): n + 1 for n, k in enumerate(best)}
    assert got == expected


def test_cosine_of_different_lengths(spark):
    df = spark.createDataFrame([([1.0, 0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0, 0.0], [0.0, 1.0, 0.0]), ([1.0, 0.0], [0.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(search.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]


def test_retrieval_order(spark):
    hits = spark.createDataFrame([(1, k, k, "document" if k in (1, 2, 5, 6, 7) else "function") for k in range(1, 10)], "query int, key int, rank int, kind string")
    got = [r["key"] for r in search.retrieve(hits, F.col("kind") == "document", k=6).orderBy("place").collect()]
    assert got == [1, 2, 5, 3, 4, 8]


def test_manifest(spark):
    old = spark.createDataFrame([("a", 1, 10), ("b", 1, 10), ("gone", 1, 1)], "path string, mtime long, size long")
    now = spark.createDataFrame([("a", 1, 10), ("b", 2, 10), ("new", 1, 5)], "path string, mtime long, size long")
    assert {(r["path"], r["is_new"]) for r in incremental.changed(now, old).collect()} == {("b", False), ("new", True)}
    assert [r["path"] for r in incremental.vanished(now, old).collect()] == ["gone"]
    merged = {r["path"]: r["mtime"] for r in incremental.upsert(old, now, "path", "mtime").collect()}
    assert merged == {"a": 1, "b": 2, "gone": 1, "new": 1}


def test_evaluation(spark):
    cases = spark.createDataFrame(
        [("c", "easy", "It uses PageRank.", ["pagerank"], True, 1, 1), ("c", "hard", "Nothing here", ["x"], False, 1, 0), ("o", "easy", "Sorry, unknown", [], False, 1, 0), ("o", "easy", "yes", ["yes"], True, 2, 1)],
        "category string, difficulty string, answer string, expected array<string>, must_cite boolean, min_sources int, n_sources int",
    )
    got = {(r["category"], r["difficulty"]): (r["total"], r["passed"], r["failed"], r["citation_rate"]) for r in evaluate.metrics(evaluate.judged(cases)).collect()}
    assert got[(None, None)] == (4, 2, 2, 0.5) and got[("c", None)] == (2, 1, 1, 1.0)


def test_stream_equals_batch(spark, tmp_path):
    from corvane.streaming.index import _parts, index_stream, read_index

    rows = spark.range(200).selectExpr("CAST(id % 40 AS STRING) AS id", "id AS seq")
    rows.repartition(5).write.parquet(str(tmp_path / "in"))
    for every in (32, 2):
        target = str(tmp_path / f"index{every}")
        index_stream(spark, rows.schema, str(tmp_path / "in"), target, str(tmp_path / f"state{every}"), "id", "seq", files_per_batch=1, compact_every=every)
        got = {r["id"]: r["seq"] for r in read_index(spark, target, "id").select("id", "_seq.seq").collect()}
        assert got == {str(k): 160 + k for k in range(40)} and ("base" in {k for k, _ in _parts(spark, target)}) == (every == 2)
    assert read_index(spark, str(tmp_path / "none"), "id") is None


def test_scan(spark, tmp_path):
    for name, text in (("a.py", "x = 1\n"), ("b/c.ts", "let a;\n"), ("b/d.d.ts", "x"), ("node_modules/m.js", "x"), (".hid/x.py", "x"), ("tests/t.py", "x"), ("r.md", "# r")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    assert {r["path"] for r in files.scan(spark, str(tmp_path)).collect()} == {"a.py", "b/c.ts"}
    lines = spark.createDataFrame([("a\nb\r\nc\n\n", 2, 9), ("a", 3, 2)], "t string, s int, e int")
    assert [r["source"] for r in files.line_range(lines, "t", "s", "e").collect()] == ["b\nc", ""]
    blob = spark.createDataFrame([(bytearray(np.array([1.5, -2], "<f4").tobytes()),), (bytearray(b"abc"),)], "b binary")
    assert [r[0] for r in blob.select(files.from_blob(F.col("b"))).collect()] == [[1.5, -2.0], None]


def test_stores(spark, tmp_path):
    import json
    import sqlite3

    x = np.array([[1.5, -2.0], [0.25, 3.0]], "<f4")
    with sqlite3.connect(tmp_path / "v.db") as c:
        c.execute("CREATE TABLE vectors (id TEXT PRIMARY KEY, vector BLOB, source_file TEXT)")
        c.executemany("INSERT INTO vectors VALUES (?, ?, ?)", [(f"k{i}", x[i % 2].tobytes() if i else b"abc", "f.py") for i in range(30)])
    c.close()
    got = {r["id"]: r["vector"] for r in files.read_sqlite_store(spark, str(tmp_path / "v.db"), parts=4).collect()}
    assert len(got) == 30 and got["k0"] is None and got["k1"] == x[1].tolist() and got["k2"] == x[0].tolist()
    back = spark.createDataFrame([("a", [1.5, -2.0]), ("b", None)], "id string, v array<float>").select("id", files.to_blob(F.col("v")).alias("b"))
    assert {r["id"]: r["b"] for r in back.collect()} == {"a": bytearray(x[0].tobytes()), "b": None}
    (tmp_path / "s.json").write_text(json.dumps({"cases": [{"question": "q", "expected": ["a"]}, {"question": "r", "expected": []}]}))
    assert {r["question"] for r in files.read_suite(spark, str(tmp_path / "s.json")).collect()} == {"q", "r"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a/b.md", "one"), ("c.md", None), ("../d.md", "no"), (None, "no")], "name string, text string")
    files.write_texts(df, str(tmp_path / "out"), "name", "text")
    assert {str(p.relative_to(tmp_path / "out")): p.read_text() for p in (tmp_path / "out").rglob("*.md")} == {"a/b.md": "one", "c.md": ""}
    for k in range(13):
        (tmp_path / "v" / f"2025{k:02}").mkdir(parents=True)
    assert sorted(files.keep_newest(spark, str(tmp_path / "v"))) == ["202500", "202501", "202502"]
    assert len(list((tmp_path / "v").iterdir())) == 10 and files.keep_newest(spark, str(tmp_path / "none")) == []


def test_hybrid_has_literal_hits_of_its_own(spark):
    docs = spark.createDataFrame([(1, "Cache rules"), (2, "The cache rules of old"), (3, "Other"), (4, None)], "doc_id int, title string")
    asked = spark.createDataFrame([(9, "cache rules"), (8, ""), (7, None)], "question_id int, question string")
    hits = spark.createDataFrame([(9, 3, 0.5)], "question_id int, key int, similarity double")
    got = {(r["question_id"], r["key"]): (r["score"], r["place"]) for r in search.hybrid(hits, docs, asked, "doc_id", "title", "question").collect()}
    assert got == {(9, 1): (0.6, 1), (9, 2): (0.4, 2 + 0), (9, 3): (0.3, 3)}


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    import pytest

    from corvane import session

    class Undefined:
        def isDefined(self):
            return False

    class Context:
        master = "spark://somewhere:7077"

        class _jsc:  # noqa: N801
            @staticmethod
            def sc():
                return type("S", (), {"getCheckpointDir": staticmethod(lambda: Undefined())})

        @staticmethod
        def getConf():
            return type("C", (), {"get": staticmethod(lambda *a: None)})

    with pytest.raises(ValueError):
        session.checkpoint_folder(type("Spark", (), {"sparkContext": Context})())
