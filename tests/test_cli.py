"""Files in, files out."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone import cli
from lodestone.sources import config, sinks, tables
from lodestone.streaming import incremental


def test_query_file_forms(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"queries": [{"query_id": "q1", "query_text": "cats"}]}))
    (tmp_path / "b.json").write_text(json.dumps(["dogs", "birds"]))
    assert [tuple(r) for r in tables.query_file(spark, str(tmp_path / "a.json")).collect()] == [("q1", "cats")]
    assert [tuple(r) for r in tables.query_file(spark, str(tmp_path / "b.json")).collect()] == [("0", "dogs"), ("1", "birds")]


def test_rank_features_and_clean(spark, tmp_path):
    corpus = tmp_path / "corpus"
    corpus.mkdir()
    (corpus / "Big_cats_0123456789.txt").write_text("Cats are large animals that live in many places of the world.")
    (corpus / "Dogs.txt").write_bytes(b"Dogs bark \xff at cats.")
    (tmp_path / "q.json").write_text(json.dumps(["large cats", "zebra"]))
    assert cli.main(["rank", "--corpus", str(corpus), "--queries", str(tmp_path / "q.json"), "--out", str(tmp_path / "r")]) == 0
    got = spark.read.parquet(str(tmp_path / "r/bm25"))
    assert {(r["query_id"], r["doc_rank"]): r["doc_id"] for r in got.collect()} == {("0", 1): "Big_cats_0123456789", ("0", 2): "Dogs", ("1", 1): "Big_cats_0123456789", ("1", 2): "Dogs"}
    assert cli.main(["features", "--corpus", str(corpus), "--out", str(tmp_path / "f")]) == 0
    assert spark.read.parquet(str(tmp_path / "f")).count() == 2
    for _ in range(2):
        assert cli.main(["clean", "--source", str(corpus), "--out", str(tmp_path / "c")]) == 0
    assert sorted(r["text"] for r in spark.read.parquet(str(tmp_path / "c")).collect())[1] == "Dogs bark  at cats."  # the second run added nothing
    assert spark.read.parquet(str(tmp_path / "c")).count() == 2


def test_graph_commands(spark, tmp_path, capsys):
    pages = [{"title": t, "canonical_title": t, "page_id": i, "kind": "page"} for i, t in enumerate(["Cat", "Dog", "Bird"])]
    (tmp_path / "index.json").write_text(json.dumps([*pages, {"title": "Animals", "kind": "category", "page_id": 9}]))
    head = "source_title,source_kind,source_page_id,source_url,target_title,target_kind,target_page_id,target_url\n"
    (tmp_path / "links.csv").write_text(head + "Cat,page,0,u,Dog,page,1,u\nBird,page,2,u,Dog,page,1,u\nDog,page,1,u,Animals,category,9,u\n")
    out = str(tmp_path / "g")
    assert cli.main(["build", "--index", str(tmp_path / "index.json"), "--links", str(tmp_path / "links.csv"), "--out", out]) == 0
    assert cli.main(["query", "--graph", out, "--title", " dog "]) == 0
    assert "rank: 1" in capsys.readouterr().out
    assert cli.main(["query", "--graph", out, "--page-id", "1", "--json"]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["rank"] == 1
    assert cli.main(["top", "--graph", out, "--limit", "1", "--json"]) == 0
    assert [r["title"] for r in json.loads(capsys.readouterr().out.strip().splitlines()[-1])] == ["Dog"]
    with pytest.raises(SystemExit):
        cli.main(["query", "--graph", out])
    made = spark.read.json(f"{out}/metadata").first().asDict(True)
    assert set(made) == {
        "generated_at_utc", "input_dir", "output_dir", "page_index_path", "links_path", "node_count", "edge_count", "dangling_node_count",
        "include_categories", "completed_only", "damping", "tolerance", "max_iterations", "iterations_run", "final_delta", "fetch_status_counts",
    } and made["node_count"] == 3 and made["edge_count"] == 2 and made["fetch_status_counts"] == {"pending": 3}
    assert cli.main(["query", "--graph", out, "--title", "o"]) == 1
    assert cli.main(["top", "--graph", out]) == 0


def test_stream_of_documents_and_windows(spark, tmp_path):
    prose = "This is a sentence that has rather more than eight words."
    spark.createDataFrame([("a", prose), ("b", "")], "id string, text string").write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        incremental.clean_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("a", prose)]
    events = spark.createDataFrame([("2024-01-01 00:01:00", "x"), ("2024-01-01 00:09:00", "x"), ("2024-01-01 00:11:00", "x")], "ts string, event_type string")
    assert [r["n"] for r in incremental.counts_by_window(events).orderBy(F.col("window.start")).collect()] == [2, 1]


def test_texts_by_name_with_bytes_that_do_not_decode(spark, tmp_path):
    (tmp_path / "b.txt").write_bytes("﻿ x � y".encode() + b"\xff z ")
    (tmp_path / "a.txt").write_text("first")
    rows = {r["doc_id"]: r["body"] for r in tables.text_corpus(spark, str(tmp_path)).collect()}
    assert rows == {"a": "first", "b": "x � y z"}
    assert [r["doc_id"] for r in tables.text_corpus(spark, str(tmp_path), 1).collect()] == ["a"]
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError):
        tables.text_corpus(spark, str(tmp_path / "none"))


def test_coefficients_go_out_wide_and_come_back_long(spark, tmp_path):
    rows = spark.createDataFrame([("q1", "a", 0.5), ("q1", "b", -0.25), ("q2", "a", None)], "query_id string, feature string, coef double")
    sinks.write_wide(rows, str(tmp_path / "w"), ["a", "b"])
    found = {(r["query_id"], r["feature"]): r["coef"] for r in tables.wide_coefficients(spark, str(tmp_path / "w")).collect()}
    assert found == {("q1", "a"): 0.5, ("q1", "b"): -0.25, ("q2", "a"): None, ("q2", "b"): None}


def test_missing_inputs_are_told_and_caches_follow_the_corpus(spark, tmp_path):
    said = []
    (tmp_path / "here").mkdir()
    assert list(tables.present(spark, {"x": str(tmp_path / "here"), "y": str(tmp_path / "gone")}, said.append)) == ["x"] and "y" in said[0]
    made, docs = [], spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for df in (docs, docs, docs.withColumn("text", F.lit("b"))):
        tables.cached(spark, str(tmp_path / "c"), "n", df, lambda df=df: made.append(1) or df).collect()
    assert len(made) == 2


def test_configuration(tmp_path):
    (tmp_path / ".env").write_text("# places\nLODESTONE_CORPUS='texts'\nLODESTONE_CACHE=hdfs://x/y\n")
    paths = config.load(tmp_path, {"LODESTONE_QUERIES": "q.json"})
    assert (paths.corpus, paths.cache, paths.queries, paths.rankings) == (str(tmp_path / "texts"), "hdfs://x/y", str(tmp_path / "q.json"), str(tmp_path / "rankings"))


def test_crawl_outputs_from_a_saved_inventory(spark, tmp_path):
    nodes = [{"title": "A", "page_id": 1, "kind": "page"}, {"title": "B", "page_id": 2, "kind": "category", "discovered_from": ["A"]}]
    (tmp_path / "inventory.json").write_text(json.dumps({"nodes": nodes}))
    (tmp_path / "progress").mkdir()
    (tmp_path / "progress" / "a.json").write_text(json.dumps({"title": "A", "links": ["B", "a", "C"], "fetch_status": "completed", "url": ""}))
    assert cli.main(["crawl-outputs", "--inventory", str(tmp_path / "inventory.json"), "--progress", str(tmp_path / "progress"), "--out", str(tmp_path / "out")]) == 0
    manifest = spark.read.json(str(tmp_path / "out" / "manifest")).first()
    assert (manifest["node_count"], manifest["category_count"], manifest["completed_count"], manifest["pending_count"], manifest["in_scope_edge_count"]) == (2, 1, 1, 1, 1)
    index = {r["title"]: (r["link_count"], r["fetch_status"]) for r in spark.read.json(str(tmp_path / "out" / "page_index")).collect()}
    assert index == {"A": (1, "completed"), "B": (0, "pending")}
    assert cli.main(["crawl-outputs", "--inventory", str(tmp_path / "none.json"), "--out", str(tmp_path / "out")]) == 1


def test_all_scorers_rank_and_exported_texts_are_cleaned(spark, tmp_path):
    corpus = tmp_path / "corpus"
    corpus.mkdir()
    (corpus / "Cats.txt").write_text("Title: Big cats\nURL: x\n\nCats purr.\n edit \nReferences\nnone")
    (corpus / "Dogs.txt").write_text("Dogs bark.")
    (tmp_path / "q.json").write_text(json.dumps(["cats purr"]))
    for model in ("sbert", "e5", "cross_encoder", "colbert"):
        for _ in range(2):
            assert cli.main(["rank", "--model", model, "--corpus", str(corpus), "--queries", str(tmp_path / "q.json"), "--out", str(tmp_path / "r"), "--cache", str(tmp_path / "cache")]) == 0
        best = spark.read.parquet(str(tmp_path / "r" / model)).filter("doc_rank = 1").first()
        assert best["doc_id"] == "Cats", model
    assert cli.main(["export-clean", "--source", str(corpus), "--out", str(tmp_path / "e")]) == 0
    assert {r["id"]: r["text"] for r in spark.read.parquet(str(tmp_path / "e")).collect()} == {"Cats": "Big cats\r\n\r\nCats purr.\r\n", "Dogs": "Dogs bark.\r\n"}
