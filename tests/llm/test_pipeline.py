"""The pipeline's stages, one after the other, on a small table."""

import numpy as np

import corpus_pipeline
from lodestone.llm import pii, registry
from lodestone.llm.common import settle

PROSE = "the cat and the dog of the house went to the garden and sat in the sun for a while before the rain came over the hill"


def test_stages(spark, tmp_path):
    rows = [(i, f"{PROSE} number {i} {'and then ' * (i % 7)} " + " ".join(f"word{(i * 31 + k) % 997}" for k in range(40)), "en", "s", 0) for i in range(30)]
    rows += [(100, rows[0][1], "en", "s", 0), (101, rows[1][1] + " end", "en", "s", 0), (102, "123 !!", "en", "s", 0), (103, None, None, "s", 0)]
    leak = " ".join(f"item{k}" for k in range(20))
    rows += [(104, f"{PROSE} before {leak} after", "en", "s", 0), (105, "the mail of the man is a.b@example.org and the rest", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = settle(stage(spark, docs, str(tmp_path)))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    clean = set(range(30))
    assert kept[0] == clean | {100, 101, 104, 105}
    assert kept[1] == clean | {104, 105}
    assert kept[2] == kept[3] == clean | {105}
    assert docs.filter("doc_id = 105").first()["text"] == "the mail of the man is <EMAIL> and the rest"
    out = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == kept[3] and all(len(r["ids"]) == 4 * r["n_tokens"] > 0 for r in out)


def test_the_language_reaches_the_result_and_labelled_junk_does_not(spark, tmp_path):
    words = {"en": "the of and to in is that for house garden rain hill before cat", "de": "der die und zu das nicht ein ich haus garten regen berg vor katze"}
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(rng.choice(words[lang].split(), 40)), lang if i < 30 else None, lang) for i in range(40) for lang in [list(words)[i % 2]]]
    junk = [(100 + i, "".join(map(chr, rng.integers(0x4E00, 0x9000, 200))), list(words)[i % 2], None) for i in range(8)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, lang, "s", len(t)) for i, t, lang, _ in rows + junk], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(f"item{k}" for k in range(20)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r["doc_id"]: r["lang"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {i: truth for i, _, _, truth in rows}


def test_eleven_queries_are_registered():
    names = set(registry.queries())
    assert {n.split("_")[0] for n in names if n != "pipeline"} == {f"op{i}" for i in range(1, 11)} and "pipeline" in names


def test_overlapping_spans_are_masked_together():
    assert pii.mask("x 1234567 y", [(1, 2, 6), (2, 4, 9)]) == "x <IP> y"


def test_sql_is_text_of_registered_queries():
    assert all(isinstance(v, str) and k in registry.queries() for k, v in registry.oracle_sql().items())
