import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leakscan_spark.llm import decontaminate, line_dedup, mixing, near_dedup, quality_rules, registry


@pytest.fixture(scope="module")
def folder(spark, documents, prose, odd_rows, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    rng = random.Random(7)
    item = prose(77, 25)
    rows = []
    for i in range(160):
        text = "\n".join(prose(1000 + 10 * i + k, 30) for k in range(4))
        rows.append((i, text if i % 4 else " ".join(w.upper() + "###" for w in text.split()), "en", f"s{i % 3}"))
    rows += [(200, rows[1][1] + " more", "en", "s0"), (201, rows[2][1].replace("\n", " \n"), "en", "s0")]
    rows += [(210, f"{prose(5, 60)} {item} {prose(6, 60)}", "en", "s1"), (211, rows[5][1] + "\n" + rows[6][1].split("\n")[0], "en", "s2")]
    rows += [(d, t, None, None) for d, t in odd_rows]
    rng.shuffle(rows)
    df = documents(rows)
    df.write.parquet(str(path / "documents.parquet"))
    labels = [(i, int(i % 4 > 0), 0) for i in range(160)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def test_stages_do_what_their_operators_say(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels, benchmark = spark.read.parquet(f"{folder}/labels.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    key = lambda df: sorted(map(str, df.collect()))
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "mixing"]

    good = corpus_pipeline.saved(stages["quality_rules"](spark, docs, folder), "t")
    verdict = quality_rules.judged(docs, quality_rules.fit(docs, labels)).where("kept").select("doc_id")
    assert good.columns == columns and sorted(map(str, verdict.collect())) == key(good.select("doc_id"))
    assert 0 < good.count() < docs.count()

    lined = corpus_pipeline.saved(stages["line_dedup"](spark, good, folder), "t")
    kept = line_dedup.deduped(good, line_dedup.ingested(good)).selectExpr("doc_id", "kept_text")
    assert lined.columns == columns and key(lined.selectExpr("doc_id", "text kept_text")) == key(kept)
    assert lined.where("n_chars <> char_length(text)").count() == 0
    assert lined.where("doc_id in (211)").first()["text"] == ""

    named = corpus_pipeline.saved(stages["near_dedup"](spark, lined, folder), "t")
    groups = near_dedup.clusters(lined, 5, 80)
    assert named.columns == columns
    assert named.count() == groups.where("kept").select("doc_id").distinct().count()

    clean = corpus_pipeline.saved(stages["decontamination"](spark, named, folder), "t")
    bad = {r["doc_id"] for r in decontaminate.matches(named, benchmark).collect()}
    assert bad == {210} and clean.columns == columns and clean.count() == named.count() - 1

    mixed = stages["mixing"](spark, clean, folder)
    plan = mixing.mix(clean)
    assert mixed.count() == plan.selectExpr("sum(copies)").first()[0]
    assert key(corpus_pipeline.run(spark, folder)) == key(mixed)


def test_pipeline_on_an_empty_table(spark, documents, tmp_path):
    documents([]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_documents_without_a_word_pair_of_any_item_pass_the_benchmark_stage(spark, documents, tmp_path):
    spark.createDataFrame([(1, "a few words of an item")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = documents([(1, "nothing that it holds", "en", "s"), (2, None, "en", "s"), (3, "other " * 200_000, "en", "s")])
    clean = corpus_pipeline.saved(corpus_pipeline.remove_benchmark_copies(spark, df, str(tmp_path)), "t")
    assert clean.columns == df.columns and sorted(map(str, clean.collect())) == sorted(map(str, df.collect()))


def test_clashing_columns_pass_the_line_and_mixing_stages(spark, documents):
    line = "a line long enough to be held twice"
    rows = documents([(1, line + "\nown", "en", "s"), (2, line + "\nother", "en", "s")]).withColumn("kept_text", F.lit("mine")).withColumn("N_Lines", F.lit(7))
    lined = corpus_pipeline.drop_repeated_lines(spark, rows, "")
    assert lined.columns == rows.columns
    assert sorted((r.doc_id, r.text, r.kept_text, r.N_Lines) for r in lined.collect()) == [(1, line + "\nown", "mine", 7), (2, "other", "mine", 7)]
    mixed = corpus_pipeline.mix_sources(spark, rows.withColumn("Copy", F.lit("kept")), "")
    assert mixed.columns == [*rows.columns, "Copy", "copy_"] and {r.Copy for r in mixed.collect()} <= {"kept"}


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in registry.registry()} == {f"op{n}" for n in range(1, 14)}
    assert set(registry.SQL) <= set(registry.registry())
