"""The pipeline's stages and its run against brute force."""

import re
import shutil

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import decontaminate

from .test_operators import DOCS, classes, prose, quality_base


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    texts = [prose(60 + i, i) for i in range(120)]
    texts += [texts[0], texts[1] + " more", None, "", "short one", "a b c " * 40, "\n".join([prose(30, 900), prose(40, 901)])]
    leak = prose(14, 5555)
    texts += [prose(50, 777) + " " + leak + " " + prose(20, 778)]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)], DOCS)
    docs.write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(1, leak.upper() + "!"), (2, prose(20, 31337))], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    yield out
    shutil.rmtree(out)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, rows = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    a = corpus_pipeline.quality_rules(spark, docs, folder)
    passed = {i for i, t in rows.items() if (n := quality_base(t))[0] >= 50 and 100 * n[4] <= 50 * n[0]}
    assert a.columns == names and {r.doc_id for r in a.collect()} == passed
    b = corpus_pipeline.near_duplicates(spark, a, folder)
    kept = {i for i, (_, c) in classes([(i, rows[i]) for i in passed]).items() if i == c}
    assert b.columns == names and {r.doc_id for r in b.collect()} == kept
    c = corpus_pipeline.benchmark_decontamination(spark, b, folder)
    windows = decontaminate.windows([(str(r.item_id), r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()], 10)
    clean = {i for i in kept if not any(w in f" {' '.join(re.findall('[a-z0-9]+', rows[i].lower()))} " for w in windows)}
    assert c.columns == names and {r.doc_id for r in c.collect()} == clean and len(clean) == len(kept) - 1
    d = corpus_pipeline.source_mix(spark, c, folder)
    counts = {r.doc_id: r["count"] for r in d.groupBy("doc_id").count().collect()}
    assert d.columns == names and set(counts) <= clean and max(counts.values()) <= 2
    total = sum(len(rows[i].split()) for i in clean)
    assert sum(n * len(rows[i].split()) for i, n in counts.items()) == pytest.approx(1.5 * total, rel=0.03)
    e = corpus_pipeline.shards(spark, d, folder)
    sizes = [r["count"] for r in e.groupBy("shard").count().collect()]
    assert e.count() == d.count() and max(sizes) - min(sizes) <= 1 and set(names) <= set(e.columns)
    whole = corpus_pipeline.run(spark, folder)
    assert {(r.doc_id, r.text) for r in whole.collect()} == {(i, rows[i]) for i in counts}
    assert whole.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 2").count() == 0


CLASHES = ["edge", "moved", "law", "size", "shard", "slot", "rank", "tied", "old_shard", "text_crc32", "component_id", "items", "kept", "copies", "key", "class", "a", "b", "host", "line", "n", "target"]


def test_empty_table(spark, folder, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    shutil.copytree(f"{folder}/benchmark.parquet", tmp_path / "benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_columns_with_any_names(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plain = {(r.doc_id, r.text, r.shard, r.slot) for r in corpus_pipeline.run(spark, folder).collect()}
    docs.select("*", *(F.concat(F.lit(c), F.col("doc_id")).alias(c) for c in CLASHES)).write.parquet(str(tmp_path / "documents.parquet"))
    shutil.copytree(f"{folder}/benchmark.parquet", tmp_path / "benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert len(set(got.columns)) == len(got.columns) and set(got.columns) >= set(docs.columns) | set(CLASHES)
    rows = got.collect()
    assert {(r.doc_id, r.text, r.shard, r.slot) for r in rows} == plain
    assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in ("edge", "rank", "tied", "component_id", "key", "a", "host", "n"))
