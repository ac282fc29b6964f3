"""The pipeline, stage by stage, against what its operators say, and the registered queries of the folder."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

import __spark_entry__ as entry
from veilgrain.llm import boilerplate, copies, decontaminate, ngram_join, packing, quality
from veilgrain.session import written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, tests = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("labels", "benchmark"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, SF), name)
        seen[name] = docs
        if name != "packing":
            assert docs.columns == before.columns
            ids = {r.doc_id for r in docs.select("doc_id").collect()}
            old = {r.doc_id for r in before.select("doc_id").collect()}
            if name == "quality":
                want = {r.doc_id for r in quality.score_quality(before, labels).collect() if r.predicted}
            elif name == "lines":
                want = old
                text = {r.doc_id: r.text for r in boilerplate.drop_boilerplate(before).collect()}
                assert {r.doc_id: (r.text, r.n_chars) for r in docs.collect()} == {k: (v, len(v)) for k, v in text.items()}
            elif name == "near_duplicates":
                want = {r.component_id for r in ngram_join.near_groups(before, n=5, percent=80).collect()}
            else:
                want = old - {r.doc_id for r in decontaminate.contaminated(before, tests).collect()}
            assert ids == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "benchmark", "packing"]
    rest = seen["benchmark"].where(F.trim("text") != "").select("doc_id")
    packed = docs.select(F.explode("doc_ids").alias("doc_id")).distinct()
    assert rest.exceptAll(packed).count() == 0 and packed.exceptAll(rest.distinct()).count() == 0
    assert docs.where("used > capacity").count() == 0


def test_registered():
    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 14):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1


def rows(spark, texts):
    """(doc_id, text) as documents of one source."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")


def page(seed, lines=12):
    rng = random.Random(seed)
    return "\n".join(" ".join(f"w{rng.randrange(5000)}" for _ in range(9)) for _ in range(lines))


def test_one_text_of_each_group_of_copies_is_packed(spark):
    menu = "home about us contact"
    texts = [f"{menu}\n{page(k)}" for k in range(40)]
    near = page(1000, 20).split("\n")
    near = ["\n".join([*near[:k], "another " + near[k], *near[k + 1 :]]) for k in range(6)]
    docs = rows(spark, enumerate(texts + [page(999)] * 20 + near))
    for name, stage in corpus_pipeline.STAGES[1:3] + corpus_pipeline.STAGES[4:]:
        docs = written(stage(spark, docs, SF), name)
        if name == "near_duplicates":
            kept = {r.doc_id: r.text for r in docs.collect()}
    assert kept == {k: page(k) for k in range(40)} | {40: page(999), 60: near[0]}
    packed = docs.select(F.explode("doc_ids").alias("doc_id")).collect()
    assert sorted(r.doc_id for r in packed) == sorted(kept)
    assert docs.agg(F.sum("used")).first()[0] == sum(len(t.split()) for t in kept.values())


def test_null_and_repeated_ids(spark):
    item = max((r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()), key=len)
    dirty = page(1) + "\n" + item
    docs = rows(spark, [(None, page(2)), (None, page(2) + " more"), (5, page(2) + " end"), (None, page(3)), (None, page(3) + " more"), (7, page(4)), (7, page(4)), (8, page(2)), (8, page(5)), (9, None), (None, page(6))])
    got = sorted((r.doc_id or 0, r.text or "") for r in corpus_pipeline.near_stage(spark, docs, SF).collect())
    third = [t for i, t in got if i == 0 and t.startswith(page(3))]
    assert len(third) == 1
    assert got == sorted([(5, page(2) + " end"), (0, third[0]), (7, page(4)), (8, page(5)), (9, ""), (0, page(6))])
    docs = rows(spark, [(None, dirty), (None, page(2)), (4, dirty), (4, page(3)), (5, None)])
    got = sorted((r.doc_id or 0, r.text or "") for r in corpus_pipeline.benchmark_stage(spark, docs, SF).collect())
    assert got == sorted([(0, page(2)), (4, page(3)), (5, "")])


def test_packed_text_keeps_its_white_space(spark):
    texts = ["  one\n\n\ttwo  three ", "x\n" * 9000 + "  end\n"]
    docs = rows(spark, enumerate(texts))
    placed = packing.pack_documents(docs).cache()
    made = {r.bin: r.text for r in corpus_pipeline.packing_stage(spark, docs, SF).collect()}
    cut = packing.sequences(placed.withColumn("bin", F.concat_ws("-", "bin", "doc_id", "first_word")), docs, spacing=True)
    parts = {r.bin: r.text for r in cut.collect()}
    for k, text in enumerate(texts):
        own = sorted((int(b.split("-")[-1]), t) for b, t in parts.items() if int(b.split("-")[-2]) == k)
        assert "".join(t for _, t in own) == text
    assert sum(map(len, made.values())) == sum(map(len, texts)) + placed.count() - len(made)


def test_columns_of_any_name_come_through(spark):
    clash = ["gone", "gone_key", "row_key", "n_lines", "_line_host", "component_id", "whole", "name", "best", "text_key", "n_rows"]
    texts = [page(k) for k in range(6)] + [page(1), None]
    docs = rows(spark, enumerate(texts)).select("*", *(F.concat(F.lit(c), "doc_id").alias(c) for c in clash))
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert all(r[c] == f"{c}{r.doc_id}" for c in clash), name


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_whole_rows_are_shuffled_once(spark):
    docs = rows(spark, [(k, page(k % 7)) for k in range(20)])
    found = plan(copies.one_each(docs))
    assert found.count("Scan ExistingRDD") == 1 and found.count("whole") > 0


def test_few_boilerplate_lines_do_not_shuffle_texts(spark):
    docs = rows(spark, [(k, f"menu\n{page(k)}") for k in range(20)])
    out = boilerplate.drop_boilerplate(docs)
    assert "Exchange hashpartitioning" not in plan(out)
    assert {r.text for r in out.collect()} == {page(k) for k in range(20)}


def test_equal_rows_and_other_columns_of_copies(spark):
    docs = rows(spark, [(1, page(1)), (1, page(1)), (2, page(1)), (None, page(2)), (None, page(2)), (3, None), (3, None)])
    docs = docs.withColumn("site", F.when(F.col("doc_id") == 2, "b").otherwise("a"))
    kept = sorted((r.doc_id or 0, r.text or "") for r in copies.one_each(docs).collect())
    assert kept == [(0, page(2)), (1, page(1)), (3, "")]
    kept = sorted((r.doc_id or 0, r.site) for r in copies.one_each(docs, ("site",)).collect())
    assert kept == [(0, "a"), (1, "a"), (2, "b"), (3, "a")]
