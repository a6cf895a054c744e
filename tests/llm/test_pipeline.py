"""The pipeline: columns, what each stage drops, and the whole run."""

import corpus_pipeline
from wattloom.llm import decontamination, mixing, neardup, toxicity
from wattloom.llm.common import stored

FOLDER = "/root/testdata/sf0.001"


def test_every_stage_on_what_the_one_before_kept(spark):
    docs = first = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels, benchmark = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("labels", "benchmark"))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near duplicates", "decontamination", "mixing", "token files"]

    kept = stored(stages["toxicity"](spark, docs, FOLDER), "t1")
    gone = {r.doc_id for r in toxicity.toxicity(docs, labels).where("predicted = 1").collect()}
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert kept.columns == first.columns and ids(kept) == sorted(set(ids(docs)) - gone)

    docs, kept = kept, stored(stages["near duplicates"](spark, kept, FOLDER), "t2")
    classes = neardup.near_duplicates(docs).collect()
    assert kept.columns == first.columns and ids(kept) == sorted({r.class_id for r in classes})

    docs, kept = kept, stored(stages["decontamination"](spark, kept, FOLDER), "t3")
    found = {r.doc_id for r in decontamination.matches(docs, benchmark).collect()}
    assert kept.columns == first.columns and ids(kept) == sorted(set(ids(docs)) - found)

    docs, kept = kept, stored(stages["mixing"](spark, kept, FOLDER), "t4")
    plan = {r.doc_id: r.taken // r.size for r in mixing.mix(docs).collect() if r.size}
    assert kept.columns == first.columns and ids(kept) == sorted(d for d, n in plan.items() for _ in range(n))

    report = stages["token files"](spark, kept, FOLDER).collect()
    assert sorted(r.doc_id for r in report) == ids(kept)


def test_whole_run_and_a_table_without_rows(spark, tmp_path):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").where("false").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_without_ids_repeated_ids_and_clashing_columns(spark, tmp_path):
    from llm_data import words

    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    passage = benchmark.head().text
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    whole = spark.read.parquet(f"{FOLDER}/documents.parquet")
    a, b, c = (" ".join(words(60, k)) for k in (1, 2, 3))
    rows = [
        (None, a), (None, a), (7, b), (7, c), (7, None), (None, None), (None, "x " + passage), (7, passage + " y"),
    ]
    more = spark.createDataFrame([(d, t, "en", None, 0) for d, t in rows], whole.schema)
    docs = whole.unionByName(more).selectExpr("*", "'x' AS digest", "1 AS _copies", "2 AS class")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", benchmark)):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    folder = str(tmp_path)
    kept = spark.read.parquet(f"{folder}/documents.parquet")
    columns = kept.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stored(stage(spark, kept, folder), f"odd_{name.replace(' ', '_')}")
        assert kept.columns == columns
        mine = [(r.doc_id, r.text) for r in kept.where("source IS NULL").collect()]
        if name == "toxicity":
            assert sorted(mine, key=repr) == sorted(rows, key=repr)
        if name == "near duplicates":
            # The passage with a word before it is near the one with a word after it, which has an id.
            assert sorted(mine, key=repr) == sorted(set(rows) - {rows[6]}, key=repr)
        if name == "decontamination":
            assert sorted(mine, key=repr) == sorted({(None, a), (7, b), (7, c), (7, None), (None, None)}, key=repr)
        if name == "mixing":
            assert {t for _, t in mine} <= {a, b, c} and len(mine) >= 3
    assert corpus_pipeline.run(spark, folder).count() == kept.count()
