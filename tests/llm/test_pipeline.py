"""The pipeline, stage by stage, against the operators and brute force."""

import time
from pathlib import Path

import public_tokenizers

import corpus_pipeline
from palimpsest.llm import common, kneser_ney, packing, rules, tokens
from palimpsest.shared import shared_dir

from .test_queries import components, shingles


def test_stages_and_their_effects(spark, folder):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "near_duplicates", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}

    one = corpus_pipeline.quality_rules(spark, docs, folder)
    assert one.columns == columns
    kept = {r["doc_id"] for r in one.collect()}
    assert kept == {i for i, t in texts.items() if rules.first_rejection(rules.Document(t), rules.RULES) is None}

    two = corpus_pipeline.quality_classifier(spark, one, folder)
    assert two.columns == columns
    good = {r["doc_id"] for r in spark.read.parquet(f"{folder}/labels.parquet").where("quality = 1 and coalesce(toxic, 0) = 0").collect()}
    left = {r["doc_id"] for r in two.collect()}
    assert left <= kept and len(left & good) >= 0.95 * len(kept & good)

    three = corpus_pipeline.near_duplicates(spark, two, folder)
    assert three.columns == columns
    sets = {i: shingles(texts[i], 5) for i in left}
    groups = components(list(sets), sets, 80, 100)
    assert {r["doc_id"] for r in three.collect()} == {i for i, c in groups.items() if i == c}


def test_run_packs_every_token_once(spark, folder):
    rows = corpus_pipeline.run(spark, folder).toPandas()
    for _, pieces in rows.sort_values("start").groupby("doc_id"):
        assert pieces.start.tolist() == (pieces.length.cumsum() - pieces.length).tolist()
        assert pieces.length.sum() == pieces.doc_tokens.iloc[0]
    assert rows.groupby("sequence_id").length.sum().max() <= 4096


def test_quality_classifier_counts_every_trusted_document(spark, tmp_path, monkeypatch):
    n, seen, count = 70_000, [], kneser_ney.gram_counts
    monkeypatch.setattr(kneser_ney, "gram_counts", lambda trusted: seen.append(count(trusted).where("lang like '*%'").groupBy().sum("n").first()[0]) or count(trusted))
    spark.range(n).selectExpr("id as doc_id", "1 as quality", "0 as toxic").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.range(n).selectExpr("id as doc_id", "'en' as lang", "concat('w', id) as text")
    corpus_pipeline.quality_classifier(spark, docs, str(tmp_path))
    assert seen == [sum(len(f"w{k}") for k in range(n))]


def test_order_of_rules_changes_no_verdict(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = sorted(str(r["doc_id"]) for r in corpus_pipeline.quality_rules(spark, docs, folder).collect())
    assert kept == sorted(str(r["doc_id"]) for r in rules.keep(docs, rules.RULES[::-1]).collect())


def test_packing_bounds_the_chunks_it_keeps(spark, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [" ".join(f"{chr(97 + k % 26)}{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(300)) for k in range(40)]
    few, many = tokens.WordEncoder(path, 500), tokens.WordEncoder(path)
    for k in range(0, len(texts), 2):
        for a, b in zip(few.encode(texts[k : k + 2], 2), many.encode(texts[k : k + 2], 2)):
            assert a.tolist() == b.tolist()
        assert max(len(few.young), len(few.old)) <= 500 + 600
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    asked, pack = [], packing.pack
    monkeypatch.setattr(packing, "pack", lambda *args, **named: asked.append(named) or pack(*args, **named))
    rows = corpus_pipeline.pack_windows(spark, docs, "").collect()
    assert asked[0]["chunks"] < tokens.WordEncoder.KEPT and asked[0]["block"] < 2_000_000
    assert rows == pack(docs, path, end_id=2, capacity=4096, with_ids=True).collect()


def test_stages_release_what_they_stored(spark, folder):
    top = Path(shared_dir(spark).removeprefix("file://"), "palimpsest")
    names = lambda: {p.name for p in top.iterdir()} if top.exists() else set()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = names()
    kept = corpus_pipeline.quality_classifier(spark, docs, folder)
    assert {n.rsplit("-", 1)[0] for n in names() - before} == {"kn-model", "kn-held-out", "kn-centres", "kn-quantile", "kn-thresholds"}
    before = names()
    left = corpus_pipeline.near_duplicates(spark, docs, folder)
    assert {n.rsplit("-", 1)[0] for n in names() - before} == {"jaccard-gone"}
    assert kept.count() and left.count()


def test_stored_rows_leave_no_shuffle_files(spark):
    def shuffled() -> set[str]:
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for k in range(files.size()) if (name := files.apply(k).getName()).startswith("shuffle_") and name.endswith(".data")}

    before = shuffled()
    df = spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count()
    rows, _ = common.stored(df, "trial")
    for _ in range(50):  # executors delete them a little later
        if not (new := shuffled() - before):
            break
        time.sleep(0.1)
    assert not new
    assert sorted(r["count"] for r in rows.collect()) == sorted(r["count"] for r in df.collect())
    assert spark.conf.get(common.CLEANUP, None) is None


def test_empty_tables(spark, empty_folder):
    rows = corpus_pipeline.run(spark, empty_folder)
    assert rows.columns[:2] == ["doc_id", "start"] and not rows.collect()


def test_null_ids_repeated_rows_and_extra_columns(spark, tmp_path):
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)]
    text, other = " ".join(words), " ".join(reversed(words))
    rows = [(None, text, "en", "a"), (None, None, None, "b"), (5, text, "en", "c"), (5, text, "en", "c"), (6, "", "en", "d"), (7, text + " end", "en", "e"), (8, other, None, "f")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, _kn string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    three = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        three = stage(spark, three, str(tmp_path))
        assert three.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["_kn"]) for r in three.collect()) == [("5", "c"), ("5", "c"), ("8", "f"), ("None", "a")]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(r["doc_id"]) for r in packed if r["start"] == 0) == ["5", "5", "8", "None"]
