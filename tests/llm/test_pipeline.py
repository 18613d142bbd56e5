import random

import pytest

from .conftest import prose

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_on_a_planted_corpus(spark, tmp_path, monkeypatch):
    r = random.Random(21)
    base = [prose(r, 120, r.choice(["en", "de"])) for _ in range(30)]
    item = " ".join(f"w{r.randrange(10**6)}" for _ in range(25))
    near = base[3].split()
    near[60] = "changed"
    rows = [(i, t) for i, t in enumerate(base)] + [(100, base[0]), (101, " ".join(near)), (102, "12 34 ..."), (103, None), (104, f"{prose(r, 40)} {item} {prose(r, 40)}")]
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else None, f"s{i % 3}", len(t or ""), 0.5, "k", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, _position int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = docs
    left = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {x["doc_id"] for x in kept.collect()}
        kept = corpus_pipeline._spark.stored(stage(spark, kept, str(tmp_path)))
        assert kept.columns == docs.columns and kept.filter("score <> 0.5 or lang_pred <> 'k' or _position <> 1").count() == 0
        left.append(before - {x["doc_id"] for x in kept.collect()})
    assert left == [{102, 103}, {100, 101}, {104}, set()]
    out = corpus_pipeline.run(spark, str(tmp_path)).orderBy("start").collect()
    assert {x["doc_id"] for x in out} == set(range(30))
    assert [x["start"] + x["n_tokens"] for x in out][:-1] == [x["start"] for x in out][1:]
    order = corpus_pipeline.pfair.mix(kept, output=("x", "y", "z")).orderBy("z").collect()
    assert [x["doc_id"] for x in out] == [x["doc_id"] for x in order]  # the files follow the mix


def test_language_stage(spark):
    """Languages that no row has a label of go, clean documents stay; without any label all stay."""
    r = random.Random(22)
    other = lambda n: " ".join("".join(r.choice("bdgklmprstvzxqjw") for _ in range(r.randint(3, 9))) for _ in range(n))
    clean = [(i, prose(r, r.randint(5, 150), k), k if i % 3 else None) for i, k in enumerate(["en", "de"] * 60)]
    strange = [(1000 + i, other(80), None) for i in range(15)] + [(2000 + i, "текст на другом языке " * 9, None) for i in range(5)]
    docs = spark.createDataFrame([(*x, "s", 1) for x in clean + strange], "doc_id long, text string, lang string, source string, n_chars int")
    kept = {x["doc_id"] for x in corpus_pipeline.identify_language(spark, docs, "").collect()}
    assert {i for i, _, _ in clean} <= kept and len(kept & {i for i, _, _ in strange}) == 0
    unlabelled = docs.withColumn("lang", corpus_pipeline.F.lit(None).cast("string"))
    assert corpus_pipeline.identify_language(spark, unlabelled, "").count() == len(clean) + len(strange)


def test_near_duplicates_by_row(spark):
    """Copies go though they have no id or one that others share; other texts of the id stay."""
    r = random.Random(23)
    a, b, c = (prose(r, 90) for _ in "abc")
    rows = [(1, a), (None, a), (1, b), (2, c), (2, c), (3, c + " end"), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted((x["doc_id"] or -1, x["text"] or "") for x in kept) == sorted([(1, a), (1, b), (2, c), (-1, "")])


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_contaminated_rows_go_by_row(spark, tmp_path):
    """Copies of an item go with no id or a shared one; clean rows that share the id stay."""
    r = random.Random(24)
    item = " ".join(f"w{r.randrange(10**6)}" for _ in range(25))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean, copy = prose(r, 60), f"{prose(r, 30)} {item} {prose(r, 30)}"
    rows = [(None, copy), (5, copy + " more"), (5, clean), (6, clean), (None, clean), (7, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    kept = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()
    assert sorted((x["doc_id"] or -1, x["text"] or "") for x in kept) == sorted([(5, clean), (6, clean), (-1, clean), (7, "")])


def test_columns_of_any_name_and_type(spark, tmp_path):
    """Every stage gives back columns of whatever names and types as they were."""
    r = random.Random(25)
    names = ["__lang", "__score", "__cosine", "__text", "__name", "__place", "__key", "__block", "__mixed", "_id", "_name", "_text", "name", "place", "digest", "rep", "key", "node", "held_out", "_file", "_row"]
    spark.createDataFrame([(1, prose(r, 25))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(i, prose(r, 80, k), k, f"s{i % 3}") for i, k in enumerate(["en", "de"] * 12)]
    docs = spark.createDataFrame(rows + rows[:1], "doc_id long, text string, lang string, source string")
    docs = docs.selectExpr("*", *[f"'own' as {c}" for c in names], "map('k', doc_id) as m", "array(1, null) as arr", "struct(doc_id) as st", "cast('b' as binary) as bin")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline._spark.stored(stage(spark, kept, str(tmp_path)))
        assert kept.columns == docs.columns, name
    assert kept.drop("m").exceptAll(docs.drop("m")).count() == 0 and kept.count() == 24
    assert all(x["m"] == {"k": x["doc_id"]} for x in kept.collect())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 24


def test_clean_up_keeps_to_its_own_folders(spark, tmp_path, monkeypatch):
    other = tmp_path / "tidemark-other"
    other.mkdir()
    monkeypatch.setattr(corpus_pipeline._spark, "_made", [])
    spark.range(3).write.parquet(f"{tmp_path}/tidemark-own")
    corpus_pipeline._spark._made.append(f"file://{tmp_path}/tidemark-own")
    assert corpus_pipeline._spark.clean_up(spark) == 1
    assert [p.name for p in tmp_path.iterdir()] == ["tidemark-other"]
