import random

import corpus_pipeline as P


def test_stages(spark, docs, none, tmp_path):
    spark.createDataFrame([(1, "la la la la la la")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d = docs
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, d, str(tmp_path))
        if k < len(P.STAGES) - 1:
            assert out.columns == docs.columns, name
            assert stage(spark, none, str(tmp_path)).count() == 0
        out.write.parquet(str(tmp_path / str(k)))
        d = spark.read.parquet(str(tmp_path / str(k)))
    ids = [r.doc_id for r in d.collect()]
    assert len(ids) == len(set(ids)) > 20
    assert 1 in ids and 76 not in ids and 79 not in ids  # copies of the first text go


def test_names_and_order():
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "bpe"]


def test_near_duplicates_compares_rows_without_or_with_one_id(spark):
    rng = random.Random(11)
    a, b, c, d = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(4))
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (7, c), (9, d)]
    got = P.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(None, a), (None, b), (7, c), (7, d)], key=str)


def test_columns_may_have_any_names(spark):
    """Columns named like the stages' own, in any case of null, come through as they were."""
    names = ["spans", "clean_text", "scan_text", "n_assign", "base_sha256", "q_words", "q_base", "q1", "sym_most", "id", "same", "row", "class_key", "one", "p_id", "none", "kept0", "once"]
    rng = random.Random(3)
    rows = []
    for i in range(30):
        text = " ".join(f"word{rng.randrange(10**4)}" for _ in range(60)) + ("\npassword: hunter2xyz\n" if i % 7 == 0 else "")
        rows.append((i if i % 5 else None, text if i != 4 else None, "en", "a" if i % 2 else None, 99, *(f"{c}{i}" for c in names)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names))
    for stage in (P.quality, P.near_duplicates, P.secrets):
        out = stage(spark, df, "")
        assert out.columns == df.columns
        got = sorted(tuple(r[c] for c in names) for r in out.collect())
        assert got and set(got) <= {r[5:] for r in rows}
        assert stage is P.quality or len(got) == 30
    clean = {r.spans: r for r in P.secrets(spark, df, "").collect()}
    assert clean["spans4"].text is None and clean["spans7"].text.endswith("\n[secret]\n") and clean["spans7"].n_chars == len(clean["spans7"].text) and clean["spans8"].n_chars == 99


def test_decontamination_leaves_out_no_item_with_every_word_edited(spark):
    from roadcut.llm import cgk_decontamination as C

    folder = "/root/testdata/sf0.001"
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").where("text IS NOT NULL").orderBy("item_id").limit(6).collect()]
    texts = [" ".join(("0" if w[0] != "0" else "1") + w[1:] for w in t.lower().split()) for t in items]
    near = [C.search(" ".join(t.lower().split()), x)[0] <= int(0.2 * len(" ".join(t.split())) + 1e-9) for t, x in zip(items, texts)]
    assert any(near)
    docs = spark.createDataFrame([(i, f"zzz yyy {x} zzz") for i, x in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id for r in P.decontamination(spark, docs, folder).collect()} == {i for i, n in enumerate(near) if not n}


def test_few_documents_make_few_files(spark):
    docs = spark.createDataFrame([(i, f"one two three four five w{i} x{i} y{i}") for i in range(9)], "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = P.near_duplicates(spark, docs, "")
        assert got.rdd.getNumPartitions() == 1 and got.count() == 9
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
