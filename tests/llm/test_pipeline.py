"""The pipeline's stages against plain versions of what each decides."""

import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import brute_llm as brute  # noqa: E402

SF = "/root/testdata/sf0.001"


def written_tables(spark, folder, docs, items, labels):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, llm_id string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_stages(spark, tmp_path):
    import corpus_pipeline
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdeknoru") for _ in range(r.randint(2, 7)))
    clean = [" ".join(word() for _ in range(r.randint(20, 120))) for _ in range(150)]
    toxic = [" ".join([word() for _ in range(40)] + ["idiot", "moron"] * 3) for _ in range(60)]
    texts = clean + toxic
    docs = [(i, t, "en", "s", len(t), "x") for i, t in enumerate(texts)]
    item = " ".join(word() for _ in range(20))
    more = [(1000, clean[0] + " tail"), (1001, clean[1]), (1002, f"{clean[2]} {item}"), (1003, "my token=abcdef123456 is here"), (1004, None), (1005, ""), (1001, clean[1]), (None, "nobody")]
    docs += [(i, t, None, None, None if t is None else len(t), "x") for i, t in more]
    labels = [(i, 1, int(i >= 150)) for i in range(len(texts))]
    written_tables(spark, tmp_path, docs, [(1, item), (2, None)], labels)
    sf = str(tmp_path)
    d = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(x["doc_id"], x["text"]) for x in d.collect()]
        out = stage(spark, d, sf)
        if name != "packing":
            assert out.columns == d.columns
        out.write.parquet(f"{sf}/{name}")
        d = spark.read.parquet(f"{sf}/{name}")
        rows[name] = d.collect()
        after = [(x["doc_id"], x["text"]) for x in rows[name]] if name != "packing" else []
        if name == "toxicity":
            gone = {i for i, _ in before} - {i for i, _ in after}
            assert len(gone & set(range(150, 210))) >= 54 and len(gone - set(range(150, 210))) <= 8
        if name == "near_dedup":
            keep = {i for i, _, _, k in brute.near_duplicates([x for x in before if x[0] is not None]) if k}
            assert {i for i, _ in after} == keep | {None} and len(after) == len(keep) + 1
        if name == "decontaminate":
            hit = {x[0] for x in brute.overlaps(before, [(1, item)]) if x[5]}
            assert {i for i, _ in after} == {i for i, _ in before} - hit and hit
        if name == "secrets":
            new = {x["doc_id"]: (x["text"], x["n_chars"]) for x in rows[name]}
            assert new[1003] == ("my [assign] is here", len("my [assign] is here"))
            assert all(new[i][0] == t for i, t in before if i != 1003)
    assert {x["doc_id"] for x in rows["packing"]} == {x["doc_id"] for x in rows["secrets"]}
    assert all(x["offset"] + x["length"] <= 4096 for x in rows["packing"])
    run = corpus_pipeline.run(spark, sf)
    assert sorted(x["ids_crc32"] for x in run.collect()) == sorted(x["ids_crc32"] for x in rows["packing"])


def test_near_dedup_links_from_four_fifths(spark, tmp_path):
    import corpus_pipeline
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdeknoru") for _ in range(8))
    rows = []
    for i in range(60):
        words = [word() for _ in range(104)]  # 100 shingles; n further words: 100 / (100 + n)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words + [word() for _ in range(18 + i % 12)]))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    after = {x["doc_id"] for x in corpus_pipeline.drop_near_duplicates(spark, d, str(tmp_path)).collect()}
    assert after == {i for i, _, _, k in brute.near_duplicates(rows, percent=80) if k}
    assert 60 < len(after) < len({i for i, _, _, k in brute.near_duplicates(rows) if k})


def test_registered():
    import __spark_entry__
    import corpus_pipeline
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontaminate", "secrets", "packing"]
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and {f"op{n}_" for n in range(1, 14)} == {x[:x.index("_") + 1] for x in names if x.startswith("op") and x[2].isdigit()}
