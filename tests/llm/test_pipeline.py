import random

import corpus_pipeline
from gridloom.llm import minhash, quality, secrets
from gridloom.llm.common import table

from .test_minhash import brute


def folder(spark, where, seed=0):
    rng, rows, labels = random.Random(seed), [], []
    word = lambda: "".join(rng.choice("etaoinshrdl") for _ in range(rng.randint(2, 9)))
    for d in range(260):
        words = [word() for _ in range(rng.randint(15, 120))]
        if bad := rng.random() < 0.25:
            words = [w.upper() + "!!" for w in words]
        elif rng.random() < 0.2:
            words.insert(5, "password=abcdefghijkl1")
        text = " ".join(words)
        rows += [(1000 * n + d, text if n < 2 else f"{text} {word()}") for n in range(rng.choice([1, 1, 2, 3]))]
        labels.append((d, 0 if bad else 1, 0))
    rows += [(5000, None), (5001, ""), (None, "no id " * 9), (rows[0][0], rows[0][1])]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return rows


def test_stages_against_brute_force(spark, tmp_path):
    where = str(tmp_path / "t")
    folder(spark, where)
    docs = table(spark, where, "documents")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "secrets", "packing"]
    good = corpus_pipeline.keep_good(spark, docs, where).cache()
    model = quality.train(docs, table(spark, where, "labels"))
    every = docs.collect()
    scores = model.scores([r["text"] for r in every])
    assert sorted(map(str, good.collect())) == sorted(str(r) for r, s in zip(every, scores, strict=True) if s >= 0.3)
    one = corpus_pipeline.deduplicate(spark, good, where).cache()
    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    want = {(d, t) for (d, t), (_, n, c) in zip(rows, brute(rows, minhash.SHINGLE), strict=True) if d == c or not n}
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in one.collect()))) == sorted(map(str, want))
    clean = corpus_pipeline.mask_secrets(spark, one, where)
    assert good.columns == one.columns == clean.columns == columns
    assert sorted(str(r["text"]) for r in clean.collect()) == sorted(str(secrets.mask_text(r["text"])) for r in one.collect())
    got = corpus_pipeline.run(spark, where)
    packed = corpus_pipeline.pack(spark, clean, where)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(str, got.select(key).collect())) == sorted(map(str, packed.select(key).collect()))


def test_empty_tables(spark, tmp_path):
    where = str(tmp_path / "t")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    assert corpus_pipeline.run(spark, where).count() == 0


def test_odd_rows_pass_every_stage(spark, tmp_path):
    """Very long texts, repeats, ties at the threshold, nulls, and columns named like the stages' own."""
    where, rng = str(tmp_path / "t"), random.Random(3)
    tie = [f"w{n}" for n in range(40)]
    other = [*tie[:36], *[f"z{n}" for n in range(4)]]  # 32 of 40 shingles shared: exactly 0.8
    assert 100 * 32 == 80 * (36 + 36 - 32)
    rows = [(1, " ".join(tie)), (2, " ".join(other)), (3, None), (4, ""), (4, ""), (None, "no id"), (5, "long " * 60_000 + "secret: abcdefghijkl99"), (6, "x" * 120_000), (7, " \n ")]
    rows += [(100 + n, " ".join(rng.choices("alpha beta gamma delta epsilon zeta".split(), k=60))) for n in range(30)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), 0.5, "k", d, 1.0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, node string, item long, predicted double")
    docs.write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(d, d % 2, 0) for d in range(100, 130)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    docs = table(spark, where, "documents")
    good = corpus_pipeline.keep_good(spark, docs, where)
    one = corpus_pipeline.deduplicate(spark, docs, where).cache()
    clean = corpus_pipeline.mask_secrets(spark, one, where)
    assert good.columns == one.columns == clean.columns == docs.columns and good.count() <= docs.count()
    ids = [r["doc_id"] for r in one.collect()]
    assert 1 in ids and 2 not in ids and {3, 4, 5, 6, 7} <= set(ids)
    assert next(r["text"] for r in clean.where("doc_id = 5").collect()).endswith("[assign]")
    packed = corpus_pipeline.pack(spark, clean, where)
    assert packed.where("doc_id = 5").count() > 1 and packed.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 2048").count() == 0
    assert corpus_pipeline.run(spark, where).count() > 0
