"""The corpus pipeline against a plain version of its stages."""

import random
import re

import pytest
from pyspark.sql import functions as F

from test_operators import components, lower, words_of

FIELDS = "doc_id long, text string, lang string, source string, n_chars long, score double, score_ int, found int, kinds string, text_ string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, out = random.Random(6), tmp_path_factory.mktemp("sf")
    common, leak = words_of(50, 400), words_of(51, 40)
    rows, labels = [], []
    for i in range(300):
        w, bad = [rng.choice(common) for _ in range(rng.randint(30, 120))], i % 5 == 1
        if bad:
            w[3:3] = ["###"] * 40
        if i % 29 == 0:
            w[9:9] = leak
        if i % 23 == 0:
            w[4:4] = ["password", "=", f"hunter{i:08d}"]
        rows.append((i, " ".join(w)))
        labels.append((i, int(not bad), 0))
    good = [t for i, t in rows if i % 5 != 1 and i % 29]
    rows += [(400, good[0]), (401, good[1] + " more"), (402, None), (403, ""), (404, "short one"), (405, " ".join(words_of(60, 30_000))), (406, good[2]), (406, good[2]), (407, " ".join(words_of(61, 50)))]
    rows += [(407, " ".join(words_of(62, 50))), (None, " ".join(words_of(63, 20) + leak)), (None, " ".join(words_of(64, 60)))]
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.25, 1, 2, "k", "t") for i, t in rows], FIELDS).repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, " ".join(leak)), (2, None)], "item_id long, text string").coalesce(1).write.parquet(f"{out}/benchmark.parquet")
    return out, leak


def test_stages_by_a_plain_version(spark, folder):
    import corpus_pipeline
    from pipequery.llm import quality_model
    from pipequery.llm.packing import byte_bpe

    sf, leak = folder
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] is not None, r["text"] or "")
    plain = sorted(docs.collect(), key=key)
    model = quality_model.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    scores = {(r["doc_id"], r["text"]): r["s"] for r in quality_model.score(docs.select("doc_id", "text"), model).select("doc_id", "text", F.col("score").alias("s")).collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "quality_classifier":
            plain = [r.asDict() for r in plain if scores[r["doc_id"], r["text"]] >= 0.3]
            assert 200 < len(plain) < 300
        elif name == "minhash_near_dedup":
            of: dict = {}
            for r in plain:
                of.setdefault(r["doc_id"], []).append(r)
            groups = components([(i, " ".join(r["text"] or "" for r in rs)) for i, rs in of.items() if i is not None and len({r["text"] for r in rs}) == 1])
            plain = [r for i, rs in of.items() for r in ({x["text"]: x for x in rs}.values() if i is not None else rs) if i is None or i not in groups or groups[i][1] == i]
            assert not {400, 406} & {r["doc_id"] for r in plain} and sum(r["doc_id"] == 407 for r in plain) == 2
        elif name == "benchmark_decontamination":
            plain = [r for r in plain if " ".join(leak) not in lower(r["text"])]
        else:
            for r in plain:
                if r["text"]:
                    text = re.sub(r"password = hunter\d+", "[SECRET]", r["text"])
                    r |= {"text": text, "n_chars": len(text)}
        docs = stage(spark, docs, str(sf))
        assert docs.columns == [x.split()[0] for x in FIELDS.split(", ")]
        assert sorted((r.asDict() for r in docs.collect()), key=key) == sorted(plain, key=key), name
    pieces = corpus_pipeline.run(spark, str(sf)).collect()
    encode, sizes = byte_bpe()(), {}
    for p in pieces:
        sizes.setdefault(p["doc_id"], []).append(p["length"])
    wanted: dict = {}
    for r in plain:
        wanted[r["doc_id"]] = wanted.get(r["doc_id"], 0) + len(encode(r["text"] or "")) + 1
    assert {i: sum(x) for i, x in sizes.items()} == wanted
    held: dict = {}
    for p in pieces:
        held.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for places in held.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 1024


def test_no_documents(spark, folder, tmp_path):
    import corpus_pipeline

    sf, _ = folder
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
