"""The pipeline on a small corpus: what each stage must drop, keep and give."""

import random
import sys
import time
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def corpus():
    picked = random.Random(5)
    words = lambda n: [f"w{picked.randint(0, 3000)}" for _ in range(n)]
    texts = {i: words(40) + (["idiot", "scum"] if i % 4 == 0 else []) for i in range(80)}
    labels = [(i, 1, int(i % 4 == 0)) for i in range(60)]
    base, passage = words(90), words(60)
    texts[100], texts[101] = base, [*base[:50], "changed", *base[51:]]
    texts[102], texts[103] = list(base), words(30) + passage + words(20)
    texts[104] = words(10) + passage + words(45)
    rows = [(i, " ".join(t), "en", f"s{i % 3}", len(" ".join(t))) for i, t in texts.items()]
    return rows + [(200, None, None, None, None), (201, "", "en", None, 0), (None, "no id here", "fr", "s1", 10), (5, " ".join(texts[5]), "en", "s2", 1)], labels, texts


def written(spark, folder, rows, labels):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages_in_order(spark, tmp_path):
    rows, labels, texts = corpus()
    folder = written(spark, tmp_path, rows, labels)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/stage-{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage-{k}")
        kept[name] = docs.collect()
        assert k == 4 or docs.columns == columns
    ids = {name: {r["doc_id"] for r in found} for name, found in kept.items()}
    assert not {i for i in range(80) if i % 4 == 0} & ids["toxicity"] and {i for i in range(80) if i % 4} | {100, 101, 103, 200, 201, None} <= ids["toxicity"]
    assert ids["toxicity"] - ids["n-gram Jaccard join"] == {101, 102}
    cut = {r["doc_id"]: r["text"] for r in kept["substring dedup"]}
    assert cut[104].split() == texts[104][:10] + texts[104][70:] and cut[103] == " ".join(texts[103])
    assert ids["substring dedup"] == ids["n-gram Jaccard join"]
    mixed = kept["mixing sources to target weights"]
    assert {r["doc_id"] for r in mixed} <= ids["substring dedup"] and all(r["text"] for r in mixed)
    last = kept["BPE encoding and decoding"]
    assert sorted(str(r["doc_id"]) for r in last) == sorted(str(r["doc_id"]) for r in mixed) and all(r["n_tokens"] == len(r["ids"]) for r in last)
    again = corpus_pipeline.run(spark, folder).collect()
    assert sorted((str(r["doc_id"]), r["ids_sha256"]) for r in again) == sorted((str(r["doc_id"]), r["ids_sha256"]) for r in last)


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, written(spark, tmp_path, [], [])).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "n-gram Jaccard join", "substring dedup", "mixing sources to target weights", "BPE encoding and decoding"]
    with pytest.raises(Exception):
        corpus_pipeline.run(spark, f"{tmp_path}/nothing")


def test_what_a_table_between_jobs_shuffled_is_deleted_with_its_job(spark):
    """Disk holds the shuffle of the job at work, not those of all jobs before it; the session's setting stays as it was."""
    from voxelmill import shared

    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {f.getName() for f in map(manager.getAllFiles().apply, range(manager.getAllFiles().size())) if f.getName().startswith("shuffle_")}
    before, setting = shuffles(), spark.conf.get(shared.CLEANUP, None)
    table = shared.stored(spark.range(20000).repartition(5, "id"), "kept-table")
    until = time.monotonic() + 5  # the files go beside the driver's work
    while shuffles() - before and time.monotonic() < until:
        time.sleep(0.1)
    assert not shuffles() - before
    assert table.count() == 20000
    assert spark.conf.get(shared.CLEANUP, None) == setting
