import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelmill.llm import mixing, permutation, sharding


@pytest.mark.parametrize("n", [0, 1, 2, 3, 16, 17, 1000, 65_537])
def test_permutation_is_a_bijection(n):
    assert sorted(permutation.permute(np.arange(n), n, 5)) == list(range(n))


def test_permutation_agrees_with_sql():
    sql = f"WITH RECURSIVE nums AS (SELECT range AS row_number FROM range(333)), {permutation.permutation_sql('nums', 'SELECT 333', 9)} SELECT slot FROM slots ORDER BY row_number"
    assert [r[0] for r in duckdb.sql(sql).fetchall()] == permutation.permute(np.arange(333), 333, 9).tolist()


def test_seeds_give_other_orders():
    assert permutation.permute(np.arange(100), 100, 1).tolist() != permutation.permute(np.arange(100), 100, 2).tolist()


def test_shards_differ_by_one_row_and_slots_are_gapless(documents):
    rows = sharding.shard_rows(documents, ["doc_id"], shards=4).collect()
    assert len(rows) == documents.count()
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    assert max(map(len, by_shard.values())) - min(map(len, by_shard.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())


def test_shards_do_not_depend_on_partitions(documents):
    unique = documents.dropDuplicates(["doc_id"])
    one, many = (sharding.shard_rows(unique.repartition(p), ["doc_id"], shards=3, partitions=p).select("doc_id", "shard", "slot").collect() for p in (1, 7))
    assert sorted(one, key=str) == sorted(many, key=str)


def test_empty_table_has_no_shards(documents):
    assert sharding.shard_rows(documents.limit(0), ["doc_id"]).count() == 0


def test_written_shards_come_back(documents, tmp_path, spark):
    sharded = sharding.shard_rows(documents, ["doc_id"], shards=3)
    sharding.write_shards(sharded, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == documents.count() and back.select("shard").distinct().count() == 3


def test_mix_takes_targets_exactly(documents):
    plan = mixing.mix_plan(documents).toPandas()
    assert len(plan) == documents.count()
    assert (plan["taken"] <= 3 * plan["size"]).all()
    for _, group in plan.groupby("source", dropna=False):
        assert group["taken"].sum() == int(np.floor(group["target"].iloc[0]))
    assert abs(sum(g["target"].iloc[0] for _, g in plan.groupby("source", dropna=False)) - plan["size"].sum()) < 1e-6


def test_targets_by_resharing_step_by_step(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 500, None: 80}
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    budget, target, free = float(sum(sizes.values())), {}, set(names)
    while free:
        level = (budget - sum(target.values())) / sum(weights[s] for s in free)
        over = {s for s in free if level * weights[s] > 3 * sizes[s]}
        if not over:
            target |= {s: level * weights[s] for s in free}
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        free -= over
    assert got == pytest.approx(target)


def test_mix_repeats_and_cuts_texts(documents):
    unique = documents.dropDuplicates(["doc_id"]).filter("doc_id IS NOT NULL")
    plan = {r["doc_id"]: r["taken"] for r in mixing.mix_plan(unique).collect()}
    mixed = mixing.mix(unique)
    assert mixed.columns == unique.columns
    words = {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    assert words == {d: n for d, n in plan.items() if n}


def test_mix_keeps_its_budget_with_repeated_ids(spark):
    rows = [(1, "a b c", "x"), (1, "d e f", "x"), (1, "a b c", "x"), (1, "a b c", "y"), (None, "a b", "x"), (None, "c d", "x"), (None, None, None), (2, "g h", None), (3, " ".join("w" * 40), "z")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, size string").repartition(3)
    plan = {r["source"]: r["n"] for r in mixing.mix_plan(docs).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    written = {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    assert written == {s: n for s, n in plan.items() if n}
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mixing.mix(docs.repartition(1)).collect()))


def test_mix_of_nothing(documents):
    assert mixing.mix_plan(documents.limit(0)).count() == 0
    assert mixing.mix(documents.limit(0)).count() == 0


def test_first_words(spark):
    row = spark.createDataFrame([("  a  b\tc\n d ",)], "t string").select(mixing.first_words(F.col("t"), F.lit(2)).alias("x")).first()
    assert row["x"] == "  a  b"
