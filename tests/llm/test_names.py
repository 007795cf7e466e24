"""Columns called like those that operators add on their way come through unchanged."""

from voxelmill.llm import mixing, substrings
from voxelmill.llm.names import freed


def test_clashing_columns_of_the_mix(spark):
    own = [c for c in mixing.OWN_COLUMNS if c != "_id"]
    rows = [(i, "one two three", "a", *[f"{c}{i}" for c in own], f"ID{i}", "free") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in own) + ", `_ID` string, `_ID_` string")
    found = mixing.mix(docs)
    assert found.columns == docs.columns
    assert sorted(map(tuple, found.collect())) == sorted(rows)


def test_clashing_columns_of_cut_passages(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text + " first", "a", "b"), (2, "second " + text, "c", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _spans string, _ID string")
    found = {r["doc_id"]: r for r in substrings.without_passages(docs, substrings.repeated_passages(docs)).collect()}
    assert tuple(found[1]) == rows[0] and (found[2]["_spans"], found[2]["_ID"]) == ("c", "d") and "w30" not in found[2]["text"]


def test_names_stay_where_none_clashes(spark):
    docs = spark.range(1)
    assert freed(docs, ("_id",))[0].columns == ["id"] and freed(docs, ("_id",))[1] == {}
