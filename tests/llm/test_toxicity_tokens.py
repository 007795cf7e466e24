import hashlib
import json
import random
import shutil
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest

from voxelmill.llm import token_shards, toxicity
from voxelmill.llm.shared import shared_folder
from voxelmill.llm.words import shingle_hashes, word_table


def sentences(n, seed=0):
    random_ = np.random.default_rng(seed)
    bad = ["idiot", "scum", "trashy"]
    texts, labels = [], []
    for i in range(n):
        words = [f"w{random_.integers(0, 200)}" for _ in range(12)]
        if i % 3 == 0:
            words[int(random_.integers(0, 12))] = bad[i % 2] + ("s" if i % 5 == 0 else "")
        texts.append(" ".join(words))
        labels.append(int(i % 3 == 0))
    return texts, np.array(labels)


def fitted(spark, texts, labels, **options):
    """A model of texts whose ids are all in the training part."""
    ids = [i for i in range(4 * len(texts) + 40) if zlib.crc32(str(i).encode()) % 3 != 1][: len(texts)]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(y)) for i, y in zip(ids, labels, strict=True)], "doc_id long, toxic int")
    return toxicity.fit(docs, marks, **options)


def scored(model, texts):
    return toxicity.scores(model, texts, toxicity.lookup_table(model.features))


def test_held_out_accuracy(spark):
    texts, labels = sentences(600)
    model = fitted(spark, texts, labels)
    fresh, truth = sentences(300, seed=1)
    assert ((scored(model, fresh) >= toxicity.THRESHOLD) == truth).mean() > 0.97


def named_mostly_in_toxic_texts():
    random_ = np.random.default_rng(0)
    texts = []
    for i in range(400):
        named = random_.random() < (0.9 if i % 2 else 0.05)
        texts.append(f"Word w{i} here. Then v{i % 7}" + (" idiot" if random_.random() < (0.8 if i % 2 else 0.1) else "") + (" gay" if named else "") + ".")
    return texts, [i % 2 for i in range(400)]


def test_counterfactual_penalty_levels_group_names(spark):
    gap = []
    for strength in (0.0, toxicity.COUNTERFACTUAL):
        a, b, c = scored(fitted(spark, *named_mostly_in_toxic_texts(), counterfactual=strength), ["the gay people w3", "the people w3", "the muslim people w3"])
        gap.append(max(abs(a - b), abs(a - c)))
    assert gap[1] < gap[0] / 5 and gap[1] < 0.05


def test_terms_are_a_parameter(spark):
    texts, labels = named_mostly_in_toxic_texts()
    texts = [t.replace("gay", "martian") for t in texts]
    model = fitted(spark, texts, labels, terms=("martian", "venusian"))
    a, b = scored(model, ["the martian came w3", "the venusian came w3"])
    other = fitted(spark, texts, labels)
    c, d = scored(other, ["the martian came w3", "the venusian came w3"])
    assert abs(a - b) < 0.05 < abs(c - d)


def test_the_penalty_acts_on_texts_that_name_no_group(spark):
    """In the query's own fit there are changes, and swaps leave scores where they are."""
    folder = "/root/testdata/sf0.001"
    docs, marks = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    labelled = toxicity.labelled_features(docs, marks).cache()
    chosen = toxicity.choose_features(labelled, labelled.count(), labelled.filter("toxic = 1").count(), np.unique(toxicity.feature_pairs([" ".join(toxicity.IDENTITY_TERMS)])[1]))
    examples = toxicity.examples_of(labelled, chosen)
    assert len(examples.change_times) > 0 and len(examples.change_at) > len(examples.change_times)
    assert examples.change_times.sum() > 0.9 * toxicity.TURNS * labelled.count()  # hashes of swapped words may coincide
    model = toxicity.train(examples, chosen)
    texts = [pair for r in docs.select("text").collect() for pair in toxicity.counterfactuals(r["text"])]
    assert texts and np.abs(scored(model, [a for a, _ in texts]) - scored(model, [b for _, b in texts])).max() < 0.05


def test_swaps():
    assert toxicity.swapped("A Muslim spoke", 0) == "A people spoke"
    assert "muslim" not in toxicity.swapped("a muslim, a gay man", 1)
    for odd in ("h\u0131ndu", "chri\u017ftian", "JEW\u0130SH", "\u00fcmuslim", "muslim's"):
        assert toxicity.swapped(odd, 1) == odd


def test_counterfactual_sentences():
    pairs = toxicity.counterfactuals("A Muslim spoke. Nobody else did! A deaf man came.")
    assert len(pairs) == 2 * toxicity.TURNS and {a for a, _ in pairs} == {"A Muslim spoke.", "A deaf man came."}
    made = toxicity.counterfactuals("Nothing of that kind. Here neither.")
    assert len(made) == toxicity.TURNS and made == toxicity.counterfactuals("Nothing of that kind. Here neither.")
    assert toxicity.counterfactuals(None) == toxicity.counterfactuals(" \n ") == []
    assert len(toxicity.counterfactuals("A gay man. " * 5000)) == 5000 * toxicity.TURNS


def test_all_sentences_of_a_long_text_count(spark):
    """Equal changes are kept once, with how often they come, so a long text takes no more room."""
    docs = spark.createDataFrame([(1, "A gay man spoke. " * 4000 + "The deaf came. " * 1000), (2, "nobody is here")], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    row = toxicity.labelled_features(docs, marks).filter("doc_id = 1").first()
    assert sum(c["times"] for c in row["changes"]) == 5000 * toxicity.TURNS and len(row["changes"]) == 2 * toxicity.TURNS


def test_one_class_or_none(spark):
    assert fitted(spark, [], []).constant == 0.0
    assert scored(fitted(spark, ["a", "b"], [1, 1]), ["x", None]).tolist() == [1.0, 1.0]
    assert np.isfinite(scored(fitted(spark, ["", None, "x", "y"], [1, 1, 0, 0]), ["x", None])).all()


def test_scores_of_odd_tables(documents, spark):
    texts, labels = sentences(60)
    labelled = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    marks = spark.createDataFrame([(1000 + i, int(y)) for i, y in enumerate(labels)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    sample = {r["doc_id"] for r in toxicity.labelled_features(labelled, marks).collect()}
    assert sample == {d for d in range(1000, 1060) if zlib.crc32(str(d).encode()) % 3 != 1}
    model = toxicity.fit(labelled, marks)
    rows = toxicity.score_documents(documents.withColumnRenamed("shard", "score"), model).collect()
    assert len(rows) == documents.count() and all(0 <= r["score"] <= 1 for r in rows)
    by_text = {}
    for r in rows:
        assert by_text.setdefault(r["text"] or "", r["score"]) == r["score"]
    assert toxicity.score_documents(documents.limit(0), model).count() == 0


def test_query_on_the_small_tables(spark):
    rows = toxicity.op10_toxicity(spark, "/root/testdata/sf0.01").collect()
    marks = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("toxic is not null").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    truth = [(r["predicted"], marks[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in marks]
    assert len(truth) > 50 and np.mean([p == y for p, y in truth]) > 0.95


def test_words_by_hand():
    texts = ["A b\tC", None, "", "  x ", "ü" * 5, "one\x00two " * 3]
    hashes, first, starts, ends, _ = word_table(texts, lower=True)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        assert [raw[a:b] for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]], strict=True)] == raw.split()
    assert len(shingle_hashes(hashes[first[0] : first[1]], 5)) == 1 and len(shingle_hashes(hashes[:0], 5)) == 0


def test_long_words_and_texts_across_blocks(monkeypatch):
    from voxelmill.llm import words

    texts = ["a" * 5000 + " b", " ".join(f"w{i}" for i in range(2000)), "c " * 3000]
    whole = word_table(texts)[0]
    monkeypatch.setattr(words, "BLOCK", 512)
    assert np.array_equal(word_table(texts)[0], whole)


@pytest.mark.parametrize(("length", "shard_sequences"), [(8, 5), (512, 65_536)])
def test_token_files_round_trip(documents, spark, tmp_path, length, shard_sequences):
    stored = str(tmp_path / "docs")
    documents.repartition(3).write.parquet(stored)
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = str(tmp_path / "out")
    index = token_shards.write_token_shards(spark, stored, out, vocabulary, length, shard_sequences)
    entries = index.collect()
    total = len(entries)
    assert sorted(e["slot"] for e in entries) == list(range(total))
    read = {r["slot"]: np.frombuffer(bytes(r["tokens"]), "<u2") for r in token_shards.read_token_shards(spark, out, total, length, shard_sequences).collect()}
    texts = {}
    for r in documents.collect():
        texts.setdefault(r["doc_id"], set()).add(r["text"])
    for doc_id, variants in texts.items():
        own = sorted((e for e in entries if e["doc_id"] == doc_id), key=lambda e: e["sequence"])
        if len([e for e in own if e["sequence"] == 0]) == 1:
            tokens = np.concatenate([read[e["slot"]][: e["n_tokens"]] for e in own]).tolist()
            assert tokens == [*token_shards.ids_of(next(iter(variants)), vocabulary).tolist(), token_shards.encoding(vocabulary)[1]]
    assert all((read[e["slot"]][e["n_tokens"] :] == token_shards.PAD).all() for e in entries)
    if total > 12:
        part = token_shards.read_token_shards(spark, out, total, length, shard_sequences, 7, 12).collect()
        assert sorted(r["slot"] for r in part) == [7, 8, 9, 10, 11] and all(np.array_equal(np.frombuffer(bytes(r["tokens"]), "<u2"), read[r["slot"]]) for r in part)


def test_ids_without_looking_ahead():
    """The pattern that texts are matched with looks nowhere ahead, and their ids are those of the tokenizer's own pattern."""
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    fast = token_shards.encoding(path)[0]
    assert "(?!" not in fast._pat_str
    whole = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=fast._mergeable_ranks, special_tokens={})
    letters = [" ", " ", " ", "\n", "\r", "\t", "\x1c", "\x1f", "\x85", "\xa0", "\u2028", "\u3000", "\u200b", "a", "Zé", "1", "'s", "'ll", "!", "漢", "\u0301", "<|endoftext|>"]
    draw = random.Random(3)
    for text in ["".join(draw.choices(letters, k=n % 13)) for n in range(20_000)]:
        assert token_shards.ids_of(text, path).tolist() == whole.encode_ordinary(text), repr(text)
    assert len(token_shards.ids_of(None, path)) == 0


def test_sequences_are_numbered_in_storage_order(spark):
    """Whatever the number of ranges: prefix sums over files, then rows, with ties of files across ranges."""
    stretches = [(f"f{i % 7}", 100 * (i // 7), i % 5 + 1) for i in range(60)]
    table = spark.createDataFrame(stretches, "file string, row long, sequences long").repartition(5)
    expected, total = {}, 0
    for file, row, n in sorted(stretches):
        expected[file, row] = total
        total += n
    for partitions in (1, 4, 90):
        firsts, n = token_shards.first_sequences(table, partitions)
        assert n == total and {(r["file"], r["row"]): r["first"] for r in firsts.collect()} == expected


def test_token_files_are_the_same_without_broadcasts(documents, spark, tmp_path):
    """Beyond Spark's bound of size the stretches are joined by merging: equal slots."""
    stored = str(tmp_path / "docs")
    documents.repartition(3).write.parquet(stored)
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    tables = []
    try:
        for threshold in (bound, "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            index = token_shards.write_token_shards(spark, stored, str(tmp_path / f"out{threshold}"), vocabulary, 8, 5)
            tables.append(sorted(map(tuple, index.select("slot", "sequence", "n_tokens").collect())))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
    assert tables[0] == tables[1] and len(tables[0]) > 12


def test_texts_are_encoded_once(documents, spark, tmp_path, monkeypatch):
    """Once the sequences are counted the documents aren't read again, and what is kept between is gone afterwards."""
    stored, counted = str(tmp_path / "docs"), token_shards.first_sequences
    documents.repartition(3).write.parquet(stored)

    def counted_and_gone(splits, partitions):
        found = counted(splits, partitions)
        shutil.rmtree(stored)
        return found

    monkeypatch.setattr(token_shards, "first_sequences", counted_and_gone)
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = {x.name for x in folder.iterdir()} if folder.exists() else set()
    out = tmp_path / "out"
    index = token_shards.write_token_shards(spark, stored, str(out), public_tokenizers.path("byte_bpe_50k.tiktoken"), 8, 5)
    total = index.count()
    read = token_shards.read_token_shards(spark, str(out), total, 8, 5)
    assert total > 12 and index.join(read, ["shard", "slot"]).count() == total
    assert {x.name.rsplit("-", 1)[0] for x in folder.iterdir() if x.name not in before} == {"token-ranges", "token-index"}
    for shard in range(-(-total // 5)):
        data, note = (out / token_shards.shard_name(shard)).read_bytes(), json.loads((out / f"{token_shards.shard_name(shard)}.json").read_text())
        assert note == {"shard": shard, "sequences": min(5, total - 5 * shard), "length": 8, "sha256": hashlib.sha256(data).hexdigest()}
        assert len(data) == 16 * note["sequences"]


def test_no_documents_no_token_files(documents, spark, tmp_path):
    stored = str(tmp_path / "docs")
    documents.limit(0).write.parquet(stored)
    assert token_shards.write_token_shards(spark, stored, str(tmp_path / "out"), public_tokenizers.path("byte_bpe_50k.tiktoken")).count() == 0


def test_vocabularies_that_need_more_bits_are_refused(tmp_path):
    import base64

    path = tmp_path / "large.tiktoken"
    path.write_text("".join(f"{base64.b64encode(bytes([i])).decode()} {i}\n" for i in range(255)) + f"{base64.b64encode(bytes([255])).decode()} {token_shards.PAD - 1}\n")
    with pytest.raises(ValueError, match="16 bits"):
        token_shards.encoding(str(path))
