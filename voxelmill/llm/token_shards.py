"""Training-order token files: fixed-stride shards whose order is a keyed permutation of all sequences."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrow import small_batches, stretches
from .bpe import SPACE
from .permutation import permuted
from .shared import dropped, fresh_path, stored
from .warc import open_store

LENGTH = 512
SHARD_SEQUENCES = 65_536
SEED = 20240229
#: The number after the vocabulary's ends a document; PAD fills its last sequence.
PAD = 65_535
FILL = b"\xff"  # each of PAD's two bytes
INDEX_FIELDS = "shard int, slot long, doc_id long, sequence int, n_tokens int"
#: The part of the tokenizer's pattern that looks ahead, at many times the cost of the rest: white space but for its last character
#: where something follows. Texts are cut there instead. REPEATED is wider by \x1c to \x1f, where CUT finds nothing; the class by name is sought faster.
AHEAD = r"|\s+(?!\S)"
REPEATED, CUT = re.compile(r"\s\s"), re.compile(f"(?<=[{SPACE}])(?=[{SPACE}][^{SPACE}])")
CUT_FIELDS = "file string, row long, number long, doc_id long, sequence int, n_tokens int, tokens binary"


@lru_cache(maxsize=2)
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    end = max(ranks.values()) + 1
    if end >= PAD:
        raise ValueError(f"ids up to {end} and the mark for filling up don't fit into 16 bits")
    if not public_tokenizers.PATTERN.endswith(rf"{AHEAD}|\s+"):
        raise ValueError(f"the tokenizer's pattern isn't the one that texts are cut for: {public_tokenizers.PATTERN}")
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN.replace(AHEAD, ""), mergeable_ranks=ranks, special_tokens={}), end


def id_list(text: str | None, path: str) -> list[int]:
    """The text's ids without the end mark; special tokens' strings are ordinary text."""
    encode, text = encoding(path)[0].encode_ordinary, text or ""
    if not REPEATED.search(text):
        return encode(text)
    return [i for part in CUT.split(text) for i in encode(part)]


def packed_ids(text: str | None, path: str) -> bytes:
    """The text's ids as 16-bit numbers, little-endian."""
    ids = id_list(text, path)
    return struct.pack(f"<{len(ids)}H", *ids)


def ids_of(text: str | None, path: str) -> np.ndarray:
    return np.frombuffer(packed_ids(text, path), np.dtype("<u2"))


def source_rows(spark: SparkSession, documents: str) -> DataFrame:
    """The stored table's rows with where they stand: file and row in it, whatever the splits."""
    return small_batches(spark.read.parquet(documents)).select("doc_id", "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def cut_sequences(rows: DataFrame, vocabulary: str, length: int) -> DataFrame:
    """The sequences of all rows, the last one of a text not filled up: a row each, with the file and the first row of the stretch
    of rows that the task read, and the number in this stretch."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, begin, number, end, step = None, 0, 0, struct.pack("<H", encoding(vocabulary)[1]), 2 * length
        for ids, texts, files, places in stretches(batches, ["doc_id", "text", "file", "row"]):
            owners, parts, sequences, numbers, begins, names = [], [], [], [], [], []
            for doc_id, text, file, row in zip(ids, texts, files, places, strict=True):
                if file != last:
                    last, begin, number = file, row, 0
                data = packed_ids(text, vocabulary) + end
                n = -(-len(data) // step)
                owners += [doc_id] * n
                parts += [data[i * step : (i + 1) * step] for i in range(n)]
                sequences += range(n)
                numbers += range(number, number + n)
                names += [file] * n
                begins += [begin] * n
                number += n
            counts = [len(x) // 2 for x in parts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(begins, pa.int64()), pa.array(numbers, pa.int64()), pa.array(owners, pa.int64()), pa.array(sequences, pa.int32()), pa.array(counts, pa.int32()), pa.array(parts, pa.binary())],
                names=["file", "row", "number", "doc_id", "sequence", "n_tokens", "tokens"],
            )

    return rows.mapInArrow(cut, CUT_FIELDS)


def first_sequences(splits: DataFrame, partitions: int) -> tuple[DataFrame, int]:
    """(file, row, first): the number of each stretch's first sequence, in order of file and row; and how many sequences there are.

    Sums by range of the order, their prefix sums, and running sums within a range.
    """
    ranged = stored(splits.repartitionByRange(partitions, "file", "row").withColumn("part", F.spark_partition_id()), "token-ranges")
    sums = {r[0]: r[1] for r in ranged.groupBy("part").agg(F.sum("sequences")).collect()}  # a number for each of the partitions chosen above
    befores, total = [], 0
    for part in sorted(sums):
        befores.append((part, total))
        total += sums[part]
    inside = F.sum("sequences").over(Window.partitionBy("part").orderBy("file", "row").rowsBetween(Window.unboundedPreceding, 0)) - F.col("sequences")
    before = F.broadcast(splits.sparkSession.createDataFrame(befores, "part int, before long"))
    return ranged.withColumn("inside", inside).join(before, "part").select("file", "row", (F.col("before") + F.col("inside")).alias("first")), total


def write_token_shards(
    spark: SparkSession,
    documents: str,
    out: str,
    vocabulary: str,
    length: int = LENGTH,
    shard_sequences: int = SHARD_SEQUENCES,
    seed: int = SEED,
) -> DataFrame:
    """Writes a stored table's texts as token files under ``out``, a folder that all machines share; returns the index.

    A text's ids and its end mark are cut into sequences of ``length`` 16-bit numbers (little-endian), the last one
    filled up with PAD. Sequences are numbered in storage order (file, row, place in the text); the permutation of these
    numbers under ``seed`` gives every sequence its slot. Slot s stands in shard s div ``shard_sequences`` at byte
    (s mod ``shard_sequences``) * 2 * ``length``: a reader can begin anywhere and resume by slot alone. The index has
    (shard, slot, doc_id, sequence, n_tokens) for every sequence. Null and empty texts have one sequence, the end mark;
    repeated rows are written as often as they stand there; an empty table gives no shards. Vocabularies whose ids and two
    marks don't fit into 16 bits are refused. Texts are encoded once: their sequences are a table, whose stretches are counted
    and which then is dealt out by shard. A task packs a shard, and when the table and what was shuffled are gone, a task
    unpacks it, so that these and the shards, filled up, don't lie on the disk together. A shard's file has its name only
    once it is whole.
    """
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    sequences = stored(cut_sequences(source_rows(spark, documents), vocabulary, length), "token-sequences", "zstd")
    firsts, total = first_sequences(sequences.groupBy("file", "row").agg(F.count(F.lit(1)).alias("sequences")), parts)
    firsts = stored(firsts, "token-firsts")
    shards = -(-total // shard_sequences)
    # no hint: Spark broadcasts the stretches' table up to its own bound of size, and merges by stretch beyond it
    numbered = sequences.join(firsts, ["file", "row"])
    placed = numbered.withColumn("slot", permuted(F.col("first") + F.col("number"), total, seed)).withColumn("shard", F.floor(F.col("slot") / shard_sequences).cast("int"))
    dealt = placed.select("shard", "slot", "doc_id", "sequence", "n_tokens", "tokens").repartitionById(max(1, shards), F.col("shard")).sortWithinPartitions("slot")
    packed = fresh_path(spark, "token-packed")
    index = stored(pack_shards(dealt, packed), "token-index")
    dropped(sequences, firsts)
    unpack_shards(spark, packed, out, shards, length).count()
    if shards:
        fs, root = open_store(packed)
        fs.delete_dir(root)
    return index


def pack_shards(dealt: DataFrame, packed: str) -> DataFrame:
    """Writes each partition's tokens, those of one shard in order of slots, as an Arrow file under ``packed``; returns the other columns."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_store(packed)
        name = f"{root}/{uuid.uuid4().hex}"
        shard, stream, writer = None, None, None
        for batch in batches:
            if writer is None and len(batch):
                shard = batch.column(0)[0].as_py()
                fs.create_dir(root, recursive=True)
                stream = fs.open_output_stream(name)
                writer = pa.ipc.new_stream(stream, pa.schema([("tokens", pa.binary())]), options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3)))
            if len(batch):
                writer.write_batch(pa.RecordBatch.from_arrays([batch.column(5)], names=["tokens"]))
            yield pa.RecordBatch.from_arrays(batch.columns[:5], names=batch.schema.names[:5])
        if writer is not None:
            writer.close()
            stream.close()
            fs.move(name, f"{root}/{shard_name(shard)}")

    return dealt.mapInArrow(pack, INDEX_FIELDS)


def unpack_shards(spark: SparkSession, packed: str, out: str, shards: int, length: int) -> DataFrame:
    """Writes the shards' files and their manifests from the packed ones, each by one task; a row for each shard."""
    full = 2 * length

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (fs, root), (source, folder) = open_store(out), open_store(packed)
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                attempt = f"{root}/_temporary/{uuid.uuid4().hex}"
                fs.create_dir(attempt, recursive=True)
                digest, records = hashlib.sha256(), 0
                with source.open_input_stream(f"{folder}/{shard_name(shard)}") as file, fs.open_output_stream(f"{attempt}/tokens") as stream:
                    for part in pa.ipc.open_stream(file):
                        data = b"".join([x.ljust(full, FILL) for x in part.column(0).to_pylist()])
                        stream.write(data)
                        digest.update(data)
                        records += len(part)
                with fs.open_output_stream(f"{attempt}/manifest") as note:
                    note.write(json.dumps({"shard": shard, "sequences": records, "length": length, "sha256": digest.hexdigest()}, sort_keys=True).encode())
                fs.move(f"{attempt}/tokens", f"{root}/{shard_name(shard)}")
                fs.move(f"{attempt}/manifest", f"{root}/{shard_name(shard)}.json")
                fs.delete_dir(attempt)
            yield batch

    return spark.range(0, shards, 1, max(1, shards)).mapInArrow(unpack, "id long")


def shard_name(shard: int) -> str:
    return f"tokens-{shard:07d}.bin"


SEQUENCE_FIELDS = "shard int, slot long, tokens binary"


def read_token_shards(spark: SparkSession, out: str, total: int, length: int = LENGTH, shard_sequences: int = SHARD_SEQUENCES, begin: int = 0, end: int | None = None) -> DataFrame:
    """The sequences of slots ``begin`` to ``end`` - 1, each shard read by one task from its first slot on, in order."""
    end = total if end is None else min(end, total)
    first, last = begin // shard_sequences, -(-end // shard_sequences)
    numbers = spark.range(first, max(first, last), 1, max(1, last - first))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_store(out)
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                low, high = max(begin, shard * shard_sequences), min(end, (shard + 1) * shard_sequences)
                with fs.open_input_file(f"{root}/{shard_name(shard)}") as file:
                    file.seek((low - shard * shard_sequences) * 2 * length)
                    for slot in range(low, high, 2048):
                        n = min(2048, high - slot)
                        data = file.read(n * 2 * length)
                        if len(data) != n * 2 * length:
                            raise EOFError(f"shard {shard} is cut")
                        parts = [data[i * 2 * length : (i + 1) * 2 * length] for i in range(n)]
                        yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int32()), pa.array(range(slot, slot + n), pa.int64()), pa.array(parts, pa.binary())], names=["shard", "slot", "tokens"])

    return numbers.mapInArrow(read, SEQUENCE_FIELDS)


def op1_token_shards(spark, sf_dir: str) -> DataFrame:
    """Every sequence of all documents, read back from its shard: where it stands, its tokens' number and checksum."""
    import public_tokenizers

    out = fresh_path(spark, "token-shards")
    index = write_token_shards(spark, f"{sf_dir}/documents.parquet", out, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    read = read_token_shards(spark, out, index.count())

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(2).to_pylist()
            used = [int((np.frombuffer(x, np.dtype("<u2")) != PAD).sum()) for x in data]
            crcs = [zlib.crc32(x[: 2 * n]) for x, n in zip(data, used, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(used, pa.int32()), pa.array(crcs, pa.int64())], names=["slot", "n_read", "tokens_crc32"])

    back = read.mapInArrow(measured, "slot long, n_read int, tokens_crc32 long")
    return index.join(back.hint("merge"), "slot").select("doc_id", "sequence", "shard", "slot", F.col("n_read").alias("n_tokens"), "tokens_crc32")
