"""Exact byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word exactly one token can be the last of the prefix's encoding: the token that is a suffix of the
prefix and goes together with the last token of what stands before it. Suffix matches come from an automaton of all
tokens; whether two tokens go together is told by undoing their merges. Following the stored tokens back from the
word's end gives the encoding, in time linear in the word.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .arrow import with_python_columns

#: Stands for a vocabulary's end-of-word mark, as one character that the byte alphabet lacks.
END = "\n"
#: Of pieces between white space a worker keeps so many new ones, and as many that came before them; of words and of tested pairs half as many.
MOST_KEPT = 80_000
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
OTHER_SPACE = re.compile("[\x1c-\x1f]")
SPLIT = re.compile(f"[{SPACE}]+")


def byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves, the rest follow from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Kept:
    """A bounded store in two generations: what is asked for again moves to the new one, the old one goes as a whole."""

    def __init__(self, most: int):
        self.most = most
        self.new: dict = {}
        self.old: dict = {}

    def get(self, key):
        """The value, or None; a value from the old generation is kept on."""
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        self.new[key] = value


class PrefixEncoder:
    """A vocabulary with merges (a ``tokenizers`` file) as automaton, ranks and splits."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.mark = model.get("end_of_word_suffix") or ""
        plain = lambda token: token[: -len(self.mark)] + END if self.mark and token.endswith(self.mark) else token
        self.id_of = {plain(token): i for token, i in model["vocab"].items()}
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.text_of = {i: token for token, i in model["vocab"].items()} | {i: token for token, i in added.items()}
        self.added = added
        if odd := [token for token in added if "<" not in token or SPLIT.search(token) or OTHER_SPACE.search(token)]:
            raise ValueError(f"added tokens without '<', or with white space, aren't supported: {odd[:3]}")
        self.added_pattern = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.pattern = regex.compile(pattern.replace(r"\s", SPACE))
        self.letters = byte_letters()
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            left, right = self.id_of[plain(a)], self.id_of[plain(b)]
            whole = self.id_of[plain(a + b)]
            self.rank[whole], self.parts[whole], self.merged[left, right] = rank, (left, right), rank
        self.automaton = ahocorasick.Automaton()
        kept: dict[int, bool] = {}
        for token, i in self.id_of.items():
            if self.stands(i, kept):
                self.automaton.add_word(token, (i, len(token) - token.endswith(END), token.endswith(END)))
        self.automaton.make_automaton()
        self.pieces, self.words, self.pairs = Kept(MOST_KEPT), Kept(MOST_KEPT // 2), Kept(MOST_KEPT // 2)
        numbers = range(max(self.text_of, default=-1) + 1)
        self.strings = pa.array([self.text_of.get(i) for i in numbers], pa.string())

    def goes_together(self, a: int, b: int, before: float = float("inf")) -> bool:
        """Whether no merge across the boundary would have come before the merges that made tokens a and b.

        The later of the two tokens' last merges is undone again and again; at each step a merge of the pieces that
        touch mustn't have come before the merge just undone. At equal ranks the left one comes first.
        """
        rank, parts, merged = self.rank, self.parts, self.merged
        while True:
            if merged.get((a, b), before) < before:
                return False
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                before, a = ra, parts[a][1]
            else:
                before, b = rb + 1, parts[b][0]

    def stands(self, token: int, kept: dict[int, bool]) -> bool:
        """Whether a token's own letters are encoded as that token."""
        if token not in kept:
            if token in self.parts:
                a, b = self.parts[token]
                kept[token] = self.stands(a, kept) and self.stands(b, kept) and self.goes_together(a, b, self.rank[token])
            else:
                kept[token] = True
        return kept[token]

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Tokens of one word, given in byte letters."""
        n, pairs = len(word), self.pairs
        last, came = [-1] * (n + 1), [0] * (n + 1)
        for at, (token, length, ends) in self.automaton.iter(word + END if self.mark else word):
            end = n if ends else at + 1
            if last[end] >= 0 or (end == n and self.mark and not ends):
                continue
            start = end - length
            if start:
                if (before := last[start]) < 0:
                    continue
                pair = before << 32 | token
                if (fits := pairs.new.get(pair)) is None and (fits := pairs.get(pair)) is None:
                    fits = self.goes_together(before, token)
                    pairs.put(pair, fits)
                if not fits:
                    continue
            last[end], came[end] = token, start
        out, at = [], n
        while at > 0:
            if last[at] < 0:
                raise ValueError("the vocabulary lacks a byte")
            out.append(last[at])
            at = came[at]
        return tuple(out[::-1])

    def encode_plain(self, text: str) -> list[int] | tuple[int, ...]:
        # capital sigma is lowered without regard to its place
        lowered = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        words = self.pattern.findall(lowered)
        if words == [text]:  # its tokens are kept with the piece
            return self.encode_letters(text)
        out: list[int] = []
        for word in words:
            if (ids := self.words.get(word)) is None:
                ids = self.encode_letters(word)
                self.words.put(word, ids)
            out += ids
        return out

    def encode_letters(self, word: str) -> tuple[int, ...]:
        """Tokens of one word; printable ASCII stands for itself in byte letters."""
        plain = word.isascii() and word.isprintable() and " " not in word
        return self.encode_word(word if plain else word.encode("utf-8").decode("latin-1").translate(self.letters))

    def encode_piece(self, piece: str) -> list[int] | tuple[int, ...]:
        """Tokens of a stretch without white space; the added tokens' own strings in it are those tokens."""
        if self.added_pattern is None or "<" not in piece:
            return self.encode_plain(piece)
        parts = self.added_pattern.split(piece)
        return tuple(chain.from_iterable((self.added[p],) if i % 2 else self.encode_plain(p) for i, p in enumerate(parts) if p))

    def encode_packed(self, text: str | None) -> bytes:
        """Tokens of a text as 32-bit numbers; pieces between white space are looked up whole."""
        text = text or ""
        parts = [p for p in SPLIT.split(text) if p] if OTHER_SPACE.search(text) else text.split()
        pieces = self.pieces
        found = list(map(pieces.new.get, parts))
        if None in found:
            for i, known in enumerate(found):
                if known is None:
                    # it may be in the old generation, or have come up again since
                    if (known := pieces.get(parts[i])) is None:
                        known = array("i", self.encode_piece(parts[i])).tobytes()
                        pieces.put(parts[i], known)
                    found[i] = known
        return b"".join(found)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_packed(text), np.int32).tolist()

    def decode(self, ids) -> str:
        """Token strings joined by spaces, as for a vocabulary file without a decoder; end-of-word marks and byte letters stay."""
        return " ".join(map(self.text_of.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str) -> PrefixEncoder:
    return PrefixEncoder(path)


def ids_of(texts: list[str | None], path: str) -> pa.ListArray:
    own = encoder(path)
    packed = [own.encode_packed(t) for t in texts]
    ends = np.cumsum([0, *(len(x) // 4 for x in packed)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def texts_of(rows: pa.ListArray, path: str) -> pa.Array:
    """The decoded text of each row of ids; null rows give null."""
    lengths = pc.fill_null(pc.list_value_length(rows), 0).to_numpy()
    ends = pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32))
    joined = pc.binary_join(pa.ListArray.from_arrays(ends, encoder(path).strings.take(rows.flatten())), " ")
    return pc.if_else(pc.is_valid(rows), joined, pa.scalar(None, pa.string()))


def encode_documents(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids of whole texts (array of int); a column that is called as ``ids`` is replaced.

    Null and empty texts have no ids; empty tables stay empty. ``path`` must exist on every machine.
    """
    return with_python_columns(docs, [text], StructType([StructField(ids, ArrayType(IntegerType()))]), lambda texts: [ids_of(texts, path)])


def decode_documents(docs: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with the text that its token ids stand for; null ids give null."""
    return with_python_columns(docs, [ids], StructType([StructField(decoded, StringType())]), lambda rows: [texts_of(rows, path)], as_lists=False)


def encode_and_decode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Both of these in one pass, by one Python worker for each task: the ids, and the text that these ids stand for.

    The column ``text`` itself isn't returned.
    """

    def both(texts: list[str | None]) -> list:
        encoded = ids_of(texts, path)
        return [encoded, texts_of(encoded, path)]

    return with_python_columns(docs, [text], StructType([StructField(ids, ArrayType(IntegerType())), StructField(decoded, StringType())]), both, dropped=(text,))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document its number of tokens and the digests of ids and decoded text."""
    return encode_and_decode(docs.select("doc_id", "text"), path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary())
