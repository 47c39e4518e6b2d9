"""Packing documents into windows of at most 4096 tokens, best-fit decreasing.

Every whole text is tokenised once, each distinct word, or part of one, once per Python worker while it is remembered
where the vocabulary drops white space and so takes words one by one; overlong documents are first cut into full windows, each a
sequence of its own, and the remainders are packed by a segment tree over remaining capacities
that finds the tightest open window. Packing runs in groups of a set number of remainders
dealt by hash, so a task's memory is fixed and no group follows a key of the data; a group's
padding is that of its last few windows. Only lengths go to the packing; the ids are stored once with
their pieces and joined to the placed ones. Null and empty texts are the end token alone. Repeated
rows and rows without a doc_id are packed each for itself. Empty tables give no rows; extra columns are not
read. A very long text is encoded whole by one task and cut into as many windows as it fills.
"""

from __future__ import annotations

import codecs
import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, whole

WINDOW = 4096
END = 2
#: Remainders packed together by one task.
GROUP = 50_000
#: Bytes and texts tokenised at a time.
CHUNK, TEXTS = 1 << 22, 1024
#: Words whose ids a task remembers before it keeps only those at hand; of parts of words half as many.
WORDS = 500_000
#: Parts of words encoded as one text.
JOINED = 256
#: What a piece holds.
PIECE = pa.schema({"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids": pa.binary(), "doc_tokens": pa.int64()})
#: Between the ids of two words; no four bytes of ids equal it, since their highest ones are 0.
BORDER = b"\xff" * 4
#: How the default vocabulary cuts texts, beside its byte pairs.
CUTS = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: Finds what keeps a word from being plain: characters beyond the letters of Latin-1 and visible ASCII, and the
#: start of special tokens. Plain characters are their own NFC and have lower-case forms of one character.
ODD = re.compile(r"[^!-~À-ÖØ-öø-ÿ]|<\|").search
#: The same parts of lower-cased plain words, and the line feed between words.
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+|\n")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Whole texts to their ids, little-endian 32-bit.

    ``word_wise`` holds for vocabularies that drop white space and join nothing across it: the ids
    of a text are then those of its words in turn. Others encode each text as one string. Words of plain
    characters are cut into parts as the tokenizer cuts them, where it cuts as the default one does, and only parts
    not met before are encoded."""

    def __init__(self, vocabulary: str, word_wise: bool, words: int = WORDS):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.word_wise, self.words, self.known, self.parts = word_wise, words, {}, {}
        spec = json.loads(self.tokenizer.to_str())
        self.cuts = all(spec[k] == v for k, v in CUTS.items()) and spec["model"].get("end_of_word_suffix") == "</w>"
        if self.cuts:
            vocab = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
            # Parts as the model takes them: their bytes stand for characters already, only spaces part them.
            self.model = Tokenizer(self.tokenizer.model)
            self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
            rest = [b for b in range(256) if b not in visible]
            self.level = "".join(" " if b == 0x20 else chr(b if b in visible else 256 + rest.index(b)) for b in range(256))

    def _ids(self, strings: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in found]

    def _part_ids(self, strings: list[str]) -> list[bytes]:
        """The ids of parts of plain words: many are encoded as one text, and each ends with a token that ends a word."""
        out = []
        for a in range(0, len(strings), JOINED):
            part = strings[a : a + JOINED]
            level = codecs.charmap_decode(" ".join(part).encode(), "strict", self.level)[0]
            ids = np.array(self.model.encode_batch_fast([level], add_special_tokens=False)[0].ids, "<u4")
            cuts = [0, *(np.flatnonzero(self.ends[ids]) + 1).tolist()]
            data = ids.tobytes()
            out += [data[4 * x : 4 * y] for x, y in zip(cuts, cuts[1:])] if len(cuts) == len(part) + 1 else self._ids(part)
        return out

    def _plain_ids(self, strings: list[str]) -> list[bytes]:
        """The ids of words of plain characters, through those of their parts."""
        cut = PARTS.findall("\n".join(strings).lower())
        seen = set(cut)
        new = list(seen.difference(self.parts, "\n"))
        if len(self.parts) + len(new) > self.words // 2:
            self.parts = {p: self.parts[p] for p in seen if p in self.parts}
        self.parts |= zip(new, self._part_ids(new))
        self.parts["\n"] = BORDER
        return b"".join(map(self.parts.__getitem__, cut)).split(BORDER)

    def _word_ids(self, strings: list[str]) -> list[bytes]:
        odd = [w for w in strings if not self.cuts or ODD(w)]
        if not odd:
            return self._plain_ids(strings)
        found = dict(zip(odd, self._ids(odd)))
        plain = [w for w in strings if w not in found]
        found |= zip(plain, self._plain_ids(plain) if plain else [])
        return [found[w] for w in strings]

    def __call__(self, texts: list[str] | pa.Array) -> list[bytes]:
        if not self.word_wise:
            return self._ids(texts.to_pylist() if isinstance(texts, pa.Array) else texts)
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        numbered = split.values.dictionary_encode()
        seen = _strings(numbered.dictionary)
        ids = list(map(self.known.get, seen))
        new = [w for w, x in zip(seen, ids) if x is None]
        if len(self.known) + len(new) > self.words:
            self.known = {w: x for w, x in zip(seen, ids) if x is not None}
        if new:
            self.known |= zip(new, self._word_ids(new))
            ids = list(map(self.known.__getitem__, seen))
        ends = np.cumsum(np.fromiter(chain([0], map(len, ids)), "i8", len(ids) + 1))
        ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(ids))])
        _, ends, data = ids.take(numbered.indices).buffers()
        at = np.frombuffer(ends, "i8")[split.offsets.to_numpy()].tolist()
        data = memoryview(data) if data else b""
        return [bytes(data[x:y]) for x, y in zip(at, at[1:])]


def _strings(words: pa.Array) -> list[str]:
    """The words, which hold no line feed, faster than by to_pylist."""
    if not len(words):
        return []
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), pa.scalar("\n", words.type))[0].as_py().split("\n")


@lru_cache(maxsize=1)
def encoder(vocabulary: str, word_wise: bool) -> Encoder:
    """The Python worker's encoder: the next tasks it is given find the words of the ones before."""
    return Encoder(vocabulary, word_wise)


class Capacities:
    """Open windows by remaining capacity: a segment tree of counts over 0..size."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(self.leaves)]

    def _add(self, capacity: int, by: int) -> None:
        k = capacity + self.leaves
        while k:
            self.count[k] += by
            k >>= 1

    def push(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        self._add(capacity, 1)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Removes and returns (capacity, window) with the least capacity >= need."""
        k = need + self.leaves
        while not self.count[k]:
            # Climb to the next subtree on the right.
            while k & 1:
                k >>= 1
            if not k:
                return None
            k += 1
        while k < self.leaves:
            k = 2 * k if self.count[2 * k] else 2 * k + 1
        capacity = k - self.leaves
        self._add(capacity, -1)
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """The window and the offset in it of each length; lengths must fall."""
    tree, used, at, offsets = Capacities(window), 0, [], []
    for n in lengths:
        found = tree.tightest(n)
        capacity, w = found or (window, used)
        used += found is None
        at.append(w)
        offsets.append(window - capacity)
        if capacity > n:
            tree.push(capacity - n, w)
    return at, offsets


def pieces(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, word_wise: bool | None = None) -> DataFrame:
    """doc_id, start, length, ids, doc_tokens of every piece of at most a window.

    ``ids`` are little-endian 32-bit, the end token included.
    ``word_wise`` as in Encoder; by default it holds for the default vocabulary alone."""
    word_wise = vocabulary is None if word_wise is None else word_wise
    vocabulary = vocabulary or default_vocabulary()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, end = encoder(vocabulary, word_wise), struct.pack("<I", END)

        def encoded(rows: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for doc_id, ids in zip(rows.column("doc_id").to_pylist(), encode(rows.column("text"))):
                ids += end
                for s in range(0, len(ids), 4 * window):
                    part = ids[s : s + 4 * window]
                    out.append((doc_id, s // 4, len(part) // 4, part, len(ids) // 4))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), PIECE.types)], schema=PIECE)

        for batch in batches:
            at, held = 0, 0
            for n, size in enumerate(pc.binary_length(batch.column("text")).to_pylist(), 1):
                held += size
                if held >= CHUNK or n - at >= TEXTS or n == batch.num_rows:
                    yield encoded(batch.slice(at, n - at))
                    at, held = n, 0

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text")).mapInArrow(
        cut, "doc_id long, start long, length long, ids binary, doc_tokens long"
    )


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """The pieces with their ids, ids_crc32, sequence_id and offset."""
    made = pieces(docs, vocabulary, window).withColumn("ids_crc32", F.crc32("ids"))
    cut = stored(made.withColumn("piece", F.monotonically_increasing_id()), "pieces")
    n = max(1, -(-cut.count() // group))

    def packed(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], ignore_index=True)
        at, offsets = best_fit_decreasing(part["length"].tolist(), window)
        part["sequence_id"] = (int(part["bin"].iloc[0]) << 32) + np.array(at, "int64")
        part["offset"] = np.array(offsets, "int64")
        return part[["piece", "sequence_id", "offset"]]

    binned = cut.select("piece", "doc_id", "start", "length", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(n)).alias("bin"))
    placed = binned.groupBy("bin").applyInPandas(packed, "piece long, sequence_id long, offset long")
    return cut.join(placed, "piece").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id, length, ids of every packed window: the ids of its pieces in order."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    ids = F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), ids.alias("ids"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset"]
    placed = pack(table(spark, sf_dir, "documents")).select(*columns, F.crc32("ids").alias("ids_crc32"))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
