"""BPE encoding and decoding of whole texts with a word-level vocabulary file.

A word is a list of symbols, doubly linked; a heap holds the merges that are
possible between neighbours by rank, and entries that a former merge has made
stale are skipped when they surface.  Words recur, so each worker keeps the ids
of those it has met, within a bound.  Decoding joins vocabulary strings.

Defined results: a null text is the empty text (no ids, empty string).
"""

from __future__ import annotations

import heapq
import json
import struct
import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collonade.llm.common import portions

PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
SPACES = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
#: Control characters that Python's split() takes for white space and the vocabulary's rules do not.
ODD = regex.compile(r"[\x1c-\x1f]")
#: Bytes of a worker's cached words, about.
CACHE = 128 << 20
#: Bytes of an entry of a dictionary besides its key and value.
SLOT = 100


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    letters = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class Vocabulary:
    """Merges and special tokens of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids, end = model["vocab"], model["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(model["merges"])}
        self.letters = byte_letters()
        self.inner = [ids[c] for c in self.letters]
        self.final = [ids[c + end] for c in self.letters]
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one word."""
        symbols = [self.inner[b] for b in piece[:-1]] + [self.final[piece[-1]]]
        if len(symbols) == 1:
            return symbols
        merges, n = self.merges, len(symbols)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []
        for i in range(n - 1):
            if m := merges.get((symbols[i], symbols[i + 1])):
                heap.append((m[0], i, m[1]))
        heapq.heapify(heap)
        while heap:
            _, i, new = heapq.heappop(heap)
            j = right[i]
            if j < 0 or symbols[i] < 0 or (merges.get((symbols[i], symbols[j])) or (0, -1))[1] != new:
                continue  # stale: one of the two has gone or become another symbol
            symbols[i], symbols[j] = new, -1
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
                if m := merges.get((new, symbols[k])):
                    heapq.heappush(heap, (m[0], i, m[1]))
            if (h := left[i]) >= 0 and (m := merges.get((symbols[h], new))):
                heapq.heappush(heap, (m[0], h, m[1]))
        return [s for s in symbols if s >= 0]


class Chunks(dict):
    """Ids, as little-endian 32-bit integers, of runs of text between white space."""

    def __init__(self, word: Callable[[str], list[int]]):
        self.word, self.pieces, self.size = word, {}, 0

    def __missing__(self, chunk: str) -> bytes:
        if self.size >= CACHE:
            self.clear()
            self.pieces.clear()
            self.size = 0
        got = []
        for piece in [chunk] if chunk.isascii() and chunk.isalpha() else PIECES.findall(chunk):
            if (ids := self.pieces.get(piece)) is None:
                own = self.word(piece)
                ids = self.pieces[piece] = struct.pack(f"<{len(own)}I", *own)
                self.size += sys.getsizeof(piece) + sys.getsizeof(ids) + SLOT
            got.append(ids)
        self[chunk] = out = b"".join(got)
        self.size += sys.getsizeof(chunk) + sys.getsizeof(out) + SLOT
        return out


class Encoder:
    """Encodes whole texts; library=True takes the merges of a word from the tokenizers library."""

    def __init__(self, path: str, library: bool = False):
        self.vocabulary = Vocabulary(path)
        if library:
            from tokenizers import Tokenizer

            model, letters = Tokenizer.from_file(path).model, self.vocabulary.letters
            self.chunks = Chunks(lambda piece: [t.id for t in model.tokenize("".join([letters[b] for b in piece.encode()]))])
        else:
            self.chunks = Chunks(lambda piece: self.vocabulary.merge(piece.encode()))

    def plain(self, text: str) -> bytes:
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        low = text.replace("Σ", "σ").lower()  # letter by letter: no final sigma
        chunks = SPACES.split(low) if ODD.search(low) else low.split()
        return b"".join(map(self.chunks.__getitem__, chunks))

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if "<|" not in text:
            return self.plain(text)
        special = self.vocabulary.special
        return b"".join(np.array([special[x]], "<u4").tobytes() if x in special else self.plain(x) for x in self.vocabulary.marks.split(text))


def token_strings(path: str) -> list[str]:
    """The vocabulary string of each id; '' for ids that are none."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ids = spec["model"]["vocab"] | {x["content"]: x["id"] for x in spec["added_tokens"]}
    names = [""] * (max(ids.values()) + 1)
    for token, i in ids.items():
        names[i] = token
    return names


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, library: bool = False) -> Encoder:
    """One for each vocabulary in a worker."""
    if (path, library) not in _ENCODERS:
        _ENCODERS[path, library] = Encoder(path, library)
    return _ENCODERS[path, library]


def encode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in portions(batches):
            packed = [enc.encode(t or "") for t in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
            ids = pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), ids)], names=[key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, ids, decoded): the vocabulary strings of the ids, joined as a file without a decoder asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = token_strings(vocabulary)
        for batch in portions(batches):
            lists = batch.column(1)
            flat, bounds = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            texts = [" ".join([names[i] for i in flat[a:b].tolist()]) for a, b in zip(bounds, bounds[1:], strict=False)]  # a row at a time: lists of numbers are large
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[key, ids, "decoded"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, ids).mapInArrow(run, f"`{key}` {kind}, `{ids}` array<int>, decoded string")


def digests(decoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """What op2 returns."""
    return decoded.select(
        key,
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
