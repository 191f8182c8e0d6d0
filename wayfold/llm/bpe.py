"""BPE encoding and decoding (operator 6).

Method: contiguous rank array.  A text is cut into words by the vocabulary's
pattern; a word is a row of part boundaries with the merge ranks of adjacent
parts beside it.  The least rank is searched for, its boundary deleted and the
two neighbouring ranks refreshed, until no rank is left.  The array is the
fastest structure for short words; words above ``SHORT`` parts use a heap over
a linked list, which gives the same merges in n log n.

Nulls are encoded as the empty text (no ids).  Bytes that are not UTF-8 become
U+FFFD first, as they cannot reach the library either.  Texts of any length are
read in pieces of ``PIECE`` words, so memory follows one text, not its ids.
Repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.arrow import Bounded
from wayfold.llm.store import documents

#: Parts up to which a word is merged by scanning its rank array.
SHORT = 64
#: Characters up to which a text is cut into words at once, and words of a longer one that are handled at a time.
WHOLE = 1 << 19
PIECE = 1 << 16
#: Words remembered by a Python worker.
MEMO = 250_000
NONE = 1 << 62


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in vocabulary files: printable Latin-1
    stands for itself, the others follow from U+0100 in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def word_pattern() -> str:
    """The pattern of words, with letters and numbers as Unicode 15 has them.

    The regex module may know a later Unicode version than the tokenizer's
    engine; code points unassigned there are neither letters nor numbers.
    """
    import regex

    letter, number = regex.compile(r"\p{L}"), regex.compile(r"\p{N}")
    later: list[list[int]] = []
    for cp in itertools.chain(range(0xD800), range(0xE000, 0x110000)):
        c = chr(cp)
        if unicodedata.category(c) in ("Cn", "Co") and (letter.match(c) or number.match(c)):
            if later and later[-1][1] == cp - 1:
                later[-1][1] = cp
            else:
                later.append([cp, cp])
    new = "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in later)
    but = f"--[{new}]" if new else ""
    known = f"(?V1)'(?:[stmd]|re|ve|ll)| ?[\\p{{L}}{but}]+| ?[\\p{{N}}{but}]+"
    return known + f"| ?[^\\s[\\p{{L}}{but}][\\p{{N}}{but}]]+|\\s+(?!\\S)|\\s+"


class Vocabulary:
    """A byte-level BPE vocabulary file of the tokenizers library, as plain picklable tables."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        alphabet = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = model["vocab"]
        size = max([*ids.values(), *self.special.values()]) + 1
        self.pieces: list[bytes] = [b""] * size
        for token, i in ids.items():
            if token not in self.special:
                self.pieces[i] = bytes(alphabet[c] for c in token)
        for content, i in self.special.items():
            self.pieces[i] = content.encode()
        self.byte_ids = [ids[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])
        self.pattern = word_pattern()


def merge_array(parts: list[int], merges: dict) -> list[int]:
    """Merge by scanning: ``ranks[i]`` is the rank of parts i and i + 1."""
    look = merges.get
    none = (NONE, -1)
    ranks = [look(pair, none) for pair in itertools.pairwise(parts)]
    while ranks:
        least = min(ranks)
        if least is none or least[0] == NONE:
            break
        i = ranks.index(least)
        parts[i] = least[1]
        del parts[i + 1], ranks[i]
        if i:
            ranks[i - 1] = look((parts[i - 1], parts[i]), none)
        if i < len(ranks):
            ranks[i] = look((parts[i], parts[i + 1]), none)
    return parts


def merge_heap(parts: list[int], merges: dict) -> list[int]:
    """The same merges for a long word: a heap of (rank, place) over a linked list."""
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(m[0], i, parts[i], parts[i + 1]) for i in range(n - 1) if (m := merges.get((parts[i], parts[i + 1])))]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if parts[i] != a or j >= n or parts[j] != b:
            continue
        parts[i] = merges[a, b][1]
        parts[j] = -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            if m := merges.get((parts[i], parts[after[i]])):
                heapq.heappush(heap, (m[0], i, parts[i], parts[after[i]]))
        if (h := before[i]) >= 0 and (m := merges.get((parts[h], parts[i]))):
            heapq.heappush(heap, (m[0], h, parts[h], parts[i]))
    return [p for p in parts if p >= 0]


class Codec:
    """Encoder and decoder of a Python worker, with a bounded memo of words."""

    def __init__(self, vocabulary: Vocabulary):
        import regex

        self.v = vocabulary
        self.any_word = regex.compile(vocabulary.pattern)
        self.ascii_word = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
        self.memo = Bounded(self.word, MEMO)
        cut = "|".join(map(re.escape, sorted(vocabulary.special, key=len, reverse=True)))
        self.special = re.compile(f"({cut})") if cut else None

    def word(self, word: str) -> tuple[int, ...]:
        parts = [self.v.byte_ids[b] for b in word.encode()]
        return tuple((merge_array if len(parts) <= SHORT else merge_heap)(parts, self.v.merges))

    def pieces(self, text: str) -> Iterator[list[int]]:
        """The ids of a text, some words at a time."""
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                yield [self.v.special[part]]
                continue
            pattern = self.ascii_word if part.isascii() else self.any_word
            if len(part) <= WHOLE:
                yield list(itertools.chain.from_iterable(map(self.memo.__getitem__, pattern.findall(part))))
                continue
            words = pattern.finditer(part)
            while some := [m[0] for m in itertools.islice(words, PIECE)]:
                yield list(itertools.chain.from_iterable(map(self.memo.__getitem__, some)))

    def encode(self, text: str) -> list[int]:
        return list(itertools.chain.from_iterable(self.pieces(text)))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.v.pieces.__getitem__, ids)).decode("utf-8", "replace")


def _codec(vocabulary: Vocabulary) -> Codec:
    """One codec for a worker process, so that its memo outlives a task."""
    key = id(type(vocabulary)), len(vocabulary.pieces), len(vocabulary.merges), vocabulary.pattern
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Codec(vocabulary)
    return _KEPT[key]


_KEPT: dict = {}


def _bytes_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


def encode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary_path))  # one fixed vocabulary: a few MB

    def run(batches):
        codec = _codec(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [codec.encode((x.as_py() or b"").decode("utf-8", "replace")) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _bytes_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id and text of every row of ``encode``; null ids give the empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary_path))

    def run(batches):
        codec = _codec(shared.value)
        for batch in batches:
            text = [codec.decode(x.as_py() or []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text, ids never leaving the kernel."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary_path))

    def run(batches):
        import codecs

        codec = _codec(shared.value)
        decimal = [str(i) for i in range(len(codec.v.pieces))]
        for batch in batches:
            counts, ids_hex, text_hex = [], [], []
            for x in batch.column(1):
                n, ids_sha, text_sha = 0, hashlib.sha256(), hashlib.sha256()
                back = codecs.getincrementaldecoder("utf-8")("replace")
                for ids in codec.pieces((x.as_py() or b"").decode("utf-8", "replace")):
                    ids_sha.update(("," * bool(n) + ",".join(map(decimal.__getitem__, ids))).encode())
                    text_sha.update(back.decode(b"".join(map(codec.v.pieces.__getitem__, ids))).encode())
                    n += len(ids)
                text_sha.update(back.decode(b"", True).encode())
                counts.append(n)
                ids_hex.append(ids_sha.hexdigest())
                text_hex.append(text_sha.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hex), pa.array(text_hex)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _bytes_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def count_tokens(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and n_tokens of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary_path))

    def run(batches):
        codec = _codec(shared.value)
        for batch in batches:
            n = [sum(map(len, codec.pieces((x.as_py() or b"").decode("utf-8", "replace")))) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return _bytes_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir), default_vocabulary())




def tokenised(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, n_tokens, ids and round_trip (whether the ids decode to the text) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary_path))

    def run(batches):
        codec = _codec(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [(x.as_py() or b"").decode("utf-8", "replace") for x in part.column(2)]
                ids = [codec.encode(t) for t in texts]
                same = [codec.decode(i) == t for i, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(i) for i in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(same)], names=["doc_id", "source", "n_tokens", "ids", "round_trip"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, source string, n_tokens long, ids array<int>, round_trip boolean")
