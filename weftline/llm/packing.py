"""Cost-balanced packing of documents into training sequences.

A task tokenizes its documents and packs them in windows of bounded size, so
memory doesn't depend on the input, nothing is shuffled, and a lost task is
repeated alone. Within a window the documents (of long ones the part beyond
whole sequences) go in descending order to the sequence of lowest estimated
cost, linear plus quadratic in the piece lengths, that has room; where none has
room, a document is cut. The sequences of a window have capacity for its tokens
exactly: full ones, and one for each power of two of the rest, so none is padded.

Tokens come from the tokenizer itself, once for each distinct chunk between
white space: the tokenizer drops white space and none of its merges crosses it.
Texts for which that isn't so (special tokens, the four separators that Python
alone counts as white space) are tokenized whole.

Defined results: a null text counts as empty, and an empty text is its end
token alone; a null doc_id is carried; repeated rows are each packed; an empty
table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import table

CAPACITY = 2048
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Tokens that a window holds at most, beyond its last document.
WINDOW = 1_500_000
CACHE = 500_000
LINEAR, QUADRATIC = 1.0, 1.0 / CAPACITY

_WHOLE = re.compile("<\\||[\x1c-\x1f]")
_NAME = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?%#*$&]*)")
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Encoder(dict):
    """Ids of chunks without white space, as little-endian 16-bit bytes; at most CACHE chunks are remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.parts: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes()

    def part(self, text: str) -> bytes:
        got = self.parts.get(text)
        if got is None:
            got = self.ids(text)
            if len(self.parts) < CACHE:
                self.parts[text] = got
        return got

    def __missing__(self, chunk: str) -> bytes:
        # a run of Latin letters and one of these signs are pieces of their own, and letters are put in lower case
        m = _NAME.fullmatch(chunk)
        got = self.part(m[1].translate(_UPPER)) + (self.part(m[2]) if m[2] else b"") if m else self.ids(chunk)
        if len(self) < CACHE:
            self[chunk] = got
        return got

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text and the end id, as 16-bit integers."""
        whole = self.ids(text) if _WHOLE.search(text) else b"".join(map(self.__getitem__, text.split()))
        return np.frombuffer(whole + END_ID.to_bytes(2, "little"), dtype="<u2")


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def assign(lengths: list[int], capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Sequences of (piece, start, length) for pieces of less than `capacity` tokens each.

    Total room equals total length; the rest of the division by `capacity` is
    met by sequences at powers of two.
    """
    total = sum(lengths)
    rooms = [capacity] * (total // capacity) + [1 << k for k in range(capacity.bit_length()) if total % capacity >> k & 1]
    room, cost = np.array(rooms, dtype=np.int64), np.zeros(len(rooms))
    out: list[list[tuple[int, int, int]]] = [[] for _ in rooms]
    todo = [(n, i, 0) for n, i in sorted(((n, i) for i, n in enumerate(lengths) if n), key=lambda x: (-x[0], x[1]))]
    for n, i, start in todo:
        while n:
            fits = room >= n
            k = int(np.argmin(np.where(fits, cost, np.inf))) if fits.any() else int(np.argmax(room))
            take = min(n, int(room[k]))
            out[k].append((i, start, take))
            room[k] -= take
            cost[k] += LINEAR * take + QUADRATIC * take * take
            n, start = n - take, start + take
    return out


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


class _Packer:
    def __init__(self, capacity: int, first: int):
        self.capacity, self.next = capacity, first
        self.held: list[tuple] = []  # (doc_id, start, ids, doc_tokens)
        self.size = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> list[tuple]:
        """Whole sequences of the document; its rest is held."""
        whole = len(ids) // self.capacity * self.capacity
        rows = []
        for k in range(0, whole, self.capacity):
            rows.append((doc_id, k, self.capacity, ids[k : k + self.capacity].astype("<u4").tobytes(), len(ids), self.next, 0))
            self.next += 1
        if whole < len(ids):
            self.held.append((doc_id, whole, ids[whole:], len(ids)))
            self.size += len(ids) - whole
        return rows

    def flush(self) -> list[tuple]:
        rows = []
        for sequence in assign([len(x[2]) for x in self.held], self.capacity):
            at = 0
            for i, start, n in sequence:
                doc_id, base, ids, total = self.held[i]
                rows.append((doc_id, base + start, n, ids[start : start + n].astype("<u4").tobytes(), total, self.next, at))
                at += n
            self.next += 1
        self.held, self.size = [], 0
        return rows


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def pack_documents(docs: DataFrame, vocabulary: str | None = None, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset); ids are little-endian 32-bit integers.

    `vocabulary` is the tokenizer's file, which every executor must have.
    """
    path = vocabulary or vocabulary_path()

    def pack(batches):
        enc = encoder(path)
        packer, rows = _Packer(capacity, TaskContext.get().partitionId() << 40), []
        for batch in batches:
            for key, value in zip(batch.column(0), batch.column(1), strict=True):
                rows += packer.add(key.as_py(), enc.encode(value.as_py() or ""))
                if packer.size >= WINDOW:
                    rows += packer.flush()
                while len(rows) >= 2000:
                    yield _batch(rows[:2000])
                    del rows[:2000]
        rows += packer.flush()
        for k in range(0, len(rows), 2000):
            yield _batch(rows[k : k + 2000])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(pack, PIECES)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack_documents(table(spark, sf_dir, "documents")))
