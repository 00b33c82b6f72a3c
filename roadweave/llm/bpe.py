"""Operator 8: byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The rank file's tokens are byte strings; the library's BPE model works on characters, so each
byte stands for one printable character. Every way to split a token into two tokens becomes a
merge with the token's rank. Each match of the pattern is encoded on its own and whole matches
that are tokens stay whole. Different matches are encoded once for each ``PORTION`` of texts and remembered (those of up
to ``LONGEST`` characters, ``REMEMBERED`` characters in all; then forgotten), so a task's work
follows its different words.

Decoding takes the characters of the ids' tokens from the tokenizer's vocabulary and reverses the byte
table, once for each token of the vocabulary. Tokens may end within a character; offsets in bytes become
offsets in characters with the number of characters begun before each byte, so a split character
belongs to all tokens that hold a part of it.

Defined results: a null text is empty and has no tokens; texts are taken as they are and whole
however long they are; special tokens' strings are ordinary text; repeated rows are encoded alike;
ids outside the vocabulary raise; an empty table gives an empty table; other columns pass through,
those named like an output are replaced.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import BPE

from .common import portions, without

#: Characters of different matches that a task remembers at most, and of one that is remembered.
REMEMBERED = 1_500_000
LONGEST = 64
#: Bytes of text that are matched, and new matches that are encoded, at once.
PORTION = 1 << 20
AT_ONCE = 4096


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable in
    Latin-1 and no space, else the next unused one from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


CHARACTERS = byte_characters()
BYTES = {c: b for b, c in enumerate(CHARACTERS)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def visible(data: bytes) -> str:
    return "".join(map(CHARACTERS.__getitem__, data))


def unseen(characters: str) -> bytes:
    """The bytes for which the characters of :func:`visible` stand."""
    return bytes(map(BYTES.__getitem__, characters))


def tokenizer(ranks: dict[bytes, int]) -> Tokenizer:
    vocab = {visible(t): r for t, r in ranks.items()}
    merges = [(visible(t[:i]), visible(t[i:])) for t, _ in sorted(ranks.items(), key=lambda x: x[1]) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    return Tokenizer(BPE(vocab=vocab, merges=merges, ignore_merges=True, cache_capacity=0))


class Codec:
    """A vocabulary with its pattern, one for each process and path."""

    def __init__(self, path: str, pattern: str):
        self.pattern = regex.compile(pattern)
        self.tokenizer = tokenizer(read_ranks(path))
        #: Bytes of each id: the characters of its token, back through the byte table.
        self.tokens = {i: unseen(t) for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items()}
        self.known: dict[str, bytes] = {}
        self.size = 0

    def _encoded(self, pieces: list[str]) -> Iterator[bytes]:
        for a in range(0, len(pieces), AT_ONCE):
            made = self.tokenizer.encode_batch_fast([visible(p.encode()) for p in pieces[a : a + AT_ONCE]], add_special_tokens=False)
            yield from (np.array(e.ids, "<u4").tobytes() for e in made)

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; matches not yet known are encoded together."""
        if self.size > REMEMBERED:
            self.forget()
        every = [self.pattern.findall(t or "") for t in texts]
        new = [p for p in dict.fromkeys(itertools.chain.from_iterable(every)) if p not in self.known]
        made = dict(zip(new, self._encoded(new), strict=True))
        long = {p: e for p, e in made.items() if len(p) > LONGEST}
        self.known |= made
        out = [b"".join(map(self.known.__getitem__, pieces)) for pieces in every]
        for p in long:
            del self.known[p]
        self.size += sum(map(len, made)) - sum(map(len, long))
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def forget(self) -> None:
        self.known.clear()
        self.size = 0

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-last character of ``text`` that each token holds a part of."""
        ends = np.cumsum([len(self.tokens[i]) for i in ids.tolist()], dtype=np.int64)
        starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        data = np.frombuffer(text.encode(), np.uint8)
        begun = np.cumsum((data & 0xC0) != 0x80)  # characters begun up to and with each byte
        return (begun[starts] - 1, begun[ends - 1]) if len(ids) else (starts, ends)


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _appended(docs: DataFrame, fields: dict[str, tuple[str, pa.DataType]], path: str, pattern: str, row) -> DataFrame:
    """``docs`` with the columns ``fields``, which ``row(codec, text, ids)`` gives as a tuple."""
    docs = without(docs, [*fields])
    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{k}` {v[0]}" for k, v in fields.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in portions(batches, "text", PORTION):
            texts = b.column("text").to_pylist()
            made = [row(own, t, ids) for t, ids in zip(texts, own.encode_all(texts), strict=True)]
            columns = zip(*made, strict=True) if made else [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(list(c), v[1]) for c, v in zip(columns, fields.values(), strict=True))], names=[*b.schema.names, *fields])
        own.forget()
        pa.default_memory_pool().release_unused()  # a worker process lives on for other tasks

    return docs.mapInArrow(run, ", ".join(names))


def encoded(docs: DataFrame, path: str, pattern: str, offsets: bool = False) -> DataFrame:
    """``docs`` with token_ids and, on request, token_starts and token_ends in characters."""
    fields: dict = {"token_ids": ("array<int>", pa.list_(pa.int32()))}
    if offsets:
        fields |= {"token_starts": ("array<long>", pa.list_(pa.int64())), "token_ends": ("array<long>", pa.list_(pa.int64()))}

    def row(own: Codec, text: str | None, raw: bytes) -> tuple:
        ids = np.frombuffer(raw, "<u4")
        return (ids.astype(np.int32), *own.offsets(text or "", ids)) if offsets else (ids.astype(np.int32),)

    return _appended(docs, fields, path, pattern, row)


def decoded(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """``rows`` (token_ids, ...) with decoded, the bytes of the ids."""
    rows = without(rows, ["decoded"])
    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in batches:
            texts = [own.decode(np.asarray(ids.as_py() or [], np.int64)) for ids in b.column("token_ids")]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary())], names=[*b.schema.names, "decoded"])

    return rows.mapInArrow(run, f"{', '.join(names)}, decoded binary")


def digested(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 and decoded_sha256: encoded and decoded in one pass."""
    fields = {"n_tokens": ("long", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}

    def row(own: Codec, text: str | None, ids: bytes) -> tuple:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(own.decode(np.frombuffer(ids, "<u4"))).hexdigest()

    return _appended(docs, fields, path, pattern, row)


def counted(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` with n_tokens."""
    return _appended(docs, {"n_tokens": ("long", pa.int64())}, path, pattern, lambda own, text, ids: (len(ids) // 4,))


def with_text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
