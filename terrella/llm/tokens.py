"""Byte-level BPE encoding and decoding through a sentencepiece model, and the padded-sequence tokenizer of the packer.

``piece_model`` serialises a sentencepiece BPE model straight from a vocabulary of ranks: byte b becomes the character
U+0100+b, a token the string of its bytes' characters, its score minus its rank, normalisation the identity. The BPE of
sentencepiece then merges the adjacent pair whose piece has the least rank, leftmost first, as the rank file means it.
Text is cut by ``PATTERN`` first; a pre-token that is itself in the vocabulary is that token. Decoding maps ids back to
bytes and ignores piece text. A bounded cache per worker process holds what recurring pre-tokens encode to.

Defined cases: a null or empty text has no tokens, and its digests are of no bytes; rows are encoded one by one, so
repeated rows and ids do not matter; texts of any length are encoded whole; an empty table gives an empty result. Other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import string
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .textkit import LOWER, as_strings

#: Entries of a worker's cache before it is emptied; long pre-tokens are not kept.
CACHE, CACHE_CHARS = 300_000, 48
PUNCTUATION = string.punctuation
LOWER_BYTES = LOWER.tobytes()
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def piece_model(ranks: dict[bytes, int]) -> tuple[bytes, list[int]]:
    """The serialised model, and the rank of each of its piece ids (the unknown piece, last, has -1)."""
    pieces, order = [], sorted(ranks.items(), key=lambda x: x[1])
    for token, rank in order:
        text = "".join(chr(0x100 + b) for b in token).encode()
        pieces.append(_field(1, _field(1, text) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank)) + _field(3, 1)))
    pieces.append(_field(1, _field(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(order))
    normal = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normal), [r for _, r in order] + [-1]


class ByteBpe:
    """Encode and decode by ranks; ``parts`` gives, per pre-token, the count of ids and their decimal text."""

    def __init__(self, path: str, pattern: str):
        import sentencepiece

        self.ranks = read_ranks(path)
        data, self.rank_of = piece_model(self.ranks)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.split = regex.compile(pattern)
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.straight = self.rank_of[:-1] == list(range(len(self.ranks)))
        self.cache: dict[str, list[int]] = {}

    def _new(self, pieces: list[str]) -> dict[str, list[int]]:
        out, rest = {}, []
        for p in pieces:
            whole = self.ranks.get(p.encode())
            if whole is None:
                rest.append(p)
            else:
                out[p] = [whole]
        if rest:
            # byte b as U+0100+b is, in UTF-16, the byte pair (b, 1)
            parts = [p.encode() for p in rest]
            data = b"".join(parts)
            wide = bytearray(b"\x01") * (2 * len(data))
            wide[::2] = data
            text, end = wide.decode("utf-16-le"), list(accumulate(map(len, parts)))
            found = self.model.encode([text[x:y] for x, y in zip([0, *end], end)], out_type=int, num_threads=1)
            if self.straight:
                out.update(zip(rest, found))
            else:
                out.update((p, [self.rank_of[i] for i in ids]) for p, ids in zip(rest, found))
        return out

    def encode(self, text: str) -> list[int]:
        pieces = self.split.findall(text)
        cache = self.cache
        extra: dict[str, list[int]] = {}
        if missing := {p for p in pieces if p not in cache}:
            extra = self._new(sorted(missing))
            if len(cache) > CACHE:
                # entries the current text needs are kept
                kept = {p: cache[p] for p in pieces if p in cache}
                cache.clear()
                cache.update(kept)
            cache.update((p, ids) for p, ids in extra.items() if len(p) <= CACHE_CHARS)
            extra = {p: ids for p, ids in extra.items() if len(p) > CACHE_CHARS}
        out: list[int] = []
        if extra:
            for p in pieces:
                out += extra[p] if p in extra else cache[p]
        else:
            for ids in map(cache.__getitem__, pieces):
                out += ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=4)
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    """One per worker process, so that its cache outlives a task."""
    return ByteBpe(path, pattern)


def bpe_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: token count, SHA-256 of the ids as decimal text joined by commas, SHA-256 of the decoded bytes."""
    ship(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        names = [str(i) for i in range(max(bpe.bytes_of) + 1)]
        for batch in batches:
            n, a, b = [], [], []
            for text in as_strings(batch.column(1)).to_pylist():
                ids = bpe.encode(text)
                n.append(len(ids))
                a.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                b.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(rows, SCHEMA)


def bpe_encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its token ids and the text they decode to."""
    ship(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for batch in batches:
            ids = [bpe.encode(t) for t in as_strings(batch.column(1)).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(x).decode() for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(rows, "doc_id long, ids array<int>, decoded string")


class WordIds:
    """Ids of a tokenizers vocabulary file as little-endian uint32 bytes, cached by white-space separated chunk.

    The vocabulary's pre-tokenizer drops white space, and its normaliser composes no character across it, so chunks between
    blanks and newlines encode apart. Other white space stays inside a chunk and is the tokenizer's to handle.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _plain(self, texts: list[str]) -> dict[str, bytes]:
        """Pure words are encoded as one text and told apart by their tokens that end a word; others one by one."""
        out, words = {}, [t for t in texts if t.isalpha()]
        if words:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(words):
                data, cut = ids.astype("<u4").tobytes(), [0, *(4 * ends).tolist()]
                out = {w: data[a:b] for w, a, b in zip(words, cut, cut[1:])}
        rest = [t for t in texts if t not in out]
        if rest:
            found = self.tokenizer.encode_batch(rest, add_special_tokens=False)
            out.update((t, struct.pack(f"<{len(e.ids)}I", *e.ids)) for t, e in zip(rest, found))
        return out

    def _new(self, chunks: dict[str, None]) -> dict[str, bytes]:
        """Letters followed by ASCII punctuation are two pre-tokens."""
        parts, out, old, cache = [], {}, self.old, self.cache
        need: dict[str, None] = {}
        for c in chunks:
            if (known := old.get(c)) is not None:
                out[c] = known
                continue
            if c.isalpha() or not (stem := c.rstrip(PUNCTUATION)).isalpha():
                need[c] = None
                continue
            tail = c[len(stem) :]
            parts.append((c, stem, tail))
            for x in (stem, tail):
                if x not in cache:
                    if (known := old.get(x)) is not None:
                        out[x] = known
                    else:
                        need[x] = None
        need.pop("", None)
        out[""] = b""
        out.update(self._plain(list(need)))
        for c, a, b in parts:
            out[c] = (out[a] if a in out else cache[a]) + (out[b] if b in out else cache[b])
        return out

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Several texts at once: what the cache lacks is encoded in one call."""
        cache, missing, split = self.cache, {}, []
        for t in texts:
            # A-Z may go to lower case first, but where a mark could have composed with a capital
            if t.isascii():
                t = t.lower()
            elif b"\xcc" not in (data := t.encode()) and b"\xcd" not in data:
                t = data.translate(LOWER_BYTES).decode()
            chunks = t.replace("\n", " ").split(" ")
            found = list(map(cache.get, chunks))
            if None in found:
                gaps = [i for i, f in enumerate(found) if f is None]
                missing.update((chunks[i], None) for i in gaps)
                split.append((found, [(i, chunks[i]) for i in gaps]))
            else:
                split.append((found, ()))
        new = self._new(missing) if missing else {}
        out = []
        for found, gaps in split:
            for i, c in gaps:
                found[i] = new[c]
            out.append(b"".join(found))
        cache.update((c, x) for c, x in new.items() if len(c) <= CACHE_CHARS)
        if len(cache) > CACHE:
            self.old, self.cache = cache, {}
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]


@lru_cache(maxsize=4)
def word_ids(path: str) -> WordIds:
    """One per worker process, so that its cache outlives a task."""
    return WordIds(path)
