"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are the largest allowed power of two, as often as it fits, and then the
binary digits of the rest, longest first. A piece is a sequence of its own: its length is a power of two, so it needs no padding,
and no sequence crosses documents. Sequences of one length form a bucket, so a batch drawn from one bucket is a full matrix.

Nothing is shuffled: the cut of a document depends on its own length alone. `write_buckets` stores the buckets.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.llm.hashing import LOWER, VALUES, prefix_sums, runs, separators, span_hashes, word_spans

END_ID = 2
MAX_TOKENS = 4096
TOKENIZER = "word_bpe_49k.json"
# White space that every part of the tokenizer agrees on: no token crosses it.
_GAPS = separators((0x20, 0x20), (0x09, 0x0A), (0x0D, 0x0D))
# Words whose ids a worker keeps at most; it starts anew beyond that. Changes speed and memory, never ids.
CACHE_WORDS = 700_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[33:127] = ~_ALNUM[33:127]


@functools.cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    ends = np.zeros(max(tokenizer.get_vocab().values()) + 1, bool)
    ends[[i for t, i in tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
    return tokenizer, ends, {}


class Encoder:
    """Ids of whole texts, by the ids of their distinct words.

    The tokenizer drops white space, merges inside words only, always parts an ASCII letter or digit from a mark that follows it, and
    lower-cases. So the ids of a text are those of its words, cut there, one after another, and ASCII words are known by their lower
    case. A text that names a special token is given to the tokenizer whole.
    """

    def __init__(self, path: str):
        self.tokenizer, self.ends, self.known = _tokenizer(path)

    def _learn(self, missing: list[bytes]) -> None:
        """Encode words many at a time, joined by spaces."""
        if len(self.known) + len(missing) > CACHE_WORDS:
            self.known.clear()
        plain = [w for w in missing if w.isalpha()]
        for i in range(0, len(plain), 4096):
            part = plain[i:i + 4096]
            ids = np.array(self.tokenizer.encode(" ".join([w.decode() for w in part]), add_special_tokens=False).ids, np.uint32)
            # A word of letters alone ends where a token with the end mark stands.
            cut = [0, *((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()]
            raw = ids.tobytes()
            self.known.update(zip(part, [raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], strict=True))
        other = [w for w in missing if not w.isalpha()]
        for i in range(0, len(other), 4096):
            part = other[i:i + 4096]
            texts = [w.decode("utf-8", "replace") for w in part]
            size = np.fromiter(map(len, texts), np.int64, len(texts))
            found = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
            at = np.fromiter((a for a, _ in found.offsets), np.int64, len(found.ids))
            owner = np.searchsorted(np.cumsum(size + 1), at, "right")
            cut = (np.searchsorted(owner, np.arange(len(part) + 1)) * 4).tolist()
            raw = np.array(found.ids, np.uint32).tobytes()
            self.known.update(zip(part, [raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], strict=True))

    def encode(self, off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a run of rows, one after another, and where each row's begin."""
        cuts = np.zeros(len(data), bool)
        cuts[1:] = _ALNUM[data[:-1]] & _MARK[data[1:]]
        start, end, rows = word_spans(off, data, _GAPS, cuts)
        ascii_only = np.diff(np.concatenate(([0], np.cumsum(data > 127)))[np.stack((start, end))], axis=0)[0] == 0
        small = LOWER[data]
        h = np.where(ascii_only, *(span_hashes(prefix_sums(VALUES[d]), start, end) for d in (small, data)))
        _, first, which = np.unique(h, return_index=True, return_inverse=True)
        raw, low = data.tobytes(), small.tobytes()
        keys = [(low if x else raw)[a:b] for a, b, x in zip(start[first].tolist(), end[first].tolist(), ascii_only[first].tolist(), strict=True)]
        known = self.known
        if missing := [w for w in keys if w not in known]:
            self._learn(missing)
        if missing := [w for w in keys if w not in known]:  # the cache began anew
            self._learn(missing)
        ids = [known[w] for w in keys]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), np.uint32)
        begin = np.concatenate(([0], np.cumsum(size)))
        n = size[which] if len(which) else np.zeros(0, np.int64)
        to = np.concatenate(([0], np.cumsum(n)))
        out = flat[np.repeat(begin[which] - to[:-1], n) + np.arange(to[-1])] if to[-1] else np.zeros(0, np.uint32)
        return out, to[rows]

    def whole(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)


def pieces(n: int, most: int = MAX_TOKENS) -> list[int]:
    """Lengths of the pieces of n tokens: whole ones of `most` (a power of two), then the binary digits of the rest."""
    rest = n % most
    return [most] * (n // most) + [1 << b for b in range(most.bit_length(), -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, path: str | None = None, most: int = MAX_TOKENS, end_id: int = END_ID, digest: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, bucket, and its ids.

    `docs` has doc_id and text; other columns are ignored. Null and empty texts have the end id alone. Rows that share a doc_id
    are packed one by one. `path` names the tokenizer's file on every executor. With `digest`, ids_crc32 stands for ids (the
    CRC-32 of the ids as little-endian unsigned 32-bit numbers). An empty table gives no rows.
    """
    if most & (most - 1):
        raise ValueError("the longest piece must be a power of two")
    path = path or tokenizer_path()
    content = pa.field("ids_crc32", pa.int64()) if digest else pa.field("ids", pa.list_(pa.int32()))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), content, ("doc_tokens", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(path)
        for batch in batches:
            doc = batch.column("doc_id").to_pylist()
            for first, off, data in runs(batch):
                out: tuple[list, ...] = ([], [], [], [], [])
                ids, begin = coder.encode(off, data)
                raw = data.tobytes()
                special = b"<|" in raw
                for r in range(len(off) - 1):
                    own = ids[begin[r]:begin[r + 1]]
                    if special and b"<|" in (text := raw[off[r]:off[r + 1]]):
                        own = coder.whole(text)
                    own = np.append(own, np.uint32(end_id))
                    at = 0
                    for n in pieces(len(own), most):
                        part = own[at:at + n]
                        content = zlib.crc32(part.tobytes()) if digest else part.astype(np.int32)
                        for x, v in zip(out, (doc[first + r], at, n, content, len(own)), strict=True):
                            x.append(v)
                        at += n
                yield pa.record_batch([pa.array(x, type=f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    kind = "ids_crc32 long" if digest else "ids array<int>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        task, f"doc_id long, start long, length long, {kind}, doc_tokens long")
    return rows.select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
                       F.log2(F.col("length")).cast("int").alias("bucket"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """Store sequences by length, so that a reader draws batches of one length."""
    packed.write.partitionBy("bucket").parquet(path)
