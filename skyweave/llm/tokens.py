"""Token ids and counts of whole texts, exactly as the tokenizer file defines them.

``Encoder`` reads a byte-level BPE file (``.json``) and merges with a faster
public library; its ids equal those of the file's own library (tested).

Overlap resynchronisation
-------------------------
A huge text is encoded in overlapping chunks with byte offsets.  Neighbours are
joined at a token start that both encodings share and that is proven to be one
in any context: the byte-level pre-tokenizer never joins a space and the
non-space behind it to what stands before, and never joins other white space to
a non-space behind it.  So the ids in front of such a place depend on nothing
behind it and the ids behind it on nothing in front.  Where an overlap holds no
such place it is doubled, until the two chunks are one.

A null text is empty.  Special strings in a text are special tokens, as by the
library's default; they hold no white space, so no cut falls into one.
Repeated rows and rows without an id are counted like any other, each on its own;
an empty table gives no rows.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweave.llm.texts import id_text, map_batches, prepare, texts_of

#: Bytes of a chunk; longer texts are spliced.
CHUNK = 32_768
#: Bytes that neighbouring chunks share at first.
OVERLAP = 512
#: The byte-level pre-tokenizer's split.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts and the byte length of every id."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        self.special = {t["content"]: t["id"] for t in described["added_tokens"]}
        letters = _byte_letters()
        ranks = {
            bytes(letters[c] for c in token): rank
            for token, rank in described["model"]["vocab"].items()
            if token not in self.special
        }
        self.library = tiktoken.Encoding(
            path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special
        )
        self.width = np.zeros(max([*ranks.values(), *self.special.values()]) + 1, np.int64)
        for token, rank in ranks.items():
            self.width[rank] = len(token)
        for token, rank in self.special.items():
            self.width[rank] = len(token.encode())

    def ids(self, text: str | None) -> np.ndarray:
        return self.library.encode_to_numpy(text or "", allowed_special="all", disallowed_special=())


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _solid(byte: int) -> bool:
    """Whether a character that begins with this byte is surely no white space."""
    return 0x20 < byte < 0x7F or byte > 0xC2 and byte not in (0xE1, 0xE2, 0xE3)


def stable(raw: bytes, at: int) -> bool:
    """Whether a token starts at byte ``at`` in any context."""
    if not 0 < at < len(raw) - 1:
        return False
    if raw[at] == 0x20:
        return _solid(raw[at + 1])
    return raw[at - 1] in b"\t\n\r" and _solid(raw[at])


def _whole(raw: bytes, at: int) -> int:
    """``at``, moved back to the first byte of a character."""
    while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
        at -= 1
    return at


def spliced_count(own: Encoder, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of ``text``, from overlapping chunks joined at stable common token starts."""
    raw = text.encode()

    def starts(begin: int, end: int) -> np.ndarray:
        width = own.width[own.ids(raw[begin:end].decode())]
        return begin + np.cumsum(width) - width

    def until(begin: int, size: int) -> int:
        return max(_whole(raw, min(len(raw), begin + size)), min(len(raw), begin + 4))

    total, at, lap = 0, 0, overlap
    end = _whole(raw, until(0, chunk))
    left = starts(at, end)
    while end < len(raw):
        begin = max(at, _whole(raw, end - lap))
        if begin == at:  # the overlap covers the whole chunk: the two become one
            end = _whole(raw, until(end, chunk))
            left, lap = starts(at, end), overlap
            continue
        stop = _whole(raw, until(begin, max(chunk, 2 * lap)))
        right = starts(begin, stop)
        shared = np.intersect1d(left[left < end - 1], right[right > begin])
        cut = next((int(b) for b in shared[::-1] if stable(raw, int(b))), None)
        if cut is None:
            lap *= 2
            continue
        total += int(np.searchsorted(left, cut))
        at, end, left, lap = cut, stop, right[right >= cut], overlap
    return total + len(left)


def token_counts(docs: DataFrame, path: str, limit: int = 1024, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row, whatever its length."""
    prepare(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = encoder(path)
        sizes, counts = [], []
        for text in texts_of(batch):
            text = text or ""
            size = len(text.encode())
            sizes.append(size)
            counts.append(len(own.ids(text)) if size <= chunk else spliced_count(own, text, chunk, overlap))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
            names=["doc_id", "n_bytes", "n_tokens"],
        )

    counted = map_batches(id_text(docs), run, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
