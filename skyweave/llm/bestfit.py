"""Vector best-fit packing of documents into fixed-size training sequences.

A piece asks for tokens, one document slot and attention cost (its length
squared); a sequence has a capacity of each.  All three follow from the length,
so pieces of one length are interchangeable and the packing needs only the
histogram of lengths: the plan is made for whole runs of equal sequences at
once, from the longest length down, and its size depends on the capacities, not
on the number of documents.  Each run of pieces goes to the open sequences that
fit in every dimension and have the best score, by the weighted norm of what
would stay free (``norm``) or by the weighted dot product of demand and
residual (``dot``).  Pieces then find their place by their number within their
length, which Spark counts in buckets.

A null text is empty: its only id is the end.  Repeated rows are documents of
their own; a null id stays null.  An empty table gives no rows, and columns other
than the id and the text are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweave.llm.texts import id_text, map_batches, numbered_within, prepare, texts_of
from skyweave.llm.tokens import encoder
from skyweave.session import cut_lineage

#: Bits that number the pieces of one length in a composite key.
RANK_BITS = 48


def token_pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each text's ids and an end id, cut if too long.

    A null text is empty: its only piece is the end id.  The first piece of a
    cut document takes the remainder, the others are full.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, rows = encoder(path), []
        for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
            ids = own.ids(text).astype("<u4", copy=False).tobytes() + end
            count = len(ids) // 4
            cuts = [0, *range(count % capacity or capacity, count + 1, capacity)]
            rows += [(doc, i, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        doc, piece, start, length, crc = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]],
            names=["doc_id", "piece", "start", "length", "ids_crc32"],
        )

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    return map_batches(id_text(docs), run, schema)


def packing_plan(
    counts: dict[int, int],
    capacity: int = 1024,
    max_docs: int | None = None,
    max_attention: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01),
    rule: str = "norm",
) -> list[tuple[int, int, int, int]]:
    """Runs ``(length, first_rank, first_sequence, offset)`` of a packing of the histogram.

    The pieces of a run take one sequence each, in order; a run ends where the
    next of its length begins.  ``max_docs`` and ``max_attention`` default to
    values that no sequence of ``capacity`` tokens can exceed.
    """
    limits = np.array([capacity, max_docs or capacity, max_attention or capacity * capacity], float)
    scale = np.array(weights, float)
    free = np.zeros((0, 3))
    first, many = np.zeros(0, np.int64), np.zeros(0, np.int64)
    runs, used = [], 0
    for length in sorted(counts, reverse=True):
        need = np.array([length, 1, length * length], float)
        if (need > limits).any():
            raise ValueError(f"a piece of {length} tokens exceeds a capacity")
        rank, left = 0, counts[length]
        while left:
            fits = np.flatnonzero((free >= need).all(axis=1))
            if len(fits):
                rest = (free[fits] - need) / limits
                if rule == "norm":
                    best = np.argmin((scale * rest * rest).sum(axis=1))
                else:
                    best = np.argmax((scale * (need / limits) * (free[fits] / limits)).sum(axis=1))
                g = fits[best]
                n, at, offset = min(left, int(many[g])), int(first[g]), int(capacity - free[g, 0])
                room = free[g] - need
                first[g] += n
                many[g] -= n
            else:
                # What later lengths can add decides how many sequences to open: here all that is left.
                per = int(min(limits // need))
                n, at, offset = -(-left // per), used, 0
                room = limits - need
                used += n
            runs.append((length, rank, at, offset))
            rank, left = rank + n, left - n
            free = np.vstack([free, room])
            first, many = np.append(first, at), np.append(many, n)
            open_ = (many > 0) & (free[:, 0] >= 1) & (free[:, 1] >= 1) & (free[:, 2] >= 1)
            free, first, many = free[open_], first[open_], many[open_]
    return runs


def pack(pieces: DataFrame, capacity: int = 1024, **options) -> DataFrame:
    """Add ``sequence_id, offset`` to written ``pieces`` (``doc_id, piece, start, length, ids_crc32``)."""
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = sorted(packing_plan(counts, capacity, **options))
    keys = np.array([(length << RANK_BITS) + rank for length, rank, _, _ in runs], np.int64)
    sequence, offset = (np.array([r[i] for r in runs], np.int64) for i in (2, 3))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
        key = (length << RANK_BITS) + rank
        at = np.searchsorted(keys, key, side="right") - 1
        placed = [pa.array(sequence[at] + key - keys[at]), pa.array(offset[at])]
        kept = [c for c in batch.schema.names if c != "_rank"]
        return pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in kept], *placed], names=[*kept, "sequence_id", "offset"]
        )

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranked = numbered_within(pieces.select(*columns), ["length"], ["doc_id", "piece", "start", "ids_crc32"], "_rank")
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return map_batches(ranked.select(*columns, "_rank"), run, schema)


def packed_documents(docs: DataFrame, path: str, capacity: int = 1024, **options) -> DataFrame:
    """One row per piece of every document, with its place in a sequence."""
    prepare(docs.sparkSession)
    return pack(cut_lineage(token_pieces(docs, path, capacity)), capacity, **options)
