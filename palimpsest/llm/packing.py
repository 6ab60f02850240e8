"""Packing of documents into windows by Karmarkar-Karp differencing.

A document that fits a window stays whole.  A longer one gives full windows of
its own, and its rest is packed like the others.  A group of documents fills a
given number of windows.  Each document starts as a partition of its own: one
window holds it, the others are empty.  The two partitions with the largest
spread are merged again and again, the fullest window of one with the emptiest
of the other, until one partition is left.  If a window exceeds the capacity,
one more window is used.

Groups are formed from consecutive rows inside each task, so no row is
shuffled and memory is bounded by one group plus one document.

Defined cases: a null text counts as empty (a piece with the end id alone);
null and repeated doc_ids are packed like others; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from palimpsest.llm.common import arrow_batches, slices, texts_of
from palimpsest.llm.tokens import WordEncoder, encoder

CAPACITY = 4096
#: Windows of a group.
WINDOWS = 64
#: Tokens left free in each window of a group, so that equal windows stay under the capacity.
SLACK = 24


def difference(sizes: list[int], windows: int) -> np.ndarray:
    """The window of each size, by multiway differencing."""
    n = len(sizes)
    heap, nodes = [], []
    for k, size in enumerate(sizes):
        sums = np.zeros(windows, np.int64)
        sums[0] = size
        nodes.append((sums, None, None, None))
        heap.append((-size, k))
    heapq.heapify(heap)
    down = np.arange(windows)[::-1]
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        sums = nodes[a][0] + nodes[b][0][down]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        sums -= sums[-1]
        place = np.empty(windows, np.int64)
        place[order] = np.arange(windows)
        nodes[a], nodes[b] = (None, *nodes[a][1:]), (None, *nodes[b][1:])
        nodes.append((sums, a, b, place))
        heapq.heappush(heap, (-int(sums[0]), len(nodes) - 1))
    slots: list = [None] * len(nodes)
    slots[-1] = np.arange(windows)
    window = np.zeros(n, np.int64)
    for k in range(len(nodes) - 1, -1, -1):
        _, a, b, place = nodes[k]
        if a is None:
            window[k] = slots[k][0]  # a single piece is in the fullest window of its partition
        else:
            slots[a] = slots[k][place]
            slots[b] = slots[k][place[down]]
        slots[k] = None
    return window


def balanced(sizes: list[int], capacity: int) -> tuple[np.ndarray, int]:
    """Window of each size, and how many windows it took; none holds more than ``capacity``."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        window = difference(sizes, windows)
        if np.bincount(window, weights=sizes, minlength=windows).max() <= capacity:
            return window, windows
        windows += 1


def _rows(pieces: list[tuple], window: Iterable[int], windows: int, first: int) -> list[tuple]:
    """Rows of pieces (doc_id, tokens of the document, start, ids), with their windows numbered from ``first``."""
    rows, offset = [], [0] * windows
    for w, (doc_id, tokens, start, ids) in zip(window, pieces):
        raw = ids.astype("<u4").tobytes()
        rows.append((doc_id, start, len(ids), zlib.crc32(raw), tokens, first + w, offset[w], raw))
        offset[w] += len(ids)
    return rows


def pack(df: DataFrame, path: str, end_id: int = 2, capacity: int = CAPACITY, with_ids: bool = False, windows: int = WINDOWS, slack: int = SLACK, id_col: str = "doc_id", text_col: str = "text", chunks: int = WordEncoder.KEPT, block: int = 2_000_000) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; ``ids`` too if asked for.

    ``chunks`` kept by the encoder and bytes of a ``block`` bound a task's memory; they do not change the result.
    """
    arrow_batches(df.sparkSession)
    slack = min(slack, capacity - 1)
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    schema = pa.schema(fields + ([("ids", pa.binary())] if with_ids else []))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path, chunks)
        sequence = TaskContext.get().partitionId() << 33
        most = max(windows * (capacity - slack), capacity)
        group: list[tuple] = []
        room = most
        for batch in slices(batches, "text", block):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), words.encode(batch.column("text").to_pylist(), end_id)):
                cut = (len(ids) - 1) // capacity * capacity  # a rest of one token at least is left
                for start in range(0, cut, capacity):
                    yield batch_of(_rows([(doc_id, len(ids), start, ids[start : start + capacity])], [0], 1, sequence))
                    sequence += 1
                if len(ids) - cut > room:
                    window, used = balanced([len(p[3]) for p in group], capacity)
                    yield batch_of(_rows(group, window.tolist(), used, sequence))
                    sequence, group, room = sequence + used, [], most
                group.append((doc_id, len(ids), cut, ids[cut:].copy()))
                room -= len(ids) - cut
        if group:
            window, used = balanced([len(p[3]) for p in group], capacity)
            yield batch_of(_rows(group, window.tolist(), used, sequence))

    columns = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return texts_of(df, id_col, text_col).mapInArrow(run, columns)
