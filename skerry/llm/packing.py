"""Sum-of-squares packing of documents into windows of equal size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.text import pieces, text_slices
from skerry.llm.tokens import FlatEncoder, public_library_encoder

WINDOW = 1024
PIECES = ("doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


class SquaresPacker:
    """Windows in the making of one task.

    counts[h] is the number of windows filled to level h, open[h] has them. An item goes to the
    level that leaves the smallest sum of squared counts; ties go to the fuller window."""

    def __init__(self, window: int, first: int):
        self.window, self.next = window, first
        self.counts = np.zeros(window + 1, dtype=np.int64)
        self.open: list[list[tuple[int, list]]] = [[] for _ in range(window)]

    def number(self) -> int:
        self.next += 1
        return self.next - 1

    def full(self, item: tuple) -> tuple[int, list]:
        """A window that one item fills."""
        return self.number(), [item]

    def place(self, item: tuple) -> tuple[int, list] | None:
        """Place an item (..., length last); returns the window if that fills it."""
        size, top = item[-1], self.window - item[-1]
        levels = np.arange(top, -1, -1)
        cost = np.where(levels > 0, 1 - 2 * self.counts[levels], 0) + np.where(levels < top, 2 * self.counts[levels + size] + 1, 0)
        cost[(self.counts[levels] == 0) & (levels > 0)] = np.iinfo(np.int64).max
        level = int(levels[np.argmin(cost)])
        if level:
            number, items = self.open[level].pop()
            self.counts[level] -= 1
        else:
            number, items = self.number(), []
        items.append(item)
        if level + size == self.window:
            return number, items
        self.open[level + size].append((number, items))
        self.counts[level + size] += 1
        return None

    def rest(self) -> list[tuple[int, list]]:
        """The windows still open."""
        return [w for level in reversed(self.open) for w in level]


def pack_documents(docs: DataFrame, window: int = WINDOW, end_id: int = 0,
                   encoder: Callable[[], FlatEncoder] = public_library_encoder) -> DataFrame:
    """Pieces of the texts of (doc_id, text), each with its window and its place there.

    Each document gets `end_id` after its ids; whole windows are cut off it and the rest is placed
    by sum of squares, within the task that reads it. The windows open at the end of a task are
    poured together and cut at window borders, so a task leaves one window that is not full. Memory
    is a slice of the texts and the open windows, whose number does not grow with the rows of
    ordinary length distributions. A null or empty text has the end id alone; repeated rows and ids
    are packed each on their own; other columns are left out; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_texts, packer = encoder(), SquaresPacker(window, TaskContext.get().partitionId() << 40)
        done: list[tuple[int, list]] = []

        def rows() -> pa.RecordBatch:
            out: list[list] = [[] for _ in range(7)]
            for number, items in done:
                offset = 0
                for doc, total, start, ids, size in items:
                    for column, value in zip(out, (doc, start, size, total, number, offset, ids), strict=True):
                        column.append(value)
                    offset += size
            done.clear()
            kinds = [pa.int64()] * 6 + [pa.binary()]
            names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

        for batch in batches:
            for part in text_slices(batch):
                flat, lengths = encode_texts.ids(part.column("text"))
                flat = np.insert(flat, np.cumsum(lengths), end_id).astype("<u4")
                offsets = np.concatenate([[0], np.cumsum(lengths + 1)])
                for doc, ids in zip(part.column("doc_id").to_pylist(), pieces(flat, offsets), strict=True):
                    total = len(ids) // 4
                    for start in range(0, total, window):
                        size = min(window, total - start)
                        item = (doc, total, start, ids[4 * start:4 * (start + size)], size)
                        filled = packer.full(item) if size == window else packer.place(item)
                        if filled:
                            done.append(filled)
                yield rows()
        level, current = 0, None
        for _, items in packer.rest():
            for doc, total, start, ids, size in items:
                while size:
                    if current is None:
                        level, current = 0, (packer.number(), [])
                    take = min(size, window - level)
                    current[1].append((doc, total, start, ids[:4 * take], take))
                    start, ids, size, level = start + take, ids[4 * take:], size - take, level + take
                    if level == window:
                        done.append(current)
                        current = None
        if current:
            done.append(current)
        yield rows()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, PIECES)
