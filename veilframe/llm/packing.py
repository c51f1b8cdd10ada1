"""Vector bin packing of token pieces into training sequences.

Every task tokenizes the rows of its partition and packs them as it goes, so no text is shuffled and a lost
executor only repeats its own partitions, with the same result. A task keeps a bounded pool of
waiting pieces. The open sequence takes the waiting piece whose demand vector (tokens, segments, loss-bearing
tokens) has the largest dot product with what is left of the limits; when no piece fits but tokens are
left, the longest piece is cut to fill them. A full sequence leaves at once.

Only a task's last sequence may be short. These tails are packed anew, whole, by the same heuristic, from a
table of their sizes alone: one row a task, in groups of ``TAILS`` tasks. So small partitions cost no padding.

Defined results: null text is empty and gives the end id alone; each row is its own document, also where
doc_id repeats or is null; ties go to the piece that came first. Further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, store
from .tokens import encoder

#: Each limit binds: plain text bears loss but for a document's first token, so sequences of few documents meet the
#: third limit, those of many short ones the second, and the others the first.
LENGTH, MOST_SEGMENTS, MOST_LOSS, POOL, END_ID = 2048, 12, 2040, 512, 1
LEAST_CUT, TAILS, _TASK_BITS = 16, 4096, 36
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


class Packer:
    """Packs pieces (doc, start, ids, doc_tokens, marks) under limits on tokens, segments and loss-bearing tokens."""

    def __init__(self, limits: tuple[int, int, int], pool: int = POOL):
        if min(limits) < 1:
            raise ValueError("every limit must be at least 1")
        self.limits, self.pool = np.array(limits, np.float64), pool
        self.pieces: list[tuple] = []
        self.need = np.zeros((pool + 2, 3))  # a row for each waiting piece
        self.left, self.used = self.limits.copy(), 0
        self.open, self.next = -1, 0  # numbers of the open sequence and of the next one
        self.out: list[tuple] = []

    @staticmethod
    def _bearing(piece: tuple) -> int:
        """Loss-bearing tokens: as marked, or else all but a document's first, which nothing predicts."""
        return len(piece[2]) - (piece[1] == 0) if piece[4] is None else int(piece[4].sum())

    def add(self, doc, ids: np.ndarray, marks: np.ndarray | None = None) -> None:
        """Queue a document, cut where one piece alone fills a sequence. marks: 1 for each id that bears loss."""
        most = int(self.limits[0] if marks is not None else min(self.limits[0], self.limits[2]))
        for start in range(0, len(ids), most):
            piece = doc, start, ids[start : start + most], len(ids), None if marks is None else marks[start : start + most]
            if len(piece[2]) == most and (marks is None or self._bearing(piece) <= self.limits[2]):
                self._write(piece, self._number(), 0)
                continue
            self._wait(piece)
            while len(self.pieces) > self.pool:
                self._step()

    def finish(self) -> int | None:
        """Place what waits. The number of the last sequence, if that is short."""
        while self.pieces:
            self._step()
        last = self.open if self.used else None
        self._close()
        return last

    def _number(self) -> int:
        self.next += 1
        return self.next - 1

    def _wait(self, piece: tuple) -> None:
        self.need[len(self.pieces)] = len(piece[2]), 1, self._bearing(piece)
        self.pieces.append(piece)

    def _take(self, k: int) -> tuple:
        last = len(self.pieces) - 1
        self.need[k:last] = self.need[k + 1 : last + 1]
        return self.pieces.pop(k)

    def _write(self, piece: tuple, number: int, offset: int) -> None:
        doc, start, ids, total, _ = piece
        crc = zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
        self.out.append((doc, start, len(ids), crc, total, number, offset, self._bearing(piece)))

    def _place(self, piece: tuple) -> None:
        if not self.used:
            self.open = self._number()
        self._write(piece, self.open, self.used)
        self.used += len(piece[2])
        self.left -= (len(piece[2]), 1, self._bearing(piece))
        if not self.left[:2].all():
            self._close()

    def _close(self) -> None:
        self.left, self.used = self.limits.copy(), 0

    def _room(self, piece: tuple) -> int:
        """Length of the longest prefix that fits in the open sequence."""
        if piece[4] is None:
            return int(min(len(piece[2]), self.left[0], self.left[2] + (piece[1] == 0)))
        return int(min(self.left[0], np.searchsorted(np.cumsum(piece[4]), self.left[2], "right")))

    def _step(self) -> None:
        """Place one waiting piece or part of one, or close the open sequence."""
        need = self.need[: len(self.pieces)]
        fits = (need <= self.left).all(1)
        if fits.any():
            scores = np.where(fits, (need / self.limits) @ (self.left / self.limits), -1.0)
            self._place(self._take(int(scores.argmax())))
            return
        k = int(need[:, 0].argmax())
        room = self._room(self.pieces[k])
        if room >= (LEAST_CUT if self.used else 1) and self.left[1] >= 1:
            doc, start, ids, total, marks = self._take(k)
            cut = lambda a, b: (doc, start + a, ids[a:b], total, None if marks is None else marks[a:b])
            self._wait(cut(room, len(ids)))
            self._place(cut(0, room))
            return
        self._close()


def _arrow(rows: list[tuple], partition: int, tail: int | None = None) -> pa.RecordBatch:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))]
    at = names.index("sequence_id")
    # The task's number in the high bits keeps sequence ids apart without a count over all tasks.
    columns[at] = pa.array([(partition << _TASK_BITS) + r[at] for r in rows], pa.int64())
    return pa.RecordBatch.from_arrays([*columns, pa.array([r[at] == tail for r in rows], pa.bool_())], [*names, "tail"])


def _run(fill: Callable[[pa.RecordBatch, Packer], Iterator[None]], limits: tuple[int, int, int], pool: int) -> Callable:
    """The function for mapInArrow: fill adds a batch's documents, and pauses where results may leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer, partition = Packer(limits, pool), TaskContext.get().partitionId()
        held: list[tuple] = []  # the open sequence's pieces stay until it is known whether it is the last

        def leave(rows: list[tuple], tail: int | None = None) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(rows), 4096):
                yield _arrow(rows[a : a + 4096], partition, tail)

        for batch in batches:
            for _ in fill(batch, packer):
                if len(packer.out) >= 4096:
                    held += packer.out
                    packer.out = []
                    yield from leave([r for r in held if r[5] != packer.open])
                    held = [r for r in held if r[5] == packer.open]
        tail = packer.finish()
        yield from leave(held + packer.out, tail)

    return run


def merged(tails: pa.Table, limits: tuple[int, int, int]) -> pa.Table:
    """Whole tails (sequence_id, tokens, segments, loss) put together, the best by dot product first: (sequence_id, into, shift)."""
    tails, most = tails.sort_by("sequence_id"), np.array(limits, np.float64)
    ids = tails.column("sequence_id").to_numpy()
    need = np.column_stack([tails.column(x).to_numpy() for x in ("tokens", "segments", "loss")]).astype(np.float64)
    waiting, into, shift = np.ones(len(ids), bool), ids.copy(), np.zeros(len(ids), np.int64)
    while waiting.any():
        left, head = most.copy(), None
        while (fits := waiting & (need <= left).all(1)).any():
            k = int(np.where(fits, (need / most) @ (left / most), -1.0).argmax())
            head = ids[k] if head is None else head
            into[k], shift[k], waiting[k] = head, most[0] - left[0], False
            left -= need[k]
    return pa.table({"sequence_id": ids, "into": into, "shift": shift})


def _joined(pieces: DataFrame, limits: tuple[int, int, int]) -> DataFrame:
    """pieces with their short last sequences packed into common ones."""
    made = store(pieces, "pieces")
    tails = made.where("tail").groupBy("sequence_id").agg(F.sum("length").alias("tokens"), F.count("*").alias("segments"), F.sum("loss_tokens").alias("loss"))

    def merge(table: pa.Table) -> pa.Table:
        return merged(table, limits)

    group = F.floor(F.shiftright("sequence_id", _TASK_BITS) / TAILS).alias("group")
    moved = store(tails.groupBy(group).applyInArrow(merge, "sequence_id long, into long, shift long"), "tails")
    out = made.drop("tail").join(small(moved, 48), "sequence_id", "left")  # a row a task
    place = {"sequence_id": F.coalesce("into", "sequence_id"), "offset": F.col("offset") + F.coalesce("shift", F.lit(0))}
    return out.select(*(place[c].alias(c) if c in place else c for c in made.drop("tail").columns))


def pack(documents: DataFrame, length: int = LENGTH, segments: int = MOST_SEGMENTS, loss: int = MOST_LOSS, pool: int = POOL, vocabulary: tuple[str | None, str | None] = (None, None)) -> DataFrame:
    """documents(doc_id, text) -> a row per piece: where it lies in its document and in its sequence."""

    def fill(batch: pa.RecordBatch, packer: Packer) -> Iterator[None]:
        encode = encoder(*vocabulary, added=True)
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = encode(text.as_py() or "")
            packer.add(doc, np.array([*ids, END_ID], np.uint32))
            yield

    limits = (length, segments, loss)
    return _joined(documents.select(documents["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(_run(fill, limits, pool), SCHEMA + ", tail boolean"), limits)


def pack_examples(examples: DataFrame, length: int = LENGTH, segments: int = MOST_SEGMENTS, loss: int = MOST_LOSS, pool: int = POOL) -> DataFrame:
    """examples(doc_id, ids array<int>, marks array<int>: 1 for each id that bears loss) -> pieces, as ``pack``.

    For instruction data: the third limit then counts marked ids only. Null ids give no piece; null marks mark nothing.
    """

    def fill(batch: pa.RecordBatch, packer: Packer) -> Iterator[None]:
        for doc, ids, marks in zip(*(batch.column(k).to_pylist() for k in range(3))):
            ids = np.array(ids or [], np.uint32)
            marks = np.array(marks if marks is not None else np.zeros(len(ids)), np.int64)
            if len(marks) != len(ids):
                raise ValueError("marks must be as many as ids")
            packer.add(doc, ids, marks)
            yield

    limits = (length, segments, loss)
    return _joined(examples.select(examples["doc_id"].cast("long").alias("doc_id"), "ids", "marks").mapInArrow(_run(fill, limits, pool), SCHEMA + ", tail boolean"), limits)
