"""Packing: sum-of-squares online packing of documents into fixed windows.

Each partition is packed on its own, in one pass. A document of a window or more fills whole windows; its
rest, and any shorter document, goes where it makes the sum over fill levels of (number of partially filled
windows at that level) squared smallest: into a window of some level, into a new one, or, as documents may
be cut, over the end of one, which costs ``CUT_COST`` squares more. The counts are a level array; a level is
``WIDTH`` tokens wide, and a window in the last one, almost full, gets the next document's first tokens. As a
new window costs more the more windows its level has, and a cut does not, few stay open whatever the sizes.

At the end of a partition the fullest open windows are filled up from the emptiest, and the tokens of at most
one window go to sequences whose lengths are powers of two: no sequence is padded. So all but a few tokens
of a partition lie where they were placed.

Defined cases: a null or empty text is the end token alone; a null id stays null; repeated rows are packed
each; a very long text fills windows as it comes, and costs memory of about ten times its bytes; an empty
table gives an empty result; other columns are not read. A lost executor's partition is packed again to
the same sequences: ids depend on the partition's rows only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm import pieces
from marginalia.llm.common import bound_batches, lean, slices, texts_of

WINDOW = 4096
END_TOKEN = 2
#: Tokens of a fill level, and squares that a cut counts for.
WIDTH, CUT_COST = 64, 4
#: Text bytes encoded at once.
SLICE_BYTES = 1 << 20


class Packer:
    """Pieces in, ``(document, start, ids, sequence, offset, length of its document)`` out as windows fill.

    ``moved`` counts the tokens that ``finish`` takes from where they were placed.
    """

    def __init__(self, window: int = WINDOW, width: int = WIDTH, cut_cost: int = CUT_COST, first: int = 0):
        self.window, self.width, self.cut_cost, self.next = window, width, cut_cost, first
        self.last = -(-window // width)
        self.count = np.zeros(self.last + 1, np.int64)  # open windows by level
        self.top = np.zeros(self.last + 1, np.int64)  # fill of the window to be taken from each level
        self.open: list[list[tuple[int, list]]] = [[] for _ in range(self.last + 1)]
        self.moved = 0

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        """Place a document's ids; yields the pieces of windows that this fills."""
        total, at = len(ids), 0
        while total - at >= self.window:
            yield from self._close([(doc, at, ids[at : at + self.window], total)])
            at += self.window
        while at < total:
            level = self.last if self.count[self.last] else self._best(total - at)
            fill, pieces_in = self._take(level) if level else (0, [])
            n = min(total - at, self.window - fill)
            pieces_in.append((doc, at, ids[at : at + n], total))
            at += n
            if fill + n == self.window:
                yield from self._close(pieces_in)
            else:
                self._put(fill + n, pieces_in)

    def finish(self) -> Iterator[tuple]:
        """Fill the fullest open windows up from the emptiest; cut what is left into powers of two."""
        windows = sorted((x for level in self.open for x in level), key=lambda x: -x[0])
        full = sum(fill for fill, _ in windows) // self.window
        rest = [p for _, window in windows[full:] for p in window]
        for fill, window in windows[:full]:
            want = self.window - fill
            self.moved += want
            while want:
                doc, at, ids, total = rest.pop()
                n = min(want, len(ids))
                window.append((doc, at + len(ids) - n, ids[len(ids) - n :], total))
                if n < len(ids):
                    rest.append((doc, at, ids[: len(ids) - n], total))
                want -= n
            yield from self._close(window)
        left = sum(len(p[2]) for p in rest)
        rest.reverse()
        while left:
            want, now = 1 << (left.bit_length() - 1), []
            left -= want
            while want:
                doc, at, ids, total = rest.pop()
                n = min(want, len(ids))
                now.append((doc, at, ids[:n], total))
                if n < len(ids):
                    rest.append((doc, at + n, ids[n:], total))
                want -= n
            yield from self._close(now)

    def _level(self, fill: np.ndarray) -> np.ndarray:
        return -(-fill // self.width)

    def _best(self, size: int) -> int:
        """The level whose use makes the sum of squared level counts smallest, cuts included; 0 opens a window.

        Of equals a placement without a cut comes first, then the fullest.
        """
        at = np.flatnonzero(self.count)[::-1]
        new = 2 * int(self.count[-(-size // self.width)]) + 1
        if not len(at):
            return 0
        before, end = self.count[at], self.top[at] + size
        over = end > self.window
        to = self._level(np.where(over, end - self.window, end))
        after = self.count[to]
        change = np.where(to == at, 0, 2 * (after - before) + 2)
        change[end == self.window] = 1 - 2 * before[end == self.window]  # a full window leaves the levels
        # a cut: the window leaves the levels, and the rest opens one
        rest = np.where(to == at, after - 1, after)
        change[over] = (1 - 2 * before + 2 * rest + 1 + self.cut_cost)[over]
        k = int(np.lexsort((over, change))[0])
        return int(at[k]) if change[k] < new or change[k] == new and not over[k] else 0

    def _take(self, level: int) -> tuple[int, list]:
        self.count[level] -= 1
        windows = self.open[level]
        out = windows.pop()
        if windows:
            self.top[level] = windows[-1][0]
        return out

    def _put(self, fill: int, window: list) -> None:
        level = -(-fill // self.width)
        self.count[level] += 1
        self.top[level] = fill
        self.open[level].append((fill, window))

    def _close(self, window: list) -> Iterator[tuple]:
        sequence, offset = self.next, 0
        self.next += 1
        for doc, at, ids, total in window:
            yield doc, at, ids, sequence, offset, total
            offset += len(ids)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_token: int = END_TOKEN, with_ids: bool = True) -> DataFrame:
    """One row per piece: ``id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, with ``with_ids``, ``ids``."""

    def rows(pieces_out, kind) -> pa.RecordBatch:
        doc, at, ids, sequence, offset, total = zip(*pieces_out, strict=True)
        crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
        columns = {"id": pa.array(doc, kind)} | {k: pa.array(v, pa.int64()) for k, v in (("start", at), ("length", [len(x) for x in ids]), ("ids_crc32", crc), ("doc_tokens", total), ("sequence_id", sequence), ("offset", offset))}
        if with_ids:
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
            columns["ids"] = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(ids).astype(np.int32)))
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    def run(batches):
        coder, kind, out = pieces.encoder(tokenizer), pa.int64(), []
        packer = Packer(window, first=TaskContext.get().partitionId() << 33)
        for batch in batches:
            kind = batch.schema.field("id").type
            for part in slices(batch, "text", SLICE_BYTES):
                flat, bounds = coder.encode(texts_of(part))
                for i, doc in enumerate(part.column("id").to_pylist()):
                    out += packer.add(doc, np.append(flat[bounds[i] : bounds[i + 1]], np.uint32(end_token)))
                if out:
                    yield rows(out, kind)
                    out = []
        out += packer.finish()
        if out:
            yield rows(out, kind)

    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(lean(run), schema).withColumnRenamed("id", id_col)
