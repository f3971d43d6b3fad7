"""A count-min sketch of one row over what occurs in texts, spread over tasks, and the bits of its cells that pass.

Each chunk of texts gives the counts of its cells. Pages of the sketch meet by their number and are added up; what is left of a
page is a bit for each cell with `least` or more. A cell counts all that falls on it, so nothing that occurs `least`
times is missed. Cells grow with the text, so their load stays the same at every size; the bits that tasks get are bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaylight.llm.common import U64, chunks, flat, free_tables, release_memory, span_hashes

#: Bytes of text for each cell of the sketch.
BYTES_A_CELL = 4
#: Bits of the map of cells that pass, at most: beyond as many cells, several share a bit, which lets more through.
MOST_BITS = 1 << 27
#: Pages of the sketch are of so many cells, or there are as many pages as this.
PAGE_CELLS, LEAST_PAGES = 1 << 22, 256
#: Bytes of text whose cells are counted together.
CHUNK = 4 << 20

#: The cells, in a sketch of 2 ** bits of them, of all that occurs in some rows, as often as it does.
Occurrences = Callable[[pa.RecordBatch, int], np.ndarray]


def text_numbers(column: pa.Array) -> np.ndarray:
    """A 64-bit number for each text of a column, the same in all tasks."""
    raw, offsets = flat(column)
    return span_hashes(raw, offsets[:-1], offsets[1:], 1)[0]


def _page_cells(rows: pa.RecordBatch, occurrences: Occurrences, bits: int, pages: int) -> pa.RecordBatch:
    """(page, cells): the cells of some rows that aren't 0, 24 bits of place in the page and 8 of count, which stops at 255."""
    cells, counts = np.unique(occurrences(rows, bits), return_counts=True)
    page = cells & U64(pages - 1)
    order = np.argsort(page, kind="stable")
    entries = ((cells // U64(pages)) | (np.minimum(counts, 255).astype(U64) << U64(24))).astype("<u4")[order]
    where = np.concatenate(([0], np.cumsum(np.bincount(page.astype(np.int64), minlength=pages))))
    full = np.flatnonzero(np.diff(where))
    return pa.record_batch([pa.array(full, pa.int64()), pa.array([entries[where[p] : where[p + 1]].tobytes() for p in full], pa.binary())], ["page", "cells"])


def _sketch_rows(batches: Iterable[pa.RecordBatch], occurrences: Occurrences, bits: int, pages: int) -> Iterator[pa.RecordBatch]:
    free_tables()
    for batch in batches:
        for a, b in chunks(flat(batch.column("text"))[1], CHUNK):
            yield _page_cells(batch.slice(a, b - a), occurrences, bits, pages)
            release_memory()


def _page_marks(key: tuple, rows: pa.Table, size: int, bits: int, least: int) -> pa.Table:
    """A page's cells added up: (page, marks), a bit for each of its cells, folded to `bits` of them."""
    counts = np.zeros(size, np.uint8)
    for cells in rows.column("cells"):
        x = np.frombuffer(cells.as_buffer(), "<u4")
        at, n = x & 0xFFFFFF, x >> 24
        counts[at] = np.minimum(counts[at] + n, 255)  # a row has a cell once
    marks = np.packbits((counts >= least).reshape(-1, bits).any(0), bitorder="little").tobytes()
    return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([marks], pa.binary())], ["page", "marks"])


class Sketch:
    """The cells that pass. A page holds the cells with equal lowest bits, so its marks are those of a range of the map."""

    def __init__(self, docs: DataFrame, occurrences: Occurrences, least: int):
        """docs: text, and the columns that occurrences reads; no text is null. least: 255 at most."""
        if least > 255:
            raise ValueError("cells count to 255")
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        bits = max(16, (size // BYTES_A_CELL).bit_length())
        pages = max(LEAST_PAGES, (1 << bits) // PAGE_CELLS)
        cells = (1 << bits) // pages
        kept = min(cells, max(8, MOST_BITS // pages))
        rows = docs.mapInArrow(lambda bs: _sketch_rows(bs, occurrences, bits, pages), "page bigint, cells binary")
        done = rows.groupBy("page").applyInArrow(lambda key, held: _page_marks(key, held, cells, kept, least), "page bigint, marks binary")
        marks = np.zeros((pages, kept // 8), np.uint8)
        for page, held in done.collect():  # MOST_BITS at most
            marks[page] = np.frombuffer(held, np.uint8)
        self.bits, self.pages, self.marks = bits, pages, docs.sparkSession.sparkContext.broadcast(marks)

    def passes(self, cells: np.ndarray) -> np.ndarray:
        marks = self.marks.value
        page, place = cells & U64(self.pages - 1), (cells // U64(self.pages)) % U64(8 * marks.shape[1])
        return (marks[page, place >> U64(3)] >> (place & U64(7)).astype(np.uint8)) & 1 == 1
