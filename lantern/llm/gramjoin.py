"""Pairs of two sides' records that share enough of their grams, from files that tasks read instead of rows that travel.

A row of the index is one record: its grams as 32-bit codes, rarest first.  A task holds one block of the evaluation side and
reads its part of the training side file by file, so what lies on disk is the index alone, whatever the grams' frequencies.
All records order their grams alike.  Records of n and m grams that share s have their first common gram no later than place
n - s + 1 of the one and m - s + 1 of the other, so only these prefixes are probed.  Two grams of one code are taken for the
same: that adds pairs and loses none, since as many codes are shared as grams at least.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import Broadcast

#: Bits of a record's sketch, and rows of it that are unpacked at once.
BITS, UNPACKED = 512, 8192
#: Pairs that are looked at together; from this many on, a gram's rows are compared as a table, else listed one by one.
AT_ONCE, TABLE = 1 << 18, 512
#: Found pairs of one part that are held; beyond it the part is halved.
HELD = 4_000_000


def ordered(offsets: np.ndarray, grams: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The codes of each record, in one order for all: by the rank of the gram's bucket, then by code."""
    g = grams.view(np.uint64)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(offsets))
    key = (row << np.uint64(40)) | (rank[(g & np.uint64(len(rank) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(32)) | (g >> np.uint64(32))
    key.sort()
    return (key & np.uint64(0xFFFFFFFF)).astype("<u4")


def _read(uri: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, numbers of grams and all codes, one record after the other, of a file of the index."""
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as f:
        table = pq.ParquetFile(f).read(columns=["_cls", "_codes"])
    ids, codes = table.column("_cls").to_numpy(), table.column("_codes").combine_chunks()
    parts = codes.chunks if isinstance(codes, pa.ChunkedArray) else [codes]
    sizes, flat = [np.empty(0, np.int64)], [np.empty(0, "<u4")]
    for part in parts:
        if len(part):
            at = np.frombuffer(part.buffers()[1], np.int32)[part.offset : part.offset + len(part) + 1]
            sizes.append(np.diff(at) // 4)
            flat.append(np.frombuffer(part.buffers()[2], "<u4", int(at[-1] - at[0]) // 4, int(at[0])))
    return ids, np.concatenate(sizes).astype(np.int64), np.concatenate(flat)


class _Block:
    """Records with the places of their prefixes, by code; within a code, those come first that a smaller record can have."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, codes: np.ndarray, contained: float, least_size: float, start: int) -> None:
        self.ids, self.n, self.codes = ids, n.astype(np.int32), codes
        self.at = np.cumsum(n) - n
        self.need = np.ceil(contained * n).astype(np.int32)
        place = np.arange(len(codes)) - np.repeat(self.at, n)
        long = n - np.ceil(contained * np.ceil(least_size * n)).astype(np.int64)
        kept = np.flatnonzero(place <= np.repeat(long, n))
        rec = np.repeat(np.arange(len(n), dtype=np.int32), n)[kept]
        left = (self.n[rec] - place[kept]).astype(np.int32)
        code, late = codes[kept], left < self.need[rec]
        order = np.argsort((code.astype(np.uint64) << np.uint64(1)) | late.astype(np.uint64))
        self.rec, self.left = rec[order], left[order]
        before = np.full(len(codes), start, np.int64)
        before[1:] = codes[:-1]
        before[self.at[n > 0]] = start  # no two first places have a gram before in common
        self.prev = before[kept][order]
        code, late = code[order], late[order]
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.empty(0, np.int64)
        self.code, self.first, self.end = code[first], first, np.r_[first[1:], len(code)].astype(np.int64)
        self.mid = first + np.add.reduceat(~late, first, dtype=np.int64) if len(first) else first
        self.bits = np.empty((BITS // 64, len(n)), np.uint64)
        for i in range(0, len(n), UNPACKED):
            some = n[i : i + UNPACKED]
            marks = np.zeros((len(some), BITS), np.uint8)
            marks[np.repeat(np.arange(len(some)), some), codes[self.at[i] : self.at[i] + some.sum()] % BITS] = 1
            self.bits[:, i : i + UNPACKED] = np.packbits(marks, axis=1).view(np.uint64).T
        #: Grams that the sketch doesn't tell apart from others of the record.
        self.spare = self.n - np.bitwise_count(self.bits).sum(axis=0, dtype=np.int32)


def _pairs(t: _Block, e: _Block, contained: float, least_size: float) -> np.ndarray | None:
    """(row of t) * len(e) + (row of e), each once, of the pairs that may share enough; None if they are too many to hold."""
    _, ti, ei = np.intersect1d(t.code, e.code, assume_unique=True, return_indices=True)
    # One of the two is the smaller record and has the gram in its short prefix: all of t by the short of e, the short of t by the rest of e.
    t0 = np.r_[t.first[ti], t.first[ti]]
    t1 = np.r_[t.end[ti], t.mid[ti]]
    e0 = np.r_[e.first[ei], e.mid[ei]]
    e1 = np.r_[e.mid[ei], e.end[ei]]
    area = (t1 - t0) * (e1 - e0)
    width, found, held = len(e.ids), [], 0

    def met(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For places of t and e that broadcast: whether the pair can be near here first, how many bits both need, and the rows."""
        x, y = t.rec[a], e.rec[b]
        n, m = t.n[x], e.n[y]
        less, need = np.minimum(n, m), np.minimum(t.need[x], e.need[y])
        ok = (t.prev[a] != e.prev[b]) & (np.minimum(t.left[a], e.left[b]) >= need) & (less >= least_size * np.maximum(n, m)) & (t.ids[x] != e.ids[y])
        # Records have no more in common than the bits of both and the grams that have no bit of their own.
        return ok, need - np.minimum(t.spare[x], e.spare[y])

    def listed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok, need = met(a, b)
        at = np.flatnonzero(ok)
        x, y, need = t.rec[a[at]], e.rec[b[at]], need[at]
        return (x.astype(np.int64) * width + y)[common(x, y, need)]

    def common(x: np.ndarray, y: np.ndarray, need: np.ndarray) -> np.ndarray:
        both = np.zeros(np.broadcast_shapes(x.shape, y.shape), np.int16)
        for mine, theirs in zip(t.bits, e.bits, strict=True):
            both += np.bitwise_count(mine[x] & theirs[y])
        return both >= need

    def add(keys: np.ndarray) -> bool:
        nonlocal found, held
        if len(keys):
            found.append(keys)
            held += len(keys)
            if held > HELD:
                found = [np.unique(np.concatenate(found))]
                held = len(found[0])
                return held <= HELD // 2 or len(t.ids) == 1
        return True

    large = np.flatnonzero(area >= TABLE)
    for k in large:
        step = max(1, AT_ONCE // int(t1[k] - t0[k]))
        a = np.arange(t0[k], t1[k])[:, None]
        for at in range(e0[k], e1[k], step):
            b = np.arange(at, min(at + step, e1[k]))[None, :]
            ok, need = met(a, b)
            ok &= common(t.rec[a], e.rec[b], need)
            i, j = np.nonzero(ok)
            if not add(t.rec[a[i, 0]].astype(np.int64) * width + e.rec[b[0, j]]):
                return None
    small = np.flatnonzero((area > 0) & (area < TABLE))
    upto = np.cumsum(area[small])
    at = 0
    while at < len(small):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + AT_ONCE, "right")))
        k = small[at:to]
        each = np.repeat(k, area[k])
        place = np.arange(len(each)) - np.repeat(np.cumsum(area[k]) - area[k], area[k])
        wide = (e1 - e0)[each]
        if not add(listed(t0[each] + place // wide, e0[each] + place % wide)):
            return None
        at = to
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


def _shared(t: _Block, e: _Block, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many of the codes of x the other, y, has too."""
    out = np.zeros(len(x), np.int64)
    upto = np.cumsum(np.maximum(t.n[x], e.n[y]).astype(np.int64))
    at = 0
    while at < len(x):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + AT_ONCE, "right")))

        def keys(s: _Block, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            n = s.n[rows].astype(np.int64)
            pair = np.repeat(np.arange(len(rows)), n)
            return pair, (pair.astype(np.uint64) << np.uint64(32)) | s.codes[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(s.at[rows], n)]

        pair, mine = keys(t, x[at:to])
        out[at:to] = np.bincount(pair[np.isin(mine, keys(e, y[at:to])[1])], minlength=to - at)
        at = to
    return out


def near(cells: Broadcast, contained: float, least_size: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over the numbers of cells, each the files of an evaluation block and those of a part of training: (_a, _b)."""

    def part(t: tuple[np.ndarray, np.ndarray, np.ndarray], e: _Block) -> Iterator[pa.RecordBatch]:
        block = _Block(*t, contained, least_size, -1)
        keys = _pairs(block, e, contained, least_size)
        if keys is None:
            ids, n, codes = t
            half = len(ids) // 2
            cut = int(n[:half].sum())
            yield from part((ids[:half], n[:half], codes[:cut]), e)
            yield from part((ids[half:], n[half:], codes[cut:]), e)
            return
        for i in range(0, len(keys), AT_ONCE):
            x, y = np.divmod(keys[i : i + AT_ONCE], len(e.ids))
            ok = _shared(block, e, x, y) >= np.minimum(block.need[x], e.need[y])
            yield pa.RecordBatch.from_arrays([pa.array(block.ids[x[ok]]), pa.array(e.ids[y[ok]])], ["_a", "_b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column(0).to_pylist():
                of_e, of_t = cells.value[cell]
                ids, n, codes = (np.concatenate(x) for x in zip(*map(_read, of_e), strict=True))
                e = _Block(ids, n, codes, contained, least_size, -2)
                for uri in of_t:
                    yield from part(_read(uri), e)

    return run
