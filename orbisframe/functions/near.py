"""Neighbours of tiles in flat arrays, for kernels that hold a world."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Near:
    """Neighbours of each tile by its place in the order of fids, in two flat
    arrays: ``near[k]`` is the list of tile ``k``'s."""

    def __init__(self, off: np.ndarray, end: np.ndarray):
        self.off, self.end = off, end

    def __getitem__(self, k: int) -> list[int]:
        return self.end[self.off[k] : self.off[k + 1]].tolist()

    @staticmethod
    def of(fid: np.ndarray, column: pa.ChunkedArray, keep: bool = False) -> tuple[np.ndarray, Near]:
        """The order of the fids, and the neighbours from a column of lists of
        fids; those that are no tile's are left out, or numbered -1 (``keep``)."""
        order = np.argsort(fid, kind="stable")
        known, starts, ends, size, at = fid[order], [], [], [], 0
        for chunk in column.chunks:
            n = np.asarray(pc.fill_null(pc.list_value_length(chunk), 0)).astype(np.int64)
            to = np.asarray(chunk.flatten())
            place = np.minimum(np.searchsorted(known, to), len(known) - 1)
            good = known[place] == to
            if keep:
                place[~good], good[:] = -1, True
            ends.append(place[good].astype(np.int32))
            # of each list, how many are tiles
            upto = np.concatenate(([0], np.cumsum(good)))[np.concatenate(([0], np.cumsum(n)))]
            starts.append(at + upto[:-1])
            size.append(np.diff(upto))
            at += int(upto[-1])
        start, size, end = np.concatenate(starts)[order], np.concatenate(size)[order], np.concatenate(ends)
        off = np.concatenate(([0], np.cumsum(size)))
        if (start != off[:-1]).any():
            end = end[np.repeat(start - off[:-1], size) + np.arange(len(end))]
        return order, Near(off, end)
