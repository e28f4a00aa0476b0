"""Vectors of Arrow list columns as matrices."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries of a matrix that is worked on at once, 8 MB of doubles.
ENTRIES = 1 << 20


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of doubles) of the vectors of each length, in slices of at most ENTRIES entries. Vectors that are null, or hold null or non-finite entries, are left out."""
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy().astype(np.int64)
    flat = pc.fill_null(pc.cast(column.flatten(), pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.clip(min=0))
    starts = ends - sizes.clip(min=0)
    wrong = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
    good = (sizes >= 0) & (wrong[ends] == wrong[starts])
    for size in np.unique(sizes[good]).tolist():
        rows = np.flatnonzero(good & (sizes == size))
        step = max(1, ENTRIES // max(1, size))
        for lo in range(0, len(rows), step):
            part = rows[lo : lo + step]
            yield part, flat[starts[part][:, None] + np.arange(size)]
