"""Sparse matrices in compressed rows, by hand: incidence of runs, transpose, Gustavson's row product."""

import numpy as np


class Csr:
    """Rows of column numbers: row i is ``indices[indptr[i]:indptr[i + 1]]``; every entry is one."""

    def __init__(self, indptr, indices, columns):
        self.indptr, self.indices, self.columns = indptr, indices, columns

    def __len__(self):
        return len(self.indptr) - 1

    def rows(self, first, last):
        """The rows from ``first`` to before ``last``, without a copy of the entries."""
        own = self.indptr[first : last + 1]
        return Csr(own - own[0], self.indices[own[0] : own[-1]], self.columns)

    def transposed(self):
        order = np.argsort(self.indices, kind="stable")
        counts = np.bincount(self.indices, minlength=self.columns)
        row_of = np.repeat(np.arange(len(self)), np.diff(self.indptr))
        return Csr(np.concatenate(([0], np.cumsum(counts))), row_of[order], len(self))


def run_incidence(lengths):
    """One row a token, one column a byte: token i covers the next ``lengths[i]`` bytes."""
    ends = np.concatenate(([0], np.cumsum(lengths)))
    return Csr(ends, np.arange(ends[-1]), int(ends[-1]))


def run_incidence_transposed(lengths):
    """One row a byte, with the token that covers it; what ``run_incidence(..).transposed()`` gives, without a sort."""
    lengths = np.asarray(lengths)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    return Csr(np.arange(len(owner) + 1), owner, len(lengths))


def label_incidence(labels, columns):
    """One row a token with one entry, the group that it belongs to."""
    return Csr(np.arange(len(labels) + 1), labels, columns)


def product_widths(a, b):
    """How many entries of ``b`` each entry of ``a`` brings in: the symbolic half of the product."""
    return (b.indptr[1:] - b.indptr[:-1])[a.indices]


def gustavson(a, b):
    """(row, column, value) of A·B in row order.

    Each entry (i, k) of A brings in row k of B, and equal columns of a result
    row are summed up.  Where rows come out in order, as for runs, nothing is
    sorted.
    """
    widths = product_widths(a, b)
    rows = np.repeat(np.arange(len(a)), np.diff(a.indptr))
    if len(widths) and widths.min() == 1 == widths.max():
        columns = b.indices[b.indptr[a.indices]]
    else:
        rows = np.repeat(rows, widths)
        before = np.cumsum(widths) - widths
        columns = b.indices[np.arange(len(rows)) + np.repeat(b.indptr[a.indices] - before, widths)]
    keys = rows * np.int64(max(1, b.columns)) + columns
    if len(keys) > 1 and (keys[1:] < keys[:-1]).any():
        keys.sort(kind="stable")
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    found = keys[first]
    values = np.diff(np.append(first, len(keys)))
    return found // max(1, b.columns), found % max(1, b.columns), values


def product_blocks(a, b, entries):
    """The product in blocks of rows of A that bring in about ``entries`` entries at most (one row at least)."""
    reach = np.concatenate(([0], np.cumsum(product_widths(a, b))))[a.indptr]
    first = 0
    while first < len(a):
        last = max(first + 1, int(np.searchsorted(reach, reach[first] + entries, side="right")) - 1)
        rows, columns, values = gustavson(a.rows(first, last), b)
        yield rows + first, columns, values
        first = last
