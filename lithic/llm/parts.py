"""Texts of a block parted into words or other pieces at once: distinct pieces, a code for each place, and the places of each text.

The texts lie one after the other in an Arrow buffer, so blanks are found, and pieces made and told apart, without an object for each.
"""

from __future__ import annotations

#: `[\\x20\\x09-\\x0D]`
BLANKS = b" \t\n\x0b\x0c\r"


def buffered(column):
    """Bytes of all texts one after the other, and each text's first byte (with the end of the last); null: empty."""
    import numpy as np
    import pyarrow as pa

    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def coded(data, offsets):
    """Distinct pieces (Arrow, binary) and the code of each piece. Piece i is data[offsets[i]:offsets[i + 1]]."""
    import numpy as np
    import pyarrow as pa

    pieces = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data)])
    found = pieces.dictionary_encode()
    return found.dictionary, found.indices.to_numpy()


def compacted(column, blanks: bytes = BLANKS, table: bytes | None = None):
    """The words' bytes without what parts them, each word's first byte there (with the end of the last), and each text's first word (with the
    end of the last). table: 256 bytes that replace the texts' first."""
    import numpy as np

    raw, at = buffered(column)
    if table is not None:
        raw = np.frombuffer(table, np.uint8)[raw]
    is_blank = np.zeros(256, bool)
    is_blank[list(blanks)] = True
    blank = is_blank[raw]
    edge = ~blank
    solid = raw[edge]
    where = np.flatnonzero(blank)
    edge[1:] &= blank[:-1]
    firsts = at[:-1][at[:-1] < len(raw)]
    edge[firsts] = ~blank[firsts]
    starts = np.flatnonzero(edge)
    offsets = np.append(starts - np.searchsorted(where, starts), len(solid))
    return solid, offsets, np.searchsorted(starts, at)


def words(column, blanks: bytes = BLANKS, table: bytes | None = None):
    """Distinct words (Arrow, binary), the code of each word, and each text's first word (with the end of the last)."""
    solid, offsets, bounds = compacted(column, blanks, table)
    return *coded(solid, offsets), bounds


#: ASCII marks.
MARKS = bytes(i for i in range(0x21, 0x7F) if not chr(i).isalnum())


def lettered(pieces, lower: bool, blank_first: bool):
    """Distinct pieces (Arrow) as a core of plain letters and the ASCII marks after it: mask of the pieces that are so, and of these the
    distinct cores and marks with their codes. Plain letters are those of ASCII and Latin-1: each has one lower-case letter and is in
    composed form. lower: cores in lower case; blank_first: a piece must begin with a blank, which belongs to the core."""
    import numpy as np

    raw, at = buffered(pieces)
    if not len(raw):
        return np.zeros(len(pieces), bool), ([], np.zeros(0, int)), ([], np.zeros(0, int))
    is_mark, is_letter = np.zeros((2, 256), bool)
    is_mark[list(MARKS)] = True
    is_letter[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3]] = True
    second = np.zeros(len(raw), bool)
    second[1:] = raw[:-1] == 0xC3
    letter = is_letter[raw] | (second & (raw != 0x97) & (raw != 0xB7))
    first, size = at[:-1], np.diff(at)
    full = size > 0
    if blank_first:
        letter[first[full]] = raw[first[full]] == 0x20
    place = np.arange(len(raw))
    end = np.zeros(len(first), np.int64)  # of the core
    end[full] = np.maximum.reduceat(np.where(is_mark[raw], -1, place), first[full]) + 1
    wrong = np.insert(np.cumsum(~letter), 0, 0)
    plain = end > first + blank_first
    plain &= wrong[np.maximum(end, first)] == wrong[first]
    of = np.repeat(np.arange(len(first)), size)
    in_core, in_plain = place < end[of], plain[of]
    if lower:
        change = np.arange(256, dtype=np.uint8)
        change[0x41:0x5B] += 0x20
        low = second & (raw < 0x9F)
        raw = change[raw]
        raw[low] += 0x20
    found = []
    for chosen, sizes in ((in_core & in_plain, end - first), (~in_core & in_plain, at[1:] - end)):
        distinct, codes = coded(raw[chosen], np.insert(np.cumsum(sizes[plain]), 0, 0))
        found.append((distinct.to_pylist(), codes))
    return plain, *found


def cored(distinct, codes, bounds, lower: bool = False, blank_first: bool = False):
    """Pieces parted into cores and marks: distinct cores, marks and other pieces; the codes in these three lists, one after the other, for
    all places, and each text's first of them (with the end of the last)."""
    import numpy as np

    plain, (cores, core), (marks, mark) = lettered(distinct, lower, blank_first)
    other = np.flatnonzero(~plain)
    two = np.full((len(plain), 2), -1)
    two[plain, 0] = core
    if b"" in marks:
        mark = np.where(mark == marks.index(b""), -1 - len(cores), mark)
    two[plain, 1] = mark + len(cores)
    two[other, 0] = np.arange(len(other)) + len(cores) + len(marks)
    flat = two[codes]
    used = flat >= 0
    before = np.insert(np.cumsum(used.sum(axis=1)), 0, 0)
    return cores, marks, distinct.take(other).to_pylist(), flat[used], before[bounds]


def joined(values, codes, bounds):
    """The values (Arrow, binary) of each text's pieces one after the other: all bytes, and each text's first (with the end of the last)."""
    import numpy as np
    import pyarrow as pa

    taken = values.cast(pa.large_binary()).take(pa.array(codes))
    _, offsets, data = taken.buffers()
    at = np.frombuffer(offsets, np.int64)[taken.offset : taken.offset + len(taken) + 1] if len(taken) else np.zeros(1, np.int64)
    return memoryview(data or b""), at[bounds]
