"""Operator 8: byte-level BPE, encoding and decoding.

Merges come from a rank queue: a bucket for each merge rank holds linked-list positions, a hierarchical bitmap over the ranks says
which buckets have any, find-first-set gives the lowest; entries whose pair is gone are skipped when met. Work grows with the merges
made, so a pre-token of a million bytes costs no square. Short pre-tokens share one queue: they lie one after the other with a gap
between, and a step takes the leftmost entry of the lowest bucket in each of them, which is what each would take on its own. Texts are
cut only at blanks between two other characters, which no match of the pattern spans from left to right; distinct parts of a block are
encoded once, and what a worker has encoded lately it keeps within bounds.

Cases: null text counts as empty: no token, and the digests of no bytes; lone or rare code points are their UTF-8 bytes; rows
are independent, so repeated rows and other columns change nothing. A text is encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import parts
from .common import byte_blocks, held
from .tokens import Known

#: Bytes of pre-tokens that share a queue: each one's at most, and all of them about.
SHORT, TOGETHER = 64, 4 << 20
#: Bits of a word of the bitmap's lower level; the upper level has a bit for each of its words.
WORD = 8
LOW = (1 << WORD) - 1
BIT = [1 << i for i in range(1 << 12)]

ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class ByteBpe:
    def __init__(self, path: str, pattern: str):
        import pyarrow as pa
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        if max(self.ranks.values()) >> WORD >= len(BIT):
            raise ValueError("more ranks than the bitmap holds")
        self.findall = regex.compile(pattern).findall
        self.pieces, self.others = Known(self.make_pieces), Known(self.make_others)
        self.lookup = self.pairs()
        ranks = range(max(self.tokens) + 1)
        self.spelled = [pa.array(x, pa.large_binary()) for x in ([b"%d " % i for i in ranks], [self.tokens.get(i, b"") for i in ranks])]

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n, get = len(piece), ranks.get
        after, before = list(range(1, n + 2)), list(range(-1, n))
        after[n] = n  # position i covers piece[i:after[i]]
        # The queue: a bucket of positions by rank (a number, or a heap where a rank waits more than once); words has a bit
        # for each bucket, upper a bit for each word that isn't empty.
        buckets: dict = {}
        words: dict[int, int] = {}
        upper, bit, seen = 0, BIT, words.get
        pair = [get(piece[i : i + 2]) for i in range(n - 1)]
        pair += (None, None)
        i = -1
        for rank in pair:
            i += 1
            if rank is not None:
                if rank in buckets:
                    had = buckets[rank]
                    if had.__class__ is int:
                        buckets[rank] = [had, i]
                    else:
                        had.append(i)
                else:
                    buckets[rank] = i
                    high = rank >> WORD
                    words[high] = seen(high, 0) | bit[rank & LOW]
                    upper |= bit[high]
        while upper:
            high = (upper & -upper).bit_length() - 1
            word = words[high]
            first = word & -word
            rank = high << WORD | first.bit_length() - 1
            i = buckets[rank]
            if i.__class__ is list and len(i) > 1:
                i = heapq.heappop(i)
            else:
                if i.__class__ is list:
                    i = i[0]
                del buckets[rank]
                words[high] = word = word ^ first
                if not word:
                    upper ^= bit[high]
            if pair[i] != rank:
                continue  # its pair is gone
            gone = after[i]
            after[i] = end = after[gone]
            pair[gone] = pair[i] = None
            left = before[i]
            if end < n:
                before[end] = i
                new = get(piece[i : after[end]])
                if new is not None:
                    pair[i] = new
                    if new in buckets:
                        had = buckets[new]
                        if had.__class__ is int:
                            buckets[new] = [had, i] if had < i else [i, had]
                        else:
                            heapq.heappush(had, i)
                    else:
                        buckets[new] = i
                        high = new >> WORD
                        words[high] = seen(high, 0) | bit[new & LOW]
                        upper |= bit[high]
            if left >= 0:
                pair[left] = new = get(piece[left:end])
                if new is not None:
                    if new in buckets:
                        had = buckets[new]
                        if had.__class__ is int:
                            buckets[new] = [had, left] if had < left else [left, had]
                        else:
                            heapq.heappush(had, left)
                    else:
                        buckets[new] = left
                        high = new >> WORD
                        words[high] = seen(high, 0) | bit[new & LOW]
                        upper |= bit[high]
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : after[i]]])
            i = after[i]
        return ids

    def pairs(self):
        """Pairs of ranks whose bytes together are a token: left << 32 | right in ascending order, and the token's rank."""
        import numpy as np

        ranks, key, value = self.ranks, array("q"), array("q")
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    key.append(left << 32 | right)
                    value.append(rank)
        key, value = np.array(key), np.array(value)
        order = np.argsort(key)
        return np.append(key[order], 1 << 62), np.append(value[order], -1)

    def merge_together(self, pieces: list[bytes]):
        """Ids of many short pre-tokens, one after the other, and how many each has, by one queue."""
        import numpy as np

        keys, values = self.lookup
        data = b"\x00".join([b"", *pieces, b""])  # a gap before each piece and after the last
        n = len(data)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        gaps = np.insert(np.cumsum(sizes + 1), 0, 0)
        single = np.array([self.ranks.get(bytes([i]), -1) for i in range(256)])
        token = single[np.frombuffer(data, np.uint8)]
        token[gaps] = -1
        of = np.repeat(np.arange(len(gaps)), np.append(sizes + 1, 1))
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        alive = token >= 0

        def ranks_of(left, right):
            key = left << 32 | right
            at = np.searchsorted(keys, key)
            return np.where((keys[at] == key) & (left >= 0) & (right >= 0), values[at], -1)

        pair = np.append(ranks_of(token[:-1], token[1:]), -1)
        # The queue: buckets of positions by rank; words has a bit for each bucket, upper a bit for each word that isn't empty.
        buckets: dict[int, list] = {}
        words: dict[int, int] = {}
        upper, bit = 0, BIT

        def put(places, ranks):
            nonlocal upper
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            edges = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            firsts = [0, *edges.tolist()]
            for rank, a, b in zip(ranks[firsts].tolist(), firsts, [*firsts[1:], len(ranks)]):
                if rank in buckets:
                    buckets[rank].append(places[a:b])
                else:
                    buckets[rank] = [places[a:b]]
                    high = rank >> WORD
                    words[high] = words.get(high, 0) | bit[rank & LOW]
                    upper |= bit[high]

        waiting = np.flatnonzero(pair >= 0)
        if len(waiting):
            put(waiting, pair[waiting])
        while upper:
            high = (upper & -upper).bit_length() - 1
            word = words[high]
            first = word & -word
            rank = high << WORD | first.bit_length() - 1
            entries = buckets.pop(rank)
            words[high] = word = word ^ first
            if not word:
                upper ^= bit[high]
            at = np.concatenate(entries) if len(entries) > 1 else entries[0]
            at = at[pair[at] == rank]  # of the others the pair is gone
            if not len(at):
                continue
            if len(at) > 1:
                if len(entries) > 1:
                    at.sort()
                    at = at[np.insert(at[1:] != at[:-1], 0, True)]
                owner = of[at]
                again = owner[1:] == owner[:-1]
                if again.any():  # a piece takes its leftmost entry and looks again
                    later = np.insert(again, 0, False)
                    put(at[later], np.full(int(later.sum()), rank))
                    at = at[~later]
            gone = after[at]
            end, left = after[gone], before[at]
            after[at], before[end] = end, at
            token[at], alive[gone] = rank, False
            pair[gone] = -1
            pair[at] = right_rank = ranks_of(token[at], token[end])
            pair[left] = left_rank = ranks_of(token[left], token[at])
            places, ranks = np.concatenate([at, left]), np.concatenate([right_rank, left_rank])
            new = ranks >= 0
            if new.any():
                put(places[new], ranks[new])
        return token[alive], np.bincount(of[alive], minlength=len(gaps))[: len(pieces)]

    def make_pieces(self, pieces: list[bytes]) -> dict[bytes, tuple[bytes, bytes]]:
        """Of pre-tokens: decimal ids, a blank after each, and the bytes that the ids decode to."""
        import numpy as np

        made: dict[bytes, tuple[bytes, bytes]] = {}

        def keep(own: list[bytes], ids, counts) -> None:
            bounds = np.insert(np.cumsum(counts), 0, 0)
            both = []
            for values in self.spelled:
                data, at = parts.joined(values, ids, bounds)
                data, at = bytes(data), at.tolist()
                both.append([data[a:b] for a, b in zip(at, at[1:])])
            made.update(zip(own, zip(*both)))

        ranks = self.ranks
        own = [x for x in pieces if x in ranks]
        keep(own, np.array([ranks[x] for x in own], np.int64), np.ones(len(own), np.int64))
        short, size = [], 0
        for piece in pieces:
            if piece in ranks:
                continue
            if len(piece) > SHORT:
                ids = self.merge(piece)
                keep([piece], np.array(ids), [len(ids)])
                continue
            short.append(piece)
            size += len(piece)
            if size > TOGETHER:
                keep(short, *self.merge_together(short))
                short, size = [], 0
        if short:
            keep(short, *self.merge_together(short))
        return made

    def make_others(self, texts: list[bytes]) -> dict[bytes, tuple[bytes, bytes]]:
        """The same of parts of texts that are not letters with marks."""
        cut = [[x.encode("utf-8", "surrogatepass") for x in self.findall(text.decode("utf-8", "surrogatepass"))] for text in texts]
        self.pieces.learn({x for own in cut for x in own})
        known = self.pieces
        return {text: tuple(b"".join([known[x][k] for x in own]) for k in (0, 1)) for text, own in zip(texts, cut)}

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def whole(self, text: str | None) -> tuple[bytes, bytes, int]:
        """Decimal ids joined by a blank, the bytes they decode to, and their number, of one text."""
        import pyarrow as pa

        (ids, _), (decoded, _) = self.encode_all(pa.array([text], pa.string()))
        return bytes(ids)[:-1], bytes(decoded), bytes(ids).count(b" ")

    def encode_all(self, column):
        """Of all texts of an Arrow column: decimal ids, a blank after each, one after the other, and each text's first byte (with the end
        of the last); then the same of the bytes that the ids decode to."""
        import numpy as np
        import pyarrow as pa

        raw, at = parts.buffered(column)
        cuts = np.sort(np.concatenate([at, cut_places(raw)]))
        cuts = cuts[np.insert(cuts[1:] != cuts[:-1], 0, True)]
        pieces = parts.coded(raw, cuts)
        cores, marks, others, codes, bounds = parts.cored(*pieces, np.searchsorted(cuts, at), blank_first=True)
        self.others.learn(set(others))
        self.pieces.learn({*cores, *marks})
        found = [*map(self.pieces.__getitem__, [*cores, *marks]), *map(self.others.__getitem__, others)]
        return [parts.joined(pa.array([x[k] for x in found], pa.large_binary()), codes, bounds) for k in (0, 1)]


def cut_places(raw):
    """Blanks between two characters that are no white space. Where the bytes nearby may be white space beyond ASCII, none is taken."""
    import numpy as np

    if len(raw) < 5:
        return np.zeros(0, np.int64)
    padded = np.concatenate([np.full(3, 0x20, np.uint8), raw, np.full(1, 0x20, np.uint8)])
    at = np.flatnonzero(raw == 0x20)
    before, two, three, after = (padded[at + k] for k in (2, 1, 0, 4))
    solid = lambda x: (x > 0x20) & (x != 0x7F)
    wide = lambda x: (x == 0xE1) | (x == 0xE2) | (x == 0xE3)
    ok = solid(before) & solid(after) & ~((before >= 0x80) & ((two == 0xC2) | wide(three))) & (after != 0xC2) & ~wide(after)
    return at[ok]


def coder(path: str, pattern: str) -> ByteBpe:
    """One for each worker process and vocabulary."""
    return held(("bytes", path, pattern), lambda: ByteBpe(path, pattern))


def encode_documents(docs: DataFrame, path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """Digests of the ids and of what they decode to; with keep_ids also `ids` (binary, little-endian unsigned 32-bit)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        bpe, names = coder(path, pattern), [x.split()[0] for x in schema.split(", ")]
        for batch in byte_blocks(batches):
            (ids, at), (decoded, end) = bpe.encode_all(batch["text"])
            spans = list(zip(at.tolist(), at[1:].tolist()))
            blanks = np.insert(np.cumsum(np.frombuffer(ids, np.uint8) == 0x20), 0, 0)
            cols = [
                batch["doc_id"],
                pa.array(np.diff(blanks[at])),
                [hashlib.sha256(ids[a : max(a, b - 1)]).hexdigest() for a, b in spans],
                [hashlib.sha256(decoded[a:b]).hexdigest() for a, b in zip(end.tolist(), end[1:].tolist())],
            ]
            if keep_ids:
                cols.append(pa.array([np.array(bytes(ids[a:b]).split(), dtype="<u4").tobytes() for a, b in spans], pa.binary()))
            yield pa.record_batch(cols, names=names)

    schema = ENCODED + ", ids binary" * keep_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """`ids` back to bytes: doc_id, decoded (binary)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        bpe = coder(path, pattern)
        for batch in batches:
            texts = [bpe.decode(np.frombuffer(x.as_py() or b"", "<u4").tolist()) for x in batch["ids"]]
            yield pa.record_batch([batch["doc_id"], pa.array(texts, pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")
