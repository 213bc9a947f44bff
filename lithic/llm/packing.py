"""Operator 5: best-fit packing of token pieces into sequences, by bin completion.

Only lengths matter to the packing, and there are at most `capacity` of them, so the planner works on a histogram of bounded size
whatever the number of documents. The incumbent is the better of best-fit decreasing over all pieces and a greedy plan that takes the
least-waste filling for the longest length left, each filling as often as the counts allow at once. Unless it meets the lower bound,
branch and bound follows: a node takes the longest length left and branches over the undominated fillings of the room beside it, each
as often as possible and once, and goes back where the waste so far leaves no plan with fewer sequences than the incumbent. A filling
is dominated if some of its lengths can be swapped for one length that is left, at least as long together and within the room, or if
one more fits. The search ends with the proof that no plan is shorter, or with its budget: PLAN_NODES placed lengths in all, and
FILLING_NODES for the fillings of one node. The number of patterns follows the number of lengths, not that of documents. Pieces then
find their places by rank within their length; the ranks come from salted counts, so a length that a third of all documents share is
never ranked in one task.

Cases: null and empty text give one piece, the end id; a document longer than the capacity is cut, its last piece may be
shorter; equal lengths are ranked by document and piece; an empty table gives no row; rows with the same doc_id are packed
each on its own, told apart by the order of their texts.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import byte_blocks, cut

CAPACITY = 4096
#: Parts of a length that are ranked apart.
SALTS = 16
#: Nodes that the search of one filling may visit before the incumbent is taken.
NODES = 20_000
#: Lengths in one searched filling, at most; the incumbent may have more.
DEPTH = 300
#: Lengths that the search over whole plans may place, in all and for the fillings of one node.
PLAN_NODES, FILLING_NODES = 400_000, 4_000

PIECES = "doc_id long, copy long, piece int, start long, length long, ids_crc32 long"


def best_filling(room: int, counts: dict[int, int], lengths: list[int], nodes: int = NODES) -> list[int]:
    """Lengths for `room` with the least waste found. lengths: ascending, those with a count left."""

    def fit(space: int, below: int) -> int:
        """Place in lengths of the longest that fits, at most at place `below`."""
        return min(below, bisect_right(lengths, space) - 1)

    def usable(at: int, taken: dict[int, int]) -> int:
        while at >= 0 and counts[lengths[at]] - taken.get(lengths[at], 0) <= 0:
            at -= 1
        return at

    # Incumbent: best fit, the longest that fits, again and again.
    best, space, taken, at = [], room, {}, len(lengths) - 1
    while (at := usable(fit(space, at), taken)) >= 0:
        best.append(lengths[at])
        taken[lengths[at]] = taken.get(lengths[at], 0) + 1
        space -= lengths[at]
    least = space
    if not least or not best:
        return best
    # Depth first: in each node the next length is no longer than the last, so that a set of lengths is met once.
    chosen: list[int] = []
    taken = {}
    shortest = lengths[0]

    def search(space: int, top: int) -> None:
        nonlocal best, least, nodes
        at = usable(fit(space, top), taken)
        while at >= 0 and least and nodes > 0:
            nodes -= 1
            size = lengths[at]
            rest = space - size
            chosen.append(size)
            taken[size] = taken.get(size, 0) + 1
            if rest < least:
                best, least = chosen[:], rest
            if least and rest >= shortest and len(chosen) < DEPTH:
                search(rest, at)
            taken[size] -= 1
            chosen.pop()
            at = usable(at - 1, taken)
            # Bound: where one more length is all that fits, the shorter ones waste more than this one would.
            if at >= 0 and 2 * shortest > space and space - lengths[at] >= least:
                return

    # The second length decides most: take it from long to short, and pair the rest with an exact two-item completion first.
    for place in range(fit(room, len(lengths) - 1), -1, -1):
        size = lengths[place]
        rest = room - size
        mate = bisect_right(lengths, rest) - 1
        if mate < 0 or mate > place:
            if mate > place:
                break
            continue
        if counts[lengths[mate]] - (lengths[mate] == size) > 0 and rest - lengths[mate] < least:
            best, least = [size, lengths[mate]], rest - lengths[mate]
            if not least:
                return best
    search(room, len(lengths) - 1)
    return best


def greedy(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Patterns by the best filling of the longest length left, again and again."""
    counts = {k: n for k, n in histogram.items() if n > 0}
    lengths = sorted(counts)
    patterns = []
    while lengths:
        longest = lengths[-1]
        counts[longest] -= 1
        left = lengths if counts[longest] else lengths[:-1]
        filling = best_filling(capacity - longest, counts, left) if left else []
        counts[longest] += 1
        pattern: dict[int, int] = {}
        for size in (longest, *filling):
            pattern[size] = pattern.get(size, 0) + 1
        times = min(counts[size] // n for size, n in pattern.items())
        patterns.append((times, pattern))
        for size, n in pattern.items():
            counts[size] -= times * n
            if not counts[size]:
                del counts[size]
                lengths.remove(size)
    return patterns


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Patterns of best-fit decreasing: long to short, each piece into the sequence with the least room that holds it."""
    full: list[tuple[int, dict[int, int]]] = []
    by_room: dict[int, list[tuple[int, dict[int, int]]]] = {}
    rooms: list[int] = []

    def put(room: int, times: int, pattern: dict[int, int]) -> None:
        if not room:
            full.append((times, pattern))
            return
        if room not in by_room:
            insort(rooms, room)
            by_room[room] = []
        by_room[room].append((times, pattern))

    for size, n in sorted(histogram.items(), reverse=True):
        while n > 0:
            place = bisect_left(rooms, size)
            if place == len(rooms):
                room, pattern = capacity, {}
                times = max(1, n // (room // size))
            else:
                room = rooms[place]
                times, pattern = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room], rooms[place]
            # A sequence that has got a piece has the least room, so it takes pieces until none fits.
            each = min(n, room // size)
            taken = min(times, n // each)
            put(room - each * size, taken, pattern | {size: each})
            if times > taken:
                put(room, times - taken, pattern)
            n -= taken * each
    return full + [x for room in rooms for x in by_room[room]]


def fewest_possible(histogram: dict[int, int], capacity: int) -> int:
    """Lower bound: what is over half the capacity takes a sequence each, and beside the lengths over capacity - k no length from k on fits."""
    pieces, tokens_of = [0] * (capacity + 2), [0] * (capacity + 2)  # up to and with each length
    for k in range(1, capacity + 1):
        pieces[k], tokens_of[k] = pieces[k - 1] + histogram.get(k, 0), tokens_of[k - 1] + k * histogram.get(k, 0)
    half = capacity // 2
    least = -(-tokens_of[capacity] // capacity)
    for k in range(1, half + 1):
        alone, large = pieces[capacity] - pieces[capacity - k], pieces[capacity - k] - pieces[half]
        room = large * capacity - (tokens_of[capacity - k] - tokens_of[half])
        least = max(least, alone + large + max(0, -(-(tokens_of[half] - tokens_of[k - 1] - room) // capacity)))
    return least


def dominated(filling: list[tuple[int, int]], waste: int, counts: dict[int, int], present: int) -> bool:
    """Whether lengths of the filling can be swapped for one that is left. present: a bit for each length with a count left."""
    one, more = 0, 0  # sums of one length of the filling, and of two or more
    for size, n in filling:
        if counts[size] == n:
            present &= ~(1 << size)
        for _ in range(n):
            more |= (more | one) << size
            one |= 1 << size
    # What is left, spread down over the waste: bit s is set where a length from s to s + waste is left.
    above, reach = present >> 1, 1
    if waste:
        while reach < waste:
            step = min(reach, waste - reach)
            above |= above >> step
            reach += step
    else:
        above = 0
    return bool((above & 1) or (one & above) or (more & (above | present)))


def fillings(room: int, counts: dict[int, int], lengths: list[int], most: int, nodes: int) -> tuple[list[tuple[int, list[tuple[int, int]]]], int, bool]:
    """(waste, [(length, how many)]) of the undominated fillings with a waste of at most `most`, least waste first; nodes visited; whether
    those are all. lengths: ascending, those with a count left."""
    below = [0]  # tokens in the lengths before a place
    for size in lengths:
        below.append(min(below[-1] + size * counts[size], room + 1))
    present = sum(1 << size for size in lengths)
    found: list[tuple[int, list[tuple[int, int]]]] = []
    chosen: list[list[int]] = []
    place, space, visited = bisect_right(lengths, room) - 1, room, 0
    while True:
        while place >= 0 and space - below[place + 1] <= most:
            size = lengths[place]
            n = min(counts[size], space // size)
            chosen.append([place, n])
            space -= n * size
            visited += 1
            place = min(place - 1, bisect_right(lengths, space) - 1)
        if place < 0 and space <= most:
            filling = [(lengths[k], n) for k, n in chosen if n]
            if not dominated(filling, space, counts, present):
                found.append((space, filling))
        while chosen and not chosen[-1][1]:
            chosen.pop()
        if not chosen or visited >= nodes:
            break
        chosen[-1][1] -= 1
        visited += 1
        space += lengths[chosen[-1][0]]
        place = chosen[-1][0] - 1
    return sorted(found, key=lambda f: f[0]), visited, not chosen


def search(histogram: dict[int, int], capacity: int, incumbent: list, least: int, nodes: int) -> tuple[list[tuple[int, dict[int, int]]], bool]:
    """The better of the incumbent and what branch and bound finds; whether no plan can be shorter."""
    counts = {k: n for k, n in histogram.items() if n > 0}
    total = sum(k * n for k, n in counts.items())
    best, fewest = incumbent, sum(t for t, _ in incumbent)
    whole, wasted, path, stack = True, 0, [], []

    def branches():
        """(times, waste of one, pattern) for the longest length left."""
        nonlocal nodes, whole
        longest = max(counts)
        counts[longest] -= 1
        left = sorted(k for k, n in counts.items() if n)
        most = (fewest - 1) * capacity - total - wasted
        found, visited, all_of_them = fillings(capacity - longest, counts, left, most, min(nodes, FILLING_NODES))
        counts[longest] += 1
        nodes -= visited + 1
        whole &= all_of_them
        for waste, filling in found:
            pattern = {longest: 1}
            for size, n in filling:
                pattern[size] = pattern.get(size, 0) + n
            times = min(counts[size] // n for size, n in pattern.items())
            yield times, waste, pattern
            if times > 1:
                yield 1, waste, pattern

    def use(times: int, waste: int, pattern: dict[int, int]) -> None:
        nonlocal wasted
        wasted += times * waste
        for size, n in pattern.items():
            counts[size] = counts.get(size, 0) - times * n
            if not counts[size]:
                del counts[size]

    if counts and fewest > least:
        stack.append(branches())
    while stack:
        if (step := next(stack[-1], None)) is None:
            stack.pop()
            if path:
                times, waste, pattern = path.pop()
                use(-times, waste, pattern)
            continue
        times, waste, pattern = step
        if wasted + times * waste > (fewest - 1) * capacity - total:
            continue
        if nodes <= 0:
            return best, False
        use(times, waste, pattern)
        path.append(step)
        if counts:
            stack.append(branches())
            continue
        best, fewest = [(t, p) for t, _, p in path], sum(t for t, _, _ in path)
        if fewest == least:
            return best, True
        path.pop()
        use(-times, waste, pattern)
    return best, whole or fewest == least


def plan_proven(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int = PLAN_NODES) -> tuple[list[tuple[int, dict[int, int]]], bool]:
    """plan() and whether it is proven that no plan has fewer sequences."""
    histogram = {k: n for k, n in histogram.items() if n > 0}
    least = fewest_possible(histogram, capacity)
    size_of = lambda patterns: sum(t for t, _ in patterns)
    best = best_fit(histogram, capacity)
    if size_of(best) > least:
        best = min(best, greedy(histogram, capacity), key=size_of)
    return search(histogram, capacity, best, least, nodes)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: how many in one sequence}) patterns that use each length exactly as often as the histogram has it."""
    return plan_proven(histogram, capacity)[0]


def pieces_of(docs: DataFrame, vocabulary: str, end_id: int = tokens.END_ID, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """A row a piece: doc_id, copy (of rows with one doc_id), piece, start, length, ids_crc32 and, if asked for, ids (binary)."""
    schema = PIECES.replace("copy long, ", "mark long, ") + ", ids binary" * keep_ids

    def run(batches):
        import numpy as np
        import pyarrow as pa

        encoder, names = tokens.encoder(vocabulary), [x.split()[0] for x in schema.split(", ")]
        for batch in byte_blocks(batches):
            ids, at = encoder.encode_all(batch["text"], end_id)
            n_pieces = -(-np.diff(at) // capacity)
            doc = np.repeat(np.arange(batch.num_rows), n_pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
            first = at[doc] + piece * capacity
            last = np.minimum(first + capacity, at[doc + 1])
            whole = [ids[a:b] for a, b in zip(first.tolist(), last.tolist())]
            cols = [batch["doc_id"].take(pa.array(doc)), batch["mark"].take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(last - first), pa.array([tokens.crc(x) for x in whole], pa.int64())]
            yield pa.record_batch([*cols, *[pa.array([x.tobytes() for x in whole], pa.binary())] * keep_ids], names=names)

    found = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("mark"), F.col("text").cast("string")).mapInArrow(run, schema)
    return found.withColumnRenamed("mark", "copy")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id and offset for each piece. pieces: a table that reads the same each time (cut), with doc_id, copy, piece, length."""
    spark = pieces.sparkSession
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "copy", "piece"), F.lit(SALTS)).cast("int"))
    # At most capacity x SALTS rows, whatever the number of documents.
    counted = salted.groupBy("length", "_salt").count().collect()
    totals: dict[int, int] = {}
    offsets = []
    for row in sorted(counted):
        offsets.append((row["length"], row["_salt"], totals.get(row["length"], 0)))
        totals[row["length"]] = totals.get(row["length"], 0) + row["count"]
    # Each pattern takes the next pieces of its lengths: ranks from `low` on, `each` of them in one sequence.
    used: dict[int, int] = {}
    sequence, slots = 0, []
    for times, pattern in plan(totals, capacity):
        at = 0
        for size, n in sorted(pattern.items(), reverse=True):
            low = used.get(size, 0)
            slots.append((size, low, low + times * n, n, sequence, at))
            used[size] = low + times * n
            at += size * n
        sequence += times
    starts = spark.createDataFrame(offsets, "length long, _salt int, _before long")
    # The ranges of a length are found by their place in a sorted list of its own.
    by_length: dict[int, list] = {}
    for size, low, high, n, first, at in sorted(slots):
        by_length.setdefault(size, []).append((low, high, n, first, at))
    ranges = spark.createDataFrame([(k, v) for k, v in by_length.items()], "length long, _slots array<struct<low:long,high:long,each:long,first:long,at:long>>")
    own = Window.partitionBy("length", "_salt").orderBy("doc_id", "copy", "piece")
    ranked = (
        salted.withColumn("_rank", F.row_number().over(own))
        .join(F.broadcast(starts), ["length", "_salt"])
        .withColumn("_rank", F.col("_rank") - 1 + F.col("_before"))
        .join(F.broadcast(ranges), "length")
        .withColumn("_slot", F.filter("_slots", lambda s: (s["low"] <= F.col("_rank")) & (F.col("_rank") < s["high"]))[0])
    )
    step = F.col("_rank") - F.col("_slot.low")
    return ranked.withColumns({
        "sequence_id": F.col("_slot.first") + F.floor(step / F.col("_slot.each")).cast("long"),
        "offset": F.col("_slot.at") + F.pmod(step, F.col("_slot.each")) * F.col("length"),
    }).drop("_salt", "_rank", "_before", "_slots", "_slot")


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = tokens.END_ID, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Every document encoded, cut where longer than a sequence, and given its place."""
    return pack(cut(pieces_of(docs, vocabulary, end_id, capacity, keep_ids), "pieces"), capacity)
