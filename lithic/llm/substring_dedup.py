"""Operator 4: removal of repeated passages, by merging shards' Burrows-Wheeler transforms.

A byte goes when a string of SPAN bytes that covers it also starts earlier (smaller doc_id, or the same document, earlier start).

Sampling. Every string of SPAN bytes has one anchor: the place of the smallest hash among its ANCHOR-byte windows. Equal strings
have their anchor at the same offset, and neighbouring strings mostly share theirs, so the strings of a text fall into runs of
starts, about one for 35 bytes, each with its anchor's hash. A run whose anchor no other run has holds no repeated string: it goes before
any suffix is sorted. What hashes say is used for that alone; whether strings are equal is always decided by their bytes.

Shards. Each task sorts the runs of its texts by anchor and context (the bytes of all strings of the run). Runs whose contexts have the same
bytes are one repeated interval of the shard: all but the first are settled there, and only the first is sent on.

Merge. Runs that share an anchor meet with the bytes of their contexts, and contexts with the same bytes are settled as before. The
different ones (the edges of passages) are parted by document into shards; each shard's suffixes are sorted once and give its transform
and the step from a suffix to the one a byte longer (`transform`). The transforms are then merged by refinement of their interleave
(`merged_blocks`): from the interleave by the first h bytes the one by h + 1 follows by a stable sort of the transforms' symbols and one
step, so no suffix is sorted again, and no text is read. The rounds give the common prefixes: two neighbours part in the round of their
first difference. A block with one suffix can have no equal any more and leaves, and round SPAN ends the merge. The blocks left are the
repeated intervals; the first start of each stays.

An anchor with more than HELD_RUNS runs is a hot passage. Its strings are dealt to all tasks by their digests, and settled there by their
bytes in the same way.

Cases: null text counts as empty; texts shorter than SPAN keep all bytes; rows alike in doc_id and text are one document and get
its result each; rows with one doc_id and different texts are told apart, and ordered, by the texts' crc; a null doc_id comes
first; an empty table gives no row; other columns pass through `deduplicated`, those with the name of a result as `<name>_input`.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import aside, cut, own_columns, text_or_empty

SPAN, ANCHOR = 100, 32
#: Starts of a text that are looked at together, and bytes of texts hashed together.
SEGMENT, STRETCH = 1 << 19, 1 << 20
#: Runs that a task sorts together: a shard.
SHARD_RUNS = 400_000
#: Runs with one anchor up to which one task refines them.
HELD_RUNS = 50_000
#: Contexts or strings that are sent on together, about.
FETCHED_ROWS = 20_000
#: Bytes of contexts merged together, about, and the shards they are parted into.
MERGED_BYTES, SHARDS = 1 << 20, 4
#: In `at`, start << 8 | number of starts; this number marks a settled stretch whose length is in `c`.
SETTLED = 255

RUNS = "h long, c long, doc_id long, mark long, at long"
NAMES = ["h", "c", "doc_id", "mark", "at"]
MADE = ("_sd_id", "_sd_mark", "_sd_list", "_sd_out", "_sd_n_bytes", "_sd_n_removed", "_sd_n_spans", "_sd_kept_sha256", "_sd_kept")


def mixed(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(data, size: int):
    """64-bit hash of each `size`-byte window (a power of two), by doubling."""
    import numpy as np

    h = mixed(np.arange(1, 257, dtype=np.uint64))[data]
    step = 1
    while step < size:
        a, b = h[:-step], h[step:]
        h = (a ^ (a >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        h += b
        step *= 2
    return mixed(h)


def runs_of(pieces: list[bytes]):
    """Runs of the strings in each piece: arrays piece, first start, number of starts, anchor hash, context hash."""
    import numpy as np

    data = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(x) for x in pieces])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    n_starts = len(data) - SPAN + 1
    if n_starts <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    h = window_hashes(data, ANCHOR)
    low = np.uint64((1 << 23) - 1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width, step = SPAN - ANCHOR + 1, 1
    while 2 * step <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if width > step:
        least = np.minimum(least[: -(width - step)], least[width - step :])
    anchor = (least & low).astype(np.int32)
    # Strings that would cross two pieces are no strings.
    edge = np.empty(n_starts, bool)
    edge[0] = True
    np.not_equal(anchor[1:], anchor[:-1], out=edge[1:])
    firsts = begins[begins < n_starts]
    stops = ends - SPAN + 1
    edge[firsts] = True
    edge[stops[(stops > 0) & (stops < n_starts)]] = True
    first = np.flatnonzero(edge)
    count = np.diff(np.append(first, n_starts))
    piece = np.searchsorted(ends, first, side="right")
    ok = first + SPAN <= ends[piece]
    first, count, piece = first[ok], count[ok], piece[ok]
    last = first + count - 1 + SPAN - ANCHOR  # the context's last window
    context = (anchor[first] - first).astype(np.uint64) << np.uint64(8) | count.astype(np.uint64)
    for off in range(0, 2 * SPAN - 2 * ANCHOR + ANCHOR + 1, ANCHOR):
        context = mixed(context ^ h[np.minimum(first + off, last)])
    return piece, first - begins[piece], count, h[anchor[first]], context


def shard_runs(docs: DataFrame) -> DataFrame:
    """Sorted runs of each shard, without those that repeat an earlier one of the same shard; these as settled stretches."""

    def settled(rows, np):
        """Stretches that start right after one another, joined."""
        doc, mark, start, count = rows
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1]) | (start[1:] != start[:-1] + count[:-1])
        at = np.flatnonzero(new)
        if not len(at):
            return [np.zeros(0, np.int64)] * 5
        total = np.add.reduceat(count, at)
        key = mixed(doc[at].view(np.uint64) + mixed(start[at].view(np.uint64))).view(np.int64)
        return [key, total, doc[at], mark[at], start[at] << 8 | SETTLED]

    def same_bytes(data, x, y, size, np):
        """Whether the `size` bytes from place x on are those from place y on."""
        words = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        ok = np.ones(len(x), bool)
        for off in range(0, int(size.max(initial=0)), 8):
            at = np.minimum(off, size - 8)
            ok &= words[x + at] == words[y + at]
        return ok

    def shard(held, data, np, pa):
        data = np.frombuffer(data, np.uint8)
        doc, mark, start, count, h, c, place = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((start, mark, doc, c, h))
        doc, mark, start, count, h, c, place = (x[order] for x in (doc, mark, start, count, h, c, place))
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (c[1:] == c[:-1]) & (count[1:] == count[:-1])
        at = np.flatnonzero(again)
        again[at] = same_bytes(data, place[at], place[at - 1], count[at] - 1 + SPAN, np)
        own = again.copy()  # the very same start of a row read twice is no repetition
        own[1:] &= (doc[1:] == doc[:-1]) & (mark[1:] == mark[:-1]) & (start[1:] == start[:-1])
        repeated = again & ~own
        back = np.lexsort((start[repeated], mark[repeated], doc[repeated]))
        sent = [h[~again], np.zeros(int((~again).sum()), np.int64), doc[~again], mark[~again], start[~again] << 8 | count[~again]]
        done = settled([x[repeated][back] for x in (doc, mark, start, count)], np)
        cols = [np.concatenate([a, b]) for a, b in zip(sent, done)]
        for k in range(0, len(cols[0]), 100_000):
            yield pa.record_batch([pa.array(x[k : k + 100_000]) for x in cols], names=NAMES)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held, n_held, pieces, owners, size, data = [], 0, [], [], 0, bytearray()

        def hashed():
            nonlocal pieces, owners, size
            piece, start, count, h, c = runs_of(pieces)
            of = np.array(owners, np.int64).reshape(-1, 3)[piece]
            begins = len(data) + np.cumsum([0, *map(len, pieces)])[piece]
            data.extend(b"".join(pieces))
            pieces, owners, size = [], [], 0
            return of[:, 0].copy(), of[:, 1].copy(), start + of[:, 2], count, h.view(np.int64), c.view(np.int64), begins + start

        for batch in batches:
            for doc, mark, text in zip(batch["doc_id"].to_pylist(), batch["mark"].to_pylist(), batch["text"]):
                own = text.as_buffer().to_pybytes()
                for off in range(0, len(own) - SPAN + 1, SEGMENT):
                    pieces.append(own[off : off + SEGMENT + SPAN - 1])
                    owners.append((doc, mark, off))
                    size += len(pieces[-1])
                    if size >= STRETCH:
                        held.append(hashed())
                        n_held += len(held[-1][0])
                if n_held >= SHARD_RUNS:
                    yield from shard(held, bytes(data), np, pa)
                    held, n_held = [], 0
                    data.clear()
        if pieces:
            held.append(hashed())
        if held:
            yield from shard(held, bytes(data), np, pa)

    return docs.select("doc_id", "mark", "text").mapInArrow(run, RUNS)


def sharing(runs: DataFrame) -> DataFrame:
    """The shards' settled stretches, and the runs whose anchor another run has: a scan of sorted partitions that holds one row back."""

    def scan(batches):
        import numpy as np
        import pyarrow as pa

        held, shared = None, False  # the last run, and whether the one before it has its anchor
        for batch in batches:
            cols = [batch[k].to_numpy() for k in NAMES]
            done = (cols[4] & 255) == SETTLED
            out, cols = [x[done] for x in cols], [x[~done] for x in cols]
            if len(cols[0]):
                if held is not None:
                    cols = [np.concatenate([a, b]) for a, b in zip(held, cols)]
                near = cols[0][1:] == cols[0][:-1]
                several = np.append(near, False) | np.insert(near, 0, shared)
                held, shared = [x[-1:] for x in cols], bool(several[-1])
                out = [np.concatenate([a, b[:-1][several[:-1]]]) for a, b in zip(out, cols)]
            if len(out[0]):
                yield pa.record_batch([pa.array(x) for x in out], names=NAMES)
        if held is not None and shared:
            yield pa.record_batch([pa.array(x) for x in held], names=NAMES)

    return runs.repartition("h").sortWithinPartitions("h").mapInArrow(scan, RUNS)


def transform(strings: list[bytes]):
    """The Burrows-Wheeler transform of strings, each with an end of its own: symbols (byte + 1; 0 before a string's first byte), the row of
    the suffix that is longer by the symbol, and each row's place in the strings, which lie one after the other with a byte between."""
    import numpy as np

    text = np.frombuffer(b"\0".join([*strings, b""]), np.uint8).astype(np.uint16) + 1
    ends = np.cumsum([len(x) + 1 for x in strings]) - 1
    text[ends] = 0
    n = len(text)
    # Ranks by prefixes of doubling length; ends are told apart from the start, so that no prefix goes beyond one.
    key = text.astype(np.int64) + len(strings)
    key[ends] = np.arange(len(strings))
    depth, most = 1, len(strings) + 258
    while True:
        further = np.zeros(n, np.int64)
        within = max(0, n - depth)
        further[:within] = key[n - within :] + 1
        key = key * most + further
        depth, most = 2 * depth, most * most
        if most < 1 << 30:
            continue  # two prefixes together still make one number
        order = np.argsort(key)
        new = np.ones(n, np.int64)
        new[1:] = key[order][1:] != key[order][:-1]
        if new.all():
            break
        key[order] = np.cumsum(new) - 1
        most = n + 1
    symbols = text[order - 1]
    longer = np.empty(n, np.int32)
    longer[np.argsort(symbols, kind="stable")] = np.arange(n)
    return symbols, longer, order


def merged_blocks(shards: list[list[bytes]], depth: int = SPAN):
    """Repeated intervals of all shards' strings: arrays block, shard, place in the shard's strings. Suffixes of one block have the same
    first `depth` bytes, and no other suffix has them."""
    import numpy as np

    made = [transform(x) for x in shards if x]
    of = [k for k, x in enumerate(shards) if x]
    if not made:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    firsts = np.cumsum([0, *[len(x[0]) for x in made]])
    symbols = np.concatenate([x[0] for x in made])
    longer = np.concatenate([x[1] + np.int32(at) for x, at in zip(made, firsts)])
    # The interleave by no byte: shard after shard, all in one block.
    rows, block = np.arange(len(symbols), dtype=np.int32), np.zeros(len(symbols), np.int32)
    for _ in range(depth):
        own = symbols[rows]
        inner = own > 0
        rows, block, own = rows[inner], block[inner], own[inner]
        order = np.argsort(own, kind="stable")
        rows, block, own = longer[rows[order]], block[order], own[order]
        first = np.ones(len(rows) + 1, bool)
        first[1:-1] = (own[1:] != own[:-1]) | (block[1:] != block[:-1])
        kept = ~(first[:-1] & first[1:])  # blocks of two or more
        rows, block = rows[kept], np.cumsum(first[:-1])[kept].astype(np.int32)
        if not len(rows):
            break
    shard = np.searchsorted(firsts, rows, side="right") - 1
    places = np.concatenate([x[2] for x in made])[rows]
    return block, np.array(of)[shard], places


def merged(contexts: DataFrame, keys: list[str]) -> DataFrame:
    """Settled starts among runs that share the keys. contexts: RUNS and `bytes`."""

    def flush(rows, np, pa):
        """Settled stretches of runs that are sorted by anchor, document and start."""
        seen: set[bytes] = set()
        done, left = [], []
        for row in rows:
            if row[5] in seen:
                done.append(row)  # one interval with an earlier run
            else:
                seen.add(row[5])
                left.append(row)
        # A context that is alone with its anchor by now has no other to share a string with.
        keys = [row[:2] for row in left]
        left = [row for k, row in enumerate(left) if keys[k - 1 : k] == [keys[k]] or keys[k + 1 : k + 2] == [keys[k]]]
        shards, owners = [[] for _ in range(SHARDS)], [[] for _ in range(SHARDS)]
        for row in left:
            shards[row[2] % SHARDS].append(row[5])
            owners[row[2] % SHARDS].append(row)
        block, shard, place = merged_blocks(shards)
        doc, mark, start = (np.zeros(len(block), np.int64) for _ in range(3))
        for k in range(SHARDS):
            here = shard == k
            begins = np.cumsum([0, *[len(x) + 1 for x in shards[k]]])
            string = np.searchsorted(begins, place[here], side="right") - 1
            for col, value in ((doc, [r[2] for r in owners[k]]), (mark, [r[3] for r in owners[k]]), (start, [r[4] >> 8 for r in owners[k]])):
                col[here] = np.array(value, np.int64)[string] if len(value) else 0
            start[here] += place[here] - begins[string]
        order = np.lexsort((start, mark, doc, block))
        again = np.zeros(len(order), bool)
        again[1:] = block[order][1:] == block[order][:-1]
        whole = [np.array([f(r) for r in done], np.int64) for f in (lambda r: r[2], lambda r: r[3], lambda r: r[4] >> 8, lambda r: r[4] & 255)]
        doc, mark, start = (np.concatenate([x[order][again], y]) for x, y in zip((doc, mark, start), whole))
        count = np.concatenate([np.ones(int(again.sum()), np.int64), whole[3]])
        back = np.lexsort((start, mark, doc))
        doc, mark, start, count = doc[back], mark[back], start[back], count[back]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1]) | (start[1:] != start[:-1] + count[:-1])
        at = np.flatnonzero(new)
        total = np.add.reduceat(count, at) if len(at) else np.zeros(0, np.int64)
        zero = np.zeros(len(at), np.int64)
        return pa.record_batch([pa.array(x) for x in (zero, total, doc[at], mark[at], start[at] << 8 | SETTLED)], names=NAMES)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        rows, size = [], 0
        for batch in batches:
            for row in zip(*(batch[k].to_pylist() for k in [*NAMES, "bytes"])):
                if rows and row[:5] == rows[-1][:5]:  # a row read twice brings its runs twice, which is no repetition
                    continue
                if size > MERGED_BYTES and row[:2] != rows[-1][:2]:
                    yield flush(rows, np, pa)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[5])
        if rows:
            yield flush(rows, np, pa)

    return contexts.repartition(*keys).sortWithinPartitions(*NAMES).mapInArrow(run, RUNS)


def fetched(docs: DataFrame, left_over: DataFrame, single: bool = False) -> DataFrame:
    """The runs left over with the bytes of their contexts; single: each string of them as a run of its own, dealt by its digest."""

    def strings(h, c, at, data):
        if not single:
            yield h, c, at, data
            return
        for k in range(at & 255):
            own = data[k : k + SPAN]
            digest = hashlib.blake2b(own, digest_size=16).digest()
            yield int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), (at >> 8) + k << 8 | 1, own

    def run(batches):
        import pyarrow as pa

        def made(out):
            return pa.record_batch([*[pa.array(x, pa.int64()) for x in out[:5]], pa.array(out[5], pa.binary())], names=[*NAMES, "bytes"])

        for batch in batches:
            out = [[] for _ in range(6)]
            for doc, mark, text, runs in zip(batch["doc_id"].to_pylist(), batch["mark"].to_pylist(), batch["text"], batch["_sd_list"].to_pylist()):
                data = text.as_buffer()
                for r in runs:
                    start, count = r["at"] >> 8, r["at"] & 255
                    for h, c, at, own in strings(r["h"], r["c"], r["at"], data.slice(start, min(count - 1 + SPAN, data.size - start)).to_pybytes()):
                        for col, x in zip(out, (h, c, doc, mark, at, own)):
                            col.append(x)
                if len(out[0]) >= FETCHED_ROWS:
                    yield made(out)
                    out = [[] for _ in range(6)]
            yield made(out)

    lists = left_over.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("h", "c", "at")).alias("_sd_list"))
    return docs.join(lists, ["doc_id", "mark"]).select("doc_id", "mark", "text", "_sd_list").mapInArrow(run, RUNS + ", bytes binary")


def prepared(docs: DataFrame) -> DataFrame:
    """doc_id (null: the smallest), mark (crc of the text) and text (null: empty)."""
    text = text_or_empty().cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), F.crc32(text).alias("mark"), text.alias("text"))


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id, mark and `_sd_list` of (start, count): the places where a string starts that also starts earlier."""
    own = prepared(docs)
    is_settled = F.col("at").bitwiseAND(F.lit(255)) == SETTLED
    scanned = cut(sharing(shard_runs(own)), "sharing")
    found, left_over = scanned.where(is_settled), scanned.where(~is_settled)
    crowded = cut(left_over.groupBy("h").count().where(F.col("count") > HELD_RUNS).select("h"), "crowded")
    if not crowded.head(1):
        found = found.unionByName(merged(fetched(own, left_over), ["h"]))
    else:
        found = found.unionByName(merged(fetched(own, left_over.join(crowded, "h", "left_anti")), ["h"]))
        found = found.unionByName(merged(fetched(own, left_over.join(crowded, "h", "left_semi"), True), ["h", "c"]))
    lists = found.groupBy("doc_id", "mark").agg(F.collect_list(F.struct(F.shiftright("at", 8).alias("start"), F.col("c").alias("count"))).alias("_sd_list"))
    return cut(lists, "repeated")


def without(data: bytes, starts: list) -> tuple[int, int, bytes]:
    """Bytes removed, maximal removed runs, and what is left."""
    covered = sorted((s["start"], s["start"] + s["count"] - 1 + SPAN) for s in starts or ())
    kept, at, removed, spans = [], 0, 0, 0
    i = 0
    while i < len(covered):
        low, high = covered[i]
        while i < len(covered) and covered[i][0] <= high:
            high = max(high, covered[i][1])
            i += 1
        kept.append(data[at:low])
        removed, spans, at = removed + high - low, spans + 1, high
    kept.append(data[at:])
    return removed, spans, b"".join(kept)


def removed(docs: DataFrame, lists: DataFrame, kept: str | None) -> DataFrame:
    """docs with `_sd_out`: n_bytes, n_removed, n_spans, kept_sha256 and `kept`, what is left: "binary", "string" (null where nothing goes; without
    the characters that removal cuts in two) or None (always null). One Python function makes all of it: a second one after it would be
    a second worker a task, and workers stay for the stages that follow."""
    made = f"n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept {kept or 'binary'}"

    @F.pandas_udf(made)
    def remove(texts, starts):
        import pandas as pd

        rows = []
        for text, own_starts in zip(texts, starts):
            data = (text or "").encode("utf-8", "surrogatepass")
            n, spans, left = without(data, [] if own_starts is None else list(own_starts))
            digest = hashlib.sha256(left).hexdigest()
            if kept == "string":
                left = left.decode("utf-8", "ignore") if n else None
            rows.append((len(data), n, spans, digest, left if kept else None))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in made.split(", ")])

    keyed = docs.withColumns({"_sd_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "_sd_mark": F.crc32(text_or_empty())})
    named = lists.select(F.col("doc_id").alias("_sd_id"), F.col("mark").alias("_sd_mark"), "_sd_list")
    joined = keyed.join(named, ["_sd_id", "_sd_mark"], "left")
    return joined.withColumn("_sd_out", remove(F.col("text").cast("string"), F.col("_sd_list")))


def deduplicated(docs: DataFrame, lists: DataFrame | None = None, digest_only: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; with the other columns and `kept` (binary) unless digest_only."""
    lists = repeated(docs) if lists is None else lists
    own = docs.select("doc_id", "text") if digest_only else aside(docs, MADE)
    out = removed(own, lists, None if digest_only else "binary")
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *([] if digest_only else ["kept"])]
    return out.select(*([] if not digest_only else ["doc_id"]), *([] if digest_only else own_columns(own)), *[F.col("_sd_out")[c].alias(c if digest_only else f"_sd_{c}") for c in names])


def dedup(docs: DataFrame) -> DataFrame:
    """The documents with what is left of their texts. A character that removal cuts in two goes wholly."""
    own = aside(docs, MADE)
    out = removed(own, repeated(docs), "string").select(*own_columns(own), "_sd_out")
    changes = F.col("_sd_out.n_removed") > 0
    changed = out.withColumn("text", F.when(changes, F.col("_sd_out.kept")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(changes, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return changed.drop("_sd_out").toDF(*docs.columns)
