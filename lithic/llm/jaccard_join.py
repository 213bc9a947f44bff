"""Operator 7: exact n-gram Jaccard join through a count-vector R-tree.

A document's tokens are the hashes of its word shingles. They are dealt into GROUPS groups; the counts of the groups are its
point. For two documents the sum over groups of the smaller count bounds their overlap from above, and so does, for a
box of an R-tree, the sum of the smaller of a count and the box's largest; a box or point whose bound cannot reach the overlap
that the threshold asks for is pruned, and pairs that survive are verified on the whole sets. Every link comes from such a search.

The points are indexed in parts, by a fact about sets: two sets at Jaccard t or more share a token among the first
|x| - ceil(t|x|) + 1 of each, in any fixed order of tokens. Each point goes to the buckets of these tokens; the order goes by
the load of a token's bin in a fixed-size histogram, lightest first, so boilerplate makes few buckets. A task's tree holds the points of many
buckets: the bucket is a coordinate of its boxes, like the size of a set. Equal sets are one point throughout.

Links are transitive in the result, so not every pair is needed, only enough verified ones. Round one searches each bucket in blocks of
NEAR points with the bucket's first document beside them, and keeps for each point that document and the one with the best bound. Round
two takes the buckets that still hold several components and searches them across components: each point is stored once, in one block
of BLOCK points, and those outside the bucket's largest component are sought in all its blocks. No link between different texts is
lost, no bucket is ever collected whole, and no pairs are made inside what is already connected.

Cases: null text, or one without words, has an empty set, links with nothing and is its own component; fewer words than a shingle
are one shingle; a row without doc_id links with nothing and has no component; rows alike are one point; an empty table gives no
row; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import parts
from .common import byte_blocks, cut, met, own_columns
from .graph import components

#: Dimensions of a point; the largest count kept, beyond which a point is not pruned.
GROUPS, FULL = 128, 255
#: Bins of the histogram of tokens (a power of two), the shift that gives a token's bin, and the pieces it is added up in.
BINS, SHIFT, PIECES = 1 << 20, 44, 32
#: Points of a leaf and children of a node of the R-tree; points of a block in the first round and in the second.
FAN, NEAR, BLOCK = 16, 128, 1024
#: Rows that are indexed together; pairs of points compared at once.
TOGETHER, PAIRS = 20_000, 50_000

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def mixed(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words):
    """64-bit hashes of words (Arrow, binary): each byte and its place in the word are hashed, and the sums again."""
    import numpy as np

    raw, at = parts.buffered(words)
    if not len(words):
        return np.zeros(0, np.uint64)
    place = np.arange(len(raw)) - np.repeat(at[:-1], np.diff(at))
    each = mixed((place.astype(np.uint64) << np.uint64(8) | raw) + np.uint64(0x9E3779B97F4A7C15))
    return mixed(np.add.reduceat(each, at[:-1]))


def shingles(column, size: int):
    """Sorted distinct 64-bit shingle hashes of each text of an Arrow column, one text after the other, and each text's first (with the end
    of the last)."""
    import numpy as np

    distinct, codes, bounds = parts.words(column, table=LOWER)
    each = word_hashes(distinct)[codes]
    n, ends = np.diff(bounds), bounds[1:]
    out = np.full(len(each), size, np.uint64)
    last = len(each) - size + 1
    for k in range(size if last > 0 else 0):
        head = out[:last]
        out[:last] = (head ^ (head >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + each[k : k + last]
    # A text with fewer words than a shingle has one, of all its words; the windows that would cross two texts go.
    short = np.flatnonzero((n > 0) & (n < size))
    for text in short:
        one = np.uint64(n[text])
        for word in each[bounds[text] : bounds[text + 1]]:
            one = np.uint64(((int(one) ^ int(one) >> 31) * 0x9E3779B97F4A7C15 + int(word)) & 0xFFFFFFFFFFFFFFFF)
        out[bounds[text]] = one
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    of = np.repeat(np.arange(len(n)), count)
    place = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    found = mixed(out[bounds[of] + place])
    at = np.insert(np.cumsum(count), 0, 0)
    for a, b in zip(at.tolist(), at[1:].tolist()):
        found[a:b].sort()
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (of[1:] != of[:-1])
    return found[new], np.searchsorted(of[new], np.arange(len(n) + 1))


def identity(found) -> tuple[int, int]:
    import numpy as np

    a, b = np.frombuffer(hashlib.blake2b(found.tobytes(), digest_size=16).digest(), "<i8")
    return int(a), int(b)


def points_of(found, at):
    """Counts of the groups of each set, a row a set."""
    import numpy as np

    of = np.repeat(np.arange(len(at) - 1), np.diff(at))
    counts = np.bincount(of * GROUPS + (found % np.uint64(GROUPS)).astype(np.int64), minlength=(len(at) - 1) * GROUPS)
    return np.minimum(counts, FULL).astype(np.uint8).reshape(-1, GROUPS)


def needed(n_a, n_b, percent: int):
    """Overlap that sets of these sizes need: 100 * i >= percent * (n_a + n_b - i)."""
    return -(-percent * (n_a + n_b) // (100 + percent))


def survey(docs: DataFrame, shingle: int) -> DataFrame:
    """One pass over all texts: a row a document (kind 0: doc_id, n, s1, s2, point) and pieces of each task's histogram (kind 1)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        bins = np.zeros(BINS, np.int64)
        names = ["kind", "doc_id", "n", "s1", "s2", "point"]
        for batch in byte_blocks(batches):
            found, at = shingles(batch["text"], shingle)
            bins += np.bincount((found >> np.uint64(SHIFT)).astype(np.int64), minlength=BINS)
            ids = [identity(found[a:b]) for a, b in zip(at.tolist(), at[1:].tolist())]
            n = batch.num_rows
            yield pa.record_batch([pa.array([0] * n, pa.int32()), batch["doc_id"], pa.array(np.diff(at)), pa.array([x[0] for x in ids], pa.int64()), pa.array([x[1] for x in ids], pa.int64()), pa.array([x.tobytes() for x in points_of(found, at)], pa.binary())], names=names)
        loads = [x.astype(np.int32).tobytes() for x in np.split(bins, PIECES)]
        none = pa.nulls(PIECES, pa.int64())
        yield pa.record_batch([pa.array([1] * PIECES, pa.int32()), pa.array(range(PIECES), pa.int64()), none, none, none, pa.array(loads, pa.binary())], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "kind int, doc_id long, n long, s1 long, s2 long, point binary")


def crowding(surveyed: DataFrame) -> bytes:
    """The load of each bin in 256 steps: PIECES rows, together BINS numbers, come to the driver."""
    import numpy as np

    def add(pdf):
        import pandas as pd

        total = sum(np.frombuffer(x, np.int32).astype(np.int64) for x in pdf["point"])
        return pd.DataFrame({"piece": pdf["doc_id"].iloc[:1], "total": [total.tobytes()]})

    rows = surveyed.where("kind = 1").select("doc_id", "point").groupBy("doc_id").applyInPandas(add, "piece long, total binary").collect()
    load = np.concatenate([np.frombuffer(r["total"], np.int64) for r in sorted(rows)]) if rows else np.zeros(BINS, np.int64)
    mean = max(1.0, load.mean())
    return np.clip(np.round((load - mean) / mean**0.5 * 16) + 64, 0, 255).astype(np.uint8).tobytes()


def bucketed(docs: DataFrame, shingle: int, percent: int, crowded: bytes) -> DataFrame:
    """tok, n, s1 for the first tokens of each set. A task leaves out sets that it has just sent. Sets that share n and s1 by chance go on
    as candidates together; the whole sets tell them apart."""
    levels = docs.sparkSession.sparkContext.broadcast(crowded)  # BINS bytes

    def run(batches):
        import numpy as np
        import pyarrow as pa

        level, sent = np.frombuffer(levels.value, np.uint8), set()
        for batch in byte_blocks(batches):
            toks, rows = [], []
            found, at = shingles(batch["text"], shingle)
            late = level[(found >> np.uint64(SHIFT)).astype(np.int64)]
            for a, b in zip(at.tolist(), at[1:].tolist()):
                n = b - a
                if not n or (who := identity(found[a:b])) in sent:
                    continue
                if len(sent) > 100_000:
                    sent.clear()
                sent.add(who)
                first = n + (-percent * n) // 100 + 1
                toks.append(found[a:b][np.argsort(late[a:b], kind="stable")[:first]])
                rows.append((n, who[0], first))
            if toks:
                times = [r[2] for r in rows]
                cols = [np.concatenate(toks).view(np.int64), *[np.repeat(np.array([r[k] for r in rows], np.int64), times) for k in range(2)]]
                for k in range(0, len(cols[0]), 100_000):
                    yield pa.record_batch([pa.array(c[k : k + 100_000]) for c in cols], names=["tok", "n", "s1"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "tok long, n long, s1 long")


def shared(tokens: DataFrame) -> DataFrame:
    """Rows of buckets with two sets or more, each set once: a scan of sorted partitions that holds one row back."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names, held, same_before = ["tok", "n", "s1"], None, False
        for batch in batches:
            cols = [batch[k].to_numpy() for k in names]
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
            if not len(cols[0]):
                continue
            new = np.ones(len(cols[0]), bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
            cols = [c[new] for c in cols]
            same = cols[0][1:] == cols[0][:-1]
            keep = np.append(same, False) | np.insert(same, 0, same_before)
            same_before = bool(same[-1]) if len(same) else same_before
            held = [c[-1:] for c in cols]
            yield pa.record_batch([pa.array(c[:-1][keep[:-1]]) for c in cols], names=names)
        if held is not None and same_before:
            yield pa.record_batch([pa.array(c) for c in held], names=names)

    return tokens.repartition("tok").sortWithinPartitions("tok", "n", "s1").mapInArrow(run, "tok long, n long, s1 long")


def pa_bool(mask):
    import pyarrow as pa

    return pa.array(mask, pa.bool_())


def sets_of(docs: DataFrame, wanted: DataFrame, shingle: int, many: bool) -> DataFrame:
    """v and its whole set (binary) for the wanted vertices (v, doc_id, s1, s2), from the texts of one document each. many: their number grows
    with the input, so both sides are shuffled at every size; else Spark decides by their size."""

    def run(batches):
        import pyarrow as pa

        for batch in byte_blocks(batches):
            vs, sets = [], []
            found, at = shingles(batch["text"], shingle)
            for k, sought in enumerate(batch["sought"].to_pylist()):
                mine = found[at[k] : at[k + 1]]
                own = identity(mine)
                for x in sought:
                    if (x["s1"], x["s2"]) == own:
                        vs.append(x["v"])
                        sets.append(mine.tobytes())
            yield pa.record_batch([pa.array(vs, pa.int64()), pa.array(sets, pa.binary())], names=["v", "found"])

    sought = cut(wanted.groupBy("doc_id").agg(F.collect_list(F.struct("v", "s1", "s2")).alias("sought")), "sought")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.join(sought.hint("merge") if many else sought, "doc_id").select("text", "sought").mapInArrow(run, "v long, found binary").dropDuplicates(["v"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that are links, by their whole sets."""

    def run(batches):
        import numpy as np

        for batch in batches:
            ok = []
            for x, y in zip(batch["found_a"].to_pylist(), batch["found_b"].to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                shared_ = int((both[1:] == both[:-1]).sum())
                ok.append(100 * shared_ >= percent * (len(x) + len(y) - shared_))
            yield batch.filter(pa_bool(ok)).select(["a", "b"])

    side = lambda x: sets.select(F.col("v").alias(x), F.col("found").alias(f"found_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


class RTree:
    """Static R-tree over count vectors of many buckets: packed by bucket, then size, then position. A node's box has the range of its buckets
    and sizes and the largest counts."""

    def __init__(self, buckets, sizes, points):
        import numpy as np

        self.order = np.lexsort((points[:, 0], sizes, buckets))
        self.levels = [tuple(x[self.order] for x in (buckets, buckets, sizes, sizes, points))]
        while len(self.levels[-1][0]) > FAN:
            at = np.arange(0, len(self.levels[-1][0]), FAN)
            ways = (np.minimum, np.maximum, np.minimum, np.maximum, np.maximum)
            self.levels.append(tuple(f.reduceat(x, at) for f, x in zip(ways, self.levels[-1])))

    def search(self, buckets, sizes, points, percent: int):
        """(query, place in the caller's order, bound) of the points in the query's bucket whose bound allows a link."""
        import numpy as np

        full = points.max(axis=1, initial=0) == FULL
        top = len(self.levels[-1][0])
        query, place = np.repeat(np.arange(len(sizes)), top), np.tile(np.arange(top), len(sizes))
        for k in range(len(self.levels) - 1, -1, -1):
            first, last, low, high, most = self.levels[k]
            ok = (first[place] <= buckets[query]) & (buckets[query] <= last[place])
            n = sizes[query]
            ok &= (100 * np.minimum(n, high[place]) >= percent * np.maximum(n, low[place]))
            query, place = query[ok], place[ok]
            bound = np.empty(len(query), np.int64)
            for at in range(0, len(query), PAIRS):
                part = slice(at, at + PAIRS)
                own, box = points[query[part]], most[place[part]]
                saturated = full[query[part]] | (box.max(axis=1, initial=0) == FULL)
                bound[part] = np.where(saturated, np.minimum(sizes[query[part]], high[place[part]]), np.minimum(own, box).sum(axis=1, dtype=np.int64))
            least = np.maximum(low[place], -(-percent * sizes[query] // 100))  # a smaller set needs more than it has
            ok = bound >= needed(sizes[query], least, percent)
            query, place, bound = query[ok], place[ok], bound[ok]
            if k:
                below = len(self.levels[k - 1][0])
                place = (place[:, None] * FAN + np.arange(FAN)).ravel()
                query = np.repeat(query, FAN)
                ok = place < below
                query, place = query[ok], place[ok]
        return query, self.order[place], bound


#: What a row is in a block: stored; stored and sought; sought.
STORED, BOTH, SOUGHT = 0, 1, 2
ROWS = ["bucket", "block", "role", "v", "n", "root", "lead"]


def tree_pairs(rows: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """Pairs that the points of each block allow, across roots; nearest: of each sought point only the one with the best bound and the leader.
    rows: bucket, block, role, v, n, root, lead, point. Of a block whose sought points are many, the stored ones alone are held."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def join(cols, points):
            bucket, block, role, v, n, root, lead = cols
            new = np.ones(len(bucket), bool)
            new[1:] = (bucket[1:] != bucket[:-1]) | (block[1:] != block[:-1])
            group = np.cumsum(new)
            stored, sought = np.flatnonzero(role != SOUGHT), np.flatnonzero(role != STORED)
            if not len(stored) or not len(sought):
                return None
            tree, found = RTree(group[stored], n[stored], points[stored]), []
            for at in range(0, len(sought), 256):
                own = sought[at : at + 256]
                query, place, bound = tree.search(group[own], n[own], points[own], percent)
                q, s = own[query], stored[place]
                ok = (root[q] != root[s]) & (v[q] != v[s])
                q, s, bound = q[ok], s[ok], bound[ok]
                if nearest:
                    score = bound / (n[q] + n[s] - bound)
                    order = np.lexsort((v[s], -score, q))
                    best = np.ones(len(q), bool)
                    best[1:] = q[order][1:] != q[order][:-1]
                    kept = lead[s] == 1
                    kept[order[best]] = True
                    q, s = q[kept], s[kept]
                found.append(np.column_stack([v[q], v[s]]))
            both = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
            return pa.record_batch([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        held = None
        for batch in batches:
            cols = [batch[k].to_numpy() for k in ROWS]
            points = np.frombuffer(b"".join(batch["point"].to_pylist()), np.uint8).reshape(-1, GROUPS)
            if held is not None:
                cols, points = [np.concatenate([h, c]) for h, c in zip(held[0], cols)], np.concatenate([held[1], points])
            held = (cols, points)
            if len(points) < TOGETHER:
                continue
            other = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            at = int(other[-1]) + 1 if len(other) else 0  # the last block may go on
            if at and (out := join([c[:at] for c in cols], points[:at])) is not None:
                yield out
            cols, points = [c[at:] for c in cols], points[at:]
            if len(points) >= TOGETHER and cols[2][-1] == SOUGHT:  # stored rows come first, so all of them are here
                if (out := join(cols, points)) is not None:
                    yield out
                kept = cols[2] != SOUGHT
                cols, points = [c[kept] for c in cols], points[kept]
                cols[2] = np.full(len(points), STORED, cols[2].dtype)
            held = (cols, points)
        if held is not None and (out := join(*held)) is not None:
            yield out

    return rows.repartition("bucket", "block").sortWithinPartitions("bucket", "block", "role").select(*ROWS, "point").mapInArrow(run, "a long, b long").distinct()


def links(docs: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents surveyed, vertices v of distinct sets with their first document, components v -> root of linked vertices)."""
    surveyed = cut(survey(docs, shingle), "survey")
    own = surveyed.where("kind = 0")
    crowded = crowding(surveyed)
    vertices = own.where("n > 0 and doc_id is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("point").alias("point"))
    vertices = cut(vertices.withColumn("v", F.monotonically_increasing_id()), "vertices")
    members = shared(bucketed(docs.where("doc_id is not null"), shingle, percent, crowded))
    members = cut(members.join(vertices.select("s1", "n", "v", "doc_id"), ["s1", "n"]).select(F.col("tok").alias("bucket"), "v", "n", "doc_id"), "members")
    points = vertices.select("v", "point")
    identities = vertices.select("v", "doc_id", "s1", "s2")
    total = members.count()

    def check(near: DataFrame, many: bool) -> DataFrame:
        wanted = cut(identities.join(near.select(F.explode(F.array("a", "b")).alias("v")).distinct(), "v", "left_semi"), "wanted")
        return verified(near, sets_of(docs, wanted, shingle, many), percent)

    def dealt(column: str, blocks: str):
        return F.pmod(F.xxhash64(column), F.col(blocks)).cast("int")

    # Round one: blocks of each bucket, with its first document in every one.
    one = F.struct("v", "n")
    mark = F.sum(F.xxhash64("v").cast("decimal(38,0)")).alias("mark")
    buckets = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), mark, F.min_by(one, F.struct("doc_id", "v")).alias("first")).where("size > 1")
    # Of buckets with the same points one is enough.
    buckets = buckets.groupBy("size", "mark").agg(F.min(F.struct("bucket", "first")).alias("x")).select("x.bucket", "x.first", "size")
    buckets = cut(buckets.withColumn("blocks", F.ceil(F.col("size") / NEAR).cast("int")), "buckets")
    mine = cut(met(members.select("bucket", "v", "n"), buckets, ["bucket"], "size", total), "met")
    near = mine.select("bucket", dealt("v", "blocks").alias("block"), F.lit(BOTH).alias("role"), "v", "n", F.col("v").alias("root"), (F.col("v") == F.col("first.v")).cast("int").alias("lead"))
    leaders = buckets.where("blocks > 1").select("bucket", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), "blocks", F.col("first.v").alias("v"), F.col("first.n").alias("n"))
    leaders = leaders.where(F.col("block") != dealt("v", "blocks")).select("bucket", "block", F.lit(STORED).alias("role"), "v", "n", F.col("v").alias("root"), F.lit(1).alias("lead"))
    found = cut(check(cut(tree_pairs(near.unionByName(leaders).join(points, "v"), percent, True), "near"), True), "links")
    roots = cut(components(found), "roots")
    # Round two: buckets that still hold several components, one of each kind of membership.
    placed = cut(mine.select("bucket", "v", "n").join(roots, "v", "left").withColumn("root", F.coalesce("root", "v")), "placed")
    by_root = placed.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("size"), F.sum(F.xxhash64("v").cast("decimal(38,0)")).alias("mark"))
    facts = [F.sum("size").alias("size"), F.sum("mark").alias("mark"), F.max_by("root", F.struct("size", "root")).alias("major"), F.count(F.lit(1)).alias("roots")]
    several = by_root.groupBy("bucket").agg(*facts).where("roots > 1").groupBy("size", "mark").agg(F.min(F.struct("bucket", "major")).alias("x"))
    several = cut(several.select("x.bucket", "x.major", "size", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "several")
    mine = met(placed, several, ["bucket"], "size", total).withColumn("own", dealt("v", "blocks"))
    outside = F.col("root") != F.col("major")
    stored = mine.select("bucket", F.col("own").alias("block"), F.when(outside, BOTH).otherwise(STORED).alias("role"), "v", "n", "root", F.lit(0).alias("lead"))
    sought = mine.where(outside & (F.col("blocks") > 1)).withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
    sought = sought.where("block <> own").select("bucket", "block", F.lit(SOUGHT).alias("role"), "v", "n", "root", F.lit(0).alias("lead"))
    more = cut(check(cut(tree_pairs(stored.unionByName(sought).join(points, "v"), percent, False), "crossing"), False), "links")
    if more.head(1):  # later links join components, so only the roots that they touch are looked at again
        root = lambda x: roots.select(F.col("v").alias(x), F.col("root").alias(f"root_{x}"))
        lifted = more.join(root("a"), "a", "left").join(root("b"), "b", "left")
        top = cut(components(lifted.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))), "roots")
        roots = roots.unionAll(top.select("v", F.col("v").alias("root")).join(roots, "v", "left_anti"))
        roots = roots.join(top.select(F.col("v").alias("root"), F.col("root").alias("_top")), "root", "left").select("v", F.coalesce("_top", "root").alias("root"))
    return own, vertices, roots


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """A row a document: doc_id, n_shingles, component_id (smallest doc_id that links reach)."""
    own, vertices, roots = links(docs, shingle, percent)
    known = vertices.select("s1", "s2", "v", F.col("doc_id").alias("first")).join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))
    known = cut(known, "known")
    least = known.groupBy("root").agg(F.min("first").alias("component_id"))
    places = known.join(least, "root").select("s1", "s2", "component_id")
    joined = own.select("doc_id", "n", "s1", "s2").join(places, ["s1", "s2"], "left")
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def dedup(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The documents with one row of each component: the one whose doc_id is smallest, rows without doc_id last."""
    key = "doc_id"
    keyed = docs
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").head(1):
        # Repeated or missing ids name no row, so each row gets a number in the order of doc_id.
        key = "_jj_row"
        order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.col("_jj_at")]
        placed = cut(docs.withColumn("_jj_at", F.monotonically_increasing_id()), "placed")
        keyed = cut(placed.orderBy(*order).withColumn(key, F.monotonically_increasing_id()).drop("_jj_at"), "keyed")
    named = keyed.select(F.col(key).alias("doc_id"), "text")
    gone = near_duplicates(named, shingle, percent).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return keyed.join(gone, keyed[key] == gone["_gone"], "left_anti").select(*own_columns(docs))
