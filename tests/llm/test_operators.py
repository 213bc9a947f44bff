"""Each operator against a brute-force version on a small table with nulls, empty and long texts, ties and repeated rows."""

import glob
import hashlib
import random
import re
import textwrap
import time
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lithic.llm import byte_bpe, exact_dedup, jaccard_join, license_scan, packing, quality_classifier, quality_rules, sharding, substring_dedup, text_stats, token_files
from lithic.llm.common import cut

WORD, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
R = random.Random(5)
VOCABULARY = ["".join(R.choice("abcdefghij") for _ in range(R.randint(2, 9))) for _ in range(400)]
prose = lambda n: " ".join(R.choice(VOCABULARY) for _ in range(n))
BASE, PASSAGE = prose(120), prose(40)


def table():
    near = BASE.split()
    rows = [(0, BASE), (1, BASE), (2, " ".join(near[:60] + ["other"] + near[61:])), (3, None), (4, ""), (5, "  \n\t"), (6, "one"), (7, "One"), (8, "a b c")]
    rows += [(9, prose(30) + "\n" + PASSAGE + "\n" + prose(25)), (10, prose(50) + " " + PASSAGE), (11, PASSAGE), (12, "x" * 5000), (13, "é" * 150 + "日本語 ünï <|endoftext|> \x1c x")]
    rows += [(14, BASE.replace(" ", "  ")), (15, prose(9000)), (16, "Released under the MIT License.\n" + prose(40)), (17, prose(60).upper() + "!! ### $$$"), (18, prose(12) * 6)]
    rows += [(20 + i, prose(R.randint(1, 90))) for i in range(30)]
    rows += [(60 + i, " ".join(w if R.random() > 0.015 else "zz" for w in near)) for i in range(12)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return table()


#: Names that operators give to results or use themselves.
CLASHING = ["score", "SHARD", "kept", "size", "v", "mark", "license", "dice", "n_matches", "posterior", "_counts", "_votes", "base_failed", "predicted", "held_out", "law", "slot", "grown_shard", "score_input", "a.b", "_sd_id", "_hs_at"]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """Extra columns have names that operators use themselves."""
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return frame.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long"), **{c: F.lit(k) for k, c in enumerate(CLASHING)}})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def encoded(text):
    from tokenizers import Tokenizer

    encoded.t = getattr(encoded, "t", None) or Tokenizer.from_file(WORD)
    return [*encoded.t.encode(text or "", add_special_tokens=False).ids, 1]


crc = lambda ids: zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def test_token_files(docs, rows, empty):
    got = {r.doc_id: r for r in token_files.token_files(docs, WORD, sequence=64).collect()}
    start = 0
    for i, text in sorted(rows):
        ids = encoded(text)
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), crc(ids)), i
        start += len(ids)
    assert len(got) == len(rows) and token_files.token_files(empty, WORD).count() == 0


def test_token_file_random_access(docs, rows):
    manifest = token_files.write_sequences(docs.repartition(1), WORD, sequence=64).orderBy("first_doc").collect()
    stream = [i for _, text in sorted(rows) for i in encoded(text)]
    at = 0
    for part in manifest:
        file = token_files.SequenceFile(part.file)
        for k in range(part.n_sequences):
            ids, valid, starts = file.sequence(k)
            n = sum(valid.to_pylist())
            assert len(ids) == 64 and list(ids[:n]) == stream[at : at + n]
            at += n
    assert at == len(stream)


def test_byte_bpe(docs, rows, empty):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTES, "rb"))}
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    kept = byte_bpe.encode_documents(docs, BYTES, public_tokenizers.PATTERN, keep_ids=True)
    back = {r.doc_id: bytes(r.decoded) for r in byte_bpe.decode_documents(kept, BYTES, public_tokenizers.PATTERN).collect()}
    for r in kept.collect():
        text = dict(rows)[r.doc_id] or ""
        ids = reference.encode_ordinary(text)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest() and back[r.doc_id] == text.encode()
    assert byte_bpe.encode_documents(empty, BYTES, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_long_and_odd_pieces():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTES, "rb"))}
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    bpe = byte_bpe.coder(BYTES, public_tokenizers.PATTERN)
    pick = random.Random(2)
    texts = ["ab" * 4000, "aaaa" * 999, " " * 777, "".join(pick.choice("etaoin") for _ in range(9000))]
    texts += ["".join(pick.choice(["a", "b", "the", " ", "  ", "\n", " \n", "'s", "é", "1", "!", "\x1c", "\x85", "　", "日", "😀", "\t"]) for _ in range(pick.randint(0, 30))) for _ in range(800)]
    for text in texts:
        ids, decoded, n = bpe.whole(text)
        assert ids.decode() == " ".join(map(str, reference.encode_ordinary(text))) and decoded == text.encode()


def test_packing_places_every_piece(docs, rows, empty):
    got = packing.pack_documents(docs, WORD, capacity=256).collect()
    for i, text in rows:
        ids = encoded(text)
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        assert [(r.start, r.length, r.ids_crc32) for r in own] == [(k, len(ids[k : k + 256]), crc(ids[k : k + 256])) for k in range(0, len(ids), 256)]
    by: dict = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    space: list[int] = []  # best-fit decreasing, which the plan must not be behind
    for length in sorted((r.length for r in got), reverse=True):
        room = min((x for x in space if x >= length), default=None)
        if room is not None:
            space.remove(room)
        space.append((256 if room is None else room) - length)
    assert -(-sum(r.length for r in got) // 256) <= len(by) <= len(space)
    assert packing.pack_documents(empty, WORD).count() == 0


@pytest.mark.parametrize("lengths", [{}, {1: 100_000}, {3: 5000, 2: 1}, {2: 9999, 4095: 7}, {1400: 5, 1365: 9, 1366: 8, 700: 40}])
def test_plan_uses_each_length_once(lengths):
    back: dict = {}
    for times, pattern in packing.plan(lengths):
        assert times > 0 and sum(k * n for k, n in pattern.items()) <= packing.CAPACITY
        for k, n in pattern.items():
            back[k] = back.get(k, 0) + times * n
    assert back == lengths


def test_plan_is_optimal_on_small_cases():
    def fewest(items, capacity):
        best = len(items)

        def place(i, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if i == len(items):
                best = len(bins)
                return
            for b in range(len(bins)):
                if bins[b] + items[i] <= capacity:
                    place(i + 1, [*bins[:b], bins[b] + items[i], *bins[b + 1 :]])
            place(i + 1, [*bins, items[i]])

        place(0, [])
        return best

    pick = random.Random(4)
    extra = 0
    for _ in range(30):
        items = sorted((pick.randint(5, 60) for _ in range(9)), reverse=True)
        found = sum(t for t, _ in packing.plan({k: items.count(k) for k in items}, 100))
        extra += found - fewest(items, 100)
    assert extra <= 1


def test_plan_is_not_behind_best_fit_decreasing():
    lengths = [1833, 1696, 1545, 1460, 1372, 1308, 1084, 1079]
    patterns, proven = packing.plan_proven({k: 1 for k in lengths})
    assert sum(t for t, _ in patterns) == 3 and proven
    pick = random.Random(8)
    for case in range(40):
        items = sorted((pick.randint(5, 70) for _ in range(60)), reverse=True)
        space: list[int] = []
        for x in items:
            room = min((s for s in space if s >= x), default=None)
            if room is not None:
                space.remove(room)
            space.append((100 if room is None else room) - x)
        histogram = {k: items.count(k) for k in items}
        assert sum(t for t, _ in packing.best_fit(histogram, 100)) == len(space)
        patterns, _ = packing.plan_proven(histogram, 100)
        assert sum(t for t, _ in patterns) <= len(space)
        assert all(sum(t * p.get(k, 0) for t, p in patterns) == n for k, n in histogram.items()) and all(sum(k * n for k, n in p.items()) <= 100 for _, p in patterns)


def test_search_revisits_fillings():
    """Against every way to pack: from a bad incumbent the search must come to the fewest sequences and prove it."""

    def fewest(items, bins, best):
        if len(bins) >= best:
            return best
        if not items:
            return len(bins)
        for room in {x for x in bins if x >= items[0]}:
            rest = list(bins)
            rest.remove(room)
            best = min(best, fewest(items[1:], [*rest, room - items[0]], best))
        return min(best, fewest(items[1:], [*bins, 100 - items[0]], best))

    pick = random.Random(2)
    for _ in range(60):
        items = sorted((pick.randint(8, 60) for _ in range(10)), reverse=True)
        histogram = {k: items.count(k) for k in items}
        patterns, proven = packing.search(histogram, 100, [(1, {k: 1}) for k in items], packing.fewest_possible(histogram, 100), 10**6)
        assert proven and sum(t for t, _ in patterns) == fewest(items, [], 11)


def test_dominated():
    counts = {30: 1, 20: 1, 10: 2, 7: 1}
    present = sum(1 << k for k in counts)
    assert packing.dominated([(20, 1), (10, 1)], 0, counts, present)  # 30 takes the place of both
    assert packing.dominated([(7, 1)], 3, counts, present)  # 10 fits in the place of 7
    assert not packing.dominated([(30, 1)], 0, counts, present) and not packing.dominated([(10, 2), (7, 1)], 0, counts, present & ~(1 << 20))


blanks = re.compile(r"[\x20\x09-\x0D]+")


def test_exact_dedup(docs, rows, empty):
    groups: dict = {}
    for i, text in rows:
        groups.setdefault(blanks.sub("", text or ""), []).append((-len(text or ""), i))
    for block in (7, 2048):
        for r in exact_dedup.groups(docs, block).collect():
            key = blanks.sub("", dict(rows)[r.doc_id] or "")
            first = min(groups[key])[1]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (first, len(groups[key]), r.doc_id == first, hashlib.sha256(key.encode()).hexdigest())
    kept = exact_dedup.dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups) and exact_dedup.groups(empty).count() == 0


def test_exact_dedup_repeated_rows(spark):
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "ab"), (2, None), (3, "")], "doc_id long, text string")
    got = exact_dedup.groups(twice).collect()
    assert len(got) == 5 and sum(r.kept for r in got) == 2 and exact_dedup.dedup(twice).count() == 2


def shingles(text, k):
    w = [x for x in blanks.split((text or "").translate({i: i + 32 for i in range(65, 91)})) if x]
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_components(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_jaccard_join(docs, rows, k, percent):
    expected = brute_components(rows, k, percent)
    got = jaccard_join.near_duplicates(docs, k, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected
    if k == 5:
        kept = jaccard_join.dedup(docs, k, percent)
        assert kept.columns == docs.columns and kept.count() == len({c for _, c in expected.values()})


def test_jaccard_dedup_decides_by_row(spark):
    """Repeated and missing doc_ids: one row of each component stays, whatever ids its rows have."""
    clean, other = prose(60), prose(60)
    table = [(1, BASE), (2, BASE + " more"), (2, clean), (3, other), (3, other), (None, other), (None, PASSAGE), (None, PASSAGE), (4, None)]
    got = jaccard_join.dedup(spark.createDataFrame(table, "doc_id long, text string")).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(map(tuple, got), key=key) == sorted([(1, BASE), (2, clean), (3, other), (None, PASSAGE), (4, None)], key=key)


def test_jaccard_join_empty(empty):
    assert jaccard_join.near_duplicates(empty).count() == 0


def test_tree_finds_all_that_may_link():
    import numpy as np

    pick = np.random.default_rng(1)
    points = pick.poisson(3, (700, jaccard_join.GROUPS)).astype(np.uint8)
    points[300:600] = points[:300] + (pick.random((300, jaccard_join.GROUPS)) < 0.1)
    sizes, buckets = points.sum(axis=1).astype(np.int64), pick.integers(0, 3, 700)
    buckets[300:600] = buckets[:300]
    tree, q = jaccard_join.RTree(buckets, sizes, points), np.arange(0, 700, 7)
    query, place, bound = tree.search(buckets[q], sizes[q], points[q], 85)
    for k in range(len(q)):
        most = np.minimum(points, points[q[k]]).sum(axis=1, dtype=np.int64)
        n = sizes[q[k]]
        ok = (buckets == buckets[q[k]]) & (most >= jaccard_join.needed(n, sizes, 85)) & (100 * np.minimum(sizes, n) >= 85 * np.maximum(sizes, n))
        assert dict(zip(place[query == k], bound[query == k])) == dict(zip(np.flatnonzero(ok), most[ok]))


def test_every_link_comes_from_the_tree(docs, rows, monkeypatch):
    """A tree that finds nothing leaves every set alone: no other path makes links."""
    import numpy as np

    none = np.zeros(0, np.int64)
    monkeypatch.setattr(jaccard_join, "tree_pairs", lambda rows_, percent, nearest: rows_.selectExpr("v as a", "v as b").where("false"))
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(docs, 4, 85).collect()}
    words = {i: tuple((t or "").lower().split()) for i, t in rows}
    assert len(none) == 0 and all(got[i] == min([j for j in words if words[i] and set(zip(*[words[j][k:] for k in range(4)])) == set(zip(*[words[i][k:] for k in range(4)])) and (len(words[i]) >= 4 or words[j] == words[i])] or [i]) for i in words)


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    """Buckets of many points are parted, and no link is lost between the parts."""
    monkeypatch.setattr(jaccard_join, "NEAR", 4)
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    monkeypatch.setattr(jaccard_join, "TOGETHER", 16)
    pick = random.Random(8)
    base = [prose(60).split() for _ in range(3)]
    table_ = [(i, " ".join(w if pick.random() > 0.01 else prose(1) for w in base[i % 3])) for i in range(90)]
    got = jaccard_join.near_duplicates(spark.createDataFrame(table_, "doc_id long, text string"), 4, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(table_, 4, 85)


def brute_repeats(rows):
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        covered = bytearray(len(data))
        for j in range(len(data) - 99):
            if data[j : j + 100] in seen:
                covered[j : j + 100] = b"\1" * 100
            seen.add(data[j : j + 100])
        runs = sum(bool(c) and (z == 0 or not covered[z - 1]) for z, c in enumerate(covered))
        out[i] = (len(data), sum(covered), runs, hashlib.sha256(bytes(b for b, c in zip(data, covered) if not c)).hexdigest())
    return out


def test_merged_blocks_are_the_repeated_intervals():
    """Blocks of the merged transforms against groups of equal prefixes, over shards of strings with zero bytes and copies."""
    pick = random.Random(4)
    for case in range(40):
        depth, copied = pick.choice([1, 3, 8]), bytes(pick.choice(b"\0ab\xff") for _ in range(12))
        shards = [[bytes(pick.choice(b"\0ab\xff") for _ in range(pick.randint(0, 20))) + pick.choice([b"", copied]) for _ in range(pick.randint(0, 5))] for _ in range(3)]
        groups: dict = {}
        for k, strings in enumerate(shards):
            at = 0
            for x in strings:
                for i in range(len(x) - depth + 1):
                    groups.setdefault(x[i : i + depth], set()).add((k, at + i))
                at += len(x) + 1
        found: dict = {}
        for block, shard, place in zip(*(x.tolist() for x in substring_dedup.merged_blocks(shards, depth))):
            found.setdefault(block, set()).add((shard, place))
        assert sorted(map(sorted, found.values())) == sorted(sorted(x) for x in groups.values() if len(x) > 1)


@pytest.mark.parametrize("held", [substring_dedup.HELD_RUNS, 1])
def test_substring_dedup(docs, rows, held, monkeypatch):
    """With one held run, every anchor with several contexts goes the way of the crowded ones."""
    monkeypatch.setattr(substring_dedup, "HELD_RUNS", held)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.deduplicated(docs, digest_only=True).collect()}
    assert got == brute_repeats(rows)


def test_substring_dedup_keeps_the_rest(docs, rows):
    out = substring_dedup.dedup(docs)
    assert out.columns == docs.columns
    expected = brute_repeats(rows)
    for r in out.collect():
        if expected[r.doc_id][1] == 0:
            assert r.text == dict(rows)[r.doc_id]
    long = "".join(random.Random(3).choice("abcd ") for _ in range(5000))
    text = long + long
    at = [x for piece in [text[o : o + 1000 + 99] for o in range(0, len(text) - 99, 1000)] for x in substring_dedup.runs_of([piece.encode()])[2]]
    assert sum(at) == len(text) - 99


def test_substring_dedup_empty(empty):
    assert substring_dedup.deduplicated(empty, digest_only=True).count() == 0


def test_substring_dedup_has_one_python_function_a_task(docs):
    """Two in a row would be two workers a task, and idle workers keep their memory while the next stage runs."""
    plan = substring_dedup.dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"ArrowEvalPython|MapInArrow|MapInPandas", plan.split("Initial Plan")[0])) == 1


@pytest.mark.parametrize("held", [substring_dedup.HELD_RUNS, 1])
def test_substring_dedup_rows_read_twice(spark, rows, held, monkeypatch):
    """Rows alike in doc_id and text are one document: each copy has the result of the one."""
    monkeypatch.setattr(substring_dedup, "HELD_RUNS", held)
    twice = spark.createDataFrame(rows + rows[::-1], "doc_id long, text string").repartition(3)
    got = substring_dedup.deduplicated(twice, digest_only=True).collect()
    expected = brute_repeats(rows)
    assert len(got) == 2 * len(rows) and all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == expected[r.doc_id] for r in got)


def test_cut_frees_its_shuffles(spark, tmp_path):
    def files():
        folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {f for d in folders for f in glob.glob(f"{d}/**/shuffle_*", recursive=True)}

    numbers = spark.range(5000).withColumn("k", F.col("id") % 50)
    wide = numbers.repartition(4, "k").join(numbers.groupBy("k").count().hint("merge"), "k")
    before = files()
    wide.write.parquet(str(tmp_path / "plain"))
    assert files() - before  # a plain write leaves them to the driver's garbage collection
    before = files()
    found = cut(wide)
    end = time.time() + 20
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before and found.count() == 5000


def test_sharding(spark, docs, rows, empty):
    got = sharding.shard(docs).withColumn("key", F.xxhash64(F.coalesce("text", F.lit("")))).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    for shard in range(8):
        own = sorted((r for r in got if r.shard == shard), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        assert [(r.key, r.doc_id) for r in own] == sorted((r.key, r.doc_id) for r in own)
    assert max((r.key, r.doc_id) for r in got if r.shard == 0) < min((r.key, r.doc_id) for r in got if r.shard == 7)
    assert all(r.size == len((dict(rows)[r.doc_id] or "").encode()) + 1 and r.law == "bytes" and r.grown_shard is None for r in got)
    assert all(r.size_input == CLASHING.index("size") and r.SHARD_input == CLASHING.index("SHARD") for r in got)
    assert sharding.shard(empty).count() == 0


def test_sharding_balances_and_keeps_groups(spark):
    pick = random.Random(1)
    rows = [(i, "hot text " * 20 if i % 3 == 0 else "t" * pick.randint(1, 300) + str(i // 2)) for i in range(6000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    size: dict = {}
    for r in got:
        size[r.shard] = size.get(r.shard, 0) + r.size
    mean = sum(size.values()) / 8
    assert len(size) == 8 and max(abs(x - mean) for x in size.values()) < 0.02 * mean
    of = {r.doc_id: r.shard for r in got}
    texts: dict = {}
    for i, t in rows:
        texts.setdefault(t, set()).add(of[i])
    assert all(len(s) == 1 for t, s in texts.items() if not t.startswith("hot"))


def test_license_scan(docs, rows, empty):
    got = {r.doc_id: r for r in license_scan.scan(docs).select("doc_id", "license", "dice", "n_matches").collect()}
    assert got[16].license == "MIT" and got[16].dice == 1.0 and got[3].license is None and got[3].dice == 0.0 and got[12].n_matches == 0
    assert license_scan.scan(empty).count() == 0


def brute_windows(text, templates, threshold=0.8):
    """(license, dice, n_matches) by every window of a text's words that is no longer than a template's bound."""
    words = re.sub(r"[^0-9a-z]+", " ", text.lower()).split()
    grams = [" ".join(p) for p in zip(words, words[1:])] or words
    found = []
    for i, (name, wording) in enumerate(templates):
        own = set(license_scan.template_bigrams(wording))
        longest = int(len(own) * (2 - threshold) / threshold + 1e-9)
        best = 0.0
        for a in range(len(grams)):
            seen = set()
            for b in range(a, min(len(grams), a + longest)):
                seen.add(grams[b])
                best = max(best, 2.0 * len(seen & own) / (len(seen) + len(own)))
        if best >= threshold:
            found.append((best, -i, name))
    return (max(found)[2], max(found)[0], len(found)) if found else (None, 0.0, 0)


def test_license_windows_find_wrapped_and_embedded_notices(spark, docs, empty):
    wrap = lambda text, lead="": "\n".join(lead + line for line in textwrap.wrap(text, 60))
    by = dict(license_scan.TEMPLATES)
    texts = [
        ("GPL-3.0", prose(20) + "\n" + wrap(by["GPL-3.0"], "# ") + "\n" + prose(20)),
        ("MIT", prose(15) + "\n" + wrap(by["MIT"], " * ") + "\n" + prose(15)),
        ("Proprietary", "Copyright 2020 Example. All rights reserved."),
        ("MIT", "The code of this page is here. Released under the MIT License. " + prose(10)),
        ("ISC", prose(9) + " " + by["ISC"].replace("copy, modify", "copy or modify").replace("any purpose", "every purpose") + " " + by["ISC"]),
        (None, prose(80)),
        (None, ""),
        (None, "License"),
    ]
    frame = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)] + [(99, None)], "doc_id long, text string")
    got = {r.doc_id: (r.license, r.dice, r.n_matches) for r in license_scan.scan_windows(frame, license_scan.TEMPLATES).collect()}
    assert got.pop(99) == (None, 0.0, 0)
    for i, (license, text) in enumerate(texts):
        assert got[i] == pytest.approx(brute_windows(text, license_scan.TEMPLATES)) and got[i][0] == license
    assert license_scan.scan_windows(empty).count() == 0
    assert license_scan.scan_windows(docs).columns == [*docs.columns, "license", "dice", "n_matches"]


@pytest.mark.parametrize("license,lead", [("MIT", ""), ("Apache-2.0", " * "), ("BSD-3-Clause", "# "), ("BSD-2-Clause", "// "), ("GPL-3.0", ""), ("AGPL-3.0", "; "), ("CC-BY-SA-4.0", "")])
def test_license_windows_find_full_texts(spark, license, lead):
    """The paragraphs of a licence wrapped in a document find it, and leave the units of whole lines and texts without it."""
    whole = "\n\n".join(t for name, t in license_scan.PARAGRAPHS if name == license)
    text = prose(30) + "\n" + "\n".join(lead + line for line in textwrap.wrap(whole, 72)) + "\n" + prose(30)
    row = license_scan.scan_windows(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    every = [*license_scan.TEMPLATES, *license_scan.PARAGRAPHS]
    assert (row.license, row.dice, row.n_matches) == pytest.approx(brute_windows(text, every)) and row.license == license
    if license == "MIT":
        assert license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().license is None


def brute_counts(text):
    text = text or ""
    words = [w for w in blanks.split(text) if w]
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if blanks.sub("", line):
            dup += line in seen
            seen.add(line)
    windows: dict = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_quality_rules(docs, rows, empty):
    for i, text in rows:
        assert text_stats.counts_of(text)[:5] == brute_counts(text), i
    judged = quality_rules.judge(docs).collect()
    got, votes = {r.doc_id: r for r in judged}, {r.doc_id: r._votes for r in judged}
    expected = brute_em(votes)
    for i, text in rows:
        n, _, _, _, repeated = brute_counts(text)
        assert got[i].base_failed == (n < 20 or 100 * repeated > 30 * n)
        assert abs(got[i].posterior - expected[i]) < 1e-6 and got[i].kept == (not got[i].base_failed and got[i].posterior >= 0.5)
        assert got[i].kept_input == CLASHING.index("kept") and got[i].posterior_input == CLASHING.index("posterior")
    assert quality_rules.judge(empty).count() == 0


def brute_em(votes):
    """Posteriors by expectation-maximisation over documents, with arrays of votes."""
    import numpy as np

    v = np.array([[{"+": 1, "-": -1, "0": 0}[c] for c in x] for x in votes.values()])
    plus, minus = (v == 1).astype(float), (v == -1).astype(float)
    good = (plus.sum(1) + 1) / (plus.sum(1) + minus.sum(1) + 2)
    for _ in range(500):
        share = (good.sum() + 1) / (len(good) + 2)
        among_good = (good @ plus + 8) / (good @ plus + good @ minus + 10)
        among_bad = ((1 - good) @ minus + 8) / ((1 - good) @ plus + (1 - good) @ minus + 10)
        odds = np.log(share / (1 - share)) + plus @ np.log(among_good / (1 - among_bad)) + minus @ np.log((1 - among_good) / among_bad)
        before, good = good, 1 / (1 + np.exp(-odds))
        if abs(good - before).max() < 1e-9:
            break
    return dict(zip(votes, good))


def test_em_tells_bad_patterns():
    found = quality_rules.posteriors({"+++++++++": 900, "+++0++++0": 80, "--+-++-++": 60, "+--+-+-++": 50, "-+--++-++": 45, "+++++++-+": 3})
    assert found["+++++++++"] > 0.9 and found["+++0++++0"] > 0.9 and found["--+-++-++"] < 0.5 and found["+--+-+-++"] < 0.5 and quality_rules.posteriors({}) == {}


def test_em_is_not_all_must_pass():
    """A bad vote of a rule that is often wrong does not drop, and the absence of bad votes does not keep."""
    found = quality_rules.posteriors({"++++0": 600, "++++-": 200, "----+": 200, "0000+": 20})
    assert found["++++-"] > 0.5 > found["0000+"] and found["++++0"] > 0.5 > found["----+"]


def test_quality_classifier_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality_classifier.score(docs, labels).join(labels, "doc_id").where("held_out").select("predicted", "quality").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.95 * len(got)


def test_quality_classifier_compiled(spark):
    """The compiled column against the rules evaluated one by one."""
    import math

    pick = random.Random(6)
    table_ = [(i, prose(pick.randint(5, 60)) + (" ### !!" * pick.randint(1, 20) if i % 3 == 0 else "") + "." * (i % 2)) for i in range(300)]
    docs = spark.createDataFrame(table_, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300) if i % 5], "doc_id long, quality int, toxic int")
    model = quality_classifier.learn(docs, labels)
    assert model["rules"]
    stats = docs.select("doc_id", text_stats.counts(F.col("text")).alias("s")).select("doc_id", *[c.alias(k) for k, c in quality_classifier.features(F.col("s")).items()]).collect()
    got = {r.doc_id: r for r in quality_classifier.score(docs, labels).collect()}
    for r in stats:
        margin = model["intercept"]
        for weight, path in model["rules"]:
            if all((r[model["features"][j]] > at) == side for j, side, at in path):
                margin += weight
        assert abs(got[r.doc_id].score - 1 / (1 + math.exp(-margin))) < 1e-9 and got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.7)


def test_quality_classifier_cases(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality_classifier.score(docs, none).collect()
    assert all(abs(r.score - 0.5) < 1e-9 and r.predicted == 0 for r in got) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(r.score_input == CLASHING.index("score_input") and r.score_input_input == CLASHING.index("score") for r in got)
    assert quality_classifier.score(empty, none).count() == 0
    assert quality_classifier.good(docs, none).columns == docs.columns


def test_nulls_and_repeated_rows(spark):
    """Rows without doc_id and rows given twice: each comes back as often as it was given."""
    given = [(None, BASE), (None, None), (1, BASE), (1, BASE), (2, None), (2, None), (3, prose(30)), (None, BASE)]
    frame = spark.createDataFrame(given, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1)], "doc_id long, quality int")
    ids = sorted([i for i, _ in given], key=str)
    of = lambda out: sorted([r.doc_id for r in out.collect()], key=str)
    assert of(token_files.token_files(frame, WORD)) == of(byte_bpe.encode_documents(frame, BYTES, public_tokenizers.PATTERN)) == ids
    assert of(sharding.shard(frame)) == of(license_scan.scan(frame)) == of(license_scan.scan_windows(frame)) == ids
    assert of(quality_rules.judge(frame)) == of(quality_classifier.score(frame, labels)) == ids
    assert not any(r.held_out for r in quality_classifier.score(frame, labels).where("doc_id is null").collect())
    packed = packing.pack_documents(frame, WORD).collect()
    assert sorted([r.doc_id for r in packed], key=str) == ids
    assert {(r.doc_id, r.ids_crc32) for r in packed} == {(i, crc(encoded(t))) for i, t in given}
    places = sorted((r.sequence_id, r.offset, r.length) for r in packed)
    assert all(a[0] != b[0] or a[1] + a[2] == b[1] for a, b in zip(places, places[1:]))
    near = {(r.doc_id, r.component_id) for r in jaccard_join.near_duplicates(frame).collect()}
    assert near == {(None, None), (1, 1), (2, 2), (3, 3)}
    assert of(substring_dedup.deduplicated(frame, digest_only=True)) == ids
