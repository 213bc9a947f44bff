"""The pipeline's stages in order, against brute force for the three dedup stages."""

import corpus_pipeline
from lithic.llm import queries
from pyspark.sql import functions as F

from tests.llm.test_operators import brute_components, brute_repeats, crc, encoded


def test_stages(spark, sf_dir):
    docs = queries.documents(spark, sf_dir)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "substring_dedup", "packing"]
    texts = lambda frame: sorted((r.doc_id, r.text) for r in frame.select("doc_id", "text").collect())
    good = corpus_pipeline.quality(spark, docs, sf_dir).cache()
    assert good.columns == docs.columns and 0 < good.count() < docs.count()
    exact = corpus_pipeline.exact(spark, good, sf_dir).cache()
    keys: dict = {}
    for i, t in texts(good):
        keys.setdefault("".join(c for c in t if c not in " \t\n\x0b\x0c\r"), []).append((-len(t), i))
    assert [i for i, _ in texts(exact)] == sorted(min(v)[1] for v in keys.values())
    near = corpus_pipeline.near(spark, exact, sf_dir).cache()
    assert [i for i, _ in texts(near)] == sorted(i for i, (_, c) in brute_components(texts(exact), 5, 80).items() if c == i)
    passages = corpus_pipeline.passages(spark, near, sf_dir)
    removed = brute_repeats(texts(near))
    assert passages.columns == docs.columns and all(len(t.encode()) <= removed[i][0] - removed[i][1] for i, t in texts(passages))
    assert passages.where(F.col("n_chars") != F.length("text")).count() == 0


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert out and all(r.offset + r.length <= 4096 for r in out)


def without_repeats(rows):
    """{doc_id: text} without the bytes of each string of 100 that occurs earlier."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = text.encode()
        covered = bytearray(len(data))
        for j in range(len(data) - 99):
            if data[j : j + 100] in seen:
                covered[j : j + 100] = b"\1" * 100
            seen.add(data[j : j + 100])
        out[i] = bytes(b for b, c in zip(data, covered) if not c).decode("utf-8", "ignore")
    return out


def test_run_against_brute_force(spark, sf_dir):
    """Every piece of run(), from the rows that the quality stage keeps; places without gaps."""
    docs = queries.documents(spark, sf_dir)
    good = [(r.doc_id, r.text or "") for r in corpus_pipeline.quality(spark, docs, sf_dir).select("doc_id", "text").collect()]
    keys: dict = {}
    for i, t in good:
        keys.setdefault("".join(c for c in t if c not in " \t\n\x0b\x0c\r"), []).append((-len(t), i))
    once = {min(v)[1] for v in keys.values()}
    exact = sorted(x for x in good if x[0] in once)
    near = {i for i, (_, c) in brute_components(exact, 5, 80).items() if c == i}
    expected = []
    for i, text in without_repeats([x for x in exact if x[0] in near]).items():
        ids = encoded(text)
        expected += [(i, k // 4096, k, len(ids[k : k + 4096]), crc(ids[k : k + 4096])) for k in range(0, len(ids), 4096)]
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(expected)
    ends: dict = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096 and sorted(ends) == list(range(len(ends)))
