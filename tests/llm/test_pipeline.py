"""The stages against plain Python, on odd rows and on the small documents."""

import collections

from test_operators import SPACE, brute_links, check_mix, check_packing

import corpus_pipeline as C
from lodeweave.llm.work import documents, stored


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages_on_odd_rows(spark, odd, clashing, none):
    for _, stage in C.STAGES:
        out = stage(spark, none, "")
        assert out.collect() == []
    for docs in (odd, clashing):
        for n, (_, stage) in enumerate(C.STAGES):
            out = stage(spark, docs, "")
            if n < 4:
                assert out.columns == docs.columns
                assert set(rows_of(out)) <= set(rows_of(docs))
            out.count()


def test_stages_one_after_another(spark, small):
    docs = documents(spark, small)
    before = rows_of(docs)

    docs = stored(C.language(spark, docs, small), "s1")
    kept = rows_of(docs)
    assert set(kept) <= set(before)
    assert {r[0] for r in before} - {r[0] for r in kept} <= {r[0] for r in before if not any(c.isalpha() for c in r[1])}
    before = kept

    docs = stored(C.exact(spark, docs, small), "s2")
    first = {}
    for r in before:
        norm = SPACE.sub(" ", r[1])
        first[norm] = min(first.get(norm, r), r)
    kept = rows_of(docs)
    assert kept == sorted(first.values(), key=repr)
    before = kept

    docs = stored(C.near(spark, docs, small), "s3")
    kept = rows_of(docs)
    links, n = brute_links([(r[0], r[1]) for r in before])
    assert {r[0] for r in kept} == {c for _, c, _ in links} and len(kept) == n
    before = kept

    mixed = stored(C.mixed(spark, docs, small), "s4")
    copies = collections.Counter(rows_of(mixed))
    assert set(copies) <= set(before) and max(copies.values()) <= 2
    out = C.mix(docs, C.word_count(C.F.col("text")))
    check_mix(out, [(r.doc_id, r.text, r.source) for r in docs.collect()])
    assert {r.doc_id: r.copies for r in out.where("copies > 0").collect()} == {r[0]: n for r, n in copies.items()}

    check_packing(C.packed(spark, mixed, small), [(r.doc_id, r.text) for r in mixed.collect()], 2048, 65_536)


def test_dropped_rows_by_shuffle(spark, odd, monkeypatch):
    """Lists of dropped rows that are too long to broadcast; rows that come from files, from a plan and from memory."""
    files = stored(odd, "odd")
    for stage in (C.exact, C.near):
        want = rows_of(stage(spark, files, ""))
        with monkeypatch.context() as m:
            m.setattr(C, "BROADCAST_ROWS", 0)
            for docs in (files, files.where("true"), odd):
                assert rows_of(stage(spark, docs, "")) == want
    repeated = files.unionAll(files)
    assert rows_of(C.exact(spark, repeated, "")) == rows_of(C.exact(spark, files, ""))


def test_packing_is_optimal_for_its_own_histogram(spark, small):
    rows = C.packed(spark, documents(spark, small), small).collect()
    held = sorted(collections.Counter(r.length for r in rows).items())
    padding = [[sum((held[i][0] - x) * n for x, n in held[j : i + 1]) for j in range(i + 1)] for i in range(len(held))]
    best = [row[0] for row in padding]  # by last length: the least with one bucket, then with one more each time
    for _ in range(7):
        best = [min([best[i], *(best[j - 1] + padding[i][j] for j in range(1, i + 1))]) for i in range(len(held))]
    assert sum(r.padding for r in rows) == best[-1]


def test_run(spark, small):
    out = C.run(spark, small)
    assert out.columns == ["doc_id", "piece", "start", "length", "bucket", "bound", "batch", "slot", "padding"]
    assert out.count() > 0
