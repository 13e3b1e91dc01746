"""Where repeated copies stand in training."""

from collections import defaultdict

from cairn.llm.mixing import _copies, training_order


def test_each_copy_stands_where_the_demand_reaches_it(spark):
    # weights 1, 2, 3 by source; the large source weighs 1, so the small ones are taken three times
    rows = [(i, "w " * (5 + i % 9), "en", "abc"[0 if i < 300 else 1 + i % 2]) for i in range(330)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    per = defaultdict(list)
    for r in _copies(docs, 3).collect():
        per[r.row.source].append((r.first + r.lap * r.source_size, r.place, (" abc".index(r.row.source) - 1) % 3 + 1, r["size"], r.target, r.drift, r.lap))
    assert max(r[-1] for r in per["c"]) == 2
    for laps in per.values():
        laps.sort()
        assert all(0 <= p < 1 for _, p, *_ in laps)
        assert [p for _, p, *_ in laps] == sorted(p for _, p, *_ in laps)
        # copies follow one another without gaps or overlaps, and the cumulative demand at each place is its offset
        assert all(a[0] + a[3] == b[0] for a, b in zip(laps, laps[1:]))
        for offset, p, weight, _, target, drift, _ in laps:
            tilt = (weight - 2) / 2
            t = p if abs(drift) < 1e-9 else (-(1 - drift) + ((1 - drift) ** 2 + 4 * drift * p) ** 0.5) / (2 * drift)
            assert abs(((1 - tilt) * t + tilt * t * t) * int(target + 0.5) - offset) < 1e-6 * max(1, target)
    ordered = sorted((r.place, r.row.doc_id, r["size"], r.row.source) for r in _copies(docs, 3).collect())
    assert [r.doc_id for r in training_order(docs).collect()] == [d for _, d, *_ in ordered]
    # a position is the share of all words before it, up to the documents that are under way there
    total, before = sum(n for _, _, n, _ in ordered), 0
    for place, _, n, _ in ordered:
        assert abs(before - place * total) <= 3 * 13 + 3
        before += n


def test_columns_of_documents_keep_their_values(spark):
    rows = [(i, "w " * (5 + i % 9), "abc"[i % 3], f"own{i}", i, i) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string, target int, _lap int")
    out = training_order(docs)
    assert out.columns == docs.columns
    assert {tuple(r) for r in out.collect()} <= set(rows)
