import brute
from test_dedup import frame, noisy_rows

from cairn.llm.fingerprint_index import FingerprintIndex


def test_batches_match_the_whole(spark, tmp_path):
    data = sorted(noisy_rows(seed=6), key=lambda r: r[0])
    index, got = FingerprintIndex(spark, str(tmp_path), fanout=2), {}
    for a in range(0, len(data), 18):
        got |= {r.doc_id: tuple(r)[1:] for r in index.extend(frame(spark, data[a : a + 18])).collect()}
        index = FingerprintIndex(spark, str(tmp_path), index.runs, fanout=2)
    assert got == brute.remove_windows(data, 13)
    assert len(index.runs) <= 2
    assert index.extend(frame(spark, [])).count() == 0
    assert [r.n_removed for r in index.extend(frame(spark, [(None, data[0][1])])).collect()] == [0]
