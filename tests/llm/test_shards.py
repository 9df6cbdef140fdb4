"""Groups of the training-data operators stay bounded however the rows lie."""

import numpy as np

from matchbook.llm import exact, minhash


def test_uneven_ids_do_not_put_all_digests_in_one_shard(spark, monkeypatch):
    counts, table = [], exact.history_table

    def noted(*args):
        out = table(*args)
        counts.append(out[1])
        return out

    monkeypatch.setattr(exact, "SHARD_DIGESTS", 50)
    monkeypatch.setattr(exact, "history_table", noted)
    rows = [(-(10**15), "text 0")] + [(i, f"text {i % 400}") for i in range(1, 501)]
    got = exact.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert counts[0] >= 399 / 50
    least = {}
    for i, t in sorted(rows):
        least.setdefault(t, i)
    assert {r.doc_id: r.keep_id for r in got} == {i: least[t] for i, t in rows}


def test_tiles_of_a_hot_bucket_are_spread(spark, monkeypatch):
    counts, shards = [], minhash.shards_for

    def noted(rows, per_shard):
        counts.append((rows, shards(rows, per_shard)))
        return counts[-1][1]

    monkeypatch.setattr(minhash, "TILE_NODES", 4)
    monkeypatch.setattr(minhash, "shards_for", noted)
    monkeypatch.setattr(minhash, "_able", lambda rows, sets: rows)
    nodes = range(40)
    rows = spark.createDataFrame([(1, i, 5, i, 5) for i in nodes], "key long, node long, n int, component long, shared long")
    same = {7: 3}  # two equal sets among sets that share nothing
    sets = spark.createDataFrame([(i, bytearray(np.arange(5, dtype=np.int64) + 100 * same.get(i, i))) for i in nodes], "node long, shingles binary")
    links = {(min(r), max(r)) for r in minhash._links_across(rows, sets).collect()}
    assert links == {(3, 7)}
    rows_sent, n = counts[-1]
    assert rows_sent > 5 * len(nodes) and n >= rows_sent / 4
