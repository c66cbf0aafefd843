"""Sets that share a run of prefix items meet at its first one only; first meetings are dealt in blocks."""

import pytest

pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from sheafline.llm import setjoin  # noqa: E402


def sets_of(spark, prefixes):
    rows = [(i, 19, 0, 0, p) for i, p in prefixes.items()]
    return spark.createDataFrame(rows, "id long, n int, bits long, more long, prefix array<long>")


@pytest.mark.parametrize("hot", [0, 256])
def test_a_run_is_one_meeting(spark, monkeypatch, hot):
    monkeypatch.setattr(setjoin, "HOT", hot)
    monkeypatch.setattr(setjoin, "later_first", lambda pairs, at, f=setjoin.later_first: [out := f(pairs, at), met.extend(map(tuple, out.collect()))][0])
    met = []
    sets = sets_of(spark, {1: [3, 5, 7, 9], 2: [3, 5, 7, 9], 3: [4, 5, 7, 9], 4: [3, 6, 7, 8], 5: [], 6: [1]})
    posted = setjoin.postings(sets.withColumn("part", F.lit(None).cast("long")), 0.8, ["id"], "part", before=True)
    assert [(r.t, r.b) for r in posted.filter("id = 1").orderBy("k").collect()] == [(3, None), (5, 3), (7, 5), (9, 7)]
    pairs = {tuple(r) for r in setjoin.all_met(posted, 0.8, ["id"], "part", F.lit(True)).collect()}
    assert pairs == {(2, 1), (3, 1), (3, 2), (4, 1), (4, 2), (4, 3)}
    # 4 meets 1 and 2 at two items apart; before, 2 and 1 met four times and 3 met either three times
    assert sorted(met) == sorted([(2, 1), (3, 1), (3, 2), (4, 1), (4, 1), (4, 2), (4, 2), (4, 3)])


def test_first_meetings_come_in_blocks(spark, monkeypatch):
    sets = sets_of(spark, {i: [i % 7 + 1, i % 5 + 10] for i in range(60)})
    posted = setjoin.postings(sets, 0.8, ["id"])
    found = []
    for blocks in (1, 3):
        monkeypatch.setattr(setjoin, "BLOCKS_FIRST", blocks)
        found.append({tuple(r) for r in setjoin.first_met(posted, 0.8, ["id"]).collect()})
    assert found[0] == found[1] and all(x > y for x, y in found[0]) and len(found[0]) > 50
