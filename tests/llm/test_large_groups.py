"""Large groups of near copies of lines: few pairs are left for the join of all pairs."""

import pytest

pytest.importorskip("public_tokenizers")

from sheafline.llm import line_dedup, setjoin  # noqa: E402


def test_lines_meet_others_than_by_their_rarest_words(spark, monkeypatch):
    """The rarest words of each near copy stand in one other line only, which is unlike it."""
    base = " ".join(f"w{k}" for k in range(40))
    own = [" ".join(f"own{i}x{k}" for k in range(3)) for i in range(200)]
    rows = [(i, f"{base} {own[i]}") for i in range(200)] + [(1000 + i, own[i] + " " + " ".join(f"u{i}x{k}" for k in range(20))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = []
    monkeypatch.setattr(line_dedup, "all_met", lambda *a, f=setjoin.all_met: [out := f(*a), asked.append(out.count())][0])
    assert {r.id for r in line_dedup.kept_lines(docs).collect()} == {0, *range(1000, 1200)}
    assert sum(asked) < 1000  # of 19,900 similar pairs
