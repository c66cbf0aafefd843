"""Lines of any number of words take part in line dedup."""

import random

import pytest

pytest.importorskip("public_tokenizers")

from sheafline.llm import line_dedup, setjoin  # noqa: E402


def brute(rows, threshold):
    """Text and number of removed lines by document: a line goes if a similar one stands before it; blank ones stay."""
    seen, out = [], {}
    for i, text in sorted(rows):
        left = []
        for line in text.split("\n"):
            s = frozenset(line.encode().split())
            if not s or not any(len(s & o) / len(s | o) >= threshold - 1e-12 for o in seen):
                left.append(line)
            if s:
                seen.append(s)
        out[i] = ("\n".join(left), text.count("\n") + 1 - len(left))
    return out


def short_lines():
    random.seed(8)
    rows = [(1, "Les.\n\nall rights reserved.\nLes."), (2, "Les.\n \nAll rights reserved.\none two three four"), (3, "All rights reserved.\none two three four five"), (4, "na " * 12 + "\nLes."), (5, "na na")]
    for k in range(6, 60):  # few words, so that small sets meet in all sizes
        rows.append((k, "\n".join(" ".join(random.choices("abcdefghij", k=random.randint(0, 8))) for _ in range(4))))
    return rows


@pytest.mark.parametrize(("threshold", "hot"), [(0.8, 256), (0.5, 0)])
def test_short_lines(spark, monkeypatch, threshold, hot):
    monkeypatch.setattr(setjoin, "HOT", hot)
    rows = short_lines()
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.without_matches(spark.createDataFrame(rows, "doc_id long, text string"), threshold).collect()}
    assert got == brute(rows, threshold)
    if threshold == 0.8:
        assert [got[k] for k in (2, 3, 4, 5)] == [(" \nAll rights reserved.\none two three four", 1), ("", 2), ("na " * 12, 1), ("", 1)]
