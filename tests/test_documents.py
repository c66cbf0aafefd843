"""Selectors, folds, lookups, merge and rounds on small documents."""

import pytest
from pyspark.sql import functions as F

from sheafline.operators import elements, folds, frames, lookups, merge, order, records, rewrite, selectors, textdiff
from sheafline.operators.selectors import Label, elem
from sheafline.plans import rounds
from sheafline.streaming import watch

ROWS = [
    (0, "heading", "A", 1, None, True, None), (1, "heading", "B", 2, None, True, None), (2, "figure", "Cat", None, "cat", True, None), (3, "heading", "D", 3, None, False, None),
    (4, "heading", "E", 1, None, True, "first"), (5, "figure", "Frog", None, "frog", True, None), (6, "figure", "Giraffe", None, "giraffe", True, "second"),
    (7, "figure", "GiraffeCat", None, "cat", True, "second"), (8, "heading", "H", 1, None, True, None), (9, "figure", "Iguana", None, "iguana", True, None), (10, "heading", "I", 2, None, True, None),
]


@pytest.fixture(scope="module")
def doc(spark):
    rows = [(1, o, o + 1, k, lv, lb, {"body": b, "kind": kd, "outlined": str(out).lower(), "supplement": "Other" if kd == "cat" else None}) for o, k, b, lv, kd, out, lb in ROWS]
    return spark.createDataFrame(rows, "doc_id long, ord long, end_ord long, elem string, level int, label string, fields map<string, string>")


L1, L2, L3, CAT, FROG = elem("heading", level=1), elem("heading", level=2), elem("heading", level=3), elem("figure", kind="cat"), elem("figure", kind="frog")


@pytest.mark.parametrize(("selector", "want"), [
    (L1 | L3, "A D E H"), (elem("heading", outlined="false"), "D"), (L1 | L2 | FROG | CAT, "A B Cat E Frog GiraffeCat H I"), (L1 | L1, "A E H"), (CAT & FROG, ""),
    ((elem("heading") | elem("figure")).before(Label("first")), "A B Cat D E"), ((L2 | elem("figure")).after(Label("first")), "Frog Giraffe GiraffeCat Iguana I"),
    (elem("figure", kind="cat", supplement="Other").after(Label("first")), "GiraffeCat"), (L1.before(Label("none")), "A E H"), (L1.after(Label("first"), inclusive=False), "H"),
    (L1.after(Label("first")) | CAT, "Cat E GiraffeCat H"), (elem("figure") & elem("figure").after(Label("first")), "Frog Giraffe GiraffeCat Iguana"),
])
def test_selectors(doc, selector, want):
    got = [r.fields["body"] for r in selectors.query(doc, selector).orderBy("ord").collect()]
    assert " ".join(got) == want


def test_unique(doc):
    assert selectors.locate(doc, Label("first")).first().ord == 4
    with pytest.raises(Exception):  # noqa: B017
        selectors.locate(doc, Label("second")).collect()
    assert {r.label: r.n for r in selectors.label_count(doc).collect()} == {"first": 1, "second": 2}
    assert selectors.query_first(doc, L2).first().ord == 1
    with pytest.raises(ValueError):
        selectors.field_values(selectors.query(doc, L1), "body", one=True)


def test_html_and_within(spark):
    page = "<h1 id=a>x <em>y <strong>there</strong></em></h1><p><strong>out</strong><br>z"
    e = elements.from_html(spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string"))
    inside = selectors.query(e, elem("strong").within(elem("em").within(elem("h1"))))
    assert inside.count() == 1 and selectors.query(e, elem("h1").within(elem("em"))).count() == 0
    assert rewrite.plain_text(e, elem("h1")).first().text == "x y there"
    assert {r.doc_id for r in e.collect()} == {1}
    texts = rewrite.collapse_spaces(spark.createDataFrame([(1, 1, " "), (1, 2, "a "), (1, 3, " "), (1, 4, "b")], "g int, o int, t string"), ["g"], "o", "t")
    assert [r.t for r in texts.orderBy("o").collect()] == ["a ", "b"]


def test_counter_cases(spark):
    rows = [(1, 1, "step", 1, None), (1, 2, "set", 0, [7]), (1, 3, "step", 1, None), (1, 4, "step", 1, None), (1, 5, "double", 0, None), (1, 6, "step", 1, None)]
    df = spark.createDataFrame(rows, "doc long, ord long, kind string, level int, numbers array<long>")
    out = folds.counter_fold(df, ["doc"], ["ord"], {"double": lambda s: [2 * x for x in s]})
    assert [r.counter for r in out.orderBy("ord").collect()] == [[1], [7], [8], [9], [18], [19]]


def test_closed_form_is_the_fold(spark):
    import random

    random.seed(3)
    rows = [(g, k, "step", random.randint(1, 4), None) for g in range(3) for k in range(60)]
    df = spark.createDataFrame(rows, "doc long, ord long, kind string, level int, numbers array<long>")
    a = {(r.doc, r.ord): r.counter for r in folds.counter_steps(df, 4, ["doc"]).collect()}
    b = {(r.doc, r.ord): r.counter for r in folds.counter_fold(df, ["doc"], ["ord"]).collect()}
    assert a == b


def test_state(spark):
    df = spark.createDataFrame([(1, k) for k in range(3)], "doc long, ord long")
    out = folds.state_fold(df, ["doc"], "a", lambda s, _: s * 2, "string", ["ord"])
    assert [r.state for r in out.orderBy("ord").collect()] == ["aa", "aaaa", "aaaaaaaa"]
    at = folds.as_of(spark.createDataFrame([(1, 0), (1, 5)], "doc long, ord long"), spark.createDataFrame([(1, 2, "x"), (1, 5, "y")], "doc long, ord long, v string"), ["doc"], "v", default=F.lit("init"))
    assert [r.v for r in at.orderBy("ord").collect()] == ["init", "y"]


def test_merge(spark):
    files = spark.createDataFrame([("a", "one two three"), ("b", "same same"), ("c", "left middle right")], "file string, contents string")
    regions = spark.createDataFrame([(1, "a", "one", "one", None), (2, "a", "three", "three", None), (3, "b", "same", "same", None), (4, "c", "gone", "gone", None), (5, "c", "left mid", "left mid", None), (6, "c", "middle", "middle", None)], "id long, file string, source string, baseline string, format string")
    edits = spark.createDataFrame([(1, "1", None, False), (2, "3", None, False), (3, "x", None, False), (4, "y", None, False), (5, "l", None, False), (6, "m", None, False)], "id long, word string, format string, moved boolean")
    planned = merge.plan(regions, edits, files)
    assert {r.id: r.status for r in planned.collect()} == {1: "ready", 2: "ready", 3: "ambiguous_location", 4: "local_overlap", 5: "overlapping_regions", 6: "overlapping_regions"}
    assert [tuple(r) for r in merge.apply(planned, files).collect()] == [("a", "1 two 3")]


def test_rounds(spark):
    up = lambda df: df.select(F.least(F.col("x") + 1, F.lit(3)).cast("int").alias("x"))
    out, stable = rounds.fixpoint(spark.createDataFrame([(0,)], "x int"), up)
    assert stable and out.first().x == 3
    with pytest.warns(UserWarning):
        assert not rounds.fixpoint(spark.createDataFrame([(0,)], "x int"), lambda df: df.select((F.col("x") + 1).alias("x")), 2)[1]
    assert rounds.while_(spark.createDataFrame([(0,)], "x int"), lambda df: df.first().x < 2, up).first().x == 2


def test_order_and_frames(spark):
    df = order.with_ord(spark.range(1000).select((F.col("id") * 37 % 1000).alias("x")), ["x"], partitions=7)
    assert df.filter("x <> ord").count() == 0
    left, right = spark.range(3).withColumnRenamed("id", "ord"), spark.range(2).withColumnRenamed("id", "ord")
    with pytest.raises(Exception):  # noqa: B017
        frames.zip_rows(left, right, "ord", exact=True).collect()
    assert frames.upper_median(spark.createDataFrame([(1, x) for x in (1, 2, 4, 4)], "g int, v int"), "v", ["g"]).first().median == 4


def test_lookups_and_records(spark):
    refs = spark.createDataFrame([("a",), ("b",)], "key string")
    with pytest.raises(Exception):  # noqa: B017
        lookups.resolve(refs, spark.createDataFrame([("a", 1), ("a", 2)], "key string, v int"), "key").collect()
    comments = records.anchored_comments(
        spark.createDataFrame([(1, "open", 3), (1, "open", 1), (1, "close", 9), (2, "close", 4)], "id int, kind string, ord int"), spark.createDataFrame([(1, "x"), (2, "y")], "id int, t string"), "id", "kind", "ord")
    assert [tuple(r) for r in comments.collect()] == [(1, "x", 1, 9)]
    facts = records.complete_groups(spark.createDataFrame([(1, "2"), (1, "x"), (2, "3.5")], "g int, v string"), ["g"], "v")
    assert {r.g: r.complete for r in facts.collect()} == {1: False, 2: True}
    assert textdiff.manifest_problems(
        spark.createDataFrame([("a", "x"), ("b", "y")], "name string, digest string"), spark.createDataFrame([("a", "1"), ("c", "2")], "name string, content string"), "name", "content", "digest"
    ).count() == 3


def test_text_measures(spark, val):
    assert val(textdiff.tokens(F.lit("Ab c dE_f1 gh"))) == ["ab", "de", "gh"]
    assert val(textdiff.without_marks(F.lit(chr(0xE9)))) == "e" and val(textdiff.folded_tokens(F.lit("STRASSE"))) == ["strasse"]
    assert val(textdiff.sequence_ratio(F.lit("a b c d"), F.lit("a b c d"))) == 1.0


def test_watch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"x": 1}\n{"x": 2}\n')
    seen = []
    watch.watch(spark, str(tmp_path / "in"), "x int", lambda df, _: seen.extend(r.x for r in df.collect()), str(tmp_path / "cp"), once=True).awaitTermination()
    assert sorted(seen) == [1, 2]
    ms = spark.createDataFrame([(1, t) for t in (0, 50, 300, 390, 480, 570, 660, 750, 840)], "g int, t long")
    out = watch.event_batches(ms, ["g"], F.col("t"), ["t"])
    assert [r.batch for r in out.orderBy("t").collect()] == [1, 1, 2, 2, 2, 2, 2, 2, 3]
