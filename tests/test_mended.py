"""TOML that its parser reads back, systems of numerals, rules with plain replacements, forgiven tokens, containment."""

import json
import random
import tomllib

import pytest

from sheafline.functions.numbering import apply_pattern
from sheafline.operators import rewrite, selectors, textdiff
from sheafline.sources.readers import _toml


def test_toml_round_trip():
    tree = {
        "title": "a \"b\" \\ \n \x7f", "n": 5, "f": 1.5, "yes": True, "list": [1, [2, "x"]], "mixed": [{"a": 1}, 2], "none": [],
        "owner": {"name": "x", "deep er": {"k": [1]}}, "rows": [{"b": 1}, {"b": 2, "in": {"c": 3}, "more": [{"d": 4}]}],
    }
    assert tomllib.loads(_toml(tree)) == tree
    assert tomllib.loads(_toml({"a": None, "b": {}})) == {"b": {}}
    with pytest.raises(TypeError):
        _toml({"a": [None]})


def test_numeral_systems():
    shown = lambda pattern, *n: apply_pattern(pattern, list(n))
    assert [shown(k, 12) for k in (chr(0x661), chr(0x6F1), chr(0x967), chr(0x9E7))] == ["".join(chr(z + int(d)) for d in "12") for z in (0x660, 0x6F0, 0x966, 0x9E6)]
    assert [shown("ㄱ)", n) for n in (0, 1, 14, 15)] == ["0)", "ㄱ)", "ㅎ)", "ㄱㄱ)"]
    assert shown("1.い", 3, 2) == "3.ろ" and shown("あ", 46) == "ん" and shown("a", 27) == "aa" and shown("A", 28) == "AB"


def test_text_rule_is_plain(spark):
    runs = spark.createDataFrame([(1, 0, "co"), (1, 1, "st 5")], "doc long, ord long, text string")
    assert rewrite.show_text(runs, ["doc"], "ord", "text", "cost", "$1 \\x").first().text == "$1 \\x 5"


def test_forgiven_tokens(spark):
    random.seed(2)
    words = ["".join(random.choices("ab", k=random.randint(1, 5))) for _ in range(40)]
    s, o = set(words[:20]), set(words[20:])
    frame = lambda x: spark.createDataFrame([(1, t) for t in x], "id long, token string")
    near = lambda t, u: t == u or (1 <= len(u) - len(t) <= 2 and (u.startswith(t) or u.endswith(t)))
    assert {r.token for r in textdiff.lost_tokens(frame(s), frame(o), ["id"]).collect()} == {t for t in s if not any(near(t, u) for u in o)}


def test_within_is_containment(spark):
    random.seed(3)
    rows = []
    for doc in range(20):
        for ord in range(15):
            rows.append((doc, ord, random.randint(ord + 1, 16), random.choice("ab"), None, None, {"k": "v"}))
    table = spark.createDataFrame(rows, "doc_id long, ord long, end_ord long, elem string, level int, label string, fields map<string, string>")
    got = sorted((r.doc_id, r.ord, json.dumps(r.fields)) for r in selectors.query(table, selectors.elem("a").within(selectors.elem("b") | selectors.elem("a"))).collect())
    want = sorted((d, o, json.dumps(f)) for d, o, _, e, _, _, f in rows if e == "a" and any(x[0] == d and x[1] < o < x[2] for x in rows))
    assert got == want
    assert selectors.query(table, selectors.elem("a").within(selectors.elem("b"))).columns == table.columns


def test_unique_look_ups(spark):
    rows = spark.createDataFrame(
        [(1, 0, 2, "heading", 1, "a", {}), (1, 1, 2, "item", 2, "b", {}), (2, 0, 1, "item", 1, "b", {})],
        "doc_id long, ord long, end_ord long, elem string, level int, label string, fields map<string,string>",
    )
    assert selectors.query_unique(rows, selectors.elem("item")).count() == 2
    assert selectors.query_label(rows, "a").first().ord == 0
    bad = [
        selectors.query_unique(rows, selectors.elem("heading")), selectors.query_unique(rows, selectors.elem()), selectors.query_label(rows, "b"), selectors.query_label(rows, "c"),
        selectors.query_unique(rows, selectors.elem("item").within(selectors.elem("heading"))),
    ]
    for b in bad:
        with pytest.raises(Exception):  # noqa: B017
            b.collect()
