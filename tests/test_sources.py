import json
import zipfile

import pytest
from pyspark.sql import functions as F

from sheafline.sources import cbor, office, readers, sinks


def put(path, content):
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def test_csv(spark, tmp_path):
    zoo = put(tmp_path / "zoo.csv", "Name,Species,Weight\nDebby,Rhinoceros,1900kg\nFluffy,Tiger,115kg\nSleepy,Dolphin,150kg\n")
    rows = readers.csv(spark, zoo, header=True).collect()
    assert (rows[0].Name, rows[1].Species, rows[2].Weight) == ("Debby", "Tiger", "150kg")
    bad = put(tmp_path / "bad.csv", "a,b\n1,2\n3,4,5\n")
    with pytest.raises(Exception):  # noqa: B017
        readers.csv(spark, bad).collect()
    with pytest.raises(ValueError):
        readers.csv(spark, zoo, delimiter="ab")


def get(df, path, kind):
    return df.select(F.variant_get("value", path, kind).alias("v")).first().v


def test_trees(spark, tmp_path):
    j = readers.tree(spark, put(tmp_path / "zoo.json", '[{"name": "Debby"}, {}, {"weight": 150}]'), "json")
    assert get(j, "$[0].name", "string") == "Debby" and get(j, "$[2].weight", "int") == 150
    with pytest.raises(Exception):  # noqa: B017
        readers.tree(spark, put(tmp_path / "bom.json", b"\xef\xbb\xbf{}"), "json").collect()
    big = readers.tree(spark, put(tmp_path / "big.json", str([2**63 - 1, 2**63])), "json")
    assert get(big, "$[0]", "bigint") == 2**63 - 1 and get(big, "$[1]", "double") == 2.0**63
    y = readers.tree(spark, put(tmp_path / "t.yaml", "a: null\nb: 1.12\nc: [1, 2]\nd: {1: one}\n"), "yaml")
    assert get(y, "$.b", "double") == 1.12 and get(y, "$.d['1']", "string") == "one"
    t = readers.tree(spark, put(tmp_path / "t.toml", 's = "x"\nd = 2023-02-01\n[table]\nelement = 5\n'), "toml")
    assert get(t, "$.table.element", "int") == 5 and get(t, "$.d", "string") == "2023-02-01"
    x = readers.tree(spark, put(tmp_path / "t.xml", '<data><hello name="hi">1</hello> <data/></data>'), "xml")
    assert get(x, "$[0].children[0].attrs.name", "string") == "hi" and get(x, "$[0].children[1]", "string") == " "
    c = readers.tree(spark, put(tmp_path / "t.cbor", cbor.encode({"a": [1, -2, 1.5, None, True, "x"]})), "cbor")
    assert get(c, "$.a[1]", "int") == -2


@pytest.mark.parametrize("v", [0, 23, 24, 255, 65536, 2**40, -1, -500, 1.5, "text", b"bytes", [1, [2]], {"k": {"n": None}}, True])
def test_cbor(v):
    assert cbor.decode(cbor.encode(v)) == v


def test_cbor_errors():
    assert cbor.decode(b"\x9f\x01\x02\xff") == [1, 2] and cbor.decode(b"\xf9\x3c\x00") == 1.0 and cbor.decode(b"\x1b" + b"\xff" * 8) == float(2**64 - 1)
    for bad in (b"", b"\x62a", b"\x01\x01"):
        with pytest.raises(ValueError):
            cbor.decode(bad)


def test_read_and_limits(spark, tmp_path):
    p = put(tmp_path / "a.txt", "one\ntwo")
    assert readers.read(spark, p).first().value == "one\ntwo" and bytes(readers.read(spark, p, None).first().value) == b"one\ntwo"
    with pytest.raises(Exception):  # noqa: B017
        readers.files(spark, p, 3).collect()
    with pytest.raises(Exception):  # noqa: B017
        readers.read(spark, put(tmp_path / "b.txt", b"\xff\xfe")).collect()


def test_bibliography(spark, tmp_path):
    put(tmp_path / "a.bib", '@book{k1, title = {A {B} c}, year = 1999}\n@article{k2, author = "X"}\n')
    rows = {r.key: r for r in readers.bibliography(spark, str(tmp_path / "a.bib")).collect()}
    assert rows["k1"].fields == {"title": "A {B} c", "year": "1999"} and rows["k2"].kind == "article"
    put(tmp_path / "c.bib", "@book{k, a = {1}}\n@book{k, a = {2}}\n")
    with pytest.raises(Exception):  # noqa: B017
        readers.bibliography(spark, str(tmp_path / "c.bib")).collect()


def test_office(spark, tmp_path):
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' for s, t in (("Heading1", "Top"), ("Normal", "Text")))
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{office.W[1:-1]}"><w:body>{body}</w:body></w:document>')
    rows = office.office(spark, str(tmp_path / "a.docx")).orderBy("ord").collect()
    assert [(r.elem, r.level, r.text) for r in rows] == [("heading", 1, "Top"), ("par", None, "Text")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("error", "font", "x"), ("warn", "font", "y"), ("warn", "size", "z")], "severity string, what string, detail string")
    report = {r.severity: r for r in sinks.loss_report(df).collect()}
    assert report["warn"].n == 2 and json.loads(report["warn"].details)[0]["detail"] == "y"
    sinks.write_bundle(df.select(F.col("what").alias("name"), F.col("detail").alias("value")), str(tmp_path / "out"))
    assert {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()} == {"name=font", "name=size"}
    assert sinks.serialised(df.limit(1), "yaml").first().value.startswith("severity:")
    assert sinks.fidelity(df, ["what"]).filter("what = 'font'").first().occurrences == 2
    assert sinks.serialised(df.limit(1), pretty=True).first().value.count("\n") > 1
