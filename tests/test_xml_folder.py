"""The XML source: every record once however a file is split, errors as rows, repairs as findings."""

import io
import random
import xml.etree.ElementTree as ET

import pytest

from palimpsest.sources import xml_folder as X


def records(data, cuts, name="act"):
    edges = [0, *cuts, len(data)]
    f = io.BytesIO(data)

    def read(at, n):
        f.seek(at)
        return f.read(n)

    return [r for a, b in zip(edges, edges[1:]) for r in X.records_in(read, len(data), a, b, name)]


def test_every_record_once_wherever_a_file_is_cut(monkeypatch):
    r = random.Random(1)
    parts = [f'<act n="{k}">{"x" * r.randint(0, 30)}<b a=">"/></act>' if k % 5 else f"<act n='{k}/>'/>" for k in range(40)] + ["<actor>no</actor>", "<act>cut off", "<act >last</act >"]
    data = ("<acts>\n" + "\n ".join(parts) + "</acts>").encode()
    whole = records(data, [])
    assert len(whole) == 42 and [ET.fromstring(d).get("n") for _, d in whole[:40]] == [str(k) if k % 5 else f"{k}/>" for k in range(40)]
    assert whole[40][1].startswith(b"<act>cut off") and whole[41][1] == b"<act >last</act >"
    for read in (7, 64, 1 << 20):
        monkeypatch.setattr(X, "READ", read)
        for _ in range(15):
            assert records(data, sorted(r.sample(range(1, len(data)), r.randint(0, 12)))) == whole


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("xml")
    (top / "sub").mkdir()
    for k in range(6):
        (top / ("sub" if k % 2 else ".") / f"d{k}.xml").write_text(f"<law><section><num>{k} §</num></section><subsection>text</subsection></law>")
    (top / "bad.xml").write_text("<law><open></law>")
    (top / "latin.xml").write_bytes('<?xml version="1.0" encoding="iso-8859-1"?><law>pykälä</law>'.encode("latin-1"))
    (top / "wrong.xml").write_bytes(b"<law>\xff\xfe</law>")
    (top / "empty.xml").write_bytes(b"")
    (top / "notes.txt").write_text("not read")
    return top


def test_folder(spark, folder):
    X.register(spark)
    df = spark.read.format("xml_records").option("path", str(folder)).option("part", 150).load()
    assert df.rdd.getNumPartitions() > 2
    rows = {r["path"].rpartition("/")[2]: r for r in df.collect()}
    assert len(rows) == 10 and {n for n, r in rows.items() if r["error"]} == {"bad.xml", "wrong.xml", "empty.xml"}
    assert "pykälä" in rows["latin.xml"]["xml"] and rows["bad.xml"]["error"].startswith("xml:") and rows["wrong.xml"]["error"].startswith("encoding")
    again = {r["path"].rpartition("/")[2]: (r["xml"], r["error"]) for r in X.whole_files(spark, str(folder)).collect()}
    assert again == {n: (r["xml"], r["error"]) for n, r in rows.items() if n != "empty.xml"}


def test_large_files_are_split(spark, tmp_path):
    body = "".join(f"<act id='{k}'>{'text ' * (k % 50)}</act>\n" for k in range(2000))
    (tmp_path / "all.xml").write_text(f"<acts>{body}</acts>")
    X.register(spark)
    df = spark.read.format("xml_records").option("path", str(tmp_path)).option("record", "act").option("part", 20_000).load()
    assert df.rdd.getNumPartitions() > 5
    got = [(r["start"], r["error"], ET.fromstring(r["xml"]).get("id")) for r in df.collect()]
    assert sorted(int(g[2]) for g in got) == list(range(2000)) and not any(g[1] for g in got) and len({g[0] for g in got}) == 2000


def test_repairs(spark, folder):
    X.register(spark)
    (folder / "letters.xml").write_text("<law><subsection num='1'><paragraph num='1)'><subparagraph num='a)'/><subparagraph num='b)'/></paragraph><paragraph num='c)'/><paragraph num='d'/><paragraph num='2)'/></subsection><section num='9'><subsection/><subsection num='7'/><subsection/></section></law>")
    rows = X.repaired(spark.read.format("xml_records").option("path", str(folder)).load()).cache()
    found = {(r["path"].rpartition("/")[2], r["finding"], r["detail"]) for r in X.findings(rows).filter("finding <> 'unreadable'").collect()}
    assert {("letters.xml", "rehome_orphaned_letter", "1/c"), ("letters.xml", "rehome_orphaned_letter", "1/d"), ("letters.xml", "positional_label", "9/1"), ("letters.xml", "positional_label", "9/3"), ("d4.xml", "absorb_orphaned_subsection", "4/1")} <= found
    assert len(found) == 4 + 6
    root = ET.fromstring(next(r["xml"] for r in rows.collect() if r["path"].endswith("letters.xml")))
    items = root.find("subsection").findall("paragraph")
    assert [i.get("num") for i in items] == ["1)", "2)"] and [s.get("num") for s in items[0]] == ["a)", "b)", "c)", "d"]
    assert X.findings(rows).filter("finding = 'unreadable'").count() == 3
