"""File sources and sinks on small files made here."""

import json
import struct

from pyspark.sql import functions as F

from corvane.sources import files as S


def test_documents_and_logs(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.json").write_text(json.dumps({"label": "a", "functions": [{"va": "0x1"}, {"va": "0x2"}, {"va": "0x3"}]}))
    got = S.calltree_documents(spark, str(tmp_path / "d"), "label string, functions array<struct<va: string>>", cap=2).collect()
    assert [(r["label"], r["pos"], r["va"]) for r in got] == [("a", 0, "0x1"), ("a", 1, "0x2")]
    (tmp_path / "log.jsonl").write_text('{"event": "x", "n": 1}\n\nbroken\n{"event": "y", "n": 2}\n')
    assert [r["n"] for r in S.json_lines(spark, str(tmp_path / "log.jsonl"), "event string, n int", "y").collect()] == [2]
    S.append_json_lines(spark.range(2), str(tmp_path / "out"))
    S.append_json_lines(spark.range(2), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 4


def test_versions(spark, tmp_path):
    S.swap(spark.range(3), str(tmp_path), "t")
    S.swap(spark.range(5), str(tmp_path), "t")
    assert S.current(spark, str(tmp_path), "t").count() == 5
    old, new = spark.createDataFrame([("a", 1)], "k string, v int"), spark.createDataFrame([("a", 2), ("b", 3)], "k string, v int")
    assert sorted(map(tuple, S.saved_incrementally(old, new, "k").collect())) == [("a", 1), ("b", 3)]
    assert sorted(map(tuple, S.saved_incrementally(old, new, "k", replace=True).collect())) == [("a", 2), ("b", 3)]


def test_pe(spark, tmp_path):
    data = bytearray(1024)
    struct.pack_into("<I", data, 0x3C, 0x80)
    data[0x80:0x84] = b"PE\0\0"
    struct.pack_into("<HH", data, 0x84, 0x8664, 1)
    struct.pack_into("<H", data, 0x94, 240)
    struct.pack_into("<H", data, 0x98, 0x20B)
    struct.pack_into("<Q", data, 0x98 + 24, 0x140000000)
    struct.pack_into("<8sIIIIIIHHI", data, 0x98 + 240, b".data\0\0\0", 0x100, 0x1000, 0x200, 0x400, 0, 0, 0, 0, 0xC0000040)
    (tmp_path / "x.exe").write_bytes(bytes(data))
    (tmp_path / "y.exe").write_bytes(b"MZ")
    sections = S.pe_sections(spark, str(tmp_path)).cache()
    r = sections.collect()
    assert len(r) == 1 and (r[0]["name"], r[0]["base"], r[0]["rva"]) == (".data", 0x140000000, 0x1000)
    assert S.writable(sections).count() == 1
    a = spark.createDataFrame([(r[0]["path"], 0x140001010), (r[0]["path"], 0x140009000)], "path string, va bigint")
    assert {(x["va"], x["name"], x["offset"]) for x in S.section_of(a, sections).collect()} == {(0x140001010, ".data", 0x410), (0x140009000, None, None)}
    assert spark.range(1).select(S.architecture(F.lit("pe"), F.lit(0xAA64)), S.architecture(F.lit("pe"), F.lit(1))).first()[:] == ("aarch64", "x86_64")


def test_archive(spark, tmp_path):
    entry = lambda n, b: f"{n:<16}{0:<12}{0:<6}{0:<6}{644:<8}{len(b):<10}`\n".encode() + b + (b"\n" if len(b) % 2 else b"")
    (tmp_path / "l.a").write_bytes(b"!<arch>\n" + entry("/", b"xx") + entry("//", b"a_very_long_member_name.o/\n") + entry("s.o/", b"abc") + entry("/0", b"defg"))
    (tmp_path / "z.a").write_bytes(b"none")
    got = {(r["member"], bytes(r["content"])) for r in S.archive_members(spark, str(tmp_path)).collect()}
    assert got == {("s.o", b"abc"), ("a_very_long_member_name.o", b"defg")}


def test_symbols_and_pointers(spark):
    s = spark.createDataFrame([("p", "a", 100, 0), ("p", "b", 120, 50), ("p", "c", 200, 0), ("p", "d", 150, 2)], "path string, name string, va bigint, raw_size bigint")
    assert {(r["name"], r["size"]) for r in S.sized_symbols(s).collect()} == {("a", 20), ("b", 50), ("c", 64)}
    blob = b"".join(struct.pack("<Q", x) for x in (0x1000, 0x1008, 0, 0x1010)).hex()
    fns = spark.createDataFrame([(0x1000, "f")], "va bigint, name string")
    got = S.pointer_tables(spark.createDataFrame([(1, blob), (2, "")], "key int, hex string"), fns, 0x1000, 0x2000)
    assert {(r["slot"], r["target"], r["kind"]) for r in got.collect()} == {(0, 0x1000, "function"), (1, 0x1008, "data")}


def test_dictionaries_catalogs_reports(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "net.json").write_text(json.dumps({"call_args": {"socket": {"0": {"2": "AF_INET"}}}, "sentinels": {"socket": {"0xff": "INVALID_SOCKET"}}}))
    (tmp_path / "d" / "bad.json").write_text("{")
    c = S.constant_dictionaries(spark, str(tmp_path / "d"))
    assert {tuple(r) for r in c.collect()} == {("net", "call_args", "socket", "0", "2", "AF_INET"), ("net", "sentinels", "socket", None, "0xff", "INVALID_SOCKET")}
    assert S.looked_up(c, "255").first()["label"] == "INVALID_SOCKET" and S.looked_up(c, "inet").first()["value"] == "2"
    (tmp_path / "c.xml").write_text("<r><w id='7'><n>One. Two.</n></w><w id='8'><n>Three</n></w></r>")
    x = S.xml_catalog(spark, str(tmp_path / "c.xml"), "w", "_id int, n string").select("_id", S.first_sentence(F.col("n")).alias("s"))
    assert {tuple(r) for r in x.collect()} == {(7, "One."), (8, "Three")}
    text = S.brief({"Rows": spark.range(3)}, "T", rows=2)
    assert "# T" in text and "More than 2 rows" in text
    assert {r["label"] for r in S.targets(spark, str(tmp_path / "d"), {"net": "network"}).collect()} == {"network", "bad"}
