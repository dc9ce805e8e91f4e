"""File sources and sinks: JSON documents, logs, images, archives, catalogs, dictionaries and reports."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.exprs import ladder

CAP = 5000


def calltree_documents(spark: SparkSession, path: str, schema: T.StructType | str, cap: int = CAP) -> DataFrame:
    """Functions of whole-document JSON dumps: program header columns, ``pos`` and the function's columns.

    ``cap`` is the reader's limit of functions per document, in document order; None reads all.
    """
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    head = [c for c in raw.columns if c != "functions"]
    rows = raw.select(*head, F.posexplode("functions").alias("pos", "f"))
    rows = rows if cap is None else rows.filter(F.col("pos") < cap)
    return rows.select(*head, "pos", "f.*")


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str, event: str | None = None) -> DataFrame:
    """Rows of a JSONL log; blank and broken lines are dropped, and rows of another ``event``."""
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return df if event is None else df.filter(F.col("event") == event)


def append_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def swap(df: DataFrame, folder: str, name: str) -> str:
    """Write a new version beside the old ones and point to it last, so readers never see half a table.

    Returns the version's path; ``current`` reads the pointer.
    """
    import uuid

    spark = df.sparkSession
    version = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(version)
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    at, temp = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.pointer"), jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.pointer.tmp")
    fs = at.getFileSystem(conf)
    out = fs.create(temp, True)
    out.writeBytes(version)
    out.close()
    # one step: readers find the old pointer or the new one
    hadoop = jvm.org.apache.hadoop.fs
    how = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    how[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    at, temp = fs.makeQualified(at), fs.makeQualified(temp)
    hadoop.FileContext.getFileContext(at.toUri(), conf).rename(temp, at, how)
    return version


def current(spark: SparkSession, folder: str, name: str) -> DataFrame:
    path = spark.read.text(f"{folder}/{name}.pointer").first()[0]
    return spark.read.parquet(path)


def saved_incrementally(old: DataFrame, new: DataFrame, key: str, replace: bool = False) -> DataFrame:
    """``old`` and the results of ``new`` with a new key; with ``replace`` those of ``new`` stand instead."""
    if replace:
        return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))
    return old.unionByName(new.join(old.select(key).distinct(), key, "left_anti").select(*old.columns))


# Architecture names of the machine numbers of image headers.
MACHINES = {"pe": {0x8664: "x86_64", 0x14C: "x86", 0xAA64: "aarch64", 0x1C0: "arm"}, "elf": {62: "x86_64", 3: "x86", 183: "aarch64", 40: "arm", 243: "riscv"}}


def architecture(kind: Column, machine: Column) -> Column:
    """Name of a machine number; x86_64 where it is unknown."""
    flat = [x for k, m in MACHINES.items() for n, a in m.items() for x in (F.lit(f"{k}:{n}"), F.lit(a))]
    return F.coalesce(F.try_element_at(F.create_map(*flat), F.concat_ws(":", kind, machine.cast("string"))), F.lit("x86_64"))


def _pe(data: bytes) -> Iterator[tuple]:
    at = struct.unpack_from("<I", data, 0x3C)[0]
    if data[at : at + 4] != b"PE\0\0":
        return
    machine, n = struct.unpack_from("<HH", data, at + 4)
    extra = struct.unpack_from("<H", data, at + 20)[0]
    wide = struct.unpack_from("<H", data, at + 24)[0] == 0x20B
    base = struct.unpack_from("<Q" if wide else "<I", data, at + 24 + (24 if wide else 28))[0]
    for i in range(n):
        name, vsize, rva, rsize, raw, _, _, _, _, flags = struct.unpack_from("<8sIIIIIIHHI", data, at + 24 + extra + 40 * i)
        yield machine, base, name.rstrip(b"\0").decode("latin-1"), rva, vsize, raw, rsize, flags


def pe_sections(spark: SparkSession, path: str) -> DataFrame:
    """(path, machine, base, name, rva, vsize, raw, raw_size, flags) of the sections of PE images; other files give none."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for p, d in zip(f["path"], f["content"], strict=True):
                try:
                    rows += [(p, *s) for s in _pe(bytes(d))]
                except struct.error:
                    continue
            yield pd.DataFrame(rows, columns=["path", "machine", "base", "name", "rva", "vsize", "raw", "raw_size", "flags"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(read, "path string, machine int, base bigint, name string, rva bigint, vsize bigint, raw bigint, raw_size bigint, flags bigint")


def section_of(addresses: DataFrame, sections: DataFrame) -> DataFrame:
    """``addresses`` (path, va) with the section that holds each: name and file offset, null if none.

    Sections are joined by image and then by range; an image has few of them.
    """
    s = sections.select("path", "base", "name", "rva", "vsize", "raw", "raw_size")
    inside = (F.col("va") - F.col("base") >= F.col("rva")) & (F.col("va") - F.col("base") < F.col("rva") + F.greatest("vsize", "raw_size"))
    hit = addresses.join(s, "path").filter(inside).select("path", "va", "name", (F.col("va") - F.col("base") - F.col("rva") + F.col("raw")).alias("offset"))
    return addresses.join(hit, ["path", "va"], "left")


def writable(sections: DataFrame) -> DataFrame:
    return sections.filter(F.col("flags").bitwiseAND(F.lit(0x80000000)) != 0)


def _elf(data: bytes) -> Iterator[tuple]:
    if data[:4] != b"\x7fELF" or data[4] != 2:
        return
    shoff = struct.unpack_from("<Q", data, 40)[0]
    size, n = struct.unpack_from("<HH", data, 58)
    heads = [struct.unpack_from("<IIQQQQIIQQ", data, shoff + size * i) for i in range(n)]
    for kind in (2, 11):  # the full symbol table, else the dynamic one
        found = False
        for h in heads:
            if h[1] != kind:
                continue
            strings = heads[h[6]][4]
            for at in range(h[4], h[4] + h[5], 24):
                name, info, _, section, value, length = struct.unpack_from("<IBBHQQ", data, at)
                if info & 15 == 2 and section and value:
                    end = data.index(b"\0", strings + name)
                    found = True
                    yield data[strings + name : end].decode("latin-1"), value, length
        if found:
            return


def elf_symbols(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, va, raw_size) of the defined functions of 64-bit ELF files; other files give none."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for p, d in zip(f["path"], f["content"], strict=True):
                try:
                    rows += [(p, *s) for s in _elf(bytes(d))]
                except (struct.error, IndexError, ValueError):
                    continue
            yield pd.DataFrame(rows, columns=["path", "name", "va", "raw_size"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(read, "path string, name string, va bigint, raw_size bigint")


def sized_symbols(symbols: DataFrame, low: int = 4, high: int = 8000, last: int = 64) -> DataFrame:
    """Symbols with ``size``: the next address less the own where none is given, 64 for the last; kept from 4 to 8000 bytes."""
    nxt = F.lead("va").over(Window.partitionBy("path").orderBy("va", "name"))
    size = F.when(F.col("raw_size") > 0, F.col("raw_size")).otherwise(F.coalesce(nxt - F.col("va"), F.lit(last)))
    return symbols.withColumn("size", size).filter(F.col("size").between(low, high))


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """(path, member, size, content) of ar archives: 60-byte heads, entries padded to even length, long names resolved."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, d in zip(f["path"], f["content"], strict=True):
                data, rows, names, at = bytes(d), [], b"", 8
                while data[:8] == b"!<arch>\n" and at + 60 <= len(data):
                    head = data[at : at + 60]
                    size = int(head[48:58].strip() or b"0")
                    name, body = head[:16].decode("latin-1").strip(), data[at + 60 : at + 60 + size]
                    if name == "//":
                        names = body
                    elif name not in ("/", "/SYM64/"):
                        if name[:1] == "/" and name[1:].isdigit():
                            name = names[int(name[1:]) :].split(b"\n")[0].decode("latin-1")
                        rows.append((p, name.rstrip("/"), size, body))
                    at += 60 + size + size % 2
                yield pd.DataFrame(rows, columns=["path", "member", "size", "content"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(read, "path string, member string, size bigint, content binary")


def targets(spark: SparkSession, path: str, names: dict[str, str] | None = None) -> DataFrame:
    """(path, label) of the files of a folder; the label is the file's name without ending, or given in ``names``."""
    files = spark.read.format("binaryFile").load(path).select("path")
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    if not names:
        return files.select("path", stem.alias("label"))
    given = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return files.select("path", F.coalesce(F.try_element_at(given, stem), stem).alias("label"))


def xml_catalog(spark: SparkSession, path: str, row: str, schema: T.StructType | str) -> DataFrame:
    """Rows of an XML catalog."""
    return spark.read.format("xml").option("rowTag", row).schema(schema).load(path)


def first_sentence(text: Column) -> Column:
    return F.trim(F.regexp_extract(F.regexp_replace(text, r"\s+", " "), r"^(.*?[.!?])(?: |$)|^(.*)$", 0))


def constant_dictionaries(spark: SparkSession, path: str) -> DataFrame:
    """(family, kind, func, arg, value, label) of a folder of JSON dictionaries; files that can't be read give none.

    Maps under ``call_args`` (function, argument, value), ``comparisons`` and
    ``sentinels`` (function, value) become rows; file names give the family.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for p, d in zip(f["path"], f["content"], strict=True):
                try:
                    doc = json.loads(bytes(d))
                except ValueError:
                    continue
                family = p.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                for kind in ("call_args", "comparisons", "sentinels"):
                    for func, inner in (doc.get(kind) or {}).items():
                        for k, v in inner.items():
                            if isinstance(v, dict):
                                rows += [(family, kind, func, k, x, str(y)) for x, y in v.items()]
                            else:
                                rows.append((family, kind, func, None, k, str(v)))
            yield pd.DataFrame(rows, columns=["family", "kind", "func", "arg", "value", "label"]).astype(object)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(read, "family string, kind string, func string, arg string, value string, label string")


def looked_up(constants: DataFrame, by: str) -> DataFrame:
    """Dictionary rows for a number (by value) or else for a name (by part of the label), without repeats."""
    from ..operators.textfeat import integer_literal

    try:
        number = int(by, 0)
    except ValueError:
        return constants.filter(F.lower("label").contains(by.lower())).dropDuplicates(["family", "value", "label"])
    return constants.filter(integer_literal(F.col("value")) == number).dropDuplicates(["family", "label", "func"])


def pointer_tables(blobs: DataFrame, functions: DataFrame, low: int, high: int) -> DataFrame:
    """(key, slot, target, kind, name): 8-byte little-endian pointers of hexadecimal text, up to the first that is zero or outside."""
    n = F.floor(F.length("hex") / 16).cast("int")
    at = lambda i: F.conv(F.array_join(F.transform(F.sequence(F.lit(7), F.lit(0), F.lit(-1)), lambda b: F.substring(F.col("hex"), i * 16 + b * 2 + 1, F.lit(2))), ""), 16, -10).cast("bigint")
    slots = blobs.filter(n > 0).select("key", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), at)).alias("slot", "target"))
    w = Window.partitionBy("key").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    good = F.col("target").between(low, high - 1) & (F.col("target") != 0)
    kept = slots.withColumn("_bad", F.max((~good).cast("int")).over(w)).filter("_bad = 0").drop("_bad")
    out = kept.join(functions.select(F.col("va").alias("target"), "name"), "target", "left")
    return out.select("key", "slot", "target", ladder((F.col("name").isNotNull(), "function"), otherwise="data").alias("kind"), "name")


def brief(sections: dict[str, DataFrame], title: str, rows: int = 20) -> str:
    """A Markdown report: the first rows of small tables; a report shows a limited number by design."""
    out = [f"# {title}"]
    for name, df in sections.items():
        found = df.limit(rows + 1).collect()
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in found[:rows]]
        if len(found) > rows:
            out.append(f"\nMore than {rows} rows; the first are shown.")
    return "\n".join(out) + "\n"
