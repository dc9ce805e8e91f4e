"""Notes written into decompiled text, and readings of its signatures and of answers about it.

Dictionaries are given as DataFrames or small literal maps; a text that has the note
already keeps it as it is.  Null texts stay null.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def argument_count(text: Column) -> Column:
    """Arguments of the first line that has a parenthesis: commas outside inner parentheses and one more; 0 for none or void, 1 without such a line."""
    line = F.get(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^[^)]*\(.*\)")), F.lit(0))
    inner = F.regexp_extract(line, r"^[^(]*\((.*)\)", 1)
    start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("n"))
    step = lambda s, c: F.struct((s["d"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)).alias("d"), (s["n"] + F.when((c == ",") & (s["d"] == 0), 1).otherwise(0)).alias("n"))
    commas = F.aggregate(F.split(inner, ""), start, step, lambda s: s["n"])
    return F.when(text.isNull(), None).when(line.isNull(), 1).when(F.lower(F.trim(inner)).isin("", "void"), 0).otherwise(commas + 1)


def field_notes(text: Column, fields: dict[int, str]) -> Column:
    """``text`` with the names of fields behind ``+ 0x..`` where the offset ends an argument or a parenthesis."""
    out = text
    for offset, name in sorted(fields.items()):
        out = F.regexp_replace(out, rf"(?i)(\+\s*)(0x{offset:x})(?!\s*/\*)(?=\s*[\),])", f"$1$2 /* ->{name} */")
    return out


def comparison_notes(text: Column, names: dict[int, str]) -> Column:
    """``text`` with the names of constants behind those that something is compared with."""
    out = text
    for value, name in sorted(names.items()):
        out = F.regexp_replace(out, rf"([!=]=\s*)((?:0[xX]0*(?i:{value:x})|0*{value}))\b(?! ?/\*)", f"$1$2 /* {name} */")
    return out


def sentinel_notes(text: Column, names: dict[str, str]) -> Column:
    """``text`` with the names of constants that mean one thing wherever they stand."""
    out = text
    for spelling, name in sorted(names.items()):
        out = F.regexp_replace(out, rf"(?i)\b{spelling}\b(?!\s*/\*)", f"{spelling} /* {name} */")
    return out


def call_arguments(functions: DataFrame, key: str, text: str, names: list[str]) -> DataFrame:
    """(key, callee, call, position, argument, value): the arguments of calls of the named functions, with their integer values.

    Arguments are split at commas outside parentheses; a call that never closes ends with
    the text.  Whole texts; one pass in Arrow batches.
    """
    kind = dict(functions.dtypes)[key]
    wanted = frozenset(names)

    def arguments(body: str, start: int) -> list[str]:
        depth, parts, begin = 1, [], start
        for i in range(start, len(body)):
            c = body[i]
            depth += (c == "(") - (c == ")")
            if depth == 0 or (c == "," and depth == 1):
                parts.append(body[begin:i].strip())
                begin = i + 1
            if depth == 0:
                break
        else:
            parts.append(body[begin:].strip())
        return [] if parts == [""] else parts

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        call = re.compile(r"\b([A-Za-z_]\w*)\s*\(")
        for batch in batches:
            rows = []
            for k, body in zip(batch[key], batch[text], strict=True):
                found = (m for m in call.finditer(body or "") if m[1] in wanted)
                for n, m in enumerate(found):
                    for i, a in enumerate(arguments(body, m.end())):
                        number = re.fullmatch(r"(-?)(0[xX][0-9a-fA-F]{1,15}|\d{1,18})[uUlL]*", a)
                        rows.append((k, m[1], n, i, a, int(number[1] + number[2], 0 if number[2][:2].lower() == "0x" else 10) if number else None))
            yield pd.DataFrame(rows, columns=["key", "callee", "call", "position", "argument", "value"]).astype({"value": "Int64"})

    return functions.select(F.col(key).alias(key), text).mapInPandas(parse, f"key {kind}, callee string, call int, position int, argument string, value bigint").withColumnRenamed("key", key)


def named_arguments(arguments: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``arguments`` with the name that the dictionary (callee, position, value, name) has for them; the least of several."""
    d = dictionary.groupBy("callee", "position", "value").agg(F.min("name").alias("name"))
    return arguments.join(d, ["callee", "position", "value"])


def named_constants(constants: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``constants`` (.., v) with each distinct name that the dictionary (value, name) has for the value."""
    d = dictionary.select(F.col("value").alias("v"), "name").dropna().distinct()
    return constants.join(d, "v")


def stable_hash(text: Column) -> Column:
    """The first eight digits of the MD5 as a number."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def execution_confidence(silent: Column, unimplemented: Column, floats: Column, calls: Column) -> Column:
    """LOW with guesses or unknown operations, MEDIUM with stubs only, else HIGH; null lists are empty."""
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    return F.when(some(silent) | some(unimplemented), "LOW").when(some(floats) | some(calls), "MEDIUM").otherwise("HIGH")


def decoded(data: Column, least: int = 4) -> Column:
    """Bytes as text: UTF-16 little-endian if that is printable, else UTF-8, else Latin-1; null below ``least`` characters."""
    wide = F.when(F.length(data) % 2 == 0, F.decode(data, "UTF-16LE"))
    utf8 = F.when(F.is_valid_utf8(data.cast("string")), F.decode(data, "UTF-8")) if hasattr(F, "is_valid_utf8") else F.decode(data, "UTF-8")
    ok = lambda t: F.when(t.rlike(rf"^[\x20-\x7E\t\r\n]{{{least},}}$"), t)
    return F.coalesce(ok(wide), ok(utf8), ok(F.decode(data, "ISO-8859-1")))


_ITEM = "struct<va:string,name:string,understanding:string,tier_analyzed:int,is_error_path:boolean,is_runtime:boolean,opaque_callees:array<string>>"


def answer_items(answers: DataFrame, text: str, tier: int) -> DataFrame:
    """The items (.., va, name, understanding, tier_analyzed, is_error_path, is_runtime, opaque_callees) of answers in JSON.

    Fences are stripped; the items are a list, a lone object, or the list ``functions`` of
    an object.  Understanding lies within 0 and 1, by default a half; items without an
    address and texts that are no JSON of these shapes give nothing.
    """
    t = F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.col(text)), r"(?m)^```[a-z]*\n?", ""), r"```\s*$", ""))
    items = F.from_json(t, f"array<{_ITEM}>")
    inner = F.from_json(F.get_json_object(t, "$.functions"), f"array<{_ITEM}>")
    lone = F.array(F.from_json(t, _ITEM))
    shape = F.when(t.startswith("["), items).when(F.get_json_object(t, "$.functions").isNotNull(), inner).when(t.startswith("{"), lone)
    rest = [c for c in answers.columns if c != text]
    e = answers.select(*rest, F.explode(shape).alias("i")).filter("i.va is not null")
    score = F.expr("try_cast(i.understanding as double)")
    return e.select(
        *rest, "i.va", "i.name", F.when(score.isNull() | F.isnan(score), 0.5).otherwise(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))).alias("understanding"), F.lit(tier).alias("tier_analyzed"),
        F.coalesce("i.is_error_path", F.lit(False)).alias("is_error_path"), F.coalesce("i.is_runtime", F.lit(False)).alias("is_runtime"), F.coalesce("i.opaque_callees", F.array().cast("array<string>")).alias("opaque_callees"),
    )
