"""Several values packed in one field: minimum-description-length choice of a dialect per cell.

A *dialect* is a set of delimiters, read with or without quoting. Every cell is parsed under each one and each two of the
delimiters it holds, and under sets that grow from the two of the lowest constant cost by one delimiter at a time, until
all are in; a parse costs

* the code length of each of its shapes of values, ``-log2 p(shape)``, with ``p`` estimated over all cells of the
  field; a shape that the cell had before costs a constant,
* a constant for each value and each run of delimiter characters left inside one, and
* the code length of the dialect itself.

Other characters cost the same under every dialect and are left out. A split pays where the pieces look like other values
of the field and not where it tears one apart. Shape counts start from
all parses of all cells and are taken again from the cheapest ones.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstead.session import cut

#: Delimiters that a dialect may use, with the pattern that finds them.
DELIMITERS = {
    ";": r";",
    "; ": r";\s+|;\s*$|^\s*;",
    "|": r"\|",
    ",": r",",
    ", ": r",\s+|,\s*$|^\s*,",
    "tab": r"\t",
    "line": r"[\r\n]+",
    "/": r"/",
    " / ": r"\s/\s|\s/\s*$|^\s*/\s",
    "&": r"&",
    " ": r"[  ]+",
}
#: Bits of each value besides its shape, of a shape that its cell had before, of each run of possible delimiters left
#: inside a value, of a quote without its fellow.
VALUE_BITS, AGAIN_BITS, LEFT_BITS, TORN_BITS = 2.0, 1.0, 3.0, 8.0
#: Rounds after which statistics that still change are left; each takes the costs down, so all are sound.
ROUNDS = 8
_PLAIN = re.compile(r"^[\"'“”„׳״`=\s﻿‎‏]+|[\"'“”„`\s﻿‎‏]+$")
_QUOTED = re.compile(r'\s*"((?:[^"\\]|""|\\.)*)"')
_ANY = re.compile(r"[;|,/&\s\"]+")
_RUNS = re.compile(r"\d+|[^\W\d_]+")
PARSES = T.ArrayType(
    T.StructType(
        [
            T.StructField("dialect", T.StringType()),
            T.StructField("items", T.ArrayType(T.StringType())),
            T.StructField("shapes", T.ArrayType(T.StringType())),
            T.StructField("fixed", T.DoubleType()),
        ]
    )
)


def shape(value: str) -> str:
    """Runs of digits become 9 and runs of letters a; punctuation and blanks stay."""
    return _RUNS.sub(lambda m: "9" if m.group()[0].isdigit() else "a", value)


def _clean_escapes(quoted: str) -> str:
    return re.sub(r"\\(.)", r"\1", quoted.replace('""', '"')).strip()


def _clean(piece: str) -> str:
    return _PLAIN.sub("", piece)


def _cut_quoted(body: str, delimiter: re.Pattern) -> list[str] | None:
    """Pieces of ``body`` where a piece that begins with a quote runs to its closing quote; None if no piece does."""
    out, at, seen = [], 0, False
    while at < len(body):
        end = None
        if m := _QUOTED.match(body, at):
            blank = len(body[m.end() :]) - len(body[m.end() :].lstrip())
            if m.end() + blank == len(body):
                end = len(body)
            elif d := delimiter.match(body, m.end()) or delimiter.match(body, m.end() + blank):
                end = d.end()
        if end is not None:
            out.append(_clean_escapes(m.group(1)))
            seen, at = True, end
            continue
        d = delimiter.search(body, at)
        out.append(_clean(body[at : d.start()] if d else body[at:]))
        at = max(d.end(), at + 1) if d else len(body)
    return [x for x in out if x.strip()] if seen else None


def _fixed(items: list[str]) -> float:
    again = len(items) - len(set(map(shape, items)))
    return VALUE_BITS * len(items) + AGAIN_BITS * again + sum(LEFT_BITS * len(_ANY.findall(x)) + TORN_BITS * (x.count('"') % 2) for x in items)


def parses(cell: str | None) -> list[dict]:
    """All distinct parses of one cell, cheapest dialect first among equal ones; none for a null or blank cell."""
    if cell is None or not cell.strip():
        return []
    body, found, seen = cell.strip(), [], set()

    def add(dialect: str, items: list[str] | None) -> None:
        key = tuple(items or ())
        if items is not None and key not in seen:
            seen.add(key)
            found.append({"dialect": dialect, "items": items, "shapes": list(dict.fromkeys(map(shape, items))), "fixed": _fixed(items)})

    if body.startswith("[") and body.endswith("]"):
        try:
            listed = json.loads(body)
            if isinstance(listed, list):
                add("list", [str(x).strip() for x in listed if x is not None and str(x).strip()])
                return found
        except ValueError:
            body = body[1:-1].strip()
    whole = _QUOTED.fullmatch(body)
    add("one", [x for x in [_clean_escapes(whole.group(1)) if whole else _clean(body)] if x])
    there = [d for d, p in DELIMITERS.items() if re.search(p, body)]

    def parse(chosen: tuple[str, ...]) -> float:
        pattern = re.compile("|".join(DELIMITERS[d] for d in chosen))
        name = "+".join(chosen)
        if '"' in body:
            add(name + ' "', _cut_quoted(body, pattern))
        items = [x for x in (_clean(p) for p in pattern.split(body)) if x]
        add(name, items)
        return _fixed(items)

    for d in there:
        parse((d,))
    pairs = {p: parse(p) for p in itertools.combinations(there, 2)}
    grown = min(pairs, key=lambda p: (pairs[p], p)) if len(there) > 2 else tuple(there)
    while len(grown) < len(there):
        _, grown = min((parse(more), more) for d in there if d not in grown for more in [tuple(x for x in there if x in grown or x == d)])
    return found


@F.pandas_udf(PARSES)
def _parses(cells: pd.Series) -> pd.Series:
    return cells.map(parses)


def _cheapest(pool: DataFrame, counts: DataFrame, dialects: DataFrame | None) -> DataFrame:
    """Each cell's cheapest parse under the given shape counts; the totals and dialect shares are a few rows a field."""
    totals = counts.groupBy("field_name").agg(F.sum("n").alias("total"))
    wanted = pool.select("field_name", "cell_no", "parse_no", F.explode("shapes").alias("shape"))
    pieces = wanted.join(counts, ["field_name", "shape"], "left").join(F.broadcast(totals), "field_name")
    value_bits = -F.log2((F.coalesce("n", F.lit(0.0)) + 0.1) / (F.col("total") + 1.0))
    bits = pieces.groupBy("field_name", "cell_no", "parse_no").agg(F.sum(value_bits).alias("shape_bits"))
    scored = pool.select("field_name", "cell_no", "parse_no", "dialect", "fixed").join(bits, ["field_name", "cell_no", "parse_no"], "left")
    if dialects is None:
        dialect_bits = F.size(F.split("dialect", r"\+")) * 4.0
    else:
        scored = scored.join(F.broadcast(dialects), ["field_name", "dialect"], "left")
        dialect_bits = -F.log2(F.coalesce("share", F.lit(1e-5)))
    cost = F.coalesce("shape_bits", F.lit(0.0)) + F.col("fixed") + dialect_bits
    best = scored.groupBy("field_name", "cell_no").agg(F.min_by("parse_no", F.struct(F.round(cost, 6), "parse_no")).alias("parse_no"))
    return pool.join(best, ["field_name", "cell_no", "parse_no"])


def unpack(cells: DataFrame, key: str, cell: str, field_name: Column | str) -> DataFrame:
    """``(field_name, row_key, pos, item_value)``, one row per value of each cell.

    ``field_name`` names the field a cell belongs to; shape statistics are kept per field, and are taken again until the
    dialects chosen stay as they are. A null or blank cell, or one of delimiters only, gives no row; a single value comes
    out at position 1. A row repeated under one key counts once (of different cells under one key the largest by bytes
    stays); a null key is a key of its own. Positions count non-empty values from 1. Cells of any length are parsed
    whole, equal ones once. Other columns of ``cells`` play no part."""
    spark = cells.sparkSession
    field = F.lit(field_name) if isinstance(field_name, str) else field_name
    keyed = cut(
        cells.select(field.alias("field_name"), F.col(key).cast("bigint").alias("row_key"), F.col(cell).cast("string").alias("cell"))
        .groupBy("field_name", "row_key")
        .agg(F.max("cell").alias("cell"))
        .where(F.length(F.trim("cell")) > 0)
        .withColumn("digest", F.md5("cell"))
    )
    once = keyed.groupBy("field_name", "digest").agg(F.count("*").alias("uses"), F.first("cell").alias("cell"))
    # a set number of partitions is not folded into few, so that parsing has all cores
    spread = once.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "digest")
    pool = cut(spread.select("field_name", F.col("digest").alias("cell_no"), "uses", _parses("cell").alias("parses")).select("field_name", "cell_no", "uses", F.posexplode("parses").alias("parse_no", "parse")).select("field_name", "cell_no", "uses", "parse_no", "parse.*"))

    def shapes(parsed: DataFrame) -> DataFrame:
        return parsed.select("field_name", "uses", F.explode("shapes").alias("shape")).groupBy("field_name", "shape").agg(F.sum("uses").cast("double").alias("n"))

    chosen, before = cut(_cheapest(pool, shapes(pool), None)), None
    while True:
        used = chosen.groupBy("field_name", "dialect").agg(F.sum("uses").alias("c"))
        state = chosen.agg(F.count("*"), F.sum(F.xxhash64("cell_no", "parse_no").cast("decimal(38,0)"))).first()
        if before is not None and state in before or len(before or ()) == ROUNDS:
            break
        before = [*(before or []), state]
        dialects = used.join(F.broadcast(used.groupBy("field_name").agg(F.sum("c").alias("t"))), "field_name").select("field_name", "dialect", (F.col("c") / F.col("t")).alias("share"))
        chosen = cut(_cheapest(pool, shapes(chosen), dialects))
    values = chosen.select("field_name", F.col("cell_no").alias("digest"), "items").join(keyed.drop("cell"), ["field_name", "digest"])
    return values.select("field_name", "row_key", F.posexplode("items").alias("pos", "item_value")).withColumn("pos", (F.col("pos") + 1).cast("int"))


def whole_number(value: Column) -> Column:
    """A spreadsheet's rendering of a number as its whole number in digits (``046049.0`` -> ``46049``); others as they are."""
    return F.when(value.rlike(r"^\s*0*\d+(\.0*)?\s*$"), F.regexp_extract(value, r"^\s*0*(\d+)", 1)).otherwise(value)
