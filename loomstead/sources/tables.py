"""Delimited and JSON tables in and out."""

from __future__ import annotations

import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hints that name a column's field, tried in this order.
HINTS = {"name": ["name", "שם", "title"], "lat": ["lat"], "lon": ["lon", "lng"], "wikidata": ["wikidata", "qid"], "kima": ["kima"], "id": ["xml_id", "id"]}


def sniff(line: str) -> str:
    """Tab where the first line has more tabs than commas, else comma."""
    return "\t" if line.count("\t") > line.count(",") else ","


def read_delimited(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """All columns as text, the byte-order mark off the first name; rows that don't fit are kept with nulls.

    Files that are no UTF-8 are read as Latin-1; one line that is no valid UTF-8 tells."""
    broken = spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1).collect()
    if sep is None:
        first = spark.read.text(path).limit(1).collect()
        sep = sniff(first[0][0]) if first else ","
    df = spark.read.csv(path, sep=sep, header=True, inferSchema=False, quote='"', escape='"', mode="PERMISSIVE", multiLine=True, encoding="ISO-8859-1" if broken else "UTF-8")
    return df.toDF(*[c.lstrip("\ufeff") for c in df.columns])


def append_log(df: DataFrame, path: str) -> None:
    """Rows added to a folder of JSON lines."""
    df.write.mode("append").json(path)


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of a spreadsheet file, all columns as text: the first row names them (``col_i`` where it is empty),
    empty cells are empty texts. The file is opened on the driver, as such files are small by nature."""
    columns, rows = workbook_rows(path)
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns)) if columns else spark.createDataFrame([], "col_0 string")


def workbook_rows(path: str) -> tuple[list[str], list[tuple]]:
    main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(path) as z:
        names = z.namelist()
        shared = ["".join(t.text or "" for t in s.iter(f"{main}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{main}si")] if "xl/sharedStrings.xml" in names else []
        sheet = min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        table = []
        for row in ElementTree.fromstring(z.read(sheet)).iter(f"{main}row"):
            cells: dict[int, str] = {}
            for c in row.iter(f"{main}c"):
                letters, at = re.match(r"[A-Z]*", c.get("r") or "").group(), 0
                for x in letters:
                    at = at * 26 + ord(x) - 64
                value = "".join(t.text or "" for t in c.iter() if t.tag in (f"{main}v", f"{main}t"))
                cells[at - 1 if letters else len(cells)] = shared[int(value)] if c.get("t") == "s" and value else value
            table.append(cells)
    if not table:
        return [], []
    width = max(max(r, default=-1) for r in table) + 1
    columns = [table[0].get(i) or f"col_{i}" for i in range(width)]
    return columns, [tuple(r.get(i, "") for i in range(width)) for r in table[1:]]


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def guess_mapping(columns: list[str]) -> dict[str, str]:
    """The first column that holds a field's hint, without case."""
    out: dict[str, str] = {}
    for field, hints in HINTS.items():
        for hint in hints:
            hit = next((c for c in columns if hint in c.lower() and c not in out.values()), None)
            if hit:
                out[field] = hit
                break
    return out


def typed_places(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Mapped columns with tolerant casts, the first of several values, and all others in ``extra``."""
    def field(name: str) -> Column:
        return F.nullif(F.trim(F.split(F.col(mapping[name]), r"\|")[0]), F.lit("")) if name in mapping else F.lit(None).cast("string")

    rest = [c for c in df.columns if c not in mapping.values()]
    pairs = F.create_map(*[x for c in rest for x in (F.lit(c), F.col(c))]) if rest else F.create_map().cast("map<string,string>")
    return df.select(field("id").alias("xml_id"), F.filter(F.transform(F.split(F.col(mapping["name"]), r"\|"), lambda x: F.trim(x)), lambda x: x != "").alias("names") if "name" in mapping else F.array().cast("array<string>").alias("names"), field("lat").try_cast("double").alias("lat"), field("lon").try_cast("double").alias("lon"), field("wikidata").alias("wikidata"), field("kima").alias("kima"), F.map_filter(pairs, lambda k, v: F.trim(v) != "").alias("extra"))


def write_delimited(df: DataFrame, path: str, sep: str = "\t", quote_all: bool = False) -> None:
    """Nested columns as JSON, arrays of text joined by `` | ``."""
    flat = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        flat.append(F.array_join(f.name, " | ").alias(f.name) if kind == "array<string>" else F.to_json(f.name).alias(f.name) if kind.startswith(("array", "map", "struct")) else F.col(f.name))
    df.select(*flat).write.csv(path, sep=sep, header=True, quoteAll=quote_all, escape='"', mode="overwrite")


def _rename(spark: SparkSession, path: str, to: str | None) -> bool:
    """Moves a folder, or deletes it; false where there is none."""
    jvm = spark.sparkContext._jvm
    source = jvm.org.apache.hadoop.fs.Path(path)
    fs = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(source):
        return False
    return fs.rename(source, jvm.org.apache.hadoop.fs.Path(to)) if to else fs.delete(source, True)


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """A table that ``upsert_table`` keeps, None where there is none; one left half exchanged by a crash is restored."""
    try:
        return spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    return spark.read.parquet(path) if _rename(spark, f"{path}.before", path) else None


def upsert_table(spark: SparkSession, path: str, new: DataFrame, keys: list[str], latest: str | None = None) -> None:
    """Exchange a parquet table for one where rows of ``new`` win, or where ``latest`` is given the later row of a key.

    The new table is written beside the old one and then takes its place, so a crash loses neither."""
    from loomstead.operators.sets import first_by_rank, upsert

    old = read_table(spark, path)
    if old is None:
        both = new
    elif latest is None:
        both = upsert(old, new, keys)
    else:
        both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
        both = first_by_rank(both, keys, F.col(latest).desc_nulls_last(), F.col("_new").desc()).drop("_new")
    _rename(spark, f"{path}.next", None)
    both.write.parquet(f"{path}.next")
    _rename(spark, f"{path}.before", None)
    _rename(spark, path, f"{path}.before")
    _rename(spark, f"{path}.next", path)
    _rename(spark, f"{path}.before", None)


def matching_db(places: DataFrame, persons: DataFrame) -> DataFrame:
    """One JSON document a section and row, ready for a JSON sink; sections are never gathered on one task."""
    def section(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.lit(name).alias("section"), F.to_json(F.struct(*df.columns)).alias("entity"))

    return section(places, "places").unionByName(section(persons, "persons"))


