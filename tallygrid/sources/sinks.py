"""Sinks: predictions, reports, summaries, export sheets. Writes go through Spark's committers, so a lost executor leaves no partial output."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.session import spread

ITEM_COLUMNS = ("description", "trade", "quantity", "unit", "confidence", "source_reference")


def nested(items: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """One row a project: trade scope, used files, line items in order."""
    row = F.struct("seq", F.struct(*ITEM_COLUMNS).alias("item"))
    return items.groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("trade") != "", F.col("trade")))), " | ").alias("trade_scope"),
        F.array_sort(F.collect_set("source_reference")).alias("input_files_used"),
        F.transform(F.array_sort(F.collect_list(row)), lambda x: x["item"]).alias("line_items"),
    )


def write_predictions(items: DataFrame, path: str, version: str = "v1", fmt: str = "json") -> None:
    """Predictions by project and version; only the projects at hand are replaced."""
    out = nested(items).withColumn("version", F.lit(version)).withColumn("project", F.col("project_id"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project", "version").format(fmt).save(path)


def write_reports(reports: DataFrame, path: str) -> None:
    reports.write.mode("overwrite").json(path)


def summary(items: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """Items in all and by trade."""
    by = items.groupBy(*keys, "trade").agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy(*keys).agg(F.sum("n").alias("total_items"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("trade", "n")))).alias("by_trade"))


def sheets(items: DataFrame, missing: DataFrame, extra: DataFrame) -> dict[str, DataFrame]:
    """The tables of an export: Summary, Line Items (numbered from 1 by project), Missing, Extra."""
    from pyspark.sql import Window

    numbered = items.withColumn("#", F.row_number().over(Window.partitionBy("project_id").orderBy("seq")))
    return {"Summary": summary(items), "Line Items": numbered.select("project_id", "#", *ITEM_COLUMNS), "Missing": missing, "Extra": extra}


def cover(items: DataFrame, most: int = 50, width: int = 80) -> DataFrame:
    """The first items of each project, their text cut: what a marked-up document has on its cover."""
    from pyspark.sql import Window

    w = Window.partitionBy("project_id").orderBy("seq")
    return items.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("project_id", "n", F.substring("description", 1, width).alias("description"))


def largest_file(found: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """The largest file of each project, the first path of equals."""
    best = F.max(F.struct("size_mb", F.struct(F.lit(0).alias("z")).alias("_")))["size_mb"]
    top = found.groupBy(*keys).agg(best.alias("size_mb"))
    return found.join(top, [*keys, "size_mb"]).groupBy(*keys, "size_mb").agg(F.min("path").alias("path"))


def write_intermediate(items: DataFrame, path: str) -> None:
    """Items by project and file while a run goes on; a file that is written again replaces what it had."""
    out = items.withColumn("project", F.col("project_id")).withColumn("file", F.col("source_reference"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project", "file").json(path)


_BOOK = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{parts}</Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" '
    'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>',
}


def _cell(v) -> str:
    from xml.sax.saxutils import escape

    if v is None:
        return "<c/>"
    if isinstance(v, (int, float)) and not isinstance(v, bool) and v == v:
        return f"<c><v>{v}</v></c>"
    clean = "".join(c for c in str(v) if c >= " " or c in "\t\n")
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(clean)}</t></is></c>'


def workbook(tables: Iterable[tuple[str, Iterable[Sequence]]]) -> bytes:
    """A spreadsheet file of named tables, each its rows from its heads on: numbers as numbers, nulls as empty cells, anything else as text.

    Rows are written as they come, so what is held is the file, compressed.
    """
    import io
    import zipfile
    from xml.sax.saxutils import quoteattr

    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"
    link = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet"
    head, out, names = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>', io.BytesIO(), []
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, rows in tables:
            names.append(name)
            with z.open(f"xl/worksheets/sheet{len(names)}.xml", "w", force_zip64=True) as sheet:
                sheet.write(f'{head}<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'.encode())
                for r in rows:
                    sheet.write(f"<row>{''.join(map(_cell, r))}</row>".encode())
                sheet.write(b"</sheetData></worksheet>")
        fill = {
            "parts": "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}"/>' for i, _ in enumerate(names, 1)),
            "names": "".join(f'<sheet name={quoteattr(n[:31])} sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1)),
            "links": "".join(f'<Relationship Id="rId{i}" Type="{link}" Target="worksheets/sheet{i}.xml"/>' for i, _ in enumerate(names, 1)),
        }
        for name, body in _BOOK.items():
            z.writestr(name, head + body.format(**fill))
    return out.getvalue()


def workbooks(items: DataFrame, missing: DataFrame, extra: DataFrame) -> DataFrame:
    """``project_id`` and ``workbook``: each project's export sheets as one spreadsheet file. Rows come sorted and are written in turn; a file fits in memory, compressed."""
    tables, every = sheets(items, missing, extra), None
    for at, (name, t) in enumerate(tables.items()):
        heads = [c for c in t.columns if c != "project_id"]
        flat = t.withColumn("by_trade", F.to_json("by_trade")) if "by_trade" in heads else t
        order = F.col("#").cast("long") if "#" in heads else F.col("seq").cast("long") if "seq" in heads else F.lit(0).cast("long")
        part = flat.select("project_id", F.lit(at).alias("at"), F.lit(name).alias("name"), order.alias("n"), F.to_json(F.array(*(F.struct(F.col(f"`{c}`").alias("v")).cast("struct<v:string>") for c in heads))).alias("cells"), F.lit("\n".join(heads)).alias("heads"))
        every = part if every is None else every.unionByName(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))

        def written(of_sheet: Iterator[tuple]) -> Iterator[Sequence]:
            for k, (_, _, _, cells, heads) in enumerate(of_sheet):
                if k == 0:
                    yield heads.split("\n")
                yield [c.get("v") for c in json.loads(cells)]

        for project, of_project in groupby(rows, key=lambda r: r[0]):
            book = workbook((name, written(of_sheet)) for (_, name), of_sheet in groupby(of_project, key=lambda r: r[1:3]))
            yield pa.RecordBatch.from_pydict({"project_id": [project], "workbook": [book]}, schema=pa.schema([("project_id", kinds[0]), ("workbook", pa.binary())]))

    kind = dict(items.dtypes)["project_id"]
    kinds = [pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()]
    dealt = spread(every, "project_id").sortWithinPartitions("project_id", "at", "n").select("project_id", "at", "name", "cells", "heads")
    return dealt.mapInArrow(run, f"project_id {kind}, workbook binary")
