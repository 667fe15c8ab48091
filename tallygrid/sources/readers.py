"""Sources: files, pages, expected items, stored predictions, registries.

Formats that need a decoder which is not installed (PDF text, rendering, recognition) take it as a function; the reading, the
distribution and the rejects are the same with any decoder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrid.functions import classify, fixed, text
from tallygrid.operators.dedup import by_digest

PAGE = "page_number int, text string"
#: The two layouts of expected spreadsheets, by number of columns; seven rows stand before the items.
LAYOUTS = {
    16: "ITEM_NUM DRAWING SECTION DESCRIPTION QUANTITY WASTAGE QTY_WITH_WASTAGE UNIT UNIT_MATERIAL UNIT_LABOUR UNIT_EQUIPMENT TOTAL_MATERIAL TOTAL_LABOR TOTAL_EQUIPMENT TOTAL_COST TRADE".split(),
    15: "ITEM_NUM DRAWING DESCRIPTION QUANTITY WASTAGE QTY_WITH_WASTAGE UNIT UNIT_MATERIAL UNIT_LABOUR UNIT_EQUIPMENT TOTAL_MATERIAL TOTAL_LABOR TOTAL_EQUIPMENT TOTAL_COST TRADE".split(),
}
SKIPPED_ROWS = 7


def files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """``path``, modificationTime, length, content of the files below a folder. Contents are read only where they are used."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)


def one_file(spark: SparkSession, path: str) -> DataFrame:
    """One PDF; raises FileNotFoundError if there is none, ValueError for another kind. Works on any file system that Spark reads."""
    if not path.lower().endswith(".pdf"):
        raise ValueError(f"not a PDF: {path}")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        raise FileNotFoundError(path)
    return spark.read.format("binaryFile").load(path)


def inventory(found: DataFrame, hidden: Sequence[str] = ("expected manual output", "expected output")) -> DataFrame:
    """Files by path without hidden folders and without repeated contents: file_name, file_type, size_mb (2 places), md5."""
    seen = found.where(~classify.any_of(F.lower("path"), hidden))
    first = by_digest(seen, "content", ["path"])
    name = F.element_at(F.split("path", "/"), -1)
    return first.select("path", name.alias("file_name"), classify.file_type_listing(name).alias("file_type"), F.round(F.col("length") / 1048576, 2).alias("size_mb"), F.md5("content").alias("md5"))


def pages(found: DataFrame, decode: Callable[[bytes], list[str]], keys: Sequence[str] = ("path",), least: int = fixed.SCANNED_BELOW) -> tuple[DataFrame, DataFrame]:
    """(pages, rejects) of files, by a decoder from bytes to the texts of pages. A file that cannot be decoded is a reject, with its reason.

    Pages: keys, page_number from 1, trimmed text, is_scanned (shorter than ``least``).
    """
    kinds = dict(found.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for *key, content in pdf.itertuples(index=False):
                try:
                    out += [(*key, n, t, None) for n, t in enumerate(decode(bytes(content)), 1)]
                except Exception as e:  # a decoder may raise anything on a damaged file
                    out.append((*key, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[*keys, "page_number", "text", "error"]).astype({"page_number": "Int32"})

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", {PAGE}, error string"
    got = found.select(*keys, "content").mapInPandas(run, schema)
    good = got.where("error is null").drop("error").withColumn("text", F.trim("text"))
    return good.withColumn("is_scanned", classify.is_scanned(F.col("text"), least)), got.where("error is not null").select(*keys, "error")


def recognise(page_images: DataFrame, engine: Callable[[bytes], tuple[str, float]] | None, keys: Sequence[str]) -> DataFrame:
    """``keys``, ocr_text, ocr_confidence of page images by an engine from bytes to (text, confidence); without one, nothing is recognised."""
    kinds = dict(page_images.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", ocr_text string, ocr_confidence double"
    if engine is None:
        return page_images.select(*keys, F.lit(None).cast("string").alias("ocr_text"), F.lit(None).cast("double").alias("ocr_confidence")).limit(0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(*key, *engine(bytes(image))) for *key, image in pdf.itertuples(index=False)], columns=[*keys, "ocr_text", "ocr_confidence"])

    return page_images.select(*keys, "image").mapInPandas(run, schema)


def with_recognised(page_rows: DataFrame, recognised: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pages with the recognised text added where they were scanned."""
    out = page_rows.join(recognised, list(keys), "left").withColumn("ocr_used", F.col("ocr_text").isNotNull() & F.col("is_scanned"))
    return out.withColumn("text", text.combined_text(F.col("text"), F.col("ocr_text"), F.col("is_scanned")))


def expected_items(sheet: DataFrame, scope: str = "project_id", row: str = "row") -> DataFrame:
    """Items of positional sheets (scope, row from 0, then 15 or 16 columns): scope, seq, description, quantity, unit.

    Rows before the items, heads and rows without number, description or a positive quantity are left out. Other widths are a ValueError.
    """
    cells = [c for c in sheet.columns if c not in (scope, row)]
    if len(cells) not in LAYOUTS:
        raise ValueError(f"{len(cells)} columns; expected {sorted(LAYOUTS)}")
    named = sheet.select(scope, row, *(F.col(c).cast("string").alias(n) for c, n in zip(cells, LAYOUTS[len(cells)], strict=True))).where(F.col(row) >= SKIPPED_ROWS)
    real = named.where("DESCRIPTION is not null and QUANTITY is not null and ITEM_NUM is not null and ITEM_NUM <> 'DESCRIPTION' and DESCRIPTION <> 'DIVISION 1- GENERAL'")
    out = real.select(scope, F.col(row).cast("long").alias("seq"), F.trim("DESCRIPTION").alias("description"), F.col("QUANTITY").try_cast("double").alias("quantity"), F.trim(F.coalesce("UNIT", F.lit(""))).alias("unit"))
    return out.where("quantity > 0")


LINE_ITEM = T.StructType(
    [T.StructField(n, t()) for n, t in (("description", T.StringType), ("trade", T.StringType), ("quantity", T.DoubleType), ("unit", T.StringType), ("confidence", T.DoubleType), ("source_reference", T.StringType))]
)
PREDICTION = T.StructType([T.StructField("project_id", T.StringType()), T.StructField("trade_scope", T.StringType()), T.StructField("input_files_used", T.ArrayType(T.StringType())), T.StructField("line_items", T.ArrayType(LINE_ITEM))])


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """Line items of stored predictions: project_id, seq and item columns; a prediction without items has no rows."""
    stored = spark.read.schema(PREDICTION).option("multiLine", "true").option("recursiveFileLookup", "true").json(path)
    return stored.select("project_id", F.posexplode("line_items").alias("seq", "item")).select("project_id", F.col("seq").cast("long").alias("seq"), "item.*")


def registry(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON registry; damaged records are dropped, so an unreadable registry is empty."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "DROPMALFORMED").json(path)


def discover(listing: DataFrame, registered: DataFrame, hidden: DataFrame, search: str = "", depths: tuple[int, int] = (3, 4), names: Sequence[str] = (".git", "node_modules", "__pycache__", "outputs")) -> DataFrame:
    """Folders of ``listing(path, is_dir)`` that may be projects: at the depths, with a PDF below, neither registered nor hidden.

    By depth and then name; ``search`` is a part of the path, in any case.
    """
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    depth = F.size(parts)
    folders = listing.where("is_dir").withColumn("depth", depth).withColumn("name", F.element_at(parts, -1)).where(F.col("depth").between(*depths) & ~F.col("name").isin(*names))
    # the folders at each depth that a PDF is in
    steps = F.transform(F.sequence(F.lit(depths[0]), F.lit(depths[1])), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")))
    holding = listing.where(~F.col("is_dir") & F.endswith(F.lower("path"), F.lit(".pdf"))).select(F.explode(steps).alias("path")).distinct()
    out = folders.join(holding, "path", "left_semi").join(registered.select("path"), "path", "left_anti").join(hidden.select("path"), "path", "left_anti")
    return out.where(F.contains(F.lower("path"), F.lit(search.lower()))).select("path", "name", "depth").orderBy("depth", "name")


def project_type(listing: DataFrame, projects: DataFrame, marker: str = "expected") -> DataFrame:
    """Projects with their type: sample if an expected folder stands in or beside them, else challenge."""
    beside = listing.where(F.col("is_dir") & F.contains(F.lower("path"), F.lit(marker))).select(F.regexp_replace("path", "/[^/]+$", "").alias("_at")).distinct()
    # a path and its parent are two rows, so that both are one equi-join
    places = projects.select("path", F.explode(F.array("path", F.regexp_replace("path", "/[^/]+$", ""))).alias("_at"))
    both = places.join(beside, "_at", "left_semi").select("path").distinct().withColumn("_s", F.lit(True))
    return projects.join(both, "path", "left").withColumn("type", F.when(F.col("_s"), "sample").otherwise("challenge")).drop("_s")


def listed(listing: DataFrame) -> DataFrame:
    """A folder's entries, folders first, then by name in any case."""
    return listing.orderBy(F.desc("is_dir"), F.lower(F.element_at(F.split("path", "/"), -1)), "path")


def images(found: DataFrame, render: Callable[[bytes, Sequence[int] | None], list[tuple[int, bytes]]], keys: Sequence[str] = ("path",), page_numbers: Sequence[int] | None = None) -> DataFrame:
    """``keys``, page_number, image of files by a renderer from (bytes, page numbers or all) to numbered images; a file that cannot be rendered gives none."""
    kinds = dict(found.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for *key, content in pdf.itertuples(index=False):
                try:
                    out += [(*key, n, image) for n, image in render(bytes(content), page_numbers)]
                except Exception:  # a renderer may raise anything on a damaged file
                    continue
            yield pd.DataFrame(out, columns=[*keys, "page_number", "image"]).astype({"page_number": "int32"})

    return found.select(*keys, "content").mapInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", page_number int, image binary")


def regions(page_images: DataFrame, detect: Callable[[bytes], tuple[int, int, list[tuple[int, int, int, int, float]]]], keys: Sequence[str]) -> DataFrame:
    """``keys``, x1, y1, x2, y2, kind: the regions of page images that may hold text.

    ``detect`` gives a page's width, height and boxes (x1, y1, x2, y2, fill); what is kept, and as what, is decided by ``classify``.
    """
    kinds = dict(page_images.dtypes)
    names = ["page_w", "page_h", "x1", "y1", "x2", "y2", "fill"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(*key, w, h, *box) for *key, image in pdf.itertuples(index=False) for w, h, boxes in [detect(bytes(image))] for box in boxes]
            yield pd.DataFrame(out, columns=[*keys, *names]).astype(dict.fromkeys(names, "float64"))

    boxes = page_images.select(*keys, "image").mapInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + ", ".join(f"{n} double" for n in names))
    c = {n: F.col(n) for n in names}
    kept = boxes.where(classify.real_region(c["x2"] - c["x1"], c["y2"] - c["y1"], c["fill"]))
    return kept.select(*keys, *names[2:6], classify.region(c["x1"], c["y1"], c["x2"], c["y2"], c["page_w"], c["page_h"]).alias("kind"))


def seen_items(page_images: DataFrame, look: Callable[[bytes], list[dict]], keys: Sequence[str], page: str = "page_number", most_pages: int = 20) -> DataFrame:
    """``keys``, page, seq, description, trade: items that a vision model, plugged in, finds on the first ``most_pages`` pages of each key; a failed call gives none."""
    from pyspark.sql import Window

    first = page_images.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(page))).where(F.col("_n") <= most_pages)
    kinds, at = dict(page_images.dtypes), [*keys, page]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for *key, image in pdf.itertuples(index=False):
                try:
                    out += [(*key, i, x["description"], x.get("trade") or "Other") for i, x in enumerate(look(bytes(image))) if x.get("description")]
                except Exception:  # one bad answer must not end a job over a whole corpus
                    continue
            yield pd.DataFrame(out, columns=[*at, "seq", "description", "trade"])

    return first.select(*at, "image").mapInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in at) + ", seq long, description string, trade string")
