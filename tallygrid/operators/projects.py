"""Projects: registries, paths, stored outputs, expected sheets. Listings are tables (path, is_dir, size), so any store will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXPECTED = "expected manual output"


def parent(path: Column | str) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def name(path: Column | str) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def visible(registry: DataFrame, hidden: DataFrame, listing: DataFrame) -> DataFrame:
    """Registered projects that are not hidden and whose path exists."""
    return registry.join(hidden.select("project_id").distinct(), "project_id", "left_anti").join(listing.select("path").distinct(), "path", "left_semi")


def info(registry: DataFrame, listing: DataFrame) -> DataFrame:
    """Registered projects with their number of PDFs (expected folders aside) and whether an output and an evaluation are stored.

    Files meet projects by each of their folders, an equi-join; a project without files counts 0.
    """
    plain = listing.where(~F.col("is_dir"))
    pdf = plain.where(F.endswith(F.lower("path"), F.lit(".pdf")) & ~F.contains(F.lower("path"), F.lit(f"/{EXPECTED}/")))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    files = pdf.select(F.explode(above).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("files_count"))
    stored = lambda file, flag: plain.where(name("path") == file).select(name(parent("path")).alias("project_id"), F.lit(True).alias(flag)).distinct()
    out = registry.join(files, "path", "left").join(stored("prediction.json", "has_output"), "project_id", "left").join(stored("evaluation_report.json", "has_evaluation"), "project_id", "left")
    return out.fillna({"files_count": 0, "has_output": False, "has_evaluation": False})


def resolve_path(wanted: DataFrame, registry: DataFrame, listing: DataFrame, default_root: str = "client_files") -> DataFrame:
    """``wanted(project_id, path)`` with ``resolved``: the given path, else the registered one, else that of the first folder whose name
    starts with the id (its "Project Files" folder if there is one), else the default place."""
    folders = listing.where("is_dir").select(F.col("path").alias("_folder"), name("path").alias("_name"))
    need = wanted.where("path is null").join(registry.select("project_id"), "project_id", "left_anti").select("project_id")
    named = need.join(folders, F.startswith("_name", "project_id"))  # theta join over the few ids that nothing else resolves
    first = named.withColumn("_n", F.row_number().over(Window.partitionBy("project_id").orderBy("_folder"))).where("_n = 1").select("project_id", "_folder")
    inner = folders.where("_name = 'Project Files'").select(parent("_folder").alias("_folder"), F.col("_folder").alias("_inner"))
    found = first.join(inner, "_folder", "left").select("project_id", F.coalesce("_inner", "_folder").alias("_found"))
    out = wanted.join(registry.select("project_id", F.col("path").alias("_registered")), "project_id", "left").join(found, "project_id", "left")
    return out.withColumn("resolved", F.coalesce("path", "_registered", "_found", F.concat(F.lit(f"{default_root}/"), "project_id", F.lit("/Project Files")))).drop("_registered", "_found")


def expected_sheets(listing: DataFrame) -> DataFrame:
    """``folder`` and ``sheet``: the first spreadsheet of each project's expected folder."""
    x = listing.where(~F.col("is_dir") & F.endswith(F.lower("path"), F.lit(".xlsx")) & (F.lower(name(parent("path"))) == EXPECTED))
    return x.groupBy(parent(parent("path")).alias("folder")).agg(F.min("path").alias("sheet"))


def batch(listing: DataFrame) -> DataFrame:
    """Every "Project Files" folder with its project and whether an expected folder stands beside it."""
    d = listing.where("is_dir")
    found = d.where(name("path") == "Project Files").select("path", parent("path").alias("project"))
    beside = d.where(F.lower(name("path")) == EXPECTED).select(parent("path").alias("project"), F.lit(True).alias("has_expected")).distinct()
    return found.join(beside, "project", "left").fillna({"has_expected": False})


def stored_versions(outputs: DataFrame) -> DataFrame:
    """``outputs(path, size, text)`` of stored JSON with the number of line items; damaged ones count 0."""
    items = F.from_json("text", "line_items array<struct<description:string>>")["line_items"]
    return outputs.select("path", name("path").alias("file"), "size", F.coalesce(F.size(items), F.lit(0)).alias("line_items_count")).orderBy("path")


def without_job(jobs: DataFrame, job_id: str) -> tuple[DataFrame, bool]:
    """Jobs without one, and whether there was one."""
    return jobs.where(F.col("job_id") != job_id), jobs.where(F.col("job_id") == job_id).limit(1).count() > 0


def search(projects: DataFrame, text: str = "", kind: str | None = None) -> DataFrame:
    """Projects of a kind (all without one) whose id or name contains a text, in any case."""
    low = F.lit(text.lower())
    out = projects.where(F.contains(F.lower("project_id"), low) | F.contains(F.lower(F.coalesce("name", F.lit(""))), low))
    return out.where(F.col("type") == kind) if kind and kind != "all" else out
