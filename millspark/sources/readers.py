"""Readers for raw payloads, layouts, worksheet cells, files and rule manifests (S1 to S5), each with its own schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

ROW = ("product_id string, label_no string, heat_no string, thickness_mm string, width_mm string, length_raw string, quantity string, weight_kg string, "
       "weight_kind string, net_weight_kg string, gross_weight_kg string, yield_strength_mpa string, tensile_strength_mpa string, elongation_pct string, hardness_hrb string, "
       "chemistry map<string,string>, evidence array<struct<page:int,region:string>>")
CERTIFICATE = ("document struct<source_name:string,supplier:string,certificate_no:string,product_name:string,customer:string,issue_date_raw:string,delivery_date_raw:string,"
               "shipping_date_raw:string>, standard string, rolling string, condition array<string>, coating struct<metal:string,process:string,post_treatment:string>, "
               "chemistry_scales map<string,string>, total_pieces int, total_weight_kg decimal(18,6), total_net_weight_kg decimal(18,6), total_gross_weight_kg decimal(18,6), "
               "subtotals array<struct<match_field:string,match_value:string,total_pieces:int,total_weight_kg:decimal(18,6)>>, "
               f"rows array<struct<{', '.join(c.strip().replace(' ', ':', 1) for c in ROW.split(', '))}>>")
BOX = "struct<x0:double,top:double,x1:double,bottom:double>"
LAYOUT = (f"file_name string, sha256 string, pages array<struct<page_number:int,width:double,height:double,rotation:int,source:string,"
          f"blocks:array<struct<page_number:int,text:string,bbox:{BOX},confidence:double,source:string>>,"
          f"tables:array<struct<page_number:int,bbox:{BOX},rows:array<array<string>>>>>>")
MAX_FILE_BYTES = 100 * 1024 * 1024


def read_raw_certificates(spark: SparkSession, path: str, multiline: bool = True) -> tuple[DataFrame, DataFrame]:
    """(documents, rows): one document per payload, its rows with their position."""
    raw = spark.read.schema(CERTIFICATE).option("multiLine", multiline).json(path).withColumn("source_name", F.coalesce("document.source_name", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)))
    docs = raw.drop("rows")
    rows = raw.select("source_name", "chemistry_scales", F.posexplode("rows").alias("at", "row")).select("source_name", (F.col("at") + 1).alias("row_pos"), "chemistry_scales", "row.*")
    return docs, rows


def read_layouts(spark: SparkSession, path: str, multiline: bool = True) -> tuple[DataFrame, DataFrame]:
    """(blocks, cells) in long form."""
    pages = spark.read.schema(LAYOUT).option("multiLine", multiline).json(path).select("file_name", F.explode("pages").alias("p"))
    blocks = pages.select("file_name", F.col("p.page_number").alias("page"), "p.width", "p.height", "p.rotation", F.posexplode("p.blocks").alias("block_idx", "b")).select(
        "file_name", "page", "width", "height", "rotation", "block_idx", "b.text", "b.bbox.*", "b.confidence", "b.source")
    tables = pages.select("file_name", F.col("p.page_number").alias("page"), F.posexplode("p.tables").alias("table_idx", "t"))
    cells = tables.select("file_name", "page", "table_idx", F.posexplode("t.rows").alias("row_idx", "r")).select(
        "file_name", "page", "table_idx", "row_idx", F.posexplode("r").alias("col_idx", "text"))
    return blocks, cells


def read_sheet_cells(spark: SparkSession, path: str) -> DataFrame:
    """Worksheet cells exported as text rows; a formula keeps its text and never a value."""
    cells = spark.read.schema("sheet string, row int, col int, value string, is_formula boolean").parquet(path)
    return cells.withColumns({"formula": F.when(F.col("is_formula"), F.col("value")), "value": F.when(~F.col("is_formula"), F.col("value"))})


def file_inventory(spark: SparkSession, path: str, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Files with hash, duplicate mark and a status: ready, unsupported_type, too_large or bad_header.

    Files over the limit are judged by their size alone; their bytes are not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = files.filter(F.col("length") <= max_bytes).select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), F.substring("content", 1, 5).alias("head"))
    large = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(F.col("length") > max_bytes).select(
        "path", F.col("length").alias("size_bytes"), F.lit(None).cast("string").alias("sha256"), F.lit(None).cast("binary").alias("head"))
    first = small.groupBy("sha256").agg(F.min("path").alias("_first"))
    df = small.unionByName(large).join(first, "sha256", "left")
    kind = F.lower(F.element_at(F.split("path", r"\."), -1))
    status = (F.when(~kind.isin("pdf", "xlsx"), "unsupported_type").when(F.col("size_bytes") > max_bytes, "too_large")
              .when((kind == "pdf") & (F.decode("head", "ISO-8859-1") != "%PDF-"), "bad_header").otherwise("ready"))
    return df.select("path", "size_bytes", "sha256", status.alias("status"), F.coalesce(F.col("path") != F.col("_first"), F.lit(False)).alias("duplicate"))


def read_rule_sets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("rule_set_id bigint, name string, version string, status string, source_hash string, "
                             "manifest struct<catalog_sha256:string,source:string,rules:map<string,string>>").json(path)
