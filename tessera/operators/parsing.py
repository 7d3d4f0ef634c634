"""Parsing files to entities, relations and requests, and resolving requests by joins."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.functions.scalars import normalize_api_path
from tessera.schema import ENTITY, RELATION, REQUEST

_REQUEST = REQUEST + ", path_literal string, method_literal string"
_STRUCT = lambda fields: "array<struct<" + ",".join(x.replace(" ", ":") for x in fields.split(", ")) + ">>"
PARSED = f"file_path string, language string, entities {_STRUCT(ENTITY)}, relations {_STRUCT(RELATION)}, requests {_STRUCT(_REQUEST)}, constants array<struct<object:string,property:string,value:string>>, wrappers array<struct<name:string,method:string>>, error string"
FRONTEND = ("vue", "javascript", "typescript")
WARNINGS = ("dynamic_url", "ambiguous_constant", "dynamic_method", "unknown_wrapper")


def parse_files(files: DataFrame) -> DataFrame:
    """One row a file (file_path, language, content): what its language's parser finds, or its error.

    Keys get their file's path in front; a file that can't be parsed doesn't stop the others.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from tessera.functions import source_code as sc

        for batch in batches:
            out = []
            for path, language, content in zip(*(batch.column(c).to_pylist() for c in ("file_path", "language", "content")), strict=True):
                row = {"file_path": path, "language": language, "entities": [], "relations": [], "requests": [], "constants": [], "wrappers": [], "error": None}
                try:
                    parser = sc.PARSERS.get(language)
                    if parser:
                        row["entities"], row["relations"], row["requests"] = parser(path, content or "")
                    for e in row["entities"]:
                        e["local_key"] = f"{path}::{e['local_key']}"
                    for r in row["relations"]:
                        r["source_key"], r["target_key"] = f"{path}::{r['source_key']}", f"{path}::{r['target_key']}"
                    for q in row["requests"]:
                        q["path_literal"], q["method_literal"] = sc.literal(q["url_expression"]), sc.literal(q["method_expression"])
                    if language in FRONTEND:
                        row["constants"] = [dict(zip(("object", "property", "value"), x, strict=True)) for x in sc.constants(content or "")]
                        row["wrappers"] = [dict(zip(("name", "method"), x, strict=True)) for x in sc.wrappers(content or "")]
                except Exception as e:  # a file's own fault is a row, not a failure of the job
                    row |= {"entities": [], "relations": [], "requests": [], "error": f"{type(e).__name__}: {e}"[:500]}
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    arrow = to_arrow_schema(StructType.fromDDL(PARSED))
    return files.select("file_path", "language", "content").mapInArrow(run, PARSED)


def catalogs(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Constants (object, property, values) and wrappers (name, methods) over all frontend files."""
    constants = parsed.select(F.inline("constants")).groupBy("object", "property").agg(F.sort_array(F.collect_set("value")).alias("values"))
    wrappers = parsed.select(F.inline("wrappers")).groupBy("name").agg(F.sort_array(F.collect_set("method")).alias("methods"))
    return constants, wrappers


def resolve_requests(requests: DataFrame, constants: DataFrame, wrappers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, warnings): requests with one path and one method become entities, others warnings.

    The path is a literal or a constant with one value; the method a literal, a plain word, or the one
    method of a wrapper of the callee's name.
    """
    parts = F.split(F.trim("url_expression"), r"\.")
    r = requests.withColumn("object", F.when(F.size(parts) >= 2, F.element_at(parts, -2))).withColumn("property", F.when(F.size(parts) >= 2, F.element_at(parts, -1)))
    r = r.withColumn("name", F.element_at(F.split("callee", r"\."), -1))
    r = r.join(constants, ["object", "property"], "left").join(wrappers, "name", "left")
    n = F.coalesce(F.size("values"), F.lit(0))
    n = F.when(F.col("values").isNull(), 0).otherwise(n)
    path = F.coalesce("path_literal", F.when(n == 1, F.element_at("values", 1)))
    path_reason = F.when(path.isNull(), F.when(n > 1, "ambiguous_constant").otherwise("dynamic_url"))
    said = F.upper(F.coalesce("method_literal", "method_expression"))
    known = F.when(F.col("methods").isNull(), 0).otherwise(F.size("methods"))
    method = F.when(F.col("method_expression").isNotNull(), F.when(said.isin("GET", "POST", "PUT", "PATCH", "DELETE"), said)).otherwise(F.when(known == 1, F.element_at("methods", 1)))
    method_reason = F.when(method.isNull(), F.when(F.col("method_expression").isNotNull(), "dynamic_method").otherwise("unknown_wrapper"))
    r = r.withColumn("path", path).withColumn("method", method).withColumn("reason", F.coalesce(path_reason, method_reason))
    good = r.filter("reason is null").withColumn("title", F.concat_ws(" ", "method", "path"))
    resolution = F.when(F.col("method_expression").isNull() & (known > 0), "wrapper_default_method").otherwise("static_request")
    meta = F.to_json(F.struct("callee", F.col("callee").alias("client"), F.col("method").alias("http_method"), normalize_api_path(F.col("path")).alias("normalized_path"), "path", resolution.alias("resolution")))
    key = F.concat_ws(":", F.lit("frontend_api_call"), "file_path", F.col("start_line").cast("string"), F.col("start_byte").cast("string"), "callee")
    entities = good.select(key.alias("local_key"), F.lit("frontend_api_call").alias("entity_type"), F.col("title").alias("name"), F.col("title").alias("qualified_name"), "file_path", "start_line", "end_line", "content", meta.alias("metadata_json"))
    warnings = r.filter("reason is not null").select("file_path", F.lit("analysis_warning").alias("issue_type"), F.concat(F.lit("FRONTEND_REQUEST_"), F.upper("reason")).alias("reason_code"), F.concat(F.lit("Frontend request was not indexed: "), "reason", F.lit(".")).alias("message"))
    return entities, warnings


def parse_errors(parsed: DataFrame) -> DataFrame:
    bad: Column = F.col("error").isNotNull()
    return parsed.filter(bad).select("file_path", F.lit("parse_error").alias("issue_type"), F.lit("PARSE_ERROR").alias("reason_code"), F.col("error").alias("message"))
