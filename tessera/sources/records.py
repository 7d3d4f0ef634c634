"""JSON-lines and manifest readers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines): strict reading fails on a bad line, the other sets it aside; blank lines don't count."""
    if strict:
        return spark.read.schema(schema).json(path, mode="FAILFAST"), spark.createDataFrame([], "line string")
    full = StructType([*StructType.fromDDL(schema).fields, StructField("_corrupt_record", StringType())])
    lines = spark.read.text(path).filter(F.trim("value") != "")
    rows = lines.select("value", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    bad = F.col("r._corrupt_record").isNotNull() | F.col("r").isNull()
    names = StructType.fromDDL(schema).fieldNames()
    return rows.filter(~bad).select(*[F.col(f"r.`{n}`") for n in names]), rows.filter(bad).select(F.col("value").alias("line"))


def torn_tails(spark: SparkSession, path: str, most: int = 1 << 20) -> list[str]:
    """The unfinished last lines of the files of a JSON-lines folder or file: those without a line break that aren't JSON.

    The driver reads at most ``most`` bytes from each file's end.
    """
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = fs.Path(path)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    listed = [s for s in system.listStatus(root) if s.isFile() and not s.getPath().getName().startswith(("_", "."))]
    out = []
    for status in listed:
        size = status.getLen()
        at = max(0, size - most)
        stream = system.open(status.getPath())
        try:
            stream.seek(at)
            tail = bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()
        if tail and not tail.endswith((b"\n", b"\r")):
            last = tail.splitlines()[-1].decode("utf-8", "replace")
            try:
                json.loads(last)
            except ValueError:
                out.append(last)
    return out


def read_checkpoint(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantined lines) of an appended JSON-lines checkpoint: a file's torn last line, left by a writer that
    died, is set aside; any other bad line is an error."""
    rows, bad = read_jsonl(spark, path, schema, strict=False)
    torn = torn_tails(spark, path)
    if bad.filter(~F.col("line").isin(*torn) if torn else F.lit(True)).head(1):
        raise ValueError(f"{path} has a bad line that isn't a torn last one")
    return rows, bad


def read_dataset(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array or JSON lines, whichever the file holds."""
    first = spark.read.text(path).filter(F.trim("value") != "").limit(1).collect()
    array = bool(first) and first[0][0].lstrip().startswith("[")
    return spark.read.schema(schema).json(path, multiLine=array, mode="FAILFAST")


def _scalar(text: str) -> object:
    text = text.strip()
    if text[:1] in "\"'" and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1]
    if text.startswith(("[", "{")):
        return json.loads(text)
    named = {"": None, "null": None, "~": None, "true": True, "false": False}
    if text.lower() in named:
        return named[text.lower()]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def _uncommented(line: str) -> str:
    """A line without its comment: from a ``#`` at its start or after a blank, outside quotes."""
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'" and (i == 0 or line[i - 1] in " :[{,-"):
            quote = c
        elif c == "#" and (i == 0 or line[i - 1] in " \t"):
            return line[:i]
    return line


def parse_manifest(text: str) -> object:
    """The part of YAML that manifests use: nested maps and lists by indentation, plain and quoted scalars."""
    lines = []
    for raw in text.splitlines():
        body = _uncommented(raw).rstrip()
        if body.strip() and body.strip() != "---":
            lines.append((len(body) - len(body.lstrip()), body.strip()))

    def block(at: int, depth: int) -> tuple[object, int]:
        out: dict | list | None = None
        while at < len(lines) and lines[at][0] >= depth:
            indent, body = lines[at]
            if body.startswith("- ") or body == "-":
                out = [] if out is None else out
                rest = body[1:].strip()
                if rest and (":" not in rest or rest[0] in "\"'[{"):
                    out.append(_scalar(rest))
                    at += 1
                    continue
                if rest:
                    lines[at] = (indent + 2, rest)
                else:
                    at += 1
                value, at = block(at, indent + 1)
                out.append(value)
                continue
            if out is None:
                out = {}
            key, _, rest = body.partition(":")
            at += 1
            nested = at < len(lines) and (lines[at][0] > indent or (lines[at][0] == indent and lines[at][1].startswith("-")))
            if rest.strip() or not nested:
                out[key.strip().strip("\"'")] = _scalar(rest)
            else:
                out[key.strip().strip("\"'")], at = block(at, lines[at][0])
            if at < len(lines) and lines[at][0] < indent:
                break
        return out, at

    return block(0, 0)[0]


def read_manifest(spark: SparkSession, path: str) -> object:
    """A manifest file, with the YAML library where there is one."""
    text = "\n".join(r[0] for r in spark.read.option("wholetext", "true").text(path).collect())
    try:
        import yaml
    except ImportError:
        return parse_manifest(text)
    return yaml.safe_load(text)
