"""Registered queries that scan and parse a source tree, which is written from the documents first."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from tessera import testdata as td
from tessera.operators import parsing
from tessera.queries import query
from tessera.sources import places
from tessera.sources.files import scan

LARGE = 3000
_TREES: dict[tuple, str] = {}


def _files_of(k: int, text: str) -> dict[str, bytes | None]:
    """What the folder of document ``k`` holds, by the last digit of ``k``; None is a link."""
    page = f"<template><div/></template>\n<script setup lang=\"ts\">\naxios.get(`/api/d{k}/${{id}}`)\nhttp.post(API{k + 1}.search, {{ a: 1 }})\nrequest({{ url: API{k + 1}.search }})\nfetch(dynamic)\n</script>\n"
    api = f"export const API{k} = {{ search: '/api/d{k}/search', other: \"/o\" }}\nexport const request = (config) => http.put(config.url)\n"
    kinds: list[dict[str, bytes | None]] = [
        {"View.vue": page.encode()}, {"api.ts": api.encode(), "node_modules/m/skip.js": b"axios.get('/skipped')"},
        {"nul.json": b"{\0}"}, {"latin.xml": b"<a>\xe9</a>"}, {"link.py": None, "__init__.py": b""},
    ]
    return {"text.json": text.encode(), "notes.txt": b"unknown suffix", **(kinds[k % 10] if k % 10 < len(kinds) else {})}


def _tree(spark, sf) -> str:
    """A folder for each document, written by tasks into the shared folder, once a session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _TREES:
        root = places.fresh(spark, "tree")
        if "://" in root and not root.startswith("file://"):
            raise ValueError("a tree of files needs a shared folder that is mounted everywhere")
        root = "/" + root.removeprefix("file:").lstrip("/")

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for name, content in _files_of(k, text or "").items():
                        path = f"{root}/{k % 7}/d{k}/{name}"
                        os.makedirs(os.path.dirname(path), exist_ok=True)
                        if content is None:
                            if not os.path.islink(path):
                                os.symlink("/nowhere", path)
                        else:
                            with open(path, "wb") as f:
                                f.write(content)
                yield pa.RecordBatch.from_arrays([batch.column(0)], ["doc_id"])

        os.makedirs(root, exist_ok=True)
        wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
        td.table(spark, sf, "documents").select("doc_id", "text").repartition(wide, "doc_id").mapInArrow(write, "doc_id long").write.format("noop").mode("overwrite").save()
        _TREES[key] = root
    return _TREES[key]


_AT = "(doc_id % 7) || '/d' || doc_id || '/'"
_FILES = f"""f AS (SELECT {_AT} || 'text.json' AS file_path, 'json' AS language, text AS content FROM documents
  UNION ALL SELECT {_AT} || 'View.vue', 'vue', '<template><div/></template>' || chr(10) || '<script setup lang="ts">' || chr(10) || 'axios.get(`/api/d' || doc_id || '/${{id}}`)' || chr(10) || 'http.post(API' || (doc_id + 1) || '.search, {{ a: 1 }})' || chr(10) || 'request({{ url: API' || (doc_id + 1) || '.search }})' || chr(10) || 'fetch(dynamic)' || chr(10) || '</script>' || chr(10) FROM documents WHERE doc_id % 10 = 0
  UNION ALL SELECT {_AT} || 'api.ts', 'typescript', 'export const API' || doc_id || ' = {{ search: ''/api/d' || doc_id || '/search'', other: "/o" }}' || chr(10) || 'export const request = (config) => http.put(config.url)' || chr(10) FROM documents WHERE doc_id % 10 = 1
  UNION ALL SELECT {_AT} || '__init__.py', 'python', '' FROM documents WHERE doc_id % 10 = 4)"""


@query(f"WITH {_FILES} SELECT file_path, language, sha256(content) AS file_hash, strlen(content)::BIGINT AS size_bytes, (length(content) - length(replace(content, chr(10), '')) + (content <> '' AND right(content, 1) <> chr(10))::INT)::INT AS line_count FROM f WHERE strlen(content) <= {LARGE}")
def scan_tree_files(spark, sf):
    return scan(spark, _tree(spark, sf), max_bytes=LARGE)[0].select("file_path", "language", "file_hash", "size_bytes", "line_count")


@query(
    f"WITH {_FILES} SELECT file_path, 'FILE_TOO_LARGE' AS reason_code FROM f WHERE strlen(content) > {LARGE} UNION ALL SELECT {_AT} || 'nul.json', 'BINARY_FILE' FROM documents WHERE doc_id % 10 = 2 "
    f"UNION ALL SELECT {_AT} || 'latin.xml', 'DECODE_ERROR' FROM documents WHERE doc_id % 10 = 3 UNION ALL SELECT {_AT} || 'link.py', 'SYMLINK_FILE' FROM documents WHERE doc_id % 10 = 4"
)
def scan_tree_issues(spark, sf):
    return scan(spark, _tree(spark, sf), max_bytes=LARGE)[1].select("file_path", "reason_code")


@query(
    f"WITH v AS (SELECT {_AT} || 'View.vue' AS file_path, doc_id AS k, EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = documents.doc_id + 1) AS known FROM documents WHERE doc_id % 10 = 0) "
    "SELECT file_path, 'GET /api/d' || k || '/${id}' AS found, 'static_request' AS how FROM v UNION ALL SELECT file_path, 'POST /api/d' || (k + 1) || '/search', 'static_request' FROM v WHERE known UNION ALL SELECT file_path, 'PUT /api/d' || (k + 1) || '/search', 'wrapper_default_method' FROM v WHERE known "
    "UNION ALL SELECT file_path, 'FRONTEND_REQUEST_DYNAMIC_URL', 'analysis_warning' FROM v UNION ALL SELECT file_path, unnest(['FRONTEND_REQUEST_DYNAMIC_URL', 'FRONTEND_REQUEST_DYNAMIC_URL']), 'analysis_warning' FROM v WHERE NOT known "
    f"UNION ALL SELECT {_AT} || 'api.ts', 'FRONTEND_REQUEST_DYNAMIC_URL', 'analysis_warning' FROM documents WHERE doc_id % 10 = 1"
)
def scan_tree_requests(spark, sf):
    """Requests of the pages' scripts, resolved by constants and wrappers of other files."""
    files = scan(spark, _tree(spark, sf), max_bytes=LARGE)[0]
    parsed = places.settled(parsing.parse_files(files.filter(F.col("language").isin("vue", "typescript"))), "parsed")
    calls, warnings = parsing.resolve_requests(parsed.select(F.inline("requests")), *parsing.catalogs(parsed))
    return calls.select("file_path", F.col("name").alias("found"), F.get_json_object("metadata_json", "$.resolution").alias("how")).unionByName(warnings.select("file_path", F.col("reason_code").alias("found"), F.col("issue_type").alias("how")))
