"""Scalar functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages of file suffixes, folders that are not scanned, router words, memory limits.
LANGUAGES = {
    "java": "java", "py": "python", "vue": "vue", "js": "javascript", "jsx": "javascript", "ts": "typescript",
    "tsx": "typescript", "sql": "sql", "xml": "xml", "yml": "yaml", "yaml": "yaml", "json": "json",
}
IGNORED_FOLDERS = (".git", "node_modules", "dist", "build", "target", "__pycache__", ".idea", ".vscode", ".venv", ".pytest_tmp", ".worktrees", "venv")
CHANGE_WORDS = ("add ", "adding ", "change ", "changing ", "modify", "modification", "which files need", "affected files", "impact", "risk", "新增", "增加", "修改", "改哪些", "需要改", "影响", "风险", "字段")
TRACE_WORDS = ("come from", "comes from", "data flow", "call chain", "call relationship", "frontend backend", "front-end back-end", "trace", "数据从哪里", "数据来源", "调用链", "调用关系", "链路", "前后端", "追踪")
TRUNCATED = " [truncated]"
LINE_BREAK = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"
CJK_CLASS = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}\x{3000}-\x{30FF}\x{FF00}-\x{FFEF}\x{AC00}-\x{D7AF}"
BEARER = r"(?i)(\bBearer\s+)[A-Za-z0-9._~+/=-]+"
ASSIGNED = r"(?i)(\b(?:api[_-]?key|authorization|access[_-]?token|token|password|secret)\s*[:=]\s*)[^\s,;]+"


def language_of(path: Column) -> Column:
    """Language of a path's suffix, in any case; null if unknown."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), suffix)


def line_count(text: Column) -> Column:
    """Lines as text editors count them: any Unicode line break, none after the last one."""
    body = F.regexp_replace(text, f"(?:{LINE_BREAK})\\z", "")
    return F.when(F.length(text) == 0, 0).otherwise(F.size(F.split(F.concat(body, F.lit("x")), LINE_BREAK, -1)))


def slice_lines(text: Column, first: Column, last: Column) -> Column:
    """Lines ``first`` to ``last``, from 1, both included."""
    return F.array_join(F.slice(F.split(text, LINE_BREAK, -1), first, last - first + 1), "\n")


def normalize_api_path(url: Column) -> Column:
    """Path of a URL with single slashes, every parameter segment as ``{param}``."""
    path = F.regexp_replace(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*", "")
    path = F.regexp_replace(F.regexp_replace(path, r"#.*$", ""), r"\?.*$", "")
    parts = F.filter(F.split(path, "/+", -1), lambda s: s != "")
    parts = F.transform(parts, lambda s: F.when(s.rlike(r"^(?:\{[^/{}]+\}|:[^/]+|\$\{[^/{}]+\}|\d+)$"), "{param}").otherwise(s))
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def join_paths(base: Column, path: Column) -> Column:
    parts = F.filter(F.array(F.trim(base, F.lit("/")), F.trim(path, F.lit("/"))), lambda s: s != "")
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def truncate(text: Column, limit: int) -> Column:
    """At most ``limit`` characters; a longer text ends with a marker inside the limit."""
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit - len(TRUNCATED)), F.lit(TRUNCATED)))


def collapse(text: Column) -> Column:
    """Lower case, white space runs as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def task_type(question: Column) -> Column:
    """Route of a question: change plan before trace before code question."""
    text = collapse(question)
    any_of = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))
    return F.when(any_of(CHANGE_WORDS), "CHANGE_PLAN").when(any_of(TRACE_WORDS), "TRACE_CHAIN").otherwise("CODE_QA")


def has_cjk(text: Column) -> Column:
    return text.rlike(r"[\x{3400}-\x{9FFF}]")


def detect_language(text: Column) -> Column:
    """``zh`` if a fifth or more of the characters that are no space or punctuation are CJK, else ``en``."""
    seen = F.length(F.regexp_replace(text, r"[\s\p{P}]", ""))
    cjk = F.length(F.regexp_replace(F.regexp_replace(text, r"[\s\p{P}]", ""), f"[^{CJK_CLASS}]", ""))
    return F.when((seen > 0) & (cjk * 5 >= seen), "zh").otherwise("en")


def redact(text: Column) -> Column:
    """Bearer tokens and assigned secrets in a message are masked."""
    return F.regexp_replace(F.regexp_replace(text, BEARER, "$1[REDACTED]"), ASSIGNED, "$1[REDACTED]")


def normalize_evidence_path(path: Column) -> Column:
    return F.regexp_replace(F.trim(F.replace(path, F.lit("\\"), F.lit("/"))), r"[.,;:)]+$", "")


def stable_key(*parts: Column) -> Column:
    """SHA-256 of an entity's identity; the third part is its path, compared in lower case with forward slashes."""
    text = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    text[2] = F.lower(F.replace(text[2], F.lit("\\"), F.lit("/")))
    return F.sha2(F.trim(F.concat_ws("|", *text)).cast("binary"), 256)


def json_object(text: Column, strict: bool = False) -> Column:
    """The text if it is a JSON object; else ``{}``, or with ``strict`` an error."""
    good = F.coalesce(F.startswith(F.ltrim(text), F.lit("{")) & F.try_parse_json(text).isNotNull(), F.lit(False))
    other = F.raise_error(F.concat(F.lit("not a JSON object: "), F.coalesce(F.substring(text, 1, 80), F.lit("null")))) if strict else F.lit("{}")
    return F.when(good, text).otherwise(other)


def relationship_limits(uncertainties: Column) -> Column:
    """Those of an answer's uncertainties that tell of a relation type without a stored edge."""
    return F.filter(uncertainties, lambda u: F.startswith(u, F.lit("No stored ")) & F.contains(u, F.lit("edge was found")) & F.contains(u, F.lit("cannot be determined from indexed code")))


def with_limits(answer: Column, uncertainties: Column) -> Column:
    """The answer with its relationship limits listed below, if it has any."""
    limits = relationship_limits(uncertainties)
    listed = F.concat(answer, F.lit("\n\nIndexed relationship limits:\n- "), F.array_join(limits, "\n- "))
    return F.when(F.size(limits) > 0, listed).otherwise(answer)


def strip_fence(text: Column) -> Column:
    """Text without a Markdown code fence around it."""
    return F.regexp_replace(F.trim(text), r"(?s)^```(?:json)?\s*(.*?)\s*```$", "$1")


def trailing_id(text: Column) -> Column:
    """The integer at a text's end, or null."""
    return F.try_to_number(F.nullif(F.regexp_extract(text, r"(\d+)\s*$", 1), F.lit("")), F.lit("9" * 18)).cast("long")


def project_from_query(value: Column, fallback: Column) -> Column:
    """A positive project id from a query string's text, or the fallback."""
    return F.when(value.rlike(r"^[1-9]\d{0,17}$"), value.cast("long")).otherwise(fallback)


def rate(part: Column, whole: Column) -> Column:
    """Quotient rounded to 4 places, 0 over nothing."""
    return F.when(whole != 0, F.round(part / whole, 4)).otherwise(0.0)
