"""Bounded evidence contexts, memory windows and the checks of answers against evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import normalize_evidence_path, truncate

BUDGET = 12_000
GAP = 2
MEMORY_MESSAGES = 6
MESSAGE_CHARS = 600
MEMORY_CHARS = 4_000
# File suffixes and shapes of paths and citations in answers.
CODE_SUFFIXES = "java|py|vue|tsx|ts|jsx|json|js|md|xml|yaml|yml"
CITATION = r"(?<!\w)\[(\d+)\]"
FOLDER_PATH = rf"(?:[A-Za-z0-9_.-]+[\\/])+[A-Za-z0-9_.-]+\.(?:{CODE_SUFFIXES})(?:[\\/][A-Za-z0-9_.-]+\.(?:{CODE_SUFFIXES}))*"
FILE_NAME = rf"(?<![A-Za-z0-9_.\\/:-])[A-Za-z0-9_.-]+\.(?:{CODE_SUFFIXES})"
LINES = r"(?::\d+(?:-\d+)?)?"


def budget_prefix(blocks: DataFrame, group: str, place: str, text: str, budget: int = BUDGET) -> DataFrame:
    """Blocks in order up to the first that would overflow the budget (blocks are two characters apart)."""
    order = Window.partitionBy(group).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(F.length(text) + GAP).over(order) - GAP
    return blocks.withColumn("used", used).filter(F.col("used") <= budget)


def budget_greedy(blocks: DataFrame, group: str, place: str, text: str, budget: int = BUDGET) -> DataFrame:
    """Blocks in order, those that would overflow skipped; citation counts the kept ones from 1."""
    ordered = blocks.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(place).alias("place"), F.length(text).alias("size")))).alias("all"))
    empty = F.array().cast("array<struct<place:bigint,citation:int,used:int>>")

    def step(a: Column, x: Column) -> Column:
        used = F.when(F.size(a) == 0, 0).otherwise(F.element_at(a, -1)["used"] + GAP) + x["size"]
        kept = F.struct(x["place"].cast("long").alias("place"), (F.size(a) + 1).alias("citation"), used.cast("int").alias("used"))
        return F.when(used <= budget, F.concat(a, F.array(kept))).otherwise(a)

    return ordered.select(group, F.inline(F.aggregate("all", empty, step))).withColumnRenamed("place", place)


def context_block(citation: Column) -> Column:
    """Text of one piece of evidence."""
    head = F.concat(F.lit("["), citation.cast("string"), F.lit("] "), F.col("file_path"), F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    return F.concat_ws("\n", head, F.concat(F.lit("Type: "), F.col("entity_type")), F.concat(F.lit("Name: "), F.col("qualified_name")), F.lit("Code:"), F.coalesce("content", F.lit("")))


def edge_lines(edges: DataFrame, names: DataFrame) -> DataFrame:
    """One line for each edge whose ends are both among ``names`` (entity_id, qualified_name)."""
    out = edges
    for side in ("source", "target"):
        out = out.join(names.select(F.col("entity_id").alias(f"{side}_id"), F.col("qualified_name").alias(f"{side}_name")), f"{side}_id")
    line = F.concat(F.col("source_name"), F.lit(" -["), F.col("relation_type"), F.lit(" confidence="), F.col("confidence").cast("string"), F.lit("]-> "), F.col("target_name"))
    return out.select("relation_id", line.alias("line"))


def memory_window(messages: DataFrame, group: str, place: str, role: str = "role", text: str = "text") -> DataFrame:
    """The last messages of each conversation, cut to a limit each and in all."""
    w = Window.partitionBy(group).orderBy(F.desc(place))
    last = messages.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= MEMORY_MESSAGES)
    line = F.concat(F.initcap(role), F.lit(": "), truncate(F.trim(F.coalesce(F.col(text), F.lit(""))), MESSAGE_CHARS))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), line.alias("line")))), lambda x: x["line"])
    whole = F.concat(F.lit("Conversation context (not code evidence):\n"), F.array_join(lines, "\n"))
    return last.groupBy(group).agg(truncate(whole, MEMORY_CHARS).alias("memory"))


def search_history(searches: DataFrame, most: int = 20) -> DataFrame:
    """The latest searches (project_id, query, searched_at), each project and query once whatever its case, with place from 1; at most ``most``.

    Blank queries and projects that aren't positive are left out.
    """
    text = F.trim("query")
    rows = searches.filter((F.col("project_id") > 0) & (text != "")).withColumn("query", text)
    one = Window.partitionBy("project_id", F.lower("query")).orderBy(F.desc("searched_at"), F.desc("query"))
    latest = rows.withColumn("again", F.row_number().over(one)).filter("again = 1").drop("again")
    kept = latest.orderBy(F.desc("searched_at"), "project_id", "query").limit(most)
    return kept.withColumn("place", F.row_number().over(Window.orderBy(F.desc("searched_at"), "project_id", "query")))


def visible_history(history: DataFrame, project_id: int, most: int = 8) -> DataFrame:
    """What is shown of a history: the current project's searches first, each part in its order."""
    order = Window.orderBy(F.when(F.col("project_id") == project_id, 0).otherwise(1), "place")
    return history.withColumn("shown", F.row_number().over(order)).filter(F.col("shown") <= most)


def project_page(projects: DataFrame, term: str = "", sort: str = "manual", page: int = 1, size: int = 10) -> DataFrame:
    """A page of the projects whose name or root holds ``term``: in manual order, by id, by name or by last scan (newest first)."""
    text = F.lower(F.concat_ws(" ", "name", "root_path"))
    found = projects.filter(F.contains(text, F.lit(term.strip().lower())))
    orders = {"id": ["id"], "name": ["name", "id"], "scan": [F.desc_nulls_last("last_scan_at"), "sort_order", "id"], "manual": ["sort_order", "id"]}
    return found.orderBy(*orders[sort if sort in orders else "manual"]).offset((page - 1) * size).limit(size)


def citations(answer: Column) -> Column:
    """Numbers cited as [n], in order."""
    return F.transform(F.regexp_extract_all(answer, F.lit(CITATION), 1), lambda x: x.cast("int"))


def invalid_citations(answer: Column, allowed: Column) -> Column:
    """Cited numbers that aren't allowed, each once, in order of first use."""
    return F.array_distinct(F.filter(citations(answer), lambda c: ~F.array_contains(allowed, c)))


def locations(answer: Column) -> Column:
    """array<struct<text, path, first, last>> of paths with folders, then of plain file names outside these."""
    foldered = F.regexp_extract_all(answer, F.lit(f"({FOLDER_PATH}{LINES})"), 1)
    plain = F.regexp_extract_all(F.regexp_replace(answer, f"{FOLDER_PATH}{LINES}", "\u0001"), F.lit(f"({FILE_NAME}{LINES})"), 1)

    def read(x: Column) -> Column:
        first = F.nullif(F.regexp_extract(x, r":(\d+)(?:-\d+)?$", 1), F.lit("")).cast("int")
        last = F.coalesce(F.nullif(F.regexp_extract(x, r":\d+-(\d+)$", 1), F.lit("")).cast("int"), first)
        return F.struct(x.alias("text"), F.regexp_replace(x, r":\d+(?:-\d+)?$", "").alias("path"), first.alias("first"), last.alias("last"))

    return F.transform(F.concat(foldered, plain), read)


def supported(location: Column, references: Column) -> Column:
    """Whether some reference (file_path, start_line, end_line) has the location's path, or its bare name, and lines."""
    path = normalize_evidence_path(location["path"])

    def holds(r: Column, lines: bool) -> Column:
        own = normalize_evidence_path(r["file_path"])
        same = (own == path) | (~F.contains(path, F.lit("/")) & (F.element_at(F.split(own, "/"), -1) == path))
        return same & (location["first"].isNull() | ((r["start_line"] <= location["first"]) & (location["last"] <= r["end_line"]))) if lines else same

    return F.exists(references, lambda r: holds(r, False)) & F.exists(references, lambda r: holds(r, True))


def invalid_paths(answer: Column, references: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(locations(answer), lambda x: ~F.coalesce(supported(x, references), F.lit(False))), lambda x: x["text"]))


def validate_answers(answers: DataFrame) -> DataFrame:
    """Adds invalid_citations, invalid_paths, is_valid and uncertainties to rows with answer and
    references array<struct<citation, file_path, start_line, end_line>>."""
    out = answers.withColumn("invalid_citations", invalid_citations(F.col("answer"), F.transform("references", lambda r: r["citation"])))
    out = out.withColumn("invalid_paths", invalid_paths(F.col("answer"), F.col("references")))
    notes = F.concat(
        F.transform("invalid_citations", lambda c: F.format_string("Answer cited unsupported reference [%d].", c)),
        F.transform("invalid_paths", lambda p: F.concat(F.lit("Answer mentioned unsupported file evidence: "), p, F.lit("."))),
    )
    return out.withColumn("is_valid", (F.size("invalid_citations") == 0) & (F.size("invalid_paths") == 0)).withColumn("uncertainties", notes)


def grounded_files(planned: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) planned files (plan_id, place, entity_id, file_path): kept are in the evidence, each once."""
    known = evidence.select("plan_id", "entity_id", "file_path").distinct()
    keys = ["plan_id", "entity_id", "file_path"]
    first = Window.partitionBy(*keys).orderBy("place")
    kept = planned.join(known, keys, "left_semi").withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")
    return kept, planned.join(known, keys, "left_anti")


#: Lines of a bin in which ranges of one file meet.
BIN_LINES = 512


def range_supported(cited: DataFrame, gold: DataFrame) -> DataFrame:
    """Cited ranges (file_path, start_line, end_line) that overlap a gold range of the same file.

    Of the gold ranges that begin up to a cited range's end, the one that ends last decides.  So gold ranges lie in
    the bin of their first line and cited ones in that of their last: inside a bin a running maximum along the lines
    finds that end, and of the bins before one number each is enough.  No two ranges are paired, and a file with very
    many is spread over its bins.  Ranges without a path or a line overlap nothing.
    """
    place = lambda c: F.floor(F.col(c) / BIN_LINES)
    row = F.struct(*[F.col(f"`{c}`") for c in cited.columns])
    asked = cited.filter(F.col("start_line").isNotNull()).select(F.col("file_path").alias("path"), F.col("end_line").cast("long").alias("line"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("end"), row.alias("row"))
    given = gold.groupBy(F.col("file_path").alias("path"), F.col("start_line").cast("long").alias("line")).agg(F.max(F.col("end_line").cast("long")).alias("end"))
    given = given.select("path", "line", F.lit(0).alias("kind"), "end", F.lit(None).cast(asked.schema["row"].dataType).alias("row"))
    both = given.unionByName(asked).filter(F.col("path").isNotNull() & F.col("line").isNotNull()).withColumn("bin", place("line"))
    bins = both.groupBy("path", "bin").agg(F.max("end").alias("most"))
    before = Window.partitionBy("path").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select("path", "bin", F.max("most").over(before).alias("before"))
    inside = Window.partitionBy("path", "bin").orderBy("line", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("within", F.max("end").over(inside)).filter("kind = 1").join(bins, ["path", "bin"])
    return found.filter(F.greatest("within", "before") >= F.col("row.start_line")).select("row.*")
