"""The engine: projects, indexing, search, graph and question answering behind one object."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schema
from tessera.functions.api_path import normalize_api_path
from tessera.functions.scalars import CHANGE_WORDS, TRACE_WORDS
from tessera.operators import adjacency, context, graph, parsing, relations, search, stats, term_index, vector_index
from tessera.operators.adjacency import Adjacency
from tessera.plans.providers import Complete, Embed, embed_chunks, embed_with_cache, hash_embedder, rewrite_query
from tessera.schema import DomainError
from tessera.sources.files import scan
from tessera.sources.log import AppendLog
from tessera.sources.marks import drop_path
from tessera.sources.store import Store, check_vectors, numbered

NO_EVIDENCE = "No supporting code evidence was found."
REFUSED = "The model answer did not pass evidence validation, so it was not returned."
GRAPH_UNAVAILABLE = "Graph relationship retrieval was unavailable; only direct search evidence was used."
CATALOG = "catalog"
MESSAGE = "conversation_id long, role string, content string, task_type string, metadata_json string, created_at timestamp"


class Engine:
    """Every method raises :class:`DomainError` with the codes of the API; reads return DataFrames or small dicts."""

    def __init__(self, spark: SparkSession, root: str, embed: Embed | None = None, complete: Complete | None = None, embed_model: str | None = None) -> None:
        """``embed_model`` names what ``embed`` computes; with a name, embeddings are cached by text across projects and builds."""
        self.embed_model = embed_model
        self.spark, self.store = spark, Store(spark, root)
        self.embed, self.complete = embed or hash_embedder(), complete
        self.tools = {"hybrid_search": self.hybrid, "graph_search": self.search_chain, "read_entity": self.read_entity, "get_related_entities": self.related}

    # -- projects --

    def _projects(self) -> list[dict]:
        if not self.store.has(CATALOG, "projects"):
            return []
        return [r.asDict() for r in self.store.read(CATALOG, "projects").collect()]

    def _change(self, change: Callable[[list[dict]], list[dict]]) -> list[dict]:
        """Replace the catalog by ``change`` of it, which is asked again if another writer was first; returns the new rows."""
        while True:
            expected = self.store.version(CATALOG)
            rows = change(self._projects())
            table = self.spark.createDataFrame([tuple(r.values()) for r in rows], schema.PROJECTS)
            try:
                self.store.publish(CATALOG, {"projects": table}, expected=expected)
                return rows
            except DomainError as e:
                if e.code != "WRITE_CONFLICT":
                    raise

    def list_projects(self) -> list[dict]:
        return sorted(self._projects(), key=lambda p: (p["sort_order"], p["id"]))

    def project(self, project_id: int) -> dict:
        for p in self._projects():
            if p["id"] == project_id:
                return p
        raise DomainError("PROJECT_NOT_FOUND", f"Project {project_id} does not exist.", 404)

    def create_project(self, name: str, root_path: str) -> dict:
        """A new project stands first; the others move down by one."""
        if not 1 <= len(name) <= 200 or not root_path:
            raise DomainError("INVALID_ROOT_PATH", "A project needs a name and a root.", 422)
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        new = {"name": name, "root_path": root_path, "status": "created", "sort_order": 0, "last_scan_at": None, "created_at": now, "updated_at": now}

        def added(rows: list[dict]) -> list[dict]:
            if any(p["root_path"] == root_path for p in rows):
                raise DomainError("PROJECT_ROOT_EXISTS", f"{root_path} is a project already.", 409)
            return [{"id": max([0, *(p["id"] for p in rows)]) + 1, **new}, *({**p, "sort_order": p["sort_order"] + 1} for p in rows)]

        return self._change(added)[0]

    def reorder_projects(self, ids: Sequence[int]) -> list[dict]:
        def ordered(rows: list[dict]) -> list[dict]:
            if sorted(ids) != sorted(p["id"] for p in rows):
                raise DomainError("PROJECT_ORDER_CONFLICT", "The order must name each project once.", 409)
            return [{**p, "sort_order": list(ids).index(p["id"])} for p in rows]

        self._change(ordered)
        return self.list_projects()

    def delete_project(self, project_id: int) -> None:
        """Vectors go first: if that fails, the rows stay."""
        self.project(project_id)
        try:
            self.store.delete(f"vectors-{project_id}")
        except Exception as e:
            raise DomainError("VECTOR_STORE_DELETE_FAILED", str(e), 502) from e
        self.store.delete(project_id)
        drop_path(self.spark, f"{self.store.root}/logs/messages-{project_id}")
        self._change(lambda rows: [p for p in rows if p["id"] != project_id])

    def _update(self, project_id: int, **values) -> None:
        self._change(lambda rows: [{**p, **values} if p["id"] == project_id else p for p in rows])

    # -- indexing --

    def scan_project(self, project_id: int) -> dict:
        """Read, parse, relate and publish a project; on failure the old index stays and the status says so."""
        project = self.project(project_id)
        with self.store.scanning(project_id):
            try:
                summary = self._index(project_id, project["root_path"])
            except Exception:
                self._update(project_id, status="failed")
                raise
            self._update(project_id, status="ready", last_scan_at=datetime.now(timezone.utc).replace(tzinfo=None))
            return summary

    def _index(self, project_id: int, root: str) -> dict:
        levels: list[DataFrame] = []

        def settle(df: DataFrame) -> DataFrame:
            levels.append(self.store.settle(df))
            return levels[-1]

        files, issues = scan(self.spark, root, project_id, settle=settle)
        files, issues = self.store.settle(files), self.store.settle(issues)
        parsed = self.store.settle(parsing.parse_files(files))
        requests = parsed.select(F.inline("requests"))
        calls, warnings = parsing.resolve_requests(requests, *parsing.catalogs(parsed))
        found = parsed.select(F.inline("entities")).unionByName(calls)
        # one numbering over a project's entities, in the order of their keys, the last of each key
        keyed = relations.last_of_each(found.withColumn("ordinal", F.col("start_line")))
        entities = numbered(self.store, keyed.drop("ordinal").withColumn("project_id", F.lit(project_id).cast("long")), "id", "local_key")
        edges = relations.resolve_ends(relations.derive(entities, parsed.select(F.inline("relations"))), entities)
        edges = numbered(self.store, edges.withColumn("project_id", F.lit(project_id).cast("long")), "id", "source_id", "target_id", "relation_type")
        folder = self.store.folder(project_id)
        written = {t: f"{folder}/{t}" for t in ("term_rows", "term_postings")}
        term_index.build(entities.withColumnRenamed("id", "entity_id").select(*search.HIT, "project_id"), *written.values())
        written["adjacency"] = f"{folder}/adjacency"
        adjacency.build(self.spark, entities.withColumnRenamed("id", "entity_id"), edges.withColumnRenamed("id", "relation_id"), written["adjacency"]).close()
        names = ["project_id", "id", *(x.split()[0] for x in schema.ENTITY.split(", "))]
        extra = warnings.unionByName(parsing.parse_errors(parsed)).withColumn("project_id", F.lit(project_id).cast("long"))
        self.store.publish(
            project_id,
            {
                "files": files, "entities": entities.select(*names), "issues": issues.unionByName(extra),
                "relations": edges.select("project_id", "id", "source_id", "target_id", "relation_type", "confidence", "metadata_json"),
            },
            written=written,
        )
        self.store.unsettle(files, issues, parsed, entities, edges, *levels)
        read = [self.store.read(project_id, t) for t in ("files", "entities", "relations", "issues")]
        return stats.scan_summary(*read).first().asDict() | {"issues_indexed": read[3].count()}

    def _read(self, project_id: int, table: str) -> DataFrame:
        self.project(project_id)
        return self.store.read(project_id, table)

    def _walkable(self, project_id: int) -> Adjacency:
        """The project's edges from both ends, by node."""
        self.project(project_id)
        return Adjacency.at(self.spark, self.store.path(project_id, "adjacency"))

    def entities(self, project_id: int) -> DataFrame:
        return self._read(project_id, "entities").withColumnRenamed("id", "entity_id")

    def edges(self, project_id: int) -> DataFrame:
        return self._read(project_id, "relations").withColumnRenamed("id", "relation_id")

    def project_stats(self, project_id: int) -> dict:
        return stats.project_stats(*(self._read(project_id, t) for t in ("files", "entities", "relations", "issues"))).first().asDict()

    def request_diagnostics(self, project_id: int, limit: int = 10) -> dict:
        if not 1 <= limit <= 50:
            raise ValueError("limit must be 1 to 50")
        calls = self.entities(project_id).filter("entity_type = 'frontend_api_call'").select(F.col("entity_id").alias("call_id"))
        made = self.edges(project_id).filter("relation_type = 'REQUESTS_API'")
        out = stats.matched_calls(calls, made).first().asDict()
        unresolved = self._read(project_id, "issues").filter("issue_type = 'analysis_warning'")
        out["unresolved"] = unresolved.count()
        out["unmatched_examples"] = [r.call_id for r in stats.unmatched_calls(calls, made, limit).collect()]
        out["unresolved_examples"] = [r.asDict() for r in unresolved.orderBy("file_path", "reason_code").limit(limit).collect()]
        return out

    def read_entity(self, project_id: int, entity_id: int) -> dict:
        found = self.entities(project_id).filter(F.col("entity_id") == entity_id).head(1)
        if not found:
            raise DomainError("ENTITY_NOT_FOUND", f"Entity {entity_id} does not exist.", 404)
        return found[0].asDict()

    # -- search --

    def vector_index_ready(self, project_id: int) -> bool:
        self.project(project_id)
        return self.store.has(f"vectors-{project_id}")

    def build_vector_index(self, project_id: int) -> int:
        chunks = self.entities(project_id).select("entity_id", search.chunk_text().alias("chunk"))
        try:
            made = embed_chunks(chunks, self.embed) if self.embed_model is None else embed_with_cache(chunks, self.embed, self.store, self.embed_model)
            vectors = self.store.settle(made)
            n = chunks.count()
            check_vectors(vectors, n)
        except Exception as e:
            raise DomainError("EMBEDDING_REQUEST_FAILED", str(e), 502) from e
        folder = self.store.folder(f"vectors-{project_id}")
        written = {t: f"{folder}/{t}" for t in ("vectors", "cells")}
        vector_index.build(vectors, *written.values())
        self.store.publish(f"vectors-{project_id}", {}, written=written)
        self.store.unsettle(vectors)
        return n

    def keyword(self, project_id: int, query: str, limit: int = 10) -> DataFrame:
        if not query or not 1 <= limit <= 50:
            raise ValueError("a query and a limit of 1 to 50 are needed")
        rows, postings = (self._read(project_id, t) for t in ("term_rows", "term_postings"))
        return term_index.TermIndex(rows, postings).search(query, limit)

    def _few(self, hits: DataFrame) -> DataFrame:
        """A branch's hits, at most its limit, as local rows: computed once, nothing stays cached."""
        return self.spark.createDataFrame(hits.select("entity_id", "score").collect(), "entity_id long, score double")

    def hybrid(self, project_id: int, query: str, limit: int = 10) -> DataFrame:
        """Both branches with twice the limit, fused; one branch failing degrades, both failing is an error."""
        query = rewrite_query(query, self.complete)
        if not self.vector_index_ready(project_id):
            raise DomainError("VECTOR_INDEX_NOT_FOUND", f"Project {project_id} has no vector index.", 409)
        entities = self.entities(project_id)
        vector, keyword, failed = None, None, []
        try:
            literal = self.embed([query])[0]
            cells = vector_index.VectorIndex(*(self.store.read(f"vectors-{project_id}", t) for t in ("vectors", "cells")))
            vector = self._few(cells.search(literal, 2 * limit))
        except DomainError:
            raise
        except Exception as e:
            failed.append(f"vector: {e}")
            vector = None
        try:
            keyword = self._few(self.keyword(project_id, query, min(50, 2 * limit)).select("entity_id", "score"))
        except DomainError:
            raise
        except Exception as e:
            failed.append(f"keyword: {e}")
            keyword = None
        if vector is None and (keyword is None or not keyword.head(1)) or keyword is None and not vector.head(1):
            raise DomainError("RETRIEVAL_UNAVAILABLE", "; ".join(failed), 503)
        source = "hybrid" if not failed else "keyword_fallback" if vector is None else "vector_fallback"
        hits = search.weighted_fusion(vector, keyword, limit) if not failed else search.top(keyword if vector is None else vector, limit)
        notes = F.array(*[F.lit(x) for x in failed]).cast("array<string>")
        return entities.join(F.broadcast(hits), "entity_id").withColumn("source", F.lit(source)).withColumn("uncertainties", notes).orderBy(F.desc("score"), "entity_id")

    # -- graph --

    def api_chain(self, project_id: int, method: str, path: str) -> tuple[DataFrame, DataFrame]:
        entities = self.entities(project_id)
        meta = lambda k: F.get_json_object("metadata_json", f"$.{k}")
        apis = entities.filter("entity_type = 'backend_api'").select("entity_id", meta("http_method").alias("http_method"), meta("normalized_path").alias("normalized_path"))
        seeds = graph.api_matches(apis, method, normalize_api_path(path)).select(F.col("entity_id").alias("seed_id"), F.col("entity_id").alias("place"))
        if not seeds.head(1):
            raise DomainError("API_NOT_FOUND", f"{method.upper()} {path} is not indexed.", 404)
        return graph.merge(graph.traverse(entities, self._walkable(project_id), seeds, 2, schema.CHAIN_TYPES), seeds)

    def related(self, project_id: int, entity_id: int, depth: int = 1) -> tuple[DataFrame, DataFrame]:
        entities = self.entities(project_id)
        graph.require_entity(entities, entity_id)
        seed = self.spark.createDataFrame([(entity_id,)], "seed_id long")
        return graph.traverse(entities, self._walkable(project_id), seed, depth)

    def search_chain(self, project_id: int, query: str, limit: int = 5, max_depth: int = 2) -> tuple[DataFrame, DataFrame]:
        if not 1 <= limit <= 20 or not 1 <= max_depth <= 2:
            raise ValueError("limit must be 1 to 20 and depth 1 or 2")
        hits = [r.entity_id for r in self.hybrid(project_id, query, limit).select("entity_id").collect()]
        seeds = self.spark.createDataFrame(list(enumerate(dict.fromkeys(hits))), "place long, seed_id long").select("seed_id", "place")
        return graph.merge(graph.traverse(self.entities(project_id), self._walkable(project_id), seeds, max_depth), seeds)

    # -- answers --

    @staticmethod
    def plan(question: str) -> str:
        text = " ".join(question.casefold().split())
        if not text:
            raise ValueError("the question must not be blank")
        if any(w in text for w in CHANGE_WORDS):
            return "CHANGE_PLAN"
        return "TRACE_CHAIN" if any(w in text for w in TRACE_WORDS) else "CODE_QA"

    @staticmethod
    def _walked(entities: DataFrame, edges: DataFrame, hits: DataFrame) -> list:
        """What the graph reaches from hits (entity_id, score), with the entities' columns: a bounded number of rows."""
        ranked = graph.graph_rag(entities, edges, hits)
        return ranked.join(entities, "entity_id").orderBy("graph_depth", F.desc("retrieval_score"), "entity_id").collect()

    def _walked_apart(self, entities: DataFrame, edges: DataFrame, hits: DataFrame) -> tuple[list, set[int]]:
        """:meth:`_walked` hit by hit, each entity once, and the hits whose walk failed: they stay direct evidence."""
        found, failed = [], set()
        for hit in hits.orderBy(F.desc("score"), "entity_id").collect():
            own = hits.filter(F.col("entity_id") == hit["entity_id"])
            try:
                found += self._walked(entities, edges, own.select("entity_id", "score"))
            except Exception:
                failed.add(hit["entity_id"])
                direct = own.withColumn("seed_id", F.col("entity_id")).withColumn("graph_depth", F.lit(0)).withColumn("retrieval_score", F.col("score"))
                found += direct.withColumn("relation_reason", F.lit("direct hybrid-search hit")).collect()
        first: dict = {}
        for r in sorted(found, key=lambda r: (r["graph_depth"], -r["retrieval_score"], r["seed_id"])):
            first.setdefault(r["entity_id"], r)
        kept = sorted(first.values(), key=lambda r: (r["graph_depth"], -r["retrieval_score"], r["entity_id"]))
        return kept[: graph.MAX_RESULTS], failed

    def _evidence(self, project_id: int, question: str, limit: int, walk: bool) -> tuple[str, list[dict], list[str]]:
        """(context, references, uncertainties): hits, or what the graph reaches from them, within the budget."""
        hits = self.hybrid(project_id, question, limit)
        entities = self.entities(project_id)
        notes = []
        if walk:
            edges = self.edges(project_id)
            try:
                rows = self._walked(entities, edges, hits.select("entity_id", "score"))
            except Exception:  # one hit's walk may fail without the others'
                rows, failed = self._walked_apart(entities, edges, hits)
                notes = [GRAPH_UNAVAILABLE] if failed else []
                edges = None if len(failed) == len({r.seed_id for r in rows}) else edges
        if walk and edges is not None:
            ids = {r.entity_id for r in rows}
            inside = edges.filter(F.col("source_id").isin(*ids) & F.col("target_id").isin(*ids)) if ids else edges.limit(0)
            notes += [f"No stored {r.relation_type} edge was found; its relationship cannot be determined from indexed code." for r in graph.missing_relation_types(inside).orderBy("place").collect()]
        if not walk:
            rows = hits.collect()
        blocks, refs, used = [], [], 0
        for r in rows:
            head = f"[{len(refs) + 1}] {r.file_path}:{r.start_line}-{r.end_line}\nType: {r.entity_type}\nName: {r.qualified_name}\n"
            if walk:
                head += f"Retrieval score: {r.retrieval_score}\nGraph depth: {r.graph_depth}\nRelation reason: {r.relation_reason}\n"
            block = f"{head}Code:\n{r.content}"
            size = used + (context.GAP if blocks else 0) + len(block)
            if size > context.BUDGET:
                if walk:
                    continue
                break
            blocks.append(block)
            refs.append({"citation": len(refs) + 1, "entity_id": r.entity_id, "file_path": r.file_path, "start_line": r.start_line, "end_line": r.end_line, "qualified_name": r.qualified_name})
            used = size
        if walk and refs and edges is not None:
            kept = self.spark.createDataFrame([(r["entity_id"], r["qualified_name"]) for r in refs], "entity_id long, qualified_name string")
            lines = [x.line for x in context.edge_lines(edges, kept).orderBy("relation_id").collect()]
            section = "\n".join(["Stored graph edges (authoritative):", *lines])
            if lines and used + context.GAP + len(section) <= context.BUDGET:
                blocks.append(section)
        return "\n\n".join(blocks), refs, notes

    def _checked(self, answer: str, refs: list[dict]) -> list[str]:
        row = self.spark.createDataFrame([(answer, [(r["citation"], r["file_path"], r["start_line"], r["end_line"]) for r in refs])], "answer string, references array<struct<citation:int,file_path:string,start_line:int,end_line:int>>")
        return list(context.validate_answers(row).first()["uncertainties"])

    def _answer(self, task: str, project_id: int, question: str, limit: int, memory: str = "") -> dict:
        text, refs, notes = self._evidence(project_id, question, limit, task != "CODE_QA")
        out = {"task_type": task, "references": refs, "uncertainties": notes, "answer": NO_EVIDENCE}
        if not refs:
            return out
        if self.complete is None:
            raise DomainError("LLM_REQUEST_FAILED", "No language model is configured.", 502)
        asked = f"{memory}\n\nCurrent question:\n{question}" if memory else question
        prompt = f"{asked}\n\nEvidence:\n{text}"
        problems: list[str] = []
        for _ in range(2):  # the answer and at most one repair
            try:
                answer = self.complete(f"Answer as {task} from the evidence only; cite it as [n].", prompt)
            except Exception as e:
                raise DomainError("LLM_REQUEST_FAILED", str(e), 502) from e
            files = None
            if task == "CHANGE_PLAN":
                answer, files, dropped = self._plan_answer(answer, refs)
                notes = [*notes, *dropped]
            problems = self._checked(answer, refs)
            if not problems:
                out |= {"answer": answer, "uncertainties": list(dict.fromkeys(notes))}
                if files is not None:
                    out["affected_files"] = files
                limits = [n for n in out["uncertainties"] if n.startswith("No stored ") and "edge was found" in n and "cannot be determined from indexed code" in n]
                if task == "TRACE_CHAIN" and limits:
                    out["answer"] += "\n\nIndexed relationship limits:\n" + "\n".join(f"- {n}" for n in limits)
                return out
            prompt = f"{prompt}\n\nThe last answer was rejected:\n" + "\n".join(problems)
        return out | {"answer": REFUSED, "uncertainties": [*notes, *problems, "Evidence validation repair limit reached."]}

    @staticmethod
    def _plan_answer(answer: str, refs: list[dict]) -> tuple[str, list[dict], list[str]]:
        """(text, grounded files, notes) of a change plan's JSON; files outside the evidence are dropped."""
        import re

        try:
            plan = json.loads(re.sub(r"^```(?:json)?\s*|\s*```$", "", answer.strip()))
            wanted = plan["affected_files"]
            summary = str(plan["summary"])
        except (ValueError, KeyError, TypeError) as e:
            raise DomainError("CHANGE_PLAN_RESPONSE_INVALID", "The language model returned an invalid change-plan response.", 502) from e
        known = {(r["entity_id"], r["file_path"]) for r in refs}
        files, notes = {}, []
        for f in wanted:
            value = f.get("entity_id")
            if isinstance(value, str):
                number = re.search(r"(\d+)\s*$", value)
                named = {r["entity_id"] for r in refs if r["file_path"] == f.get("file_path") and r["qualified_name"].casefold() in value.casefold()}
                value = int(number[1]) if number else named.pop() if len(named) == 1 else None
            key = (value, f.get("file_path"))
            if key in known:
                files.setdefault(key, {**f, "entity_id": value})
            else:
                notes.append(f"Ungrounded file {f.get('file_path')} (entity {f.get('entity_id')}) was removed from the change plan.")
        return summary, list(files.values()), notes

    def code_qa(self, project_id: int, question: str, limit: int = 5) -> dict:
        return self._answer("CODE_QA", project_id, question, limit)

    def trace(self, project_id: int, question: str, limit: int = 5) -> dict:
        return self._answer("TRACE_CHAIN", project_id, question, limit)

    def change_plan(self, project_id: int, question: str, limit: int = 5) -> dict:
        return self._answer("CHANGE_PLAN", project_id, question, limit)

    # -- conversations --

    def _titles(self) -> AppendLog:
        """Conversations of all projects: an id is a place in one log, so no two projects have one."""
        return AppendLog(self.spark, self.store.root, "conversations", "project_id long, title string, created_at timestamp")

    def _messages(self, project_id: int) -> AppendLog:
        return AppendLog(self.spark, self.store.root, f"messages-{project_id}", MESSAGE, ["conversation_id"])

    def _own_messages(self, project_id: int, conversation_id: int) -> DataFrame:
        """A conversation's messages; an unknown conversation, or another project's, is an error."""
        self.project(project_id)
        found = self._titles().read(F.col("ordinal") == conversation_id).head(1)
        own = self._messages(project_id).read(F.col("conversation_id") == conversation_id).withColumnRenamed("ordinal", "id")
        if found and found[0]["project_id"] != project_id:
            raise DomainError("CONVERSATION_PROJECT_MISMATCH", "The conversation belongs to another project.", 409)
        if not found or not own.head(1):  # one whose first exchange was never saved doesn't exist
            raise DomainError("CONVERSATION_NOT_FOUND", f"Conversation {conversation_id} does not exist.", 404)
        return own

    def conversation(self, project_id: int, conversation_id: int) -> dict:
        own = self._own_messages(project_id, conversation_id).orderBy("created_at", "id").select(*(c.split()[0] for c in schema.MESSAGES.split(", "))).collect()
        about = self._titles().read(F.col("ordinal") == conversation_id).first()
        return {"id": conversation_id, "project_id": project_id, "title": about["title"], "created_at": about["created_at"], "updated_at": own[-1]["created_at"], "messages": [m.asDict() for m in own]}

    def save_exchange(self, project_id: int, question: str, result: dict, conversation_id: int | None = None) -> int:
        """Both messages in one append; a new conversation is titled by the question's first 80 characters."""
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        about = json.dumps({k: v for k, v in result.items() if k != "answer"}, ensure_ascii=False, sort_keys=True, default=str)
        number = self._titles().append([(project_id, question[:80], now)]) if conversation_id is None else conversation_id
        self._messages(project_id).append([(number, "user", question, None, "{}", now), (number, "assistant", result["answer"], result.get("task_type"), about, now)])
        return number

    def chat(self, project_id: int, question: str, conversation_id: int | None = None, limit: int = 5) -> dict:
        """Route a question, answer it with the conversation's last messages in mind, and save the exchange."""
        memory = ""
        if conversation_id is not None:
            last = self._own_messages(project_id, conversation_id).orderBy(F.desc("created_at"), F.desc("id")).limit(context.MEMORY_MESSAGES)
            rows = last.select(F.col("conversation_id").alias("c"), "id", "role", F.col("content").alias("text"))
            memory = context.memory_window(rows, "c", "id").first()["memory"]
        result = self._answer(self.plan(question), project_id, question, limit, memory)
        return result | {"conversation_id": self.save_exchange(project_id, question, result, conversation_id)}
