import json
import threading
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tessera.functions.scalars import IGNORED_FOLDERS
from tessera.operators import evaluation, graph
from tessera.plans.engine import REFUSED, Engine
from tessera.plans.providers import hash_embedder
from tessera.schema import DomainError
from tessera.sources import places
from tessera.sources import store as store_module
from tessera.sources import tree as tree_module
from tessera.sources.files import scan
from tessera.sources.log import FAN, RESPONSES, ResponseLog
from tests import project


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    return project.write(tmp_path_factory.mktemp("tree"))


@pytest.fixture(scope="module")
def engine(spark, tree, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("store")))
    e.create_project("demo", str(tree))
    e.summary = e.scan_project(1)
    return e


def test_scan_reads_and_skips(spark, tree):
    files, issues = scan(spark, str(tree), 1, max_bytes=4000)
    got = {r.file_path: r for r in files.collect()}
    assert set(got) == {n for n in project.FILES if n not in ("node_modules/skip.js", "notes.txt")} | {"bom.json"}
    assert got["bom.json"].content == "{}\r\n{}\n" and got["bom.json"].line_count == 2 and got["bom.json"].size_bytes == 10
    assert got["frontend/src/api.ts"].language == "typescript"
    assert {(r.file_path, r.reason_code) for r in issues.collect()} == {("big.sql", "FILE_TOO_LARGE"), ("nul.json", "BINARY_FILE"), ("latin.xml", "DECODE_ERROR"), ("link.py", "SYMLINK_FILE")}
    with pytest.raises(DomainError):
        scan(spark, str(tree / "nowhere"))


def test_ignored_folders_are_never_opened(spark, tmp_path):
    for i in range(40):
        folder = tmp_path / f"a{i % 3}" / f"b{i}" / "c"
        folder.mkdir(parents=True)
        (folder / "x.py").write_text("x = 1")
        deep = folder / "node_modules" / "m" / "n"
        deep.mkdir(parents=True)
        (deep / "y.js").write_text("")
    (tmp_path / "loop").symlink_to(tmp_path)
    (tmp_path / "build").write_text("a file of an ignored folder's name")
    for at_once in (1000, 7):
        levels = tree_module.entries(spark, str(tmp_path), IGNORED_FOLDERS, lambda df: places.settled(df, "listing"), at_once)
        assert (len(levels) == 1) == (at_once == 1000)
        assert tree_module.all_of(levels, "folder").count() == 1 + 3 + 40 + 40  # the root, a, b and c; nothing below node_modules
        assert sorted(r.file_path for r in tree_module.all_of(levels, "file").collect()) == sorted([*(f"a{i % 3}/b{i}/c/x.py" for i in range(40)), "build"])
        assert [r.file_path for r in tree_module.all_of(levels, "link").collect()] == ["loop"]


def test_rounds_of_a_listing_follow_depth_not_folders(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"b{i}" / "c").mkdir(parents=True)
        (tmp_path / f"b{i}" / "c" / "x.py").write_text("x = 1")
    levels = tree_module.entries(spark, str(tmp_path), IGNORED_FOLDERS, lambda df: places.settled(df, "listing"), 7)
    assert len(levels) == 3
    assert tree_module.all_of(levels, "folder").select("file_path").distinct().count() == tree_module.all_of(levels, "folder").count() == 1 + 2 * 300
    assert tree_module.all_of(levels, "file").count() == 300


def test_entities_of_every_kind(engine):
    rows = engine.entities(1).collect()
    by = {}
    for r in rows:
        by.setdefault(r.entity_type, {})[r.qualified_name] = r
    assert set(by["java_class"]) == {"OrderController", "OrderController.Inner", "OrderService", "StockService"}
    assert set(by["java_method"]) == {"OrderController.find", "OrderController.search", "OrderController.create", "OrderController.Inner.size", "OrderService.findById", "OrderService.all", "StockService.touch"}
    assert set(by["backend_api"]) == {
        "GET /api/orders/{id}", "GET /v2/orders/{id}", "POST /api/orders/search", "PUT /api/orders/search", "POST /v2/orders/search", "PUT /v2/orders/search", "POST /api/orders", "POST /v2/orders",
    }
    assert set(by["python_class"]) == {"Detector"}
    assert set(by["python_function"]) == {"Detector.run", "Detector.run.inner", "Detector.wait", "top"}
    assert set(by["frontend_api_call"]) == {"GET /api/orders/${id}", "POST /api/orders/search", "DELETE /api/orders/7", "PUT /api/orders/search"}
    find = by["java_method"]["OrderController.find"]
    meta = json.loads(find.metadata_json)
    assert meta["annotations"] == ["GetMapping"] and meta["return_type"] == "Order" and meta["declaring_class"] == "OrderController"
    assert meta["invocations"] == [{"method": "touch", "qualifier": "stock", "receiver_type": "StockService"}, {"method": "findById", "qualifier": "service", "receiver_type": "OrderService"}]
    assert (find.start_line, find.end_line) == (18, 22) and find.content.startswith("@GetMapping")
    run = by["python_function"]["Detector.run"]
    assert json.loads(run.metadata_json) == {"arguments": ["a", "b", "*rest", "c", "**more"], "decorators": ["staticmethod"], "is_async": False}
    assert json.loads(by["java_class"]["OrderController"].metadata_json)["is_controller"] is True


def test_relations_and_issues(engine):
    names = {r.entity_id: r.qualified_name for r in engine.entities(1).collect()}
    got = {(r.relation_type, names[r.source_id], names[r.target_id], r.confidence) for r in engine.edges(1).collect()}
    assert ("CALLS_METHOD", "OrderController.find", "OrderService.findById", 0.8) in got
    assert ("CALLS_METHOD", "OrderController.find", "StockService.touch", 0.8) in got
    assert ("REQUESTS_API", "GET /api/orders/${id}", "GET /api/orders/{id}", 1.0) in got
    assert ("DEFINES_API", "POST /api/orders/search", "OrderController.search", 1.0) in got
    assert ("CONTAINS", "Detector", "Detector.wait", 1.0) in got and ("CONTAINS", "Detector", "Detector.run.inner", 1.0) not in got
    reasons = sorted((r.issue_type, r.reason_code) for r in engine._read(1, "issues").collect())
    assert ("parse_error", "PARSE_ERROR") in reasons
    assert reasons.count(("analysis_warning", "FRONTEND_REQUEST_AMBIGUOUS_CONSTANT")) == 1
    assert reasons.count(("analysis_warning", "FRONTEND_REQUEST_DYNAMIC_URL")) == 3
    assert reasons.count(("analysis_warning", "FRONTEND_REQUEST_UNKNOWN_WRAPPER")) == 1
    out = engine.request_diagnostics(1)
    assert out["identified"] == 4 and out["matched"] + out["unmatched"] == 4 and out["unresolved"] == 5
    stats = engine.project_stats(1)
    assert stats["files"] == engine.summary["files_indexed"] and stats["entity_types"]["java_class"] == 4


def test_search_and_graph(engine):
    with pytest.raises(DomainError) as e:
        engine.hybrid(1, "order controller")
    assert (e.value.code, e.value.status) == ("VECTOR_INDEX_NOT_FOUND", 409)
    assert engine.build_vector_index(1) == engine.summary["entities_indexed"]
    top = engine.keyword(1, "OrderController", 5).collect()
    assert top[0].qualified_name == "OrderController" and top[0].score == 1.0
    hits = engine.hybrid(1, "OrderService findById", 5).collect()
    assert len(hits) == 5 and hits[0].source == "hybrid"
    nodes, edges = engine.api_chain(1, "get", "/api/orders/42")
    names = {r.entity_id: r.qualified_name for r in engine.entities(1).collect()}
    found = {names[r.entity_id]: r.depth for r in nodes.collect()}
    assert found["GET /api/orders/{id}"] == 0 and found["OrderController.find"] == 1 and found["OrderService.findById"] == 2
    with pytest.raises(DomainError):
        engine.api_chain(1, "get", "/nothing")
    with pytest.raises(DomainError):
        engine.read_entity(1, 10**6)
    assert engine.search_chain(1, "findById", 3)[0].count() >= 3


def test_answers_with_evidence_checks(engine):
    engine.build_vector_index(1)
    engine.complete = lambda system, prompt: "It is in [1]."
    out = engine.chat(1, "Where is findById implemented?")
    assert out["task_type"] == "CODE_QA" and out["answer"] == "It is in [1]." and out["conversation_id"] == 1
    seen = []
    engine.complete = lambda system, prompt: seen.append(prompt) or "See [99] and other/File.java:3."
    out = engine.chat(1, "trace the call chain of findById", out["conversation_id"])
    assert out["answer"] == REFUSED and len(seen) == 2 and "User: Where is findById" in seen[0]
    assert "Answer cited unsupported reference [99]." in out["uncertainties"]
    talk = engine.conversation(1, 1)
    assert [m["role"] for m in talk["messages"]] == ["user", "assistant"] * 2 and talk["title"] == "Where is findById implemented?"
    with pytest.raises(DomainError):
        engine.conversation(1, 99)

    def plan(system, prompt):
        path = prompt.split("[1] ")[1].split(":")[0]
        first = engine.hybrid(1, "change findById", 5).first()
        files = [{"entity_id": f"entity {first.entity_id}", "file_path": path, "reason": "r"}, {"entity_id": 999, "file_path": "x.py", "reason": "r"}]
        return "```json\n" + json.dumps({"summary": "Do it [1].", "affected_files": files, "risks": [], "uncertainties": []}) + "\n```"

    engine.complete = plan
    out = engine.change_plan(1, "change findById")
    assert len(out["affected_files"]) == 1 and any("x.py" in n for n in out["uncertainties"])
    engine.complete = lambda s, p: "no json"
    with pytest.raises(DomainError) as e:
        engine.change_plan(1, "change findById")
    assert e.value.code == "CHANGE_PLAN_RESPONSE_INVALID"


def test_projects(spark, tmp_path, tree):
    e = Engine(spark, str(tmp_path))
    a, b = e.create_project("a", str(tree)), e.create_project("b", str(tmp_path))
    assert [p["name"] for p in e.list_projects()] == ["b", "a"]
    with pytest.raises(DomainError):
        e.create_project("again", str(tree))
    assert [p["name"] for p in e.reorder_projects([a["id"], b["id"]])] == ["a", "b"]
    with pytest.raises(DomainError):
        e.reorder_projects([a["id"]])
    with pytest.raises(DomainError) as x:
        e.entities(a["id"])
    assert x.value.code == "PROJECT_NOT_SCANNED"
    with e.store.scanning(1), pytest.raises(DomainError) as x:
        e.scan_project(1)
    assert x.value.code == "SCAN_ALREADY_RUNNING"
    e.delete_project(a["id"])
    assert [p["name"] for p in e.list_projects()] == ["b"]
    assert e.plan("Which files need a new field?") == "CHANGE_PLAN" and e.plan("trace it") == "TRACE_CHAIN" and e.plan("hm") == "CODE_QA"


def test_failed_publication_keeps_the_old_version(spark, tmp_path):
    s = store_module.Store(spark, str(tmp_path))
    s.publish(1, {"t": spark.range(3), "u": spark.range(2)})
    from pyspark.sql import functions as F

    with pytest.raises(Exception, match="boom"):
        s.publish(1, {"t": spark.range(9).select(F.raise_error(F.lit("boom")).cast("long").alias("id"))})
    assert s.read(1, "t").count() == 3
    s.publish(1, {"t": spark.range(5)}, keep=True)
    assert (s.read(1, "t").count(), s.read(1, "u").count()) == (5, 2)


def test_versions_conflicts_and_added_rows(spark, tmp_path):
    s, other = store_module.Store(spark, str(tmp_path)), store_module.Store(spark, str(tmp_path))
    first = s.publish(1, {"t": spark.range(3), "u": spark.range(2)})
    reader = s.read(1, "t")
    assert other.publish(1, {}, more={"t": spark.range(3, 5)}, expected=first) == first + 1
    assert sorted(r.id for r in s.read(1, "t").collect()) == [0, 1, 2, 3, 4] and s.read(1, "u").count() == 2
    with pytest.raises(DomainError) as x:
        s.publish(1, {}, more={"t": spark.range(9, 10)}, expected=first)
    assert x.value.code == "WRITE_CONFLICT"
    assert reader.count() == 3  # the version it began with is still there
    for i in range(4):
        s.publish(1, {"t": spark.range(i)})
    assert s.version(1) == 6 and s.read(1, "t").count() == 3 and not s.has(1, "u")
    assert len(list((tmp_path / "data/1").glob("*/t"))) == store_module.KEPT
    with s.scanning(1), pytest.raises(DomainError), other.scanning(1):
        pass
    with other.scanning(1):
        pass


def test_numbers_follow_the_order(spark, tmp_path):
    s = store_module.Store(spark, str(tmp_path))
    df = spark.range(500).selectExpr("id", "lpad(string(pmod(id * 37, 500)), 4, '0') AS k")
    got = store_module.numbered(s, df.repartition(7), "n", "k").collect()
    assert [r.k for r in sorted(got, key=lambda r: r.n)] == [f"{i:04d}" for i in range(500)] and sorted(r.n for r in got) == list(range(1, 501))
    assert store_module.numbered(s, df.limit(0), "n", "k").count() == 0


def test_file_that_cannot_be_read_is_a_row(spark, tmp_path):
    for name in ("a.py", "b.py"):
        (tmp_path / name).write_text("x = 1\n")
    files, issues = scan(spark, str(tmp_path))
    (tmp_path / "b.py").unlink()  # listed, and gone when it is read
    assert [r.file_path for r in files.collect()] == ["a.py"]
    assert [(r.file_path, r.reason_code) for r in issues.collect()] == [("b.py", "READ_ERROR")]


def test_graph_failure_keeps_the_direct_hits(engine, monkeypatch):
    from tessera.plans import engine as module

    engine.build_vector_index(1)

    def fails(*_):
        raise RuntimeError("no graph")

    monkeypatch.setattr(module.graph, "graph_rag", fails)
    text, refs, notes = engine._evidence(1, "OrderService findById", 5, True)
    assert refs and notes == [module.GRAPH_UNAVAILABLE] and "Relation reason: direct hybrid-search hit" in text


def test_embedding_cache_asks_once(spark, tmp_path):
    from tessera.plans.providers import embed_with_cache, hash_embedder

    s, plain = store_module.Store(spark, str(tmp_path)), hash_embedder(8)
    seen = tmp_path / "seen"

    def counting(texts):
        with seen.open("a") as f:
            f.writelines(t + "\n" for t in texts)
        return plain(texts)

    chunks = spark.createDataFrame([(1, "alpha"), (2, "beta"), (3, "alpha")], "entity_id long, chunk string")
    first = {r.entity_id: r.embedding for r in embed_with_cache(chunks, counting, s).collect()}
    assert sorted(seen.read_text().split()) == ["alpha", "beta"] and first[1] == first[3] == plain(["alpha"])[0]
    more = chunks.union(spark.createDataFrame([(4, "gamma")], chunks.schema))
    assert len(embed_with_cache(more, counting, s).collect()) == 4
    assert sorted(seen.read_text().split()) == ["alpha", "beta", "gamma"]


def test_report_is_replaced_whole(spark, tmp_path):
    from pyspark.sql import functions as F

    out = str(tmp_path / "report")
    store_module.write_report(spark.range(2), out, [])
    with pytest.raises(Exception, match="boom"):
        store_module.write_report(spark.range(3).select(F.raise_error(F.lit("boom")).cast("long").alias("id")), out, [])
    assert spark.read.json(out).count() == 2
    store_module.write_report(spark.range(5), out, [])
    assert spark.read.json(out).count() == 5


def test_torn_checkpoint_lines_are_set_aside(spark, tmp_path):
    from tessera.sources import records

    path = tmp_path / "c.jsonl"
    path.write_text('{"a": 1}\n{"a": 2}\n{"a": 3')
    rows, torn = records.read_checkpoint(spark, str(path), "a int")
    assert sorted(r.a for r in rows.collect()) == [1, 2] and [r.line for r in torn.collect()] == ['{"a": 3']
    path.write_text('{"a": 1}\n{"a": \n{"a": 3}\n')
    with pytest.raises(ValueError, match="bad line"):
        records.read_checkpoint(spark, str(path), "a int")
    assert records.parse_manifest('a: "x # y" # note\nb: it\'s\n# all\nc: d#e\n') == {"a": "x # y", "b": "it's", "c": "d#e"}


def test_snapshot_and_reports(engine, spark, tmp_path):
    tables = store_module.snapshot(engine._read(1, "files"), engine._read(1, "entities"), engine._read(1, "relations"), engine._read(1, "issues"), "repo", "c0ffee")
    store_module.write_snapshot(tables, str(tmp_path / "snap"))
    keys = {r.stable_entity_key for r in spark.read.json(str(tmp_path / "snap/code_entities")).collect()}
    ends = spark.read.json(str(tmp_path / "snap/code_relations")).collect()
    assert ends and all(r.source_key in keys and r.target_key in keys and len(r.source_key) == 64 for r in ends)
    assert store_module.attest(spark, str(tmp_path / "snap")).count() >= 4
    with pytest.raises(ValueError, match="input"):
        store_module.write_report(spark.range(1), "a/", ["a"])
    assert store_module.render_report("T", [{"a": 1, "b": "x"}]) == "# T\n\n| a | b |\n|---|---|\n| 1 | x |\n"
    with pytest.raises(ValueError, match="dimension"):
        store_module.check_vectors(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "entity_id long, embedding array<double>"))


def test_concurrent_catalog_changes_lose_nothing(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    with ThreadPoolExecutor(6) as pool:
        made = list(pool.map(lambda i: Engine(spark, str(tmp_path / "store")).create_project(f"p{i}", f"/r{i}"), range(6)))
    assert sorted(p["id"] for p in made) == [1, 2, 3, 4, 5, 6] and len(e.list_projects()) == 6
    assert sorted(p["sort_order"] for p in e.list_projects()) == list(range(6))
    jobs = [lambda: e.reorder_projects([6, 5, 4, 3, 2, 1]), lambda: e._update(3, status="ready"), lambda: e._update(4, status="failed")]
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda f: f(), jobs))
    assert [p["id"] for p in e.list_projects()] == [6, 5, 4, 3, 2, 1] and {p["id"]: p["status"] for p in e.list_projects()} | {3: "ready", 4: "failed"} == {p["id"]: p["status"] for p in e.list_projects()}
    for i in range(1, 7):
        e.delete_project(i)
    assert e.list_projects() == [] and e.create_project("again", "/again")["id"] == 1


def test_a_stale_lock_goes_to_one_waiter(spark, tmp_path, monkeypatch):
    s = store_module.Store(spark, str(tmp_path))
    store_module.marks.publish(spark, f"{tmp_path}/locks/7", f"old {time.time() - store_module.LEASE - 9}")
    gate, won = threading.Barrier(4), []

    def wait(i):
        gate.wait()
        try:
            with s.scanning(7):
                won.append(i)
                time.sleep(1.5)
        except DomainError as e:
            assert e.code == "SCAN_ALREADY_RUNNING"

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(wait, range(4)))
    assert len(won) == 1
    # an owner whose lock was taken over meanwhile leaves its successor's alone
    with s.scanning(7):
        store_module.marks.drop_path(spark, f"{tmp_path}/locks/7")
        store_module.marks.publish(spark, f"{tmp_path}/locks/7", f"other {time.time()}")
    assert s._lock(f"{tmp_path}/locks/7")[0] == "other"
    # a beat keeps a lock that is older than a lease
    monkeypatch.setattr(store_module, "LEASE", 1.2)
    with s.scanning(8):
        time.sleep(2)
        with pytest.raises(DomainError), s.scanning(8):
            pass


def test_a_log_numbers_rows_without_gaps(spark, tmp_path):
    def writer(w):
        log = ResponseLog(spark, str(tmp_path), "r1")
        return [log.record(f"c{w}-{k // 3}", f"a{w}-{k}", "initial" if k % 3 == 0 else "repair", usage=(1, 2, 3), requested="m") for k in range(9)]

    with ThreadPoolExecutor(4) as pool:
        given = [x for some in pool.map(writer, range(4)) for x in some]
    assert sorted(given) == list(range(1, 37))
    log = ResponseLog(spark, str(tmp_path), "r1")
    spark.range(3).write.parquet(f"{log.data}/torn")  # a writer that died before its mark
    assert log.size() == 36 and log.segments() <= 2 * FAN
    calls = log.calls()
    assert evaluation.response_violations(calls).count() == 0
    assert sorted(r.call_ordinal for r in calls.collect()) == list(range(1, 37))
    slices = evaluation.case_responses(calls).collect()
    assert {r.calls for r in slices} == {3} and len({r.case_id for r in slices}) == 12
    assert all(r.phase == ("initial" if r.place == 1 else "repair") for r in slices)
    table = spark.range(500).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("case_id"), (-F.col("id")).alias("at")).repartition(5)
    names = [f.split()[0] for f in RESPONSES.split(", ")]
    full = table.select("at", "case_id", *[F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in RESPONSES.split(", ")[1:]])
    assert names[0] == "case_id" and log.append_table(full, "at") == 37
    assert [r.case_id for r in log.read(F.col("ordinal") > 36).orderBy("ordinal").limit(2).collect()] == ["t499", "t498"] and log.size() == 536


def test_many_exchanges_leave_few_folders(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    one, two = e.create_project("a", "/a")["id"], e.create_project("b", "/b")["id"]
    first = e.save_exchange(one, "q0", {"answer": "a0"})
    for k in range(1, 20):
        assert e.save_exchange(one, f"q{k}", {"answer": f"a{k}"}, first) == first
    other = e.save_exchange(two, "x" * 99, {"answer": "y"})
    assert other != first and e.conversation(two, other)["title"] == "x" * 80
    talk = e.conversation(one, first)
    assert [m["content"] for m in talk["messages"]] == [f"{c}{k}" for k in range(20) for c in "qa"]
    assert e._messages(one).segments() <= 2 * FAN and len(list((tmp_path / "store/logs/messages-1/data").iterdir())) <= 4 * FAN
    with pytest.raises(DomainError) as x:
        e.conversation(two, first)
    assert x.value.code == "CONVERSATION_PROJECT_MISMATCH"


def test_one_failing_walk_leaves_the_others(engine, monkeypatch):
    if not engine.vector_index_ready(1):
        engine.build_vector_index(1)
    real, bad = graph.graph_rag, engine.hybrid(1, "findById", 5).first().entity_id

    def walk(nodes, edges, hits, *rest):
        if bad in {r.entity_id for r in hits.collect()}:
            raise RuntimeError("broken node")
        return real(nodes, edges, hits, *rest)

    monkeypatch.setattr(graph, "graph_rag", walk)
    text, refs, notes = engine._evidence(1, "findById", 5, True)
    assert notes[0].startswith("Graph relationship retrieval was unavailable")
    assert bad in {r["entity_id"] for r in refs} and "Graph depth: 1" in text


def test_named_embeddings_are_cached(spark, tree, tmp_path):
    asked = []

    def embed(texts):
        asked.extend(texts)
        return hash_embedder(8)(texts)

    e = Engine(spark, str(tmp_path / "store"), embed=embed, embed_model="counting")
    e.create_project("demo", str(tree))
    e.scan_project(1)
    n = e.build_vector_index(1)
    assert n == e.build_vector_index(1) and e.store.read("embeddings-counting", "cache").count() <= n
