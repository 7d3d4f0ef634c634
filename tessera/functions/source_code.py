"""Source-code kernels: pure Python, no Spark.

Each parser returns (entities, relations, requests) as lists of dicts in the shapes of ``schema``.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

from tessera.functions.api_path import normalize_api_path

# Annotations, clients and shapes that carry meaning.
MAPPINGS = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH", "RequestMapping": None}
CONTROLLERS = {"Controller", "RestController"}
INJECTED = {"Autowired", "Resource"}
VERBS = ("get", "post", "put", "patch", "delete")
CLIENTS = ("axios", "request", "http", "service")
NAME = r"[A-Za-z_$][\w$]*"


def dumps(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True)


def entity(key: str, kind: str, name: str, qualified: str, path: str, first: int, last: int, content: str, meta: dict) -> dict:
    return {"local_key": key, "entity_type": kind, "name": name, "qualified_name": qualified, "file_path": path, "start_line": first, "end_line": last, "content": content, "metadata_json": dumps(meta)}


def relation(source: str, target: str, kind: str) -> dict:
    return {"source_key": source, "target_key": target, "relation_type": kind, "confidence": 1.0, "metadata_json": "{}"}


# -- Python --


def parse_python(path: str, source: str) -> tuple[list, list, list]:
    """Classes and functions with dotted names; a class contains the functions right inside it."""
    entities, relations = [], []
    lines = source.splitlines()

    def arguments(a: ast.arguments) -> list[str]:
        out = [x.arg for x in a.posonlyargs + a.args]
        out += [f"*{a.vararg.arg}"] if a.vararg else []
        out += [x.arg for x in a.kwonlyargs]
        return out + ([f"**{a.kwarg.arg}"] if a.kwarg else [])

    def walk(node: ast.AST, names: tuple[str, ...], holder: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            if not isinstance(child, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                walk(child, names, holder)
                continue
            is_class = isinstance(child, ast.ClassDef)
            kind = "python_class" if is_class else "python_function"
            dotted = ".".join((*names, child.name))
            key = f"{kind}:{dotted}:{child.lineno}"
            meta = {"decorators": [ast.unparse(d) for d in child.decorator_list]}
            meta |= {"bases": [ast.unparse(b) for b in child.bases]} if is_class else {"arguments": arguments(child.args), "is_async": isinstance(child, ast.AsyncFunctionDef)}
            entities.append(entity(key, kind, child.name, dotted, path, child.lineno, child.end_lineno, "\n".join(lines[child.lineno - 1 : child.end_lineno]), meta))
            if not is_class and holder:
                relations.append(relation(holder, key, "CONTAINS"))
            walk(child, (*names, child.name), key if is_class else None)

    walk(ast.parse(source), (), None)
    return entities, relations, []


# -- text with strings and comments blanked --


def blanked(source: str, quotes: str, text_blocks: bool = False) -> str:
    """``source`` with comments and the insides of strings as blanks, the same length."""
    marks = [r"//[^\n]*", r"/\*.*?(?:\*/|\Z)"] + ([r'"""(?:\\.|(?!""").)*"""'] if text_blocks else [])
    marks += [rf"{q}(?:\\.|[^{q}\\{'' if q == '`' else chr(10)}])*{q}" for q in quotes]

    def hide(m: re.Match) -> str:
        text = m[0]
        inner = re.sub(r"[^\n]", " ", text)
        return inner if text[0] == "/" else text[0] + inner[1:-1] + text[-1]

    return re.sub("|".join(marks), hide, source, flags=re.DOTALL)


PAIRS = {"(": ")", "[": "]", "{": "}"}


def closing(code: str, at: int) -> int:
    """Place of the bracket that closes the one at ``at``, or the end."""
    stack = []
    for i in range(at, len(code)):
        if code[i] in PAIRS:
            stack.append(PAIRS[code[i]])
        elif stack and code[i] == stack[-1]:
            stack.pop()
            if not stack:
                return i
    return len(code)


def pieces(code: str, low: int, high: int) -> Iterator[tuple[int, int]]:
    """Ranges between commas that stand in no bracket."""
    at = begin = low
    while at < high:
        if code[at] in PAIRS:
            at = closing(code, at)
        elif code[at] == ",":
            yield begin, at
            begin = at + 1
        at += 1
    if code[begin:high].strip():
        yield begin, high


# -- Java --

ANNOTATION = re.compile(r"@(?!interface\b)([\w.]+)\s*")
MODIFIER = re.compile(r"(?:public|protected|private|static|final|abstract|native|synchronized|transient|volatile|strictfp|default|sealed|non-sealed)\b\s*")
STRING = re.compile(r'"(?:\\.|[^"\\])*"')
PATH_VALUE = r'(\{(?:[^{}"]|"(?:\\.|[^"\\])*")*\}|"(?:\\.|[^"\\])*")'


class JavaFile:
    """A scanner of declarations by brackets: classes, their methods, fields and constructors."""

    def __init__(self, path: str, source: str) -> None:
        self.path, self.source = path, source
        self.code = blanked(source, "\"'", text_blocks=True)
        self.entities: list[dict] = []
        self.relations: list[dict] = []

    def line(self, at: int) -> int:
        return self.source.count("\n", 0, at) + 1

    def members(self, low: int, high: int) -> Iterator[tuple[int, int, int]]:
        """(start, header end, end) of each declaration: up to its semicolon or its body's closing brace."""
        at = low
        while at < high:
            while at < high and (self.code[at].isspace() or self.code[at] in ";,"):
                at += 1
            begin = at
            while at < high and self.code[at] not in "{;":
                if self.code[at] in "([":
                    at = closing(self.code, at)
                elif self.code[at] == "=":  # an initialiser may hold braces
                    while at < high and self.code[at] != ";":
                        at = closing(self.code, at) + 1 if self.code[at] in PAIRS else at + 1
                    break
                at += 1
            if at >= high:
                return
            stop = closing(self.code, at) if self.code[at] == "{" else at
            yield begin, at, min(stop + 1, high)
            at = stop + 1

    def annotations(self, low: int, high: int) -> tuple[list[tuple[str, str]], int]:
        """((simple name, text) of each leading annotation, place after annotations and modifiers)."""
        found, at = [], low
        while at < high:
            if m := ANNOTATION.match(self.code, at, high):
                end = m.end()
                if end < high and self.code[end] == "(":
                    end = closing(self.code, end) + 1
                found.append((m[1].rsplit(".", 1)[-1], self.source[at:end].rstrip()))
                at = end
            elif m := MODIFIER.match(self.code, at, high):
                at = m.end()
            elif self.code[at].isspace():
                at += 1
            else:
                break
        return found, at

    def declarations(self, low: int, high: int, outer: tuple[str, ...]) -> None:
        """Classes of a region, also inside bodies that aren't classes."""
        for begin, header, end in self.members(low, high):
            _, at = self.annotations(begin, header)
            m = re.compile(r"(class|interface|enum|record|@interface)\s+(\w+)").match(self.code, at, header)
            if m and m[1] == "class":
                self.java_class(begin, at, header, end, outer)
            elif m and self.code[header] == "{":
                self.declarations(header + 1, end - 1, outer)

    def java_class(self, begin: int, at: int, header: int, end: int, outer: tuple[str, ...]) -> None:
        marks, _ = self.annotations(begin, header)
        names = [n for n, _ in marks]
        name = re.compile(r"class\s+(\w+)").match(self.code, at)[1]
        dotted = ".".join((*outer, name))
        key = f"java_class:{dotted}:{self.line(begin)}"
        controller = bool(CONTROLLERS & set(names))
        meta = {"annotations": names, "is_controller": controller, "is_service": "Service" in names}
        self.entities.append(entity(key, "java_class", name, dotted, self.path, self.line(begin), self.line(end - 1), self.source[begin:end], meta))
        bases = [p for n, text in marks if n == "RequestMapping" for p in mapped_paths(text)] or ["/"]
        body = list(self.members(header + 1, end - 1))
        injected = self.injected(body, name)
        for b, h, e in body:
            _, a = self.annotations(b, h)
            if re.compile(r"class\s+\w").match(self.code, a):
                self.java_class(b, a, h, e, (*outer, name))
            elif m := self.method_name(a, h, name):
                self.method(b, a, h, e, m, dotted, key, bases, controller, injected)

    def method_name(self, at: int, header: int, class_name: str) -> re.Match | None:
        """The match of ``name(`` in a method's header; none for fields, constructors and other types."""
        if re.compile(r"(?:interface|enum|record|@interface)\s+\w").match(self.code, at):
            return None
        head = self.code[at:header]
        m = re.search(r"(\w+)\s*\(", head)
        if not m or "=" in head[: m.start()]:
            return None
        before = re.sub(r"^<.*?>\s*(?=[\w@])", "", head[: m.start()].strip())
        return re.compile(r"(\w+)\s*\(").search(self.code, at, header) if before else None

    def injected(self, body: list[tuple[int, int, int]], class_name: str) -> dict[str, str]:
        """Field name -> type: annotated fields, and constructor parameters stored in ``this``."""
        found: dict[str, str] = {}
        for begin, header, end in body:
            marks, at = self.annotations(begin, header)
            head = self.source[at:header]
            if m := re.match(rf"(?:<[^>]*>\s*)?{re.escape(class_name)}\s*\(", self.code[at:header]):
                open_ = at + m.end() - 1
                types = {}
                for a, b in pieces(self.code, open_ + 1, closing(self.code, open_)):
                    _, a = self.annotations(a, b)
                    if p := re.fullmatch(r"(.+?)\s+(\w+)", self.source[a:b].strip(), re.DOTALL):
                        types[p[2]] = p[1].strip()
                for field, value in re.findall(r"\bthis\s*\.\s*(\w+)\s*=\s*(\w+)\s*;", self.code[header:end]):
                    if value in types:
                        found[field] = types[value]
            elif INJECTED & {n for n, _ in marks} and "(" not in self.code[at:header]:
                if m := re.match(r"([\w.]+(?:\s*<.*>)?(?:\[\])*)\s+(.+)", head, re.DOTALL):
                    for one in m[2].split("=")[0].split(","):
                        found[one.strip()] = m[1].strip()
        return found

    def method(self, begin, at, header, end, m, class_name, class_key, bases, controller, injected) -> None:
        marks, _ = self.annotations(begin, header)
        name, first, last = m[1], self.line(begin), self.line(end - 1)
        open_ = m.end() - 1
        returns = re.sub(r"^<.*?>\s*(?=[\w@])", "", self.source[at : m.start()].strip()) or None
        calls = [
            {"qualifier": q, "method": c, "receiver_type": injected[q]}
            for q, c in re.findall(r"(?<![\w.$])(\w+)\s*\.\s*(\w+)\s*\(", self.code[header:end])
            if q in injected
        ]
        meta = {"annotations": [n for n, _ in marks], "parameters": self.source[open_ : closing(self.code, open_) + 1], "return_type": returns, "declaring_class": class_name, "invocations": calls}
        key = f"java_method:{class_name}.{name}:{first}"
        content = self.source[begin:end]
        self.entities.append(entity(key, "java_method", name, f"{class_name}.{name}", self.path, first, last, content, meta))
        self.relations.append(relation(class_key, key, "CONTAINS"))
        for mark, text in marks if controller else []:
            if mark not in MAPPINGS:
                continue
            verbs = [MAPPINGS[mark]] if MAPPINGS[mark] else re.findall(r"RequestMethod\.([A-Z]+)", text) or ["ANY"]
            for base in bases:
                for own in mapped_paths(text):
                    path = "/" + "/".join(s for s in (base.strip("/"), own.strip("/")) if s)
                    for verb in verbs:
                        api = f"{verb} {path}"
                        api_key = f"backend_api:{verb}:{path}:{class_name}.{name}:{first}"
                        about = {"http_method": verb, "path": path, "normalized_path": normalize_api_path(path), "controller_class": class_name, "handler_method": name}
                        self.entities.append(entity(api_key, "backend_api", api, api, self.path, first, last, content, about))
                        self.relations.append(relation(api_key, key, "DEFINES_API"))


def mapped_paths(annotation: str) -> list[str]:
    """Paths that a mapping annotation names, by ``value``, ``path`` or place; ``/`` if none."""
    if "(" not in annotation:
        return ["/"]
    inside = annotation[annotation.index("(") + 1 : annotation.rindex(")")]
    m = re.search(rf"\b(?:value|path)\s*=\s*{PATH_VALUE}", inside, re.DOTALL) or re.match(rf"\s*{PATH_VALUE}", inside, re.DOTALL)
    return [json.loads(x) for x in STRING.findall(m[1])] or ["/"] if m else ["/"]


def parse_java(path: str, source: str) -> tuple[list, list, list]:
    file = JavaFile(path, source)
    # package and import lines end with semicolons and are members without meaning
    file.declarations(0, len(source), ())
    return file.entities, file.relations, []


# -- frontend requests --


def literal(expression: str | None) -> str | None:
    """The text of a string literal; none for other expressions and for templates that only substitute."""
    text = (expression or "").strip()
    if len(text) < 2 or text[0] not in "'\"`" or text[-1] != text[0]:
        return None
    if text[0] == "`" and not re.sub(r"\$\{.*?\}", "", text[1:-1]).strip():
        return None
    return text[1:-1].encode().decode("unicode_escape")


def script_blocks(path: str, source: str) -> Iterator[tuple[str, int]]:
    """(source, first line) of a file's script parts."""
    if not path.lower().endswith(".vue"):
        yield source, 1
        return
    for m in re.finditer(r"<script\b[^>]*>(.*?)</script\s*>", source, re.IGNORECASE | re.DOTALL):
        yield m[1], source.count("\n", 0, m.start(1)) + 1


CALL = re.compile(rf"(?<![\w$.])((?:{NAME}\s*\.\s*)*{NAME})\s*\(")


def _object(code: str, source: str, low: int, high: int) -> dict[str, str] | None:
    """Top-level ``key: value`` texts of an object literal."""
    text = code[low:high]
    begin = low + len(text) - len(text.lstrip())
    if begin >= high or code[begin] != "{":
        return None
    out = {}
    for a, b in pieces(code, begin + 1, closing(code, begin)):
        if ":" in code[a:b]:
            cut = code.index(":", a, b)
            out[source[a:cut].strip().strip("\"'")] = source[cut + 1 : b].strip()
    return out


def parse_frontend(path: str, source: str) -> tuple[list, list, list]:
    """Request candidates; resolving them needs all files' constants and wrappers."""
    requests = []
    for block, first_line in script_blocks(path, source):
        code = blanked(block, "\"'`")
        for m in CALL.finditer(code):
            callee = re.sub(r"\s+", "", m[1])
            open_ = m.end() - 1
            close = closing(code, open_)
            args = list(pieces(code, open_ + 1, close))
            head, _, tail = callee.rpartition(".")
            url = method = None
            if head in CLIENTS and tail.lower() in VERBS:
                if not args:
                    continue
                callee, url, method = f"{head}.{tail.lower()}", block[slice(*args[0])].strip(), tail.upper()
            elif callee == "fetch":
                if not args:
                    continue
                options = _object(code, block, *args[1]) if len(args) > 1 else None
                url, method = block[slice(*args[0])].strip(), (options or {}).get("method", "GET")
            elif callee in ("axios", "request") or (head and tail.lower() == "request"):
                options = _object(code, block, *args[0]) if args else None
                if not options or "url" not in options:
                    continue
                callee = f"{head}.request" if head else callee
                url, method = options["url"], options.get("method")
            else:
                continue
            end = min(close + 1, len(block))
            requests.append(
                {
                    "file_path": path, "start_line": first_line + block.count("\n", 0, m.start()), "end_line": first_line + block.count("\n", 0, end - 1),
                    "start_byte": len(block[: m.start()].encode()), "content": block[m.start() : end], "callee": callee, "url_expression": url, "method_expression": method,
                }
            )
    return [], [], requests


def constants(source: str) -> list[tuple[str, str, str]]:
    """(object, property, value) of string properties of object constants."""
    out = []
    for o in re.finditer(rf"(?:export\s+)?(?:const|let|var)\s+({NAME})\s*=\s*\{{(.*?)\}}", source, re.DOTALL):
        for p in re.finditer(rf"({NAME})\s*:\s*(['\"](?:\\.|[^'\"])*['\"])", o[2]):
            value = literal(p[2])
            if value is not None:
                out.append((o[1], p[1], value))
    return out


def wrappers(source: str) -> list[tuple[str, str]]:
    """(name, method) of arrow functions whose body makes exactly one call on a URL."""
    out = []
    code = blanked(source, "\"'`")
    for m in re.finditer(rf"(?:export\s+)?(?:const|let|var)\s+({NAME})\s*=\s*(?:\([^)]*\)|{NAME})\s*=>\s*", source):
        at = m.end()
        if at < len(source) and code[at] == "{":
            close = closing(code, at)
            if close == len(code):
                continue
            body = source[at + 1 : close]
        else:
            body = source[at:].split(";", 1)[0]
        calls = re.findall(rf"\b{NAME}\.({'|'.join(VERBS)})\s*\(\s*(?:{NAME}\.)?url\b", body, re.IGNORECASE)
        if len(calls) == 1:
            out.append((m[1], calls[0].upper()))
    return out


PARSERS = {"python": parse_python, "java": parse_java, "vue": parse_frontend, "javascript": parse_frontend, "typescript": parse_frontend}
