"""Symbols and edges of one file: a page of text, walked by the rules of its language."""

from __future__ import annotations

import bisect
import json
import posixpath
import re
from urllib.parse import urlsplit

from . import rules as R
from .manifests import config_keys, locked, manifest


_json = json.JSONEncoder(sort_keys=True).encode


class Page:
    """A file's text with its lines, and what has been found in it so far (first of equal names wins)."""

    def __init__(self, path: str, language: str, text: str):
        self.path, self.language, self.text = path, language, text
        self.lines = re.split(r"\r?\n", text)
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self.file = f"{path}:file"
        self.symbols: dict[str, dict] = {}
        self.edges: list[dict] = []

    def line_at(self, offset: int) -> int:
        return bisect.bisect_left(self.breaks, offset) + 1

    def signature(self, line: int) -> str:
        return self.lines[line - 1].strip()[:220]

    def add(self, kind, name, line, end=None, /, *, signature=None, exported=False, suffix="", via=("DEFINES", 1.0), owner=None, **metadata) -> str:
        """Note a symbol, and by ``via`` the edge that leads to it; returns its qualified name."""
        qualified = f"{self.path}:{kind}:{name}:{line}{suffix}"
        self.symbols.setdefault(qualified, {"qualified_name": qualified, "name": name, "kind": kind, "start_line": line, "end_line": end or line, "signature": signature, "exported": int(exported), "metadata": _json(metadata)})
        if via:
            self.link(owner or self.file, qualified, *via)
        return qualified

    def link(self, source: str, target: str, type_: str, weight: float, /, **metadata) -> None:
        self.edges.append({"source": source, "target": target, "type": type_, "weight": float(weight), "metadata": _json(metadata)})

    def around(self, line: int) -> str:
        """The smallest function, method, class or route that holds a line; else the file."""
        inside = [s for s in self.symbols.values() if s["kind"] in ("function", "method", "class", "route") and s["start_line"] <= line <= s["end_line"]]
        return min(inside, key=lambda s: s["end_line"] - s["start_line"])["qualified_name"] if inside else self.file


def block_end(language: str, lines: list[str], line: int) -> int:
    """The last line of the block that begins at ``line``."""
    rest = lines[line - 1 :]
    if language == "python":
        depth = len(rest[0]) - len(rest[0].lstrip())
        for k, text in enumerate(rest[1:], line):
            if text.strip() and len(text) - len(text.lstrip()) <= depth:
                return k
        return len(lines)
    if language in R.BLOCK_OPENERS:
        opener, depth = R.BLOCK_OPENERS[language], 0
        for k, text in enumerate(rest, line):
            bare = text.split("#", 1)[0].strip()
            depth += bool(bare and opener.match(bare))
            if re.match(r"end\b", bare):
                depth -= 1
                if depth <= 0:
                    return k
        return line
    depth, opened = 0, False
    for k, text in enumerate(rest, line):
        opened = opened or "{" in text
        depth += text.count("{") - text.count("}")
        if opened and depth <= 0:
            return k
    return line


def imports(page: Page) -> list[str]:
    found: dict[str, None] = {}
    for pattern in R.IMPORTS.get(page.language, ()):
        for m in pattern.finditer(page.text):
            value = next((g for g in m.groups() if g), None)
            if value:
                found[value.strip()] = None
    return list(found)


def callable_name(name: str) -> bool:
    return len(name) > 2 and name.lower() not in R.NOT_CALLABLE


def declarations(page: Page) -> None:
    for kind, pattern in R.DECLARATIONS.get(page.language, ()):
        for m in pattern.finditer(page.text):
            name = m["name"]
            if name.lower() in R.NOT_NAMES:
                continue
            line = page.line_at(m.start() + max(0, m[0].find(name)))
            page.add(kind, name, line, block_end(page.language, page.lines, line), signature=page.signature(line), exported=bool(m.groupdict().get("exported")))
    if page.language in ("typescript", "javascript"):
        for owner in [s for s in page.symbols.values() if s["kind"] == "class"]:
            first, last = owner["start_line"], owner["end_line"]
            body = "\n".join(page.lines[first - 1 : last])
            for m in R.METHOD.finditer(body):
                line = first + body.count("\n", 0, m.start())
                if callable_name(m[1]) and m[1] not in R.RESERVED_METHODS and first < line <= last:
                    page.add("method", m[1], line, block_end(page.language, page.lines, line), signature=page.signature(line), via=("DEFINES", 0.95), owner=owner["qualified_name"], parentClass=owner["name"], parentQualifiedName=owner["qualified_name"])


def route_method(word: str) -> str:
    bare = re.sub("(?i)mapping$", "", re.sub("(?i)^map", "", re.sub("(?i)^http", "", word))).upper()
    if not bare or bare.startswith("/") or bare in ("REQUEST", "REQUESTMAPPING", "ROUTE"):
        return "ROUTE"
    return "ANY" if bare in ("METHODS", "ANY") else bare


def app_router_path(path: str) -> str | None:
    """The route that a file of an app router serves, by its folders."""
    m = R.APP_ROUTER.search(path.replace("\\", "/"))
    if not m:
        return None
    parts = []
    for part in filter(None, (m[1] or "").split("/")):
        if part.startswith("(") and part.endswith(")"):
            continue
        for shape, made in ((r"\[\[\.\.\.([\w-]+)\]\]", "*{}?"), (r"\[\.\.\.([\w-]+)\]", "*{}"), (r"\[([\w-]+)\]", ":{}")):
            named = re.fullmatch(shape, part, re.A)
            if named:
                part = made.format(named[1])
                break
        parts.append(part)
    return "/".join(["/api", *parts])


def routes(page: Page) -> None:
    if page.language in R.ROUTE_LANGUAGES:
        served = app_router_path(page.path) if page.language in ("typescript", "javascript") else None
        for m in R.APP_METHOD.finditer(page.text) if served else ():
            method = m[1] or m[2]
            page.add("route", f"{method} {served}", page.line_at(m.start()), exported=True, method=method, path=served, framework="next-app-router")
        for pattern in R.ROUTES:
            for m in pattern.finditer(page.text):
                at = m[2] if pattern.groups > 1 and m[2] is not None else m[1]
                if at and at.startswith("/"):
                    method = route_method(m[1] or "ROUTE")
                    page.add("route", f"{method} {at}", page.line_at(m.start()), exported=True, method=method, path=at)
    elif page.language in ("yaml", "json") and R.OPENAPI.search(page.text):
        for method, at, line in _openapi_json(page) if page.language == "json" else _openapi_yaml(page.lines):
            at = re.sub(r"\{([A-Za-z0-9_-]+)\}", r":\1", at)
            page.add("route", f"{method} {at}", line, exported=True, method=method, path=at, protocol="openapi")


def _openapi_json(page: Page):
    try:
        paths = json.loads(page.text).get("paths") or {}
    except (ValueError, AttributeError):
        return
    for at, item in paths.items():
        for method in item if isinstance(item, dict) else ():
            if method.upper() in R.OPENAPI_METHODS:
                yield method.upper(), at, page.line_at(max(0, page.text.find(f'"{at}"')))


def _openapi_yaml(lines: list[str]):
    top = at = None  # indentations of "paths" and of the path; None outside
    name = ""
    for k, line in enumerate(lines, 1):
        bare = line.strip()
        if not bare or bare.startswith("#"):
            continue
        depth = len(line) - len(line.lstrip())
        if re.fullmatch(r"paths\s*:", bare):
            top, at = depth, None
        elif top is None:
            continue
        elif depth <= top:
            top = at = None
        elif m := re.fullmatch(r"""(["']?/[^:"']*["']?)\s*:""", bare):
            name, at = m[1].strip("\"'"), depth
        elif at is not None and depth > at and (m := re.fullmatch(r"([a-z]+)\s*:", bare)) and m[1].upper() in R.OPENAPI_METHODS:
            yield m[1].upper(), name, k


def channels(page: Page) -> None:
    for type_, how, pattern in R.SWIFT_CHANNELS if page.language == "swift" else R.CHANNELS:
        for m in pattern.finditer(page.text):
            name = (next((g for g in m.groups() if g), "") or "").strip()
            if not name or len(name) > 160:
                continue
            name, line = re.sub(r"\s+", " ", name), page.line_at(m.start())
            qualified = f"channel:{name}"
            page.symbols.setdefault(qualified, {"qualified_name": qualified, "name": name, "kind": "channel", "start_line": 1, "end_line": 1, "signature": None, "exported": 1, "metadata": json.dumps({"channel": name}), "file_path": "__channels__", "language": "unknown"})
            page.link(page.around(line), qualified, type_, 0.85 if type_ == "EMITS" else 0.75, channel=name, line=line, pattern=how)


def http_target(url: str) -> dict | None:
    """Path, and for absolute urls host and scheme; None for what is no HTTP path."""
    url = url.strip()
    if re.match(r"[a-z][a-z0-9+.-]*://", url, re.I):
        try:
            found = urlsplit(url)
            host = found.netloc.rpartition("@")[2].lower()
        except ValueError:
            return None
        if found.scheme not in ("http", "https") or not host:
            return None
        path = found.path.rstrip("/") or "/"
        return {"path": path, "host": host, "scheme": found.scheme, "url": f"{found.scheme}://{host}{path}", "urlKind": "absolute"}
    path = re.split("[?#]", url, maxsplit=1)[0]
    return {"path": path.rstrip("/") or "/", "urlKind": "relative"} if path.startswith("/") else None


def http_calls(page: Page) -> None:
    if page.language not in ("typescript", "javascript"):
        return
    found = []
    for m in R.FETCH.finditer(page.text):
        following = re.search(r"\bfetch\(", page.text[m.end() : m.end() + R.FETCH_WINDOW])
        method = R.FETCH_METHOD.search(page.text, m.start(), m.end() + (following.start() if following else R.FETCH_WINDOW))
        found.append((method[1].upper() if method else "GET", m[1], m.start()))
    for pattern in R.CLIENTS:
        found += [("ANY" if m[1].lower() == "request" else m[1].upper(), m[2], m.start()) for m in pattern.finditer(page.text)]
    seen = set()
    for method, url, offset in found:
        target, line = http_target(url), page.line_at(offset)
        if not target or (method, target.get("host"), target["path"], line) in seen:
            continue
        seen.add((method, target.get("host"), target["path"], line))
        told = {"method": method, "line": line, **target}
        source = page.around(line)
        qualified = page.add("http_call", f"{method} {target['path']}", line, via=("DEFINES", 0.8), **told)
        page.link(source, qualified, "CALLS_HTTP_ENDPOINT", 0.6 if method == "ANY" else 0.8, **told)


def _operations(page: Page, text: str, base: int, **more):
    for m in R.GRAPHQL_OPERATION.finditer(text):
        operation, name = m[1], m[2] or "anonymous"
        yield f"{operation} {name}", base + text.count("\n", 0, m.start()), {"protocol": "graphql", "operation": operation, "name": name, **more}


def protocols(page: Page) -> None:
    text = page.text
    if page.language == "graphql":
        for name, line, told in _operations(page, text, 1):
            page.add("graphql_operation", name, line, exported=True, via=("DECLARES", 1), **told)
        for m in R.GRAPHQL_TYPE.finditer(text):
            page.add("graphql_type", f"{m[1]} {m[2]}", page.line_at(m.start()), exported=True, via=("DECLARES", 1), protocol="graphql", category=m[1], name=m[2])
    elif page.language == "proto":
        service = None
        for k, line in enumerate(page.lines, 1):
            if m := R.PROTO_SERVICE.match(line):
                service = m[1]
                page.add("grpc_service", service, k, signature=line.strip(), exported=True, via=("DECLARES", 1), protocol="grpc", service=service)
            elif line.strip() == "}":
                service = None
            elif service and (m := R.PROTO_RPC.match(line)):
                page.add("route", f"RPC /{service}/{m[1]}", k, signature=line.strip(), exported=True, protocol="grpc", method="RPC", path=f"/{service}/{m[1]}", service=service, rpc=m[1], request=m[2].strip(), response=m[3].strip())
    elif page.language in ("typescript", "javascript"):
        for t in R.GRAPHQL_TEMPLATE.finditer(text):
            for name, line, told in _operations(page, t[1], page.line_at(t.start()), source="template"):
                around = page.around(line)
                page.link(around, page.add("graphql_operation", name, line, exported=True, suffix=":template", via=None, **told), "USES_GRAPHQL", 0.75)
        for m in R.TRPC_BUILDER.finditer(text):
            begin = max(0, m.start() - 160)
            name = re.search(r"([A-Za-z_$][\w$]*)\s*:\s*$", text[begin : m.start()], re.A)
            kind = re.search(r"\.(query|mutation|subscription)\s*\(", text[m.end() : m.end() + 240])
            if name and kind:
                page.add("trpc_procedure", f"{kind[1]} {name[1]}", page.line_at(begin + name.start()), exported=True, via=("DEFINES", 0.9), protocol="trpc", procedure=name[1], procedureType=kind[1])
        for m in R.TRPC_CALL.finditer(text):
            line = page.line_at(m.start())
            around = page.around(line)
            page.link(around, page.add("trpc_call", f"{m[2]} {m[1]}", line, via=None, protocol="trpc", procedure=m[1], callType=m[2]), "CALLS_TRPC", 0.75)


def terraform(page: Page) -> None:
    for m in R.TERRAFORM.finditer(page.text):
        line = page.line_at(m.start() + len(m[0]) - len(m[0].lstrip()))
        end = block_end("terraform", page.lines, line)
        if m[1]:
            page.add(m[1], f"{m[2]}.{m[3]}", line, end, via=("DECLARES", 1), providerType=m[2], name=m[3])
            continue
        body = "\n".join(page.lines[line - 1 : end])
        source = re.search(r'^\s*source\s*=\s*"([^"]+)"', body, re.M) if m[4] == "module" else None
        qualified = page.add(m[4], m[5], line, end, via=("DECLARES", 1), name=m[5], **({"source": source[1]} if source else {}))
        if source:
            page.link(qualified, f"external:{source[1].strip()}", "IMPORTS", 0.75, source=source[1])


def dockerfile(page: Page) -> None:
    stages, current = {}, None
    for k, line in enumerate(page.lines, 1):
        if m := re.match(r"\s*FROM\s+(\S+)(?:\s+AS\s+([A-Za-z0-9_.-]+))?", line, re.I):
            number = sum(x.isdigit() for x in stages)
            name = m[2] or f"stage-{number + 1}"
            current = page.add("stage", name, k, signature=line.strip(), exported=True, via=("DECLARES", 1), image=m[1], alias=m[2])
            image = page.add("container_image", m[1], k, via=("DECLARES", 0.7), image=m[1])
            page.link(current, image, "IMPORTS", 0.9, instruction="FROM")
            stages[name.lower()] = stages[str(number)] = current
        elif current and (m := re.match(r"\s*COPY\s+.*--from=(\S+)", line, re.I)) and m[1].lower() in stages:
            page.link(current, stages[m[1].lower()], "IMPORTS", 0.75, instruction="COPY --from", line=k)


def _child_lines(lines: list[str], keys: list[str]):
    """(key, line number, line) of the lines that lie deeper than a line that is one of ``keys`` alone."""
    head = re.compile(rf"(\s*)({'|'.join(map(re.escape, keys))})\s*:\s*(?:#.*)?")
    for k, line in enumerate(lines):
        m = head.fullmatch(line)
        if not m:
            continue
        for j in range(k + 1, len(lines)):
            if lines[j].strip():
                if len(lines[j]) - len(lines[j].lstrip()) <= len(m[1]):
                    break
                yield m[2], j + 1, lines[j]


_SCALAR = r"""\s*{}\s*:\s*["']?([^"'#]+?)["']?\s*(?:#.*)?"""


def _scalar(lines: list[str], key: str) -> tuple[str, int] | None:
    for k, line in enumerate(lines, 1):
        if m := re.fullmatch(_SCALAR.format(key), line):
            return m[1].strip(), k
    return None


def infrastructure(page: Page) -> None:
    """Resources and images of YAML documents; what a kustomization brings together."""
    documents, begin = [], 0
    for k, line in enumerate([*page.lines, "---"]):
        if re.fullmatch(r"\s*---\s*", line) and any(x.strip() for x in page.lines[begin:k]):
            documents.append((begin, page.lines[begin:k]))
            begin = k + 1
    kinds = []
    for begin, lines in documents:
        kind = _scalar(lines, "kind")
        kinds.append((kind or ("", 0))[0].lower())
        inner = [line for _, _, line in _child_lines(lines, ["metadata"])]
        name = _scalar(inner, "name") or _scalar(lines, "name")
        if not kind or not name:
            continue
        resource = page.add("resource", f"{kind[0]}/{name[0]}", begin + kind[1], via=("DECLARES", 1), kind=kind[0], name=name[0])
        for k, line in enumerate(lines, 1):
            if m := re.fullmatch(r"""\s*image\s*:\s*["']?([^"'#\s]+)["']?\s*(?:#.*)?""", line):
                page.link(resource, page.add("container_image", m[1], begin + k, via=None, image=m[1]), "CONFIGURES", 0.8, field="image")
    if posixpath.basename(page.path).lower() in ("kustomization.yaml", "kustomization.yml") or "kustomization" in kinds:
        folder = posixpath.dirname(page.path)
        module = page.add("module", f"Kustomization/{folder or '.'}", 1, len(page.lines), via=("DECLARES", 1), path=page.path)
        for key, _, line in _child_lines(page.lines, ["resources", "bases", "components"]):
            if m := re.fullmatch(r"""\s*-\s*["']?([^"'#]+?)["']?\s*(?:#.*)?""", line):
                value = m[1].strip()
                outside = re.match(r"[a-z]+://", value, re.I) or value.startswith("git::")
                target = f"external:{value}" if outside else posixpath.normpath(posixpath.join(folder, value))
                page.link(module, f"{target}:file", "IMPORTS", 0.7, field=key, value=value)


def extract(path: str, language: str, text: str) -> Page:
    """Everything that the rules find in a file."""
    page = Page(path, language, text)
    page.symbols[page.file] = {"qualified_name": page.file, "name": posixpath.basename(path), "kind": "file", "start_line": 1, "end_line": len(page.lines), "signature": None, "exported": 0, "metadata": json.dumps({"path": path})}
    for name in imports(page):
        page.link(page.file, f"external:{name}", "IMPORTS", 1, **{"import": name})
    routes(page)
    for kind, name, line, told in manifest(path, text):
        page.add(kind, name, line, exported=kind == "package", via=("DECLARES", 1), **told)
    for key, line, how, words in config_keys(path, language, text):
        page.add("config_key", key[:180], line, via=("DECLARES", 0.85), key=key, normalizedKey="_".join(words), source=how)
    lock, held = locked(path, text)
    if held:
        file = page.add("lockfile", posixpath.basename(path), 1, len(page.lines), via=("DECLARES", 1), **lock, lockedDependencies=len(held))
        for name, version, line in held:
            told = {**lock, **({"version": version} if version else {})}
            page.link(file, page.add("locked_dependency", name, line, via=None, **told), "LOCKS", 0.8, **told)
    if language == "markdown":
        for k, line in enumerate(page.lines, 1):
            if m := R.HEADING.fullmatch(line):
                page.add("heading", m[2].strip(), k, signature=line.strip(), level=len(m[1]))
    elif language == "sql":
        for m in R.DDL.finditer(text):
            page.add(m[1].lower(), m[2], page.line_at(m.start()), via=("DECLARES", 1))
    elif language == "yaml":
        infrastructure(page)
    elif language == "terraform":
        terraform(page)
    base = posixpath.basename(path).lower()
    if base == "dockerfile" or base.endswith(".dockerfile"):
        dockerfile(page)
    declarations(page)
    channels(page)
    http_calls(page)
    protocols(page)
    return page
