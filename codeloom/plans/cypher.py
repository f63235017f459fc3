"""A read-only subset of Cypher, compiled to DataFrame operations.

MATCH (a[:Label])[-[r:TYPE]->(b) | <-[r:TYPE]-(b)] [WHERE ..] RETURN [DISTINCT] .. [ORDER BY ..] [SKIP n] [LIMIT n].
WHERE has comparisons joined by AND and OR (AND binds tighter); text comparisons ignore case.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class GraphQueryError(ValueError):
    """The query is not in the supported language."""


NODE = {"id": "id", "name": "name", "kind": "kind", "label": "kind", "language": "language", "filepath": "file_path", "file": "file_path", "qualifiedname": "qualified_name", "qualified": "qualified_name", "startline": "start_line", "endline": "end_line", "signature": "signature", "exported": "exported"}
EDGE = {"type": "type", "source": "source", "target": "target", "weight": "weight"}
WRITES = {"create", "merge", "set", "delete", "detach", "remove", "drop", "call", "load", "foreach", "insert", "update"}
TOKEN = re.compile(r"""\s*(?:(?P<text>'[^']*'|"[^"]*")|(?P<number>-?\d+(?:\.\d+)?)|(?P<sign><>|<=|>=|->|<-|[-=<>(),.:*\[\]])|(?P<word>[A-Za-z_]\w*))""")


def tokens(text: str) -> list[tuple[str, str]]:
    out, at, text = [], 0, text.strip().rstrip(";").rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m or m.end() == at:
            raise GraphQueryError(f"unexpected text at {text[at : at + 20]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    if any(kind == "word" and value.lower() in WRITES for kind, value in out):
        raise GraphQueryError("only reading is supported")
    return out


class Parser:
    def __init__(self, text: str):
        self.rest = tokens(text)

    def peek(self, value: str) -> bool:
        return bool(self.rest) and self.rest[0][0] in ("word", "sign") and self.rest[0][1].lower() == value.lower()

    def take(self, value: str) -> bool:
        if self.peek(value):
            self.rest.pop(0)
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise GraphQueryError(f"expected {value!r}" + (f" before {self.rest[0][1]!r}" if self.rest else " at the end"))

    def kind(self, kind: str) -> str:
        if not self.rest or self.rest[0][0] != kind:
            raise GraphQueryError(f"expected a {kind}")
        return self.rest.pop(0)[1]

    def node(self) -> tuple[str, str | None]:
        self.need("(")
        alias, label = self.kind("word"), None
        if self.take(":"):
            label = re.sub("node$", "", self.kind("word").lower())
        self.need(")")
        return alias, label

    def edge(self) -> tuple[str, str | None]:
        if not self.take("["):
            return "e", None
        alias = "e" if self.peek(":") or self.peek("]") else self.kind("word")
        kind = self.kind("word").upper() if self.take(":") else None
        self.need("]")
        return alias, kind

    def property(self) -> tuple[str, str | None]:
        alias = self.kind("word")
        return alias, self.kind("word") if self.take(".") else None

    def value(self) -> str:
        if not self.rest or self.rest[0][0] not in ("text", "number"):
            raise GraphQueryError("expected a value")
        kind, value = self.rest.pop(0)
        return value[1:-1] if kind == "text" else value


def query_graph(symbols: DataFrame, edges: DataFrame, text: str, limit: int = 100) -> DataFrame:
    """The rows of ``text``; joins are equi-joins on qualified names, so edges to unknown symbols drop."""
    p = Parser(text)
    p.need("match")
    a, label_a = p.node()
    nodes, edge = {a: label_a}, None
    if p.take("<-"):
        edge = (*p.edge(), "in")
        p.need("-")
    elif p.take("-"):
        edge = (*p.edge(), "out")
        p.need("->")
    if edge:
        b, label_b = p.node()
        if b == a:
            raise GraphQueryError("both nodes have one name")
        nodes[b] = label_b

    def column(alias: str, name: str | None) -> Column:
        key = re.sub("_", "", (name or "qualifiedName").lower())
        known = NODE if alias in nodes else EDGE if edge and alias in (edge[0], "e") else None
        if known is None or key not in known:
            raise GraphQueryError(f"unknown property {alias}.{name}")
        return F.col(f"{'r' if known is EDGE else 'a' if alias == a else 'b'}_{known[key]}")

    def condition() -> Column:
        left = column(*p.property())
        folded = F.lower(left.cast("string"))
        like = lambda v: v.lower().replace("\\", "\\\\")  # _ and % stay wildcards
        if p.take("contains"):
            return folded.like("%" + like(p.value()) + "%")
        for side, test in (("starts", "{}%"), ("ends", "%{}")):
            if p.take(side):
                p.need("with")
                return folded.like(test.format(like(p.value())))
        if p.take("in"):
            close = "]" if p.take("[") else ")"
            if close == ")":
                p.need("(")
            items = [p.value().lower()]
            while p.take(","):
                items.append(p.value().lower())
            p.need(close)
            return folded.isin(items)
        sign = p.kind("sign")
        if sign in ("=", "<>"):
            same = folded == p.value().lower()
            return same if sign == "=" else ~same
        leading = F.regexp_extract(left.cast("string"), r"^\s*([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)", 1)
        number = F.coalesce(leading.try_cast("double"), F.lit(0.0))
        if sign not in ("<", "<=", ">", ">="):
            raise GraphQueryError(f"unknown comparison {sign}")
        try:
            bound = float(p.value())
        except ValueError as e:
            raise GraphQueryError("expected a number") from e
        return {"<": number < bound, "<=": number <= bound, ">": number > bound, ">=": number >= bound}[sign]

    wanted = None
    if p.take("where"):
        options = [[condition()]]
        while p.peek("and") or p.peek("or"):
            if p.take("and"):
                options[-1].append(condition())
            else:
                p.need("or")
                options.append([condition()])
        wanted = reduce(Column.__or__, [reduce(Column.__and__, x) for x in options])
    p.need("return")
    distinct, outputs, count = p.take("distinct"), [], None
    while True:
        if p.take("count"):
            p.need("(")
            if p.take("*"):
                count = F.count(F.lit(1))
            else:
                once = p.take("distinct")
                count = (F.countDistinct if once else F.count)(column(*p.property()))
            p.need(")")
            name = p.kind("word") if p.take("as") else "count"
            outputs.append((name, count))
        else:
            alias, prop = p.property()
            col = column(alias, prop)
            outputs.append((p.kind("word") if p.take("as") else f"{alias}.{prop or 'qualifiedName'}", col))
        if not p.take(","):
            break
    if count is not None and len(outputs) > 1:
        raise GraphQueryError("count stands alone")
    order = []
    if p.take("order"):
        p.need("by")
        while True:
            key = column(*p.property())
            down = p.take("desc")
            if not down:
                p.take("asc")
            order.append((key, down))
            if not p.take(","):
                break

    def number(word: str, default: int) -> int:
        if not p.take(word):
            return default
        digits = p.kind("number")
        if not digits.isdigit():
            raise GraphQueryError(f"{word} takes a whole number")
        return min(int(digits), 2**31 - 1)

    skip = number("skip", 0)
    most = number("limit", limit)
    if p.rest:
        raise GraphQueryError(f"unexpected {p.rest[0][1]!r}")

    side = lambda prefix, label: (symbols.where(F.lower("kind") == label) if label else symbols).select(*(F.col(c).alias(f"{prefix}_{c}") for c in symbols.columns))
    rows = side("a", label_a)
    if edge:
        typed = (edges.where(F.col("type") == edge[1]) if edge[1] else edges).select(*(F.col(c).alias(f"r_{c}") for c in edges.columns))
        near, far = ("r_source", "r_target") if edge[2] == "out" else ("r_target", "r_source")
        rows = typed.join(rows, F.col(near) == F.col("a_qualified_name")).join(side("b", label_b), F.col(far) == F.col("b_qualified_name"))
    if wanted is not None:
        rows = rows.where(wanted)
    if count is not None:
        out = rows.agg(outputs[0][1].alias(outputs[0][0]))  # one row, whatever its order
    else:
        chosen = [c.alias(name) for name, c in outputs]
        turned = lambda cs: [c.desc() if down else c.asc() for c, (_, down) in zip(cs, order)]
        if distinct:
            # keys of the order need not be among the outputs: equal rows stand where the first of them does
            first = [(F.max if down else F.min)(key).alias(f"_k{i}") for i, (key, down) in enumerate(order)]
            grouped = rows.groupBy(*chosen).agg(F.count(F.lit(1)).alias("_n"), *first)
            keys = turned([F.col(f"_k{i}") for i in range(len(order))])
            out = (grouped.orderBy(*keys) if keys else grouped).select(*(F.col(f"`{name}`") for name, _ in outputs))
        else:
            out = (rows.orderBy(*turned([key for key, _ in order])) if order else rows).select(*chosen)
    return out.offset(skip).limit(min(max(most, 1), 500)) if skip else out.limit(min(max(most, 1), 500))
