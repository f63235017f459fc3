"""The driver's star-schema tables as a code graph: symbols, edges, files, lines, routes.

Parts are functions, consecutive returned parts of an order call each other, documents are
source files, pages are HTTP routes, events are runtime traces.  ``code`` renders a source file of each part, so that
extraction has something to find.  Every view is one SQL text over the base tables and earlier views; Spark registers them as
temporary views, so plans stay declarative and only the views a query names are ever computed.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "embeddings")

#: text of a source file: TypeScript, Python, SQL or Markdown by the part's number; q is a quote, nl ends a line
_CODE = """CASE k % 4 WHEN 0 THEN concat(
  'import { helper } from ', q, './part_', near, q, nl, 'export class Part', key, ' extends Part', near, ' {', nl,
  '  load_', key, '(order) {', nl, '    fetch(', q, '/api/', brand, '/', five, q, ', { method: ', q, 'POST', q, ' })', nl, '    bus.emit(', q, 'part.', seven, q, ')', nl, '  }', nl, '}', nl,
  'export function make_', name, '(order) {', nl, '  helper_', near, '(order)', nl, '}', nl, 'function helper_', key, '(item) {', nl, '  bus.on(', q, 'part.', three, q, ', item)', nl, '}', nl,
  'app.', CASE WHEN k % 8 = 0 THEN 'post' ELSE 'get' END, '(', q, '/api/', brand, '/', five, q, ', make_', name, ')')
WHEN 1 THEN concat('import os', nl, 'class Part', key, '(Base):', nl, '    def run_', name, '(self):', nl, '        pass', nl, 'def tool_', key, '():', nl, '    return 1')
WHEN 2 THEN concat('CREATE TABLE t_', key, ' (id INT);', nl, nl, 'create index if not exists i_', key, ' ON t_', key, ' (id);')
ELSE concat('# Part ', key, nl, 'text', nl, '### ', name, ' ', nl, '#no heading') END"""

VIEWS: dict[str, str] = {
    "symbols": """
SELECT p_partkey AS id, concat('part:', CAST(p_partkey AS STRING)) AS qualified_name, concat(replace(p_name, ' ', '_'), '_', CAST(p_partkey AS STRING)) AS name,
  CASE p_partkey % 4 WHEN 0 THEN 'class' WHEN 1 THEN 'method' ELSE 'function' END AS kind,
  concat('src/', replace(p_brand, ' ', '_'), '/', replace(p_type, ' ', '_'), '/part_', CAST(p_partkey AS STRING), '.ts') AS file_path, 'typescript' AS language,
  CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END AS exported, p_size AS start_line, p_size + 10 AS end_line,
  concat('function ', replace(p_name, ' ', '_'), '(', lower(p_type), ')') AS signature,
  concat('{"size": ', CAST(p_size AS STRING), ', "brand": "', p_brand, CASE WHEN p_partkey % 2 = 0 THEN '", "tag": 1}' ELSE '", "tag": "x"}' END) AS metadata
FROM part""",
    "edges": """
SELECT concat('part:', CAST(s AS STRING)) AS source, concat('part:', CAST(t AS STRING)) AS target, 'CALLS' AS type, CAST(count(*) AS DOUBLE) AS weight
FROM (SELECT l_partkey AS s, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS t FROM lineitem WHERE l_returnflag = 'R') x
WHERE t IS NOT NULL AND s <> t GROUP BY s, t""",
    "files": """
SELECT doc_id, concat('src/', source, '/', lang, '/doc_', CAST(doc_id AS STRING), '.md') AS path, lang AS language, source AS project, text, length(text) AS chars FROM documents""",
    "indexed": """
SELECT path, language, CAST(length(text) AS BIGINT) AS bytes, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INT) AS lines, doc_id % 9 = 0 AS skipped FROM files""",
    "part_files": """
SELECT file_path AS path, language, CAST(start_line * 100 AS BIGINT) AS bytes, start_line * 10 AS lines, id % 9 = 0 AS skipped FROM symbols""",
    "code": f"""
SELECT k, key, name, brand, concat('src/', brand, '/part_', key, CASE k % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' WHEN 2 THEN '.sql' ELSE '.md' END) AS path, {_CODE} AS text
FROM (SELECT p_partkey AS k, CAST(p_partkey AS STRING) AS key, CAST(p_partkey + 4 AS STRING) AS near, CAST(p_partkey % 5 AS STRING) AS five, CAST(p_partkey % 7 AS STRING) AS seven, CAST(p_partkey % 3 AS STRING) AS three,
  concat(replace(p_name, ' ', '_'), '_', CAST(p_partkey AS STRING)) AS name, replace(replace(p_brand, ' ', '_'), '#', '') AS brand, chr(10) AS nl, chr(39) AS q FROM part) x""",
    "star": """
SELECT concat('nation:', CAST(n_nationkey AS STRING)) AS source, concat('region:', CAST(n_regionkey AS STRING)) AS target, 'IN_REGION' AS type, CAST(1 AS DOUBLE) AS weight FROM nation
UNION ALL SELECT concat('supplier:', CAST(s_suppkey AS STRING)), concat('nation:', CAST(s_nationkey AS STRING)), 'IN_NATION', CAST(1 AS DOUBLE) FROM supplier
UNION ALL SELECT concat('part:', CAST(l_partkey AS STRING)), concat('supplier:', CAST(l_suppkey AS STRING)), 'SUPPLIED_BY', CAST(count(*) AS DOUBLE) FROM lineitem GROUP BY l_partkey, l_suppkey""",
    "service_calls": """
SELECT source AS project, concat('GET /', lang) AS endpoint, 'GET' AS method, CASE WHEN doc_id % 5 = 0 THEN h.host END AS host
FROM documents LEFT JOIN (SELECT page_id, regexp_extract(url, '://([^/]+)', 1) AS host FROM pages) h ON h.page_id = doc_id""",
    "service_routes": """
SELECT DISTINCT regexp_extract(url, '://([^/]+)', 1) AS project, concat('GET /', regexp_extract(url, '://[^/]+/([^/?#]+)', 1)) AS endpoint FROM pages WHERE regexp_extract(url, '://[^/]+/([^/?#]+)', 1) <> ''""",
    "dependencies": """
SELECT DISTINCT concat('team-', CAST(s_nationkey AS STRING)) AS project, p_brand AS name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey WHERE l_quantity >= 48""",
    "changes": """
SELECT file_path AS path, CASE id % 3 WHEN 0 THEN 'modified' WHEN 1 THEN 'deleted' ELSE 'renamed' END AS status FROM symbols WHERE id % 50 = 0 UNION ALL SELECT 'src/new.ts' AS path, 'untracked' AS status""",
    "history": """
SELECT row_number() OVER (ORDER BY o_orderdate DESC, l_orderkey DESC, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS seq, CAST(l_orderkey AS STRING) AS commit, CAST(o_custkey AS STRING) AS author, CAST(l_linenumber AS STRING) AS date,
  concat('part_', CAST(l_partkey AS STRING)) AS path, CAST(l_quantity AS INT) AS added, l_linenumber AS deleted FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    "imports": """
SELECT cn.n_name AS source, sn.n_name AS target, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN nation sn ON s_nationkey = sn.n_nationkey
WHERE l_discount >= 0.10 AND l_quantity >= 49 AND c_nationkey % 5 <> s_nationkey % 5 AND s_nationkey - c_nationkey BETWEEN -4 AND 6 AND c_nationkey <> s_nationkey
GROUP BY cn.n_name, sn.n_name""",
}


def register(spark: SparkSession, sf_dir: str) -> None:
    """Temporary views of the tables and of the graph over ``sf_dir``."""
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    for name, text in VIEWS.items():
        spark.sql(text).createOrReplaceTempView(name)


def with_views(text: str) -> str:
    """``text`` as one statement for an engine that has the tables alone."""
    wanted: set[str] = set()
    todo = [text]
    while todo:
        said = todo.pop()
        for name, sql in VIEWS.items():
            if name not in wanted and re.search(rf"\b{name}\b", said):
                wanted.add(name)
                todo.append(sql)
    views = ", ".join(f"{name} AS ({VIEWS[name].replace('AS STRING', 'AS VARCHAR')})" for name in VIEWS if name in wanted)
    return f"WITH {'RECURSIVE ' if 'RECURSIVE' in text else ''}{views} {text}" if views else text
