"""Queries of the text, path and scanner expressions over documents, pages and lines of code."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import scanners
from .projection import pick, read

FOLDERS = ["src", "a/node_modules/b", "./lib//x", "pkg/tests", "vendor/z", "deep/./target/t", "docs", "app/.venv/y", "buildx", "third_party"]
NAMES = ["mod{}.py", "main{}.min.js", "x{}.test.ts", "lib{}.js", "a{}.pb.go", "y{}_test.rs", "z{}.h", "n{}.json", "s{}.tsx", ".hidden{}", "Make{}", "w{}.ts.py", "q{}.cpp"]
CODE = ['import "lib/x{}";', "#include <a{}.h>", "class Foo{} {{", "public class Bar{}", "fn run{}() {{", "if (x{}) {{", "  call{}(arg, b.c(d));", "func add{}(a) {{", "struct S{} {{", "use std::v{};", "def m{}(self):",
        "x{} = f(3)", "export const k{} = (a) => a;", "import {{ z }} from './m{}';", "method{}(a, b) {{", "export default class D{} {{", "pub fn p{}()", "var w{} = require('r');", "type T{} = string;", "from pkg{} import y", "  ", "return g{}(1)"]


def _sql(templates: list[str], number: str) -> str:
    return "[" + ", ".join("'" + t.format("\x01").replace("'", "''").replace("\x01", f"' || {number} || '") + "'" for t in templates) + "]"


def _spark(templates: list[str], number: F.Column):
    def one(t: str):
        a, _, b = t.format("\x01").partition("\x01")
        return F.concat(F.lit(a), number, F.lit(b)) if "\x01" in t.format("\x01") else F.lit(a)

    return [one(t) for t in templates]


def paths(spark, d):
    i = F.col("page_id")
    n = i.cast("string")
    name = F.element_at(F.array(*_spark(NAMES, n)), (i % len(NAMES) + 1).cast("int"))
    return read(spark, d, "pages").select("page_id", F.concat(pick(FOLDERS, i % len(FOLDERS)), F.lit("/"), name).alias("path"), F.col("html").alias("text"))


PATHS = f"paths AS (SELECT page_id, {_sql(FOLDERS, '')}[page_id % {len(FOLDERS)} + 1] || '/' || {_sql(NAMES, 'page_id')}[page_id % {len(NAMES)} + 1] AS path, html AS text FROM pages)".replace("{}", "")


def code(spark, d):
    """A line of code an order, in the file of its customer."""
    k = F.col("o_orderkey")
    line = F.element_at(F.array(*_spark(CODE, F.col("o_custkey").cast("string"))), (k % len(CODE) + 1).cast("int"))
    return read(spark, d, "orders").select("o_custkey", "o_orderkey", line.alias("line"), F.trim(line).alias("t"))


CODE_SQL = f"code AS (SELECT o_custkey, o_orderkey, line, trim(line) AS t FROM (SELECT *, {_sql(CODE, 'o_custkey')}[o_orderkey % {len(CODE)} + 1] AS line FROM orders))"
LINES = r"""lines AS (SELECT doc_id, i - 1 AS i, regexp_replace(line, '\r$', '') AS line FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '\n$', ''), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(text, '\n$', ''), chr(10)), 1) AS i FROM documents WHERE text <> ''))"""
_ID = "[A-Za-z0-9_$]+"


def after(*prefixes: str, line: str = "t") -> str:
    import re

    return "coalesce(" + ", ".join(f"nullif(regexp_extract(ltrim({line}), '^{re.escape(p).replace(chr(92) + ' ', ' ')}\\s*({_ID})', 1), '')" for p in prefixes) + ")"


def line_spans(spark, d):
    rows = scanners.source_lines(read(spark, d, "documents"), "doc_id")
    return rows.select("doc_id", F.col("i").cast("long").alias("i"), "span.byte_start", "span.byte_end", F.col("span.start.line").alias("line"), F.col("span.end.column").alias("col_end"))


def span_text(spark, d):
    rows = scanners.source_lines(read(spark, d, "documents"), "doc_id").select("doc_id", "i", "span")
    rows = rows.join(read(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return rows.select("doc_id", F.col("i").cast("long").alias("i"), X.fingerprint(X.span_text("text", "span")).alias("hash"))


def read_identifier(spark, d):
    rows = scanners.source_lines(read(spark, d, "documents"), "doc_id")
    return rows.select("doc_id", F.col("i").cast("long").alias("i"), X.read_identifier("line").alias("name"))


def quoted_module(spark, d):
    return read(spark, d, "pages").select("page_id", X.quoted_module("html").alias("module"))


def call_identifiers(spark, d):
    return code(spark, d).select("o_orderkey", F.posexplode(X.call_identifiers("line")).alias("pos", "call")).withColumn("pos", F.col("pos").cast("long"))


def fingerprint(spark, d):
    return read(spark, d, "pages").select("page_id", X.fingerprint("html").alias("fingerprint"))


def path_functions(spark, d):
    p = paths(spark, d)
    return p.select("page_id", X.normalize_path("path").alias("normal"), X.file_stem("path").alias("stem"), X.module_stem("path").alias("module"), X.extension("path").alias("ext"))


def vendor_filter(spark, d):
    return paths(spark, d).where(X.is_vendor_or_generated("path")).select("page_id", "path")


def test_path(spark, d):
    return paths(spark, d).where(X.is_test_path("path")).select("page_id", "path")


def path_candidate(spark, d):
    return paths(spark, d).where(X.path_candidate("path")).select("page_id", "path")


def language_detect(spark, d):
    return paths(spark, d).select("page_id", X.detect_language("path", "text").alias("language"))


def binary_filter(spark, d):
    content = F.when(F.col("doc_id") % 5 == 0, F.concat(F.substring("text", 1, 60), F.lit("\0"), F.col("text"))).otherwise(F.col("text")).cast("binary")
    return read(spark, d, "documents").where(X.is_binary(content)).select("doc_id")


def stem_shards(spark, d):
    return read(spark, d, "part").select("p_partkey", X.shard("p_name").cast("long").alias("shard"))


def scan_brace(spark, d):
    return code(spark, d).select("o_orderkey", scanners.brace_import("t").alias("import"), scanners.brace_type("t").alias("type"), scanners.brace_function("t").alias("function"))


def scan_rust(spark, d):
    return code(spark, d).select("o_orderkey", scanners.rust_import("t").alias("import"), scanners.rust_function("t").alias("function"))


def scan_python(spark, d):
    s = scanners.python_symbol("t")
    return code(spark, d).select("o_orderkey", scanners.python_import("t").alias("import"), s["name"].alias("name"), s["kind"].alias("kind"))


def scan_typescript(spark, d):
    s = scanners.ts_symbol("t")
    return code(spark, d).select("o_orderkey", scanners.ts_import("t").alias("import"), scanners.ts_export("t").alias("export"), s["name"].alias("name"), s["kind"].alias("kind"), F.array_join(scanners.ts_calls("t"), ",").alias("calls"))


def enclosing_decl(spark, d):
    rows = code(spark, d).withColumn("name", scanners.ts_symbol("t")["name"])
    return rows.select("o_orderkey", scanners.enclosing_symbol(rows, "o_custkey", "o_orderkey", "name").alias("scope"))


def json_deps(spark, d):
    keys = F.json_object_keys("props")
    return read(spark, d, "events").select("event_id", "props", F.explode(keys).alias("key")).select("event_id", "key", F.get_json_object("props", "$.k").alias("value"))


def _w(cte: str, sql: str) -> str:
    return f"WITH {cte}\n{sql}"


_FN = r"regexp_extract(string_split(t, '(')[1], '([A-Za-z0-9_]+)[^A-Za-z0-9_]*$', 1)"
_VAR = after("export const ", "const ", "export let ", "let ", "export var ", "var ")
_METHOD = f"NOT starts_with(t, '//') AND contains(t, '(') AND ends_with(t, '{{')  AND regexp_extract(t, '^({_ID})', 1) NOT IN ('if', 'for', 'while', 'switch', 'catch', '')"
_PAIRS = [("export function ", "function "), ("export class ", "class "), ("export interface ", "interface "), ("export type ", "type "), ("export enum ", "enum ")]
_KINDS = ["function", "class", "interface", "type-alias", "enum"]
TS_NAME = "CASE " + " ".join(f"WHEN {after(*p)} IS NOT NULL THEN {after(*p)}" for p in _PAIRS) + f" WHEN {_VAR} IS NOT NULL THEN {_VAR} WHEN {_METHOD} THEN regexp_extract(t, '^({_ID})', 1) END"
TS_KIND = "CASE " + " ".join(f"WHEN {after(*p)} IS NOT NULL THEN '{k}'" for p, k in zip(_PAIRS, _KINDS, strict=True)) + f" WHEN {_VAR} IS NOT NULL AND (contains(t, '=>') OR contains(t, 'function')) THEN 'function' WHEN {_VAR} IS NOT NULL THEN 'variable' WHEN {_METHOD} THEN 'method' END"
_QUOTED = "coalesce(CASE WHEN regexp_matches({x}, '(?s)\".*?\"') THEN regexp_extract({x}, '(?s)^[^\"]*\"([^\"]*)\"', 1) END, CASE WHEN regexp_matches({x}, '(?s)''.*?''') THEN regexp_extract({x}, '(?s)^[^'']*''([^'']*)''', 1) END)"
_CALLS = f"list_filter(list_transform(string_split({{x}}, '('), lambda x: regexp_extract(regexp_replace(x, '\\s+$', ''), '([A-Za-z0-9_$]*)$', 1)), lambda y: y <> '' AND y NOT IN {tuple(X.NO_CALLS)})"
_EXT = r"regexp_extract(string_split(path, '/')[-1], '^.+\.([^.]*)$', 1)"
_HAS = lambda *words: "(" + " OR ".join(f"contains(text, '{w}')" for w in words) + ")"
_SHEBANG = "(starts_with(text, '#!') AND contains(regexp_extract(text, '^([^\\r\\n]*)', 1), '{}'))"
_IN = lambda lang: f"{_EXT} IN ({', '.join(repr(e) for e in X.ENDINGS[lang])})"
_NAME = "string_split(path, '/')[-1]"
DETECT = (
    f"CASE WHEN {_IN('objective-c')} OR ({_EXT} = 'h' AND {_HAS('@interface', '@implementation', '@protocol')}) THEN 'objective-c' WHEN {_IN('cpp')} OR ({_EXT} = 'h' AND {_HAS('namespace ', 'template <', 'class ')}) THEN 'cpp' "
    f"WHEN {_IN('c')} OR ({_EXT} = 'h' AND NOT {_HAS('@interface', '@protocol', 'namespace ', 'template <', 'class ')}) THEN 'c' WHEN {_IN('go')} THEN 'go' WHEN {_IN('java')} THEN 'java' "
    f"WHEN {_IN('json')} OR (({_NAME} = 'package-lock.json' OR starts_with({_NAME}, 'tsconfig')) AND starts_with(ltrim(text), '{{')) THEN 'json' WHEN {_IN('rust')} OR {_SHEBANG.format('rust-script')} THEN 'rust' "
    f"WHEN {_IN('javascript')} OR {_NAME} = 'vite.config.js' OR {_SHEBANG.format('node')} THEN 'javascript' WHEN {_IN('typescript')} THEN 'typescript' "
    f"WHEN {_IN('python')} OR {_NAME} IN ('SConstruct', 'SConscript') OR {_SHEBANG.format('python')} THEN 'python' ELSE 'unknown' END"
)
_STEM = r"nullif(regexp_replace(regexp_replace(regexp_replace(string_split(path, '/')[-1], '\.js$', ''), '\.ts$', ''), '\.py$', ''), '')"
_ENDS = lambda *ends: " OR ".join(f"ends_with(path, '{e}')" for e in ends)
QUERIES = {
    "q_line_spans": (line_spans, _w(LINES, "SELECT doc_id, i, before AS byte_start, before + strlen(line) AS byte_end, i + 1 AS line, length(line) + 1 AS col_end FROM (SELECT *, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM lines)")),
    "q_span_text": (span_text, _w(LINES, "SELECT doc_id, i, sha256(line) AS hash FROM lines")),
    "q_read_identifier": (read_identifier, _w(LINES, f"SELECT doc_id, i, nullif(regexp_extract(line, '^({_ID})', 1), '') AS name FROM lines")),
    "q_quoted_module": (quoted_module, f"SELECT page_id, {_QUOTED.format(x='html')} AS module FROM pages"),
    "q_call_identifiers": (call_identifiers, _w(CODE_SQL, f"SELECT o_orderkey, unnest(range(len(c)))::BIGINT AS pos, unnest(c) AS call FROM (SELECT o_orderkey, {_CALLS.format(x='line')} AS c FROM code)")),
    "q_fingerprint": (fingerprint, "SELECT page_id, sha256(html) AS fingerprint FROM pages"),
    "q_path_functions": (path_functions, _w(PATHS, rf"SELECT page_id, array_to_string(list_filter(string_split(path, '/'), lambda x: x NOT IN ('', '.')), '/') AS normal, CASE WHEN regexp_matches({_NAME}, '.\.[^.]*$') THEN regexp_replace({_NAME}, '\.[^.]*$', '') ELSE {_NAME} END AS stem, {_STEM} AS module, {_EXT} AS ext FROM paths")),
    "q_vendor_filter": (vendor_filter, _w(PATHS, f"SELECT page_id, path FROM paths WHERE list_has_any(string_split(path, '/'), ['node_modules', '.git', 'target', 'dist', 'build', 'third_party', 'vendor', '.venv', '__pycache__']) OR {_ENDS('.min.js', '.generated.ts', '.generated.py', '.pb.go')}")),
    "q_test_path": (test_path, _w(PATHS, f"SELECT page_id, path FROM paths WHERE contains(path, '/tests/') OR {_ENDS('_test.rs', '_test.ts', '_test.py', '.test.ts', '.spec.ts')}")),
    "q_path_candidate": (path_candidate, _w(PATHS, f"SELECT page_id, path FROM paths WHERE {_EXT} IN ('h', '', {', '.join(repr(e) for es in X.ENDINGS.values() for e in es)}) OR {_NAME} IN ('SConstruct', 'SConscript', 'package-lock.json') OR starts_with({_NAME}, 'tsconfig')")),
    "q_language_detect": (language_detect, _w(PATHS, f"SELECT page_id, {DETECT} AS language FROM paths")),
    "q_binary_filter": (binary_filter, "SELECT doc_id FROM documents WHERE doc_id % 5 = 0"),
    "q_stem_shards": (stem_shards, "SELECT p_partkey, ('0x' || substr(sha256(p_name), 1, 2))::BIGINT AS shard FROM part"),
    "q_scan_brace": (scan_brace, _w(CODE_SQL, (
        "SELECT o_orderkey, CASE WHEN starts_with(t, '#include') THEN trim(substr(t, 9)) WHEN starts_with(t, 'import ') THEN regexp_replace(regexp_replace(trim(substr(t, 8)), ';+$', ''), '^\"+|\"+$', '', 'g') WHEN starts_with(t, '@import ') THEN regexp_replace(trim(substr(t, 9)), ';+$', '') END AS import, "
        f"{after(*scanners.TYPE_PREFIXES)} AS type, CASE WHEN contains(t, '(') AND NOT ends_with(t, ';') AND {_FN} NOT IN ('', 'if', 'for', 'while', 'switch', 'return') THEN {_FN} END AS function FROM code"))),
    "q_scan_rust": (scan_rust, _w(CODE_SQL, f"SELECT o_orderkey, CASE WHEN starts_with(t, 'use ') THEN regexp_replace(substr(t, 5), ';+$', '') END AS import, {after('fn ', 'pub fn ', 'async fn ', 'pub async fn ')} AS function FROM code")),
    "q_scan_python": (scan_python, _w(CODE_SQL, (
        f"SELECT o_orderkey, {after('import ', 'from ')} AS import, coalesce({after('async def ', 'def ')}, {after('class ')}, a) AS name, CASE WHEN {after('async def ', 'def ')} IS NOT NULL THEN 'function' WHEN {after('class ')} IS NOT NULL THEN 'class' WHEN a IS NOT NULL THEN 'variable' END AS kind "
        f"FROM (SELECT *, CASE WHEN contains(t, '=') THEN nullif(regexp_extract(trim(string_split(t, '=')[1]), '^({_ID})', 1), '') END AS a FROM code)"))),
    "q_scan_typescript": (scan_typescript, _w(CODE_SQL, (
        f"SELECT o_orderkey, CASE WHEN starts_with(t, 'import ') OR contains(t, ' require(') THEN coalesce(CASE WHEN contains(t, ' from ') THEN {_QUOTED.format(x=chr(39).join(['string_split(t, ', ' from ', ')[2]']))} END, {_QUOTED.format(x='t')}) END AS import, "
        f"CASE WHEN starts_with(t, 'export ') THEN coalesce({after(*['export ' + k for k in ('default function ', 'default class ', 'function ', 'class ', 'interface ', 'type ', 'enum ', 'const ', 'let ', 'var ')])}, 'default') END AS export, {TS_NAME} AS name, {TS_KIND} AS kind, "
        f"array_to_string(CASE WHEN regexp_matches(t, '^(function |class |interface |export function |export class |export interface )') THEN [] ELSE list_filter({_CALLS.format(x='t')}, lambda c: c <> 'require') END, ',') AS calls FROM code"))),
    "q_enclosing_decl": (enclosing_decl, _w(CODE_SQL, f"SELECT o_orderkey, last_value(name IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS scope FROM (SELECT *, {TS_NAME} AS name FROM code)")),
    "q_json_deps": (json_deps, "SELECT event_id, unnest(json_keys(props)) AS key, props->>'$.k' AS value FROM events"),
}
