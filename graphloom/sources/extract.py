"""Facts from source text: Python by its syntax tree, brace languages by tokens, JSON by structure, lines as a fallback."""

from __future__ import annotations

import ast
import itertools
import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import expr as X
from ..operators.tables import GraphTables, cut, dedup_edges, dedup_external, numbered, resolve_local
from . import scan

FACTS = "file_id string, ord long, fact string, name string, qualified_name string, symbol_kind string, span " + schema.SPAN.simpleString() + ", owner long, provenance string, confidence string, message string"
_POINT = pa.struct([("line", pa.int64()), ("column", pa.int64())])
ARROW = pa.schema([
    ("file_id", pa.string()), ("ord", pa.int64()), ("fact", pa.string()), ("name", pa.string()), ("qualified_name", pa.string()), ("symbol_kind", pa.string()),
    ("span", pa.struct([("byte_start", pa.int64()), ("byte_end", pa.int64()), ("start", _POINT), ("end", _POINT)])), ("owner", pa.int64()), ("provenance", pa.string()), ("confidence", pa.string()), ("message", pa.string()),
])
#: Facts that a task holds before it hands them on, about.
ROWS = 50_000
#: Larger texts are scanned by line.
MOST_BYTES = 2 << 20
#: Diagnostics of a file at most, characters of a snippet in them at most, lines of a Python text that are put right at most.
MOST_DIAGNOSTICS, SNIPPET, REPAIRS = 4, 40, 32
#: How facts are found: by lines alone; by structure alone; by structure, and by lines where a text is too large for it.
MODES = ["scanner-only", "tree-only", "tree-with-fallback"]
TREE, SCAN = ("tree-sitter", "high"), ("structural-scanner", "medium")


@dataclass
class Builder:
    """Facts of one file in order; owner is the place of the fact that makes a call or reference, -1 for the file."""

    path: str
    text: str
    quality: tuple[str, str] = SCAN
    rows: list[dict] = field(default_factory=list)

    def __post_init__(self):
        self.raw = self.text.encode("utf-8")
        self.starts = [0] + [m.end() for m in re.finditer(b"\n", self.raw)]

    @property
    def stem(self) -> str:
        return re.sub(r"(?<=.)\.[^.]*$", "", self.path.rsplit("/", 1)[-1])

    def span(self, start: int, end: int) -> dict:
        import bisect

        def point(at: int) -> dict:
            line = bisect.bisect_right(self.starts, at) - 1
            return {"line": line + 1, "column": at - self.starts[line] + 1}

        return {"byte_start": start, "byte_end": end, "start": point(start), "end": point(end)}

    def add(self, fact: str, name: str | None, qualified: str | None = None, kind: str | None = None, span: dict | None = None, owner: int = -1, message: str | None = None) -> int:
        self.rows.append({"ord": len(self.rows), "fact": fact, "name": name, "qualified_name": qualified, "symbol_kind": kind, "span": span, "owner": owner, "provenance": self.quality[0], "confidence": self.quality[1], "message": message})
        return len(self.rows) - 1


# Python


class _Python(ast.NodeVisitor):
    def __init__(self, b: Builder):
        self.b = b
        self.scopes = [(b.add("symbol", b.stem, b.stem, "module", b.span(0, len(b.raw))), b.stem, "module")]

    def at(self, node: ast.AST) -> dict:
        s = self.b.starts
        return self.b.span(s[node.lineno - 1] + node.col_offset, s[node.end_lineno - 1] + node.end_col_offset)

    def scope(self, node, kind: str) -> None:
        owner, parent, parent_kind = self.scopes[-1]
        for d in node.decorator_list:
            target = d.func if isinstance(d, ast.Call) else d
            self.b.add("reference", ast.unparse(target).rsplit(".", 1)[-1], span=self.at(d), owner=owner)
            if isinstance(d, ast.Call):
                self.visit(d)
        kind = "method" if kind == "function" and parent_kind == "class" else kind
        name = f"{parent}.{node.name}"
        self.scopes.append((self.b.add("symbol", node.name, name, kind, self.at(node)), name, kind))
        for child in ast.iter_child_nodes(node):
            if child not in node.decorator_list:
                self.visit(child)
        self.scopes.pop()

    def visit_ClassDef(self, node):
        self.scope(node, "class")

    def visit_FunctionDef(self, node):
        self.scope(node, "function")

    visit_AsyncFunctionDef = visit_FunctionDef

    def assigned(self, targets: list[ast.AST]) -> None:
        _, parent, kind = self.scopes[-1]
        for t in targets:
            for n in ast.walk(t):
                if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store):
                    self.b.add("symbol", n.id, f"{parent}.{n.id}", "field" if kind == "class" else "variable", self.at(n))

    def visit_Assign(self, node):
        self.assigned(node.targets)
        self.generic_visit(node)

    def visit_AnnAssign(self, node):
        self.assigned([node.target])
        self.generic_visit(node)

    def visit_Import(self, node):
        for a in node.names:
            self.b.add("import", a.asname or a.name.rsplit(".", 1)[-1], a.name, span=self.at(node))

    def visit_ImportFrom(self, node):
        module = "." * node.level + (node.module or "")
        for a in node.names:
            self.b.add("import", a.asname or a.name, f"{module}.{a.name}" if module else a.name, span=self.at(node))

    def visit_Call(self, node):
        f = node.func
        name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
        if name:
            self.b.add("call", name, span=self.at(node), owner=self.scopes[-1][0])
        self.generic_visit(node)


def _tolerant(text: str) -> tuple[ast.Module | None, list[int]]:
    """A tree of what parses, and the numbers of lines with errors, each put right by a statement that leaves what is inside in place."""
    lines, wrong = text.split("\n"), []
    indent = lambda line: len(line) - len(line.lstrip())
    for _ in range(REPAIRS):
        try:
            return ast.parse("\n".join(lines)), wrong
        except (ValueError, RecursionError, MemoryError):
            return None, wrong
        except SyntaxError as e:
            at = min(max(1, e.lineno or 1), len(lines)) - 1
            while at > 0 and not lines[at].strip():
                at -= 1
            if at + 1 not in wrong:
                wrong.append(at + 1)
            after = next((x for x in lines[at + 1 :] if x.strip()), "")
            pad = " " * indent(lines[at])
            better = pad + ("if 1:" if indent(after) > len(pad) else "pass")
            lines[at] = better if lines[at] != better else ""
    return None, wrong


def python_facts(path: str, text: str) -> list[dict]:
    """Facts of a syntax tree; lines that don't parse are left out of it, each with a diagnostic."""
    tree, wrong = _tolerant(text)
    b = Builder(path, text, TREE) if tree else Builder(path, text)
    if tree:
        _Python(b).visit(tree)
    else:
        python_lines(b)
    lines = text.split("\n")
    for n in sorted(wrong)[:MOST_DIAGNOSTICS]:
        line = lines[n - 1].strip()[:SNIPPET]
        start = b.starts[n - 1]
        b.add("diagnostic", None, span=b.span(start, start + len(lines[n - 1].encode())), message=f"syntax error near {line}" if line else "syntax error")
    if not tree and not wrong:
        b.add("diagnostic", None, message="syntax error")
    return b.rows


def _line_spans(b: Builder) -> Iterator[tuple[str, dict]]:
    at = 0
    for i, line in enumerate(b.text.removesuffix("\n").split("\n") if b.text else []):
        line = line.removesuffix("\r")
        size = len(line.encode())
        yield line, {"byte_start": at, "byte_end": at + size, "start": {"line": i + 1, "column": 1}, "end": {"line": i + 1, "column": len(line) + 1}}
        at += size + 1


IDENTIFIER = re.compile(r"[A-Za-z0-9_$]+")


def _after(line: str, *prefixes: str) -> str | None:
    for p in prefixes:
        if line.startswith(p) and (m := IDENTIFIER.match(line[len(p) :].lstrip())):
            return m[0]
    return None


def _calls(line: str) -> list[str]:
    found = [re.search(r"([A-Za-z0-9_$]*)$", part.rstrip())[1] for part in line.split("(")]
    return [x for x in found if x and x not in X.NO_CALLS]


def python_lines(b: Builder) -> None:
    """The scanner for text that doesn't parse: scopes by indentation."""
    scopes: list[tuple[int, str, int]] = [(0, "", -1)]
    for line, span in _line_spans(b):
        t = line.strip()
        if not t or t.startswith("#"):
            continue
        indent = len(line) - len(line.lstrip())
        while len(scopes) > 1 and indent <= scopes[-1][0]:
            scopes.pop()
        parent, owner = scopes[-1][1], scopes[-1][2]
        if module := _after(t, "import ", "from "):
            place = b.add("import", module, module, span=span)
            b.add("reference", module, span=span, owner=owner)
            scopes.append((indent + 1, module, place))
            continue
        declared = [(_after(t, "async def ", "def "), "function"), (_after(t, "class "), "class"), ((m[0] if (m := IDENTIFIER.match(t.split("=", 1)[0].strip())) else None) if "=" in t else None, "variable")]
        name, kind = next(((n, k) for n, k in declared if n), (None, None))
        if name:
            q = f"{parent}.{name}" if parent else name
            scopes.append((indent, q, b.add("symbol", name, q, kind, span)))
            continue
        for c in _calls(t):
            b.add("call", c, span=span, owner=owner)


# Languages of braces and tokens

TOKEN = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|[A-Za-z_$@#~][A-Za-z0-9_$]*|::|=>|[0-9][A-Za-z0-9_.]*|\S", re.S)


@dataclass(frozen=True)
class BraceLanguage:
    """What a token scanner needs to know of a language: scope words with the kind they declare, and where imports stand."""

    separator: str
    scopes: dict[str, str]
    imports: Callable[[str], list[tuple[str, int, int]]]
    functions: frozenset[str] = frozenset()
    module: bool = False
    variables: frozenset[str] = frozenset()
    exports: bool = False


def _matches(pattern: str, *groups: int) -> Callable[[str], list[tuple[str, int, int]]]:
    p = re.compile(pattern, re.M)
    return lambda text: [(next(g for g in m.groups() if g is not None).strip(), m.start(), m.end()) for m in p.finditer(text)]


def _go_imports(text: str) -> list[tuple[str, int, int]]:
    out = [(m[1], m.start(), m.end()) for m in re.finditer(r'^import\s+(?:[\w.]+\s+)?"([^"]+)"', text, re.M)]
    for block in re.finditer(r"^import\s*\((.*?)\)", text, re.M | re.S):
        out += [(m[1], block.start(1) + m.start(), block.start(1) + m.end()) for m in re.finditer(r'"([^"]+)"', block[1])]
    return out


LANGUAGES = {
    "c": BraceLanguage("::", {"struct": "class", "enum": "enum", "union": "class"}, _matches(r'^\s*#\s*include\s*([<"][^>"\n]+[>"])')),
    "cpp": BraceLanguage("::", {"class": "class", "struct": "class", "enum": "enum", "namespace": "module", "union": "class"}, _matches(r'^\s*#\s*include\s*([<"][^>"\n]+[>"])')),
    "go": BraceLanguage(".", {"type": "type-alias", "package": "module"}, _go_imports, frozenset({"func"}), False, frozenset({"var", "const"})),
    "java": BraceLanguage(".", {"class": "class", "interface": "interface", "enum": "enum", "record": "class", "@interface": "interface", "package": "module"}, _matches(r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;")),
    "objective-c": BraceLanguage(".", {"@interface": "class", "@implementation": "class", "@protocol": "interface", "struct": "class", "enum": "enum"}, _matches(r'^\s*#\s*(?:import|include)\s*([<"][^>"\n]+[>"])|^\s*@import\s+([\w.]+)\s*;')),
    "rust": BraceLanguage("::", {"struct": "class", "enum": "enum", "trait": "interface", "impl": "class", "mod": "module", "type": "type-alias"}, _matches(r"^\s*(?:pub\s+)?use\s+([^;]+);"), frozenset({"fn"}), True, frozenset({"let", "const", "static"})),
    "typescript": BraceLanguage(".", {"class": "class", "interface": "interface", "enum": "enum", "type": "type-alias", "namespace": "module"}, _matches(r"""^\s*import\b[^;'"]*?['"]([^'"]+)['"]|\b(?:require|import)\(\s*['"]([^'"]+)['"]|^\s*export\b[^;'"=({]*\{[^}]*\}\s*from\s*['"]([^'"]+)['"]"""), frozenset({"function"}), True, frozenset({"const", "let", "var"}), True),
}
LANGUAGES["javascript"] = LANGUAGES["typescript"]
#: Words before a parenthesis that are neither functions nor calls.
KEYWORDS = {"if", "for", "while", "switch", "return", "class", "struct", "enum", "interface", "public", "private", "protected", "static", "const", "var", "let", "type", "catch", "function", "fn", "func", "match", "else", "new", "sizeof", "super", "constructor", "throw", "typeof", "in", "of", "await", "import", "impl", "where", "do"}


#: What may stand before a field of a class.
FIELD_STARTS = {"{", ";", "}", "public", "private", "protected", "readonly", "static", "declare", "abstract", "override", ")"}


def brace_facts(path: str, text: str, language: str) -> list[dict]:
    """Scopes by braces: types, functions (methods in a type), fields, variables outside functions, calls, references, imports, exports."""
    lang, b = LANGUAGES[language], Builder(path, text)
    offset = _byte_offsets(text)
    at = lambda a, z: b.span(offset(a), offset(z))
    sep, script = lang.separator, language in ("typescript", "javascript")
    jsx = script and path.endswith("x")
    root = b.add("symbol", b.stem, b.stem, "module", b.span(0, len(b.raw))) if lang.module else -1
    stack: list[tuple[str, str, int]] = [(b.stem if lang.module else "", "module", root)]
    imports = lang.imports(text)
    for spec, a, z in imports:
        for alias in _aliases(text[a:z], spec, language):
            b.add("import", alias, spec.strip('<>"'), span=at(a, z))
    skip = [(a, z) for _, a, z in imports]
    tokens = [m for m in TOKEN.finditer(text) if not m[0].startswith(("//", "/*"))]
    words = [m[0] for m in tokens]
    depth, opened, pending = 0, [], None
    qualify = lambda name: f"{stack[-1][0]}{sep}{name}" if stack[-1][0] else name
    name_like = re.compile(r"[A-Za-z_$~][A-Za-z0-9_$]*$")

    def close(place: int, end: int) -> None:
        """A scope's span ends with its body."""
        if place >= 0 and (span := b.rows[place]["span"]):
            b.rows[place]["span"] = b.span(span["byte_start"], offset(end))

    def close_paren(i: int) -> int:
        level = 0
        for j in range(i, len(words)):
            level += (words[j] == "(") - (words[j] == ")")
            if level == 0:
                return j
        return len(words) - 1

    def statement_end(i: int) -> int:
        """The end of a statement outside of all brackets that open in it."""
        level = 0
        for j in range(i, len(words)):
            level += (words[j] in "([{") - (words[j] in ")]}")
            if level < 0 or (level == 0 and words[j] == ";"):
                return j
            if level == 0 and words[j] == "}" and "\n" in text[tokens[j].end() : tokens[j + 1].start() if j + 1 < len(words) else len(text)]:
                return j + 1
        return len(words)

    def body_after(j: int) -> bool:
        throws = False
        for w in itertools.islice(words, j + 1, None):
            throws |= w == "throws"
            if w == "{":
                return True
            if w in (";", "}", ")", "=") or w == "," and not throws or w == "=>" and not script:
                return False
        return False

    i, paren_until = 0, -1
    while i < len(words):
        w, m = words[i], tokens[i]
        if any(a <= m.start() < z for a, z in skip):
            i += 1
            continue
        inside = any(k in ("function", "method") for _, k, _ in stack)
        if lang.exports and w == "export":
            rest = words[i + 1 : i + 4]
            names = re.match(r"export\s*\{([^}]*)\}", text[m.start() :])
            if names:
                for part in names[1].split(","):
                    if part.strip():
                        b.add("export", part.split(" as ")[-1].strip(), span=at(m.start(), m.start() + names.end()))
            else:
                found = [x for x in rest if name_like.match(x) and x not in KEYWORDS | {"default", "async", "abstract", "declare", "namespace"}]
                b.add("export", found[0] if found else "default", span=at(m.start(), m.end()))
        if w in lang.scopes and i + 1 < len(words):
            j = i + 1
            if w == "impl":
                end = next((k for k in range(j, len(words)) if words[k] == "{"), len(words))
                body = words[j:end]
                body = body[body.index("for") + 1 :] if "for" in body else body
                name = next((x for x in body if name_like.match(x)), None)
            else:
                name = words[j] if name_like.match(words[j]) else None
            if name and not (w in ("struct", "enum", "union") and language in ("c", "cpp", "objective-c") and not body_after(j)) and not (w == "type" and language in ("typescript", "javascript") and words[j + 1 : j + 2] not in (["="], ["<"])):
                kind = lang.scopes[w]
                q = qualify(name)
                place = b.add("symbol", name, q, kind, at(m.start(), tokens[j].end()))
                if w == "package":
                    dotted = re.match(r"package\s+([\w.]+)", text[m.start() :])
                    stack[0] = (dotted[1] if dotted else name, "module", place)
                elif language == "objective-c" and w in ("@interface", "@implementation", "@protocol"):
                    stack.append((q, kind, place))
                    opened.append(-1)
                elif (body_after(j) or w in ("impl",)) and not (language == "go" and w == "type"):
                    pending = (q, kind, place)
            i = j + 1 if name else i + 1
            continue
        direct = bool(opened) and opened[-1] in (depth, -1) and not inside and pending is None
        before = words[i - 1] if i else ""
        named = bool(name_like.match(before)) and before not in KEYWORDS
        if script and w.startswith("@") and len(w) > 1:
            j = i
            while words[j + 1 : j + 2] == ["."] and j + 2 < len(words):
                j += 2
            b.add("reference", words[j].lstrip("@"), span=at(m.start(), tokens[j].end()), owner=stack[-1][2])
            i = j + 1
            continue
        if jsx and w == "<" and not named and i + 1 < len(words) and words[i + 1][0].isupper():
            b.add("reference", words[i + 1], span=at(m.start(), tokens[i + 1].end()), owner=stack[-1][2])
        if script and direct and stack[-1][1] == "class" and w in (":", "=", ";", "?", "!") and named and (i < 2 or words[i - 2] in FIELD_STARTS):
            b.add("symbol", before, qualify(before), "field", at(tokens[i - 1].start(), tokens[i - 1].end()))
            if w in ("=", ":"):
                i = statement_end(i)
                continue
        if language == "java" and direct and stack[-1][1] in ("class", "interface", "enum") and w in (";", "=", ",") and named and i > 1 and (name_like.match(words[i - 2]) or words[i - 2] in (">", "]", ",")) and words[i - 2] not in ("return", "package"):
            b.add("symbol", before, qualify(before), "field", at(tokens[i - 1].start(), tokens[i - 1].end()))
            if w == "=":
                i = statement_end(i)
                continue
        if language in ("c", "cpp", "objective-c") and w == "=" and not inside and named and i > 1 and (name_like.match(words[i - 2]) or words[i - 2] in ("*", "&", ">")) and words[i + 1 : i + 2] != ["="]:
            b.add("symbol", before, qualify(before), "variable", at(tokens[i - 1].start(), tokens[i - 1].end()))
            i = statement_end(i)
            continue
        if language in ("c", "cpp", "objective-c") and w == "typedef":
            level, j = 0, i
            while j < len(words) and not (words[j] == ";" and level == 0):
                level += (words[j] in "{(") - (words[j] in "})")
                j += 1
            pointer = next((k + 2 for k in range(i, j - 2) if words[k] == "(" and words[k + 1] == "*" and name_like.match(words[k + 2])), None)
            place = pointer or (j - 1 if j > i and name_like.match(words[j - 1]) else None)
            if place:
                b.add("symbol", words[place], qualify(words[place]), "type-alias", at(m.start(), tokens[min(j, len(words) - 1)].end()))
        if language == "objective-c" and inside and w == "[":
            j, level = i + 1, 0
            while j < len(words) and (level or words[j] == "["):
                level += (words[j] == "[") - (words[j] == "]")
                j += 1
            j = j if j > i + 1 else j + 1
            if j < len(words) and name_like.match(words[j]):
                b.add("call", words[j], span=at(m.start(), tokens[j].end()), owner=stack[-1][2])
        if w == "@end" and len(stack) > 1:
            close(stack.pop()[2], m.end())
            opened.pop()
        elif language == "objective-c" and w in ("-", "+") and not inside and words[i + 1 : i + 2] == ["("]:
            j = close_paren(i + 1) + 1
            if j < len(words) and name_like.match(words[j]):
                q = qualify(words[j])
                place = b.add("symbol", words[j], q, "method", at(m.start(), tokens[j].end()))
                if body_after(j):
                    pending = (q, "method", place)
                i = j + 1
                continue
        elif w in lang.variables and i + 1 < len(words) and not (inside and language != "rust"):
            j = i + 1 + (words[i + 1] == "mut")
            if j < len(words) and name_like.match(words[j]):
                statement = re.compile(r"[^;\n]*").match(text, tokens[j].end())[0]
                is_function = language in ("typescript", "javascript") and ("=>" in statement or re.match(r"\s*(:[^=]*)?=\s*(async\s+)?function\b", statement))
                kind = "function" if is_function else "variable"
                place = b.add("symbol", words[j], qualify(words[j]), kind, at(m.start(), tokens[j].end()))
                if is_function and "{" in statement:
                    pending = (qualify(words[j]), "function", place)
                i = j + 1
                continue
        elif w == "new" and language in ("typescript", "javascript") and i + 1 < len(words) and name_like.match(words[i + 1]):
            b.add("call", words[i + 1], span=at(m.start(), tokens[i + 1].end()), owner=stack[-1][2])
            i += 2
            continue
        elif name_like.match(w) and words[i + 1 : i + 2] in (["("], ["!"]) or w in lang.functions:
            j = i
            if w in lang.functions:
                j = i + 1
                if words[j : j + 1] == ["("]:
                    j = close_paren(j) + 1
                while j < len(words) and not name_like.match(words[j]):
                    j += 1
            if j >= len(words):
                break
            name = words[j]
            paren = next((k for k in range(j + 1, len(words)) if words[k] in ("(", "{", ";", "}")), None)
            paren = paren if paren is not None and words[paren] == "(" else None
            macro = words[j + 1 : j + 2] == ["!"]
            declared = w in lang.functions or (not macro and not inside and name not in KEYWORDS and paren is not None and body_after(close_paren(paren)) and (stack[-1][1] in ("class", "interface") or language in ("c", "cpp", "java", "objective-c")))
            if declared and paren is not None:
                in_type = stack[-1][1] in ("class", "interface")
                kind = "method" if in_type or language == "go" and words[i + 1 : i + 2] == ["("] else "function"
                q = qualify(name)
                end = close_paren(paren)
                place = b.add("symbol", name, q, kind, at(m.start(), tokens[end].end()))
                if body_after(end):
                    pending = (q, kind, place)
                i = end + 1
                continue
            if name not in KEYWORDS and w not in lang.functions:
                b.add("call", name, span=at(m.start(), m.end()), owner=stack[-1][2])
        if w == "{":
            depth += 1
            if pending:
                stack.append(pending)
                opened.append(depth)
                pending = None
        elif w == "}":
            if opened and opened[-1] == depth and len(stack) > 1:
                close(stack.pop()[2], m.end())
                opened.pop()
            depth = max(0, depth - 1)
        elif w == ";" and paren_until < i:
            pending = None
        i += 1
    if depth:
        b.add("diagnostic", None, message=f"unbalanced braces in {language} file")
    return b.rows


def _aliases(statement: str, spec: str, language: str) -> list[str]:
    if language in ("typescript", "javascript"):
        names = re.search(r"\{([^}]*)\}", statement)
        out = [p.split(" as ")[-1].strip() for p in names[1].split(",") if p.strip()] if names else []
        if star := re.search(r"\*\s*as\s+(\w+)", statement):
            out.append(star[1])
        if default := re.match(r"\s*import\s+(?:type\s+)?(\w+)\s*(?:,|from)", statement):
            out.insert(0, default[1])
        return out or [spec]
    return [re.split(r"::|[./]", spec.strip('<>"'))[-1] or spec]


def _byte_offsets(text: str) -> Callable[[int], int]:
    if text.isascii():
        return lambda i: i
    sizes = [0]
    for c in text:
        sizes.append(sizes[-1] + len(c.encode()))
    return lambda i: sizes[i]


# JSON


#: Keys of a package manifest that list dependencies.
DEPENDENCY_KEYS = ["dependencies", "devDependencies", "peerDependencies", "optionalDependencies", "bundledDependencies", "bundleDependencies"]


def json_facts(path: str, text: str) -> list[dict]:
    b = Builder(path, text, ("structural-scanner", "high"))
    name = path.rsplit("/", 1)[-1]
    whole = b.span(0, len(b.raw))
    document = b.add("symbol", name, name, "module", whole)
    try:
        value = json.loads(text)
    except (ValueError, RecursionError) as e:
        b.add("diagnostic", None, message=f"invalid JSON: {e}")
        return b.rows
    if not isinstance(value, dict):
        return b.rows
    if isinstance(value.get("name"), str):
        b.add("symbol", value["name"], value["name"], "module", whole)
    for key in DEPENDENCY_KEYS:
        listed = value.get(key)
        for dep in listed if isinstance(listed, dict) else [x for x in listed if isinstance(x, str)] if isinstance(listed, list) else []:
            b.add("import", dep, dep, span=whole)
            b.add("dependency", dep, span=whole, owner=document)

    def targets(v) -> Iterator[str]:
        if isinstance(v, str):
            if v.startswith((".", "/")):
                yield v
        elif isinstance(v, dict | list):
            for x in v.values() if isinstance(v, dict) else v:
                yield from targets(x)

    for key in ("imports", "exports"):
        for t in targets(value.get(key)):
            b.add("reference", t, span=whole, owner=document)
    return b.rows


# Registry

Extractor = Callable[[str, str], list[dict]]


class Registry:
    """Extractors by language; register adds one or takes the place of one."""

    def __init__(self):
        self.extractors: dict[str, Extractor] = {"python": python_facts, "json": json_facts}
        for lang in LANGUAGES:
            self.extractors[lang] = lambda path, text, lang=lang: brace_facts(path, text, lang)

    def register(self, language: str, extractor: Extractor) -> None:
        self.extractors[language] = extractor

    def facts(self, path: str, text: str, language: str, most: int = MOST_BYTES, mode: str = MODES[2]) -> list[dict]:
        """Facts of a text; of one to be scanned by line, those that the line scanners of scan.py don't give."""
        extractor = self.extractors.get(language)
        if extractor is None:
            return []
        large = language != "json" and len(text.encode()) > most
        if not large and (mode != "scanner-only" or language not in (*scan.LANGUAGES, "python")):
            return extractor(path, text)
        b = Builder(path, text)
        if language == "python" and mode != "tree-only":
            python_lines(b)
        if large and mode != "scanner-only":
            # after all facts of lines
            b.add("diagnostic", None, message=f"tree parse skipped large {language} file: {len(b.raw)} bytes > {most}")
            b.rows[-1]["ord"] = len(b.starts) * scan.ROOM
        return b.rows


def extract_facts(sources: DataFrame, registry: Registry | None = None, most: int = MOST_BYTES, mode: str = MODES[2]) -> DataFrame:
    """Facts of (file_id, path, language, text); an extractor that fails leaves a diagnostic.

    Texts over `most` bytes, or all with mode 'scanner-only', are scanned by line, as their language asks.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}; one of {', '.join(MODES)}")
    registry = registry or Registry()
    by_line = F.lit(mode == "scanner-only") | (F.octet_length("text") > most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file_id, path, language, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                began = time.perf_counter()
                try:
                    found = registry.facts(path, text or "", language, most, mode)
                except Exception as e:  # noqa: BLE001  a file must not fail the index
                    b = Builder(path, "")
                    b.add("diagnostic", None, message=f"extraction failed: {type(e).__name__}")
                    found = b.rows
                for r in found:
                    r["file_id"] = file_id
                rows += found
                # how long it took, in microseconds
                rows.append({"file_id": file_id, "ord": -1, "fact": "time", "owner": int(1e6 * (time.perf_counter() - began))})
                if len(rows) >= ROWS:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, ARROW)

    found = sources.select("file_id", "path", "language", "text").mapInArrow(run, FACTS)
    return found if mode == "tree-only" else found.unionByName(scan.scan_facts(sources.where(by_line)))


def build_graph(sources: DataFrame, facts: DataFrame, resolve: bool = True) -> GraphTables:
    """Nodes and edges of facts: all ids are expressions, all links are joins within a file.

    Facts are written once to the shared folder, so that no text is parsed again for the tables made of them.
    """
    files = sources.select("repo_id", "file_id", "path", "language")
    rows = cut(facts).join(files, "file_id")
    none, null, long = F.lit(None).cast(schema.SPAN), F.lit(None).cast("string"), lambda c: c.cast("long")
    quality = ["provenance", "confidence"]
    file_node = X.node_id("repo_id", "file_id", F.lit("file"), "language", "path", X.file_name("path"), none)
    own_kind = F.when(F.col("fact") == "symbol", "symbol").when(F.col("fact") == "import", "import").when(F.col("fact") == "export", "export")
    own_id = X.node_id("repo_id", "file_id", own_kind, "language", "qualified_name", "name", "span")
    rows = rows.withColumn("own_kind", own_kind).withColumn("own_id", F.when(F.col("own_kind").isNotNull(), own_id)).withColumn("file_node", file_node)
    node = lambda df, ord_, id_, kind, language, name, qualified, symbol_kind, file_id, span: df.select(F.col("file_id").alias("file_part"), long(ord_).alias("ord"), id_.alias("id"), kind.alias("kind"), language.alias("language"), name.alias("name"), qualified.alias("qualified_name"), symbol_kind.alias("symbol_kind"), file_id.alias("file_id"), span.alias("span"), *quality)
    base = files.withColumn("provenance", F.lit("structural-scanner")).withColumn("confidence", F.lit("high"))
    nodes = node(base, F.lit(-1), file_node, F.lit("file"), F.col("language"), X.file_name("path"), F.replace("path", F.lit("\\"), F.lit("/")), null, F.col("file_id"), none)
    nodes = nodes.unionByName(node(rows.where("own_kind is not null"), F.col("ord") * 2, F.col("own_id"), F.col("own_kind"), F.col("language"), F.col("name"), F.col("qualified_name"), F.col("symbol_kind"), F.col("file_id"), F.col("span")))
    outside = F.when(F.col("fact").isin("import", "dependency"), "package").when(F.col("fact").isin("call", "reference"), "external-symbol")
    target = F.when(F.col("fact") == "import", F.col("qualified_name")).otherwise(F.col("name"))
    empty = F.lit("")
    ext = rows.withColumn("ext_kind", outside).where("ext_kind is not null").withColumn("ext_name", target)
    ext = ext.withColumn("ext_id", X.node_id("repo_id", empty, "ext_kind", F.lit("unknown"), "ext_name", "ext_name", none))
    nodes = nodes.unionByName(node(ext, F.col("ord") * 2 + 1, F.col("ext_id"), F.col("ext_kind"), F.lit("unknown"), F.col("ext_name"), null, F.when(F.col("ext_kind") == "external-symbol", "unknown"), null, none))

    owners = rows.where("own_id is not null").select("file_id", F.col("ord").alias("owner"), F.col("own_id").alias("owner_id"))

    def edge(df: DataFrame, ord_, kind, source, to) -> DataFrame:
        df = df.withColumn("_kind", kind).withColumn("_from", source).withColumn("_to", to)
        return df.select(F.col("file_id").alias("file_part"), long(ord_).alias("ord"), X.edge_id("_kind", "_from", "_to", "span").alias("id"), F.col("_kind").alias("kind"), F.col("_from").alias("from"), F.col("_to").alias("to"), "span", *quality)

    of = lambda fact: F.col("fact") == fact
    verb = F.when(of("symbol"), "defines").when(of("import"), "contains").otherwise("exports")
    edges = edge(rows.where("own_kind is not null"), F.col("ord") * 2, verb, F.col("file_node"), F.col("own_id"))
    edges = edges.unionByName(edge(ext.where(of("import")), F.col("ord") * 2 + 1, F.lit("imports"), F.col("own_id"), F.col("ext_id")))
    linked = ext.where(~of("import")).join(owners, ["file_id", "owner"], "left")
    verb = F.when(of("call"), "calls").when(of("reference"), "references").otherwise("depends-on")
    edges = edges.unionByName(edge(linked, F.col("ord") * 2, verb, F.coalesce("owner_id", "file_node"), F.col("ext_id")))
    nodes, edges = dedup_external(nodes), dedup_edges(edges)
    if resolve:
        local = sources.where("language <> 'json'").select(F.col("file_id").alias("file_part"))
        edges = resolve_local(nodes.join(local, "file_part", "left_semi"), edges)
    diagnostics = rows.where(of("diagnostic")).select(F.col("file_id").alias("file_part"), "ord", F.lit("warning").alias("severity"), "message", "file_id", "span")
    # structures are parsed and walked in one pass, which is all extraction
    times = rows.where(of("time")).groupBy("file_id").agg(F.sum("owner").alias("extraction_time_micros"))
    table = sources.select("file_id", "path", "language", "fingerprint", F.lit(0).cast("long").alias("parse_time_micros")).join(times, "file_id", "left").fillna(0, "extraction_time_micros")
    return GraphTables(numbered(table, "partition_pos", "path", "file_id"), nodes, edges, diagnostics)


def index(sources: DataFrame, registry: Registry | None = None, most: int = MOST_BYTES, mode: str = MODES[2]) -> GraphTables:
    """The graph of sources (repo_id, file_id, path, language, fingerprint, text)."""
    return build_graph(sources, extract_facts(sources, registry, most, mode))
