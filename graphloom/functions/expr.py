"""Identity, path, span, text and scoring expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema

Name = Column | str


def col(x: Name) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ordinal(x: Name, values: list[str]) -> Column:
    """Position of a value in a list, from 0; null for any other."""
    return F.nullif(F.array_position(F.array(*[F.lit(v) for v in values]), col(x)), F.lit(0)) - 1


# Identity


def det_id(prefix: str, *parts: Name) -> Column:
    """prefix, ':' and 24 hex digits of a digest over the parts, each ended by a NUL; a null part is empty."""
    ended = F.concat(*[F.concat(F.coalesce(col(p).cast("string"), F.lit("")), F.lit("\0")) for p in parts])
    return F.concat(F.lit(f"{prefix}:"), F.substring(F.sha2(ended, 256), 1, 24))


def fingerprint(text: Name) -> Column:
    return F.sha2(col(text).cast("binary"), 256)


def span_key(span: Name) -> Column:
    s = col(span)
    return F.when(s.isNull(), "").otherwise(F.concat_ws(":", s["byte_start"].cast("string"), s["byte_end"].cast("string")))


def node_id(repo: Name, file_id: Name, kind: Name, language: Name, qualified: Name, name: Name, span: Name) -> Column:
    return det_id("node", repo, file_id, kind, language, F.coalesce(col(qualified), col(name)), span_key(span))


def edge_id(kind: Name, source: Name, target: Name, span: Name) -> Column:
    return det_id("edge", kind, source, target, span_key(span))


def shard(x: Name) -> Column:
    """One of 256 shards, the first byte of a digest."""
    return F.conv(F.substring(F.sha2(col(x).cast("binary"), 256), 1, 2), 16, 10).cast("int")


# Paths


def normalize_path(path: Name) -> Column:
    """Without empty and '.' components, joined by '/'."""
    parts = F.filter(F.split(F.replace(col(path), F.lit("\\"), F.lit("/")), "/"), lambda x: ~x.isin("", "."))
    return F.array_join(parts, "/")


def relative_path(root: Name, path: Name) -> Column:
    """Normalised, without the root it starts with; another path is normalised as it is."""
    r = F.concat(F.regexp_replace(col(root), "/+$", ""), F.lit("/"))
    return normalize_path(F.when(F.startswith(col(path), r), F.substr(col(path), F.length(r) + 1)).otherwise(col(path)))


def file_name(path: Name) -> Column:
    return F.substring_index(col(path), "/", -1)


def file_stem(path: Name) -> Column:
    """File name without its last extension; a name that only starts with a dot is kept."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Name) -> Column:
    """After the last dot of the file name that isn't its first character; empty for none."""
    return F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1)


def module_stem(specifier: Name) -> Column:
    """Last path part without one .js, then one .ts, then one .py at its end; null if nothing is left."""
    out = F.substring_index(col(specifier), "/", -1)
    for suffix in (".js", ".ts", ".py"):
        out = F.regexp_replace(out, suffix.replace(".", r"\.") + "$", "")
    return F.nullif(out, F.lit(""))


def is_vendor_or_generated(path: Name) -> Column:
    # Folders and endings that are never indexed.
    folders = ["node_modules", ".git", "target", "dist", "build", "third_party", "vendor", ".venv", "__pycache__"]
    endings = [".min.js", ".generated.ts", ".generated.py", ".pb.go"]
    hit = F.arrays_overlap(F.split(col(path), "/"), F.array(*[F.lit(x) for x in folders]))
    for e in endings:
        hit = hit | F.endswith(col(path), F.lit(e))
    return hit


def is_test_path(path: Name) -> Column:
    hit = F.contains(col(path), F.lit("/tests/"))
    for e in ("_test.rs", "_test.ts", "_test.py", ".test.ts", ".spec.ts"):
        hit = hit | F.endswith(col(path), F.lit(e))
    return hit


def is_binary(content: Name) -> Column:
    """A NUL in the first 8192 bytes, or not UTF-8."""
    nul = F.instr(F.substring(col(content), 1, 8192).cast("string"), "\0") > 0
    return nul | ~F.coalesce(F.is_valid_utf8(col(content).cast("string")), F.lit(False))


# Language detection. Endings and names by language, in the order they are tried.
ENDINGS = {
    "objective-c": ["m", "mm"],
    "cpp": ["cc", "cpp", "cxx", "c++", "hh", "hpp", "hxx", "h++", "ipp"],
    "c": ["c"],
    "go": ["go"],
    "java": ["java"],
    "json": ["json", "webmanifest"],
    "rust": ["rs"],
    "javascript": ["js", "jsx", "mjs", "cjs"],
    "typescript": ["ts", "tsx", "mts", "cts"],
    "python": ["py", "pyw"],
}


def path_candidate(path: Name) -> Column:
    """A known ending, a header, a special name, or no extension at all."""
    ext, name = extension(path), file_name(path)
    return ext.isin(*[e for es in ENDINGS.values() for e in es], "h", "") | name.isin("SConstruct", "SConscript", "package-lock.json") | F.startswith(name, F.lit("tsconfig"))


def detect_language(path: Name, text: Name) -> Column:
    """The first language in order whose rule holds for path and text; else unknown."""
    ext, name, t = extension(path), file_name(path), F.coalesce(col(text), F.lit(""))
    has = lambda *words: F.lit(False) if not words else _any([F.contains(t, F.lit(w)) for w in words])
    header = ext == "h"
    objc, cpp = has("@interface", "@implementation", "@protocol"), has("namespace ", "template <", "class ")
    first = F.regexp_extract(t, r"^([^\r\n]*)", 1)
    script = F.startswith(first, F.lit("#!"))
    run_by = lambda word: script & F.contains(first, F.lit(word))
    is_ = lambda lang: ext.isin(*ENDINGS[lang])
    rules = [
        ("objective-c", is_("objective-c") | (header & objc)),
        ("cpp", is_("cpp") | (header & cpp)),
        ("c", is_("c") | (header & ~has("@interface", "@protocol", "namespace ", "template <", "class "))),
        ("go", is_("go")),
        ("java", is_("java")),
        ("json", is_("json") | (((name == "package-lock.json") | F.startswith(name, F.lit("tsconfig"))) & F.startswith(F.ltrim(t), F.lit("{")))),
        ("rust", is_("rust") | run_by("rust-script")),
        ("javascript", is_("javascript") | (name == "vite.config.js") | run_by("node")),
        ("typescript", is_("typescript") | run_by("node")),
        ("python", is_("python") | name.isin("SConstruct", "SConscript") | run_by("python")),
    ]
    out = F
    for lang, rule in rules:
        out = out.when(rule, F.lit(lang))
    return out.otherwise(F.lit("unknown"))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


# Lines and text


def lines(text: Name) -> Column:
    """Lines without their ends; no empty line after a last end."""
    t = col(text)
    cut = F.split(F.regexp_replace(t, r"\n$", ""), "\n")
    return F.when(F.coalesce(t, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.transform(cut, lambda x: F.regexp_replace(x, r"\r$", "")))


def line_span(index: Name, before: Name, line: Name) -> Column:
    """Span of the line of index (from 0) with `before` bytes ahead, each line end counted as one byte."""
    i, b = col(index).cast("long"), col(before).cast("long")
    at = lambda column: F.struct((i + 1).alias("line"), column.cast("long").alias("column"))
    return F.struct(b.alias("byte_start"), (b + F.octet_length(col(line))).alias("byte_end"), at(F.lit(1)).alias("start"), at(F.char_length(col(line)) + 1).alias("end"))


def span_text(text: Name, span: Name) -> Column:
    """The bytes of a span as text; null if the span is outside, inverted or cuts a character."""
    raw, s = F.encode(col(text), "UTF-8"), col(span)
    cut = F.substring(raw, (s["byte_start"] + 1).cast("int"), (s["byte_end"] - s["byte_start"]).cast("int")).cast("string")
    ok = (s["byte_start"] <= s["byte_end"]) & (s["byte_end"] <= F.octet_length(raw)) & F.is_valid_utf8(cut)
    return F.when(ok, cut)


def valid_span(span: Name) -> Column:
    s = col(span)
    a, z = s["start"], s["end"]
    return (s["byte_start"] <= s["byte_end"]) & ((a["line"] < z["line"]) | ((a["line"] == z["line"]) & (a["column"] <= z["column"])))


IDENTIFIER = "[A-Za-z0-9_$]+"


def read_identifier(text: Name) -> Column:
    return F.nullif(F.regexp_extract(col(text), f"^({IDENTIFIER})", 1), F.lit(""))


def first_identifier_after(line: Name, prefix: str) -> Column:
    import re

    return F.nullif(F.regexp_extract(F.ltrim(col(line)), rf"^{re.escape(prefix)}\s*({IDENTIFIER})", 1), F.lit(""))


def quoted_module(line: Name) -> Column:
    """What the first pair of double quotes encloses, else of single ones; an empty text is a match."""
    q = lambda quote: F.when(F.regexp_like(col(line), F.lit(f"(?s){quote}.*?{quote}")), F.regexp_extract(col(line), f"(?s)^[^{quote}]*{quote}([^{quote}]*){quote}", 1))
    return F.coalesce(q('"'), q("'"))


#: Words before a parenthesis that call nothing.
NO_CALLS = ["if", "for", "while", "switch", "function", "def", "class", "return"]


def call_identifiers(line: Name) -> Column:
    """Before each '(' and at the line's end, the last identifier after a dot, but for keywords."""
    return F.filter(F.transform(F.split(col(line), "[(]"), lambda x: F.regexp_extract(F.regexp_replace(x, r"\s+$", ""), r"([A-Za-z0-9_$]*)$", 1)), lambda y: (y != "") & ~y.isin(*NO_CALLS))


def simple_name(symbol: Name) -> Column:
    """Last part between '/', '#' and '.'; the whole if that is empty."""
    return F.coalesce(F.nullif(F.element_at(F.split(col(symbol), "[/#.]"), -1), F.lit("")), col(symbol))


# Scores and labels

#: What risks and changes score in a review.
RISK_SCORES = {"high": 20, "medium": 10, "low": 1}
SYMBOL_SCORES = {"removed": 8, "added": 5, "modified": 3, "type-changed": 3, "renamed": 2, "copied": 2}
PUBLIC_SCORE = 10
FILE_SCORES = {"removed": 12, "added": 8, "renamed": 8, "type-changed": 6, "modified": 2, "copied": 2}
#: Sentences of a review.
SYMBOL_REASONS = {"removed": "symbol removed", "added": "new symbol added", "renamed": "symbol renamed", "copied": "symbol copied"}
PUBLIC_REASON, OTHER_SYMBOL_REASON = "public API changed", "symbol behavior or shape changed"
FILE_REASONS = {"removed": "file removed", "added": "new file added"}
RENAMED_REASON, TEST_REASON, OTHER_FILE_REASON = "file renamed from ", "test coverage changed", "file changed"


def fact_score(provenance: Name, confidence: Name) -> Column:
    return ((ordinal(provenance, schema.PROVENANCES) + 1) * 10 + ordinal(confidence, schema.CONFIDENCES) + 1).cast("int")


def label(qualified: Name = "qualified_name", name: Name = "name") -> Column:
    return F.coalesce(col(qualified), col(name))


def scoped_name(symbol_kind: Name, qualified: Name, name: Name) -> Column:
    """$module for a module; else what follows the first dot if both sides hold something; else the name."""
    q = F.coalesce(label(qualified, name), F.lit(""))
    cut = F.instr(q, ".")
    return F.when(col(symbol_kind) == "module", "$module").when((cut > 1) & (cut < F.length(q)), F.substr(q, cut + 1)).otherwise(F.coalesce(col(name), q))


def impact_verb(edge_kind: Name) -> Column:
    return F.when(col(edge_kind) == "depends-on", "depends on").when(col(edge_kind).isin("imports", "calls", "references"), col(edge_kind)).otherwise("uses")


def risk_for(change: Name, public: Name) -> Column:
    c, p = col(change), col(public)
    return F.when(p & (c == "removed"), "high").when(p | (c == "removed"), "medium").otherwise("low")


def by_value(x: Name, values: dict[str, int]) -> Column:
    out = F
    for k, v in values.items():
        out = out.when(col(x) == k, F.lit(v))
    return out.otherwise(F.lit(0))


def risk_score(risk: Name) -> Column:
    return by_value(risk, RISK_SCORES)


def symbol_score(risk: Name, public: Name, change: Name) -> Column:
    return risk_score(risk) + F.when(col(public), PUBLIC_SCORE).otherwise(0) + by_value(change, SYMBOL_SCORES)


def file_score(change: Name) -> Column:
    return by_value(change, FILE_SCORES)


def file_risk(path: Name, change: Name) -> Column:
    return F.when(is_test_path(path), "low").when(col(change) == "removed", "high").otherwise("medium")


def max_risk(risk: Name) -> Column:
    """The highest risk of a group."""
    return F.max_by(col(risk), risk_score(risk))


def symbol_reason(public: Name, change: Name) -> Column:
    out = F.when(col(public), PUBLIC_REASON)
    for value, reason in SYMBOL_REASONS.items():
        out = out.when(col(change) == value, reason)
    return out.otherwise(OTHER_SYMBOL_REASON)


def file_reason(path: Name, change: Name, old_path: Name) -> Column:
    c = col(change)
    return (
        F.when((c == "renamed") & col(old_path).isNotNull(), F.concat(F.lit(RENAMED_REASON), col(old_path)))
        .when(c == "removed", FILE_REASONS["removed"]).when(c == "added", FILE_REASONS["added"]).when(is_test_path(path), TEST_REASON).otherwise(OTHER_FILE_REASON)
    )


def symbol_summary(symbols: Name) -> Column:
    """The first of a set in order, and how many more there are."""
    s = F.array_sort(col(symbols))
    n = F.size(s)
    return F.when(n == 1, s[0]).when(n > 1, F.concat(s[0], F.lit(" (+"), (n - 1).cast("string"), F.lit(" more)")))


def location(path: Name, span: Name) -> Column:
    s = col(span)
    return F.when(s.isNull(), col(path)).otherwise(F.concat_ws(":", col(path), s["start"]["line"].cast("string"), s["start"]["column"].cast("string")))


# Interchange spans


def scip_span(span_range: Name) -> Column:
    """[line, start, end] from zero, as a one-line span; null if shorter. Of four elements the third is the end column."""
    r = col(span_range)
    point = lambda line, column: F.struct((line + 1).alias("line"), (column + 1).alias("column"))
    zero = F.lit(0).cast("long")
    whole = F.struct(zero.alias("byte_start"), zero.alias("byte_end"), point(r[0], r[1]).alias("start"), point(r[0], r[2]).alias("end"))
    return F.when(F.size(r) >= 3, whole)


def lsp_span(span_range: Name) -> Column:
    r = col(span_range)
    point = lambda p: F.struct((p["line"] + 1).alias("line"), (p["character"] + 1).alias("column"))
    zero = F.lit(0).cast("long")
    return F.when(r.isNotNull(), F.struct(zero.alias("byte_start"), zero.alias("byte_end"), point(r["start"]).alias("start"), point(r["end"]).alias("end")))
