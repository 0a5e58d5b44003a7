"""Line scanners: facts from single lines of source text, as Column expressions and windows over lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as X


def source_lines(sources: DataFrame, key: str = "file_id", text: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """(key, *also, i, line, trimmed, span) of every line. Offsets count one byte a line end, whatever it is."""
    rows = sources.select(key, *also, F.posexplode(X.lines(text)).alias("i", "line"))
    ahead = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.octet_length("line") + 1).over(ahead), F.lit(0))
    rows = rows.withColumn("before", before)
    return rows.select(key, *also, "i", "line", F.regexp_replace("line", r"^\s+|\s+$", "").alias("trimmed"), X.line_span("i", "before", "line").alias("span"))


def _first(line: X.Name, prefixes: list[str]) -> Column:
    return F.coalesce(*[X.first_identifier_after(line, p) for p in prefixes])


def _strip_end(x: Column, ends: str) -> Column:
    return F.regexp_replace(x, f"[{ends}]+$", "")


# Brace languages


def brace_import(line: X.Name) -> Column:
    t = X.col(line)
    rest = lambda p: F.trim(F.regexp_extract(t, f"^{p}(.*)$", 1))
    return (
        F.when(F.startswith(t, F.lit("#include")), rest("#include"))
        .when(F.startswith(t, F.lit("import ")), F.regexp_replace(_strip_end(rest("import "), ";"), r'^"+|"+$', ""))
        .when(F.startswith(t, F.lit("@import ")), _strip_end(rest("@import "), ";"))
    )


#: What starts a type in a line.
TYPE_PREFIXES = ["class ", "public class ", "interface ", "public interface ", "struct ", "enum ", "@interface ", "@implementation ", "@protocol ", "type "]


def brace_type(line: X.Name) -> Column:
    return _first(line, TYPE_PREFIXES)


def brace_function(line: X.Name) -> Column:
    """The last identifier before the first parenthesis of a line that doesn't end in ';', unless a keyword (fixed values)."""
    t = X.col(line)
    name = F.regexp_extract(F.substring_index(t, "(", 1), r"([A-Za-z0-9_]+)[^A-Za-z0-9_]*$", 1)
    return F.when(F.contains(t, F.lit("(")) & ~F.endswith(t, F.lit(";")) & (name != "") & ~name.isin("if", "for", "while", "switch", "return"), name)


# Rust


def rust_import(line: X.Name) -> Column:
    t = X.col(line)
    return F.when(F.startswith(t, F.lit("use ")), _strip_end(F.regexp_extract(t, "^use (.*)$", 1), ";"))


def rust_function(line: X.Name) -> Column:
    # fixed values: what starts a function
    return _first(line, ["fn ", "pub fn ", "async fn ", "pub async fn "])


# Python


def python_import(line: X.Name) -> Column:
    return _first(line, ["import ", "from "])


def python_symbol(line: X.Name) -> Column:
    """struct(name, kind) that a line declares: function, class, or what any '=' assigns to."""
    t = X.col(line)
    function, klass = _first(t, ["async def ", "def "]), X.first_identifier_after(t, "class ")
    assigned = F.when(F.contains(t, F.lit("=")), X.read_identifier(F.trim(F.substring_index(t, "=", 1))))
    return _named([(function, "function"), (klass, "class"), (assigned, "variable")])


def _named(options: list[tuple[Column, str]]) -> Column:
    out = F
    for name, kind in options:
        out = out.when(name.isNotNull(), F.struct(name.alias("name"), F.lit(kind).alias("kind")))
    return out


# TypeScript and JavaScript


def ts_import(line: X.Name) -> Column:
    t = X.col(line)
    after = F.get(F.split(t, " from "), F.lit(1))
    module = F.coalesce(F.when(after.isNotNull(), X.quoted_module(after)), X.quoted_module(t))
    return F.when(F.startswith(t, F.lit("import ")) | F.contains(t, F.lit(" require(")), module)


def ts_export(line: X.Name) -> Column:
    # fixed values: what an export may declare
    kinds = ["default function ", "default class ", "function ", "class ", "interface ", "type ", "enum ", "const ", "let ", "var "]
    return F.when(F.startswith(X.col(line), F.lit("export ")), F.coalesce(_first(line, [f"export {k}" for k in kinds]), F.lit("default")))


def ts_symbol(line: X.Name) -> Column:
    t = X.col(line)
    # fixed values: words and prefixes that declare, in the order they are tried
    both = lambda word: _first(t, [f"export {word} ", f"{word} "])
    variable = _first(t, ["export const ", "const ", "export let ", "let ", "export var ", "var "])
    arrow = F.contains(t, F.lit("=>")) | F.contains(t, F.lit("function"))
    name = X.read_identifier(t)
    method = F.when(~F.startswith(t, F.lit("//")) & F.contains(t, F.lit("(")) & F.endswith(t, F.lit("{")) & ~name.isin("if", "for", "while", "switch", "catch"), name)
    return _named([
        (both("function"), "function"), (both("class"), "class"), (both("interface"), "interface"), (both("type"), "type-alias"), (both("enum"), "enum"),
        (F.when(arrow, variable), "function"), (variable, "variable"), (method, "method"),
    ])


def ts_calls(line: X.Name) -> Column:
    """Calls of a line; none but those of a declaration's keywords, and no require."""
    t = X.col(line)
    # fixed values: starts of lines that declare
    starts = ["function ", "class ", "interface ", "export function ", "export class ", "export interface "]
    declares = F.regexp_like(t, F.lit("^(" + "|".join(starts) + ")"))
    return F.filter(X.call_identifiers(t), lambda c: ~declares & (c != "require"))


def enclosing_symbol(lines: DataFrame, key: str, order: str, symbol: str) -> Column:
    """The last symbol that a line up to this one declares, in its file."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(F.col(symbol), ignorenulls=True).over(w)
