"""Facts of lines, for texts that no tree is made of: the line scanners of each language, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..operators import scanners as S

SCRIPT, BRACE = ["typescript", "javascript"], ["c", "cpp", "go", "java", "objective-c"]
#: Languages whose lines are scanned here; Python's scopes go by indentation, which its extractor follows itself.
LANGUAGES = [*SCRIPT, "rust", *BRACE]
#: Places of facts of a line.
ROOM = 1 << 20


def _of(language: Column, options: list[tuple[list[str], Column]]) -> Column:
    out = F
    for names, value in options:
        out = out.when(language.isin(*names), value)
    return out


def scan_facts(sources: DataFrame) -> DataFrame:
    """Facts of (file_id, language, text), in the order of lines: imports, exports, what a line declares, and calls.

    A call belongs to the symbol that was declared last above it. Names are not qualified, as lines don't tell scopes.
    """
    lines = S.source_lines(sources.where(F.col("language").isin(*LANGUAGES)), also=("language",))
    t, language = F.col("trimmed"), F.col("language")
    symbol = lambda name, kind: F.when(name.isNotNull(), F.struct(name.alias("name"), F.lit(kind).alias("kind")))
    rows = lines.select(
        "file_id", "i", "span",
        _of(language, [(SCRIPT, S.ts_import(t)), (["rust"], S.rust_import(t)), (BRACE, S.brace_import(t))]).alias("imported"),
        _of(language, [(SCRIPT, S.ts_export(t))]).alias("exported"),
        _of(language, [(SCRIPT, S.ts_symbol(t)), (["rust"], symbol(S.rust_function(t), "function")), (BRACE, symbol(S.brace_type(t), "class"))]).alias("first"),
        _of(language, [(BRACE, symbol(S.brace_function(t), "function"))]).alias("second"),
        _of(language, [(SCRIPT, S.ts_calls(t))]).alias("calls"),
    )
    at = lambda k: F.col("i").cast("long") * ROOM + k
    rows = rows.withColumn("place", F.when(F.col("first").isNotNull(), at(2)))
    rows = rows.withColumn("owner", F.coalesce(S.enclosing_symbol(rows, "file_id", "i", "place"), F.lit(-1).cast("long")))
    none, root = F.lit(None).cast("string"), F.lit(-1).cast("long")
    fact = lambda kind, place, name, qualified, symbol_kind, owner: F.struct(
        place.cast("long").alias("ord"), F.lit(kind).alias("fact"), name.alias("name"), qualified.alias("qualified_name"), symbol_kind.alias("symbol_kind"), owner.alias("owner")
    )
    one = lambda there, value: F.when(there.isNotNull(), value)
    col = F.col
    single = F.array_compact(F.array(
        one(col("imported"), fact("import", at(0), col("imported"), col("imported"), none, root)),
        one(col("exported"), fact("export", at(1), col("exported"), none, none, root)),
        one(col("first"), fact("symbol", at(2), col("first.name"), col("first.name"), col("first.kind"), root)),
        one(col("second"), fact("symbol", at(3), col("second.name"), col("second.name"), col("second.kind"), root)),
    ))
    called = F.transform(F.coalesce("calls", F.array().cast("array<string>")), lambda c, i: fact("call", at(8) + i, c, none, none, col("owner")))
    found = rows.select("file_id", "span", F.explode(F.concat(single, called)).alias("f"))
    return found.select("file_id", "f.ord", "f.fact", "f.name", "f.qualified_name", "f.symbol_kind", col("span").cast(schema.SPAN).alias("span"), "f.owner", F.lit("structural-scanner").alias("provenance"), F.lit("medium").alias("confidence"), none.alias("message"))
