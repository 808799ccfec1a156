"""Resolution: from imports, calls, fields and macros to edges with a confidence and a method."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselar import schema
from tesselar.functions import text
from tesselar.graph import PropertyGraph
from tesselar.operators import joins

TYPE_LABELS = ["Struct", "Enum", "Trait", "TypeAlias"]
CALLABLE = ["Function", "Method"]

# What macros, and in other languages the decorators and hooks that stand for them, expand to.
MACROS = {
    "rust": {
        "println": ["std::io::_print", "std::fmt::Arguments::new_v1"], "eprintln": ["std::io::_eprint", "std::fmt::Arguments::new_v1"], "print": ["std::io::_print"], "eprint": ["std::io::_eprint"],
        "format": ["std::fmt::format"], "write": ["std::fmt::Write::write_fmt"], "writeln": ["std::fmt::Write::write_fmt"], "vec": ["alloc::vec::Vec::from_elem"], "panic": ["std::rt::begin_panic"],
        "assert": ["std::rt::begin_panic"], "assert_eq": ["std::rt::begin_panic"], "assert_ne": ["std::rt::begin_panic"], "unreachable": ["std::rt::begin_panic"], "todo": ["std::rt::begin_panic"], "unimplemented": ["std::rt::begin_panic"],
        "matches": ["core::matches"], "dbg": ["std::io::_eprint"], "include_str": ["core::include_str"],
    },
    "python": {
        "dataclass": ["dataclasses.dataclass"], "property": ["builtins.property"], "staticmethod": ["builtins.staticmethod"], "classmethod": ["builtins.classmethod"],
        "cached_property": ["functools.cached_property"], "lru_cache": ["functools.lru_cache"], "wraps": ["functools.wraps"], "abstractmethod": ["abc.abstractmethod"],
    },
    "typescript": {
        "Component": ["@angular/core.Component"], "Injectable": ["@angular/core.Injectable"], "NgModule": ["@angular/core.NgModule"], "Pipe": ["@angular/core.Pipe"], "Directive": ["@angular/core.Directive"],
        "Input": ["@angular/core.Input"], "Output": ["@angular/core.Output"], "useState": ["react.useState"], "useEffect": ["react.useEffect"], "useMemo": ["react.useMemo"], "useCallback": ["react.useCallback"],
    },
}


def label_rank(label: Column) -> Column:
    order = schema.SEARCHABLE
    return reduce(lambda acc, x: F.when(label == x[1], x[0]).otherwise(acc), list(enumerate(order)), F.lit(len(order)))


def symbols(graph: PropertyGraph) -> DataFrame:
    """name, qualified_name, id, label, file of what references can mean."""
    return graph.scan(*schema.SEARCHABLE).select("name", "qualified_name", "id", "label", F.coalesce("file", text.file_of_id(F.col("id"))).alias("file"))


def _first_order() -> list[Column]:
    """Of several symbols that fit as well."""
    return [label_rank(F.col("label")), F.col("qualified_name"), F.col("id")]


def _edge(kind: str, from_label: Column, from_id: Column, to_label: Column, to_id: Column, confidence: Column, method: str, phase: int) -> list[Column]:
    rel = F.concat_ws("_", F.lit(kind), from_label, to_label)
    return [rel.alias("rel"), F.lit(kind).alias("kind"), from_label.alias("from_label"), from_id.alias("from_id"), to_label.alias("to_label"), to_id.alias("to_id"), confidence.alias("confidence"), F.lit(method).alias("resolution_method"), F.lit(phase).alias("phase")]


def imports(graph: PropertyGraph, roots: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges from files to what they import, and the imports (id, reason) without a target.

    The last segment is looked up by name; of several the one whose name fits the path is taken, with less confidence.
    A glob takes all direct children of its module. Paths that leave the code are external; roots names first
    segments that don't.
    """
    known = symbols(graph)
    asked = graph.scan("Import").select(F.col("id").alias("import"), F.col("path").alias("raw"), text.normalise_import(F.col("path")).alias("path"), F.coalesce("is_glob", F.lit(False)).alias("is_glob"), F.coalesce("file", text.file_of_id(F.col("id"))).alias("source"))
    inside = asked.where(F.coalesce("raw", F.lit("")) != "").where(~text.is_external(F.col("raw"), roots))
    single = inside.where("not is_glob").select("import", "source", "path", text.leaf(F.col("path")).alias("leaf"))
    best = joins.best_match(single, "leaf", F.col("path"), known.select("name", "qualified_name", "id", "label"), *_first_order())
    one = best.select("import", *_edge("Imports", F.lit("File"), F.col("source"), F.col("label"), F.col("id"), F.when(F.col("n") == 1, 1.0).otherwise(0.7), "import", 1))
    module = known.withColumn("module", F.regexp_replace(F.regexp_replace(text.parent(F.col("qualified_name")), r"^src/", ""), r"\.(rs|py|tsx?)$", "")).withColumn("module", F.regexp_replace("module", "/", "::"))
    globs = inside.where("is_glob").withColumn("module", F.regexp_replace("path", r"::\*$", "")).join(module, "module")
    many = globs.select("import", *_edge("Imports", F.lit("File"), F.col("source"), F.col("label"), F.col("id"), F.lit(0.9), "glob", 1))
    edges = one.unionByName(many)
    missing = asked.join(edges.select("import").distinct(), "import", "left_anti").select(F.col("import").alias("id"), F.when(text.is_external(F.col("raw"), roots), "external crate").otherwise("no candidate").alias("reason"))
    return edges, missing


def calls(graph: PropertyGraph, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges from callers, and the call sites (id, reason) without a target. found: the edges of imports.

    A qualified callee is looked up by its last segment. Another is what its file imports under that name, or the
    only one of that name in its file, or the only one at all; in this order.
    """
    known = symbols(graph)
    sites = graph.scan("CallSite").select(F.col("id").alias("site"), F.col("callee_name").alias("callee"), text.caller_of_site(F.col("id")).alias("caller"), F.coalesce("file", text.file_of_id(F.col("id"))).alias("source")).where(~F.endswith("callee_name", F.lit("!")))
    sites = joins.label_or_default(sites.withColumnRenamed("caller", "from_qn"), "from_qn", known).withColumnRenamed("label", "from_label")
    target = F.struct("label", "id").alias("t")
    full = sites.where(F.contains("callee", F.lit("::"))).select("site", "callee", text.leaf(F.col("callee")).alias("leaf"))
    full = joins.best_match(full, "leaf", F.col("callee"), known.select("name", "qualified_name", "id", "label"), *_first_order()).select("site", target, F.lit(1.0).alias("confidence"))
    plain = sites.where(~F.contains("callee", F.lit("::")))
    named = found.join(known.select(F.col("id").alias("to_id"), F.col("name").alias("callee")), "to_id").groupBy(F.col("from_id").alias("source"), "callee").agg(F.min(F.struct(F.col("to_label").alias("label"), F.col("to_id").alias("id"))).alias("a"))
    only = lambda keys, out: known.groupBy(*keys).agg(F.min(F.struct("label", "id")).alias(out), F.count("*").alias("n")).where("n = 1").drop("n").withColumnRenamed("name", "callee")
    tried = plain.join(named, ["source", "callee"], "left").join(only(["file", "name"], "b").withColumnRenamed("file", "source"), ["source", "callee"], "left").join(only(["name"], "c"), "callee", "left")
    short = tried.select("site", F.coalesce("a", "b", "c").alias("t"), F.lit(0.9).alias("confidence")).where("t is not null")
    hit = sites.join(full.unionByName(short), "site")
    to_label, to_id = F.col("t.label"), F.col("t.id")
    called = hit.where(to_label.isin(CALLABLE) & F.col("from_label").isin(CALLABLE)).select("site", *_edge("Calls", F.col("from_label"), F.col("from_qn"), to_label, to_id, F.col("confidence"), "call", 2))
    used = hit.where(to_label.isin(TYPE_LABELS) & F.col("from_label").isin(CALLABLE)).select("site", *_edge("Uses", F.col("from_label"), F.col("from_qn"), to_label, to_id, F.col("confidence"), "call", 2))
    edges = called.unionByName(used)
    return edges, sites.join(edges.select("site").distinct(), "site", "left_anti").select(F.col("site").alias("id"), F.lit("no candidate").alias("reason"))


def implements(graph: PropertyGraph) -> DataFrame:
    """Structs and traits with a method of one name."""
    has = graph.expand("HasMethod_Struct_Method", "HasMethod_Trait_Method").join(graph.scan("Method").select(F.col("id").alias("to_id"), "name"), "to_id").select(F.col("from_id").alias("owner"), F.col("from_label").alias("owner_label"), "name")
    pairs = joins.sharing(has, "owner", "owner_label", "name", "Struct", "Trait")
    return pairs.select(*_edge("Implements", F.lit("Struct"), F.col("a"), F.lit("Trait"), F.col("b"), F.lit(0.7), "method-name", 3))


def heritage(refs: DataFrame, graph: PropertyGraph) -> DataFrame:
    """Extends and Implements edges from declared references (kind, from_qualified_name, to_qualified_name)."""
    known = symbols(graph).where(F.col("label").isin("Struct", "Enum", "Trait"))
    left = refs.where(F.col("kind").isin("Extends", "Implements")).join(known.select(F.col("qualified_name").alias("from_qualified_name"), F.col("id").alias("from_id"), F.col("label").alias("from_label")), "from_qualified_name").withColumn("leaf", text.leaf(F.col("to_qualified_name")))
    best = joins.first_of_name(left.dropDuplicates(["kind", "from_id", "to_qualified_name"]), "leaf", known.select("name", "id", "label"), F.col("label"), F.col("id"))
    edges = best.select(F.col("kind").alias("k"), *_edge("Extends", F.col("from_label"), F.col("from_id"), F.col("label"), F.col("id"), F.lit(1.0), "declared", 4))
    return edges.withColumn("kind", F.col("k")).withColumn("rel", F.concat_ws("_", "k", "from_label", "to_label")).drop("k")


def derives(refs: DataFrame, graph: PropertyGraph, language: str = "rust") -> tuple[DataFrame, DataFrame]:
    """Implements edges from types to the library's traits that they derive, and these StdlibSymbol nodes."""
    known = symbols(graph).where(F.col("label").isin("Struct", "Enum")).select(F.col("qualified_name").alias("from_qualified_name"), "id", "label")
    met = refs.where(F.col("kind") == "DeriveImplements").join(known, "from_qualified_name")
    target = F.concat(F.lit(f"stdlib::{language}::derive::"), F.col("to_qualified_name"))
    edges = met.select(*_edge("Implements", F.col("label"), F.col("id"), F.lit("StdlibSymbol"), target, F.lit(0.85), "macro-expansion", 6))
    nodes = met.select("to_qualified_name").distinct().select(target.alias("id"), F.lit("StdlibSymbol").alias("label"), F.col("to_qualified_name").alias("name"), F.lit(language).alias("language"), F.col("to_qualified_name").alias("canonical_path"))
    return edges, nodes


def library_calls(sites: DataFrame, entries: DataFrame) -> DataFrame:
    """sites (language, receiver_type, method and others) with the library's canonical_path. entries: the library's index, (language, receiver_type, method, canonical_path), a parameter."""
    return sites.join(entries, ["language", "receiver_type", "method"])


def field_uses(graph: PropertyGraph) -> DataFrame:
    """Fields and the types that their annotations name: of several types of a name the first by label and name."""
    fields = graph.scan("Field").select("id", F.explode(text.type_identifiers(F.col("type_annotation"))).alias("type"))
    types = graph.scan(*TYPE_LABELS).select("name", F.col("label").alias("l"), F.col("id").alias("t"), F.col("qualified_name").alias("q"))
    best = joins.first_of_name(fields.distinct(), "type", types, label_rank(F.col("l")), F.col("q"), F.col("t"))
    return best.select(*_edge("Uses", F.lit("Field"), F.col("id"), F.col("l"), F.col("t"), F.lit(0.9), "field-type", 5))


def macro_rules(spark: SparkSession, language: str = "rust") -> DataFrame:
    mark = "!" if language == "rust" else ""
    return spark.createDataFrame([(f"{name}{mark}", path) for name, paths in MACROS.get(language, {}).items() for path in paths], "callee_name string, canonical_path string")


def macros(graph: PropertyGraph, language: str = "rust") -> tuple[DataFrame, DataFrame]:
    """Edges from callers of macros to what they expand to, and these StdlibSymbol nodes."""
    rules = F.broadcast(macro_rules(graph.nodes.sparkSession, language))  # a fixed table
    sites = graph.scan("CallSite").select("id", "callee_name").join(rules, "callee_name").select(text.caller_of_site(F.col("id")).alias("from_qn"), "canonical_path")
    met = joins.label_or_default(sites, "from_qn", symbols(graph)).where(F.col("label").isin(CALLABLE))
    target = F.concat(F.lit(f"stdlib::{language}::"), F.col("canonical_path"))
    edges = met.select(*_edge("Calls", F.col("label"), F.col("from_qn"), F.lit("StdlibSymbol"), target, F.lit(0.85), "macro-expansion", 6))
    nodes = met.select("canonical_path").distinct().select(target.alias("id"), F.lit("StdlibSymbol").alias("label"), text.leaf(F.col("canonical_path")).alias("name"), F.lit(language).alias("language"), "canonical_path")
    return edges, nodes


def from_definitions(graph: PropertyGraph, definitions: DataFrame, per_site: bool = True, existing: DataFrame | None = None) -> DataFrame:
    """Edges for call sites by a table of definitions (file, line, col, target_file, target_line), as a language server gives them.

    The target is the symbol that starts at the line, or within three lines of it. per_site: all sites are asked;
    else those of callers without any Calls edge among existing.
    """
    sites = graph.scan("CallSite").select(F.col("id").alias("site"), text.caller_of_site(F.col("id")).alias("from_qn"), F.coalesce("file", text.file_of_id(F.col("id"))).alias("file"), "line", "col")
    if not per_site:
        done = (existing if existing is not None else graph.edges).where(F.col("kind") == "Calls").select(F.col("from_id").alias("from_qn")).distinct()
        sites = sites.join(done, "from_qn", "left_anti")
    asked = sites.join(definitions, ["file", "line", "col"])
    starts = graph.scan(*CALLABLE, *TYPE_LABELS).where("start_line is not null").select(F.coalesce("file", text.file_of_id(F.col("id"))).alias("target_file"), F.col("start_line").alias("at"), F.col("id").alias("t"), F.col("label").alias("l"))
    met = joins.first_per(joins.nearest(asked, ["target_file"], "target_line", starts, "at"), ["site"], F.col("_priority"), label_rank(F.col("l")), F.col("t"))
    labelled = joins.label_or_default(met, "from_qn", symbols(graph))
    call = labelled.where(F.col("l").isin(CALLABLE)).select(*_edge("Calls", F.col("label"), F.col("from_qn"), F.col("l"), F.col("t"), F.lit(0.9), "lsp-definition", 7))
    return call.unionByName(labelled.where(F.col("l").isin(TYPE_LABELS)).select(*_edge("Uses", F.col("label"), F.col("from_qn"), F.col("l"), F.col("t"), F.lit(0.9), "lsp-definition", 7)))


def first_phase(edges: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One edge for each (rel, from, to): that of the first phase; none that exist already."""
    out = joins.first_per(edges, ["rel", "from_id", "to_id"], F.col("phase"), F.desc("confidence"))
    return out.join(existing.select("rel", "from_id", "to_id"), ["rel", "from_id", "to_id"], "left_anti") if existing is not None else out


def run(graph: PropertyGraph, language: str = "rust", refs: DataFrame | None = None, roots: list[str] | None = None) -> tuple[PropertyGraph, DataFrame, DataFrame]:
    """The graph with resolved edges, the statistics (one row for each kind), and what is unresolved (id, reason)."""
    spark = graph.nodes.sparkSession
    imported, no_import = imports(graph, roots)
    called, no_call = calls(graph, imported)
    by_macro, nodes = macros(graph, language)
    parts = [imported.drop("import"), called.drop("site"), implements(graph), field_uses(graph), by_macro]
    if refs is not None:
        derived, traits = derives(refs, graph, language)
        parts += [heritage(refs, graph), derived]
        nodes = nodes.unionByName(traits)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    tables = schema.rel_tables(spark)
    fresh = first_phase(every.join(F.broadcast(tables.select("rel")), "rel", "left_semi"), graph.edges)
    out = graph.add_nodes(nodes.join(graph.nodes.select("id"), "id", "left_anti"))
    out = out.add_edges(fresh.drop("phase"))
    stats = every.groupBy("kind").agg(F.count("*").alias("resolved"), F.count_distinct("rel", "from_id", "to_id").alias("edges"))
    return out, stats, no_import.unionByName(no_call)
