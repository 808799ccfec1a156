"""Source code made of parts: parsing and indexing against counts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselar import parsing
from tesselar.operators import index, resolve
from tesselar.queries.registry import query
from tesselar.tables import table

FILE_PARTS = 64


def _files(spark: SparkSession, sf_dir: str, language: str, extension: str, item: Column) -> DataFrame:
    """A file for each brand, with an item for each of its parts."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", item.alias("item")))), lambda x: x["item"]), "\n")
    # Files are few and long: as many partitions as would hold them one by one, which adaptive execution doesn't join.
    files = table(spark, sf_dir, "part").repartition(FILE_PARTS, "p_brand").groupBy("p_brand").agg(text.alias("content"))
    path = F.concat(F.lit("src/"), F.regexp_replace("p_brand", "#", "_"), F.lit(extension))
    return files.select(path.alias("path"), F.lit(language).alias("language"), F.octet_length("content").cast("long").alias("size_bytes"), "content")


def _key() -> Column:
    return F.col("p_partkey").cast("string")


def _rust(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.concat(F.lit("pub struct P"), _key(), F.lit(" { pub size: u32, /* fn no() */ next: Option<P"), _key(), F.lit("> }\nfn f"), _key(), F.lit('() { helper::g'), F.col("p_size").cast("string"), F.lit('(); println!("fn {}", 1); }'))
    return _files(spark, sf_dir, "rust", ".rs", item)


PATH = "'src/' || replace(p_brand, '#', '_') || '.{0}'"


@query(f"SELECT {PATH.format('py')} AS file, label, count(*) AS n FROM part, (SELECT unnest(['Function', 'CallSite', 'Constant']) AS label) GROUP BY ALL")
def parse_python_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.concat(F.lit("MAX_"), _key(), F.lit(" = 1\ndef part_"), _key(), F.lit("(a):\n    return call_"), F.col("p_size").cast("string"), F.lit("(a.method('def x(): pass'))"))
    parsed = parsing.parse_files(_files(spark, sf_dir, "python", ".py", item), strict=True)
    return parsed.where("record = 'node'").groupBy("file", "label").agg(F.count("*").alias("n"))


@query(f"SELECT {PATH.format('rs')} AS file, label, count(*) AS n FROM part, (SELECT unnest(['Struct', 'Field', 'Field', 'Function', 'CallSite', 'CallSite']) AS label) GROUP BY ALL")
def parse_rust_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.parse_files(_rust(spark, sf_dir), strict=True).where("record = 'node'").groupBy("file", "label").agg(F.count("*").alias("n"))


@query(
    """
SELECT rel, count(*) AS n FROM part, (SELECT unnest(['Defines_File_Struct', 'Defines_File_Function', 'HasField_Struct_Field', 'HasField_Struct_Field']) AS rel) GROUP BY rel
UNION ALL SELECT 'Contains_Dir_File', count(DISTINCT p_brand) FROM part"""
)
def index_source_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.run(_rust(spark, sf_dir), strict=True)[0].edge_count()


@query(
    f"""
SELECT 'Uses_Field_Struct' AS rel, {PATH.format('rs')} || '::P' || p_partkey || '::next' AS from_id, {PATH.format('rs')} || '::P' || p_partkey AS to_id, 0.9::DOUBLE AS confidence FROM part
UNION ALL SELECT 'Calls_Function_StdlibSymbol', {PATH.format('rs')} || '::f' || p_partkey, 'stdlib::rust::' || path, 0.85 FROM part, (SELECT unnest(['std::io::_print', 'std::fmt::Arguments::new_v1']) AS path)"""
)
def resolve_source_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What fields' types and macros resolve to; the helpers that are called are not among the files."""
    graph, _ = index.run(_rust(spark, sf_dir), strict=True)
    return resolve.run(graph, "rust")[0].edges.where("confidence is not null").select("rel", "from_id", "to_id", "confidence")


#: For each language an item that stands once for each part (# is its key, % its size), and the labels of its nodes.
ITEMS = {
    "typescript": (".ts", "import { A# as B# } from './m#';\nexport interface I# { m(a: number): void }\nexport class K# extends A# implements I# { private n: number = 1; go(): void { helper%(1); } }\nexport enum E# { A, B }\nexport type U# = string;\nexport function f#() { return `function no() {}`; }", ["Import", "Trait", "Method", "Struct", "Field", "Method", "CallSite", "Enum", "Variant", "Variant", "TypeAlias", "Function"]),
    "java": (".java", "class K# extends A implements I { private int n; public void go() { helper%(); } /* void no() {} */ }\ninterface I# { void m(); }\nenum E# { A, B }", ["Struct", "Constant", "Method", "CallSite", "Trait", "Method", "Enum", "Constant", "Constant"]),
    "kotlin": (".kt", "class K# : A() { val n: Int = 1\n fun go() { helper%() } }\ninterface I# { fun m() }\nfun f#() { println(\"fun no() {}\") }", ["Struct", "Constant", "Method", "CallSite", "Trait", "Method", "Function", "CallSite"]),
    "swift": (".swift", "struct K# { var n: Int\n func go() { helper%() } }\nprotocol I# { func m() }\nenum E# { case a, b }\nfunc f#() {} // func no() {}", ["Struct", "Constant", "Method", "CallSite", "Trait", "Method", "Enum", "Constant", "Constant", "Function"]),
    "objc": (".m", "@interface K# : A\n@property int n#;\n- (void)go;\n@end\nvoid f#(int a) { helper%(a); }", ["Struct", "Method", "Function", "CallSite"]),
    "c": (".c", "#define M# 1\nstruct s# { int a; char *b; };\nenum e# { X#, Y# };\ntypedef int t#;\nint f#(int a) { return helper%(a); /* g() */ }", ["Struct", "Enum", "Constant", "Constant", "Constant", "Function", "CallSite"]),
    "cpp": (".cpp", "namespace n# { class K# : public A { public: int a; void go() { helper%(a); } }; }\nint f#() { return 0; }", ["Struct", "Struct", "Constant", "Method", "CallSite", "Function"]),
    "go": (".go", "type S# struct { A int }\ntype I# interface { M() }\nfunc (s S#) Go() { helper%() }\nfunc F#() { x := \"func no() {}\"; _ = x }", ["Struct", "Trait", "Method", "CallSite", "Function"]),
}


def _written(template: str) -> Column:
    """The template with a part's key for # and its size for %; a # before a letter stays."""
    out = F.lit("")
    for piece in re.split(r"(#(?![a-z])|%)", template):
        out = F.concat(out, _key() if piece == "#" else F.col("p_size").cast("string") if piece == "%" else F.lit(piece))
    return out


def _parser(language: str) -> None:
    extension, template, labels = ITEMS[language]
    listed = ", ".join(f"'{x}'" for x in labels)

    def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = parsing.parse_files(_files(spark, sf_dir, language, extension, _written(template)), strict=True)
        return rows.where("record = 'node'").groupBy("file", "label").agg(F.count("*").alias("n"))

    parsed.__name__ = f"parse_{language}_nodes"
    query(f"SELECT {PATH.format(extension[1:])} AS file, label, count(*) AS n FROM part, (SELECT unnest([{listed}]) AS label) GROUP BY ALL")(parsed)


for _language in ITEMS:
    _parser(_language)
