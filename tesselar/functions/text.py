"""Scalar functions on names, paths, annotations and times, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What isn't a type of the code at hand, and which first segments of paths are known to be external.
PRIMITIVES = ["bool", "char", "str", "u8", "u16", "u32", "u64", "u128", "usize", "i8", "i16", "i32", "i64", "i128", "isize", "f32", "f64", "self", "Self", "String", "Vec", "Option", "Result", "Box", "Arc", "Rc", "HashMap", "HashSet", "BTreeMap", "BTreeSet"]
EXTENSIONS = {"rs": "rust", "py": "python", "ts": "typescript", "tsx": "typescript", "java": "java", "kt": "kotlin", "kts": "kotlin", "swift": "swift", "m": "objc", "mm": "objc", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hh": "cpp", "hpp": "cpp", "hxx": "cpp", "go": "go"}


def qualify(*parts: Column) -> Column:
    return F.concat_ws("::", *parts)


def leaf(qn: Column) -> Column:
    return F.substring_index(qn, "::", -1)


def file_prefix(qn: Column) -> Column:
    return F.substring_index(qn, "::", 1)


def parent(qn: Column) -> Column:
    """What stands before the last `::`, or an empty string."""
    return F.regexp_extract(qn, r"^(.*)::[^:]*$", 1)


def strip_first_folder(qn: Column) -> Column:
    """The name without its path's first folder; null where the path is a bare file."""
    path = file_prefix(qn)
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(qn, r"^[^/]*/", ""))


def file_of_id(i: Column) -> Column:
    """The path that an id begins with, up to an extension that is followed by `::`; any of the known languages."""
    found = F.regexp_extract(i, rf"^(.*?\.(?:{'|'.join(EXTENSIONS)}))::", 1)
    return F.when(found != "", found).otherwise(i)


def caller_of_site(i: Column) -> Column:
    found = F.regexp_extract(i, r"^(.*)::call@", 1)
    return F.when(found != "", found).otherwise(i)


def rel_kind(rel: Column) -> Column:
    return F.substring_index(rel, "_", 1)


def community_number(i: Column) -> Column:
    return F.coalesce(F.substring_index(i, "::", -1).try_cast("bigint"), F.lit(-1))


def language(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    known = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.try_element_at(known, extension)


def symbol_text(name: Column) -> Column:
    """The words of a name, lower-cased, one space apart: cut at `: _ / .` and before capitals."""
    spaced = F.regexp_replace(F.translate(name, ":_/.", "    "), r"(\p{Lu})", " $1")
    return F.array_join(symbol_tokens_of(spaced), " ")


def symbol_tokens_of(spaced: Column) -> Column:
    return F.filter(F.split(F.lower(spaced), r"\s+"), lambda x: x != "")


def symbol_tokens(name: Column) -> Column:
    return symbol_tokens_of(F.regexp_replace(F.translate(name, ":_/.", "    "), r"(\p{Lu})", " $1"))


def type_identifiers(annotation: Column) -> Column:
    """The types that an annotation names, in their order: capitalised, no lifetimes, no primitives or containers."""
    tokens = F.split(F.translate(annotation, "&*<>,()[]", "         "), r"\s+")
    return F.filter(tokens, lambda x: (x != "") & x.rlike(r"^\p{Lu}") & ~x.isin(PRIMITIVES))


def claim_token(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, r"[^A-Za-z0-9_:]", ""))


def is_external(path: Column, internal_roots: list[str] | None = None) -> Column:
    """Whether an imported path leaves the code at hand: any first segment but crate, self, super, a relative one or one of internal_roots."""
    first = F.substring_index(path, "::", 1)
    inside = first.isin("crate", "self", "super", *(internal_roots or [])) | F.startswith(first, F.lit("."))
    return ~inside & (first != "") & ~F.contains(first, F.lit("/"))


def normalise_import(path: Column) -> Column:
    return F.regexp_replace(path, "^crate::", "")


def safe_id(i: Column) -> Column:
    return i.rlike(r"^[A-Za-z0-9._-]{1,128}$") & ~F.startswith(i, F.lit(".")) & ~F.contains(i, F.lit(".."))


def safe_path(path: Column) -> Column:
    """Absolute, without a `..` segment."""
    return F.startswith(path, F.lit("/")) & ~path.rlike(r"(^|/)\.\.(/|$)")


def hunk_start(header: Column) -> Column:
    """The new side's first line in a hunk's header."""
    return F.regexp_extract(header, r"^@@ -\d+(?:,\d+)? \+(\d+)", 1).try_cast("bigint")


def iso_time(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def compact_time(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyyMMdd'T'HHmmss'Z'")


def run_id(seconds: Column) -> Column:
    return F.concat_ws("-", compact_time(seconds), F.substring(F.sha2(F.uuid(), 256), 1, 6))


def percent_encoded(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.url_encode(path), r"%2F", "/"), r"\+", "%20")


def visibility(language: str, name: Column) -> Column:
    """The visibility that a language reads from a name."""
    if language == "python":
        return F.when(F.startswith(name, F.lit("__")) & F.endswith(name, F.lit("__")), "").when(F.startswith(name, F.lit("_")), "private").otherwise("")
    if language == "go":
        return F.when(name.rlike(r"^\p{Lu}"), "public").otherwise("package")
    raise ValueError(f"{language} reads no visibility from names")


def is_constant_name(name: Column) -> Column:
    return name.rlike(r"^[A-Z0-9_]+$") & name.rlike(r"[A-Z]")
