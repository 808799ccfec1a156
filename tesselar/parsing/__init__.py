"""Source files to nodes and references, one extractor for each language, run next to the data."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tesselar.parsing.base import Node, Ref
from tesselar.parsing.braces import C, Cpp, Go, Java, Kotlin, ObjC, Swift, TypeScript
from tesselar.parsing.python import Python
from tesselar.parsing.rust import Rust

EXTRACTORS = {x.language: x for x in (Rust, Python, TypeScript, Java, Kotlin, Swift, ObjC, C, Cpp, Go)}
BATCH = 20_000  # rows
SCHEMA = "file string, language string, seq int, record string, label string, name string, qualified_name string, start_line long, end_line long, visibility string, properties map<string,string>, kind string, from_qualified_name string, to_qualified_name string, error string"


def parse(source: str, path: str, language: str) -> tuple[list[Node], list[Ref]]:
    return EXTRACTORS[language](source, path).parse()


def _rows(path: str, language: str, source: str | None, strict: bool = False) -> Iterator[tuple]:
    blank = (None,) * 7
    if strict and (source is None or language not in EXTRACTORS):
        raise ValueError(f"{path}: no source, or no parser for {language}")
    if source is None or language not in EXTRACTORS:
        return
    n = k = 0
    try:
        for nodes, refs in EXTRACTORS[language](source, path).parts():
            for x in nodes:
                yield (path, language, n, "node", x.label, x.name, x.qualified_name, x.start_line, x.end_line, x.visibility, list(x.properties.items()), None, None, None, None)
                n += 1
            for r in refs:
                yield (path, language, k, "ref", *blank, r.kind, r.from_qualified_name, r.to_qualified_name, None)
                k += 1
    except (SyntaxError, RecursionError, ValueError, KeyError, IndexError) as e:  # a file that can't be read is a row, not a failed job
        if strict:
            raise
        yield (path, language, 0, "error", *blank, None, None, None, f"{type(e).__name__}: {e}"[:300])


def parse_files(files: DataFrame, strict: bool = False) -> DataFrame:
    """SCHEMA rows (records node, ref and error) of files (path, language, content), of any length. Arrow batches in, rows out; a file is in one task.

    An error comes after what was found before it. strict: an error fails the job, for sources that must be read.
    """
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "map<string,string>": pa.map_(pa.string(), pa.string())}
    schema = pa.schema([(name, types[kind]) for name, kind in (f.split() for f in SCHEMA.split(", "))])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for p, lang, c in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                for r in _rows(p, lang, c, strict):
                    rows.append(r)
                    if len(rows) == BATCH:
                        yield batch_of(rows)
                        rows = []
        if rows:
            yield batch_of(rows)

    return files.select("path", "language", "content").mapInArrow(run, SCHEMA)


__all__ = ["EXTRACTORS", "SCHEMA", "parse", "parse_files"]
