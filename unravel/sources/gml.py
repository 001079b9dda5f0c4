"""GML as a data source: ``spark.read.format("gml")`` and ``df.write.format("gml")``.

    register(spark)
    spark.read.format("gml").option("part", "vertices").load(path)

Rows are those of ``graph_files.read_gml``: ``part`` is "edges" (graph_id, edge_id, src, dst,
value; the default) or "vertices" (graph_id, id, label, weight). graph_id is the last number
in a file's name. A partition is a group of ``files`` files, read one after the other. Files
are opened through pyarrow's file systems; ``read_gml`` reads a store that only Spark knows.
A file that isn't well formed fails the read, with its name and what is wrong.

Writing makes a file a graph from rows (graph_id, src, dst, value), which must come with all
rows of a graph in one partition and sorted by graph_id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMAS = {"edges": "graph_id long, edge_id long, src long, dst long, value double", "vertices": "graph_id long, id long, label string, weight double"}
TOKENS = re.compile(r'"([^"]*)"|([\[\]])|([^\s\[\]"]+)')
NAME = re.compile(r"(\d+)\D*$")


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def parsed(text: str) -> list[tuple[str, object]]:
    """The (key, value) pairs of a GML text; a list's value is such pairs again."""
    stack: list[list[tuple[str, object]]] = [[]]
    key = None
    for m in TOKENS.finditer(re.sub(r"(?m)^\s*#.*$", "", text)):
        quoted, bracket, plain = m.groups()
        if bracket == "[":
            if key is None:
                raise ValueError(f"a list without a key at {m.start()}")
            inner: list[tuple[str, object]] = []
            stack[-1].append((key, inner))
            stack.append(inner)
            key = None
        elif bracket == "]":
            if len(stack) == 1 or key is not None:
                raise ValueError(f"a bracket out of place at {m.start()}")
            stack.pop()
        elif key is None:
            if plain is None:
                raise ValueError(f"a value without a key at {m.start()}")
            key = plain
        else:
            stack[-1].append((key, quoted if plain is None else plain))
            key = None
    if len(stack) > 1 or key is not None:
        raise ValueError("it ends within a list or after a key")
    return stack[0]


def rows_of(text: str, graph_id: int | None, part: str) -> Iterator[tuple]:
    graphs = [v for k, v in parsed(text) if k == "graph" and isinstance(v, list)]
    if len(graphs) != 1:
        raise ValueError(f"{len(graphs)} graphs instead of one")

    def number(found: dict, name: str, kind=int, must: bool = False):
        if name not in found and not must:
            return None
        return kind(found[name])

    at = 0
    for key, value in graphs[0]:
        if not isinstance(value, list):
            continue
        found = {k: v for k, v in value if not isinstance(v, list)}
        if key == "node" and part == "vertices":
            yield graph_id, number(found, "id", must=True), found.get("label"), number(found, "weight", float)
        elif key == "edge" and part == "edges":
            u, v = number(found, "source", must=True), number(found, "target", must=True)
            yield graph_id, at, min(u, v), max(u, v), number(found, "weight", float)
            at += 1


@dataclass
class Files(InputPartition):
    paths: list[str]


class GmlReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.part, self.each = options["path"], options.get("part", "edges"), int(options.get("files", 16))
        if self.part not in SCHEMAS:
            raise ValueError(f"unknown part: {self.part}")

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, path = file_system(self.path)
        info = system.get_file_info(path)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
        paths = sorted(x.path for x in found if x.is_file and x.path.endswith(".gml"))
        return [Files(paths[i : i + self.each]) for i in range(0, len(paths), self.each)]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = file_system(self.path)
        for path in partition.paths:
            with system.open_input_stream(path) as f:
                text = f.read().decode()
            name = NAME.search(path.rpartition("/")[2].removesuffix(".gml"))
            try:
                yield from rows_of(text, int(name[1]) if name else None, self.part)
            except (ValueError, KeyError) as e:
                raise ValueError(f"{path} is no well-formed graph: {e}") from e


class GmlWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"]
        if overwrite:
            raise ValueError("a folder of graphs is only added to")

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        system, path = file_system(self.path)
        system.create_dir(path, recursive=True)
        last, out, ends = None, None, set()

        def close() -> None:
            if out:
                out.write("".join(f"  node [ id {v} ]\n" for v in sorted(ends)).encode() + b"]\n")
                out.close()

        for r in iterator:
            if out is None or r.graph_id != last:
                close()
                last, ends = r.graph_id, set()
                out = system.open_output_stream(f"{path}/graph_{last}.gml")  # a task that runs again writes the same
                out.write(b"graph [\n")
            weight = "" if r.value is None else f" weight {r.value!r}"
            out.write(f"  edge [ source {r.src} target {r.dst}{weight} ]\n".encode())
            ends |= {r.src, r.dst}
        close()
        return WriterCommitMessage()


class GmlSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gml"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("part", "edges")]

    def reader(self, schema: StructType) -> GmlReader:
        return GmlReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> GmlWriter:
        return GmlWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GmlSource)
