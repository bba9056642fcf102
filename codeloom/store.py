"""A graph on storage: versions that share their unchanged parts.

Nodes and edges are dealt into buckets by a hash of the file path, embeddings by one of the name. A write makes new folders
for the buckets that it touches only. A version is a small manifest, which names the folder of every bucket of every
table, under ``versions`` by its number; readers take the highest whole one, so they see either the old or the new graph.
A manifest is created without overwriting: of two writers that started from one version, the second fails and leaves
the first one's version as it is. ``vacuum`` deletes folders that none of the latest versions name.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import Graph
from .operators import dml, embed
from .schemas import EDGE_KEY, EDGES, EMBEDDINGS, METADATA, NODE_KEY, NODES
from .shared import SIDE_BY_SIDE, written

_TABLES = {"nodes": NODES, "edges": EDGES, "embeddings": EMBEDDINGS, "metadata": METADATA}
_DEALT_BY = {"nodes": "file_path", "edges": "file_path", "embeddings": "qualified_name", "metadata": None}
_NUMBER = re.compile(r"(\d{12})\.json")

Manifest = dict[str, dict[str, str]]


class ConcurrentWrite(Exception):
    """Another writer committed since this one read."""


def _fit(df: DataFrame, schema) -> DataFrame:
    """``df`` with exactly the schema's columns; missing ones are null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


@dataclass
class GraphStore:
    spark: SparkSession
    path: str
    buckets: int = 32  #: of a new store; an old one keeps its number
    keep: int = 3  #: versions that ``vacuum`` leaves

    # ------------------------------------------------------------ versions

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._fs(folder)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _numbers(self) -> list[int]:
        return sorted((int(m[1]) for n in self._names(f"{self.path}/versions") if (m := _NUMBER.fullmatch(n))), reverse=True)

    def _manifest(self, number: int) -> Manifest | None:
        """None for one that is still being written."""
        fs, p = self._fs(f"{self.path}/versions/{number:012d}.json")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        except ValueError:
            return None
        finally:
            stream.close()

    def _latest(self) -> tuple[int, Manifest]:
        for n in self._numbers():
            if (m := self._manifest(n)) is not None:
                return n, m
        return 0, {}

    def version(self) -> int | None:
        return self._latest()[0] or None

    def _publish(self, number: int, manifest: Manifest) -> int:
        fs, p = self._fs(f"{self.path}/versions/{number:012d}.json")
        try:
            out = fs.create(p, False)
        except Exception as e:  # py4j wraps the file system's FileAlreadyExistsException
            if fs.exists(p):
                raise ConcurrentWrite(f"version {number} of {self.path} is another writer's") from e
            raise
        out.write(json.dumps(manifest).encode())
        out.close()
        return number

    # ------------------------------------------------------------ reading

    def _read(self, name: str, manifest: Manifest, only: set[str] | None = None) -> DataFrame:
        folders = [f"{self.path}/{d}" for b, d in sorted(manifest.get(name, {}).items()) if b != "n" and (only is None or b in only)]
        return self.spark.read.schema(_TABLES[name]).parquet(*folders) if folders else self.spark.createDataFrame([], _TABLES[name])

    def table(self, name: str) -> DataFrame:
        return self._read(name, self._latest()[1])

    def graph(self) -> Graph:
        m = self._latest()[1]
        return Graph(self._read("nodes", m), self._read("edges", m))

    # ------------------------------------------------------------ writing

    def _bucket(self, name: str, n: int) -> Column:
        key = _DEALT_BY[name]
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int") if key else F.lit(0)

    def _write(self, name: str, df: DataFrame, n: int) -> dict[str, str]:
        """Folders of the buckets that have rows."""
        folder = f"data/{name}-{uuid.uuid4().hex}"
        dealt = _fit(df, _TABLES[name]).withColumn("_b", self._bucket(name, n))
        dealt.repartition("_b").write.partitionBy("_b").parquet(f"{self.path}/{folder}")
        return {d.removeprefix("_b="): f"{folder}/{d}" for d in self._names(f"{self.path}/{folder}") if d.startswith("_b=")}

    def commit(self, touched: dict[str, set[str]] | None = None, since: tuple[int, Manifest] | None = None, **tables: DataFrame) -> int:
        """Writes a version in which the named tables are replaced, whole or in their ``touched`` buckets, and all else stays as it was."""
        number, old = since or self._latest()
        n = int(old.get("nodes", {}).get("n", self.buckets))
        new = {name: dict(old.get(name, {})) for name in _TABLES}
        made_of = dict(zip(tables, SIDE_BY_SIDE.map(lambda t: self._write(*t, n), tables.items()), strict=True))
        for name, made in made_of.items():
            gone = (touched or {}).get(name)
            new[name] = {b: d for b, d in new[name].items() if b != "n" and gone is not None and b not in gone} | made
        new["nodes"]["n"] = str(n)
        return self._publish(number + 1, new)

    def _touched(self, name: str, keys: DataFrame, n: int) -> set[str]:
        """At most as many as there are buckets."""
        return {str(r["b"]) for r in keys.select(self._bucket(name, n).alias("b")).distinct().collect()}

    def replace_files(self, new: Graph, paths: DataFrame, metadata: dict[str, str] | None = None) -> int:
        """Everything of the given files goes; the new graph's rows, which are of these files, come. Other files' buckets are neither
        read nor written."""
        since = self._latest()
        n = int(since[1].get("nodes", {}).get("n", self.buckets))
        touched = self._touched("nodes", paths, n)
        old = {name: self._read(name, since[1], touched) for name in ("nodes", "edges")}
        changed = {
            "nodes": dml.replace_files(old["nodes"], _fit(new.nodes, NODES), paths, NODE_KEY),
            "edges": dml.replace_files(old["edges"], _fit(new.edges, EDGES), paths, EDGE_KEY),
        }
        if metadata:
            changed["metadata"] = dml.set_metadata(self._read("metadata", since[1]), metadata)
        return self.commit({"nodes": touched, "edges": touched}, since, **changed)

    def remove_files(self, paths: DataFrame, fixed: bool = False) -> int:
        """Nodes and edges of the files go. Their embeddings stay unless ``fixed``."""
        since = self._latest()
        n = int(since[1].get("nodes", {}).get("n", self.buckets))
        touched = self._touched("nodes", paths, n)
        nodes, edges = (self._read(name, since[1], touched) for name in ("nodes", "edges"))
        changed, of = {"nodes": dml.remove_files(nodes, paths), "edges": dml.remove_files(edges, paths)}, {"nodes": touched, "edges": touched}
        if fixed:
            names = nodes.select("qualified_name").subtract(changed["nodes"].select("qualified_name"))
            of["embeddings"] = self._touched("embeddings", names, n)
            changed["embeddings"] = embed.remove(self._read("embeddings", since[1], of["embeddings"]), names)
        return self.commit(of, since, **changed)

    def metadata(self, key: str) -> str | None:
        row = self.table("metadata").where(F.col("key") == key).first()
        return row["value"] if row else None

    def embed_all(self, backend: embed.Backend) -> int:
        """Embeds what is pending among nodes of files with a File node; returns how many were. Only their buckets are written."""
        since = self._latest()
        m, n = since[1], int(since[1].get("nodes", {}).get("n", self.buckets))
        nodes = embed.embeddable(Graph(self._read("nodes", m), self._read("edges", m)))
        made = written(embed.embed(embed.pending(nodes, self._read("embeddings", m), backend.name), backend), "embedded")  # the model runs once
        if count := made.count():
            touched = self._touched("embeddings", made, n)
            self.commit({"embeddings": touched}, since, embeddings=dml.upsert(self._read("embeddings", m, touched), made, ["qualified_name"]))
        return count

    def clear_embeddings(self) -> int:
        n = self.table("embeddings").count()
        self.commit(embeddings=self.spark.createDataFrame([], EMBEDDINGS))
        return n

    def vacuum(self) -> int:
        """Deletes versions before the latest ``keep`` and folders that the rest do not name; how many folders. Readers of older versions,
        and writers that have not published yet, must be done."""
        numbers = self._numbers()
        manifests = [m for m in map(self._manifest, numbers[: self.keep]) if m]
        used = {d.split("/")[1] for m in manifests for t in m.values() for b, d in t.items() if b != "n"}
        for old in numbers[self.keep :]:
            fs, p = self._fs(f"{self.path}/versions/{old:012d}.json")
            fs.delete(p, False)
        gone = [d for d in self._names(f"{self.path}/data") if d not in used]
        for d in gone:
            fs, p = self._fs(f"{self.path}/data/{d}")
            fs.delete(p, True)
        return len(gone)
