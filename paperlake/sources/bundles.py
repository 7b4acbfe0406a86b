"""Paper bundles: single files, folders and archives, read as one row a file, then as one row a paper.

Archives are unpacked in memory from their bytes, never to a disk; unsafe names (absolute, or climbing out) are reported, not read.
"""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperlake.functions import columns

ARCHIVES = r"\.(gz|tgz|zip)$"
FILES = "paper_id string, rel_path string, content binary, error string"
#: Windows-1252 differs from Latin-1 in these characters.
_OWN = bytes(b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
_CP1252 = (_OWN.decode("latin-1"), _OWN.decode("cp1252"))
#: Largest size that an unpacked archive may have, in bytes.
MOST_BYTES = 512 << 20


def unsafe(name: str) -> bool:
    return name.startswith(("/", "\\")) or ".." in name or ":" in name


def unpack(name: str, content: bytes) -> Iterator[tuple[str, bytes | None, str | None]]:
    """(name, content, error) of each file in an archive."""
    try:
        if name.endswith(".zip"):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for i in z.infolist():
                    if not i.is_dir():
                        yield (i.filename, None, "unsafe name") if unsafe(i.filename) else (i.filename, None, "too large") if i.file_size > MOST_BYTES else (i.filename, z.read(i), None)
            return
        try:
            with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as t:
                for m in t:
                    if m.isfile():
                        yield (m.name, None, "unsafe name") if unsafe(m.name) else (m.name, None, "too large") if m.size > MOST_BYTES else (m.name, t.extractfile(m).read(), None)
            return
        except tarfile.TarError:
            pass
        if name.endswith((".tar.gz", ".tgz", ".gz")):
            with gzip.open(io.BytesIO(content)) as g:
                text = g.read(MOST_BYTES + 1)
            if len(text) > MOST_BYTES:
                yield name, None, "too large"
                return
            base = name.rpartition("/")[2].removesuffix(".gz")
            base = base if base.endswith(".tex") else base + ".tex"
            main = b"\\documentclass" in text or b"\\begin{document}" in text
            yield (base, text, None) if main else (base, None, "not a main file")
            return
        yield name, None, "unsupported type"
    except (OSError, EOFError, ValueError, RuntimeError, zipfile.BadZipFile) as e:
        yield name, None, f"{type(e).__name__}: {e}"


def read(spark: SparkSession, path: str) -> DataFrame:
    """FILES rows of every bundle under a path: archives are papers, folders of files are papers, a lone file at the top is one too."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return explode(found, path)


def explode(found: DataFrame, root: str = "") -> DataFrame:
    """FILES rows of binaryFile rows (path, content); works for streams too."""
    tail = F.regexp_replace("path", r"^\w+:/*", "/")
    inside = F.regexp_replace(tail, "^" + root.split(":")[-1].rstrip("/").replace(".", r"\."), "") if root else tail
    rows = found.select(F.regexp_replace(inside, "^/", "").alias("path"), "content")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if path.endswith((".gz", ".tgz", ".zip")):
                    held = [(path, *f) for f in unpack(path, content or b"")]
                else:
                    folder, _, name = path.partition("/")
                    held = [(folder, name, content, None) if name else (path, path, content, None)]
                for r in held:
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(r, (pa.string(), pa.string(), pa.binary(), pa.string()), strict=True)], names=["paper_id", "rel_path", "content", "error"])

    return rows.mapInArrow(make, FILES)


def decode(files: DataFrame) -> DataFrame:
    """Adds text and encoding: UTF-16 or UTF-32 where a byte order mark says so, UTF-8 where the bytes are valid, else Windows-1252 where only its bytes occur, else Latin-1."""
    raw = F.col("content")
    begin = F.hex(F.substring(raw, 1, 4))
    wide = F.when(begin.isin("FFFE0000", "0000FEFF"), "utf-32").when(begin.rlike("^(?:FFFE|FEFF)"), "utf-16")
    odd = F.hex(raw).rlike("^(?:..)*?(?:81|8D|8F|90|9D)")
    encoding = F.when(wide.isNotNull(), wide).when(F.is_valid_utf8(raw.cast("string")), "utf-8").when(odd, "latin-1").otherwise("cp1252")
    text = F.when(F.col("encoding") == "utf-16", F.decode(raw, "UTF-16")).when(F.col("encoding") == "utf-32", F.decode(raw, "UTF-32")).when(F.col("encoding") == "utf-8", F.decode(raw, "UTF-8")).when(F.col("encoding") == "latin-1", F.decode(raw, "ISO-8859-1")).otherwise(F.translate(F.decode(raw, "ISO-8859-1"), *_CP1252))
    return files.withColumn("encoding", encoding).withColumn("text", F.regexp_replace(text, "^\ufeff", ""))


def main_files(files: DataFrame) -> DataFrame:
    """The main file of each paper: of those with a class or a document, one with a class first, then the least deep, then by name."""
    marked = files.filter(F.col("rel_path").rlike(r"(?i)\.(tex|ltx)$") & columns.is_main_file(F.col("text")))
    order = [(~columns.strip_comments(F.col("text")).contains("\\documentclass")), F.size(F.split("rel_path", "/")), F.col("rel_path")]
    w = Window.partitionBy("paper_id").orderBy(*order)
    return marked.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def papers(files: DataFrame) -> DataFrame:
    """paper_id, main_path, text, files: a row a paper with its main text and a map of all its texts by path (as written and relative to the main file).

    A paper's files are brought together on its id: the paper is the unit that the kernel reads, as macros carry over from file to file. They are dealt once, to as
    many partitions as the session's shuffle width, which are not put together by size: the kernel takes a second a megabyte.
    """
    files = files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "paper_id")
    main = main_files(files).select("paper_id", F.col("rel_path").alias("main_path"), "text")
    texts = files.filter("text IS NOT NULL").groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("rel_path", F.col("text").alias("t")))).alias("all"))
    joined = main.join(texts, "paper_id")
    folder = F.regexp_replace("main_path", "[^/]*$", "")
    relative = F.transform("all", lambda x: F.struct(F.when(F.startswith(x["rel_path"], folder), F.substr(x["rel_path"], F.length(folder) + 1)).otherwise(x["rel_path"]).alias("k"), x["t"].alias("v")))
    named = F.map_from_entries(F.filter(relative, lambda x: x["k"] != ""))
    return joined.select("paper_id", "main_path", "text", named.alias("files"))


def include_edges(files: DataFrame) -> DataFrame:
    """paper_id, rel_path, target: which file includes which, the target found as written or with .tex."""
    edges = files.select("paper_id", "rel_path", F.explode(columns.includes(columns.strip_comments(F.col("text")))).alias("named"))
    known = files.select("paper_id", F.col("rel_path").alias("target"))
    both = edges.withColumn("as_is", F.col("named")).withColumn("with_ext", F.concat("named", F.lit(".tex")))
    exact = both.join(known, (both.paper_id == known.paper_id) & (known.target == F.col("as_is")), "left").select(both["*"], known.target.alias("t1"))
    known2 = known.withColumnRenamed("paper_id", "p2").withColumnRenamed("target", "t2")
    return exact.join(known2, (F.col("paper_id") == F.col("p2")) & (F.col("with_ext") == F.col("t2")), "left").select("paper_id", "rel_path", "named", F.coalesce("t1", "t2").alias("target"))


def reachable(files: DataFrame) -> DataFrame:
    """paper_id, rel_path, depth: files that a paper's main file includes, directly or not, however deep; a cycle is entered once. depth is the shortest way.

    A paper's edges are few and belong together: they are followed where they are brought together, breadth first.
    """
    edges = include_edges(files).filter("target IS NOT NULL").groupBy("paper_id").agg(F.collect_set(F.struct("rel_path", "target")).alias("edges"))
    rows = main_files(files).select("paper_id", "rel_path").join(edges, "paper_id", "left").select(F.col("paper_id").cast("string").alias("paper_id"), "rel_path", "edges")

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], []]
            for paper, main, found in zip(*[c.to_pylist() for c in b.columns], strict=True):
                next_of: dict[str, list[str]] = {}
                for e in found or []:
                    next_of.setdefault(e["rel_path"], []).append(e["target"])
                depth, queue = {main: 0}, [main]
                for path in queue:
                    for t in sorted(next_of.get(path, [])):
                        if t not in depth:
                            depth[t] = depth[path] + 1
                            queue.append(t)
                for path, d in depth.items():
                    for c, v in zip(out, (paper, path, d), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], names=["paper_id", "rel_path", "depth"])

    kind = files.schema["paper_id"].dataType
    return rows.mapInArrow(follow, "paper_id string, rel_path string, depth long").withColumn("paper_id", F.col("paper_id").cast(kind))


def write_json(documents: DataFrame, path: str) -> None:
    """One JSON object a line with its paper's id, compressed, in as many files as there are partitions."""
    documents.write.mode("overwrite").option("compression", "gzip").json(path)
