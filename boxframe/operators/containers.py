"""The tree of nested containers, one level a round: members become rows of their own, which Spark deals out, and rows that are containers are opened next.

A task only lists and reads the members of one archive; what a member is, its size and its hash are told by built-in functions. No
tree is held anywhere, so an archive of archives is as wide as the cluster from its second level on.
"""

from __future__ import annotations

import sys
import zipfile
from collections.abc import Iterator
from io import BytesIO

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.store import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_DEPTH = 8
#: Bytes of members that a task passes on at a time.
BATCH = 8 << 20
# Parts that tell what a package is.
PACKAGES = (("xl/workbook.xml", "xlsx"), ("word/document.xml", "docx"), ("ppt/presentation.xml", "pptx"))
NODE = ["doc_id", "path", "depth", "dialect", "size", "sha256", "member_count", "truncated"]
_MEMBERS = "doc_id long, path string, name string, dialect string, size long, sha256 string, member_count int, content binary"


def magic(content: Column) -> Column:
    """pdf, ole, zip, xml or other, by the first bytes."""
    start = lambda n: F.lower(F.hex(F.substring(content, 1, n)))
    xml = F.decode(F.substring(content, 1, 64), "ISO-8859-1").rlike(r"\A[ \t\n\x0B\f\r]*<\?xml")
    return F.when(start(4) == "25504446", "pdf").when(start(8) == "d0cf11e0a1b11ae1", "ole").when(start(4) == "504b0304", "zip").when(xml, "xml").otherwise("other")


def _looked(may_open: bool):
    """Archives (doc_id, path, size, sha256, content) to a row each, with a null name, and a row for each member of those that are opened."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _MEMBERS.split(", ")]
        rows, held = [], 0
        for b in batches:
            for key, path, size, sha, content in zip(*(b.column(c) for c in ("doc_id", "path", "size", "sha256", "content")), strict=True):
                node = [key.as_py(), path.as_py(), None, "zip", size.as_py(), sha.as_py(), None, None]
                rows.append(node)
                try:
                    z = zipfile.ZipFile(BytesIO(content.as_py()))
                except zipfile.BadZipFile:
                    continue
                listed = z.namelist()
                node[6] = len(listed)
                if "[Content_Types].xml" in listed:
                    node[3] = next((d for part, d in PACKAGES if part in listed), "ooxml")
                    continue
                for name in listed if may_open else ():
                    if name.endswith("/"):
                        continue
                    try:
                        data = z.read(name)
                    except (zipfile.BadZipFile, RuntimeError, NotImplementedError):
                        continue  # a damaged or encrypted member has no node
                    rows.append([node[0], f"{node[1]}/{name}", name, None, None, None, None, data])
                    held += len(data)
                    if held >= BATCH:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)

    schema = pa.schema([("doc_id", pa.int64()), ("path", pa.string()), ("name", pa.string()), ("dialect", pa.string()), ("size", pa.int64()), ("sha256", pa.string()), ("member_count", pa.int32()), ("content", pa.binary())])
    return each


def walk(df: DataFrame, content: str = "content", max_depth: int = MAX_DEPTH) -> DataFrame:
    """doc_id, path ('' for the document), depth, dialect, size, sha256, member_count and truncated of every node; packages are leaves.

    An archive at max_depth is not opened and marked. A null or empty document has no node.
    """
    level = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit("").alias("path"), F.col(content).cast("binary").alias("content")).where(F.octet_length("content") > 0)
    out = None
    for depth in range(max_depth + 1):
        told = level.select("doc_id", "path", magic(F.col("content")).alias("dialect"), F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"), "content")
        null = lambda kind: F.lit(None).cast(kind)
        leaves = told.where("dialect <> 'zip'").select("doc_id", "path", F.lit(depth).alias("depth"), "dialect", "size", "sha256", null("int").alias("member_count"), null("string").alias("truncated"))
        looked = stored(told.where("dialect = 'zip'").select("doc_id", "path", "size", "sha256", "content").mapInArrow(_looked(depth < max_depth), _MEMBERS), "containers")
        cut = F.when(F.lit(depth == max_depth) & (F.col("dialect") == "zip") & F.col("member_count").isNotNull(), F.lit("max depth"))
        nodes = leaves.unionByName(looked.where("name is null").select("doc_id", "path", F.lit(depth).alias("depth"), "dialect", "size", "sha256", "member_count", cut.alias("truncated")))
        out = nodes if out is None else out.unionByName(nodes)
        level = looked.where("name is not null").select("doc_id", "path", "content")
        if level.isEmpty():
            break
    return out.select(NODE)
