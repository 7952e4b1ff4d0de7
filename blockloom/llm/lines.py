"""Removal of lines that other documents hold as well, by hashes of normalised lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from .common import batch, scratch, set_aside, stored

#: Code points that a key has at least, and documents that may hold it before all but the first lose it.
LEAST, MOST = 10, 1
#: Lines that are handed on together.
LINES = 1 << 16


def normalised(text: bytes) -> list[bytes]:
    """The key of each line: ASCII white space stripped at both ends, A-Z lower-cased. An empty text is one empty line."""
    return [x.strip() for x in text.lower().split(b"\n")]


def counted(text: bytes, least: int) -> dict[bytes, int]:
    """The distinct keys of a text of so many code points and more, numbered by their first lines."""
    own = dict.fromkeys(x for x in normalised(text) if len(x) >= 4 * least or (len(x) >= least and len(x.decode("utf-8", "replace")) >= least))
    return {key: k for k, key in enumerate(own)}


def halves(hashes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes as two numbers each."""
    both = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def document_hash(doc_id, text: bytes) -> bytes:
    """Documents of the same id and text lose the same lines."""
    return xxhash.xxh3_128_digest(xxhash.xxh3_128_digest(text) + repr(doc_id).encode())


def each_document(b: pa.RecordBatch) -> Iterator[tuple[object, bytes]]:
    """Id and text of a batch's rows; a null text is empty."""
    for doc_id, text in zip(b.column("doc_id"), b.column("text")):
        yield doc_id.as_py(), text.as_py() or b""


def exploded(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, d1, d2, k, h1, h2): a row for each document and distinct key, k its number within the text."""
    kind: DataType = docs.schema["doc_id"].dataType

    def run(batches):
        for b in batches:
            at, hashes, numbers, owners = [], [], [], []

            def full(b=b, at=at, hashes=hashes, numbers=numbers, owners=owners):
                d, h = halves(owners), halves(hashes)
                out = pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int64())), *map(pa.array, d), pa.array(numbers, pa.int32()), *map(pa.array, h)], names=["doc_id", "d1", "d2", "k", "h1", "h2"])
                for some in (at, hashes, numbers, owners):
                    some.clear()
                return out

            for n, (doc_id, text) in enumerate(each_document(b)):
                own = document_hash(doc_id, text)
                for key, k in counted(text, least).items():
                    at.append(n)
                    owners.append(own)
                    numbers.append(k)
                    hashes.append(xxhash.xxh3_128_digest(key))
                    if len(at) == LINES:
                        yield full()
            yield full()

    binary = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return binary.mapInArrow(run, f"doc_id {kind.simpleString()}, d1 long, d2 long, k int, h1 long, h2 long")


def repeated(lines: DataFrame, most: int) -> DataFrame:
    """(h1, h2, holder): the keys that more documents hold than may, and the smallest doc_id of these.

    Each key's documents are counted by their distinct ids, in two steps, so that a key that all documents hold is no
    more than a row per task.
    """
    null = F.max(F.col("doc_id").isNull().cast("int"))
    return lines.groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("n"), null.alias("null"), F.min("doc_id").alias("holder")).where(F.col("n") + F.col("null") > most).select("h1", "h2", "holder")


KEPT = pa.schema([("text", pa.binary()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])


def without(text: bytes, dropped: set[int], least: int) -> tuple[bytes, int, int]:
    """A text without the lines whose keys have these numbers, its lines before, and how many went."""
    lines = text.split(b"\n")
    if not dropped:
        return text, len(lines), 0
    number = counted(text, least)
    kept = [line for line, key in zip(lines, normalised(text)) if number.get(key, -1) not in dropped]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def deduplicated(docs: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """docs with repeated lines dropped from text; _n_lines and _n_dropped count a text's lines before, and those that went.

    A line's key is the line with ASCII white space stripped at both ends and A-Z lower-cased. Keys of at least so many
    code points that more than so many documents hold lose all their lines, except in the smallest doc_id that holds
    them. Other lines stay as they are, in their order, joined by line feeds.

    Lines are exploded to hashes of 128 bits, once per document and key; keys of different texts share one by chance
    only (n keys: below n^2 / 2^129). Texts meet the numbers of their dropped keys by a hash of id and text, so rows are
    never told apart by where they lie, and a task that runs again finds the same.

    A null text is empty, and an empty text is one empty line. Documents are told apart by doc_id: rows of the same id
    are one document, and null ids are one, which comes after all others. A text of any length is one row, its lines are
    numbered within it. Repeated rows stay repeated. An empty table gives an empty result. Other columns come along
    whatever their names; of clashing names, the two new ones get as many underscores as make them others.
    """
    aside = set_aside(docs, "doc_id", "text")
    # both are written: a join splits a hot key only where its sides come straight from a shuffle, not from a grouping
    with scratch() as keep:
        held = stored(repeated(exploded(docs, least), most), "held")
        met = exploded(docs, least).join(held, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("holder")))
        dropped = keep(stored(met.groupBy("d1", "d2").agg(F.collect_set("k").alias("_dropped")), "dropped"))

    def named(batches):
        for b in batches:
            d1, d2 = halves([document_hash(*x) for x in each_document(b)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(d1), pa.array(d2)], names=[*b.schema.names, "d1", "d2"])

    carried = [c for c in aside.columns if c != "text"]
    shape = ", ".join(f"`{c}` {aside.schema[c].dataType.simpleString()}" for c in carried)
    own = aside.select(*carried, F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")).mapInArrow(named, f"{shape}, text binary, d1 long, d2 long")
    both = own.join(dropped, ["d1", "d2"], "left").select(*carried, "text", "_dropped")

    def cut(batches):
        for b in batches:
            done = [without(text or b"", set(gone or ()), least) for text, gone in zip((x.as_py() for x in b.column("text")), (x.as_py() for x in b.column("_dropped")))]
            new = batch(KEPT, **dict(zip(KEPT.names, zip(*done) if done else ([], [], []))))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carried), *new.columns], names=[*carried, *new.schema.names])

    out = both.mapInArrow(cut, f"{shape}, text binary, n_lines long, n_dropped long").withColumn("text", F.col("text").cast("string"))
    names = []
    for name in ("_n_lines", "_n_dropped"):
        while name.lower() in {c.lower() for c in docs.columns}:
            name += "_"
        names.append(name)
    return out.select(*aside.columns, "n_lines", "n_dropped").toDF(*docs.columns, *names)


def op12_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    found = deduplicated(docs.select("doc_id", "text"))
    return found.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM d
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), h AS (
  SELECT key, min(doc_id) AS holder FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) > 1
), m AS (
  SELECT k.*, h.key IS NOT NULL AND k.doc_id IS DISTINCT FROM h.holder AS gone FROM k LEFT JOIN h ON h.key = k.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""
