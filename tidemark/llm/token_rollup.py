"""Token totals by source, language and tokenizer version, kept by signed changes.

A ledger is a folder. A batch's changes (inserts +1, deletes -1, a revised count as both) are summed for each key and
added to the totals so far; the new totals are written to a folder of their own and become the ledger's by one small
marker file that names the batch and the folder. What was written without its marker counts for nothing, and a batch
that has its marker isn't added again, so every batch counts once, whatever is lost or sent twice in between.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.text_batches import record_batch, slices
from tidemark.llm.vocabulary import library_ids, read_ranks
from tidemark.sources.scratch import written

KEYS = ["source", "lang", "version"]
SUMS = ["docs", "tokens", "chars"]
_COLUMNS = "source string, lang string, version string, docs long, tokens long, chars long"
#: The tokenizer version that counts runs of characters between white space.
WORDS = "words"


def count_tokens(docs: DataFrame, vocabularies: Mapping[str, str], pattern: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """doc_id, text_key, source, lang, version, docs (1), tokens, chars: one row per row of docs and version.

    vocabularies: version -> rank file; the version WORDS is added. text_key is the text's MD5 and null for a null text,
    which counts as empty; null ids, sources and languages stay. Texts are counted whole, however long. Repeated rows
    count again; other columns are left out; an empty table gives an empty result.
    """
    ranks = docs.sparkSession.sparkContext.broadcast({v: read_ranks(p) for v, p in vocabularies.items()})  # vocabulary files: bounded
    versions = [*vocabularies, WORDS]
    keep = [("doc_id", pa.int64()), ("text_key", pa.binary()), ("source", pa.string()), ("lang", pa.string())]
    schema = pa.schema([*keep, ("chars", pa.int64()), *[(f"n{i}", pa.int64()) for i in range(len(versions))]])

    def run(batches):
        for batch in slices(batches):
            texts = batch.column(4)
            listed = [t or "" for t in texts.to_pylist()]
            counts = [[len(i) // 4 for i in library_ids(texts, ranks.value[v], pattern)] for v in versions[:-1]]
            yield record_batch(schema, [*batch.columns[:4], [len(t) for t in listed], *counts, [len(t.split()) for t in listed]])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.md5(text_col)).alias("text_key"), F.col(source_col).alias("source"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    columns = ["doc_id long", "text_key binary", "source string", "lang string", "chars long", *[f"n{i} long" for i in range(len(versions))]]
    wide = rows.mapInArrow(run, ", ".join(columns))
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("version"), F.col(f"n{i}").alias("tokens")) for i, v in enumerate(versions)]))
    long_ = wide.select("doc_id", "text_key", "source", "lang", "chars", each.alias("x"))
    return long_.select("doc_id", "text_key", "source", "lang", "x.version", F.lit(1).cast("long").alias("docs"), "x.tokens", "chars")


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, *SUMS)


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, *[(-F.col(c)).alias(c) for c in SUMS])


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Signed rows that turn the counts `before` into the counts `after`, keys that changed included."""
    return deletes(before).unionByName(inserts(after))


class Ledger:
    """The ledger under `path`, a folder that driver and executors share. One writer at a time; a new object on the same
    folder goes on where the last one stopped."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def commits(self) -> list[dict]:
        """batch, digest and totals folder of each committed batch, in order; one row a batch."""
        folder = self._path("commits")
        fs = self._files(folder)
        if not fs.exists(folder) or not len(fs.listStatus(folder)):
            return []
        rows = self.spark.read.schema("n long, batch string, digest string, totals string").json(f"{self.path}/commits")
        return [r.asDict() for r in rows.orderBy("n").collect()]

    def commit(self, batch: str, *changes: DataFrame) -> bool:
        """Adds a batch's changes to the totals; False if it had been added before, which changes nothing.

        The same id with other changes is refused with a ValueError.
        """
        if not batch.replace("-", "").isalnum():
            raise ValueError("a batch id has letters, digits and - only")
        rows = reduce(DataFrame.unionByName, [c.select(*KEYS, *SUMS) for c in changes])
        change = written(_summed(rows), "batch-changes")
        digest = _digest(change)
        known = self.commits()
        for old in known:
            if old["batch"] == batch:
                if old["digest"] != digest:
                    raise ValueError(f"batch {batch} was committed with other changes")
                return False
        totals = f"totals-{uuid.uuid4().hex}"
        before = self._totals(known)
        _summed(before.unionByName(change)).where(" or ".join(f"{c} <> 0" for c in SUMS)).write.parquet(f"{self.path}/{totals}")
        self._mark(len(known), {"n": len(known), "batch": batch, "digest": digest, "totals": totals})
        return True

    def totals(self) -> DataFrame:
        """source, lang, version, docs, tokens, chars of what all batches leave; keys without documents are left out."""
        return self._totals(self.commits()).where("docs <> 0")

    def _totals(self, commits: list[dict]) -> DataFrame:
        if not commits:
            return self.spark.createDataFrame([], _COLUMNS)
        return self.spark.read.schema(_COLUMNS).parquet(f"{self.path}/{commits[-1]['totals']}")

    def _mark(self, n: int, commit: dict) -> None:
        """One file that is there whole or not at all: written beside its place, then renamed."""
        made, place = self._path(f"marker-{uuid.uuid4().hex}"), self._path(f"commits/{n:09}.json")
        fs = self._files(place)
        if fs.exists(place):
            raise RuntimeError(f"another writer has committed batch number {n}")
        fs.mkdirs(place.getParent())
        out = fs.create(made, False)
        out.write(bytearray(json.dumps(commit).encode() + b"\n"))
        out.close()
        if not fs.rename(made, place):
            raise RuntimeError(f"batch number {n} could not be committed")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _files(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])


def _digest(summed: DataFrame) -> str:
    """The same for the same rows in any order."""
    row = F.xxhash64(*KEYS, *[F.col(c).isNull() for c in KEYS], *SUMS)
    found = summed.agg(F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).alias("s"), F.bit_xor(row).alias("x")).first()
    return f"{found['n']}-{found['s']}-{found['x']}"
