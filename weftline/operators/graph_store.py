"""The graph store: append-only logs, snapshots that merge them, and tables derived from both.

An upsert of one row after another is, over a log, one aggregate a key: what is
set on creation is the value at the smallest order, a counter is a count, "replace
if longer" is the value at the greatest (length, earliest). So an ingest appends,
and only one shuffle a table is needed whatever the number of chunks. Entities are
one by id alone: the first type wins.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as X


def merge_entities(log: DataFrame, order: str = "ord") -> DataFrame:
    """log: id, name, type, description and an order. Returns id, name, type, description, mentions, label."""
    o = F.col(order)
    longest = F.struct(F.length(F.coalesce("description", F.lit(""))).alias("n"), (-o).alias("o")) if dict(log.dtypes)[order] in ("int", "bigint") else None
    best = F.max_by("description", longest) if longest is not None else F.min_by("description", F.struct((-F.length("description")).alias("n"), o.alias("o")))
    merged = log.groupBy("id").agg(F.min_by("name", o).alias("name"), F.min_by("type", o).alias("type"), best.alias("description"), F.count(F.lit(1)).alias("mentions"))
    return merged.withColumn("label", X.label(F.col("type")))


def merge_relations(log: DataFrame, order: str = "ord") -> DataFrame:
    """log: src, tgt, type, description, chunk_id and an order. Returns src, tgt, type, description, weight."""
    return log.where("src <> tgt").groupBy("src", "tgt", "type").agg(F.min_by("description", F.col(order)).alias("description"), F.count(F.lit(1)).alias("weight"))


def relation_chunks(log: DataFrame) -> DataFrame:
    """(src, tgt, type, chunk_id): the chunks of each relation, a row each, since a common relation has any number of them."""
    return log.where("src <> tgt and chunk_id is not null").select("src", "tgt", "type", "chunk_id").distinct()


def first_chunks(log: DataFrame, most: int = 20, order: str = "ord") -> DataFrame:
    """(src, tgt, type, chunks): the first `most` chunks of each relation in their order, for display."""
    firsts = log.where("src <> tgt and chunk_id is not null").groupBy("src", "tgt", "type", "chunk_id").agg(F.min(order).alias("o"))
    at = Window.partitionBy("src", "tgt", "type").orderBy("o", "chunk_id")
    kept = firsts.withColumn("k", F.row_number().over(at)).where(F.col("k") <= most)
    return kept.groupBy("src", "tgt", "type").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunks"))


def resolved(relations: DataFrame, entities: DataFrame, tasks: int | None = None) -> DataFrame:
    """Relations whose two ends exist; where `tasks` is given, they meet their ends in so many tasks."""
    ids = entities.select(F.col("id"))
    deal = lambda df, key: df if tasks is None else df.repartition(tasks, key)
    return deal(deal(relations, "src").join(ids.withColumnRenamed("id", "src"), "src", "left_semi"), "tgt").join(ids.withColumnRenamed("id", "tgt"), "tgt", "left_semi")


def merge_documents(log: DataFrame) -> DataFrame:
    """log: file_hash, filename, pages, chunks, at (time). The last name wins; page and chunk counts are set on creation."""
    n = F.count(F.lit(1))
    return log.groupBy("file_hash").agg(F.max_by("filename", "at").alias("filename"), F.min_by("pages", "at").alias("pages"), F.min_by("chunks", "at").alias("chunks"), F.min("at").alias("created_at"), F.when(n > 1, F.max("at")).alias("updated_at"))


def once_per_run(log: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """The idempotent view of a log into which a document went more than once: one row per chunk and key."""
    rest = [c for c in log.columns if c not in ("chunk_id", *keys, order)]
    return log.groupBy("chunk_id", *keys).agg(F.min_by(F.struct(order, *rest), order).alias("v")).select("chunk_id", *keys, "v.*")


def mentions(log: DataFrame) -> DataFrame:
    return log.select("chunk_id", F.col("id").alias("entity_id")).where("chunk_id is not null").distinct()


def ingest_totals(chunks: DataFrame, entity_log: DataFrame, relation_log: DataFrame) -> DataFrame:
    """Chunks processed, and entities and relations found before chunks are merged: one row."""
    count = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("what"), "n")
    every = count(chunks, "chunks_processed").unionByName(count(entity_log, "entities_found")).unionByName(count(relation_log, "relations_found"))
    return every.groupBy().pivot("what", ["chunks_processed", "entities_found", "relations_found"]).agg(F.first("n"))


_ORD = "struct<at:string,doc_hash:string,i:bigint,pos:bigint>"
LOGS = {
    "entity_log": f"run_id string, ord {_ORD}, chunk_id string, id string, name string, type string, description string",
    "relation_log": f"run_id string, ord {_ORD}, chunk_id string, src string, tgt string, type string, description string",
    "chunks": "id string, doc_hash string, index int, page_start int, page_end int, text string, filename string, at string",
    "documents": "file_hash string, filename string, pages int, chunks int, at timestamp",
}
_RELATION = ["src", "tgt", "type"]


def _longest(ord_col: str) -> Column:
    """Of descriptions: the longest is least, of equally long ones the earliest."""
    return F.struct((-F.length(F.coalesce("description", F.lit("")))).alias("minus"), F.col(ord_col).alias("ord"))


def _firsts(keys: list[str], rest: list[str], order: str = "ord"):
    """Folds rows into one a key: the first in order."""
    return lambda df: df.groupBy(*keys).agg(F.min_by(F.struct(*rest, order), order).alias("v")).select(*keys, "v.*")


#: Accumulators of a run's log that merge in any order: name -> (log, rows of the log as accumulators, fold of accumulators, keys).
ACCUMULATORS: dict[str, tuple[str, Callable[[DataFrame], DataFrame], Callable[[DataFrame], DataFrame], list[str]]] = {
    "entities": (
        "entity_log",
        lambda log: log.select("id", "ord", "name", "type", _longest("ord").alias("rank"), "description", F.lit(1).cast("long").alias("mentions")),
        lambda acc: acc.groupBy("id").agg(F.min("ord").alias("ord"), F.min_by("name", "ord").alias("name"), F.min_by("type", "ord").alias("type"), F.min("rank").alias("rank"), F.min_by("description", "rank").alias("description"), F.sum("mentions").alias("mentions")),
        ["id"],
    ),
    "relations": (
        "relation_log",
        lambda log: log.where("src <> tgt").select(*_RELATION, "ord", "description", F.lit(1).cast("long").alias("weight")),
        lambda acc: acc.groupBy(*_RELATION).agg(F.min("ord").alias("ord"), F.min_by("description", "ord").alias("description"), F.sum("weight").alias("weight")),
        _RELATION,
    ),
    # a row per chunk and key, of which the idempotent view and the links to chunks are made
    "mentions": ("entity_log", lambda log: log.select("chunk_id", "id", "name", "type", "description", "ord"), _firsts(["chunk_id", "id"], ["name", "type", "description"]), ["id"]),
    "relation_chunks": ("relation_log", lambda log: log.select("chunk_id", *_RELATION, "description", "ord"), _firsts(["chunk_id", *_RELATION], ["description"]), _RELATION),
    # a chunk is set on creation: that of the first run that has it stays
    "chunks": ("chunks", lambda log: log, lambda acc: acc.groupBy("id").agg(F.min_by(F.struct(*[c for c in acc.columns if c != "id"]), F.struct("at", "text")).alias("v")).select("id", "v.*"), ["id"]),
    "documents": (
        "documents",
        lambda log: log.select("file_hash", "filename", "pages", "chunks", F.col("at").alias("first"), F.col("at").alias("last"), F.lit(1).cast("long").alias("runs")),
        lambda acc: acc.groupBy("file_hash").agg(F.max_by("filename", "last").alias("filename"), F.min_by("pages", "first").alias("pages"), F.min_by("chunks", "first").alias("chunks"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("runs").alias("runs")),
        ["file_hash"],
    ),
}
#: So many runs, and so many snapshots of a level, are merged into one of the next.
FAN = 8


def fold_entities(accumulators: DataFrame) -> DataFrame:
    """Accumulators of an entity log, folded in part or not at all: what merge_entities() makes of the log itself."""
    folded = ACCUMULATORS["entities"][2](accumulators)
    return folded.select("id", "name", "type", "description", "mentions").withColumn("label", X.label(F.col("type")))


class GraphStore:
    """The tables of a graph in a folder: logs of runs and merged snapshots as Parquet, everything else derived.

    Each run writes folders of its own, and last a mark that it is whole; readers take
    whole runs only. A run that failed in between is invisible, and run again under its
    id it writes over its own folders, so nothing is counted twice.

    Every `fan` runs become a snapshot of accumulators (first names and types, longest
    descriptions, counts, first chunks), dealt by key; every `fan` snapshots of a level
    become one of the next, so a read opens less than `fan` runs and `fan` snapshots a
    level whatever the number of ingests. What counts is the latest manifest, a small
    file that is put in place by one rename: until then the merged runs count, from then
    on the snapshot does, and what it replaces is deleted later.
    """

    def __init__(self, spark, folder: str, *, fan: int = FAN):
        self.spark, self.folder, self.fan = spark, folder.rstrip("/"), fan

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, name: str) -> list[str]:
        """What lies in a folder of the store; nothing if there is none."""
        path, fs = self._fs(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _delete(self, name: str) -> None:
        path, fs = self._fs(name)
        fs.delete(path, True)

    def _manifest(self) -> dict:
        """The latest manifest: snapshots by level, runs that they hold though their marks may still lie there, and folders to delete."""
        found = [n for n in self._names("manifest") if n.endswith(".json")]
        if not found:
            return {"version": 0, "levels": [], "held": [], "old": []}
        path, fs = self._fs(f"manifest/{found[-1]}")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _put(self, manifest: dict) -> None:
        """Put a manifest in the place of that of the version before; of two writers one fails."""
        version = manifest["version"]
        path, fs = self._fs(f"manifest/{version:012d}.tmp")
        stream = fs.create(path, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        if not fs.rename(path, self._fs(f"manifest/{version:012d}.json")[0]):
            raise RuntimeError(f"manifest {version} is there already: another writer was first")
        for name in self._names("manifest"):
            if name.endswith(".json") and int(name[:12]) < version - 1:
                self._delete(f"manifest/{name}")

    def _open(self) -> tuple[dict, list[str]]:
        """The manifest, and the whole runs that no snapshot holds."""
        manifest = self._manifest()
        return manifest, [r for r in self._names("whole") if r not in set(manifest["held"])]

    def _logs(self, name: str, runs: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.folder}/{name}/{r}" for r in runs]) if runs else self.spark.createDataFrame([], LOGS[name])

    def _parts(self, name: str) -> DataFrame:
        """A table's accumulators of all snapshots and open runs, not folded."""
        manifest, runs = self._open()
        log, lift, _, _ = ACCUMULATORS[name]
        out, snaps = lift(self._logs(log, runs)), [s for level in manifest["levels"] for s in level]
        return out.unionByName(self.spark.read.schema(out.schema).parquet(*[f"{self.folder}/snapshots/{s}/{name}" for s in snaps])) if snaps else out

    def _knows(self, run_id: str) -> bool:
        manifest, runs = self._open()
        snaps = [s for level in manifest["levels"] for s in level]
        if run_id in runs or run_id in manifest["held"]:
            return True
        return bool(snaps) and self.spark.read.parquet(*[f"{self.folder}/snapshots/{s}/runs" for s in snaps]).where(F.col("run_id") == run_id).limit(1).count() > 0

    def ingest(self, chunks: DataFrame, extractor=None, *, run_id: str, at: str, force: bool = False, progress: Callable[[int, int, str], None] | None = None) -> dict:
        """Add the chunks of documents that are not in the store yet (or of all, if forced) and what is extracted from them.

        `progress(done, total, message)` is called from the driver while chunks are extracted. A
        run id that the store holds already changes nothing.
        """
        from weftline.sources import extraction
        from weftline.sources.pages import not_yet_known

        if self._knows(run_id):
            return {"chunks_processed": 0, "entities_found": 0, "relations_found": 0}
        new = chunks if force else not_yet_known(chunks.withColumnRenamed("doc_hash", "file_hash"), self._parts("documents")).withColumnRenamed("file_hash", "doc_hash")
        write = lambda df, name: df.write.mode("overwrite").parquet(f"{self.folder}/{name}/{run_id}")
        write(new.withColumn("at", F.lit(at)), "chunks")
        new = self.spark.read.parquet(f"{self.folder}/chunks/{run_id}")
        with _watched(self.spark, new.count() if progress else 0, progress) as seen:
            write(extraction.extract(new.select("id", "text"), extractor or extraction.OfflineExtractor, seen), "staged")  # extraction is not to run twice
        entities, relations = extraction.clean(self.spark.read.parquet(f"{self.folder}/staged/{run_id}"))
        place = new.select(F.col("id").alias("chunk_id"), "doc_hash", F.col("index").cast("long").alias("i"))
        ordered = lambda df: df.join(place, "chunk_id").select(F.lit(run_id).alias("run_id"), F.struct(F.lit(at).alias("at"), "doc_hash", "i", F.col("pos").cast("long").alias("pos")).alias("ord"), *[c for c in df.columns if c != "pos"])
        write(ordered(entities), "entity_log")
        write(ordered(relations), "relation_log")
        docs = new.groupBy("doc_hash").agg(F.min("filename").alias("filename"), F.max("page_end").alias("pages"), F.count(F.lit(1)).cast("int").alias("chunks"))
        write(docs.select(F.col("doc_hash").alias("file_hash"), "filename", "pages", "chunks", F.lit(at).cast("timestamp").alias("at")), "documents")
        write(self.spark.range(1), "whole")
        self._delete(f"staged/{run_id}")
        read = lambda name: self.spark.read.parquet(f"{self.folder}/{name}/{run_id}")
        told = ingest_totals(new, read("entity_log"), read("relation_log")).first().asDict()
        self.compact()
        return told

    def _snapshot(self, made: Callable[[str], DataFrame], runs: DataFrame) -> str:
        """Write folded accumulators; returns the snapshot's name. Nothing reads it before a manifest names it."""
        snap = uuid.uuid4().hex
        for name, (_, _, fold, keys) in ACCUMULATORS.items():
            fold(made(name)).repartition(*keys).write.parquet(f"{self.folder}/snapshots/{snap}/{name}")
        runs.write.parquet(f"{self.folder}/snapshots/{snap}/runs")
        return snap

    def compact(self, *, least: int | None = None) -> None:
        """Merge runs, then levels, wherever there are `fan` of them (`least` of them, if given). May be broken off anywhere and called again."""
        least = self.fan if least is None else least
        manifest, runs = self._open()
        for name in manifest["old"]:  # of the compaction before: who reads by now knows the manifest after it
            self._delete(name)
        marks = set(self._names("whole"))
        left = [r for r in manifest["held"] if r in marks]
        for r in left:
            self._drop_run(r)
        if len(runs) >= least > 0:
            snap = self._snapshot(lambda name: ACCUMULATORS[name][1](self._logs(ACCUMULATORS[name][0], runs)), self.spark.createDataFrame([(r,) for r in runs], "run_id string"))
            levels = manifest["levels"] or [[]]
            manifest = {"version": manifest["version"] + 1, "levels": [[*levels[0], snap], *levels[1:]], "held": runs, "old": []}
            self._put(manifest)
            for r in runs:
                self._drop_run(r)
        at = 0
        while at < len(manifest["levels"]):
            snaps = manifest["levels"][at]
            if len(snaps) >= max(2, least):
                read = lambda name, snaps=snaps: self.spark.read.parquet(*[f"{self.folder}/snapshots/{s}/{name}" for s in snaps])
                snap = self._snapshot(read, read("runs"))
                levels = [*manifest["levels"], []] if at + 1 == len(manifest["levels"]) else manifest["levels"]
                levels = [[] if i == at else [*level, snap] if i == at + 1 else level for i, level in enumerate(levels)]
                manifest = {"version": manifest["version"] + 1, "levels": levels, "held": manifest["held"], "old": [*manifest["old"], *[f"snapshots/{s}" for s in snaps]]}
                self._put(manifest)
            at += 1

    def _drop_run(self, run_id: str) -> None:
        for name in LOGS:
            self._delete(f"{name}/{run_id}")
        self._delete(f"whole/{run_id}")  # last: a mark without logs is only met where the manifest holds its run

    def tables(self, *, idempotent: bool = False) -> dict[str, DataFrame]:
        folded = {name: fold(self._parts(name)) for name, (_, _, fold, _) in ACCUMULATORS.items()}
        of_chunks, of_relations = folded["mentions"], folded["relation_chunks"]
        if idempotent:
            again = lambda name, rows: ACCUMULATORS[name][2](ACCUMULATORS[name][1](rows))
            folded["entities"], folded["relations"] = again("entities", of_chunks), again("relations", of_relations)
        entities = folded["entities"].select("id", "name", "type", "description", "mentions").withColumn("label", X.label(F.col("type")))
        d = folded["documents"]
        return {
            "documents": d.select("file_hash", "filename", "pages", "chunks", F.col("first").alias("created_at"), F.when(F.col("runs") > 1, F.col("last")).alias("updated_at")),
            "chunks": folded["chunks"].drop("at"), "entities": entities, "mentions": mentions(of_chunks),
            "relations": resolved(folded["relations"].select(*_RELATION, "description", "weight"), entities), "relation_chunks": relation_chunks(of_relations),
        }

    def exists(self, file_hash: str) -> bool:
        return self._parts("documents").where(F.col("file_hash") == file_hash).limit(1).count() > 0

    def clear(self) -> int:
        """Empty the store; returns how many documents, chunks and entities there were."""
        manifest, runs = self._open()
        if not runs and not any(manifest["levels"]):
            return 0
        t = self.tables()
        n = t["documents"].count() + t["chunks"].count() + t["entities"].count()
        self._delete("whole")  # the marks first, then the manifest: what is left of a broken clearing is invisible
        self._put({"version": manifest["version"] + 1, "levels": [], "held": [], "old": []})
        for name in ("snapshots", "staged", *LOGS):
            self._delete(name)
        return n


@contextmanager
def _watched(spark, total: int, progress: Callable[[int, int, str], None] | None):
    """An accumulator of chunks that are done, told to `progress` as tasks end; None without it."""
    if progress is None:
        yield None
        return
    seen, ended = spark.sparkContext.accumulator(0), threading.Event()
    progress(0, total, "extracting")

    def tell():
        last = 0
        while not ended.wait(0.2):
            if seen.value != last:
                last = seen.value
                progress(min(last, total), total, "extracting")

    thread = threading.Thread(target=tell, daemon=True)
    thread.start()
    try:
        yield seen
    finally:
        ended.set()
        thread.join()
    progress(total, total, "extracted")
