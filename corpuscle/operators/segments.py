"""An index that changes: immutable segments, marks of what they replace, and compaction.

A batch of changes (chunks to put in or to delete) becomes a segment: meta, texts and
postings of the chunks that it puts in, and marks, the keys of all chunks that it
touches.  A row lives unless a later segment marks its key.  Readers see the segments
of the newest version in the log; a version is one small file, written last and only if
it is not there yet, so a batch is whole or not there at all.  The log also holds the
last batch of each stream: a batch that comes again is skipped, and files of a batch
that died before its version are written over.

Chunks whose fields have not changed are left out of a batch, so a write is as large as
the change.  A segment none of whose rows lives is not read.  ``compact`` merges ``fan`` neighbours of about one size, as rows that live
among them; marks stay for as long as there is an older segment.  So segments number
some ``fan`` times the logarithm of the table, and a chunk is written again as often.

Keys are (repo_id, chunk_id), not null.  Of several changes of a key in one batch the
one with the largest ``seq`` counts.  An empty batch writes no segment.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpuscle.sources.scratch import cut, hadoop

from . import search
from .index import BUCKETS, KEY, POSTINGS, Index, digest, in_order, meta_rows, posting_lists, relisted, write_postings

FAN, FEW_MARKS = 4, 1 << 20  # marks that are broadcast
TABLES = ["meta", "texts", "postings", "marks"]


class SegmentIndex(Index):
    """As ``Index``, over segments; ``buckets`` is fixed when the first batch is written."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        super().__init__(spark, folder)
        self.wanted = buckets

    # the log

    def state(self) -> dict:
        """The newest version: its number, buckets, segments from old to new (id, rows, marks, and how many rows live) and the last batch of each stream."""
        at, store = hadoop(self.spark, f"{self.folder}/log")
        names = sorted(f.getPath().getName() for f in store.listStatus(at)) if store.exists(at) else []
        if not names:
            return {"version": 0, "buckets": self.wanted, "segments": [], "batches": {}, "next": 0}
        return json.loads(self.spark.read.text(f"{self.folder}/log/{names[-1]}").first()["value"])

    def commit(self, state: dict, version: int) -> None:
        """Writes the next version; an error if another writer was faster."""
        at, store = hadoop(self.spark, f"{self.folder}/log/{version:012d}")
        out = store.create(at, False)
        try:
            out.write(bytearray(json.dumps(state | {"version": version}).encode()))
        finally:
            out.close()

    def buckets(self) -> int:
        return self.state()["buckets"]

    # reading

    def parts(self, name: str, segments: list[dict], some: list[int] | None = None) -> DataFrame:
        """The rows of a table in the segments, or at some of their places, with the place of their segment."""
        read = self.spark.read.option("basePath", f"{self.folder}/{name}")
        if name == "postings":
            read = read.schema(f"{POSTINGS}, segment int")
        rank = F.create_map(*[F.lit(x) for i, s in enumerate(segments) for x in (s["id"], i)])
        rows = read.parquet(*[f"{self.folder}/{name}/segment={segments[i]['id']}" for i in (range(len(segments)) if some is None else some)])
        return rows.withColumn("__rank", rank[F.col("segment")]).drop("segment")

    def ranked(self, name: str, segments: list[dict]) -> DataFrame:
        """The rows of a table that no later segment marks, with the place of their segment."""
        full = [i for i, s in enumerate(segments) if s["live"]] or [len(segments) - 1]
        rows = self.parts(name, segments, full)
        later = [i for i in range(full[0] + 1, len(segments)) if segments[i]["marks"]]
        if later:
            last = self.parts("marks", segments, later).groupBy(*KEY).agg(F.max("__rank").alias("__last"))
            last = F.broadcast(last) if sum(segments[i]["marks"] for i in later) <= FEW_MARKS else last
            rows = rows.join(last, KEY, "left").where(F.col("__last").isNull() | (F.col("__rank") >= F.col("__last"))).drop("__last")
        return rows

    def living(self, name: str, segments: list[dict]) -> DataFrame:
        """The rows of a table that no later segment marks."""
        return self.ranked(name, segments).drop("__rank")

    def counted(self, segments: list[dict]) -> list[dict]:
        """The segments with the number of their rows that live."""
        lives = {r["__rank"]: r["count"] for r in self.ranked("meta", segments).groupBy("__rank").count().collect()} if segments else {}
        return [s | {"live": lives.get(i, 0)} for i, s in enumerate(segments)]

    def table(self, name: str) -> DataFrame:
        if name == "stats":
            return search.corpus_stats(self.table("meta"))
        return self.living(name, self.state()["segments"])

    # writing

    def apply(self, changes: DataFrame, batch: int | None = None, stream: str = "") -> bool:
        """Takes in a batch: chunks with ``change`` (put, or delete) and ``seq``; False if the stream's batch is in already."""
        state = self.state()
        if batch is not None and batch <= state["batches"].get(stream, -1):
            return False
        fields = [c for c in changes.columns if c not in ("change", "seq")]
        asked = changes.select(*KEY, "change", "seq", digest(fields).alias("digest"))
        last = asked.groupBy(*KEY).agg(F.max(F.struct("seq", "change", "digest")).alias("m"), F.count(F.lit(1)).alias("n")).select(*KEY, "m.*", "n")
        if state["segments"]:
            known = self.living("meta", state["segments"]).select(*KEY, F.col("digest").alias("old"))
            last = last.join(known, KEY, "left")
        else:
            last = last.withColumn("old", F.lit(None).cast("string"))
        # what is new needs no mark, nor what stays as it is
        same = (F.col("change") == "put") & F.col("old").eqNullSafe(F.col("digest"))
        todo = cut(last.withColumns({"puts": (F.col("change") == "put") & ~same, "mark": F.col("old").isNotNull() & ~same}), "todo")
        read, puts, marks = todo.agg(F.sum("n"), F.count_if("puts"), F.count_if("mark")).first()
        after = dict(state, next=state["next"] + 1, batches=state["batches"] | ({stream: batch} if batch is not None else {}))
        if puts or marks:
            put = changes if puts == read else self.chosen(changes, todo.where("puts"), fields)
            put = cut(in_order(put.select(*fields)), "put")  # over tasks however the batch came: all else is made of it
            self.write(state["next"], put, todo.where("mark").select(*KEY), state["buckets"])
            self.drop(put)
            after["segments"] = self.counted([*state["segments"], {"id": state["next"], "rows": puts + marks, "marks": marks, "live": puts}])
        self.drop(todo)
        self.commit(after, state["version"] + 1)
        return True

    def chosen(self, changes: DataFrame, puts: DataFrame, fields: list[str]) -> DataFrame:
        """The rows of a batch that are to be written, each once."""
        these = puts.select(*KEY, *[F.col(c).alias(f"__{c}") for c in ("seq", "change", "digest")])
        rows = changes.withColumn("__d", digest(fields)).join(these, KEY)
        rows = rows.where(F.col("seq").eqNullSafe(F.col("__seq")) & (F.col("change") == F.col("__change")) & (F.col("__d") == F.col("__digest")))
        return rows.dropDuplicates(KEY)

    def drop(self, rows: DataFrame) -> None:
        """Deletes a table that ``cut`` wrote."""
        for file in rows.inputFiles():
            at, store = hadoop(self.spark, file)
            store.delete(at, False)

    def write(self, segment: int, put: DataFrame, marks: DataFrame, buckets: int) -> None:
        """The tables of a segment, from chunks in order."""
        for name in TABLES:  # what a writer left that died before its version
            at, store = hadoop(self.spark, f"{self.folder}/{name}/segment={segment}")
            store.delete(at, True)
        path = {name: f"{self.folder}/{name}/segment={segment}" for name in TABLES}
        put.select(*KEY, "content").write.parquet(path["texts"])
        meta_rows(put).write.parquet(path["meta"])
        marks.write.parquet(path["marks"])
        write_postings(posting_lists(put, buckets), path["postings"])

    def compact(self, fan: int = FAN) -> int:
        """Merges neighbours of about one size until none are left; how many merges there were."""
        merges = 0
        while True:
            state = self.state()
            tier = [int(math.log(max(s["rows"], 1), fan)) for s in state["segments"]]
            at = next((i for i in range(len(tier) - fan + 1) if max(tier[i : i + fan]) == tier[i]), None)
            if at is None:
                return merges
            self.merge(state, at, at + fan)
            merges += 1

    def merge(self, state: dict, first: int, end: int) -> None:
        """Makes one segment of those from ``first`` to before ``end``."""
        some, new = state["segments"][first:end], state["next"]
        path = {name: f"{self.folder}/{name}/segment={new}" for name in TABLES}
        for name in TABLES:
            at, store = hadoop(self.spark, path[name])
            store.delete(at, True)
        for name in ("meta", "texts"):
            self.living(name, some).write.parquet(path[name])
        write_postings(relisted(self.living("postings", some)), path["postings"])
        marks = self.parts("marks", some).select(*KEY).distinct()
        (marks if first else marks.limit(0)).write.parquet(path["marks"])
        live, marks = (self.spark.read.parquet(path[name]).count() for name in ("meta", "marks"))
        segments = [*state["segments"][:first], {"id": new, "rows": live + marks, "marks": marks, "live": live}, *state["segments"][end:]]
        self.commit(state | {"segments": self.counted(segments), "next": new + 1}, state["version"] + 1)

    def vacuum(self) -> None:
        """Deletes the tables of segments that the newest version doesn't name; for when no reader uses an older one."""
        kept = {f"segment={s['id']}" for s in self.state()["segments"]}
        for name in TABLES:
            at, store = hadoop(self.spark, f"{self.folder}/{name}")
            for f in store.listStatus(at) if store.exists(at) else []:
                if f.getPath().getName() not in kept:
                    store.delete(f.getPath(), True)

    def feed(self, changes: DataFrame, checkpoint: str, stream: str = "stream", once: bool = True, every: str = "300 seconds") -> StreamingQuery:
        """Takes in a stream of changes: all there is, or a batch at every interval.  Replayed batches are skipped."""

        def take(rows: DataFrame, batch: int) -> None:
            if self.apply(rows, batch, stream):
                self.compact()

        writer = changes.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
