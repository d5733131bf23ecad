"""From files to a searchable collection, and the facade over all operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talefold.config import EngineConfig, check_steps, pool_size
from talefold.functions.chunk import chunked
from talefold.functions.text import prefixed
from talefold.models import Models
from talefold.operators import collection, enrich, evaluate, metadata, retrieve
from talefold.plans import loop
from talefold.sources import files, sinks


def collection_rows(stories: DataFrame, cfg: EngineConfig = EngineConfig(), version: int = 0) -> DataFrame:
    """Chunks of stories (title, text) as rows of a collection."""
    rows = chunked(stories.select("title", "text"), "title", "text", cfg.max_chars, cfg.overlap_chars, cfg.least_words)
    entries = F.create_map(*[x for k, v in (("Title", F.col("title")), ("query_type", F.lit("content")), ("chunk_id", F.col("chunk_id"))) for x in (F.lit(k), v)])
    return rows.select(F.col("chunk_id").alias("id"), F.col("chunk").alias("document"), metadata.without_nulls(entries).alias("metadata"), F.lit(version).cast("bigint").alias("version"))


class Engine:
    """All public operations over one collection."""

    def __init__(self, spark: SparkSession, cfg: EngineConfig = EngineConfig(), models: Models = Models()):
        self.spark, self.cfg, self.models = spark, cfg, models
        self.collections = collection.Collections(spark, cfg.collection_path, cfg.collection, lambda text: models.embed(prefixed(text, cfg.embed_model)))

    @property
    def collection(self) -> collection.Collection:
        return self.collections.active

    def ingest_stories(self, folder: str, drop_stale: bool = False) -> int:
        """Chunk and upsert the stories of a folder; with drop_stale, chunks a shorter story no longer has go."""
        return self._ingest(files.stories(self.spark, folder), drop_stale)

    def _ingest(self, stories: DataFrame, drop_stale: bool = False) -> int:
        rows = collection_rows(stories, self.cfg, self.collection.version() + 1)
        if drop_stale:
            title = F.try_element_at("metadata", F.lit("Title"))
            gone = self.collection.read().join(rows.select(title.alias("t")).distinct(), title == F.col("t"), "left_semi").join(rows.select("id"), "id", "left_anti")
            self.collection.delete(gone.select("id"))
        return self.collection.upsert(rows)

    def ingest_manifest(self, path: str) -> int:
        """Upsert manifest rows; of equal ids the last row of the last file (by name) counts, written in cfg.upsert_groups groups of ids."""
        rows = files.manifest(self.spark, path)
        entries = F.map_filter(F.from_json(F.to_json("metadata"), "map<string,string>"), lambda k, v: v.isNotNull())
        rows = rows.select(F.col("chunk_id").alias("id"), F.col("text").alias("document"), entries.alias("metadata"), F.struct(F.col("file"), F.col("line")).alias("place"))
        last = rows.groupBy("id").agg(F.max_by(F.struct("document", "metadata"), "place").alias("r"))
        version = self.collection.version() + 1
        return self.collection.upsert(last.select("id", "r.document", "r.metadata", F.lit(version).cast("bigint").alias("version")), self.cfg.upsert_groups)

    def prepare(self, folder: str, records: str, template: str | None = None) -> DataFrame:
        """Records of the stories of a folder that have none yet, with the template's values; written to `records`."""
        raw = files.template(template)[0] if template else {}
        have = files.records(self.spark, records).select(F.col("meta.title").alias("title")) if files.exists(self.spark, records) else None
        sinks.write_records(metadata.story_records(files.stories(self.spark, folder), raw, have), records)
        return files.records(self.spark, records)

    def enrich(self, records: DataFrame) -> DataFrame:
        """Manifest rows of records, each chunk with its label and each record with its summary."""
        rows = metadata.manifest(records.withColumn("summary", F.when(F.length("summary") > 0, F.col("summary")).otherwise(self.models.summarise(F.col("raw_text")))))
        keyed = rows.withColumn("chunk_no", F.regexp_extract("id", r"_chunk_(\d+)\z", 1).try_cast("int")).withColumn("story", F.col("metadata.Title"))
        counted = keyed.withColumn("n", F.count("*").over(Window.partitionBy("story")))
        named = counted.withColumn("label", self.models.label(F.col("chunk_no"), F.col("n")))
        tagged = enrich.labelled(named, "story", "chunk_no", "label")
        return tagged.select("id", "text", F.col("metadata").withField("section", F.col("section")).alias("metadata"))

    def run(self, steps: list[str], folder: str, work: str | None = None, template: str | None = None) -> dict[str, str]:
        """Named steps in order; unknown ones are an error before anything runs.

        fetch and extract read book files of `folder` as stories into `work`;
        prepare makes records of stories, enrich labels them, reset empties the
        collection, ingest upserts what the steps before it made (else the
        stories of `folder`). A step that needs `work` and has none is skipped.
        """
        done: dict[str, str] = {}
        stories, records, rows = None, None, None
        for step in check_steps(steps):
            done[step] = "done"
            if step == "reset":
                self.collection.reset()
            elif step in ("fetch", "extract") and work:
                if step == "extract":
                    read = files.books(self.spark, folder)
                    sinks.write_texts(read.where("error is null"), f"{work}/texts")
                    stories = self.spark.read.parquet(f"{work}/texts").select(F.regexp_replace("name", r"\.[^.]+\z", "").alias("title"), "text")
                else:
                    done[step] = f"{files.books(self.spark, folder).count()} files"
            elif step == "prepare" and work:
                raw = files.template(template)[0] if template else {}
                records = metadata.story_records(stories if stories is not None else files.stories(self.spark, folder), raw)
            elif step == "enrich" and records is not None:
                rows = self.enrich(records)
            elif step == "ingest" and rows is not None:
                entries = F.map_filter(F.from_json(F.to_json("metadata"), "map<string,string>"), lambda k, v: v.isNotNull())
                self.collection.upsert(rows.select("id", F.col("text").alias("document"), entries.alias("metadata"), F.lit(self.collection.version() + 1).cast("bigint").alias("version")))
            elif step == "ingest":
                self._ingest(stories if stories is not None else files.stories(self.spark, folder))
            else:
                done[step] = "skipped"
        return done

    def corpus(self) -> DataFrame:
        """What searches compare with: documents with the vectors they were stored with."""
        rows = self.collection.content().where("embedding is not null")
        return rows.select("id", F.col("document").alias("text"), F.try_element_at("metadata", F.lit("Title")).alias("title"), "embedding")

    def query(self, queries: DataFrame, k: int | None = None, where: dict | None = None) -> DataFrame:
        """Hybrid retrieval for queries (query_id, query), ordered again by the pair scorer where one is set; `where` names metadata."""
        asked = queries.select("query_id", "query", self.models.embed(prefixed(F.col("query"), self.cfg.embed_model, query=True)).alias("query_vector"))
        c = self.cfg
        rows = self.corpus()
        if where:
            meta = self.collection.read().where(retrieve.condition(where, lambda name: F.try_element_at("metadata", F.lit(name))))
            rows = rows.join(meta.select("id"), "id", "left_semi")
        score = self.models.pair_score if c.rerank_model else None
        return retrieve.hybrid(rows, asked, k or pool_size(c.pool_base, c.n_stories, c.chunks_per_story, c.k_boost), c.n_stories, c.chunks_per_story, c.bm25_weight, c.rrf_k, c.bm25, pair_score=score)

    def generate(self, queries: DataFrame) -> DataFrame:
        return loop.three_steps(self.corpus(), queries, self.cfg, self.models)

    def generate_agentic(self, queries: DataFrame) -> loop.Result:
        return loop.agentic(self.corpus(), queries, self.cfg, self.models)

    def summarise(self, texts: DataFrame) -> DataFrame:
        return texts.select("*", self.models.summarise(F.col("text")).alias("summary"))

    def evaluate(self, texts: DataFrame) -> DataFrame:
        e = evaluate.parse_evaluation(self.models.evaluate(F.col("text")))
        return texts.select("*", evaluate.average(e).alias("average_score"))

    def evaluate_files(self, texts: DataFrame, sources: DataFrame) -> DataFrame:
        """evaluate() of texts (name, text) beside their sources (name, text); a missing source reads "Not provided."."""
        return self.evaluate(files.with_sources(texts, sources))

    def status(self) -> dict[str, object]:
        """What a health check asks for."""
        return {"collection": self.collection.path, "version": self.collection.version(), "segments": len(self.collection.segments()), "rows": self.collection.count()}
