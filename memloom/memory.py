"""One object for everything: a memory that keeps its tables in a folder.

Every method is an operator of this package over the stored tables. Results are DataFrames,
or small dictionaries where there is one answer. Tables only grow: a change appends a new
version, and readers see the latest.
"""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom.operators import dialect, drawers, embedding, entities, graph, kg, layers, registry, transcripts, vectors
from memloom.sources import files

_DRAWERS = (
    "drawer_id string, wing string, room string, content string, source_file string, chunk_index int, added_by string, filed_at string, created_at double, updated_at double, "
    "extra map<string,string>, extra_type map<string,string>, embedding array<float>, ord long, version long, deleted boolean"
)
_LOG = "seq long, op string, subject string, predicate string, object string, type string, date string"
_PEOPLE = "name string, source string, context string, relationship string, confidence double, aliases array<string>, canonical string, ord int"
_WIKI = "word string, inferred_type string, confidence double, title string, summary string, confirmed boolean"


def _flat(metadata: Mapping[str, object] | None) -> tuple[dict[str, str], dict[str, str]]:
    """Metadata as text and its types; what is neither text, number nor boolean becomes JSON."""
    import json

    values, kinds = {}, {}
    for k, v in (metadata or {}).items():
        kinds[k] = "boolean" if isinstance(v, bool) else "number" if isinstance(v, int | float) else "string"
        values[k] = v if isinstance(v, str) else json.dumps(v)
    return values, kinds


class Memory:
    def __init__(self, spark: SparkSession, folder: str, *, embedder: embedding.Embedder | None = None, identity_paths: Sequence[str | Path] = ()) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.embedder = embedder or embedding.HashingEmbedder()
        self.identity_paths = identity_paths
        self.mode = "personal"

    # ── Tables ───────────────────────────────────────────────────────────────

    def _table(self, name: str, schema: str) -> DataFrame:
        return files.load_table(self.spark, f"{self.folder}/{name}", schema)

    def _append(self, df: DataFrame, name: str, schema: str) -> None:
        empty = self.spark.createDataFrame([], schema)
        files.save_table(empty.unionByName(df, allowMissingColumns=True).select(*empty.columns), f"{self.folder}/{name}")

    def drawers(self) -> DataFrame:
        log = self._table("drawers", _DRAWERS)
        return drawers.latest_version(log, "drawer_id", "version").where("not deleted")

    def triples(self) -> DataFrame:
        return kg.replay(self._table("facts", _LOG))[1]

    def people(self) -> DataFrame:
        return drawers.latest_version(self._table("people", _PEOPLE), "name", "ord")

    def projects(self) -> DataFrame:
        return self._table("projects", "name string, ord int")

    def wiki(self) -> DataFrame:
        found = self._table("wiki", _WIKI)
        return found.groupBy("word").agg(F.max_by(F.struct(*(c for c in found.columns if c != "word")), "confirmed").alias("r")).select("word", "r.*")

    # ── Status, taxonomy, queries ────────────────────────────────────────────

    def status(self) -> DataFrame:
        return drawers.status(self.drawers())

    def list_wings(self) -> DataFrame:
        return drawers.list_wings(self.drawers())

    def list_rooms(self, wing: str | None = None) -> DataFrame:
        return drawers.list_rooms(self.drawers(), wing)

    def get_taxonomy(self) -> DataFrame:
        return drawers.taxonomy(self.drawers())

    def query_by_date(self, after: str | None = None, before: str | None = None, **where: object) -> DataFrame:
        return drawers.query_by_date(self.drawers(), after, before, **where)

    def query_by_metadata(self, key: str, value: str, **where: object) -> DataFrame:
        return drawers.query_by_metadata(self.drawers(), key, value, **where)

    # ── Drawers ──────────────────────────────────────────────────────────────

    def _vector(self, text: str) -> list[float]:
        return [float(x) for x in self.embedder.embed([text])[0]]

    def _nearest(self, text: str, n: int, wing: str | None, room: str | None) -> DataFrame:
        query = self.spark.createDataFrame([("query", self._vector(text))], "id string, embedding array<float>")
        stored = self.drawers()
        store = stored.where("embedding is not null").withColumn("id", F.col("drawer_id"))
        found = vectors.nearest(store, query, n, where=drawers.within(wing, room))
        return found.join(stored, F.col("id") == F.col("drawer_id")).select("query_id", "rank", "similarity", "drawer_id", "wing", "room", "content", "source_file", "extra").orderBy("rank")

    def search(self, query: str, *, wing: str | None = None, room: str | None = None, limit: int = 5) -> DataFrame:
        return self._nearest(query, limit, wing, room)

    def check_duplicate(self, content: str, threshold: float = 0.9) -> DataFrame:
        return self._nearest(content, 5, None, None).where(F.col("similarity") >= threshold)

    def add_drawer(self, wing: str, room: str, content: str, *, source_file: str = "", added_by: str = "mcp", metadata: Mapping[str, object] | None = None, threshold: float = 0.9) -> dict:
        """Files a text, unless something filed is that similar: then the matches come back."""
        if matches := self.check_duplicate(content, threshold).select("drawer_id", "similarity", F.substring("content", 1, 200).alias("content")).collect():
            return {"success": False, "reason": "duplicate", "matches": [m.asDict() for m in matches]}
        now, (extra, kinds) = time.time(), _flat(metadata)
        new = self.spark.createDataFrame([(wing, room, content, source_file, added_by, extra, kinds, int(now * 1e6), self._vector(content))], "wing string, room string, content string, source_file string, added_by string, extra map<string,string>, extra_type map<string,string>, ord long, embedding array<float>")
        made = drawers.add_drawers(new.limit(0).withColumns({"drawer_id": F.lit(""), "created_at": F.lit(0.0)}).drop("embedding"), new.drop("embedding"), now=now)
        made = made.join(new.select("ord", "embedding"), "ord").withColumns({"version": F.col("ord"), "deleted": F.lit(False), "filed_at": F.lit(datetime.fromtimestamp(now, UTC).isoformat())})
        self._append(made, "drawers", _DRAWERS)
        return {"success": True, "drawer_id": made.first()["drawer_id"], "wing": wing, "room": room}

    def get_drawer(self, drawer_id: str) -> dict:
        found = drawers.get_drawer(self.drawers(), drawer_id).drop("embedding").first()
        return found.asDict() if found else {"error": f"Drawer not found: {drawer_id}"}

    def update_drawer(self, drawer_id: str, *, content: str | None = None, wing: str | None = None, room: str | None = None, metadata: Mapping[str, object] | None = None) -> dict:
        old = drawers.get_drawer(self.drawers(), drawer_id)
        if old.isEmpty():
            return {"error": f"Drawer not found: {drawer_id}"}
        now, (extra, kinds) = time.time(), _flat(metadata)
        change = self.spark.createDataFrame([(drawer_id, content, wing, room, extra if metadata else None)], "drawer_id string, content string, wing string, room string, extra map<string,string>")
        new = drawers.update_drawers(old.drop("updated_at"), change, now=now).withColumn("version", F.lit(int(now * 1e6)))
        if kinds:
            fresh = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))
            new = new.withColumn("extra_type", F.map_concat(F.map_filter("extra_type", lambda k, _: ~k.isin(*kinds)), fresh))
        if content is not None:
            new = new.withColumn("embedding", F.array(*map(F.lit, self._vector(content))).cast("array<float>"))
        self._append(new, "drawers", _DRAWERS)
        return {"success": True, "drawer_id": drawer_id}

    def delete_drawer(self, drawer_id: str) -> dict:
        old = drawers.get_drawer(self.drawers(), drawer_id)
        if old.isEmpty():
            return {"error": f"Drawer not found: {drawer_id}"}
        self._append(old.withColumns({"deleted": F.lit(True), "version": F.lit(int(time.time() * 1e6))}), "drawers", _DRAWERS)
        return {"success": True, "drawer_id": drawer_id}

    # ── Knowledge graph ──────────────────────────────────────────────────────

    def _log(self, op: str, subject: str, predicate: str | None, obj: str | None, kind: str | None, date: str | None) -> None:
        self._append(self.spark.createDataFrame([(time.time_ns(), op, subject, predicate, obj, kind, date)], _LOG), "facts", _LOG)

    def kg_add(self, subject: str, predicate: str, obj: str, valid_from: str | None = None) -> dict:
        self._log("add", subject, predicate, obj, None, valid_from)
        return {"success": True, "fact": f"{subject} -> {predicate} -> {obj}"}

    def kg_add_entity(self, name: str, kind: str) -> None:
        self._log("add_entity", name, None, None, kind, None)

    def kg_invalidate(self, subject: str, predicate: str, obj: str, ended: str | None = None) -> dict:
        ended = ended or datetime.now(UTC).date().isoformat()
        self._log("invalidate", subject, predicate, obj, None, ended)
        return {"success": True, "ended": ended}

    def kg_query(self, name: str, as_of: str | None = None, direction: str = "both") -> DataFrame:
        return kg.query_entity(self.triples(), name, as_of, direction)

    def kg_timeline(self, name: str | None = None) -> DataFrame:
        return kg.timeline(self.triples(), name)

    def kg_stats(self) -> DataFrame:
        return kg.stats(self.triples())

    # ── Room graph ───────────────────────────────────────────────────────────

    def traverse(self, start_room: str, max_hops: int = 2) -> DataFrame:
        found = graph.traverse(self.drawers(), start_room, max_hops)
        return graph.suggest_rooms(graph.room_nodes(self.drawers()), start_room) if found.isEmpty() else found

    def find_tunnels(self, wing_a: str | None = None, wing_b: str | None = None) -> DataFrame:
        return graph.find_tunnels(graph.room_nodes(self.drawers()), wing_a, wing_b)

    def graph_stats(self) -> dict:
        nodes = graph.room_nodes(self.drawers())
        return graph.graph_stats(nodes).first().asDict() | {"rooms_per_wing": graph.rooms_per_wing(nodes), "top_tunnels": graph.top_tunnels(nodes)}

    # ── Diary ────────────────────────────────────────────────────────────────

    def diary_write(self, agent: str, entry: str, topic: str = "general") -> dict:
        now = time.time()
        filed = datetime.fromtimestamp(now, UTC).strftime("%Y-%m-%dT%H:%M:%S.%f")[:23] + "Z"
        made = drawers.diary_entries(self.spark.createDataFrame([(agent, topic, entry, filed, int(now * 1e6))], "agent string, topic string, entry string, filed_at string, ord long"))
        labels = [c for c in ("hall", "type", "agent", "topic", "date")]
        row = made.withColumns(
            {
                "extra": F.create_map(*(x for c in labels for x in (F.lit(c), F.col(c)))),
                "extra_type": F.create_map(*(F.lit(x) for c in labels for x in (c, "string"))),
                "created_at": F.lit(now),
                "version": F.col("ord"),
                "deleted": F.lit(False),
                "added_by": F.col("agent"),
            }
        )
        self._append(row.drop(*labels), "drawers", _DRAWERS)
        return {"success": True, "drawer_id": made.first()["drawer_id"]}

    def diary_read(self, agent: str, last_n: int = 10) -> DataFrame:
        wing = f"wing_{agent.lower().replace(' ', '_')}"
        own = self.drawers().where(drawers.within(wing, "diary"))
        entries = own.select(F.lit(agent).alias("agent"), F.element_at("extra", "topic").alias("topic"), F.col("content").alias("entry"), "filed_at", "ord")
        return drawers.diary_read(entries, last_n)

    # ── Layers ───────────────────────────────────────────────────────────────

    def _identity(self) -> str:
        return layers.load_identity(self.identity_paths)

    def wake_up(self, wing: str | None = None) -> dict:
        return layers.wake_up(self.drawers(), self._identity(), wing).first().asDict()

    def recall(self, wing: str | None = None, room: str | None = None, n: int = 10) -> DataFrame:
        return drawers.recall(self.drawers(), wing, room, n)

    def deep_search(self, query: str, *, wing: str | None = None, room: str | None = None, limit: int = 5) -> DataFrame:
        return layers.deep_search_lines(self._nearest(query, limit, wing, room))

    def layer_status(self) -> dict:
        return layers.layer_status(self.drawers(), self._identity()).first().asDict()

    # ── Summaries ────────────────────────────────────────────────────────────

    def _one(self, text: str) -> DataFrame:
        return self.spark.createDataFrame([(text,)], "text string")

    def get_spec(self) -> str:
        return dialect.SPECIFICATION

    def compress(self, text: str, **about: str) -> str:
        return self._one(text).select(dialect.compress("text", **{k: F.lit(v) for k, v in about.items()})).first()[0]

    def compress_stats(self, text: str) -> dict:
        return self._one(text).withColumn("summary", dialect.compress("text")).select(dialect.compression_stats("text", "summary").alias("s")).select("s.*").first().asDict()

    def decode(self, summary: str) -> dict:
        return self._one(summary).select(dialect.decode("text").alias("d")).select("d.*").first().asDict()

    # ── Mining ───────────────────────────────────────────────────────────────

    def scan_convos(self, folder: str) -> dict:
        count, paths, truncated = files.list_chat_files(self.spark, folder)
        return {"count": count, "files": paths, "truncated": truncated}

    def mine_convos(self, folder: str, *, wing: str | None = None, agent: str = "loader", limit: int = 0, dry_run: bool = False) -> DataFrame:
        """Files a folder's chats that aren't filed yet -> (room, files, drawers) of what it filed, or with dry_run would file."""
        found = files.chat_files(self.spark, folder)
        if limit:
            found = found.join(found.select("path").orderBy("path").limit(limit), "path", "left_semi")
        now = time.time()
        mined = transcripts.mine(found, None if dry_run else self.drawers(), wing=wing or transcripts.wing_of(folder), agent=agent, now=now)
        if dry_run:
            return transcripts.mining_totals(mined)
        rows = embedding.embed_column(mined, "content", self.embedder)
        stamp = int(now * 1e6)
        per_file = mined.groupBy("source_file").agg(F.count("*").alias("n"))  # a row for each file: their order needs no more
        before = Window.orderBy("source_file").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.join(per_file.select("source_file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "source_file")
        rows = rows.withColumns({"version": F.lit(stamp), "ord": F.lit(stamp) + F.col("before") + F.col("chunk_index"), "deleted": F.lit(False), "extra": F.create_map(F.lit("ingest_mode"), F.lit("convos")), "extra_type": F.create_map(F.lit("ingest_mode"), F.lit("string"))}).drop("before")
        self._append(rows, "drawers", _DRAWERS)
        return transcripts.mining_totals(self._table("drawers", _DRAWERS).where(F.col("version") == stamp))

    # ── Entities ─────────────────────────────────────────────────────────────

    def detect_entities(self, folder: str, max_files: int = 10, *, stop_words: Sequence[str] | None = None) -> DataFrame:
        texts = files.detection_files(self.spark, folder, max_files).withColumn("k", F.lit(0))
        return entities.detect(texts, "k", "path", max_texts=max_files, stop_words=stop_words)

    def entity_seed(self, people: Sequence[Mapping[str, str]], projects: Sequence[str] = (), aliases: Mapping[str, str] | None = None, mode: str = "personal") -> dict:
        """Adds people, and replaces the projects."""
        self.mode = mode
        start = (self._table("people", _PEOPLE).agg(F.max("ord")).first()[0] or 0) + 1
        rows = [(p["name"], p.get("relationship"), p.get("context"), start + i) for i, p in enumerate(people)]
        named = self.spark.createDataFrame(rows, "name string, relationship string, context string, ord int")
        other = self.spark.createDataFrame([(a, c, i) for i, (a, c) in enumerate((aliases or {}).items())], "alias string, canonical string, ord int")
        self._append(registry.seed(named, other), "people", _PEOPLE)
        self.spark.createDataFrame([(p, i) for i, p in enumerate(projects)], "name string, ord int").write.mode("overwrite").parquet(f"{self.folder}/projects")
        return {"people": len(rows), "projects": len(projects)}

    def entity_lookup(self, word: str, context: str = "") -> dict:
        words = self.spark.createDataFrame([(0, word, context)], "word_id int, word string, context string")
        return registry.lookup(words, self.people(), self.projects(), self.wiki()).first().asDict()

    def entity_learn(self, text: str, min_confidence: float = 0.75, *, stop_words: Sequence[str] | None = None) -> list[str]:
        whole = self._one(text).withColumn("k", F.lit(0))
        found = entities.classify(entities.score(entities.candidates(whole, "k", stop_words=stop_words), whole, "k"))
        new = registry.learn(found, self.people(), self.projects(), mode=self.mode, least=min_confidence)
        start = (self._table("people", _PEOPLE).agg(F.max("ord")).first()[0] or 0) + 1
        names = sorted(r["name"] for r in new.collect())  # the persons of one text
        place = F.array_position(F.array(*map(F.lit, names)), F.col("name")).cast("int") if names else F.lit(0)
        if names:
            self._append(new.withColumns({"relationship": F.lit(""), "aliases": F.array().cast("array<string>"), "ord": place + start}), "people", _PEOPLE)
        return names

    def entity_research(self, word: str, pages: DataFrame, *, confirm: bool = False) -> dict:
        """What the given encyclopaedia pages say of a word; what was asked before isn't asked again."""
        words = self.spark.createDataFrame([(word,)], "word string")
        found = registry.research(words, self.wiki(), pages).where(F.col("word") == word)
        found = found.withColumn("confirmed", F.col("confirmed") | F.lit(confirm))
        row = found.first()
        if row:
            self._append(self.spark.createDataFrame([row], found.schema), "wiki", _WIKI)
        return row.asDict() if row else {"word": word, "inferred_type": "unknown", "confidence": 0.0}

    def entity_summary(self) -> str:
        return registry.summary(self.people(), self.projects(), self.wiki(), self.mode).first()[0]
