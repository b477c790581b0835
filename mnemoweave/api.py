"""One object over a stored graph: what a caller invokes by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoweave.operators import aggregates, lookups, relations
from mnemoweave.plans import agent, conversations, embedding, ingestion, mutations, ranking, reflection, retrieval, traversal
from mnemoweave.sources import files, snapshot
from mnemoweave.state import GraphState
from mnemoweave.storage import materialise

CLIP_CHARS = 60_000


@dataclass
class Memory:
    """A graph in a folder.  Reading methods return DataFrames or text; changing ones hold until ``save``."""

    spark: SparkSession
    root: str
    client: ingestion.Client = field(default_factory=ingestion.RuleClient)
    embed: embedding.Embedder = embedding.hashing_embedder
    #: Mentions that are close to an entity, but not close enough to link.
    review: DataFrame | None = None

    def __post_init__(self) -> None:
        self.state: GraphState = snapshot.load(self.spark, self.root)
        self._ranks: DataFrame | None = None
        self._vectors: DataFrame | None = None
        self._stored = snapshot.load_vectors(self.spark, self.root)

    def _changed(self, state: GraphState) -> None:
        self._stored = self._vectors if self._vectors is not None else self._stored
        self.state, self._ranks, self._vectors = state, None, None

    @property
    def ranks(self) -> DataFrame:
        """PageRank, computed when first asked for after a change."""
        if self._ranks is None:
            self._ranks = ranking.pagerank(self.state.entities, self.state.edges)
        return self._ranks

    @property
    def vectors(self) -> DataFrame:
        """Vectors of all entities: those stored or made before whose descriptor is the same, the rest embedded now."""
        if self._vectors is None:
            self._vectors = materialise(embedding.refreshed(self.state, self._stored, self.embed))
        return self._vectors

    # reading
    def status(self) -> DataFrame:
        return aggregates.statistics(self.state)

    def entity(self, reference: str) -> DataFrame:
        return agent.briefs(self.state, lookups.resolve(self.state, reference), self.ranks)

    def search(self, text: str, limit: int = 20) -> DataFrame:
        return lookups.search_entities(self.state, text, limit)

    def similar(self, text: str, limit: int = 10) -> DataFrame:
        return retrieval.semantic_search(self.state, self.vectors, self.ranks, self.embed([text])[0], limit)

    def neighbourhood(self, reference: str, hops: int = 2, start: int | None = None, end: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        return traversal.subgraph(self.state, self._id(reference), hops, start, end)

    def timeline(self, reference: str, limit: int = 30) -> DataFrame:
        return agent.timeline(self.state, self._id(reference), limit)

    def mentions(self, reference: str, limit: int = 20) -> DataFrame:
        return agent.mentions(self.state, self._id(reference), limit)

    def evidence(self, a: str, b: str) -> DataFrame:
        return relations.evidence(self.state, self._id(a), self._id(b))

    def knowledge_map(self, top: int = 30) -> DataFrame:
        return retrieval.knowledge_map(self.state, self.ranks, top)

    def context(self, situation: str, full: bool = False, since: int | None = None, until: int | None = None) -> agent.Context:
        """What an agent is told about a situation, briefly or in full."""
        return agent.context(self.state, self.vectors, self.ranks, situation, self.embed([situation])[0], full, since=since, until=until)

    def profile(self) -> DataFrame:
        return agent.profile(self.state, self.ranks)

    def recall(self, question: str, budget: int = 8000, since: int | None = None, until: int | None = None) -> str:
        """The most similar entities and the assembled context of a question, over edges in time."""
        hits = "\n".join(f"- {r['canonical_name']} ({r['entity_type']})" for r in self.similar(question).collect())
        context = retrieval.assembled(self.state, self.vectors, self.ranks, self.embed([question])[0], len(question) // 4, budget, since=since, until=until)
        return "\n\n".join(x for x in (hits, context) if x)[:CLIP_CHARS]

    def all_memories(self, top: int = 20) -> str:
        """Counts and the top entities."""
        counts = self.status().first().asDict()
        names = lookups.key_entities(self.state.entities.drop("rank").join(self.ranks, "id"), limit=top).collect()
        return "\n".join([", ".join(f"{k}: {v}" for k, v in counts.items()), *(f"- {r['canonical_name']} ({r['entity_type']})" for r in names)])

    # changing
    def remember(self, text: str, source_id: str, now: int, category: str = "Episodic") -> DataFrame:
        return self.ingest(files.inline(self.spark, text, source_id, category), now)

    def ingest(self, docs: DataFrame, now: int, replace: bool = False) -> DataFrame:
        return self._ingested(ingestion.ingest(self.state, docs, now, self.client, replace, embed=self.embed))

    def reingest(self, docs: DataFrame, now: int) -> DataFrame:
        """Documents again from the start, changed or not: what they wrote before is removed first."""
        return self._ingested(ingestion.ingest(self.state, docs, now, self.client, replace=True, embed=self.embed, whole=True))

    def ingest_sessions(self, folder: str, now: int, project: str | None = None, since: int | None = None) -> DataFrame:
        """Session files of a folder, by a part of their path and their time; a session that has changed is replaced."""
        docs, raw = conversations.session_documents(files.sessions(self.spark, folder, project, since))
        return self._ingested(ingestion.ingest(self.state, docs, now, self.client, replace=True, raw=raw, embed=self.embed))

    def ingest_lore(self, path: str, now: int) -> DataFrame:
        """Entries of a lore file; nothing is done while the file as a whole is the one ingested before."""
        rows = files.lore(self.spark, path)
        docs = rows.select("source_document", "text", F.lit("Semantic").alias("memory_category"))
        mark = rows.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_document", "sha256"))), lambda x: x["sha256"]), "\n"), 256).alias("sha256")).select(F.lit(files.LORE_MANIFEST).alias("document"), "sha256")
        mark = materialise(mark)
        known = not mark.join(self.state.document_hashes, ["document", "sha256"], "left_semi").isEmpty()
        results = self.ingest(docs.limit(0) if known else docs, now, replace=True)
        if not known:
            self._changed(mutations.store_hashes(self.state, mark))
        return results

    def lore(self, question: str, k: int = 5) -> DataFrame:
        """The entries of lore most similar to a question."""
        return retrieval.search_under(self.state, files.LORE, self.embed([question])[0], self.embed, k)

    def _ingested(self, done: ingestion.Ingested) -> DataFrame:
        self._changed(GraphState(*map(materialise, done.state)))  # else plans grow with every call
        self.review = materialise(done.review if self.review is None else self.review.unionByName(done.review))
        return done.results

    def forget(self, reference: str) -> None:
        self._changed(mutations.remove_entities(self.state, lookups.resolve(self.state, reference).select("id")))

    def remove_document(self, document: str) -> DataFrame:
        r = mutations.remove_documents(self.state, self.spark.createDataFrame([(document,)], "document string"))
        self._changed(r.state)
        return r.counts

    def reflect(self, now: int, full: bool = True, says_yes: Callable[[DataFrame], DataFrame] | None = None) -> None:
        self._changed(GraphState(*map(materialise, reflection.reflect(self.state, now, self.vectors if full else None, full, says_yes))))

    def save(self) -> str:
        """Store a new version, with the vectors of its entities."""
        version = snapshot.save(self.spark, self.state, self.root, self.vectors)
        self._changed(snapshot.load(self.spark, self.root, version))
        self._stored = self._vectors = snapshot.load_vectors(self.spark, self.root, version)
        return version

    def _id(self, reference: str) -> str:
        row = lookups.resolve(self.state, reference).select(F.col("id")).first()
        return row["id"] if row else ""
