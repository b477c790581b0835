"""Small literal graphs."""

from mnemoweave import schemas
from mnemoweave.functions import edge_weight
from mnemoweave.operators.relations import cooccurrences
from mnemoweave.state import GraphState

T0 = 1731974400


def graph(spark, entities, chunks, documents=(), edges=None):
    """entities: (id, name, type, aliases); chunks: (id, document, type, tags, timestamp, text)."""
    e = spark.createDataFrame([(i, n, a, t, 100, 200, 1, 0.0, None, [], ["alpha"]) for i, n, t, a in entities], schemas.ENTITIES)
    c = spark.createDataFrame([(i, d, None, None, ts, t, "Episodic", text, tags, ts or 50, []) for i, d, t, tags, ts, text in chunks], schemas.CHUNKS)
    known = {x[0] for x in entities}
    m = spark.createDataFrame([(t, x[0]) for x in chunks for t in dict.fromkeys(x[3]) if t in known], schemas.MENTIONS)
    d = spark.createDataFrame(sorted({(t, x[1]) for x in chunks for t in x[3] if t in known} | set(documents)), schemas.ENTITY_DOCUMENTS)
    found = cooccurrences(c, edge_weight) if edges is None else spark.createDataFrame(edges, schemas.EDGES)
    return GraphState(e, m, d, found.select(*[f.name for f in schemas.EDGES]), c, spark.createDataFrame([], schemas.DOCUMENT_HASHES))


def core(spark):
    return graph(
        spark,
        [("e-nils", "Nils Berg", "Person", ["NB"]), ("e-kaia", "Kaia Holm", "Person", []), ("e-atlas", "Atlas Migration", "Project", []), ("e-wasm", "Wasm", "Technology", [])],
        [
            ("c1", "notes/site-visit.md", "Decision", ["e-nils", "e-atlas"], T0, "Nils decided on the atlas"),
            ("c2", "notes/site-visit.md", "Discussion", ["e-nils", "e-kaia"], T0, "Nils and Kaia talked"),
            ("c3", "notes/site-visit.md", "ActionItem", ["e-kaia", "e-atlas"], T0, "Kaia will do the atlas"),
            ("c4", "plans/atlas.md", "Background", ["e-atlas", "e-wasm"], T0, "The atlas uses Wasm"),
        ],
    )
