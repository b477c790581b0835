"""Column layouts of the memory graph's tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


S, L, D, B, I = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.IntegerType()  # noqa: E741
STRINGS = T.ArrayType(S)

MERGE_RECORD = _struct(merged_entity_id=S, merged_entity_name=S, method=S, merged_at=L, confidence=D)
#: An entity's chunks and documents are rows of their own tables: such lists grow with the corpus.
ENTITIES = _struct(
    id=S, canonical_name=S, aliases=STRINGS, entity_type=S, created_at=L, updated_at=L, access_count=L, rank=D, extraction_confidence=D,
    merge_history=T.ArrayType(MERGE_RECORD), projects=STRINGS,
)
MENTIONS = _struct(entity_id=S, chunk_id=S)
ENTITY_DOCUMENTS = _struct(entity_id=S, document=S)
EDGES = _struct(src=S, dst=S, chunk_id=S, chunk_type=S, memory_category=S, timestamp=L, source_document=S, weight=D)
CHUNKS = _struct(
    id=S, source_document=S, section_name=S, speaker=S, timestamp=L, chunk_type=S, memory_category=S, text=S, tags=STRINGS, created_at=L, projects=STRINGS,
)
DOCUMENT_HASHES = _struct(document=S, sha256=S)
EMBEDDINGS = _struct(entity_id=S, vector=T.ArrayType(D))
#: With the hash of what an entity was embedded by.
STORED_EMBEDDINGS = _struct(entity_id=S, sha256=S, vector=T.ArrayType(D))
RAW_CHUNKS = _struct(source_document=S, position=I, section_name=S, speaker=S, timestamp=L, memory_category=S, text=S)
FRAGMENTS = _struct(
    id=L, source_id=S, text=S, category=S, project=S, entity_hints=S, created_at=L, extracted_at=L, extraction_status=S, batch_id=S, error=S,
)
OVERFLOW = _struct(version=I, source_id=S, text=S, category=S, project=S, entity_hints=STRINGS, captured_at=L)
FILES = _struct(path=S, language=S, definitions=STRINGS, usages=STRINGS, content_hash=L)
FILE_EDGES = _struct(src=S, dst=S, kind=S)
FILE_EVENTS = _struct(path=S, kind=S, at=T.TimestampType())

#: Fixed values of the data model.
CHUNK_TYPES = ("Decision", "Discussion", "ActionItem", "StatusUpdate", "Preference", "Background")
MEMORY_CATEGORIES = ("Episodic", "Semantic", "Procedural")
ENTITY_TYPES = ("Person", "Project", "Technology", "Organization", "Location", "Decision", "Concept", "Document")
EDGE_WEIGHTS = {"Decision": 2.0, "ActionItem": 1.8, "StatusUpdate": 1.5, "Preference": 1.5, "Discussion": 1.0, "Background": 0.5}
SCORE_WEIGHTS = {"Decision": 1.0, "ActionItem": 0.9, "StatusUpdate": 0.7, "Preference": 0.6, "Discussion": 0.5, "Background": 0.3}
FILE_EDGE_STRENGTHS = {"Import": 2.0, "SymbolUsage": 1.0}
SPOOL_STATES = ("pending", "extracting", "extracted", "failed")
