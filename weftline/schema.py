"""Schemas of the graph store, of extraction answers and of evaluation sets."""

from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType, TimestampType


def _struct(**fields) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


S, I, L = StringType(), IntegerType(), LongType()
DOCUMENTS = _struct(file_hash=S, filename=S, pages=I, chunks=I, created_at=TimestampType(), updated_at=TimestampType())
CHUNKS = _struct(id=S, doc_hash=S, index=I, page_start=I, page_end=I, text=S)
ENTITIES = _struct(id=S, name=S, type=S, description=S, mentions=L, label=S)
MENTIONS = _struct(chunk_id=S, entity_id=S)
RELATIONS = _struct(src=S, tgt=S, type=S, description=S, weight=L)
RELATION_CHUNKS = _struct(src=S, tgt=S, type=S, chunk_id=S)
EXTRACTION = _struct(entities=ArrayType(_struct(name=S, type=S, description=S)), relations=ArrayType(_struct(source=S, target=S, relation=S, description=S)))
TRIPLES_ANSWER = _struct(triples=ArrayType(_struct(subject=S, predicate=S, object=S)))
TRIPLES = _struct(run=S, idx=I, subject=S, predicate=S, object=S)
