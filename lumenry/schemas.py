"""Schemas of the logical entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType

_STR, _LONG, _INT, _DOUBLE, _BOOL = StringType(), LongType(), IntegerType(), DoubleType(), BooleanType()


def _struct(**fields: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


RAW = _struct(Doc_url=_STR, Text=_STR, Titles=_STR, Court_Name_Normalized=_STR, Court_Type=_STR, Case_Type=_STR, Cites=_LONG, Cited_by=_LONG)
METADATA = _struct(title=_STR, court=_STR, court_type=_STR, case_types=ArrayType(_STR), cites=_LONG, cited_by=_LONG, url=_STR)
DOCUMENT = _struct(id=_STR, text=_STR, metadata=METADATA, seq=_LONG)
CHUNK = _struct(id=_STR, doc_id=_STR, idx=_INT, text=_STR, metadata=METADATA)
VECTOR = _struct(chunk_id=_STR, embedding=ArrayType(FloatType()))
RESULT = _struct(query_id=_STR, rank=_INT, score=_DOUBLE, chunk_id=_STR, doc_id=_STR, text=_STR, metadata=METADATA, score_type=_STR)
LABEL = _struct(query=_STR, relevant_chunk_ids=ArrayType(_STR), kind=_STR, note=_STR)
MENTION = _struct(citation_key=_STR, source_doc_id=_STR, treatment=_STR, raw=_STR, snippet=_STR)
STRUCTURED_ANSWER = "refused boolean, claims array<struct<text:string,source_ids:array<string>>>"
REQUEST_LOG = _struct(
    request_id=_STR, ts=_STR, client=_STR, query=_STR, route=_STR, k=_INT, refused=_BOOL, cited=ArrayType(_INT), invalid=ArrayType(_INT), score_gap=_DOUBLE, retriever_ms=_LONG, generation_ms=_LONG, error=_STR
)
SCORE_TYPES = ("cosine", "bm25", "rrf", "exact", "reranked")


def expect(df: DataFrame, schema: StructType) -> DataFrame:
    """df with schema's columns in its order; a missing column or another type is an error."""
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f.name for f in schema if have.get(f.name) != f.dataType]
    if wrong:
        raise ValueError(f"columns missing or of another type: {', '.join(wrong)}")
    return df.select(*schema.fieldNames())
