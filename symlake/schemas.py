"""Schemas of the tables of a code index, and of search hits."""

from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, LongType, StringType, StructType

_TYPES = {"string": StringType(), "int": IntegerType(), "long": LongType(), "double": DoubleType(), "array<string>": ArrayType(StringType()), "array<float>": ArrayType(FloatType()), "array<int>": ArrayType(IntegerType())}


def _schema(text: str) -> StructType:
    """A schema from "name type, ..." without a session."""
    out = StructType()
    for part in text.split(", "):
        name, kind = part.split(" ")
        out.add(name, _TYPES[kind])
    return out


FILES = _schema("path string, language string, content string, version long")
SYMBOLS = _schema("id string, qualified_name string, file_path string, name string, kind string, language string, start_line int, end_line int, parent string, ord int")
CHUNKS = _schema("id string, unit_type string, symbol_qualified_name string, file_path string, language string, start_line int, end_line int, content string, profile string")
EDGES = _schema("src_symbol_id string, dst_symbol_id string, edge_type string, file_path string, line_start int, line_end int, confidence double")
ENRICHMENTS = _schema("chunk_id string, description string, responsibilities array<string>, tags array<string>, inputs array<string>, outputs array<string>, side_effects array<string>, failure_modes array<string>")
CONTEXT = _schema("edge_type string, target string, file_path string, line_start int, line_end int, confidence double")
VECTORS = _schema("id string, vector array<float>, unit_type string, file_path string, language string, symbol string, line_start int, line_end int, content string, profile string, embedding_text string").add("graph_context", ArrayType(CONTEXT)).add("symbol_count", IntegerType()).add("defined_symbols", ArrayType(StringType()))
POSTINGS = _schema("id string, file_path string, dl long, col int, term string, positions array<int>")
HITS = _schema("query_id long, rank int, id string, score double, file_path string, symbol string, content string, source string, retrieval_method string, line_start int, line_end int")

#: Table name -> (schema, key columns, column that says which file a row came from).
TABLES = {
    "files": (FILES, ["path"], "path"),
    "symbols": (SYMBOLS, ["qualified_name", "file_path"], "file_path"),
    "chunks": (CHUNKS, ["id"], "file_path"),
    "symbol_edges": (EDGES, ["src_symbol_id", "dst_symbol_id", "edge_type", "file_path"], "file_path"),
    "llm_enrichments": (ENRICHMENTS, ["chunk_id"], None),
    "postings": (POSTINGS, ["id", "col", "term"], "file_path"),
    "vectors": (VECTORS, ["id"], "file_path"),
}

#: What columns hold in rows that were written before a table had them, as expressions; null where nothing is said.
DEFAULTS: dict[str, dict[str, str]] = {
    "chunks": {"unit_type": "'function_chunk'"},
    "symbol_edges": {"confidence": "1.0D"},
    "llm_enrichments": {"responsibilities": "cast(array() as array<string>)", "side_effects": "cast(array() as array<string>)"},
}
