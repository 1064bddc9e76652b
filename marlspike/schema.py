"""Schemas and vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

ENTITY_KEY = ["domain", "entity_type", "name"]
SUBJECT, OBJECT = ["s_domain", "s_type", "s_name"], ["o_domain", "o_type", "o_name"]
EDGE_KEY = ["asserting_file", "relation", *SUBJECT, *OBJECT, "argc", "spread"]

ENTITY = T.StructType([T.StructField(c, T.StringType(), c == "file") for c in (*ENTITY_KEY, "file")])
IR = T.StructType([
    T.StructField("file_id", T.StringType(), False), T.StructField("version", T.LongType(), False), T.StructField("pos", T.IntegerType(), False),
    T.StructField("opcode", T.StringType(), False), T.StructField("args", T.ArrayType(T.StringType()), False),
])
CONTEXTS = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("file_path", T.StringType()), T.StructField("content_hash", T.StringType()),
    T.StructField("source_hash", T.StringType()), T.StructField("fidelity", T.IntegerType()), T.StructField("raw_tokens", T.LongType()),
    T.StructField("compressed_tokens", T.LongType()), T.StructField("created_at", T.TimestampNTZType()), T.StructField("updated_at", T.TimestampNTZType()),
])

# Vocabularies.
RELATIONS = (
    "Injects HasInput HasOutput HasModel HasSelector HasTemplate HasStyle DeclaresInModule ImportsModule ExportsFromModule RouteMapsTo GuardedBy "
    "ResolvedBy Dispatches Selects HandlesAction CallsService HasStore TriggersReducer ProducesAction ControllerAction HasRoute HasEntity "
    "EntityRelationship MapsFrom MapsTo HubMethodTargets Tests Autowired EndpointMapsTo BeanProduces ConfigurationProperties Extends Implements "
    "Defines Calls HasBaseType HasConstructorParameterType"
).split()
DEPENDENCY_RELATIONS = "Injects Autowired ImportsModule HandlesAction CallsService HasEntity MapsFrom ConfigurationProperties".split()
CYCLE_RELATIONS = ["Injects", "ImportsModule"]
INJECTION_RELATIONS = ["Injects", "Autowired"]
FIDELITY = {"Low": 0, "Medium": 1, "High": 2, "Edit": 3, "Verbatim": 4}
FILE_CLASSES = ["Test", "Config", "Model", "Service", "Implementation", "General"]
