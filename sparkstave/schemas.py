"""Fixed schemas, and the check of required columns when a plan is built."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "boolean": T.BooleanType()}


def _fields(kind: str, *names: str) -> list[T.StructField]:
    return [T.StructField(n, _TYPES[kind]) for n in names]


MANIFEST = T.StructType([
    *_fields("string", "id", "selected_variant"),
    *_fields("int", "selected_source_length", "selected_target_length"),
    *_fields("string", "truncated_musicxml_path", "truncated_lmx_path", "truncated_midi_path"),
    *_fields("boolean", "xml_conversion_ok", "lmx_conversion_ok", "midi_conversion_ok"),
    *_fields("string", "xml_conversion_error", "lmx_conversion_error", "midi_conversion_error"),
])
_CLEF = T.StructType(_fields("string", "number", "sign", "line"))
ELEMENTS = T.StructType([
    *_fields("string", "file"), *_fields("int", "part_idx", "measure_order"), *_fields("string", "measure_number"), *_fields("int", "child_pos"),
    *_fields("string", "tag", "duration"), *_fields("boolean", "is_chord", "is_rest"),
    *_fields("string", "step", "alter", "octave", "staff", "voice", "beats", "beat_type", "fifths", "divisions"),
    T.StructField("clefs", T.ArrayType(_CLEF)), *_fields("string", "ties", "error"),
])


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """``df`` itself, or an error that names what it lacks."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
