"""Table contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "binary": T.BinaryType(),
    "timestamp": T.TimestampType(),
    "map<string,bigint>": T.MapType(T.StringType(), T.LongType()),
}


def _struct(text: str) -> T.StructType:
    """`name type` pairs; a trailing `!` marks a column that is never NULL."""
    fields = []
    for part in text.replace("\n", " ").split(";"):
        name, kind = part.split()
        nullable = not kind.endswith("!")
        fields.append(T.StructField(name, _TYPES[kind.rstrip("!")], nullable))
    return T.StructType(fields)


REPOS = _struct(
    "id string!; full_name string; url string; conference string; year int; paper_title string"
)
METADATA = _struct(
    "full_name string!; size_kb bigint; language string; default_branch string;"
    "http_status int; fetched_at timestamp"
)
SNAPSHOTS = _struct("repo_id string!; ok boolean!; error string")
FILES = _struct("repo_id string!; path string!; size_bytes bigint!; content binary")
EDGES = _struct("repo_id string!; src string!; dst string!; n bigint!")
# --- Fixed values: columns of the result table (`token_counter` is additional) ---
RESULT = _struct(
    "id string!; repo_id string!; full_name string!; url string!; github_size_kb bigint!;"
    "primary_language string; default_branch string; total_code_tokens bigint!;"
    "total_code_files bigint!; total_code_bytes bigint!;"
    "tokens_by_extension map<string,bigint>; token_counter string; dependency_score double!;"
    "internal_import_count bigint!; unique_internal_imports bigint!; graph_density double;"
    "avg_in_degree double; max_in_degree bigint; num_connected_components bigint;"
    "largest_component_fraction double; conference string; year int; paper_title string;"
    "processing_status string!; error_message string; processed_at timestamp!"
)
# --- End of fixed values ----------------------------------------------------


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Pick the contract's columns in order; absent optional ones become typed NULLs."""
    present = set(df.columns)
    columns = []
    for field in schema:
        if field.name in present:
            columns.append(F.col(field.name).cast(field.dataType).alias(field.name))
        elif field.nullable:
            columns.append(F.lit(None).cast(field.dataType).alias(field.name))
        else:
            raise ValueError(f"column {field.name} is required")
    return df.select(*columns)
