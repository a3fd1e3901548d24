"""Column-level helpers: each returns a :class:`pyspark.sql.Column` built from
Spark's own expressions, so it stays inside whole-stage code generation."""

from sigframe.functions.arrays import (
    argmax, channel_major_to_time_major, flatten_channels, one_hot, relu, relu_array,
    softmax, time_major_to_channel_major, vector_element,
)
from sigframe.functions.keys import composite_key, eq_flag, file_name_of, recording_id
from sigframe.functions.stages import stage_label, stage_map_column

__all__ = [
    "argmax", "channel_major_to_time_major", "composite_key", "eq_flag", "file_name_of",
    "flatten_channels", "one_hot", "recording_id", "relu", "relu_array", "softmax",
    "stage_label", "stage_map_column", "time_major_to_channel_major", "vector_element",
]
