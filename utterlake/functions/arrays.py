"""Array and label-index expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAD = "pad"


def vocabulary(labels: Column) -> Column:
    """Label array with the padding label at index 0 and the labels in code point order after it."""
    return F.concat(F.array(F.lit(PAD)), F.sort_array(F.array_distinct(labels)))


def labels_to_indices(labels: Column, vocabulary: Column) -> Column:
    """Index of each label; a label that the vocabulary lacks is an error."""
    at = lambda x: F.array_position(vocabulary, x) - 1
    return F.transform(labels, lambda x: F.when(at(x) < 0, F.raise_error(F.concat(F.lit("unknown label: "), x)).cast("bigint")).otherwise(at(x)))


def indices_to_labels(indices: Column, vocabulary: Column, keep_padding: bool = False) -> Column:
    """Labels of indices; zeros, which are padding, go unless kept."""
    real = indices if keep_padding else F.filter(indices, lambda x: x != 0)
    return F.transform(real, lambda x: F.element_at(vocabulary, x.cast("int") + 1))


def keep_labels(tokens: Column, labels: Column | None) -> Column:
    """Tokens that are in ``labels``; a null or empty label set keeps all."""
    if labels is None:
        return tokens
    kept = F.filter(tokens, lambda x: F.array_contains(labels, x))
    return F.when(F.coalesce(F.size(labels), F.lit(0)) <= 0, tokens).otherwise(kept)


def zero_pad(frames: Column, length: Column, width: int) -> Column:
    """Frames followed by zero frames up to ``length``; more frames than that are an error."""
    zeros = F.array_repeat(F.array_repeat(F.lit(0.0).cast("float"), width), F.greatest(length - F.size(frames), F.lit(0)).cast("int"))
    return F.when(F.size(frames) > length, F.raise_error(F.lit("matrix is longer than the length to pad to")).cast("array<array<float>>")).otherwise(F.concat(frames, zeros))


def collapse(frames: Column) -> Column:
    """Frames of features by channels (array of array of array) with the channels joined to one feature axis."""
    return F.transform(frames, lambda frame: F.flatten(_transposed(frame)))


def _transposed(matrix: Column) -> Column:
    width = F.coalesce(F.size(matrix[0]), F.lit(0))
    return F.transform(F.sequence(F.lit(0), F.greatest(width, F.lit(1)) - 1), lambda j: F.transform(matrix, lambda row: row[j]))


def one_hot(indices: Column, size: int) -> Column:
    """A row of 0s and one 1 for each index."""
    return F.transform(indices, lambda i: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda j: F.when(i == j, 1).otherwise(0)))
