"""Column functions of the library, for use outside the named queries as well."""

from setloom.functions.numbers import affine, camelot_distance, correlation, cosine, grid_snap, log_ratio
from setloom.functions.text import clean_name, own_music, record_key, split_title, word_overlap

__all__ = ["affine", "camelot_distance", "clean_name", "correlation", "cosine", "grid_snap", "log_ratio", "own_music", "record_key", "split_title", "word_overlap"]
