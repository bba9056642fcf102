"""Column functions of the code graph. All are built from Spark's own functions."""

from .text import binary_content, detect_language, file_hash, ignored, is_test_file, is_test_name, node_text, qualified_name, sanitize_name
from .vector import cosine_similarity

__all__ = ["binary_content", "cosine_similarity", "detect_language", "file_hash", "ignored", "is_test_file", "is_test_name", "node_text", "qualified_name", "sanitize_name"]
