"""Column expressions; all of them run inside the JVM."""

from .quotes import daily_return, row_hash, row_text
from .text import base_name, file_date, normalize, normalize_text

__all__ = ["base_name", "daily_return", "file_date", "normalize", "normalize_text", "row_hash", "row_text"]
