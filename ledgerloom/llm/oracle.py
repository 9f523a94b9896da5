"""SQL of the queries in this folder that DuckDB can express."""

from __future__ import annotations

from .forms import CONTROLS, IGNORABLE
from .split import MAX_TOKENS


def _class(characters: str) -> str:
    """Characters and ranges of a character class as escapes."""
    return "".join(c if c == "-" else f"\\x{{{ord(c):X}}}" for c in characters)


_WORD = r"[\p{L}\p{N}_]"
_SPACES = r"\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_TOKEN = rf"{_WORD}+(?:[-''’]{_WORD}+)*|[^\p{{L}}\p{{N}}_{_SPACES}{_class(IGNORABLE)}{_class(CONTROLS)}]"

ORACLE: dict[str, str] = {
    "p1_found": f"SELECT id AS chunk_id FROM chunk WHERE len(regexp_extract_all(text, '{_TOKEN}')) > {MAX_TOKENS}",
}
