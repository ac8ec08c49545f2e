"""Words for comparing texts with templates and benchmarks."""

from __future__ import annotations

#: ASCII letters and digits stay (A-Z lower-cased), other ASCII becomes a space, other bytes belong to words.
_TABLE = bytes(i + 32 if 65 <= i <= 90 else i if i >= 128 or 48 <= i <= 57 or 97 <= i <= 122 else 32 for i in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()
