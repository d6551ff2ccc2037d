"""The words and the form of a text, from its bytes; apart from mixing, so that workers need not import spark.ml."""

from __future__ import annotations

import string

#: ASCII punctuation as spaces; bytes of other letters are never ASCII.
_PLAIN = bytes(32 if chr(c) in string.punctuation else c for c in range(256))


def shape(raw: bytes) -> tuple[set[bytes], float, float]:
    """_words, _marks and _repeats of mixing._shaped, of a text in UTF-8."""
    if raw.isascii():
        size, low = len(raw), raw.lower()
    else:
        text = raw.decode("utf-8", "replace")
        size, low = len(text), text.lower().encode()
    own = set(low.translate(_PLAIN).split())  # of bytes: at ASCII's six spaces, as \s
    own.add(b"")
    marks = (len(raw) - len(raw.translate(None, b"#$%&*|"))) / max(size, 1)
    parts = raw.split(b" ")
    distinct = sum(len(set(parts[at : at + 100])) for at in range(0, len(parts), 100))
    return own, min(marks * 10, 2.0), (1.0 - distinct / len(parts)) * 2
