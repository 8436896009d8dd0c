"""Terms of texts: runs of bytes that are no ASCII delimiter, A-Z lower-cased.

All delimiters are ASCII, so UTF-8 bytes can be mapped without decoding; every
delimiter becomes one space.
"""

from __future__ import annotations


def byte_table(kept: bytes) -> bytes:
    """A translation that keeps bytes from 128 on and ``kept``, lower-cases A-Z and turns the rest into spaces."""
    out = bytearray(b" " * 128 + bytes(range(128, 256)))
    for b in kept:
        out[b] = b + 32 if 65 <= b <= 90 else b
    return bytes(out)


LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: Letters and all that is not ASCII.
LETTER_TABLE = byte_table(LETTERS)
#: Digits too.
DIGIT_TABLE = byte_table(LETTERS + b"0123456789")


def plain(text: str | None, table: bytes) -> bytes:
    """The text with delimiters as spaces; null is empty."""
    return (text or "").encode().translate(table)
