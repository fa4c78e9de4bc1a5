"""Words of UTF-8 bytes: A-Z in lower case, every byte of what is no word character a blank, long texts in pieces."""

from __future__ import annotations

from collections.abc import Iterator

#: Bytes of a text whose words are held as a list at a time.
PIECE = 4 << 20


def table(digits: bool) -> bytes:
    """For bytes.translate: letters, all bytes from 0x80 on and, if wanted, digits are of words."""

    def to(b: int) -> int:
        if 65 <= b <= 90:
            return b + 32
        return b if b >= 128 or 97 <= b <= 122 or (digits and 48 <= b <= 57) else 32

    return bytes(map(to, range(256)))


LETTERS, LETTERS_AND_DIGITS = table(False), table(True)


def pieces(data: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of translated bytes, in lists of some ``size`` bytes; no word is cut."""
    at = 0
    while at < len(data):
        stop = data.find(b" ", at + size)
        stop = len(data) if stop < 0 else stop
        yield data[at:stop].split()
        at = stop
