"""Words of a text without case, accents, punctuation, markup and marks of quotation."""

from __future__ import annotations

import html
import re
import unicodedata

_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>|<!--[\s\S]*?-->")
_WORD = re.compile(r"[^\W_]+(?:['_][^\W_]+)*")
_MOJIBAKE = re.compile(r"[ÂÃâ]")
_REST = r"[\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]"
_PAIR = re.compile(rf"[ÂÃ]{_REST}|â{_REST}{_REST}")
_QUOTES = str.maketrans({"’": "'", "‘": "'", "ʼ": "'", "´": "'", "`": " "})


def mended(text: str) -> str:
    """Text that was decoded as latin-1 or Windows-1252 although it was UTF-8, read again where all of it allows that."""
    if not _MOJIBAKE.search(text):
        return text

    def again(m: re.Match) -> str:
        run = m.group()
        for encoding in ("cp1252", "latin-1"):
            try:
                return run.encode(encoding).decode("utf-8")
            except UnicodeError:
                continue
        return run

    return _PAIR.sub(again, text)


def unaccented(text: str) -> str:
    """Lower case without accents."""
    text = text.lower()
    if text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def words(text: str | None) -> list[str]:
    """Words in order; null and empty texts have none."""
    if not text:
        return []
    if "&" in text or "<" in text:
        text = html.unescape(_TAG.sub(" ", text))
    return _WORD.findall(unaccented(mended(text)).translate(_QUOTES))
