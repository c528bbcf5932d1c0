"""Lines of a page text: cutting, mending, keys that ignore what is filled in, and word units."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import xxhash

# Month names by language, as written beside day or year numbers.
MONTHS = (
    "january february march april may june july august september october november december "
    "jan feb mar apr jun jul aug sep sept oct nov dec "
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre "
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre "
    "januar februar märz juni juli oktober dezember "
    "gennaio febbraio aprile maggio giugno luglio settembre ottobre dicembre "
    "janeiro fevereiro março maio junho julho setembro outubro dezembro "
    "ocak şubat mart nisan mayıs haziran temmuz ağustos eylül ekim kasım aralık "
    "января февраля марта апреля мая июня июля августа сентября октября ноября декабря "
    "січня лютого березня квітня травня червня липня серпня вересня жовтня листопада грудня "
    "يناير فبراير مارس أبريل مايو يونيو يوليو أغسطس سبتمبر أكتوبر نوفمبر ديسمبر "
    "ژانویه فوریه آوریل مه ژوئن ژوئیه اوت سپتامبر اکتبر نوامبر دسامبر "
    "जनवरी फरवरी मार्च अप्रैल मई जून जुलाई अगस्त सितंबर अक्टूबर नवंबर दिसंबर"
).split()
FILLED = {m.upper().casefold() for m in MONTHS} | {"am", "pm"}
_FAR_DIGITS = "".join(c for c in map(chr, range(128, 0x20000)) if c.isdecimal())
#: Digits beyond ASCII, those of the first plane apart: a set of higher ones is slow to search.
_FAR_DIGIT, _HIGH_DIGIT = (re.compile("[" + "".join(c for c in _FAR_DIGITS if (ord(c) > 0xFFFF) is high) + "]") for high in (False, True))


def _leads(letters: Iterable[str]) -> re.Pattern:
    """Leading UTF-8 bytes of letters: a look at bytes spares most searches for the letters."""
    return re.compile(b"[" + b"".join(sorted({c.encode()[:1] for c in letters})) + b"]")


def _without(letters: str) -> bytes:
    """All bytes but the leading ones of letters: what is left of a text without them tells whether a search for the letters is needed."""
    leads = {c.encode()[0] for c in letters}
    return bytes(b for b in range(256) if b not in leads)


_NO_FAR, _NO_HIGH, _NO_DATE = _without(_FAR_DIGITS), _without("\U00010000"), _without("年月日号號時时分秒")
#: Bytes of texts that beyond ASCII have letters only, × and ÷ apart: Latin up to U+017F and Cyrillic.
_LETTERS = bytes({*range(0xC0), *(c.encode()[0] for c in "éāšдя")})
SPACELESS_LEAD = _leads(chr(c) for lo, hi in ((0xE00, 0xFFF), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF)) for c in range(lo, hi + 1))
#: ASCII bytes in lower case, digits as zero characters, zero characters and underscores as blanks; ASCII bytes that are neither letters nor digits (0 stands for what is filled in).
_LOWER = bytes(range(256)).lower()
_HOLED = bytes(0 if 48 <= b < 58 else 32 if b in (0, 95) else b for b in _LOWER)
_NO_WORD = bytes(b for b in range(1, 128) if not chr(b).isalnum())


def _beside(names: Iterable[str]) -> str:
    """A pattern of what is filled in with a name right after it, only other marks between."""
    by: dict[str, list[str]] = {}
    for name in sorted(names):
        by.setdefault(name[0], []).append(name[1:])
    return "\\x00[^\\w\\x00]*(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by.items()) + ")(?!\\w)"


#: Names right after a number, and, in the reversed text, right before one; each for ASCII bytes and for any text.
_NAMES = [m for m in FILLED if m.isalnum()]
_AFTER, _BEFORE = (re.compile(_beside(m[::step] for m in _NAMES)) for step in (1, -1))
_AFTER_ASCII, _BEFORE_ASCII = (re.compile(_beside(m[::step] for m in _NAMES if m.isascii()).encode()) for step in (1, -1))
_NO_LETTER = re.compile(r"[^\w\x00]+")
_CJK_DATE = re.compile(r"(?<=\d)\s*[年月日号號時时分秒]")
#: Marks of a wrong decoding beside the letter Ð: two patterns, as each is sought by its first letters.
_MIS_DECODED = re.compile("[ÃÂâÐÑØÙÛàá][\u0080-¿ŒœŠšŸŽžƒˆ˜–—‘’‚“”„†‡•…‰‹›€™]"), re.compile("[РС][ -џ‚ѓ„…†‡€‰‹‘’“”•–—™›]")
SPACELESS = re.compile("[฀-๿ༀ-࿿ក-៿぀-ヿ㐀-鿿豈-﫿]+")
END = re.compile("[.!?。！？؟।…۔](?=[\"'”’»」』）)\\]]*(?:\\s|$)|[^\\x00-\\x7f])")
_KEYS: dict[str, str] = {}


def _mis_decoded(text: str) -> bool:
    a, b = _MIS_DECODED
    return not text.isascii() and ("Ð" in text or a.search(text) is not None or b.search(text) is not None)


def mend(text: str) -> str:
    """The text with a wrong single-byte decoding of UTF-8 undone, if there is one; else the text itself."""
    if not _mis_decoded(text):
        return text
    for name in ("latin-1", "cp1252", "cp1251"):
        try:
            return text.encode(name).decode("utf-8")
        except UnicodeError:
            continue
    raw = bytearray()
    for c in text:
        try:
            raw += c.encode("cp1252")
        except UnicodeError:
            if ord(c) > 255:
                return _mend_parts(text)
            raw.append(ord(c))
    try:
        return raw.decode("utf-8")
    except UnicodeError:
        return _mend_parts(text)


def _mend_parts(text: str) -> str:
    """Word-wise mending for texts of which only parts were decoded wrongly."""
    out = []
    for word in text.split(" "):
        fixed = word
        if _mis_decoded(word):
            raw = bytearray()
            for c in word:
                try:
                    raw += c.encode("cp1252")
                except UnicodeError:
                    raw += bytes([ord(c)]) if ord(c) < 256 else c.encode("utf-8")
            fixed = raw.decode("utf-8", "replace").replace("�", "")
        out.append(fixed)
    return " ".join(out)


def _letters(raw: bytes) -> str:
    """Letters and zero characters of lower-case bytes; '#' for each run of zero characters."""
    raw = raw.translate(None, _NO_WORD)
    if not raw.isascii() and (raw.translate(None, _LETTERS) or b"\xc3\x97" in raw or b"\xc3\xb7" in raw):
        raw = _NO_LETTER.sub("", raw.decode()).encode()
    if b"\x00" in raw:
        while b"\x00\x00" in raw:
            raw = raw.replace(b"\x00\x00", b"\x00")
        raw = raw.replace(b"\x00", b"#")
    return raw.decode()


def _without_names(text, filled, after: re.Pattern, before: re.Pattern):
    """A text or its bytes without the month names and day halves that stand beside what is ``filled`` in."""
    if after.search(text):
        text = after.sub(filled, text)
    back = text[::-1]
    return before.sub(filled, back)[::-1] if before.search(back) else text


def _far_key(text: str) -> str:
    """The key of a folded line with letters beyond ASCII."""
    raw = text.encode()
    if raw.translate(None, _NO_DATE):
        raw = _CJK_DATE.sub(" ", text.replace("\x00", " ")).encode()
    far, high = raw.translate(None, _NO_FAR), raw.translate(None, _NO_HIGH)
    raw = raw.translate(_HOLED)
    if far:
        text = _FAR_DIGIT.sub("\x00", raw.decode())
        raw = (_HIGH_DIGIT.sub("\x00", text) if high else text).encode()
    return _letters(_without_names(raw.decode(), "\x00", _AFTER, _BEFORE).encode() if b"\x00" in raw else raw)


def fresh_key(line: str) -> str:
    """``line_key`` for callers that keep what they make of a line themselves."""
    if line.isascii():
        raw = line.encode().translate(_HOLED)
        return _letters(_without_names(raw, b"\x00", _AFTER_ASCII, _BEFORE_ASCII) if b"\x00" in raw else raw) or line.strip()
    return _far_key(unicodedata.normalize("NFC", line.upper().casefold())) or line.strip()


def line_key(line: str) -> str:
    """What is left of a line without case, spacing, punctuation, dates, times and numbers; '' for a blank line."""
    known = _KEYS.get(line)
    if known is not None:
        return known
    key = fresh_key(line)
    if len(line) < 120:
        if len(_KEYS) > 200_000:
            _KEYS.clear()
        _KEYS[line] = key
    return key


def key_number(key: str) -> int:
    """64-bit hash of a key as a signed number."""
    h = xxhash.xxh64_intdigest(key)
    return h - (1 << 64) if h >= 1 << 63 else h


_MARKS = ".,;:!?\"()«»„“”…؟،।。！？「」『』、，；：‹›—–·•|/#>*[]"
_OTHER_MARKS = re.compile("[" + re.escape("".join(c for c in _MARKS if not c.isascii())) + "]")
#: ASCII bytes in lower case, marks as blanks, digits as 0.
_PLAIN = bytes(32 if b < 128 and chr(b) in _MARKS else 48 if 48 < b < 58 else b for b in _LOWER)


def units(text: str) -> list[str]:
    """Lower-case words; runs of scripts without spaces give their pairs of letters instead."""
    raw = text.encode().translate(_PLAIN)
    if raw.isascii():
        return raw.decode().split()
    words = _OTHER_MARKS.sub(" ", raw.decode()).lower().split()
    if not SPACELESS_LEAD.search(raw) or not SPACELESS.search(text):
        return words
    out: list[str] = []
    for w in words:
        if SPACELESS.search(w):
            for run in SPACELESS.findall(w):
                out += [run[i:i + 2] for i in range(len(run) - 1)] or [run]
        else:
            out.append(w)
    return out
