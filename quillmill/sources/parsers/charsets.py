"""Which encoding bytes are written in, where neither a mark nor UTF-8 tells.

A multi-byte encoding is a candidate when the whole text decodes strictly by its coding rules, and it is taken when its
pairs of bytes lie where that language's common signs lie: rows of kana and of the first level of kanji, the Hangul
block, the frequent half of Big5, the first level of GB 2312. Those rows are a handful of ranges of lead bytes, so the
model is a count of pairs by lead byte. Single-byte encodings decode anything, so a guess among them is never verified:
Cyrillic ones are told by long runs of high bytes and by where their small letters lie, the rest are Western."""

from __future__ import annotations

from collections import Counter

SAMPLE = 32_768
# Lead bytes of each encoding's common signs (first and last), and of its signs of punctuation.
COMMON = {
    "euc_jp": [(0xA4, 0xA5), (0xB0, 0xCF), (0xA1, 0xA1)],
    "shift_jis": [(0x82, 0x83), (0x88, 0x97), (0x81, 0x81)],
    "euc_kr": [(0xB0, 0xC8), (0xA1, 0xA1)],
    "big5": [(0xA4, 0xC6), (0xA1, 0xA3)],
    "gb18030": [(0xB0, 0xD7), (0xA1, 0xA3)],
}
KANA = {"euc_jp": (0xA4, 0xA5), "shift_jis": (0x82, 0x83)}
ENOUGH = 0.9


def pairs(data: bytes, encoding: str) -> Counter | None:
    """Two-byte signs by (lead, whether the trail byte is below 0xA1); None where the bytes break the coding rules."""
    try:
        text = data.decode(encoding)
    except UnicodeDecodeError:
        return None
    found: Counter = Counter()
    for sign in text[:SAMPLE]:
        raw = sign.encode(encoding, "ignore")
        if len(raw) == 2:
            found[raw[0], raw[1] < 0xA1] += 1
        elif len(raw) > 2:
            found["longer"] += 1
    return found


def share(found: Counter, ranges: list[tuple[int, int]]) -> float:
    held = sum(found.values())
    return sum(n for k, n in found.items() if k != "longer" and any(a <= k[0] <= b for a, b in ranges)) / held if held else 0.0


def multi_byte(data: bytes) -> str | None:
    """The encoding whose common signs the text is made of: Japanese by its kana first, then Korean, whose Hangul is a
    part of the rows that Chinese uses, then Big5 by its low trail bytes, then GB 18030."""
    known = {e: found for e in COMMON if (found := pairs(data, e)) and sum(found.values()) >= 2}
    for e in ("euc_jp", "shift_jis"):
        if e in known and share(known[e], [KANA[e]]) >= 0.2 and share(known[e], COMMON[e]) >= ENOUGH:
            return e
    if "euc_kr" in known and share(known["euc_kr"], COMMON["euc_kr"]) >= 0.97 and share(known["euc_kr"], COMMON["euc_kr"][:1]) >= 0.7:
        return "euc_kr"
    if "big5" in known:
        low = sum(n for k, n in known["big5"].items() if k != "longer" and k[1]) / sum(known["big5"].values())
        if low >= 0.15 and share(known["big5"], COMMON["big5"]) >= ENOUGH and share(known.get("gb18030", Counter()), COMMON["gb18030"]) < ENOUGH:
            return "big5"
    if "gb18030" in known:
        high = sum(n for k, n in known["gb18030"].items() if k == "longer" or not k[1]) / sum(known["gb18030"].values())
        if high >= 0.5:  # Western text read as GB 18030 has its own letters as trail bytes, which are low
            return "gb18030"
    return None


def single_byte(data: bytes) -> str:
    """An unverified guess."""
    sample = data[:SAMPLE]
    high = [b for b in sample if b >= 0x80]
    runs = sum(a >= 0xC0 and b >= 0xC0 for a, b in zip(sample, sample[1:]))
    if len(high) >= 8 and runs >= 0.5 * len(high):
        low, upper = sum(0xC0 <= b <= 0xDF for b in high), sum(b >= 0xE0 for b in high)
        return "koi8_r" if low > upper else "cp1251"
    undefined = {0x81, 0x8D, 0x8F, 0x90, 0x9D}  # fixed values: bytes without a sign in cp1252
    return "cp1252" if any(0x80 <= b <= 0x9F for b in high) and not undefined & set(high) else "latin-1"
