"""Encodings by their rules and common signs."""

import pytest

from quillmill.sources.parsers.charsets import multi_byte, single_byte
from quillmill.sources.parsers.texts import decode

TEXTS = {
    "big5": "這是一個用來測試編碼的文字檔案,裡面有許多常用的中文字。今天的天氣很好,我們一起去公園散步吧。",
    "gb18030": "这是一个用来测试编码的文本文件，里面有许多常用的中文字。今天天气很好，我们一起去公园散步吧。",
    "euc_kr": "이것은 인코딩을 시험하기 위한 글입니다. 오늘은 날씨가 매우 좋아서 우리는 공원에 산책하러 갑니다.",
    "shift_jis": "これは文字コードを調べるための文章です。今日は天気がとても良いので、公園へ散歩に行きましょう。",
    "euc_jp": "これは文字コードを調べるための文章です。今日は天気がとても良いので、公園へ散歩に行きましょう。",
}
WESTERN = "Les élèves étaient très heureux à l’école. Für die Mädchen gab es größere Äpfel. El niño comió piña."
RUSSIAN = "Это простой текст на русском языке, который нужен для проверки кодировки. Сегодня хорошая погода."


@pytest.mark.parametrize("name", TEXTS)
def test_multi_byte_texts(name):
    for text in (TEXTS[name], TEXTS[name] * 40, "An English heading\n\n" + TEXTS[name], TEXTS[name][:20]):
        got, how = decode(text.encode(name))
        assert (got, how) == (text, {"encoding": name})


def test_western_text_is_never_taken_for_chinese():
    for name in ("cp1252", "latin-1", "cp1250"):
        for text in ("Die Äpfel und Öfen für größere Mädchen", "año niño señor mañana", "Él comió piñas; già è città perché", "naïve café", "é"):
            assert multi_byte(text.encode(name, "replace")) is None, (name, text)
    got, how = decode(WESTERN.encode("cp1252"))
    assert got == WESTERN and how == {"encoding": "cp1252", "encoding_verified": False}
    plain = WESTERN.replace("’", "'")
    got, how = decode(plain.encode("latin-1"))
    assert got == plain and how == {"encoding": "latin-1", "encoding_verified": False, "lossy_decode": True}


@pytest.mark.parametrize("name", ["cp1251", "koi8_r"])
def test_cyrillic(name):
    assert single_byte(RUSSIAN.encode(name)) == name and decode(RUSSIAN.encode(name))[0] == RUSSIAN


def test_marks_and_utf8_come_first():
    text = TEXTS["gb18030"]
    for name in ("utf-8", "utf-8-sig", "utf-16"):
        assert decode(text.encode(name))[0] == text and "encoding_verified" not in decode(text.encode(name))[1]
    assert decode(b"") == ("", {"encoding": "utf-8"}) and decode(b"plain")[1] == {"encoding": "utf-8"}
    broken = "valid for long " * 200 + "x"
    assert decode(broken.encode() + b"\xff\xfe\x81")[1]["encoding_verified"] is False  # a valid start does not decide
