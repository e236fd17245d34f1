import unicodedata

import pytest

from tabulon.llm.lookalikes import Forms, unify, unusual_cells


@pytest.fixture(scope="module")
def forms():
    return Forms()


@pytest.mark.parametrize(
    "text",
    ["Ｔａｘ", "５ apples", "coﬆ", "été", "zero​width", "soft­hyphen", "no break", "thin space", "　ideographic", "﻿mark", "pаypal", "Мушюв Mушюв", "αb", "№ 5", "x²", "Ω"],
)
def test_unusual(forms, text):
    assert forms.unusual(text)


@pytest.mark.parametrize("text", ["", "plain", "Ångström", "“quoted” – it’s", "tab\tand\r\nbreak", "лист Doe 样本", "第 1 号", "a-б", "naïve", "½".replace("½", "1/2")])
def test_ordinary(forms, text):
    assert not forms.unusual(text)
    assert forms.normal(text, fold=False) == text


def test_normal_form(forms):
    assert forms.normal("Ｔáx ​5") == "táx 5"
    assert forms.normal("pаypаl") == "paypal"
    assert forms.normal("Mушюв") == "мушюв"
    assert forms.normal("n\u04e7tig") == "nötig"
    assert forms.normal("Straße “X” – Y") == "strasse “x” – y"
    assert forms.normal("Ångström") == "ångström"


def test_normal_is_stable(forms):
    for text in ["Ｔａｘ", "é a‍b", "coﬆ", "ΑΒΓ", "İstanbul", "ẞ", "ﷺ"]:
        once = forms.normal(text)
        assert forms.normal(once) == once
        assert unicodedata.is_normalized("NFC", once)


def test_tables(rows, tuples):
    t = rows([(1, "Ｔax", None, 1), (2, None, "a​b", 2), (3, "", "ok", 3), (4, "x" * 200_000 + " ", "Ｔax", 4), (4, "dup", "Ｔax", 4)], "id long, name string, note string, name_unified int")
    out = unify(t, ["name", "note"])
    assert out.columns == ["id", "name", "note", "name_unified", "name_unified_1", "name_unusual", "note_unified", "note_unusual"]
    got = tuples(unusual_cells(t, "id", ["name", "note"]), "row_id", "column_name")
    assert got == sorted([(1, "name"), (2, "note"), (4, "name"), (4, "note"), (4, "note")], key=repr)
    assert unify(t.limit(0), ["name"]).count() == 0


def test_more_scripts_and_writing_systems():
    from tabulon.llm.lookalikes import Forms

    f = Forms()
    for odd, plain in (("\u0501og", "dog"), ("\u04cfove", "love"), ("\u13aapple", "apple"), ("w\u0585rd", "word")):
        assert f.unusual(odd) and f.normal(odd) == plain
    for fine in ("\u65e5\u672c\u306e\u4f1a\u793e", "\u5927\u97d3\ubbfc\uad6d", "\u041c\u043e\u0441\u043a\u0432\u0430 \u043d\u0435 Moscow", "na\u00efve caf\u00e9"):
        assert not f.unusual(fine)
