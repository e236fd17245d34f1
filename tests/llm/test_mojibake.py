from collections import Counter
import random

import pytest

from tabulon.llm.mojibake import _LETTERS, Garble, _count, fit, garbled_cells, restore_text

CLEAN = [
    "Gerät läuft, Rückfrage nötig",
    "relevé vérifié près du marché",
    "seção já está em revisão, sem alteração",
    "лист передан в архив, копия у нас",
    "样本需要重新登记。",
    "próbka źle opisana, sprawdzić później",
    "το φύλλο ελέγχθηκε ξανά",
    "“kiln” crossed out – déjà vu",
    "NÃO CONFERIDO: FICHA",
    "plain words only",
    "à revoir : fiche déposée l’été dernier",
]


def misread(text, written, read):
    raw = text.encode(written)
    out = []
    if read in ("gb18030", "utf-8"):
        return raw.decode(read, "replace")
    for b in raw:
        try:
            out.append(bytes([b]).decode(read))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@pytest.fixture(scope="module")
def model():
    from collections import Counter

    rng = random.Random(1)
    counts = Counter()
    for _ in range(300):
        text = rng.choice(CLEAN)
        counts.update(text)
        for w in _LETTERS.findall(text.casefold()):
            counts.update(a + b for a, b in zip(" " + w, w))
    return Garble(counts)


@pytest.mark.parametrize("read", ["latin-1", "cp1252", "mac_roman", "cp437", "cp850", "cp1251", "gb18030"])
def test_utf8_misread_comes_back(model, read):
    for text in CLEAN:
        bad = misread(text, "utf-8", read)
        got, garbled = model.restore(bad)
        assert garbled == (bad != text)
        if "�" not in bad:
            assert got == text, (read, bad)


def test_twice_garbled_parts_and_other_pairs(model):
    twice = misread(misread("Gerät läuft", "utf-8", "cp1252"), "utf-8", "cp1252")
    assert model.restore(twice) == ("Gerät läuft", True)
    mixed = CLEAN[1] + ". " + misread(CLEAN[2], "utf-8", "mac_roman")
    assert model.restore(mixed) == (CLEAN[1] + ". " + CLEAN[2], True)
    assert model.restore(misread("样本需要重新登记。", "gb18030", "cp1252")) == ("样本需要重新登记。", True)
    assert model.restore(misread(CLEAN[3], "cp1251", "latin-1")) == (CLEAN[3], True)
    assert model.restore("G�rard") == ("G�rard", True)


def test_letters_in_another_order(model):
    for written, read in (("koi8-r", "cp1251"), ("cp1251", "koi8-r")):
        bad = misread(CLEAN[3], written, read)
        assert model.restore(bad) == (CLEAN[3], True)
        assert model.restore(f"{CLEAN[0]}. {bad}")[0] == f"{CLEAN[0]}. {CLEAN[3]}"
    for same in (CLEAN[3].upper(), CLEAN[3].swapcase(), CLEAN[3].title()):
        assert model.restore(same) == (same, False)


def test_clean_text_stays(model):
    for text in [*CLEAN, "", "Gîã", "SÃO PAULO", "Ångström", "样本", "FUHÉŠT", "naïve café"]:
        assert model.restore(text) == (text, False)


def test_tables(spark, rows, tuples):
    texts = [(i, t, None) for i, t in enumerate(CLEAN * 20)] + [(1000, misread(CLEAN[0], "utf-8", "cp1252"), "x"), (1001, None, "x"), (1002, "", misread("é", "utf-8", "latin-1"))]
    t = rows(texts, "id long, note string, note_restored string")
    m = fit([(t, ["note", "note_restored"])])
    assert tuples(garbled_cells(t, "id", ["note"], m)) == [(1000, "note", CLEAN[0])]
    out = restore_text(t, ["note"], m)
    assert out.columns == ["id", "note", "note_restored", "note_restored_1", "note_garbled"]
    assert [tuple(r) for r in out.where("id in (1001, 1002)").orderBy("id").select("note_restored_1", "note_garbled").collect()] == [(None, False), ("", False)]
    empty = rows([], "id long, note string")
    assert restore_text(empty, ["note"], m).count() == 0
    assert fit([(empty, ["note"])]).restore("é")[0] == "é"
    assert _count(empty, ["note"], None) == {}


def test_very_long_text(model):
    text = "x" * 200_000 + misread("é", "utf-8", "cp1252") + "y" * 200_000
    assert model.restore(text) == ("x" * 200_000 + "é" + "y" * 200_000, True)


def test_characters_are_counted_as_one_by_one():
    from tabulon.llm.mojibake import _LETTERS, count_characters

    texts = ["\u041f\u0440\u0438\u0432\u0435\u0442 \u043c\u0438\u0440", "abc\u041f\u0440\u0438\u0432\u0435\u0442", "\u043c\u0438\u0440-\u043c\u0438\u0440 x", "", "a\U0001f600", "\u0401\u0436\u00c4 \u0451\u0436"]
    weights = [3, 1, 2, 1, 5, 1]
    want = Counter()
    for t, n in zip(texts, weights):
        for ch in t:
            want[ch] += n
        for w in _LETTERS.findall(t.casefold()):
            for a, b in zip(" " + w, w):
                want[a + b] += n
    assert count_characters(texts, weights) == want


def test_deep_garbles_come_out_whole():
    text = "Jos\u00e9 M\u00fcller, S\u00e3o Paulo"
    plain = "Jos\u00e9 M\u00fcller S\u00e3o Paulo Z\u00fcrich caf\u00e9 " * 500
    model = Garble(Counter(plain))
    deep = text
    for _ in range(6):
        deep = deep.encode("utf-8").decode("latin-1")
    assert model.restore(deep) == (text, True)
