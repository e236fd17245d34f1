"""One consistent form for texts that look the same but differ in their characters.

Compatibility forms are replaced and the result composed (quotation marks and dashes stay as they
are), default-ignorable characters are removed, spaces become U+0020, letters that only look like
those of the rest of their word are replaced by those, and case is fully folded. A text is worked on
once per distinct value of an Arrow batch; ASCII texts only have their case folded.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.runtime import fresh, quoted

# Letters of other scripts that look like Latin ones, column by column; ~ where a script has none.
LATIN = "ABCDEGHIJKLMNOPQSTUVWXYZacdeghijlnopqsuvwxyz"
CYRILLIC = "АВС~Е~НІЈК~М~ОРԚЅТ~Ѵ~ХУ~асԁе~һіјӏ~орԛѕ~ѵԝху~"
GREEK = "ΑΒ~~Ε~ΗΙ~Κ~ΜΝΟΡ~~Τ~~~ΧΥΖα~~~~~ι~~ηορ~~υν~χγ~"
ARMENIAN = "~~~~~~~~~~~~~Օ~~Տ~Ս~~~~~~~~~ցհ~յ~ոօ~զ~ս~~~~~"
CHEROKEE = "ᎪᏴᏟᎠᎬᏀᎻᎥᎫᏦᏞᎷ~~Ꮲ~ᏚᎢ~ᏙᎳ~~Ꮓ~~~~~~~~~~~~~~~~~~~~"
# Default-ignorable characters beside those of the category Cf.
IGNORABLE = re.compile("[\u034f\u115f\u1160\u17b4\u17b5\u180b-\u180f\u2065\u3164\ufe00-\ufe0f\uffa0\ufff0-\ufff8\U000e0000-\U000e0fff]")
# Characters of the category Cf that are visible.
VISIBLE = re.compile("[\u0600-\u0605\u06dd\u070f\u0890\u0891\u08e2\U000110bd\U000110cd]")

_SCRIPTS = {"LATIN": LATIN, "CYRILLIC": CYRILLIC, "GREEK": GREEK, "ARMENIAN": ARMENIAN, "CHEROKEE": CHEROKEE}
# Scripts that one writing system mixes.
_TOGETHER = dict.fromkeys(("CJK", "HIRAGANA", "KATAKANA", "HANGUL", "BOPOMOFO", "IDEOGRAPHIC"), "CJK")
_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|[\u0300-\u036f])*")
_WIDE = ("\uff00", "\uffef")


class Forms:
    """Tables of single characters, filled as characters are met."""

    def __init__(self):
        self.kind: dict[str, str] = {}
        self.plain: dict[str, str] = {}
        self.script: dict[str, str] = {}
        self.ordinary: set[str] = set()
        self.odd: set[str] = set()
        self.alike = {
            (a, b): {x: y for x, y in zip(_SCRIPTS[a], _SCRIPTS[b]) if x != "~" and y != "~"} for a in _SCRIPTS for b in _SCRIPTS if a != b
        }

    def kind_of(self, ch: str) -> str:
        """``ignorable``, ``space``, ``compat`` or empty."""
        k = self.kind.get(ch)
        if k is None:
            cat = unicodedata.category(ch)
            if (cat == "Cf" and not VISIBLE.match(ch)) or IGNORABLE.match(ch):
                k = "ignorable"
            elif cat == "Zs":
                k = "space" if ch != " " else ""
            elif cat in ("Pd", "Pi", "Pf") and not _WIDE[0] <= ch <= _WIDE[1]:
                k = ""
            else:
                k = "compat" if unicodedata.normalize("NFKC", ch) != unicodedata.normalize("NFC", ch) else ""
            self.kind[ch] = k
        return k

    def plain_of(self, ch: str) -> str:
        p = self.plain.get(ch)
        if p is None:
            k = self.kind_of(ch)
            p = "" if k == "ignorable" else " " if k == "space" else unicodedata.normalize("NFKC", ch) if k == "compat" else ch
            self.plain[ch] = p
        return p

    def script_of(self, ch: str) -> str:
        """The script of a letter, empty for what has none."""
        s = self.script.get(ch)
        if s is None:
            s = ""
            c = unicodedata.normalize("NFKC", ch)[:1]
            if c and unicodedata.category(c)[0] == "L":
                s = unicodedata.name(c, "").split(" ")[0].split("-")[0]
                s = "" if s == "MODIFIER" else _TOGETHER.get(s, s)
            self.script[ch] = s
        return s

    def plain_text(self, text: str) -> bool:
        """Does a text hold ordinary characters of at most one script only, each composed? Most do, and this is a matter of sets."""
        chars = set(text)
        new = chars - self.ordinary - self.odd
        for c in new:
            (self.odd if c >= "\x80" and self.kind_of(c) else self.ordinary).add(c)
        return not chars & self.odd and unicodedata.is_normalized("NFC", text) and len({s for s in map(self.script_of, chars) if s}) < 2

    def unusual(self, text: str) -> bool:
        """Does a text hold a compatibility form, an accent apart, an invisible character, another space or mixed scripts?"""
        if text.isascii() or self.plain_text(text):
            return False
        if any(self.kind_of(c) for c in set(text) if c >= "\x80") or not unicodedata.is_normalized("NFC", text):
            return True
        return any(len({s for s in map(self.script_of, w) if s}) > 1 for w in _WORD.findall(text) if not w.isascii())

    def one_script(self, word: str) -> str:
        """A word of several scripts with look-alikes put into the script of most of its letters."""
        found = Counter(s for s in map(self.script_of, word) if s)
        if len(found) < 2:
            return word
        for target in sorted(found, key=lambda s: (-found[s], s)):
            new = "".join(c if self.script_of(c) in ("", target) else self._as(c, target) for c in word)
            if len({s for s in map(self.script_of, new) if s}) == 1:
                return new
        return word

    def _as(self, ch: str, target: str) -> str:
        """A letter's look-alike in another script, accents kept; the letter itself if there is none."""
        table = self.alike.get((self.script_of(ch), target), {})
        base, *marks = unicodedata.normalize("NFD", ch)
        return unicodedata.normalize("NFC", table[base] + "".join(marks)) if base in table else ch

    def normal(self, text: str, fold: bool = True) -> str:
        if not text.isascii() and not self.plain_text(text):
            text = unicodedata.normalize("NFC", "".join(map(self.plain_of, text)))
            text = _WORD.sub(lambda m: m.group() if m.group().isascii() else self.one_script(m.group()), text)
        if fold:
            text = unicodedata.normalize("NFC", text.casefold())
        return text


def unify(df: DataFrame, columns: Sequence[str], *, fold: bool = True) -> DataFrame:
    """``df`` with ``<column>_unified`` (text) and ``<column>_unusual`` (boolean) for each column.

    Null stays null and is not unusual; the empty text stays empty; whole texts are read whatever
    their length. Tabs and line breaks are ordinary and stay. Words of several scripts that no
    replacement of look-alikes brings into one stay as they are. Taken names get a numbered suffix.
    """
    names = fresh(df.columns, *[f"{c}_{x}" for c in columns for x in ("unified", "unusual")])
    fields = T.StructType(df.schema.fields + [T.StructField(n, T.StringType() if i % 2 == 0 else T.BooleanType()) for i, n in enumerate(names)])
    at = [df.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms = Forms()
        for b in batches:
            new = []
            for i in at:
                coded = b.column(i).dictionary_encode()
                values = coded.dictionary.to_pylist()
                for kind, done in ((pa.string(), [forms.normal(v, fold) for v in values]), (pa.bool_(), [forms.unusual(v) for v in values])):
                    column = pa.array(done, kind).take(coded.indices) if done else pa.nulls(len(coded), kind)
                    new.append(column if kind == pa.string() else column.fill_null(False))
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[f.name for f in fields])

    return df.mapInArrow(run, fields)


def unusual_cells(df: DataFrame, id_column: str, columns: Sequence[str]) -> DataFrame:
    """(row_id, column_name, original, unified) of the unusual cells only."""
    # ASCII texts are ordinary and need not leave the JVM.
    odd = reduce(lambda a, b: a | b, [quoted(c).rlike(r"[^\x00-\x7f]") for c in columns])
    d = unify(df.where(odd).select(quoted(id_column).alias("row_id"), *[quoted(c) for c in columns]), columns)
    cells = F.array(
        *[
            F.when(F.col(f"{c}_unusual"), F.struct(F.lit(c).alias("column_name"), quoted(c).alias("original"), F.col(f"{c}_unified").alias("unified")))
            for c in columns
        ]
    )
    return d.select("row_id", F.explode(F.array_compact(cells)).alias("c")).select("row_id", "c.*")
