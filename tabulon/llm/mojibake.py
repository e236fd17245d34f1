"""Text that was decoded with the wrong character encoding: where it is, and what it was.

A hidden Markov model reads a text character by character. It has one clean state and one state per
encoding pair (written in the one, read in the other). The clean state emits a character with its
frequency in the corpus; the state of a pair emits a run of characters with the frequency of the text
that the pair's inverse transform makes of it, and nothing that the transform rejects. ASCII is the
same in all states. Where a pair turns letters into letters of the same alphabet, words are weighed by
the frequency of their letter pairs without case instead, as single letters tell too little. The most probable path labels every character, and each labelled span is put
through its state's inverse transform, again and again where text was garbled more than once.

The character frequencies are counted over all cells, then once more over the cells as restored by
the first model, so that frequent garbles do not pass for ordinary text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.errors import EngineError
from tabulon.runtime import fresh, quoted

# The encodings that UTF-8 is commonly mistaken for, one byte a character.
SINGLE = ("latin-1", "cp1252", "mac_roman", "cp437", "cp850", "cp1251")
_UTF8 = re.compile(
    "(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    "|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})+"
)
_DOUBLE = re.compile("(?:[\x81-\xfe][\x40-\x7e\x80-\xfe]|[\x81-\xfe][0-9][\x81-\xfe][0-9])+")
# Words of nothing but the letters that Cyrillic turns into, read one byte a character.
_CYRILLIC = re.compile(r"(?<![^\W\d_])[\xc0-\xff\xa8\xb8]+(?![^\W\d_])")
# Words of Cyrillic letters, and of what they turn into, for the two encodings that hold them in another order.
_LETTERS = re.compile(r"(?<![^\W\d_])[\u0401\u0406\u0408\u0410-\u044f\u0451\u0456]+(?![^\W\d_])")
_ORDERS = (("koi8-r", "cp1251"), ("cp1251", "koi8-r"))
_LOST = "\ufffd"


def _table(encoding: str) -> dict[int, str]:
    """Character to byte, bytes written as the characters of their number; undefined bytes stand for themselves."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            ch = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            ch = chr(b)
        out[ord(ch)] = chr(b)
    return out


def _class(chars: set[str]) -> str:
    return "[" + "".join(re.escape(c) for c in sorted(chars)) + "]"


def _filters() -> tuple[re.Pattern, re.Pattern]:
    """Texts without a lead and a continuation in some pair, or without two neighbours that can be bytes, need no look."""
    tables = [_table(e) for e in SINGLE]
    lead = {chr(c) for t in tables for c, b in t.items() if "\xc2" <= b <= "\xf4"}
    rest = {chr(c) for t in tables for c, b in t.items() if b <= "\xbf"}
    high = {chr(c) for t in tables[:2] for c in t}
    return re.compile(_class(lead) + _class(rest)), re.compile(f"{_class(high)}(?:{_class(high)}|[0-9]{_class(high)}[0-9])")


class _Bytes(dict):
    """A translation table that turns what the encoding lacks into NUL."""

    def __missing__(self, k: int) -> str:
        v = self[k] = chr(k) if k < 0x80 else "\0"
        return v


def _wide_runs(text: str) -> Iterator[tuple[int, int, str]]:
    """Runs read in the double-byte encoding that are well-formed UTF-8 as bytes."""
    for m in re.finditer("[^\x00-\x7f\ufffd]+", text):
        run = m.group()
        if max(run) < "\u2e80":
            continue
        try:
            fixed = run.encode("gb18030").decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            continue
        yield m.start(), m.end(), fixed


class Garble:
    """The model: log frequencies of characters, and the search for the best path."""

    def __init__(self, counts: Counter, enter: float = 1e-3, leave: float = 0.05, mixed: float = 6.0):
        single = {c: n for c, n in counts.items() if len(c) == 1}
        total = sum(single.values()) + 1.0
        blocks: Counter = Counter()
        for ch, n in single.items():
            blocks[ord(ch) >> 7] += n
        self.total, self.counts, self.blocks = total, single, dict(blocks)
        self.two = {c: n for c, n in counts.items() if len(c) == 2}
        self.one: dict[str, int] = {}
        for c, n in self.two.items():
            self.one[c[0]] = self.one.get(c[0], 0) + n
        self.enter, self.stay, self.leave, self.keep = math.log(enter), math.log(1 - enter), math.log(leave), math.log(1 - leave)
        self.mixed = mixed
        self._memo: dict[str, float] = {}
        self._words: dict[str, list] = {}
        self._tables: list[_Bytes] | None = None
        self._pairs, self._neighbours = _filters()

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_memo": {}, "_words": {}, "_tables": None}

    def log(self, ch: str) -> float:
        """Log frequency of a character, one in ten of it from its block of 128."""
        v = self._memo.get(ch)
        if v is None:
            p = 0.9 * self.counts.get(ch, 0) / self.total + 0.1 * (self.blocks.get(ord(ch) >> 7, 0) + 1e-3) / self.total / 128
            v = self._memo[ch] = math.log(p)
        return v

    def score(self, text: str) -> float:
        return sum(map(self.log, text))

    def word(self, word: str) -> float:
        """Log frequency of a word's letter pairs without case."""
        w = " " + word.casefold()
        return sum(math.log((self.two.get(a + b, 0) + 0.05) / (self.one.get(a, 0) + 2.0)) for a, b in zip(w, w[1:]))

    def reordered(self, text: str) -> Iterator[tuple[int, int, int, str, float]]:
        """(state, start, end, text before, gain) of words that another order of letters makes likelier or not."""
        for m in _LETTERS.finditer(text):
            w = m.group()
            known = self._words.get(w)
            if known is None:
                if len(self._words) > 100_000:
                    self._words.clear()
                known = self._words[w] = self._orders(w)
            for k, fixed, gain in known:
                yield k, m.start(), m.end(), fixed, gain

    def _orders(self, w: str) -> list[tuple[int, str, float]]:
        out = []
        for k, (written, read) in enumerate(_ORDERS):
            try:
                fixed = w.encode(read).decode(written)
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
            if fixed.isalpha():
                out.append((len(SINGLE) + 5 + k, fixed, self.word(fixed) - self.word(w)))
        return out

    def segments(self, text: str) -> list[tuple[int, int, int, str]]:
        """(state, start, end, text before it was garbled) of every run that some pair can have made."""
        if self._tables is None:
            self._tables = [_Bytes(_table(e)) for e in SINGLE]
        out = []
        single, double = self._pairs.search(text) is not None, self._neighbours.search(text) is not None
        for k, table in enumerate(self._tables, 1):
            if not single and not (double and k <= 2):
                continue
            raw = text.translate(table)
            for m in _UTF8.finditer(raw) if single else ():
                fixed = m.group().encode("latin-1").decode("utf-8")
                while True:  # garbled more than once in the same way; every step is shorter
                    deeper = _UTF8.sub(lambda x: x.group().encode("latin-1").decode("utf-8"), fixed.translate(table))
                    if "\0" in deeper or len(deeper) >= len(fixed) or self.score(deeper) <= self.score(fixed):
                        break
                    fixed = deeper
                out.append((k, m.start(), m.end(), fixed))
            if double and k <= 2:
                # Double-byte text read in this encoding, one character a byte.
                for m in _DOUBLE.finditer(raw):
                    try:
                        out.append((len(SINGLE) + 1 + k, m.start(), m.end(), m.group().encode("latin-1").decode("gb18030")))
                    except UnicodeDecodeError:
                        continue
        if double:
            for m in _CYRILLIC.finditer(text):
                out.append((len(SINGLE) + 4, m.start(), m.end(), m.group().encode("latin-1").decode("cp1251")))
        if not max(text) >= "\u2e80":
            return out
        out += [(len(SINGLE) + 1, i, j, fixed) for i, j, fixed in _wide_runs(text)]
        return out

    def label(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, restored) of the spans that the most probable path puts into a garbled state."""
        segs = self.segments(text)
        words = list(self.reordered(text)) if _LETTERS.search(text) else []
        if not segs and not any(gain > 0 for *_, gain in words):
            return []
        states = len(SINGLE) + 5 + len(_ORDERS)
        n = len(text)
        emit: list[dict[int, float]] = [{} for _ in range(n)]
        part: dict[tuple[int, int], tuple[int, int, str]] = {}
        for k, i, j, fixed in segs:
            each = self.score(fixed) / (j - i)
            for t in range(i, j):
                emit[t][k] = each
                part[k, t] = (i, j, fixed)
        for k, i, j, fixed, gain in words:
            for t in range(i, j):
                emit[t][k] = self.log(text[t]) + gain / (j - i)
                part[k, t] = (i, j, fixed)
        ends = {j for _, _, j, _ in segs}
        score = [0.0] + [self.enter] * (states - 1)
        back: list[list[int]] = []
        for t, ch in enumerate(text):
            if t and ch < "\x80" and text[t - 1] < "\x80" and not emit[t] and t not in ends:
                back.append(list(range(states)))
                continue
            here = emit[t]
            clean = self.log(ch)
            if ch >= "\u2e80":
                for side in (t - 1, t + 1):
                    if 0 <= side < n and text[side].isalpha() and text[side] < "\u2e80":
                        clean -= self.mixed
            best_k = max(range(1, states), key=score.__getitem__)
            step, new = [0] * states, [0.0] * states
            stay, come = score[0] + self.stay, score[best_k] + self.leave
            step[0], new[0] = (0, stay) if stay >= come else (best_k, come)
            new[0] += clean
            for k in range(1, states):
                stay, come = score[k] + self.keep, score[0] + self.enter
                step[k], new[k] = (k, stay) if stay >= come else (0, come)
                new[k] += here[k] if k in here else clean if ch < "\x80" else -60.0
            score = new
            back.append(step)
        k = max(range(states), key=score.__getitem__)
        path = [0] * n
        for t in range(n - 1, -1, -1):
            path[t] = k
            k = back[t][k]
        out, t = [], 0
        while t < n:
            k = path[t]
            if k and (k, t) in part:
                i, j, fixed = part[k, t]
                if i == t and all(x == k for x in path[i:j]):
                    out.append((i, j, fixed))
                    t = j
                    continue
            t += 1
        return out

    def restore(self, text: str) -> tuple[str, bool]:
        """(the text with every labelled span restored, again until nothing is labelled; was anything garbled). Lost characters stay."""
        garbled, seen = _LOST in text, {text}
        while not text.isascii():
            spans = self.label(text)
            if not spans:
                break
            garbled = True
            done, at = [], 0
            for i, j, fixed in spans:
                done += [text[at:i], fixed]
                at = j
            text = "".join([*done, text[at:]])
            if text in seen:  # two orders of the letters that look each better from the other
                break
            seen.add(text)
        return text, garbled


class _Restored(dict):
    """Texts restored so far in a task; equal ones are labelled once. Emptied when large."""

    def __init__(self, model: Garble, most: int = 50_000):
        self.model, self.most = model, most

    def __missing__(self, text: str) -> tuple[str, bool]:
        if len(self) >= self.most:
            self.clear()
        done = self[text] = (text, False) if text.isascii() else self.model.restore(text)
        return done


_WIDEST = 0x110000


class _Letters:
    """Tables by code point: is it a letter, is it one of the Cyrillic letters of ``_LETTERS``."""

    def __init__(self):
        self.alpha, self.known = np.zeros(_WIDEST, bool), np.zeros(_WIDEST, bool)
        self.own = np.zeros(_WIDEST, bool)
        self.own[[c for c in range(0x400, 0x460) if _LETTERS.fullmatch(chr(c))]] = True

    def isalpha(self, codes: np.ndarray) -> np.ndarray:
        new = np.unique(codes[~self.known[codes]])
        self.alpha[new] = [chr(c).isalpha() for c in new]
        self.known[new] = True
        return self.alpha[codes]


def count_characters(texts: Sequence[str], weights: Sequence[int], letters: _Letters | None = None) -> Counter:
    """How often each character occurs, and each pair of letters (or of a space and the first letter) of words of Cyrillic letters without case."""
    letters = letters or _Letters()
    total: Counter = Counter()
    if not texts:
        return total
    n = np.array([len(t) for t in texts])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    seen, back = np.unique(codes, return_inverse=True)
    for c, m in zip(seen.tolist(), np.bincount(back, np.repeat(np.array(weights, float), n)).tolist()):
        total[chr(c)] += int(m)
    folded = [(" " + t.casefold() + " ", w) for t, w in zip(texts, weights) if not t.isascii()]
    if not folded:
        return total
    codes = np.frombuffer("".join(t for t, _ in folded).encode("utf-32-le", "surrogatepass"), np.uint32)
    own = letters.own[codes]
    if not own.any():
        return total
    each = np.repeat([float(w) for _, w in folded], [len(t) for t, _ in folded])
    alpha = letters.isalpha(codes)
    # Runs of Cyrillic letters, but not those that other letters touch. Texts begin and end with a space.
    edge = np.diff(own.astype(np.int8), prepend=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    alone = ~alpha[start - 1] & ~alpha[end]
    start, end = start[alone], end[alone]
    at = np.repeat(start - np.concatenate(([0], np.cumsum(end - start)[:-1])), end - start) + np.arange(int((end - start).sum()))
    before = codes[at - 1].astype(np.int64)
    before[np.isin(at, start)] = ord(" ")
    pairs, back = np.unique(before * _WIDEST + codes[at], return_inverse=True)
    for c, m in zip(pairs.tolist(), np.bincount(back, each[at]).tolist()):
        total[chr(c // _WIDEST) + chr(c % _WIDEST)] += int(m)
    return total


def _count(df: DataFrame, columns: Sequence[str], model: Garble | None) -> Counter:
    """How often each character, and each pair of Cyrillic letters, occurs in all cells, as they are or as restored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        letters, restored = _Letters(), _Restored(model) if model is not None else None
        for b in batches:
            for c in b.columns:
                found = [(v, n) for v, n in zip(*(x.to_pylist() for x in c.value_counts().flatten())) if v]
                texts = [v if restored is None else restored[v][0] for v, _ in found]
                total.update(count_characters(texts, [n for _, n in found], letters))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["c", "n"])

    found = df.select(*[quoted(c) for c in columns]).mapInArrow(run, "c string, n long").groupBy("c").agg(F.sum("n").alias("n")).collect()
    return Counter({r["c"]: r["n"] for r in found})


def fit(tables: Sequence[tuple[DataFrame, Sequence[str]]], rounds: int = 1) -> Garble:
    """Character frequencies of all cells of all tables, then ``rounds`` times of the cells as restored.

    What comes to the driver is one row per distinct character and pair of Cyrillic letters.
    """
    if not tables:
        raise EngineError("At least one table is required.")
    model = None
    for _ in range(rounds + 1):
        counts: Counter = Counter()
        for df, columns in tables:
            counts += _count(df, columns, model)
        model = Garble(counts)
    return model


def restore_text(df: DataFrame, columns: Sequence[str], model: Garble) -> DataFrame:
    """``df`` with ``<column>_restored`` (text) and ``<column>_garbled`` (boolean) for each column.

    Null stays null and is not garbled; empty and ASCII texts stay as they are. A text with U+FFFD is
    garbled, and what was lost there is not restored. Whole texts are read, whatever their length, and
    equal texts of a task are labelled once. New names that are taken get a numbered suffix.
    """
    names = fresh(df.columns, *[f"{c}_{x}" for c in columns for x in ("restored", "garbled")])
    fields = T.StructType(df.schema.fields + [T.StructField(n, T.StringType() if i % 2 == 0 else T.BooleanType()) for i, n in enumerate(names)])
    at = [df.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restored = _Restored(model)
        for b in batches:
            new = []
            for i in at:
                coded = b.column(i).dictionary_encode()
                done = [restored[v] for v in coded.dictionary.to_pylist()]
                for kind, values in ((pa.string(), [x[0] for x in done]), (pa.bool_(), [x[1] for x in done])):
                    column = pa.array(values, kind).take(coded.indices) if done else pa.nulls(len(coded), kind)
                    new.append(column if kind == pa.string() else column.fill_null(False))
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[f.name for f in fields])

    return df.mapInArrow(run, fields)


def garbled_cells(df: DataFrame, id_column: str, columns: Sequence[str], model: Garble) -> DataFrame:
    """(row_id, column_name, restored) of the garbled cells only."""
    # ASCII texts are never garbled and need not leave the JVM.
    odd = reduce(lambda a, b: a | b, [quoted(c).rlike(r"[^\x00-\x7f]") for c in columns])
    d = restore_text(df.where(odd).select(quoted(id_column).alias("row_id"), *[quoted(c) for c in columns]), columns, model)
    cells = F.array(
        *[
            F.when(F.col(f"{c}_garbled"), F.struct(F.lit(c).alias("column_name"), F.col(f"{c}_restored").alias("restored")))
            for c in columns
        ]
    )
    return d.select("row_id", F.explode(F.array_compact(cells)).alias("c")).select("row_id", "c.*")
