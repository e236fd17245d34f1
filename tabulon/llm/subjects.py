"""The subject areas of each document, from the sentences it consists of.

Labelling functions vote on the subject of every sentence: the lexicon (how its words speak, with a first and a second
choice), the section (the document's other sentences), the address (the other documents of its bundle) and the
source (the other documents of its source). How far each can be trusted is learnt from how their votes meet, by
expectation maximisation over the counts of vote patterns of all sentences. The lexicon votes as two of
disjoint words, so that its accuracy can be told; the model knows that the last three see the same surroundings. Documents get their subjects from the posterior probabilities of
their sentences.

The lexicon is fitted on a bounded sample of labelled documents, whose labels say only which subjects
occur, and then on all documents, labelled or not: words that keep company with known words join it.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.errors import EngineError
from tabulon.runtime import attach, cut, hashed_share, quoted

NONE = "none"
#: Most labelled documents that the lexicon is first fitted on; more are drawn from by their hash.
LABELLED = 20_000
#: Fewest sentences that speak for a word of the lexicon.
LEAST = 5.0
#: Least share of all sentences that hold a word of the lexicon.
RARE = 1e-5

#: Texts read in one go.
_AT_ONCE = 512

# Marks that end a sentence, those that need no space after them last.
_STOPS, _WIDE_STOPS = ".!?…؟۔।॥።", "。！？។៕။"
_END = re.compile(rf"(?<=[{_STOPS}{_WIDE_STOPS}])[\"'»”“’)\]]*\s+|\n+|(?<=[{_WIDE_STOPS}])")
_SHORT = re.compile(r"(?:^|[\s(«„“\"'’-])[^\W\d_]{1,2}\.$")
_WORD = re.compile(r"[^\W\d_]+")
# Scripts without spaces between words: Thai, Lao, Burmese, Khmer, kana and Han.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff]+")


def sentences(text: str) -> list[str]:
    """A text's sentences; initials and abbreviations of one or two letters do not end one."""
    out, held = [], ""
    for part in _END.split(text):
        part = part.strip()
        if not part:
            continue
        held = f"{held} {part}" if held else part
        if not _SHORT.search(held[-4:]):
            out.append(held)
            held = ""
    if held:
        out.append(held)
    return [s for s in out if any(c.isalnum() for c in s)]


def words(sentence: str) -> set[str]:
    """Words without case; apostrophes and hyphens separate them. Where a script has no spaces, its pairs of characters."""
    text = sentence.casefold()
    found = set(_WORD.findall(text))
    if not text.isascii() and _UNSPACED.search(text):
        found = {w for w in found if not _UNSPACED.search(w)}
        for run in _UNSPACED.findall(text):
            found.update(map("".join, zip(run, run[1:])) if len(run) > 1 else (run,))
    return found


class Lexicon:
    """Subject words and how strongly each speaks for each subject; ``subjects`` ends with "none".

    A word is kept if it keeps to one subject, or to two: words of sentence patterns, names and
    everyday words are spread over all and fall out, so that a sentence without subject words has none.
    """

    def __init__(self, subjects: Sequence[str], counts: dict[str, np.ndarray], least: float, pure: float, smooth: float = 1.0):
        self.subjects = list(subjects)
        k = len(self.subjects) - 1
        names = list(counts)
        n = np.array([counts[w] for w in names], float).reshape(-1, k + 1)
        told = n[:, :k]
        total = told.sum(axis=1)
        prior = (told.sum(axis=0) + 1.0) / (told.sum() + k)
        p = (told + smooth * prior) / (total[:, None] + smooth)
        top = np.sort(p, axis=1)
        keep = (total >= least) & ((top[:, -1] >= pure) | (top[:, -2:].sum(axis=1) >= pure + 0.5 * (1 - pure)))
        keep &= total >= 0.25 * n.sum(axis=1)
        self.row = {names[i]: j for j, i in enumerate(np.flatnonzero(keep))}
        self.llr = np.log(np.maximum(p[keep], 1e-4) / prior).astype(np.float32)
        # Two lexicons of disjoint words, which vote independently of each other.
        self.half = np.array([zlib.crc32(w.encode()) & 1 for w in self.row], int)
        self.prior = prior

    def probabilities(self, sentence: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(subject probabilities, number of words) of n sentences by some of their words, given as ascending sentences and rows."""
        known = np.bincount(sentence, minlength=n)
        at = np.flatnonzero(known)
        out = np.zeros((n, len(self.prior)))
        if len(at):
            x = np.add.reduceat(self.llr[rows].astype(float), np.cumsum(known[at]) - known[at], axis=0) + np.log(self.prior)
            x = np.exp(x - x.max(axis=1, keepdims=True))
            out[at] = x / x.sum(axis=1, keepdims=True)
        return out, known


class _Ids(dict):
    """Numbers of words in the order in which they are met."""

    def __missing__(self, w: str) -> int:
        n = self[w] = len(self)
        return n


class Reading:
    """The sentences of some texts as arrays: whose they are, their words, and what these say.

    ``alone`` has each sentence's subject probabilities by its words, ``post`` with the document's mixture as
    prior, ``known`` its number of subject words; rows of sentences without subject words are 0.
    """

    def __init__(self, lexicon: Lexicon, texts: Sequence[str | None], rounds: int = 3):
        k = len(lexicon.subjects) - 1
        ids, doc, flat, size = _Ids(), [], [], []
        for i, t in enumerate(texts):
            for s in sentences(t) if t else ():
                own = words(s)
                flat.extend(map(ids.__getitem__, own))
                size.append(len(own))
                doc.append(i)
        self.texts, self.vocabulary = len(texts), list(ids)
        self.doc, self.size, self.word = np.array(doc, int), np.array(size, int), np.array(flat, int)
        self.sentence = np.repeat(np.arange(len(doc)), self.size)
        self.row = np.array([lexicon.row.get(w, -1) for w in ids], int)
        rows = self.row[self.word] if len(flat) else np.empty(0, int)
        self.told = rows >= 0
        self.halves = [lexicon.probabilities(self.sentence[m], rows[m], len(doc)) for m in (self.told & (lexicon.half[rows] == h) for h in (0, 1))] if len(lexicon.half) else [(np.zeros((len(doc), k)), np.zeros(len(doc), int))] * 2
        self.known = np.bincount(self.sentence[self.told], minlength=len(doc))
        self.alone, self.post = np.zeros((len(doc), k)), np.zeros((len(doc), k))
        at = np.flatnonzero(self.known)
        if not len(at):
            return
        starts = np.cumsum(self.known[at]) - self.known[at]
        scores = np.add.reduceat(lexicon.llr[rows[self.told]].astype(float), starts, axis=0)
        of = self.doc[at]
        first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        which = np.cumsum(np.concatenate(([False], of[1:] != of[:-1])))
        mixture = np.tile(lexicon.prior, (len(first), 1))
        for n in range(rounds):
            x = scores + np.log(mixture)[which]
            x = np.exp(x - x.max(axis=1, keepdims=True))
            x /= x.sum(axis=1, keepdims=True)
            if not n:
                self.alone[at] = x
            mixture = np.add.reduceat(x, first, axis=0) + lexicon.prior
            mixture /= mixture.sum(axis=1, keepdims=True)
        self.post[at] = x

    def one_subject(self, k: int) -> np.ndarray:
        """Per text the subject of four in five of its sentences that have one, if half have; the place of "none" if there is no such."""
        has = self.known > 0
        n = np.zeros((self.texts, k))
        np.add.at(n, self.doc[has], self.post[has])
        all_, some = np.bincount(self.doc, minlength=self.texts), np.bincount(self.doc[has], minlength=self.texts)
        top = n.max(axis=1, initial=0.0)
        sure = (some > 0) & (top >= 0.8 * n.sum(axis=1)) & (2 * some >= all_)
        return np.where(sure, n.argmax(axis=1), k)


def seed_lexicon(texts: Sequence[str], labels: Sequence[set[str]], subjects: Sequence[str]) -> Lexicon:
    """Words that occur mostly in documents of one subject.

    A document with several subjects counts in part for each, one without for "none".
    """
    names = [*sorted(subjects), NONE]
    at = {s: i for i, s in enumerate(names)}
    counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(names)))
    for text, label in zip(texts, labels):
        mine = [at[x] for x in label if x in at and x != NONE] or [at[NONE]]
        for w in {w for s in sentences(text) for w in words(s)}:
            counts[w][mine] += 1.0 / len(mine)
    return Lexicon(names, counts, least=2.0, pure=0.6)


def word_counts(lexicon: Lexicon, texts: Sequence[str | None], parallel: Sequence[str | None]) -> dict[str, np.ndarray]:
    """Per word, how many sentences of each subject hold it beside another subject word, and of none.

    A sentence without subject words counts for the subject of the parallel text, if that has one
    subject, and for none otherwise; everyday words are spread over all subjects that way. The empty
    word counts all sentences.
    """
    k = len(lexicon.subjects) - 1
    counts: dict[str, np.ndarray] = {}
    total = 0
    for part in range(0, len(texts), _AT_ONCE):
        own = Reading(lexicon, texts[part : part + _AT_ONCE])
        total += len(own.doc)
        # Parallel texts are only read where a sentence has no subject words.
        asks = np.zeros(own.texts, bool)
        asks[own.doc[own.known == 0]] = True
        other = np.full(own.texts, k)
        if asks.any():
            other[asks] = Reading(lexicon, [parallel[part + i] for i in np.flatnonzero(asks)]).one_subject(k)
        has = own.known > 0
        kind = np.where(has, own.post.argmax(axis=1) if k else 0, other[own.doc])
        weight = np.where(has, own.post.max(axis=1, initial=0.0), 1.0)
        # A sentence's only subject word must not speak for itself.
        speaks = (own.known[own.sentence] != 1) | ~own.told
        n = np.bincount(own.word[speaks] * (k + 1) + kind[own.sentence[speaks]], weight[own.sentence[speaks]], len(own.vocabulary) * (k + 1)).reshape(-1, k + 1)
        for w, c in zip(own.vocabulary, n):
            if w in counts:
                counts[w] += c
            else:
                counts[w] = c
    counts[""] = np.append(np.zeros(k), float(total))
    return counts


def fit_lexicon(
    documents: DataFrame, id_column: str, text: str, labels: DataFrame, subjects: Sequence[str], *, parallel: str | None = None, rounds: int = 2
) -> Lexicon:
    """The lexicon from (id, subject) rows of ``labels`` and from all documents; see the module's text.

    Wrong and repeated labels do no harm as long as most are right. What comes to the driver is the
    sample of labelled documents and, per round, the words that keep to their subject and stand in at least
    ``LEAST`` sentences and in one of 1 / ``RARE``: by their share these are at most the mean number
    of words of a sentence over ``RARE``, however large the corpus.
    """
    if not subjects:
        raise EngineError("At least one subject is required.")
    per = labels.where(F.col("subject").isNotNull()).groupBy(quoted(id_column).alias("_id")).agg(F.collect_set("subject").alias("_s"))
    n = per.count()
    share = min(1.0, LABELLED / n) if n else 1.0
    drawn = per.where(hashed_share(F.col("_id"), share))
    told = documents.select(quoted(id_column).alias("_id"), quoted(text).alias("_t")).where("_t is not null").join(drawn, "_id").select("_t", "_s").collect()
    lexicon = seed_lexicon([r["_t"] for r in told], [set(r["_s"]) for r in told], subjects)
    k = len(lexicon.subjects)
    plain = documents.select(quoted(text).alias("t"), (quoted(parallel) if parallel else F.lit(None).cast("string")).alias("p"))
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], lexicon: Lexicon = lexicon) -> Iterator[pa.RecordBatch]:
            for b in batches:
                counts = word_counts(lexicon, b.column(0).to_pylist(), b.column(1).to_pylist())
                n = np.array(list(counts.values()), float).reshape(-1, k)
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array(n[:, i]) for i in range(k))], ["w", *(f"n{i}" for i in range(k))])

        d = plain.mapInArrow(run, "w string, " + ", ".join(f"n{i} double" for i in range(k)))
        d = cut(d.groupBy("w").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(k)]))
        total = d.where("w = ''").agg(F.sum(f"n{k - 1}")).first()[0] or 0.0
        least = max(LEAST, RARE * total)
        each = F.array_sort(F.array(*[F.col(f"n{i}") for i in range(k - 1)]))
        told = sum(F.col(f"n{i}") for i in range(1, k - 1)) + F.col("n0") if k > 2 else F.col("n0")
        two = F.element_at(each, -1) + (F.element_at(each, -2) if k > 2 else F.lit(0.0))
        kept = d.where((F.col("w") != "") & (told >= least) & (told >= 0.2 * (told + F.col(f"n{k - 1}"))) & (two >= 0.7 * told)).toPandas()
        counts = dict(zip(kept["w"], kept[[f"n{i}" for i in range(k)]].to_numpy()))
        lexicon = Lexicon(lexicon.subjects, counts, least=least, pure=0.85)
    return lexicon


#: How one lexicon's words speak in a sentence: clearly, rather for one subject, or for several alike; and neither's at all.
KINDS = ("clear", "leaning", "open", "nothing")
_SILENT = 3
#: The functions that know the surroundings of a sentence.
AROUND = ("section", "address", "source")
#: Initial accuracies: of the first and second choice of each kind, and of the surroundings.
_FIRST, _SECOND, _AROUND = (0.95, 0.75, 0.5, 0.9), (0.03, 0.2, 0.4, 0.0), (0.6, 0.3, 0.2)
#: Votes' worth of trust that each initial accuracy keeps.
_KEPT = 100.0


class Patterns:
    """Vote patterns as whole numbers: both lexicons' kinds, first and second choices, section, address, source; a digit of 0 abstains."""

    def __init__(self, classes: int):
        self.base = classes + 1

    def pack(self, kind: np.ndarray, *votes: np.ndarray) -> np.ndarray:
        code = kind.astype(np.int64)
        for v in votes:
            code = code * self.base + (v + 1)
        return code

    def unpack(self, code: np.ndarray) -> list[np.ndarray]:
        out = []
        for _ in range(7):
            out.append(code % self.base - 1)
            code = code // self.base
        return [code, *out[::-1]]


class LatentModel:
    """Accuracies of the labelling functions and the subjects of sentences behind them, by expectation maximisation.

    The lexicon votes as two, of disjoint words, whose meeting tells how far words can be trusted; their accuracy is that of
    the first and second choice, for each kind of vote. Section, address and source know the same surroundings, so that they are not taken for independent: the model has one joint
    table of which of them agree with each other and which of the agreeing parties is right. Documents
    with labels add a third view, whose error is learnt too: a sentence's subject is one of its document's labels,
    or none, but for some. Every sentence of every document counts.

    Silence meets no other vote on whether there is a subject at all. Its accuracy comes from ``unseen``, how many sentences
    with a subject are likely to have none of their words in the lexicon (``unseen_sentences``).
    """

    def __init__(self, codes: Sequence[int], labels: Sequence[Sequence[int] | None], counts: Sequence[float], classes: int, *, unseen: float | None = None, rounds: int = 100):
        none = classes - 1
        self.pack = Patterns(classes)
        self.n = n = np.array(counts, float)
        kinds, *votes = self.pack.unpack(np.array(codes, np.int64))
        around = votes[4:]
        c = np.arange(classes)[None, :]
        # Lexicons: groups by kind and by whether there is a second choice; states first, second, other. Silent ones leave
        # no trace, but for both together, which is a vote for no subject.
        silent = (kinds // 4 == _SILENT) & (kinds % 4 == _SILENT)
        heard = []
        for half, (first, second) in enumerate((votes[:2], votes[2:4])):
            kind = kinds % 4 if half else kinds // 4
            group = kind * 2 + (second >= 0)
            first = np.where(silent, none, first)
            role = np.where(c == first[:, None], 0, np.where((c == second[:, None]) & (second[:, None] >= 0), 1, 2))
            others = np.log(np.maximum(1, classes - 1 - (second >= 0)))
            heard.append((kind != _SILENT if half else (kind != _SILENT) | silent, group, role, others))

        def words_say(lexicon: np.ndarray) -> np.ndarray:
            x = np.zeros((len(kinds), classes))
            for speaks, group, role, others in heard:
                one = np.log(np.maximum(lexicon[group[:, None], role], 1e-9)) - np.where(role == 2, others[:, None], 0.0)
                x += np.where(speaks[:, None], one, 0.0)
            return x

        lexicon = np.array([[_FIRST[g // 2], _SECOND[g // 2] if g % 2 else 0.0, 0.0] for g in range(2 * len(KINDS))])
        lexicon[:, 2] = 1.0 - lexicon[:, :2].sum(axis=1)
        quiet = 2 * _SILENT
        if unseen is not None:
            known = 1.0 - min(0.5, unseen / max(1.0, float(n[silent].sum())))
            lexicon[quiet] = known, 0.0, 1.0 - known
        start = lexicon.copy()
        # Surroundings: the parties that agree, and which of them (or none) is right.
        voted = np.stack(around, axis=1)
        party = np.full(voted.shape, -1)
        parties = np.zeros(len(voted), int)
        for i in range(voted.shape[1]):
            same = np.full(len(voted), -1)
            for j in range(i):
                same = np.where((voted[:, j] == voted[:, i]) & (voted[:, i] >= 0), party[:, j], same)
            party[:, i] = np.where(voted[:, i] < 0, -1, np.where(same >= 0, same, parties))
            parties += (voted[:, i] >= 0) & (same < 0)
        shapes, shape = np.unique(party, axis=0, return_inverse=True)
        shape = shape.reshape(-1)
        right = np.full((len(voted), classes), 3)
        for i in range(voted.shape[1]):
            right = np.where((voted[:, i : i + 1] == c) & (voted[:, i : i + 1] >= 0), party[:, i : i + 1], right)
        table = np.zeros((len(shapes), 4))
        for i, sh in enumerate(shapes):
            trust = [max((_AROUND[j] for j in range(3) if sh[j] == q), default=0.0) for q in range(3)]
            table[i, :3] = np.array(trust) / max(1.0, sum(trust) / 0.9)
            table[i, 3] = 1.0 - table[i, :3].sum()
        around_start = table.copy()
        # Ways in which the parties that are wrong can vote, given which is right.
        ways = np.ones((len(voted), classes))
        for step in range(3):
            ways *= np.where(parties[:, None] - (right < 3) > step, np.maximum(1, classes - 1 - step), 1)
        # Labels: in the set, none, or outside of it.
        sets = np.full((len(kinds), classes), -1)
        odds = np.ones(len(kinds))
        for i, own in enumerate(labels):
            if own is not None:
                inside = np.isin(np.arange(classes), own)
                sets[i] = np.where(inside, 1, 0)
                sets[i, none] = 2
                odds[i] = (none - len(own)) / len(own) if 0 < len(own) < none else 1.0
        labelled = sets[:, 0] >= 0
        error = 0.05
        self.prior = np.full(classes, 1.0 / classes)
        at = np.arange(len(n))[:, None]
        for turn in range(rounds + 1):
            x = np.log(self.prior)[None, :] + words_say(lexicon)
            x = x + np.log(np.maximum(table[shape[:, None], right], 1e-9)) - np.log(ways)
            inside = np.log1p(-error) + np.log(odds)[:, None]
            x = x + np.where(sets == 1, inside, np.where(sets == 0, np.log(error), np.where(sets == 2, 0.5 * (inside + np.log(error)), 0.0)))
            x = np.exp(x - x.max(axis=1, keepdims=True))
            post = x / x.sum(axis=1, keepdims=True)
            if turn == rounds:
                break
            mass = n[:, None] * post
            tell = np.zeros_like(lexicon)
            for speaks, group, role, _ in heard:
                np.add.at(tell, (group[:, None].repeat(classes, 1), role), mass * speaks[:, None])
            lexicon = (tell + _KEPT * start) / (tell.sum(axis=1, keepdims=True) + _KEPT)
            if unseen is not None:
                lexicon[quiet] = start[quiet]
            tell = np.zeros_like(table)
            np.add.at(tell, (shape[:, None].repeat(classes, 1), right), mass)
            table = (tell + _KEPT * around_start) / (tell.sum(axis=1, keepdims=True) + _KEPT)
            if labelled.any():
                out, told = (mass * (sets == 0)).sum(), (mass * ((sets == 0) | (sets == 1))).sum()
                error = min(0.5, max(1e-3, (out + 1.0) / (told + 20.0)))
            self.prior = (mass.sum(axis=0) + 1.0) / (n.sum() + classes)
        self.lexicon, self.label_error = lexicon, error
        # Labels tell the model its accuracies; a sentence is judged by its votes alone.
        free = np.log(self.prior)[None, :] + words_say(lexicon)
        free = free + np.log(np.maximum(table[shape[:, None], right], 1e-9)) - np.log(ways)
        free = np.exp(free - free.max(axis=1, keepdims=True))
        free /= free.sum(axis=1, keepdims=True)
        self.codes, keep = np.unique(np.array(codes, np.int64), return_index=True)
        self.posterior = free[keep]
        mass = n[:, None] * post
        self.report = []
        for g in range(2 * len(KINDS)):
            heard_n = sum(float(n[speaks & (group == g)].sum()) for speaks, group, _, _ in heard)
            if heard_n:
                self.report.append((KINDS[g // 2] + (", two choices" if g % 2 else ""), heard_n, float(lexicon[g, 0])))
        for i, name in enumerate(AROUND):
            votes_of = voted[:, i] >= 0
            hit = mass[votes_of, voted[votes_of, i]].sum()
            self.report.append((name, float(n[votes_of].sum()), float(hit / max(1.0, n[votes_of].sum()))))

    def of(self, codes: np.ndarray) -> np.ndarray:
        """Subject probabilities of sentences with these vote patterns."""
        return self.posterior[np.searchsorted(self.codes, codes)]


def unseen_sentences(once: float, twice: float) -> float:
    """Sentences none of whose subject words the lexicon knows, from those with one and with two: Chao's estimate of the unseen."""
    return once * once / (2.0 * max(1.0, twice))


def at_least(p: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that at least m[j] of the independent events p[:, j] happen, for each column j."""
    n, k = p.shape
    sure = (p >= 0.999).sum(axis=0)
    dist = np.zeros((n + 1, k))
    dist[0] = 1.0
    for row in np.where((p >= 0.999) | (p <= 0.001), 0.0, p)[((p > 0.001) & (p < 0.999)).any(axis=1)]:
        dist[1:] = dist[1:] * (1.0 - row) + dist[:-1] * row
        dist[0] *= 1.0 - row
    tail = np.cumsum(dist[::-1], axis=0)[::-1]
    left = np.maximum(m - sure, 0)
    return np.where(left > n, 0.0, tail[np.minimum(left, n), np.arange(k)])


def _others_lead(counts: np.ndarray, own: np.ndarray) -> int:
    """The subject of most of the sentences counted, without the document's own; -1 at ties and where there are none."""
    left = counts - own
    top = int(left.argmax())
    return top if left[top] > 0 and (left == left[top]).sum() == 1 else -1


def _section(lead: np.ndarray, own: np.ndarray) -> np.ndarray:
    """For each sentence, what most of the document's other sentences are about; -1 at ties and without others."""
    out = np.full(len(lead), -1)
    for v in np.unique(lead):
        one = np.zeros_like(own)
        one[v] = 1
        out[lead == v] = _others_lead(own, one)
    return out


def _surroundings(read: DataFrame, key: str, classes: int) -> DataFrame:
    """(key, docs, counts): how many sentences of all of a key's documents are about each subject."""
    counts = [F.sum(F.element_at("own", i + 1)).alias(f"n{i}") for i in range(classes)]
    g = read.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("docs"), *counts)
    return g.select(key, "docs", F.array(*[F.col(f"n{i}") for i in range(classes)]).alias(f"of_{key}"))


def subject_model(
    documents: DataFrame, id_column: str, text: str, lexicon: Lexicon, *, address: str, source: str, labels: DataFrame | None = None
) -> tuple[DataFrame, LatentModel]:
    """((id, codes): the vote patterns of each document's sentences, the model learnt from all of them)."""
    classes, none = len(lexicon.subjects), len(lexicon.subjects) - 1
    patterns = Patterns(classes)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, rows = b.column(1).to_pylist(), []
            for part in range(0, len(texts), _AT_ONCE):
                r = Reading(lexicon, texts[part : part + _AT_ONCE])
                has = r.known > 0
                clear = r.alone.max(axis=1, initial=0.0) >= 0.9
                lead = np.where(has, np.where(clear, r.alone.argmax(axis=1), r.post.argmax(axis=1)), none) if none else np.zeros(len(has), int)
                kinds, chosen = np.zeros(len(has), int), []
                for p, known in r.halves:
                    order = np.argsort(-p, axis=1, kind="stable")
                    top = np.take_along_axis(p, order[:, :2], axis=1)
                    kind = np.where(known == 0, _SILENT, np.where(top[:, 0] >= 0.9, 0, np.where(top[:, 0] >= 0.65, 1, 2)))
                    kinds = kinds * 4 + kind
                    chosen.append(np.where(kind < _SILENT, order[:, 0], -1))
                    chosen.append(np.where((kind > 0) & (kind < _SILENT) & (top[:, -1] >= 0.05), order[:, 1], -1) if none > 1 else np.full(len(has), -1))
                words_vote = patterns.pack(kinds, *chosen)
                ends = np.searchsorted(r.doc, np.arange(r.texts + 1))
                rows += [(lead[s:e], words_vote[s:e], r.known[s:e]) for s, e in zip(ends, ends[1:])]
            own = [np.append(np.bincount(r[0], minlength=classes), [np.count_nonzero(r[2] == m) for m in (1, 2)]) for r in rows]
            lists = [pa.array(x, pa.list_(kind)) for x, kind in (([r[0] for r in rows], pa.int32()), ([r[1] for r in rows], pa.int64()), (own, pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), *lists], ["id", "address", "source", "lead", "words", "own"])

    d = documents.select(quoted(id_column).cast("long").alias("id"), quoted(text), quoted(address).cast("string").alias("address"), quoted(source).cast("string").alias("source"))
    d = cut(d.mapInArrow(read, "id long, address string, source string, lead array<int>, words array<long>, own array<long>"))
    # The last two places of ``own`` count the document's sentences with one and with two subject words.
    few = d.agg(F.count("*").alias("docs"), *[F.sum(F.element_at("own", classes + i)).alias(f"k{i}") for i in (1, 2)]).first()
    d, total = d.withColumn("own", F.slice("own", 1, classes)), few["docs"]
    for key in ("address", "source"):
        d = attach(d, cut(_surroundings(d, key, classes)), [key], "docs", total)
    own_labels = F.lit(None).cast("array<int>")
    if labels is not None:
        # At most LABELLED documents by their hash, so that the table may be broadcast.
        at = F.create_map(*[x for i, s in enumerate(lexicon.subjects[:none]) for x in (F.lit(s), F.lit(i))])
        per = labels.where(F.col("subject").isNotNull()).groupBy(quoted(id_column).cast("long").alias("id")).agg(F.sort_array(F.collect_set(F.element_at(at, F.col("subject")))).alias("labels"))
        n = per.count()
        d = d.join(F.broadcast(per.where(hashed_share(F.col("id"), min(1.0, LABELLED / n) if n else 1.0))), "id", "left")
        own_labels = F.col("labels")

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = []
            for lead, told, own, bundle, origin in zip(*(b.column(i).to_pylist() for i in range(1, 6))):
                if not lead:
                    codes.append([])
                    continue
                own = np.array(own)
                spread = [np.full(len(lead), _others_lead(np.array(of), own) if of is not None else -1) for of in (bundle, origin)]
                codes.append(patterns.pack(np.array(told), _section(np.array(lead), own), *spread))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes, pa.list_(pa.int64())), b.column(6)], ["id", "codes", "labels"])

    d = d.select("id", "lead", "words", "own", "of_address", "of_source", own_labels.alias("labels"))
    d = cut(d.mapInArrow(vote, "id long, codes array<long>, labels array<int>"))
    # One row per vote pattern and set of labels: the functions are six, the subjects few.
    found = d.select(F.explode("codes").alias("code"), "labels").groupBy("code", "labels").agg(F.count("*").alias("n")).orderBy("code", "labels").collect()
    model = LatentModel([r["code"] for r in found], [r["labels"] for r in found], [r["n"] for r in found], classes, unseen=unseen_sentences(few["k1"] or 0, few["k2"] or 0))
    return d.select("id", "codes"), model


def subjects_of(
    documents: DataFrame, id_column: str, text: str, lexicon: Lexicon, *, address: str, source: str, labels: DataFrame | None = None, share: float = 0.2
) -> DataFrame:
    """(id, subject, probability, sentences, of): every subject that at least ``share`` of a document's sentences probably deal with.

    The posteriors of the sentences give the probability that enough of them deal with a subject; from a half on
    the document has it. ``sentences`` is the expected number. Null and empty texts and those without a
    sentence have no subject; a text may have several. Repeated texts and ids are read as separate
    documents; an empty table gives no rows.
    """
    d, model = subject_model(documents, id_column, text, lexicon, address=address, source=source, labels=labels)
    none = len(lexicon.subjects) - 1

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for i, codes in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not codes:
                    continue
                p = model.of(np.array(codes))[:, :none]
                # Rounding must not decide a share that is met exactly.
                least = max(1, math.ceil(share * len(codes) - 1e-9))
                some = np.flatnonzero(p.sum(axis=0) >= 0.05)
                chance = at_least(p[:, some], np.full(len(some), least))
                out += [(i, lexicon.subjects[c], float(q), float(p[:, c].sum()), len(codes)) for c, q in zip(some, chance) if q >= 0.5]
            cols = list(zip(*out)) if out else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["id", "subject", "probability", "sentences", "of"])

    return d.mapInArrow(decide, "id long, subject string, probability double, sentences double, of int")
