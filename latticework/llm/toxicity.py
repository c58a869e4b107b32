"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer turns each word into a symbol: insult word, threat verb, intent, target, negation,
verb of speech, clause end or other. Clauses with an insult word or a threat verb then run through the
grammar, which is composed of these transducers, each a machine of its own:

    threat     a threat verb behind an intent becomes a threat; without one it is an ordinary word
    negation   marks hits shortly behind a negation
    report     marks hits behind a verb of speech
    target     marks hits near a target
    phrase     marks hits with another word of the clause beside them

The first three look left. Targets and phrases count on either side, so their machines run over the
clause from left to right and, composed apart, back from right to left. A clause matches a pattern if it
holds an insult in a phrase or an insult with a target, or a threat with a target; a word that stands
alone, a threat verb without intent or a threat without target match nothing. What counts are matched
clauses, by pattern, targeted, negated and reported; the weights of these outputs and of the bias are
fitted by penalised logistic regression, around the grammar's default weights, on labelled rows that
are not held out. So is the insult lexicon: words and word stems that stand in toxic texts and hardly in
others.

Fitting reads `MAX_TRAIN` labelled rows at most (the least by hash of doc_id). Scoring reads every whole
text once, without a shuffle. Labels, lang, source and doc_id are no inputs of a score.

Edge cases. Null, empty or blank text: no clause, the score of the bias. Labelled rows that share a
doc_id: the least text is learned from, all are scored. No usable labels: default
weights and seed words. Repeated labels of one doc_id: the largest counts. Null doc_id: not held out,
scored. Empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as T
from .common import drop_written, map_arrow, written

MAX_TRAIN = 20_000
FOLDS = 5
#: Stems are prefixes of these lengths.
STEMS = (4, 5, 6)
#: A unit must stand in this share of the toxic texts at least.
MIN_SHARE = 0.005
#: Least shingles of a text that tell families of near copies.
FAMILY = 5
CACHE = 300_000

OTHER, INSULT, VERB, INTENT, TARGET, NEGATION, REPORT, BREAK = b"oivwhnrb"
SEEDS = ("idiot", "moron", "stupid", "scum", "worthless", "pathetic")
THREATS = ("kill", "hurt", "destroy", "beat", "stab", "shoot", "burn", "punch", "töten", "tuer", "matar")
INTENTS = ("will", "gonna", "going", "shall", "should", "must", "want", "wanna", "i'll", "we'll", "let's", "werde", "werden", "vais", "allons", "voy", "vamos")
TARGETS = ("you", "your", "you're", "u", "he", "she", "him", "her", "they", "them", "these", "those", "du", "dich", "ihr", "sie", "tu", "toi", "vous", "ils", "tú", "te", "ustedes", "ellos")
NEGATIONS = ("not", "no", "never", "isn't", "aren't", "wasn't", "don't", "won't", "without", "nicht", "kein", "keine", "nie", "pas", "jamais", "non", "nunca", "ni")
REPORTS = ("said", "says", "called", "calls", "reported", "wrote", "quoted", "quote", "claimed", "sagte", "nannte", "dit", "appelle", "dijo", "llamó")
_ENDS = ".,;:!?"
_STRIP = ".,;:!?\"'()[]{}<>«»“”„‘’¿¡*_#|-…"
#: How far the scopes of an opener reach, in words.
INTENT_REACH, NEGATION_REACH, REPORT_REACH, TARGET_REACH = 4, 3, 6, 4
#: Marks of a hit.
NEGATED, REPORTED, TARGETED, PHRASE = 1, 2, 4, 8


# ---- transducers


@dataclass
class Transducer:
    """arcs: (state, symbol) -> (next state, output symbol); 0 is the start."""

    arcs: dict[tuple[int, int], tuple[int, int]] = field(default_factory=dict)

    def run(self, symbols: bytes) -> bytes:
        state, out = 0, bytearray()
        for symbol in symbols:
            state, end = self.arcs[state, symbol]
            out.append(end)
        return bytes(out)


def hit(threat: bool, marks: int = 0) -> int:
    """The symbol of an insult or a threat with marks."""
    return 128 + 16 * threat + marks


_HITS = frozenset(hit(t, m) for t in (False, True) for m in range(16))
_ALPHABET = (OTHER, INSULT, VERB, INTENT, TARGET, NEGATION, REPORT, BREAK, *sorted(_HITS))


def threats() -> Transducer:
    """Insult words become insults, threat verbs within reach of an intent threats, others ordinary words."""
    t = Transducer()
    for state in range(INTENT_REACH + 1):
        for symbol in _ALPHABET:
            end = {INSULT: hit(False), VERB: hit(True) if state else OTHER}.get(symbol, symbol)
            t.arcs[state, symbol] = (INTENT_REACH if symbol == INTENT else 0 if symbol == BREAK else max(0, state - 1), end)
    return t


def scope(opener: int, reach: int, mark: int) -> Transducer:
    """Marks hits up to `reach` symbols after an opener; a clause end closes the scope."""
    t = Transducer()
    for state in range(reach + 1):
        for symbol in _ALPHABET:
            end = symbol | mark if state and symbol in _HITS else symbol
            t.arcs[state, symbol] = (reach if symbol == opener else 0 if symbol == BREAK else max(0, state - 1), end)
    return t


def phrase() -> Transducer:
    """Marks hits that have a word of their clause right before them."""
    t = Transducer()
    for state in (0, 1):
        for symbol in _ALPHABET:
            t.arcs[state, symbol] = (int(symbol != BREAK), symbol | PHRASE if state and symbol in _HITS else symbol)
    return t


def compose(a: Transducer, b: Transducer) -> Transducer:
    """b reads what a writes; only states that are reached."""
    number, todo, out = {(0, 0): 0}, [(0, 0)], Transducer()
    for x, y in todo:
        for symbol in _ALPHABET:
            x2, middle = a.arcs[x, symbol]
            y2, end = b.arcs[y, middle]
            if (x2, y2) not in number:
                number[x2, y2] = len(number)
                todo.append((x2, y2))
            out.arcs[number[x, y], symbol] = (number[x2, y2], end)
    return out


@cache
def grammar() -> tuple[Transducer, Transducer]:
    """The machine that reads a clause from left to right, and the one that reads its output back."""
    target = scope(TARGET, TARGET_REACH, TARGETED)
    left = compose(threats(), scope(NEGATION, NEGATION_REACH, NEGATED))
    left = compose(left, scope(REPORT, REPORT_REACH, REPORTED))
    return compose(compose(left, target), phrase()), compose(target, phrase())


#: Outputs of matched clauses: insults by three marks, threats (always targeted) by two.
OUTPUTS = [hit(False, m) for m in range(8)] + [hit(True, m | TARGETED) for m in range(4)]
_PLACE = {s: i for i, s in enumerate(OUTPUTS)}


def matched(symbol: int) -> int | None:
    """The output of a hit, if it completes a clause pattern."""
    if symbol not in _HITS:
        return None
    marks = symbol & 15
    if marks & TARGETED or (marks & PHRASE and symbol < hit(True)):
        return symbol & ~PHRASE
    return None


def default_weights() -> np.ndarray:
    """Bias, then a weight for each output."""
    out = [-3.0]
    for s in OUTPUTS:
        out.append(4.0 - 2.5 * bool(s & NEGATED) - 2.0 * bool(s & REPORTED) + 1.0 * bool(s & TARGETED))
    return np.array(out)


class Machine:
    """The lexical transducer and the grammar, run over texts. Symbols of words are cached."""

    def __init__(self, lexicon: dict[str, int]):
        self.symbols = {}
        for words, symbol in ((TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT), (INTENTS, INTENT), (THREATS, VERB)):
            self.symbols |= dict.fromkeys(words, symbol)
        self.words = {w for w, whole in lexicon.items() if whole}
        self.stems = {w for w, whole in lexicon.items() if not whole}
        self.left, self.right = grammar()
        self.cache: dict[str, bytes] = {}

    def symbol(self, raw: str) -> bytes:
        word = raw.lower().strip(_STRIP)
        if word in self.words or any(word[:n] in self.stems for n in STEMS):
            s = INSULT
        else:
            s = self.symbols.get(word, OTHER)
        return bytes((s, BREAK)) if raw[-1] in _ENDS else bytes((s,))

    def clause(self, symbols: bytes) -> set[int]:
        """The outputs that a clause matches."""
        back = self.right.run(self.left.run(symbols)[::-1])
        return {out for s in back if (out := matched(s)) is not None}

    def counts(self, text: str) -> np.ndarray | None:
        """How many clauses match each output; None if none does."""
        known, parts = self.cache, []
        for w in text.split():
            s = known.get(w)
            if s is None:
                s = self.symbol(w)
                if len(known) < CACHE:
                    known[w] = s
            parts.append(s)
        line = b"".join(parts)
        if INSULT not in line and VERB not in line:
            return None
        out = np.zeros(len(OUTPUTS))
        for clause in line.split(bytes((BREAK,))):
            if INSULT in clause or VERB in clause:
                for end in self.clause(clause):
                    out[_PLACE[end]] += 1
        return out if out.any() else None


def _features(counts: np.ndarray | None) -> np.ndarray:
    """Counts saturate: the second matched clause tells less than the first."""
    return np.zeros(len(OUTPUTS)) if counts is None else np.minimum(np.log2(1 + counts), 3.0)


# ---- fitting


def _units(text: str) -> set[str]:
    """Distinct words (with `=` before) and stems of a text, lower-cased."""
    out = set()
    for raw in set(text.lower().split()):
        word = raw.strip(_STRIP)
        if len(word) >= 3 and word.isalpha():
            out.add("=" + word)
            out.update(word[:n] for n in STEMS if len(word) >= n)
    return out


def _count_units(only: frozenset[str] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for text in batch.column(0):
                units = _units(text.as_py() or "")
                found.update(units if only is None else units & only)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["unit", "n"])

    return run


def _support(texts: DataFrame, only: frozenset[str] | None) -> DataFrame:
    return map_arrow(texts.select("text"), _count_units(only), "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def _family_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, toxic) with a hash of the text and `FAMILY` least hashes of its three-word shingles."""
    for batch in batches:
        for a, b, buf, offsets in T.chunks(batch.column(0)):
            flat, ptr = T.shingle_sets(buf, offsets, 3)
            keys = np.zeros((FAMILY, b - a), np.int64)
            own, full = np.diff(ptr), np.flatnonzero(np.diff(ptr))
            for k in range(FAMILY):
                if len(full):
                    keys[k, full] = np.minimum.reduceat(T.mix(flat ^ T._STEP[k]), ptr[:-1][full]).view(np.int64)  # noqa: SLF001
                keys[k, own == 0] = 0
            texts = batch.column(0).slice(a, b - a)
            yield pa.RecordBatch.from_arrays([texts, batch.column(1).slice(a, b - a), pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * FAMILY), pa.array(keys.T.reshape(-1)))], names=["text", "toxic", "keys"])


def one_of_each_family(train: DataFrame) -> DataFrame:
    """One text of each family of copies and near copies, as copies are no independent evidence.

    Texts that share any of a few least shingles count as a family. The keys of at most `MAX_TRAIN`
    texts are compared on the driver.
    """
    keyed = written(map_arrow(train.select("text", "toxic"), _family_kernel, "text string, toxic int, keys array<long>").withColumn("h", F.xxhash64("text", "toxic")), "families")
    seen, kept = set(), []
    for r in sorted(keyed.select("h", "toxic", "keys").collect(), key=lambda r: (r.h, r.toxic)):
        own = {(r.toxic, i, k) for i, k in enumerate(r["keys"])}
        if seen.isdisjoint(own):
            kept.append((r.h,))
        seen |= own
    ids = train.sparkSession.createDataFrame(kept, "h long")
    out = written(keyed.join(F.broadcast(ids), "h").dropDuplicates(["h"]).select("text", "toxic"), "family")
    drop_written(keyed)
    return out


def learn_lexicon(train: DataFrame) -> dict[str, int]:
    """Words (1) and stems (0) that mark toxic texts, from (text, toxic) rows without copies."""
    sizes = {r.toxic: r.n for r in train.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return dict.fromkeys(SEEDS, 1)
    # units of a bounded number of texts; rarer ones could not pass below
    some = _support(train.where("toxic = 1"), None).where(F.col("n") >= max(3.0, MIN_SHARE * toxic)).collect()
    hits = {r.unit: r.n for r in some}
    misses = {r.unit: r.n for r in _support(train.where("toxic = 0"), frozenset(hits)).collect()}
    # enough toxic texts that chance, tried on all candidates, doesn't explain their number
    least = max((math.log(max(2, len(hits))) + 4) / math.log((toxic + clean) / toxic), MIN_SHARE * toxic)
    good = {}
    for unit, n in hits.items():
        odds = math.log((n + 0.5) / (toxic + 1)) - math.log((misses.get(unit, 0) + 0.5) / (clean + 1))
        if n >= least and odds >= 3.0:
            good[unit] = n
    top_word: Counter = Counter()
    for unit, n in hits.items():
        if unit[0] == "=":
            for k in STEMS:
                top_word[unit[1 : 1 + k]] = max(top_word[unit[1 : 1 + k]], n)
    lexicon = dict.fromkeys(SEEDS, 1)
    stems = sorted((u for u in good if u[0] != "="), key=len)
    for stem in stems:  # a stem stands for many words; one word's stem adds nothing
        if good[stem] > 1.1 * top_word[stem] and not any(stem.startswith(s) for s, whole in lexicon.items() if not whole):
            same = [t for t in stems if t.startswith(stem) and good[t] >= 0.98 * good[stem]]
            lexicon[max(same, key=len)] = 0  # the longest that stands for the same words
    for unit in sorted((u for u in good if u[0] == "="), key=lambda u: (-good[u], u)):
        if not any(lexicon.get(unit[1 : 1 + n]) == 0 for n in STEMS):
            lexicon[unit[1:]] = 1
    return lexicon


def fit_weights(x: np.ndarray, y: np.ndarray, strength: float = 1.0, steps: int = 100) -> np.ndarray:
    """Logistic regression by damped Newton steps, penalised by the distance from the default weights."""
    prior = default_weights()
    w = prior.copy()
    if not len(y):
        return w
    x = np.hstack([np.ones((len(x), 1)), x])

    def loss(v):
        z = x @ v
        return np.logaddexp(0, z).sum() - y @ z + strength / 2 * ((v - prior) ** 2).sum()

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + strength * (w - prior)
        hess = (x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w))
        step, size = np.linalg.solve(hess, grad), 1.0
        while (then := loss(w - size * step)) > now and size > 1e-6:
            size /= 2
        if now - then < 1e-9:
            break
        w, now = w - size * step, then
    return w


def _feature_kernel(lexicon: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine(lexicon)
        for batch in batches:
            rows = [_features(machine.counts(t.as_py() or "")).tolist() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    return run


@dataclass
class Model:
    lexicon: dict[str, int]
    weights: list[float]


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """A model from labelled rows that are not held out."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    # at most max_train ids go to the executors; of rows that share a doc_id the least text is taken
    train = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").where("text IS NOT NULL")
    train = train.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")
    train = written(train, "toxic")
    some = one_of_each_family(train)
    lexicon = learn_lexicon(some)
    rows = map_arrow(train, _feature_kernel(lexicon), "x array<double>, toxic int").collect()  # max_train rows at most
    drop_written(some)
    drop_written(train)
    weights = fit_weights(np.array([r.x for r in rows]).reshape(len(rows), len(OUTPUTS)), np.array([r.toxic for r in rows], float))
    return Model(lexicon, weights.tolist())


def _score_kernel(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine(model.lexicon)
        bias, weights = model.weights[0], np.array(model.weights[1:])
        for batch in batches:
            z = [bias if (c := machine.counts(t.as_py() or "")) is None else bias + float(_features(c) @ weights) for t in batch.column(2)]
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30))) if z else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, _score_kernel(model), "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
