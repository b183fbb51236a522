"""Word classes in context: a hidden Markov tagger fitted by expectation-maximisation on Spark.

States are word classes; a sentence's words are its observations.  A word among
the ``max_words`` most frequent is a symbol of its own, others share the symbol
of their ending, so the model is bounded.  Which classes a symbol may have comes
from a short list of function words and from endings; the probabilities are
learnt from the texts alone.  A round of learning runs forward-backward over all
sentences in Arrow tasks, each task adds up its expected counts, Spark sums
them, and the driver divides them (``max_words`` times the number of classes at
most).  Tags are the likeliest sequence of a sentence (Viterbi).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revmine.functions import lexicon as L
from revmine.functions import text as X
from revmine.session import cut_lineage

TAGS = ("NN", "VB", "JJ", "RB", "DT", "IN", "PR", "MD", "CC", "CD")
_TAG = {t: i for i, t in enumerate(TAGS)}
WORD = r"\p{L}+|\p{N}+"

#: function words with their only class
CLOSED = {
    "DT": "a an all any each every her his its my no our some that the their these this those your",
    "IN": "about after as at because before by for from if in into of on over since than through under until when where while with without",
    "PR": "he i it me she they us we who you him them what which there",
    "MD": "can cannot could may might must shall should will would to",
    "CC": "and but nor or yet",
    "VB": "am are be been being did do does had has have having is was were",
    "RB": "also always even ever just never not often only quite rather really so still then too very",
}
#: classes that an ending allows; the first that fits counts
ENDINGS = (
    ("ly", "RB JJ"), ("ing", "VB NN JJ"), ("ed", "VB JJ"), ("tion", "NN"), ("ment", "NN"), ("ness", "NN"), ("ity", "NN"), ("ism", "NN"),
    ("ous", "JJ"), ("ful", "JJ"), ("ive", "JJ NN"), ("able", "JJ"), ("ible", "JJ"), ("ish", "JJ"), ("less", "JJ"), ("ic", "JJ NN"),
    ("est", "JJ NN"), ("er", "NN JJ VB"), ("es", "NN VB"), ("s", "NN VB"),
)
OPEN = "NN VB JJ"
#: and of a form that a table of irregular lemmas has for a class
IRREGULAR = {"NN": "NN VB", "VB": "VB NN JJ", "JJ": "JJ RB NN"}
#: weight of the lists' order of classes, the first twice as likely as the second, against a word's uses
LISTS = 0.25
#: words of the sentences that a task steps over together
RUN_WORDS = 1 << 19
#: sentences up to which one call per step is faster than one per class
FEW = 64
#: what usually follows a class ("" is a sentence's begin and end): counts that learning starts from and keeps as a prior
FOLLOWS = {
    "": "DT:4 PR:4 NN:2 IN:1 RB:1 JJ:1", "DT": "NN:6 JJ:3", "JJ": "NN:6 JJ:1 CC:1 :1", "NN": "VB:3 IN:3 MD:1 CC:1 NN:1 RB:1 :4", "PR": "VB:6 MD:3 RB:1",
    "MD": "VB:8 RB:1", "VB": "DT:3 IN:2 RB:2 JJ:1 NN:1 PR:1 :1", "IN": "DT:4 NN:3 JJ:1 PR:1", "RB": "JJ:3 VB:3 RB:1 :1", "CC": "NN:2 VB:2 DT:2 JJ:1 PR:1", "CD": "NN:6 IN:1",
}


def allowed_tags(word: str) -> str:
    """Classes that a word may have, by the lists above."""
    for tag, words in CLOSED.items():
        if word in words.split():
            return tag
    if not word.isalpha():
        return "CD"
    for tag, tags in IRREGULAR.items():
        if word in L.IRREGULAR_LEMMAS[tag]:
            return tags
    return next((tags for end, tags in ENDINGS if word.endswith(end) and len(word) >= len(end) + 2), OPEN)


def shape(word: str) -> str:
    """Symbol of a word that the model does not list."""
    if not word.isalpha():
        return "#"
    return "*" + next((end for end, _ in ENDINGS if word.endswith(end) and len(word) >= len(end) + 2), "")


@dataclass
class HmmTagger:
    """``start`` (class), ``move`` (class, next class), ``stop`` (class last in a sentence), ``emit`` (class, symbol): probabilities."""

    symbols: dict[str, int]
    likely: np.ndarray  # (class, symbol): weight of each class that the lists allow
    start: np.ndarray
    move: np.ndarray
    stop: np.ndarray
    emit: np.ndarray
    log_likelihood: list[float] = field(default_factory=list)

    @classmethod
    def initial(cls, words: Sequence[str]) -> HmmTagger:
        names = [*dict.fromkeys([*words, "#", "*", *["*" + e for e, _ in ENDINGS]])]
        names_ = {n: i for i, n in enumerate(names)}
        likely = np.zeros((len(TAGS), len(names)))
        for i, name in enumerate(names):
            tags = "CD" if name == "#" else allowed_tags("xx" + name[1:]) if name.startswith("*") else allowed_tags(name)
            for k, t in enumerate(tags.split()):
                likely[_TAG[t], i] = 1 / (k + 1)
        likely /= likely.sum(axis=0)
        return cls(names_, likely, *_normal(*_priors()), likely / np.maximum(likely.sum(axis=1, keepdims=True), 1e-300))

    def encode(self, words: Sequence[str]) -> np.ndarray:
        get = self.symbols.get
        return np.array([i if (i := get(w)) is not None else self.symbols[shape(w)] for w in words], np.int64)

    def encode_array(self, words: pa.Array) -> np.ndarray:
        words = words.dictionary_encode()
        return self.encode(words.dictionary.to_pylist())[words.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)

    def expected(self, sentences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected counts (start, move, stop, emit) of the sentences, and their log likelihood."""
        return self.expected_flat(*_joined(sentences))

    def expected_flat(self, codes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
        """The same of sentences as one array of symbols and their lengths."""
        start, move, stop, emit, log = _nothing(self.emit)
        emitted = np.ascontiguousarray(self.emit.T)
        for _, _, obs, first in _packed(codes, size):
            active = np.diff(first)
            seen = emitted[obs]
            ahead, scale = np.empty(seen.shape), np.empty(len(obs))
            for i, (lo, n) in enumerate(zip(first[:-1].tolist(), active.tolist(), strict=True)):
                now = (self.start if i == 0 else ahead[before:before + n] @ self.move) * seen[lo:lo + n]
                total = now.sum(axis=1)
                scale[lo:lo + n] = total
                np.divide(now, total[:, None], out=ahead[lo:lo + n])
                before = lo
            behind = np.empty((active[0], len(TAGS)))
            went, longer = np.zeros(move.shape), 0
            for i in range(len(active) - 1, -1, -1):
                lo, n = int(first[i]), int(active[i])
                if n > longer:  # sentences that end here
                    last = ahead[lo + longer:lo + n]
                    end = last @ self.stop
                    behind[longer:n] = self.stop / end[:, None]
                    stop += (last * behind[longer:n]).sum(axis=0)
                    log += float(np.log(end).sum())
                    longer = n
                ahead[lo:lo + n] *= behind[:n]  # from here on: the expected classes of these words
                if i:
                    step = seen[lo:lo + n] * behind[:n]
                    step /= scale[lo:lo + n, None]
                    back = int(first[i - 1])
                    went += ahead[back:back + n].T @ step
                    behind[:n] = step @ self.move.T
            start += ahead[:active[0]].sum(axis=0)
            move += self.move * went
            for c in range(len(TAGS)):
                emit[c] += np.bincount(obs, weights=ahead[:, c], minlength=emit.shape[1])
            log += float(np.log(scale).sum())
        return start, move, stop, emit, log

    def reestimated(self, start: np.ndarray, move: np.ndarray, stop: np.ndarray, emit: np.ndarray) -> HmmTagger:
        """Probabilities from expected counts and the priors; the lists weigh ``LISTS`` times as much as a word's uses."""
        first, follow, last = _priors()
        emit = emit + LISTS * emit.sum(axis=0) * self.likely + 0.01 * self.likely  # an allowed class never dies out
        return HmmTagger(self.symbols, self.likely, *_normal(start + first, move + follow, stop + last),
                         emit / np.maximum(emit.sum(axis=1, keepdims=True), 1e-300), self.log_likelihood)

    def viterbi(self, sentences: list[np.ndarray]) -> list[np.ndarray]:
        """Likeliest classes of each sentence; the first class on ties."""
        codes, size = _joined(sentences)
        return np.split(self.viterbi_flat(codes, size), np.cumsum(size)[:-1]) if len(size) else []

    def viterbi_flat(self, codes: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The same of sentences as one array of symbols and their lengths."""
        out = np.zeros(len(codes), np.int64)
        with np.errstate(divide="ignore"):
            start, move, stop, emit = np.log(self.start), np.log(self.move), np.log(self.stop), np.log(self.emit)
        emitted = np.ascontiguousarray(emit.T)
        for words, place, obs, first in _packed(codes, size):
            active = np.diff(first)
            best, back = start + emitted[obs[:active[0]]], np.zeros((len(obs), len(TAGS)), np.int8)
            for lo, n in zip(first[1:-1].tolist(), active[1:].tolist(), strict=True):
                if n < FEW:
                    reach = best[:n, :, None] + move
                    back[lo:lo + n] = reach.argmax(axis=1)
                    most = reach.max(axis=1)
                else:
                    most = best[:n, :1] + move[0]
                    for k in range(1, len(TAGS)):
                        other = best[:n, k:k + 1] + move[k]
                        back[lo:lo + n][other > most] = k
                        np.maximum(most, other, out=most)
                best[:n] = most + emitted[obs[lo:lo + n]]
            path, now = np.empty(len(obs), np.int64), (best + stop).argmax(axis=1)
            for i in range(len(active) - 1, -1, -1):
                lo, n = int(first[i]), int(active[i])
                path[lo:lo + n] = now[:n]
                now[:n] = back[np.arange(lo, lo + n), now[:n]]
            out[words] = path[place]
        return out

    def tags(self, sentences: str | Column) -> Column:
        """Classes of the words of ``array<array<string>>`` (sentences of words), in the same shape; null for null."""
        tagger = self

        @F.arrow_udf("array<array<string>>")
        def likeliest(texts: pa.Array) -> pa.Array:
            spoken = texts.flatten()  # sentences of the texts that are not null
            per_text, size = _lengths(texts), _lengths(spoken)
            path = tagger.viterbi_flat(tagger.encode_array(spoken.flatten()), size)
            inner = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(TAGS).take(pa.array(path)))
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_text)]), pa.int32()), inner, mask=texts.is_null())

        return likeliest(F.col(sentences) if isinstance(sentences, str) else sentences)

    def lemmas(self, text: str | Column, pattern: str = L.THREE_LETTERS, keep: Sequence[str] | None = None) -> Column:
        """Lemmas of a text's words by their classes in context, as one array.

        ``pattern``: words to return (all words are context); ``keep``: only of
        these classes.  Usable as the ``tokenizer`` of a word count.
        """
        from revmine.operators.text import lemma_by_class

        sentences = words_of_sentences(text)
        pairs = F.flatten(F.zip_with(sentences, self.tags(sentences), lambda s, t: F.zip_with(s, t, lambda a, b: F.struct(a.alias("w"), b.alias("t")))))
        some = F.filter(pairs, lambda p: p["w"].rlike("^(?:" + pattern + ")$") & (p["t"].isin(list(keep)) if keep else F.lit(True)))
        return F.transform(some, lambda p: lemma_by_class(p["w"], p["t"]))


def words_of_sentences(text: str | Column) -> Column:
    """``array<array<string>>``: lowercase words of each sentence, sentences without words left out."""
    c = F.lower(F.col(text) if isinstance(text, str) else text)
    return F.filter(F.transform(X.split_sentences(c), lambda s: F.regexp_extract_all(s, F.lit(WORD), F.lit(0))), lambda s: F.size(s) > 0)


def _priors() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    names = {**_TAG, "": len(TAGS)}
    table = np.full((len(TAGS) + 1, len(TAGS) + 1), 0.1)
    for i, tag in enumerate((*TAGS, "")):
        for part in FOLLOWS[tag].split():
            name, n = part.split(":")
            table[i, names[name]] += float(n)
    return table[-1, :-1], table[:-1, :-1], table[:-1, -1]


def _normal(start: np.ndarray, move: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    total = move.sum(axis=1) + stop
    return start / start.sum(), move / total[:, None], stop / total


def _nothing(emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    k = len(TAGS)
    return np.zeros(k), np.zeros((k, k)), np.zeros(k), np.zeros(emit.shape), 0.0


def _added(sums: tuple, model: HmmTagger, held: list[tuple[np.ndarray, np.ndarray]]) -> tuple:
    """``sums`` and the expected counts of (symbols, lengths) of some batches."""
    if not held:
        return sums
    codes, size = (np.concatenate(x) for x in zip(*held, strict=True))
    return tuple(a + b for a, b in zip(sums, model.expected_flat(codes, size), strict=True))


def _joined(sentences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all sentences, length of each)."""
    return np.concatenate([np.zeros(0, np.int64), *sentences]), np.array([len(s) for s in sentences], np.int64)


def _lengths(lists: pa.Array) -> np.ndarray:
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _packed(codes: np.ndarray, size: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """(words, place, obs, first) of bounded runs of sentences, for steps over all first words, all second words and so on.

    The longest sentence comes first, so those that go on are always the first
    rows: ``obs[first[i]:first[i + 1]]`` has the i-th words of all sentences that
    have one.  ``place`` says where in ``obs`` the words of ``codes[words]`` are.
    """
    ends = np.cumsum(size)
    done = at = 0
    while done < len(size):
        upto = max(done + 1, int(np.searchsorted(ends, at + RUN_WORDS, side="right")))
        some = size[done:upto]
        words = slice(at, int(ends[upto - 1]))
        done, at = upto, words.stop
        if words.stop == words.start:
            continue
        rank = np.empty(len(some), np.int64)
        rank[np.argsort(-some, kind="stable")] = np.arange(len(some))
        have = np.bincount(some)[::-1].cumsum()[::-1][1:]  # sentences of i words and more, from 1 on
        first = np.concatenate([[0], np.cumsum(have)])
        nth = np.arange(words.stop - words.start) - np.repeat(np.cumsum(some) - some, some)
        place = first[nth] + np.repeat(rank, some)
        obs = np.empty(len(place), np.int64)
        obs[place] = codes[words]
        yield words, place, obs, first


def fit_tagger(df: DataFrame, text: str = "text", max_words: int = 10_000, max_rounds: int = 12, tolerance: float = 1e-3) -> HmmTagger:
    """Tagger fitted on the sentences of all texts; empty and null texts have none.

    Rounds end when the log likelihood grows by less than ``tolerance`` of
    itself, after ``max_rounds`` at the latest.
    """
    sentences = cut_lineage(df.select(F.explode(words_of_sentences(text)).alias("words")))  # read once a round
    top = (sentences.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
           .orderBy(F.desc("n"), "w").limit(max_words).select("w").collect())  # max_words words
    model = HmmTagger.initial([r["w"] for r in top])
    for _ in range(max_rounds):
        got = _round(sentences, model)
        start, move, stop, emit, _ = _nothing(model.emit)
        i, j, v = got["i"].to_numpy(), got["j"].to_numpy(), got["v"].to_numpy()
        part = got["part"].to_numpy()
        start[i[part == 0]] = v[part == 0]
        move[i[part == 1], j[part == 1]] = v[part == 1]
        emit[i[part == 2], j[part == 2]] = v[part == 2]
        stop[i[part == 4]] = v[part == 4]
        log = float(v[part == 3].sum())
        model = model.reestimated(start, move, stop, emit)
        before, model.log_likelihood = model.log_likelihood, [*model.log_likelihood, log]
        if before and log - before[-1] < tolerance * abs(before[-1]):
            break
    return model


def _round(sentences: DataFrame, model: HmmTagger) -> pa.Table:
    """Summed expected counts (part, i, j, v): 0 start, 1 move, 2 emit, 3 log likelihood, 4 stop."""
    sent = sentences.sparkSession.sparkContext.broadcast(model)  # classes * symbols doubles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = sent.value
        sums = _nothing(tagger.emit)
        held, n = [], 0
        for batch in batches:
            column = batch.column("words")
            held.append((tagger.encode_array(column.flatten()), _lengths(column)))
            n += len(held[-1][0])
            if n >= RUN_WORDS:
                sums, held, n = _added(sums, tagger, held), [], 0
        sums = _added(sums, tagger, held)
        start, move, stop, emit, log = sums
        for part, m in ((0, start[:, None]), (1, move), (2, emit), (3, np.array([[log]])), (4, stop[:, None])):
            i, j = np.nonzero(m)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), part, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(m[i, j])],
                                             names=["part", "i", "j", "v"])

    return (sentences.mapInArrow(run, "part int, i int, j int, v double").groupBy("part", "i", "j").agg(F.sum("v").alias("v"))).toArrow()
