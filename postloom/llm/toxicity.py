"""Abusive, hateful or sexual content by maximum-scoring segments.

Every token (and known pair of neighbours) has a log-odds score per category, from the labelled sample against its
harmless background, with Dirichlet priors: the corpus's own word rates, and pseudo-counts for words of a general lexicon.
Most of a labelled text is harmless, so the passages are learned with the scores: each text's best sentence under the scores of the
last round counts for its category, the rest of it for the background. A linear scan finds the segment of a text with the
largest sum; its significance follows from the extreme-value law of such sums, fitted to the maxima of held-out harmless texts.

Tokens are compared without the usual disguises: zero-width characters, look-alike letters, digits and signs for
letters, asterisks, drawn-out or spelled-out letters.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CATEGORIES = ("abusive", "hateful", "sexual")
#: Labelled rows used at most (the bound of what is fitted).
SAMPLE_ROWS = 5_000
#: Weights of the priors in tokens: a category's, the harmless background's; a lexicon entry's pseudo-count.
PRIOR, PRIOR_NONE, SEED = 300.0, 3000.0, 6.0
#: Evidence a token must bring before it counts for a category (nats), and what one observation takes off for chance.
MARGIN, CHANCE = 1.3, 1.0
#: Bounds of a score: of a word only the sample knows, of a lexicon entry, of a function word.
LIMIT, LIMIT_LEXICON, LIMIT_COMMON = 6.0, 8.0, 1.0
#: The score from which a word makes a passage alone; words around such words tell mentions from use.
STRONG = 3.0
#: Rounds of finding the labelled texts' passages, and folds of the calibration.
ROUNDS, FOLDS = 3, 5
#: The sum below which a segment is no more than a chance word.
SMALL = 0.5
#: Largest chance of a segment of such a score in a harmless text.
P_VALUE = 1e-4

# A lexicon of general prior knowledge (insults, slurs that dehumanise, sexual offers, in four languages).
LEXICON = {
    "abusive": """idiot idiots moron morons imbecile imbeciles cretin cretins dimwit dimwits halfwit halfwits dumbass dumbasses jackass asshole assholes
arsehole bastard bastards scumbag scumbags loser losers wanker wankers prick twat twats dipshit douchebag fuckwit fuckface motherfucker shithead bitch bitches
nitwit numbskull dickhead dickheads lowlife
vollidiot vollidioten trottel arschloch arschlöcher wichser hurensohn dummkopf schwachkopf schwachköpfe depp deppen idioten mistkerl drecksau versager penner
missgeburt spast arschgesicht dreckskerl vollpfosten fresse
connard connards connasse abruti abrutis salaud salopard salope enculé enculés imbécile imbéciles enfoiré bouffon ordure crétin crétins crétine
gilipollas imbécil cabrón cabrones idiota idiotas pendejo pendejos capullo payaso hijoputa cretino malnacido""",
    "hateful": """vermin subhuman subhumans untermensch untermenschen cockroaches parasites savages degenerates mongrels filth ungeziefer abschaum parasiten kakerlaken
alimañas chusma escoria vermine racaille cafards parásitos cucarachas sabandijas""",
    "sexual": """porn porno nudes nude horny xxx topless blowjob blowjobs handjob orgasm masturbate masturbating hardcore escorts milf pussy cock dick boobs tits cum
anal threesome creampie stripper erotic sexy hentai fetish
nacktbilder nacktfotos sexbilder pornos ficken fotze titten muschi nackt geil
pornos desnuda desnudas desnudo follar tetas polla coño sexo nue nues baiser seins sexe""",
}
# Parts of general phrases; pairs are made of them by rule.
HARM = "break smash punch slap kick hurt kill stab strangle choke crush burn shoot beat hunt hang drown".split()
BODY = "fingers bones legs arms neck face teeth jaw nose skull head throat knees ribs mouth".split()
DIE = [("drop", "dead"), ("go", "die"), ("stop", "breathing"), ("kill", "yourself"), ("hang", "yourself"), ("jump", "off"), ("shut", "up"), ("your", "mother"), ("your", "mom"), ("ta", "gueule"), ("cállate", "la"), ("verpiss", "dich"), ("te", "taire")]
TOO, STUPID = "too zu trop demasiado".split(), "stupid dumb dumm blöd bête bêtes stupides tonto tonta tontos tontas".split()
#: Refusals of nearness, as scales of social distance ask for them.
SHUN = [(x, "next") for x in ("work", "live", "sit", "stand", "eat", "sleep")]
BED = [("into", "bed"), ("clothes", "off"), ("ins", "bett"), ("a", "poil"), ("moan", "louder"), ("strip", "naked"), ("naked", "pics"), ("naked", "photos"), ("get", "naked"), ("sex", "chat"), ("sex", "videos"), ("sex", "tape")]

# Function words and verbs of everyday use; they support a passage and never make one.
COMMON = """a an the and or but not no nor so if of in on at to by for from with as than then that this these those it its he she they them their there
here his her him i me my we us our you your is are was were be been being am do does did have has had can could will would should may might must shall up
down out off over all any every some such only just too very now never always ever what who whom whoever which when where why how go goes went come came
back take took send sent get got make made let put see want like hope know tell told ask asked free want use used wrote write who's people person folk""".split()

_UNSEEN = re.compile(r"[\u200b-\u200d\u2060\ufeff\u00ad]")
_ALIKE = str.maketrans("аеорсухіѕјԁһкмтнвгοαεινρτυ", "aeopcyxisjdhkmthvroaeivptu")
_LEET = str.maketrans("0134578$@!|+", "oieastbsaiit")
_SPELLED = re.compile(r"(?<![\w.])[^\W\d_](?:([.\-_ ])[^\W\d_])(?:\1[^\W\d_]){1,}(?![\w])")
_MAYBE_SPELLED = re.compile(r"\b[^\W\d_][.\-_ ][^\W\d_][.\-_ ][^\W\d_]\b")
_TOKEN = re.compile(r"[\w*$@]+")
_RUN = re.compile(r"(.)\1+")
_MIXED = re.compile(r"[a-z]")


def squeeze(word: str) -> str:
    """A word without accents and without doubled letters."""
    if not word.isascii():
        word = "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))
    return _RUN.sub(r"\1", word)


class Canonical(dict):
    """Canonical forms of tokens, each worked out when it is first asked for."""

    MOST = 500_000

    def __init__(self, work):
        self.work = work

    def __missing__(self, token: str) -> str:
        if len(self) > self.MOST:
            self.clear()
        self[token] = got = self.work(token)
        return got


class Reader:
    """Tokens of texts in canonical form; ``known`` are the canonical words disguises are resolved to."""

    def __init__(self, known: set[str]):
        self.known = known

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "lookup"}

    def _canonical(self, token: str) -> str:
        if token.isascii() and token.isalpha():
            return squeeze(token)
        if "*" in token:
            pattern = re.compile("".join(r"\w" if c == "*" else re.escape(c) for c in token.translate(_LEET) if c.isalnum() or c == "*"))
            if _MIXED.search(token):
                return next((w for w in self.raw if pattern.fullmatch(w)), "#")
            return "#"
        plain = squeeze(token.translate(_ALIKE)) if _MIXED.search(token) or not token.isascii() else token
        if any(c.isdigit() or c in "$@" for c in plain):
            if not any(c.isalpha() for c in plain) and not any(c in "$@" for c in plain):
                return "#"
            plain = squeeze(plain.translate(_LEET))
            return plain if plain in self.known else "#"
        if plain in self.known:
            return plain
        return squeeze(token)

    raw: list[str] = []

    def tokens(self, text: str) -> list[str]:
        text = text.lower()
        if not text.isascii():
            text = unicodedata.normalize("NFKC", text).lower()
            if _UNSEEN.search(text):
                text = _UNSEEN.sub("", text)
        if _MAYBE_SPELLED.search(text):
            text = _SPELLED.sub(lambda m: m[0].replace(m[1], ""), text)
        if "lookup" not in self.__dict__:
            self.lookup = Canonical(self._canonical).__getitem__
        return list(map(self.lookup, _TOKEN.findall(text.replace("_", " "))))


def lexicon_entries() -> dict[str, list[tuple[str, ...]]]:
    """The lexicon's words and the pairs made of its parts, in canonical form; entries without a letter are left out."""
    words = {c: [(w,) for w in text.split()] for c, text in LEXICON.items()}
    words["abusive"] += [(h, x) for h in HARM for x in ("you", "your")] + [("your", x) for x in BODY] + DIE
    words["hateful"] += [(t, x) for t in TOO for x in STUPID] + [(x, "country") for x in ("this", "our", "my")] + SHUN
    words["sexual"] += BED
    plain = {c: [tuple(squeeze("".join(re.findall(r"[^\W\d_]", w))) for w in e) for e in entries] for c, entries in words.items()}
    return {c: [e for e in dict.fromkeys(entries) if all(e)] for c, entries in plain.items()}


_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


class Model:
    """Log-odds per category: ``score[word]`` and ``score[(word, next)]`` are arrays over CATEGORIES, ``other`` that of
    all other tokens; ``scale`` (lambda) and ``size`` (K) are the extreme-value law's parameters per category."""

    def __init__(self, labelled: list[tuple[str, str]]):
        self.entries = lexicon_entries()
        raw = {w for text in LEXICON.values() for w in text.split()} | {w for t, c in labelled if t and c in CATEGORIES for w in re.findall(r"[^\W\d_]+", t.lower()) if w.isascii()}
        self.reader = Reader({squeeze(w) for w in raw})
        #: category and tokens of each labelled text's sentences
        self.texts = [(c, [s for s in map(self.reader.tokens, _SENTENCE.split(t)) if s]) for t, c in labelled if t and c in (*CATEGORIES, "none")]
        self.lexicon = {e if len(e) > 1 else e[0] for c in CATEGORIES for e in self.entries[c]}
        words = {w for items in self.entries.values() for e in items for w in e}
        harmless = {w for c, sentences in self.texts if c == "none" for s in sentences for w in s}
        telling, pairs = Counter(), Counter()
        for c, sentences in self.texts:
            if c != "none":
                telling.update(w for s in sentences for w in s if w not in harmless)
                pairs.update((c, p) for s in sentences for p in zip(s, s[1:]))
        # masked words are looked up among the lexicon's and the sample's telling words
        self.reader.raw = sorted({w for w in raw if squeeze(w) in words or telling[squeeze(w)]}, key=lambda w: (squeeze(w) not in words, -telling[squeeze(w)], w))
        self.vocabulary = words | {w for _, sentences in self.texts for s in sentences for w in s}
        self.pairs = {p for (_, p), n in pairs.items() if n >= 2} | {e for e in self.lexicon if isinstance(e, tuple)}
        self.score: dict = {}

    def fit(self, rates: dict, total: int, left_out: int | None = None) -> None:
        """``rates``: counts in the corpus of the vocabulary's words and pairs, among ``total`` tokens; ``left_out``: the fold
        of labelled texts that is not to be learned from."""
        texts = [x for i, x in enumerate(self.texts) if i % FOLDS != left_out]
        total, common = max(total, 1), {squeeze(w) for w in COMMON}
        chosen = [sentences if c != "none" else [] for c, sentences in texts]
        for turn in range(ROUNDS + 1):
            counts, sizes = {c: Counter() for c in (*CATEGORIES, "none")}, Counter()
            # of a passage's words their different neighbours are counted: a set phrase is one piece of evidence, however often it is told
            contexts: dict[str, dict] = {c: {} for c in CATEGORIES}
            for (c, sentences), own in zip(texts, chosen):
                for s in sentences:
                    if c != "none" and any(s is x for x in own):
                        for before, w, after in zip(["", *s], s, [*s[1:], ""]):
                            contexts[c].setdefault(w, set()).update([(before, 0), (after, 1)])
                        for pair, after in zip(zip(s, s[1:]), [*s[2:], ""]):
                            contexts[c].setdefault(pair, set()).add(after)
                    else:
                        counts["none"].update(s)
                        counts["none"].update(zip(s, s[1:]))
                        sizes["none"] += len(s)
            for c in CATEGORIES:
                counts[c].update({w: len(x) / (1 if isinstance(w, tuple) else 2) for w, x in contexts[c].items()})
                sizes[c] = sum(n for w, n in counts[c].items() if isinstance(w, str))
            for c, items in self.entries.items():
                for e in items:
                    counts[c][e if len(e) > 1 else e[0]] += SEED
            self._log_odds(counts, sizes, rates, total, common)
            if turn < ROUNDS:
                chosen = [[max(sentences, key=lambda s, k=CATEGORIES.index(c): self._best(s)[k])] if c != "none" and sentences else [] for c, sentences in texts]
        self._mentions(texts, chosen)

    def _log_odds(self, counts: dict, sizes: Counter, rates: dict, total: int, common: set[str]) -> None:
        none, n_none = counts["none"], max(sizes["none"], 1)
        size = np.array([max(sizes[c], 1) for c in CATEGORIES])
        pull = np.log(PRIOR / (size + PRIOR)) - np.log(PRIOR_NONE / (n_none + PRIOR_NONE))
        self.other, self.before, self.after = np.minimum(pull, -0.3) - MARGIN, {}, {}

        def raw(entries: list) -> tuple[np.ndarray, np.ndarray]:
            p = np.array([max(rates.get(w, 0), 0.5) for w in entries])[:, None] / total
            seen = np.array([[counts[c][w] for c in CATEGORIES] for w in entries])
            told = np.array([none[w] for w in entries])[:, None]
            value = np.log((seen + PRIOR * p) / (size + PRIOR)) - np.log((told + PRIOR_NONE * p) / (n_none + PRIOR_NONE))
            most = np.array([LIMIT_LEXICON if w in self.lexicon else MARGIN + LIMIT_COMMON if w in common else LIMIT for w in entries])[:, None]
            return np.clip(np.where(value > 0, np.maximum(value - CHANCE / np.sqrt(np.maximum(seen, 1)), 0), value), -LIMIT, most), told

        words, pairs = sorted(self.vocabulary), sorted(self.pairs)
        self.score = dict(zip(words, raw(words)[0] - MARGIN))
        if pairs:  # what a pair says beyond its words
            value, told = raw(pairs)
            first, second = (np.array([self.score_of(x[k]) for x in pairs]) for k in (0, 1))
            given = np.array([x in self.lexicon for x in pairs])[:, None]
            apart = np.where(given, first + second, np.maximum(first, 0) + np.maximum(second, 0))
            beyond = np.maximum(value - MARGIN - apart, 0)
            plain = np.array([common.issuperset(x) for x in pairs])[:, None] & ~given
            beyond = np.where(plain, np.minimum(beyond, LIMIT_COMMON), beyond)
            self.score.update(zip(pairs, np.where(told > 0, np.minimum(value - apart, 0), beyond)))

    def _mentions(self, texts: list, chosen: list) -> None:
        """Words that stand right before (after) strong words in harmless sentences and in no passage: a strong word there
        is mentioned or part of a term, and scores nothing."""
        for k, c in enumerate(CATEGORIES):
            strong = {w for w, v in self.score.items() if isinstance(w, str) and v[k] >= STRONG}
            around = {True: (set(), set()), False: (set(), set())}
            for (kind, sentences), own in zip(texts, chosen):
                for s in sentences:
                    before, after = around[any(s is x for x in own)] if kind in (c, "none") else (set(), set())
                    for a, b in zip(s, s[1:]):
                        if b in strong:
                            before.add(a)
                        if a in strong:
                            after.add(b)
            self.before[k], self.after[k] = around[False][0] - around[True][0] - strong, around[False][1] - around[True][1] - strong

    def _best(self, words: list[str]) -> np.ndarray:
        scores = np.array([self.score_of(w) for w in words]).reshape(-1, len(CATEGORIES))
        for i, pair in enumerate(zip(words, words[1:])):
            if pair in self.pairs:
                scores[i + 1] += self.score[pair]
        return best_segments(scores, np.array([len(words)]))[0]

    def score_of(self, word: str) -> np.ndarray:
        return self.score.get(word, self.other)

    def table(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
        """Scores of all tokens of the texts, one after the other, and each text's number of tokens."""
        words = [self.reader.tokens(t) for t in texts]
        return *self.table_of(words), words

    def table_of(self, words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        codes, uniques, counts = factorized(words)
        scores = np.array([self.score_of(u) for u in uniques]).reshape(-1, len(CATEGORIES))[codes]
        at, pairs = known_pairs(codes, uniques, counts, self.score.keys() & self.pairs)
        if pairs:
            scores[1:][at >= 0] += np.array([self.score[p] for p in pairs])[at[at >= 0]]
        if len(codes) > 1:
            firsts, lasts = np.cumsum(counts) - counts, np.cumsum(counts) - 1
            for k in self.before:
                strong = scores[:, k] >= STRONG
                before, after = (np.array([u in side[k] for u in uniques])[codes] for side in (self.before, self.after))
                mention = np.zeros(len(codes), bool)
                mention[1:] = strong[1:] & before[:-1]
                mention[firsts[counts > 0]] = False
                follows = np.zeros(len(codes), bool)
                follows[:-1] = strong[:-1] & after[1:]
                follows[lasts[counts > 0]] = False
                scores[mention | follows, k] = np.minimum(scores[mention | follows, k], self.other[k])
        return scores, counts


def factorized(words: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' tokens one after the other as codes, the word of each code, and each text's number of tokens."""
    counts = np.fromiter(map(len, words), np.int64, len(words))
    codes, uniques = pd.factorize(np.fromiter(chain.from_iterable(words), object, int(counts.sum())))
    return codes, uniques, counts


def known_pairs(codes: np.ndarray, uniques: np.ndarray, counts: np.ndarray, pairs: set) -> tuple[np.ndarray, list]:
    """For each token but the last the number of the known pair it begins (-1: none, or the next token is another text's), and
    the pairs by number."""
    place = {u: i for i, u in enumerate(uniques)}
    known = sorted((place[a] * len(uniques) + place[b], (a, b)) for a, b in pairs if a in place and b in place)
    out = np.full(max(len(codes) - 1, 0), -1, np.int64)
    if known and len(out):
        keys, key = np.array([k for k, _ in known]), codes[:-1] * len(uniques) + codes[1:]
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = keys[at] == key
        ends = np.cumsum(counts)
        hit[ends[(ends > 0) & (ends < len(codes))] - 1] = False
        out[hit] = at[hit]
    return out, [p for _, p in known]


def best_segments(scores: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The largest sum of neighbouring scores of each text and category (0 for none): sums from the start of the text, minus
    the smallest such sum before, for all texts at once."""
    out = np.zeros((len(counts), scores.shape[1]))
    has = counts > 0
    if not has.any():
        return out
    n = counts[has]
    starts = np.cumsum(n) - n
    for c in range(scores.shape[1]):
        total = np.cumsum(scores[:, c])
        before = np.concatenate([[0.0], total[:-1]])
        # shifting every text far below the one before it makes the running minimum start anew
        shift = np.repeat(np.arange(len(n)) * 1e6, n) + np.repeat(before[starts], n)
        low = np.minimum.accumulate(before - shift)
        out[has, c] = np.maximum(np.maximum.reduceat(total - shift - low, starts), 0)
    return out


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring subsequences (start, end, sum) of one text and category, by a linear scan that keeps a list of
    disjoint candidates with the sums before and after them."""
    found: list[tuple[int, int, float, float]] = []
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        start, left = i, before
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j -= 1
            if j < 0 or found[j][3] >= total:
                break
            start, left = found[j][0], found[j][2]
            del found[j:]
        found.append((start, i + 1, left, total))
    return [(a, b, r - l) for a, b, l, r in found]


def _corpus(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for b in batches:
            words = [model.reader.tokens(t) for t in b.column(0).to_pylist() if t]
            codes, uniques, counts = factorized(words)
            seen = np.bincount(codes, minlength=len(uniques))
            rows = [(w, int(n)) for w, n in zip(uniques, seen) if w in model.vocabulary] + [("", len(codes))]
            at, pairs = known_pairs(codes, uniques, counts, model.pairs)
            rows += [(" ".join(pairs[i]), int(n)) for i, n in enumerate(np.bincount(at[at >= 0], minlength=len(pairs))) if n]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows]), pa.array([n for _, n in rows], pa.int64())], ["word", "n"])

    return run


def fit(corpus: DataFrame, text: str, sample: DataFrame, sample_text: str = "text", category: str = "category") -> Model:
    """Fit on at most ``SAMPLE_ROWS`` labelled rows (ordered by text) and on word counts over the whole corpus; only the
    counts of the sample's and the lexicon's words reach the driver."""
    rows = sample.where(F.col(sample_text).isNotNull() & F.col(category).isNotNull()).select(F.col(sample_text).alias("text"), F.col(category).alias("category")).orderBy("text", "category").limit(SAMPLE_ROWS)
    model = Model([(r.text, r.category) for r in rows.collect()])
    shared = corpus.sparkSession.sparkContext.broadcast(model)
    counted = corpus.select(F.col(text).cast("string").alias("text")).where("text is not null").mapInArrow(_corpus(shared), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    rates = {r.word: r.n for r in counted.collect()}
    total = rates.pop("", 0)
    calibrated(model, {tuple(w.split(" ")) if " " in w else w: n for w, n in rates.items()}, total)
    return model


def calibrated(model: Model, rates: dict, total: int) -> Model:
    """Fit the scores and the extreme-value law. Lambda is the positive root of E[exp(lambda s)] = 1 over the corpus's tokens, K
    the maximum-likelihood value for the largest segments of harmless labelled texts, each scored by a fit that hasn't seen its
    fold; a text whose best is below ``SMALL`` counts as just that."""
    sizes, maxima = [], []
    for fold in range(FOLDS):
        held = [[w for s in sentences for w in s] for i, (c, sentences) in enumerate(model.texts) if i % FOLDS == fold and c == "none"]
        if held:
            model.fit(rates, total, fold)
            scores, counts = model.table_of(held)
            sizes.append(counts)
            maxima.append(best_segments(scores, counts))
    model.fit(rates, total)
    words = [w for w in model.score if isinstance(w, str)]
    p = np.array([rates.get(w, 0) for w in words], float) / max(total, 1)
    s = np.array([model.score[w] for w in words]).reshape(-1, len(CATEGORIES))
    rest = max(1 - p.sum(), 0)
    model.scale = np.array([_root(p, s[:, k], rest, model.other[k]) for k in range(len(CATEGORIES))])
    model.size = np.full(len(CATEGORIES), 1e-2)
    if maxima:
        n, best = np.maximum(np.concatenate(sizes), 1).astype(float)[:, None], np.concatenate(maxima)
        seen = (best > SMALL).sum()
        model.size[:] = max(seen, 1) / (n * np.exp(-model.scale * np.maximum(best, SMALL))).sum()
    return model


def _root(p: np.ndarray, s: np.ndarray, rest: float, other: float) -> float:
    """The positive root of sum p exp(x s) + rest exp(x other) = 1, at most 5."""
    lo, hi = 1e-3, 5.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (p * np.exp(mid * s)).sum() + rest * np.exp(mid * other) < 1 else (lo, mid)
    return (lo + hi) / 2


def p_values(model: Model, best: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The chance that a harmless text of as many tokens has a segment of this sum: 1 - exp(-K n exp(-lambda S))."""
    expected = model.size * np.maximum(counts, 1)[:, None] * np.exp(-model.scale * best)
    return np.where(best > 0, -np.expm1(-expected), 1.0)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            scores, counts, words = model.table(texts)
            best = best_segments(scores, counts)
            p = p_values(model, best, counts)
            ends = np.cumsum(counts)
            categories, passages = [None] * len(texts), [None] * len(texts)
            for i in np.flatnonzero((p < P_VALUE).any(1)):
                own = scores[ends[i] - counts[i] : ends[i]]
                found = []
                for c in np.flatnonzero(p[i] < P_VALUE):
                    for x, y, s in segments(own[:, c]):
                        chance = float(p_values(model, np.full((1, len(CATEGORIES)), s), counts[i : i + 1])[0, c])
                        if chance < P_VALUE:
                            found.append((chance, -s, int(c), x, y))
                found.sort()
                kept: list = []
                for f in found:  # a passage belongs to the category it is most significant in
                    if all(f[4] <= k[3] or f[3] >= k[4] for k in kept):
                        kept.append(f)
                categories[i] = sorted({CATEGORIES[f[2]] for f in kept})
                passages[i] = [" ".join(words[i][f[3] : f[4]]) for f in kept]
            score = np.round(-np.log10(np.maximum(p, 1e-30)), 4)
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(score[:, c]) for c in range(len(CATEGORIES))), pa.array(categories, pa.list_(pa.string())), pa.array(passages, pa.list_(pa.string()))], ["id", *CATEGORIES, "categories", "passages"])

    return run


def score(df: DataFrame, model: Model, row_id: str, text: str, *keep: str) -> DataFrame:
    """Every row with abusive, hateful, sexual (minus log10 of the p-value of its best segment, 0: none), categories and
    passages (null where nothing is significant) and the columns ``keep``. Null and empty texts score 0; equal rows come
    out once each; texts are scanned whole."""
    kind = df.schema[row_id].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)
    kept = F.struct(F.col(row_id).alias("id"), *[F.col(k) for k in keep])
    rows = df.select(kept.alias("id"), F.col(text).cast("string").alias("text"))
    inner = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_score(shared), f"id {inner}, " + ", ".join(f"{c} double" for c in CATEGORIES) + ", categories array<string>, passages array<string>")
    return out.select(F.col("id.id").cast(kind).alias(row_id), *[F.col(f"id.{k}") for k in keep], *CATEGORIES, "categories", "passages")


def rates(scored: DataFrame, source: str = "source_name") -> DataFrame:
    """Rows and flagged rows per source (null is a source of its own): pre-aggregated before the shuffle."""
    flagged = [F.count_if(F.array_contains("categories", c)).alias(c) for c in CATEGORIES]
    out = scored.groupBy(source).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("categories").isNotNull()).alias("flagged"), *flagged)
    return out.withColumn("rate", F.round(F.col("flagged") / F.col("rows"), 6))
