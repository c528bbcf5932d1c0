"""Languages of texts and of their parts by a linear-chain conditional random field.

Words are labelled with languages from affix, letter n-gram, letter and lexicon
features; transitions are learned, and forward-backward gives each word's
distribution, so that a passage in a second language shows inside a text. The
model is trained on story paragraphs of a bounded sample: function words and
scripts label them first, then the field trained on these labels its own words
anew and is trained once more.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import mainbody
from weftline.llm.lines import key_number, mend

LANGUAGES = ("en", "es", "fr", "de", "it", "pt", "tr", "ru", "uk", "ar", "fa", "hi", "th", "zh", "ja")
#: Story paragraphs of the sample that the field is trained on.
TRAIN_PARAGRAPHS = 1_500

# Common function words by language.
FUNCTION_WORDS = {
    "en": "the of and in to was with for that from said were at by a",
    "es": "el los las de del que en para una con por y un la",
    "fr": "les des du une est et dans pour avec sur à ont de la un ne",
    "de": "der die das und den von mit nach bei zu ein eine ohne dem",
    "it": "gli della dei il di che con una per sono hanno le un la",
    "pt": "os as dos das não uma com para em o de da ao por",
    "tr": "ve bir bu için ile sonra kadar olan günü göre önce rağmen dedi",
    "ru": "и в во что из с по его как к ещё этом после",
    "uk": "і та у що з від його біля після й під ще цьому",
    "ar": "في من على إلى أن قرب بعد دون هذا مع التي",
    "fa": "در از به را که با این برای است و های",
}
# English names of the languages as labels use them.
NAMES = {
    "english": "en", "spanish": "es", "french": "fr", "german": "de", "italian": "it", "portuguese": "pt", "turkish": "tr", "russian": "ru",
    "ukrainian": "uk", "arabic": "ar", "persian": "fa", "farsi": "fa", "hindi": "hi", "thai": "th", "chinese": "zh", "japanese": "ja",
    "eng": "en", "spa": "es", "fra": "fr", "deu": "de", "ita": "it", "por": "pt", "tur": "tr", "rus": "ru", "ukr": "uk", "ara": "ar", "fas": "fa",
    "hin": "hi", "tha": "th", "zho": "zh", "jpn": "ja",
}
_MARKS = ".,;:!?\"()«»„“”…؟،؛।。！？「」『』、，；：‹›—–·•|/\\<>#*[]{}=+"
_FAR_MARKS = re.compile("[" + "".join(c for c in _MARKS if not c.isascii()) + "]")
#: ASCII marks as blanks.
_PLAIN = bytes(32 if b < 128 and chr(b) in _MARKS else b for b in range(256))
_SCRIPTS = (
    ("th", re.compile("[฀-๿]")), ("ja", re.compile("[぀-ヿ]")), ("zh", re.compile("[㐀-鿿]")),
    ("hi", re.compile("[ऀ-ॿ]")), ("ar", re.compile("[؀-ۿ]")), ("ru", re.compile("[Ѐ-ӿ]")),
)


def label_code(label: Column) -> Column:
    """The two-letter code that a label in any notation names; null if it names no language."""
    word = F.lower(F.regexp_extract(F.trim(label), r"^([A-Za-z]+)", 1))
    codes = F.create_map(*[F.lit(x) for pair in (NAMES | {c: c for c in LANGUAGES}).items() for x in pair])
    known = codes[word]
    other = F.when(F.length(word) == 2, word)
    return F.when(word.isin("", "und", "unknown", "none", "null", "na"), None).otherwise(F.coalesce(known, other))


def script_of(word: str) -> str:
    if word.isascii():
        return "latin"
    for name, pattern in _SCRIPTS:
        if pattern.search(word):
            return name
    return "latin"


def features(word: str) -> list[str]:
    """Features of one word."""
    if word.isascii() and (word.isupper() and len(word) > 1 or not word.isalpha() and any(c.isdigit() for c in word)):
        return ["mark"]
    w = word.lower()
    script = script_of(w)
    out = [f"script {script}"]
    if script in ("th", "ja", "zh"):
        return out + ([f"word {w}"] if len(w) < 9 else []) + (["long run"] if len(w) >= 6 else [])
    out += [f"word {w}", f"start {w[:3]}", f"end {w[-3:]}", f"end {w[-2:]}"]
    edged = f"^{w}$"
    out += {f"gram {edged[i:i + 3]}" for i in range(len(edged) - 2)}
    if not w.isascii():
        out += {f"letter {c}" for c in w if ord(c) > 127}
    return out


_OF_SCRIPT = {"th": ("th",), "ja": ("ja",), "zh": ("zh", "ja"), "hi": ("hi",), "ar": ("ar", "fa"), "ru": ("ru", "uk")}
_MASKS = {s: np.array([1.0 if c in own else 1e-6 for c in LANGUAGES], np.float32) for s, own in _OF_SCRIPT.items()}
_MASKS["latin"] = np.ones(len(LANGUAGES), np.float32)


def words_of(text: str) -> list[str]:
    text = text.encode().translate(_PLAIN).decode()
    return (text if text.isascii() else _FAR_MARKS.sub(" ", text)).split()


_QUOTE = re.compile("[“«„「\"]")
_QUOTED = re.compile("“[^”]*”?|«[^»]*»?|„[^“”]*[“”]?|「[^」]*」?|\"[^\"]*\"")


def words_and_voice(text: str) -> tuple[list[str], np.ndarray | None]:
    """Words, and which of them stand outside quotations (None if all do, or none)."""
    if not _QUOTE.search(text):
        return words_of(text), None
    words: list[str] = []
    outside: list[bool] = []
    at = 0
    for m in (*_QUOTED.finditer(text), None):
        plain = words_of(text[at:m.start()] if m else text[at:])
        words += plain
        outside += [True] * len(plain)
        if m:
            said = words_of(m[0])
            words += said
            outside += [False] * len(said)
            at = m.end()
    mask = np.array(outside, bool)
    return words, mask if mask.any() and not mask.all() else None


def first_label(words: list[str]) -> str | None:
    """The language that function words or script give a paragraph, or None if they don't clearly."""
    scripts = Counter(script_of(w) for w in words if not (w.isascii() and (w.isupper() or not w.isalpha())))
    if not scripts:
        return None
    script = scripts.most_common(1)[0][0]
    if script in ("ja", "zh") and scripts["ja"]:
        return "ja"
    if script in ("th", "zh", "hi"):
        return script
    group = {"latin": ("en", "es", "fr", "de", "it", "pt", "tr"), "ru": ("ru", "uk"), "ar": ("ar", "fa")}[script]
    hits = Counter({g: 0 for g in group})
    for w in words:
        for g in group:
            hits[g] += w.lower() in _FUNCTION_SETS[g] or bool(script != "latin" and (own := _OWN_LETTERS.get(g)) and own.search(w))
    (a, n), (_, m) = hits.most_common(2)
    return a if n >= 2 and n >= m + 1 + m // 3 else None


# Letters of one language of a script only.
_OWN_LETTERS = {"uk": re.compile("[іїєґІЇЄҐ]"), "ru": re.compile("[ыэъёЫЭЪЁ]"), "fa": re.compile("[پچژگکی]")}
_FUNCTION_SETS = {k: set(v.split()) for k, v in FUNCTION_WORDS.items()}


class LanguageField:
    """Emission weights, transitions and a cache of word emissions."""

    def __init__(self) -> None:
        n = len(LANGUAGES)
        self.rows: dict[str, int] = {}
        self.weights = np.zeros((0, n), np.float32)
        self.steps = np.full((n, n), 0.01 / (n - 1), np.float32)
        np.fill_diagonal(self.steps, 0.99)
        self.forget()

    def forget(self) -> None:
        self.ids: dict[str, int] = {}
        self.emit = np.zeros((4096, len(LANGUAGES)), np.float32)

    def __getstate__(self) -> dict:
        return {"rows": self.rows, "weights": self.weights, "steps": self.steps}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.forget()

    def word_ids(self, words: list[str]) -> np.ndarray:
        ids = self.ids
        try:
            return np.fromiter(map(ids.__getitem__, words), np.int32, len(words))
        except KeyError:
            for w in words:
                if w not in ids:
                    self._add(w)
            return np.fromiter(map(ids.__getitem__, words), np.int32, len(words))

    def _add(self, word: str) -> None:
        i = len(self.ids)
        if i == len(self.emit):
            self.emit = np.concatenate([self.emit, np.zeros_like(self.emit)])
        rows = [r for f in features(word) if (r := self.rows.get(f)) is not None]
        score = self.weights[rows].sum(0) if rows else np.zeros(len(LANGUAGES), np.float32)
        self.emit[i] = np.exp(np.maximum(score - score.max(), -12)) * _MASKS[script_of(word)]
        self.ids[word] = i

    def posteriors(self, texts: list[list[int] | np.ndarray]) -> list[np.ndarray]:
        """Each text's (words x languages) distributions."""
        out: list[np.ndarray] = [np.zeros((0, len(LANGUAGES)), np.float32)] * len(texts)
        for group, _, found in self._groups(texts):
            for j, i in enumerate(group):
                out[i] = found[:len(texts[i]), j]
        return out

    def leading(self, texts: list[np.ndarray], voices: list[np.ndarray | None]) -> list[int]:
        """The language with the largest sum of shares over each text's words, those of its mask if it has one."""
        out = [0] * len(texts)
        for group, real, found in self._groups(texts):
            for j, i in enumerate(group):
                if voices[i] is not None:
                    real[:len(texts[i]), j] = voices[i]
            found *= real[:, :, None]
            for i, top in zip(group, found.sum(0).argmax(1).tolist()):
                out[i] = top
        return out

    def _groups(self, texts: list[list[int] | np.ndarray], chunk_cells: int = 400_000) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """(numbers of texts, which cells of words x texts are words, their distributions) by forward-backward; texts of like length go together."""
        order = sorted((i for i, t in enumerate(texts) if len(t)), key=lambda i: len(texts[i]))
        at = 0
        while at < len(order):
            longest, n = len(texts[order[at]]), 0
            while at + n < len(order) and n < 2048:
                longest = len(texts[order[at + n]])
                if n and longest * (n + 1) * len(LANGUAGES) > chunk_cells * 4:
                    break
                n += 1
            group = order[at:at + n]
            at += n
            longest = len(texts[group[-1]])
            real = np.arange(longest)[:, None] < np.array([len(texts[i]) for i in group])
            ids = np.zeros((n, longest), np.int32)
            ids[real.T] = np.concatenate([texts[i] for i in group])
            e = self.emit[ids.T]
            e[~real] = 1.0
            ahead = np.empty_like(e)
            a = e[0] / e[0].sum(1, keepdims=True)
            ahead[0] = a
            for t in range(1, longest):
                a = (a @ self.steps) * e[t]
                a /= a.sum(1, keepdims=True)
                ahead[t] = a
            b = np.ones_like(a)
            back_steps = np.ascontiguousarray(self.steps.T)
            for t in range(longest - 2, -1, -1):
                b = (e[t + 1] * b) @ back_steps
                b /= b.max(1, keepdims=True)
                ahead[t] *= b
            ahead /= ahead.sum(2, keepdims=True)
            yield group, real, ahead

    def train(self, texts: list[list[str]], labels: list[np.ndarray], rounds: int = 12, rate: float = 0.35) -> None:
        """Ascent on the conditional likelihood of the labels (languages x words one-hot), transitions from their counts."""
        n = len(LANGUAGES)
        vocabulary: dict[str, int] = {}
        ids = [[vocabulary.setdefault(w, len(vocabulary)) for w in t] for t in texts]
        rows: dict[str, int] = {}
        per = [[rows.setdefault(f, len(rows)) for f in features(w)] for w in vocabulary]
        flat = np.array([r for p in per for r in p], np.int64)
        owner = np.repeat(np.arange(len(per)), [len(p) for p in per])
        masks = np.stack([_MASKS[script_of(w)] for w in vocabulary])
        gold = np.zeros((len(vocabulary), n))
        for t, y in zip(ids, labels):
            np.add.at(gold, t, y)
        counts = np.stack([np.bincount(flat, gold[owner, k], len(rows)) for k in range(n)], 1)
        seen = counts.sum(1, keepdims=True)
        counts, keep = counts[:, :], (seen[:, 0] >= 2)
        share = (counts + 0.1) / (seen + 0.1 * n)
        self.weights = (0.3 * (np.log(share) - np.log(share).mean(1, keepdims=True)) * keep[:, None]).astype(np.float32)
        steps = np.full((n, n), 0.05)
        np.fill_diagonal(steps, 5.0)
        for y in labels:
            if len(y) > 1:
                steps += y[:-1].T @ y[1:]
        self.steps = (steps / steps.sum(1, keepdims=True)).astype(np.float32)
        push, size = np.zeros_like(self.weights), np.zeros_like(self.weights)
        for step in range(1, rounds + 1):
            score = np.stack([np.bincount(owner, self.weights[flat, k], len(per)) for k in range(n)], 1)
            self.emit = np.exp(np.clip(score - score.max(1, keepdims=True), -12, 0)).astype(np.float32) * masks
            off = gold.copy()
            for t, p in zip(ids, self.posteriors(ids)):
                np.subtract.at(off, t, p)
            slope = np.stack([np.bincount(flat, off[owner, k], len(rows)) for k in range(n)], 1) / np.sqrt(seen + 1.0) - 0.01 * self.weights
            push, size = 0.8 * push + 0.2 * slope, 0.95 * size + 0.05 * slope**2
            self.weights = ((self.weights + rate * (push / (1 - 0.8**step)) / (np.sqrt(size / (1 - 0.95**step)) + 0.1) * 0.3) * keep[:, None]).astype(np.float32)
        self.rows = {f: i for f, i in rows.items() if keep[i]}
        self.forget()


def fit(paragraphs: list[str]) -> LanguageField:
    """A field from paragraphs in any of the languages, and the function words."""
    texts, labels, open_texts = [], [], []
    n = len(LANGUAGES)
    one = np.eye(n)
    for p in paragraphs:
        words = words_of(mend(p))
        if (label := first_label(words)) is not None:
            texts.append(words)
            labels.append(np.repeat(one[LANGUAGES.index(label)][None], len(words), 0))
        elif words:
            open_texts.append(words)
    for code, words in FUNCTION_WORDS.items():
        texts += [words.split()] * 2
        labels += [np.repeat(one[LANGUAGES.index(code)][None], len(words.split()), 0)] * 2
    for code, run in (("th", "ทหาร รัฐบาล"), ("zh", "政府 军队"), ("ja", "政府 軍は した の"), ("hi", "सरकारी सैनिकों ने को के में")):
        texts += [run.split()] * 2
        labels += [np.repeat(one[LANGUAGES.index(code)][None], len(run.split()), 0)] * 2
    field = LanguageField()
    field.train(texts, labels, rounds=8)
    again = field.posteriors([field.word_ids(t) for t in texts])
    # A run of at least four words that the field reads otherwise than the paragraph's label is taken as read.
    for y, p in zip(labels, again):
        best = p.argmax(1)
        off = (best != y[0].argmax()) & (p.max(1) > 0.9) if len(y) else np.zeros(0, bool)
        start = 0
        for i in range(len(off) + 1):
            if i == len(off) or not off[i]:
                if i - start >= 4:
                    y[start:i] = one[best[start:i]]
                start = i + 1
    for t, p in zip(open_texts, field.posteriors([field.word_ids(t) for t in open_texts])):
        if (mean := p.mean(0)).max() > 0.75:
            texts.append(t)
            labels.append(np.repeat(one[mean.argmax()][None], len(t), 0))
    field.train(texts, labels, rounds=8)
    return field


def fit_on(articles: DataFrame) -> tuple[mainbody.PageModel, LanguageField]:
    """Page model and language field from the bounded sample of articles; repeated lines are counted over all."""
    keyed, sample = mainbody.keyed_and_sample(articles)
    pages = mainbody.fit(sample, repeated=mainbody.corpus_repeats(keyed))
    paragraphs = set()
    for domain, text in sample:
        at, story, none = pages.read(text, domain)
        if not none:
            cut = text.split("\n")
            paragraphs |= {cut[i] for i, s in zip(at, story) if s}
    return pages, fit(sorted(paragraphs, key=key_number)[:TRAIN_PARAGRAPHS])


_PARAGRAPH = "globaleventid long, line_no int, lang string, confidence double, n_words int, parts array<struct<lang:string,n_words:int,confidence:double>>"


def _read_batch(pages: mainbody.PageModel, field: LanguageField, pdf: pd.DataFrame) -> tuple[list[tuple], list[np.ndarray], list[np.ndarray | None]]:
    """Of a batch of articles: (row, line number, characters) of each story paragraph, its words' ids in the field, and its mask of words outside quotations."""
    if len(field.ids) > 300_000:
        field.forget()
    where, ids, voices = [], [], []
    for row, (domain, text) in enumerate(zip(pdf["domain"], pdf["text"])):
        at, story, none = pages.read(text, domain)
        if none:
            continue
        cut = text.split("\n")
        for n, s in zip(at, story):
            if s:
                line = mend(cut[n])
                words, voice = words_and_voice(line.lower() if line.isupper() else line)
                if words:
                    where.append((row, n, len(line)))
                    ids.append(field.word_ids(words))
                    voices.append(voice)
    return where, ids, voices


def _usable(articles: DataFrame) -> DataFrame:
    return articles.where("globaleventid is not null and text is not null").select("globaleventid", "article_language", "domain", "text")


def story_paragraphs(articles: DataFrame, models: tuple[mainbody.PageModel, LanguageField] | None = None) -> DataFrame:
    """One row per story paragraph: its language with confidence, and its runs of words by language.

    Words outside quotations decide a paragraph's language if there are any.
    Lines outside the story and articles that hold no story are left out, as are rows without id or text.
    """
    models = models or fit_on(articles)
    shared = articles.sparkSession.sparkContext.broadcast(models)

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pages, field = shared.value
        for pdf in batches:
            keys = pdf["globaleventid"].tolist()
            rows = []
            where, ids, voices = _read_batch(pages, field, pdf)
            for (row, n, _), p, voice in zip(where, field.posteriors(ids), voices):
                mean = p.mean(0) if voice is None else p[voice].mean(0)
                top = int(mean.argmax())
                best = p.argmax(1)
                edges = (np.flatnonzero(np.diff(best)) + 1).tolist()
                parts = [{"lang": LANGUAGES[best[a]], "n_words": b - a, "confidence": float(p[a:b, best[a]].mean())} for a, b in zip([0, *edges], [*edges, len(best)])]
                rows.append((keys[row], n, LANGUAGES[top], float(mean[top]), len(best), parts))
            yield pd.DataFrame(rows, columns=["globaleventid", "line_no", "lang", "confidence", "n_words", "parts"])

    return _usable(articles).mapInPandas(go, _PARAGRAPH)


def article_languages(articles: DataFrame, models: tuple[mainbody.PageModel, LanguageField] | None = None) -> DataFrame:
    """(globaleventid, label, langs): the languages with whole paragraphs, the one with most characters first (ties in code order).

    Repeated rows of an article collapse; of several labels the first in byte order counts.
    """
    models = models or fit_on(articles)
    shared = articles.sparkSession.sparkContext.broadcast(models)

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pages, field = shared.value
        for pdf in batches:
            sums: dict[int, Counter] = {}
            where, ids, voices = _read_batch(pages, field, pdf)
            for (row, _, size), top in zip(where, field.leading(ids, voices)):
                sums.setdefault(row, Counter())[LANGUAGES[top]] += size
            at = list(sums)
            yield pd.DataFrame({
                "globaleventid": pdf["globaleventid"].to_numpy()[at], "label": pdf["article_language"].to_numpy()[at],
                "langs": [sorted(c, key=lambda k, c=c: (-c[k], k)) for c in sums.values()],
            }) if at else pd.DataFrame({"globaleventid": [], "label": [], "langs": []})

    rows = _usable(articles).mapInPandas(go, "globaleventid long, label string, langs array<string>")
    return rows.groupBy("globaleventid").agg(F.min("label").alias("label"), F.max("langs").alias("langs"))


def wrong_or_mixed(articles: DataFrame, models: tuple[mainbody.PageModel, LanguageField] | None = None) -> DataFrame:
    """(globaleventid, lang) of articles with a missing or wrong label, or with whole paragraphs in several languages."""
    found = article_languages(articles, models)
    label = label_code(F.col("label"))
    return found.where((F.size("langs") > 1) | label.isNull() | (label != F.col("langs")[0])).select("globaleventid", F.explode("langs").alias("lang"))
