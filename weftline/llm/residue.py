"""Template residue, filler and error pages by positive-unlabelled naive Bayes.

Trusted positives are passages with unfilled slots, filler or server wording
and the residue lines of the labelled table. All other passages are unlabelled:
expectation maximization gives each a share of being residue and learns the
words of both classes. Records are decided by their passages: where the page
model sees story, the passage that is least like residue speaks for the record,
else the one that is most like it, and to its log likelihood ratio come the log prior odds of the
record's kind, learned by expectation maximization from records that surely hold residue or a story.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame

from weftline.llm.lines import line_key, units

# Marks of unfilled slots, filler and machine output that a reporter does not write.
TRUSTED = re.compile(
    r"\{\{.*?\}\}|\$\{.*?\}|<%.*?%>|%%\w+%%|\{\d\}.*\{\d\}|\[\[.*?\]\]|\blorem ipsum\b|\bTK TK\b|^\W*(?:4|5)\d\d\b(?! \w+ (?:people|homes))|"
    r"^\s*\{\s*\"\w+\"\s*:|Traceback \(most recent|\bundefined variable\b|\[object Object\]|\bJavaScript\b|"
    r"\b(?:Forbidden|Bad Gateway|Not Found|Gateway Timeout)\b|\btest test\b|^\W*\[(?:insert|paragraph|your|name)\b|^__[A-Z_0-9]+__$",
    re.I,
)
_MARKS = re.compile(r"\{\{|\}\}|\$\{|<%|%>|%%|\[\[|\]\]|\{\d+\}|\{\"|\":")


def words_of(line: str) -> list[str]:
    """Distinct units of a passage, with pairs of neighbours and slot marks."""
    u = units(line)
    marks = {f"mark {m if not m[1:2].isdigit() else '{n}'}" for m in _MARKS.findall(line)}
    return list({*u, *map(" ".join, zip(u, u[1:])), *marks})


class ResidueModel:
    def __init__(self) -> None:
        self.weights: dict[str, float] = {}
        self.bias = -3.0
        self.priors = [-3.0, 0.0, -3.0]
        self._known: dict[str, float] = {}

    def fit(self, residue: list[str], stories: list[str], free: list[str], leaning: set[str] | None = None, rounds: int = 8) -> None:
        """``residue``: trusted positive lines; ``stories``: sure negatives; ``free``: unlabelled lines, of which ``leaning`` (keys) start as likely positives."""
        leaning = leaning or set()
        known = {line_key(x): x for x in residue}
        pages = Counter(map(line_key, residue))
        sure = {k: x for x in stories if (k := line_key(x)) not in known}
        rest = {k: x for x in free if (k := line_key(x)) not in known and k not in sure}
        docs = [words_of(x) for x in (*known.values(), *sure.values(), *rest.values())]
        fixed = len(known) + len(sure)
        share = np.array([1.0] * len(known) + [0.0] * len(sure) + [0.8 if k in leaning else 0.05 for k in rest])
        ids: dict[str, int] = {}
        flat = np.array([ids.setdefault(w, len(ids)) for d in docs for w in d], dtype=np.int64)
        sizes = np.array([len(d) for d in docs])
        owner = np.repeat(np.arange(len(docs)), sizes)
        seen = np.bincount(flat, minlength=len(ids))
        # A word of one line only counts if the line is on several of the pages.
        often = np.zeros(len(docs), bool)
        often[:len(known)] = [pages[k] >= 2 for k in known]
        kept = (seen >= 2) | (np.bincount(flat, often[owner], len(ids)) > 0)
        keep = kept[flat]
        flat, owner = flat[keep], owner[keep]
        found = np.bincount(owner, minlength=len(docs))
        weight = np.zeros(len(ids))
        for _ in range(rounds):
            pos = np.bincount(flat, share[owner], len(ids))
            n = share.sum()
            weight = np.log((pos + 0.05) / (n + 1.1)) - np.log((seen - pos + 0.05) / (len(docs) - n + 1.1))
            self.bias = math.log((n + 1.0) / (len(docs) - n + 1.0))
            logit = self.bias + np.bincount(owner, weight[flat], len(docs)) / (1 + 0.12 * found)
            share[fixed:] = (1 / (1 + np.exp(-np.clip(logit, -30, 30))))[fixed:]
        self.weights = {w: float(weight[i]) for w, i in ids.items() if kept[i]}
        self._known.clear()

    def logit(self, line: str) -> float:
        """Log odds of a passage being residue."""
        known = self._known.get(line)
        if known is None:
            found = [v for v in map(self.weights.get, words_of(line)) if v is not None]
            known = max(-30.0, min(30.0, self.bias + sum(found) / (1 + 0.12 * len(found))))
            if len(line) < 120:
                if len(self._known) > 100_000:
                    self._known.clear()
                self._known[line] = known
        return known

    def score(self, line: str) -> float:
        """How likely a passage is residue, 0 to 1."""
        return 1 / (1 + math.exp(-self.logit(line)))

    def evidence(self, lines: list[str], story: list[bool], furniture: list[bool]) -> tuple[int, float]:
        """(kind, log likelihood ratio) of a record: kind 0 with story passages, 1 without but with passages that are no known furniture of a site, 2 with nothing else."""
        if any(story):
            return 0, min(self.logit(x) for x, s in zip(lines, story) if s) - self.bias
        return (2 if all(furniture) else 1), max(map(self.logit, lines)) - self.bias

    def fit_records(self, shown: list[tuple[int, float, float | None]], rounds: int = 8) -> None:
        """Log prior odds of each kind of record from (kind, log likelihood ratio, 1 for sure residue or 0 for a sure story or None)."""
        kinds = np.array([x[0] for x in shown], np.int64)
        told = np.array([x[1] for x in shown])
        known = np.array([math.nan if x[2] is None else x[2] for x in shown], float)
        priors = np.array([-3.0, 0.0, -3.0])
        for _ in range(rounds):
            share = np.where(np.isnan(known), 1 / (1 + np.exp(-np.clip(priors[kinds] + told, -30, 30))), known)
            hits, n = np.bincount(kinds, share, 3), np.bincount(kinds, minlength=3)
            priors = np.log((hits + 0.5) / (n - hits + 0.5))
        self.priors = [float(x) for x in priors]

    def holds_no_story(self, lines: list[str], story: list[bool], furniture: list[bool]) -> bool:
        """Whether the page holds residue only; ``story`` is the page model's view of each line, ``furniture`` tells which lines its site is known to repeat."""
        if any(story):  # the first passage that speaks for a story decides, as the least one would
            least = self.bias - self.priors[0]
            return all(self.logit(x) > least for x in sorted((x for x, s in zip(lines, story) if s), key=len))
        kind, told = self.evidence(lines, story, furniture)
        return self.priors[kind] + told > 0


def no_story_articles(articles: DataFrame, model=None) -> DataFrame:
    """(globaleventid) of the articles that hold no story; rows without id or text, and blank texts, are no cases."""
    from weftline.llm import mainbody

    model = model or mainbody.fit_on(articles)
    return mainbody.read_pages(articles, model).where("no_story").select("globaleventid").distinct()
