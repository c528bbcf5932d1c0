"""Main body of pages: flat text blocks classified by a decision tree.

A block is a line. Its features are its length in words, sentence ends, share
of link-like marks (separators of menus, tag lists and teasers), how much its words belong to furniture or to stories, and
the same of its neighbours. Which lines a site repeats is counted over all
articles. The word weights come from the pages themselves (lines that a site
repeats against long lines that occur once) over a bounded sample; the tree is
trained on the small labelled table in labelled_pages.
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import labelled_pages, residue
from weftline.llm.lines import END, fresh_key, key_number, line_key, mend, units
from weftline.session import cut

#: Articles of the sample that word weights and the residue model are fitted on.
SAMPLE_ROWS = 3_000
#: Sites of the sample from which on a line that they have is no sign of a story by itself.
SHARED_SITES = 3
#: Different texts of a site that hold a line which counts as repeated there.
LEAST_TEXTS = 5

#: A line names its site if the name is at least one in so many of its letters: a long paragraph may tell of its paper in a story.
NAME_SHARE = 40

_NONE = (0.0,) * 7
#: Link-like marks; no two kinds of them can overlap, so each is sought by its own first letters.
_DASH, _SPACED, _FAR_MARK = re.compile(r"[/–—-]\s"), re.compile(r"\s[/–—-]\s"), re.compile("[·•»،、，]")


def tree(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 3) -> tuple:
    """A CART of nested tuples (feature, cut, low branch, high branch) with the share of class 1 in its leaves."""
    share = float(y.mean()) if len(y) else 0.5
    if depth == 0 or len(y) < 2 * least or share in (0.0, 1.0):
        return ((y.sum() + 0.5) / (len(y) + 1.0),)
    best = (1e-9, None, 0.0)
    base = share * (1 - share) * len(y)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        xs, ys = x[order, f], y[order]
        ones, k = np.cumsum(ys)[:-1], np.arange(1, len(ys))
        rest, m = ys.sum() - ones, len(ys) - k
        gain = base - (ones * (1 - ones / k) + rest * (1 - rest / m))
        gain[(xs[1:] - xs[:-1] < 1e-9) | (k < least) | (m < least)] = -1
        i = int(gain.argmax()) if len(gain) else 0
        if len(gain) and gain[i] > best[0]:
            best = (float(gain[i]), f, float(xs[i] + xs[i + 1]) / 2)
    if best[1] is None:
        return ((y.sum() + 0.5) / (len(y) + 1.0),)
    low = x[:, best[1]] <= best[2]
    return best[1], best[2], tree(x[low], y[low], depth - 1, least), tree(x[~low], y[~low], depth - 1, least)


def site_of(domain: str | None) -> str:
    """A site's name as it may stand in line keys: that of the domain's first label; '' if that says little."""
    name = line_key((domain or "").lower().removeprefix("www.").split(".")[0])
    return name if len(name) > 5 else ""


def names_site(key: str, site: str) -> bool:
    """Whether the line of a key is one that names its site."""
    return bool(site) and len(key) <= NAME_SHARE * len(site) and site in key


def link_marks(text: str) -> int:
    """Separators of menus, tag lists and teasers in a text, and its addresses."""
    raw = text.encode()
    n = len(raw) - len(raw.translate(None, b"|>#,")) + (len(_SPACED.findall(text)) if _DASH.search(text) else 0) + raw.count(b"http:") + raw.count(b"https:") + raw.count(b"www.")
    return n if raw.isascii() else n + len(_FAR_MARK.findall(text))


def leaf(node: tuple, row: list[float]) -> float:
    while len(node) == 4:
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node[0]


class PageModel:
    """Labels the lines of a page as story or not, and decides whether a page holds a story at all."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}
        self.nodes: tuple = (0.5,)
        self.residue = residue.ResidueModel()
        self.repeated = array("q")
        self.counted = False
        self._known: dict[str, tuple] = {}

    def forget(self) -> None:
        self._known.clear()

    def repeats(self, key: str) -> bool:
        """Whether some site repeats the line of this key in the whole table."""
        at = bisect_left(self.repeated, number := key_number(key))
        return at < len(self.repeated) and self.repeated[at] == number

    def _block(self, line: str, site: str) -> tuple[tuple[float, ...], str, bool]:
        """Of one line: (words, sentence ends, ends with a sentence end, weight per word, link marks per word, letters, names its site), its key, and whether it is known furniture."""
        known = self._known.get(line)
        if known is None:
            text = mend(line).strip()
            key = fresh_key(line)
            words = units(text)
            found = [v for v in map(self.weights.get, words) if v is not None]
            n = len(words)
            stem = text.rstrip("\"'”’»」』）)]  ")
            repeated = self.repeats(key)
            known = ((
                float(min(n, 80)), float(min(len(END.findall(text)), 6)), float(stem[-1:] in ".!?。！？؟।…") if stem else 0.0,
                3.0 if repeated else sum(found) / (len(found) + 1.0), link_marks(text) / (n + 1.0), float(len(found)) / (n + 1.0), 0.0,
            ), key, repeated)
            if len(line) < 120:
                if len(self._known) > 100_000:
                    self._known.clear()
                self._known[line] = known
        return (self._named(known[0]), known[1], True) if names_site(known[1], site) else known

    def _named(self, out: tuple) -> tuple:
        """Features of a line that names its own site: furniture, however often it stands in the table."""
        return (*out[:3], 3.0 if self.counted else out[3], *out[4:6], 1.0)

    def blocks(self, lines: list[str], site: str = "") -> list[tuple[tuple[float, ...], str, bool]]:
        return [self._block(x, site) for x in lines]

    def rows(self, lines: list[str], site: str = "") -> list[list[float]]:
        """Features of each (non-blank) line among its neighbours; ``site`` is the name of the page's site."""
        return self.beside([b[0] for b in self.blocks(lines, site)])

    @staticmethod
    def beside(blocks: list[tuple[float, ...]]) -> list[list[float]]:
        """Features of blocks with those of their neighbours."""
        out, last = [], len(blocks) - 1
        for i, b in enumerate(blocks):
            before = blocks[i - 1] if i else _NONE
            after = blocks[i + 1] if i < last else _NONE
            out.append([*b, before[0], after[0], before[3], after[3], before[4] + after[4], min(i, last - i) / (last + 1.0)])
        return out

    def story_share(self, lines: list[str], site: str = "") -> list[float]:
        return [leaf(self.nodes, r) for r in self.rows(lines, site)]

    def read(self, text: str | None, domain: str | None = None) -> tuple[list[int], list[bool], bool]:
        """(numbers of the non-blank lines, whether each is story, whether the page holds no story at all)."""
        if not text:
            return [], [], False
        cut = text.split("\n")
        at = [i for i, x in enumerate(cut) if x.strip()]
        if not at:
            return [], [], False
        lines = [cut[i] for i in at]
        blocks = self.blocks(lines, site_of(domain))
        story = [leaf(self.nodes, r) > 0.5 for r in self.beside([b[0] for b in blocks])]
        return at, story, self.residue.holds_no_story(lines, story, [b[2] for b in blocks])


#: Times that a line of the labelled table counts, and pages of the sample whose surely known lines join the labelled table.
_TABLE_WEIGHT, _SELF_LABELLED = 6, 400
_THAI = re.compile("[\u0e00-\u0e7f]{20,}")


def keys_and_cluster(text: str) -> tuple[list[int], list[int], int]:
    """(hashes of the keys of the lines that have one, the lines' numbers, the cluster's stamp) of a page.

    Copies of a story with other menus, teasers or dates are of one cluster: the
    stamp is that of the distinct lines of several sentences if they hold half of
    the page's letters, else that of all distinct lines.
    """
    keys, at, told = [], [], set()
    letters = long = 0
    for n, line in enumerate(text.split("\n")):
        if key := line_key(line):
            number = key_number(key)
            keys.append(number)
            at.append(n)
            letters += len(key)
            if len(key) > 50 and several_sentences(line):
                told.add(number)
                long += len(key)
    return keys, at, key_number(" ".join(map(str, sorted(told if 2 * long >= letters else set(keys)))))


def several_sentences(line: str) -> bool:
    return len(END.findall(line)) >= 2 or _THAI.search(line) is not None


def repeated_keys(sample: list[tuple[str | None, str | None]], least: int = LEAST_TEXTS) -> array:
    """``corpus_repeats`` of rows (domain, text) that are at hand."""
    pairs = set()
    for domain, text in sample:
        keys, _, cluster = keys_and_cluster(text or "")
        pairs |= {(domain, k, cluster) for k in keys}
    per_site = Counter((domain, k) for domain, k, _ in pairs)
    return array("q", sorted({k for (_, k), n in per_site.items() if n >= least}))


def keyed_pages(articles: DataFrame, sample_below: int = 0) -> DataFrame:
    """(globaleventid, site, day, row_hash, cluster, keys, line_nos, domain, text) per row with a text, from one pass over whole texts.

    ``site`` is the hash of the domain (null for none), ``row_hash`` that of the
    text, ``day`` the publication date. ``domain`` and ``text`` are given only for rows whose hash lies below ``sample_below`` of 2^30.
    """
    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [keys_and_cluster(x) for x in pdf["text"]]
            picked = pdf["picked"].to_numpy(bool)
            pdf["keys"], pdf["line_nos"], pdf["cluster"] = [g[0] for g in got], [g[1] for g in got], [g[2] for g in got]
            pdf["domain"], pdf["text"] = pdf["domain"].where(picked, None), pdf["text"].where(picked, None)
            yield pdf.drop(columns="picked")

    h = F.xxhash64("text")
    rows = articles.where("text is not null").select(
        F.col("globaleventid").cast("long").alias("globaleventid"), F.when(F.col("domain").isNotNull(), F.xxhash64("domain")).alias("site"), F.col("sqldate").cast("long").alias("day"),
        h.alias("row_hash"), (F.pmod(F.xxhash64("globaleventid", h), F.lit(1 << 30)) < sample_below).alias("picked"), "domain", "text")
    return rows.mapInPandas(go, "globaleventid long, site long, day long, row_hash long, cluster long, keys array<long>, line_nos array<int>, domain string, text string")


def corpus_repeats(keyed: DataFrame, least: int = LEAST_TEXTS) -> array:
    """Sorted hashes of the line keys that at least ``least`` clusters of one site hold, counted over all ``keyed_pages``.

    A story published again says nothing new about its site. Lines are counted
    by site, line and cluster before they are shuffled by site and line, so no
    task holds a hot line. What reaches the driver is 8 bytes for each repeated line.
    """
    lines = keyed.select("site", "cluster", F.explode(F.array_distinct("keys")).alias("key"))
    often = lines.groupBy("site", "key").agg(F.count_distinct("cluster").alias("n")).where(F.col("n") >= least)
    return array("q", np.sort(often.select("key").distinct().toArrow()["key"].to_numpy()).tobytes())


def _seeds(pages: list[tuple[str | None, list[str]]], model: PageModel) -> tuple[dict[str, str], dict[str, str], dict[str, str], Counter]:
    """Distinct lines (by key): surely furniture (repeated on a site), surely story (long, once), and all; and on how many sites each is."""
    where: Counter[str] = Counter()
    first: dict[str, str] = {}
    copies: set[tuple] = set()
    for site, lines in pages:
        own = {line_key(x): x for x in lines}
        if (stamp := (site, hash(tuple(own)))) in copies:
            continue
        copies.add(stamp)
        for key, line in own.items():
            where[key] += 1
            first.setdefault(key, line)
    furniture = {k: x for k, x in first.items() if model.repeats(k)}
    for site, lines in pages:
        if name := site_of(site):
            furniture |= {k: x for x in lines if names_site(k := line_key(x), name)}
    often = furniture.keys()
    story = {
        k: x for k, x in first.items()
        if where[k] == 1 and k not in often and len(k) > 50 and several_sentences(x)
    }
    return furniture, story, first, Counter(k for k, _ in {(line_key(x), site) for site, lines in pages for x in lines})


def _weights(furniture: list[str], story: list[str], least: int = 2) -> dict[str, float]:
    """Log odds of furniture against story per word; words of either class that occur once say nothing."""
    a, b = Counter(), Counter()
    for lines, into in ((furniture, a), (story, b)):
        for x in lines:
            into.update(set(units(mend(x))))
    na, nb = sum(a.values()) + 1.0, sum(b.values()) + 1.0
    return {
        w: max(-3.0, min(3.0, math.log((a[w] + 0.3) / na) - math.log((b[w] + 0.3) / nb)))
        for w in a.keys() | b.keys() if a[w] + b[w] >= least
    }


def fit(sample: list[tuple[str | None, str | None]], rounds: int = 1, repeated: array | None = None) -> PageModel:
    """A model from (domain, text) rows, the labelled table and the lines that ``repeated`` lists (without it, those of the sample)."""
    model = PageModel()
    known = repeated_keys(sample) if repeated is None else repeated
    pages = []
    for domain, text in sample:
        if text and (lines := [x.strip() for x in text.split("\n") if x.strip()]):
            pages.append((domain, lines))
    table = labelled_pages.pages()
    blocks = [(label, line) for page in table for label, line in page]
    by = {c: [line for label, line in blocks if label == c] for c in "SFR"}
    model.repeated = known
    furniture, story, every, sites = _seeds(pages, model)
    model.repeated = array("q")
    trusted, odd_lines = list(by["R"]), set()
    for _, lines in pages:
        odd = [x for x in lines if len(x) < 400 and residue.TRUSTED.search(x) and len(END.findall(x)) < 5]
        if odd and not any(line_key(x) in story for x in lines if x not in odd):
            trusted += odd
            odd_lines.update(odd)
    model.residue.fit(trusted, by["S"] + by["F"], list(every.values()), rounds=1)
    story = {k: x for k, x in story.items() if model.residue.score(x) < 0.5}
    extra = by["F"] + by["R"], by["S"]
    plain, told = [*furniture.values(), *trusted], list(story.values())
    y = np.array([float(label == "S") for label, _ in blocks])
    for step in range(rounds + 1):
        model.weights = _weights(plain + extra[0], told + extra[1])
        model.forget()
        x = [r for page in table for r in model.rows([line for _, line in page], "harlonpost")]
        # Names in tag lists and teasers may be well known from stories: such lines count once more with story words.
        dense = [[*r[:3], -1.5, r[4], 0.9, *r[6:]] for r, told_ in zip(x, y) if not told_ and r[4] > 0.4]
        x, label = (x + dense) * _TABLE_WEIGHT, [*y, *[0.0] * len(dense)] * _TABLE_WEIGHT
        for site, lines in pages[:_SELF_LABELLED]:
            for line, r in zip(lines, model.rows(lines, site_of(site))):
                key = line_key(line)
                if key in story or key in furniture:
                    x.append(r)
                    label.append(float(key in story))
        model.nodes = tree(np.array(x), np.array(label))
        model.repeated, model.counted = known, True
        model.forget()
        if step == rounds:
            break
        plain, told, beside, open_lines = {}, {}, {}, {}
        for site, lines in pages:
            shares = model.story_share(lines, site_of(site))
            # A line that several sites have need not tell a story: messages of servers are such lines.
            holds = not any(x in odd_lines for x in lines) and any(x > 0.5 and sites[line_key(line)] < SHARED_SITES and model.residue.score(line) < 0.5 for line, x in zip(lines, shares))
            for line, share in zip(lines, shares):
                key = line_key(line)
                (told if share > 0.5 else plain)[key] = line
                if holds and not residue.TRUSTED.search(line):
                    beside[key] = line
                elif not holds:
                    open_lines[key] = line
        # What stands beside a story is no residue; what stands on pages without one is unlabelled, and likely residue unless it is furniture elsewhere.
        leaning = {k for k in open_lines if k not in furniture and len(k) > 12}
        model.residue.fit(trusted, by["S"] + by["F"] + list(beside.values()), list(open_lines.values()), leaning)
        odd = {k for k, v in told.items() if model.residue.score(v) >= 0.5}
        plain = [v for k, v in plain.items() if k not in story] + [told[k] for k in odd] + list(furniture.values())
        told = [v for k, v in told.items() if k not in furniture and k not in odd]
    shown = []
    for site, lines in pages:
        blocks = model.blocks(lines, site_of(site))
        flags = [leaf(model.nodes, r) > 0.5 for r in model.beside([b[0] for b in blocks])]
        known = 1.0 if any(x in odd_lines for x in lines) else 0.0 if any(b[1] in story for b in blocks) else None
        shown.append((*model.residue.evidence(lines, flags, [b[2] for b in blocks]), known))
    model.residue.fit_records(shown)
    return model


def keyed_and_sample(articles: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[DataFrame, list[tuple[str | None, str]]]:
    """``keyed_pages`` written to the shared folder, and (domain, text) of about ``rows`` articles, all if there are no more, chosen by the hash of id and text in the same pass."""
    total = articles.count()
    keyed = cut(keyed_pages(articles, (1 << 30) * rows // total if total > rows else 1 << 30))
    got = keyed.where("text is not null").select("domain", "text", F.xxhash64("globaleventid", "row_hash").alias("h")).limit(2 * rows).collect()
    return keyed, [(r[0], r[1]) for r in sorted(got, key=lambda r: (r[2], r[1]))]


def fit_on(articles: DataFrame) -> PageModel:
    """The page model of a table: line counts over all articles, the rest from the bounded sample."""
    keyed, sample = keyed_and_sample(articles)
    return fit(sample, repeated=corpus_repeats(keyed))


def read_pages(articles: DataFrame, model: PageModel) -> DataFrame:
    """(globaleventid, domain, no_story, furniture array<int>) per article row, from one pass over whole texts."""
    shared = articles.sparkSession.sparkContext.broadcast(model)

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            empty, furniture = [], []
            for domain, text in zip(pdf["domain"], pdf["text"]):
                at, story, none = m.read(text, domain)
                empty.append(none)
                furniture.append([i for i, s in zip(at, story) if not s])
            yield pd.DataFrame({"globaleventid": pdf["globaleventid"], "no_story": empty, "furniture": furniture})

    return articles.where("globaleventid is not null and text is not null").select("globaleventid", "domain", "text").mapInPandas(
        go, "globaleventid long, no_story boolean, furniture array<int>")


def furniture_lines(articles: DataFrame, model: PageModel | None = None) -> DataFrame:
    """(globaleventid, line_no) of each non-blank line outside the story, without articles that hold no story.

    Lines count from 0 between "\\n". Rows without id or text give nothing; repeated rows give their lines once.
    """
    model = model or fit_on(articles)
    return read_pages(articles, model).where("not no_story").select("globaleventid", F.explode("furniture").alias("line_no")).distinct()


def main_text(articles: DataFrame, model: PageModel | None = None) -> DataFrame:
    """(globaleventid, body): each article's story paragraphs, mended, in order; '' where there is no story."""
    model = model or fit_on(articles)
    shared = articles.sparkSession.sparkContext.broadcast(model)

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            out = []
            for domain, text in zip(pdf["domain"], pdf["text"]):
                at, story, none = m.read(text, domain)
                cut = text.split("\n")
                out.append("" if none else "\n".join(mend(cut[i].strip()) for i, s in zip(at, story) if s))
            yield pd.DataFrame({"globaleventid": pdf["globaleventid"], "body": out})

    bodies = articles.where("globaleventid is not null and text is not null").select("globaleventid", "domain", "text").mapInPandas(go, "globaleventid long, body string")
    return bodies.withColumn("h", F.xxhash64("body")).dropDuplicates(["globaleventid", "h"]).drop("h")
