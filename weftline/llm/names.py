"""Free-typed organisation names mapped to the entries of a reference list.

An Aho-Corasick automaton over all full and short names finds mentions embedded
in what was typed; the longest mentions that do not overlap win. What is left
over then decides: filler words may surround a mention, any other word makes
another organisation. Names without such a mention go to token-set similarity:
each typed word is read as the nearest word of the list (typing slips, sound
spellings, abbreviations), and the set of read words must be an entry's set, or
lack one word of exactly one entry.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import cut

# Words that say nothing about which organisation is meant.
JOINING = {"the", "of", "for", "a", "an", "and", "aka", "alias", "known", "as", "also"}
DESCRIPTIONS = {
    "rebel", "rebels", "fighter", "fighters", "militia", "militias", "militiamen", "militant", "militants", "spokesman", "spokeswoman",
    "spokesperson", "spokespersons", "leader", "leaders", "commander", "commanders", "member", "members", "armed", "group", "troops",
    "insurgent", "insurgents", "guerrilla", "guerrillas", "gunmen", "faction", "supporters", "combatants", "soldiers", "forces",
}
# Letters that are written for one another.
SOUNDS = (("sch", "sh"), ("w", "v"), ("q", "k"), ("ph", "f"))
#: How many times as many entries the word that an abbreviation stands for must be in as the next one.
CLEAR = 4.0
DIGITS = str.maketrans("013457", "oleast")
SPLIT = re.compile(r"[^0-9a-z]+")


def tokens_of(text: str) -> list[str]:
    """Lower-case words without marks; apostrophes close up, digits inside words read as letters, dotted initials join."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()
    plain = plain.replace("ı", "i").replace("ø", "o").replace("ł", "l").replace("đ", "d")
    plain = re.sub(r"['’‘`´]+s?\b", lambda m: "s" if m[0].endswith("s") else "", plain)
    out: list[str] = []
    run: list[str] = []
    for word in SPLIT.split(plain):
        if not word:
            continue
        if any(c.isdigit() for c in word):
            word = word.translate(DIGITS) if any(c.isalpha() for c in word) or len(word) == 1 else word
        if len(word) == 1:
            run.append(word)
            continue
        if run:
            out.append("".join(run))
            run = []
        out.append(word)
    return out + (["".join(run)] if run else [])


def sounded(word: str) -> str:
    for a, b in SOUNDS:
        word = word.replace(a, b)
    return word


def slips(a: str, b: str, most: int) -> int:
    """Edits (with swaps of neighbours) from a to b, or most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            cost = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            new.append(cost)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return row[-1]


def _cuts(word: str, depth: int) -> set[str]:
    found, edge = {word}, {word}
    for _ in range(depth):
        edge = {w[:i] + w[i + 1:] for w in edge for i in range(len(w))}
        found |= edge
    return found


def _inside(short: str, long: str) -> bool:
    it = iter(long)
    return all(c in it for c in short)


class Words:
    """One block of the list's words, each with the number of entries whose full name has it, and whether it is a name by itself."""

    def __init__(self, counts: list[tuple[str, int, bool]]) -> None:
        self.counts = {w: n for w, n, _ in counts if n}
        self.names = {w for w, _, named in counts if named}
        self.starting: dict[str, list[str]] = defaultdict(list)
        self.near: dict[str, set[str]] = defaultdict(set)
        for w in self.counts:
            self.starting[w[0]].append(w)
            for c in _cuts(sounded(w), 2 if len(w) > 5 else 1):
                self.near[c].add(w)

    def look(self, token: str) -> list[tuple[str, str, float]]:
        """(kind, word, weight) of what the block knows of a token: the word itself, words it starts or lies in or is far from (by entries), words it slips into (by slips).

        Of each kind only what a decision over all blocks needs is given: all words of the block's fewest slips, and the two words of most entries of each other kind.
        """
        if token in self.counts:
            return [("same", token, 0.0)]
        if token in self.names:
            return [("name", token, 0.0)]
        plain, allowed = sounded(token), 2 if len(token) > 5 else 1
        mates = self.starting.get(token[0], [])
        longer = [w for w in mates if len(w) > len(token) + 1] if 2 <= len(token) <= 6 else []
        slipped = [(d, w) for w in set().union(*(self.near.get(c, ()) for c in _cuts(plain, allowed)))
                   if (d := slips(plain, sounded(w), allowed)) <= (2 if min(len(w), len(token)) > 5 else 1)]
        fewest = min((d for d, _ in slipped), default=0)
        out = [("slip", w, float(d)) for d, w in sorted(slipped) if d == fewest]
        for kind, words in (("start", [w for w in longer if w.startswith(token)]), ("inside", [w for w in longer if _inside(token, w)]),
                            ("far", [w for w in mates if len(token) > 6 and slips(plain, sounded(w), 3) <= 3])):
            out += [(kind, w, float(self.counts[w])) for w in sorted(words, key=lambda w: (-self.counts[w], w))[:2]]
        return out


def _clear(words: list[tuple[str, float]]) -> list[str]:
    """The word that far more entries have than any other of them, if there is one."""
    top = sorted(words, key=lambda x: (-x[1], x[0]))
    return [top[0][0]] if top and (len(top) == 1 or top[0][1] >= CLEAR * top[1][1]) else []


def readings(token: str, known: list[tuple[str, str, float]]) -> list[tuple[str, float]]:
    """Words that a token may stand for, each with the slips it takes, from what all blocks know of it."""
    of: dict[str, list[tuple[str, float]]] = defaultdict(list)
    for kind, word, weight in known:
        of[kind].append((word, weight))
    if of["same"] or of["name"]:  # a name by itself stands for no other word
        return [(token, 0.0)] if of["same"] else []
    if starts := _clear(of["start"]):
        return [(starts[0], 0.5)]
    if of["slip"]:
        least = min(d for _, d in of["slip"])
        nearest = sorted(w for w, d in of["slip"] if d == least)
        nearest = [w for w in nearest if w[0] == token[0]] or nearest
        return [(w, least or 0.5) for w in nearest]
    if within := _clear(of["inside"]):
        return [(within[0], 0.5)]
    return [(w, 3.0) for w in _clear(of["far"])]


class Matcher:
    """Matches read names against one block of the reference list."""

    def __init__(self, entries: list[tuple[int, str | None, str | None]]) -> None:
        self.names: dict[str, set[int]] = defaultdict(set)
        self.shorts: dict[int, set[str]] = defaultdict(set)
        self.by_set: dict[frozenset[str], set[int]] = defaultdict(set)
        self.by_lack: dict[frozenset[str], set[int]] = defaultdict(set)
        for key, full, short in entries:
            for form in (full, short):
                if form and (toks := plain_tokens(form)):
                    self.names[" ".join(toks)].add(key)
                    if len(toks) == 1:
                        self.shorts[key].add(toks[0])
            if words := list_words(full):
                self.by_set[words].add(key)
                if len(words) > 2:
                    for w in words:
                        self.by_lack[words - {w}].add(key)
        self.longest = max(map(len, self.by_set), default=0)
        self.holding: dict[tuple[str, int], list[frozenset[str]]] = defaultdict(list)
        for words in self.by_set:
            for w in words:
                self.holding[w, len(words)].append(words)
        self.automaton = ahocorasick.Automaton()
        for name, keys in self.names.items():
            self.automaton.add_word(f" {name} ", (len(name), frozenset(keys)))
        if self.names:
            self.automaton.make_automaton()

    def match(self, toks: list[str], read: list[list[tuple[str, float]]]) -> tuple[float, set[int]]:
        """(cost, ids): the entries that fit best; no ids if none fits.

        Mentions cost less than nothing, the more letters they cover the less; words cost their slips, a missing word more.
        """
        if not toks or not self.names:
            return 99.0, set()
        line = f" {' '.join(toks)} "
        hits = sorted(((n, end - n - 1, end, keys) for end, (n, keys) in self.automaton.iter(line)), key=lambda h: (-h[0], h[1]))
        taken: list[tuple[int, int, frozenset[int]]] = []
        for n, start, end, keys in hits:
            if all(end - 1 < s or start > e - 1 for s, e, _ in taken):
                taken.append((start, end, keys))
        if taken:
            left = line
            for start, end, _ in sorted(taken, key=lambda t: -t[0]):
                left = left[:start] + " " + left[end:]
            rest = [t for t in left.split() if t not in DESCRIPTIONS]
            ids = frozenset.intersection(*(keys for *_, keys in taken))
            if not rest and ids:
                return -float(sum(e - s for s, e, _ in taken)), set(ids)
        return self._by_words(toks, read)

    def _combined(self, forms: list[list[tuple[str, float]]]) -> dict[frozenset[str], float]:
        """Sets of words, another one for each token, that are an entry's words or lack one of them, each with the least cost.

        The entries that hold a word of the token with fewest such entries are gone through, however many words a token may stand for.
        """
        found: dict[frozenset[str], float] = {}
        options = [dict(sorted(f, key=lambda x: -x[1])) for f in forms]
        for size in (len(forms), len(forms) + 1):
            rarest = min(options, key=lambda o: sum(len(self.holding.get((w, size), ())) for w in o))
            for words in {s for w in rarest for s in self.holding.get((w, size), ())}:
                states: dict[frozenset[str], float] = {frozenset(): 0.0}
                for o in options:
                    grown: dict[frozenset[str], float] = {}
                    for used, cost in states.items():
                        for w in (words & o.keys()) - used:
                            k = used | {w}
                            grown[k] = min(cost + o[w], grown.get(k, 1e9))
                    if not (states := grown):
                        break
                for used, cost in states.items():
                    found[used] = min(cost, found.get(used, 1e9))
        return found

    def _by_words(self, toks: list[str], read: list[list[tuple[str, float]]]) -> tuple[float, set[int]]:
        forms_of = dict(zip(toks, read))
        forms, plainly, odd = [], [], []
        for t in dict.fromkeys(toks):
            known = forms_of[t]
            if t in DESCRIPTIONS and not (known and known[0] == (t, 0.0)):
                plainly.append(t)
            elif known:
                forms.append(known)
            else:
                odd.append(t)
        # Every token must be another word of the entry, so a name with more tokens than any entry has words fits none.
        if not forms or len(odd) > 1 or len(forms) > self.longest:
            return 99.0, set()
        best: tuple[float, set[int]] = (99.0, set())
        for words, cost in self._combined(forms).items():
            if (ids := self.by_set.get(words)) is None:
                if plainly or (ids := self.by_lack.get(words)) is None:
                    continue
                cost += 10.0
            if odd:
                ids = {i for i in ids if odd[0] in self.shorts[i]}
            if ids and cost <= best[0]:
                best = (cost, ids | best[1] if cost == best[0] else set(ids))
        return best


def plain_tokens(text: str) -> list[str]:
    return [t for t in tokens_of(text) if t not in JOINING]


def list_words(full: str | None) -> frozenset[str]:
    """The words of a full name of several words; none of a name of one word."""
    words = frozenset(plain_tokens(full)) if full else frozenset()
    return words if len(words) > 1 else frozenset()


def _blocks(df: DataFrame, column: str, block_rows: int) -> Iterator[list[tuple]]:
    """The rows of a frame in blocks of about ``block_rows`` by the hash of a column, one block on the driver at a time; one empty block of an empty frame."""
    blocks = max(1, -(-df.count() // block_rows))
    for b in range(blocks):
        yield sorted((tuple(r) for r in df.where(F.pmod(F.xxhash64(column), F.lit(blocks)) == b).collect()), key=repr)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _tokenized(names: DataFrame) -> DataFrame:
    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"entered_name": pdf["entered_name"], "toks": [plain_tokens(n) for n in pdf["entered_name"]]})

    return names.mapInPandas(go, "entered_name string, toks array<string>")


def _vocabulary(entries: DataFrame) -> DataFrame:
    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            alone = [toks[0] for form in (*pdf["f"], *pdf["s"]) if form and len(toks := plain_tokens(form)) == 1]
            words = [w for full in pdf["f"] for w in list_words(full)]
            yield pd.DataFrame({"w": words + alone, "named": [False] * len(words) + [True] * len(alone)})

    return entries.mapInPandas(go, "w string, named boolean").groupBy("w").agg(F.count_if(~F.col("named")).alias("n"), F.bool_or("named").alias("named"))


_KNOWN = "array<struct<kind:string,word:string,weight:double>>"


def _read(tokens: DataFrame, words: DataFrame, block_rows: int) -> DataFrame:
    """(token, known): what all blocks of the list's words know of each token."""
    parts = []
    for rows in _blocks(words, "w", block_rows):
        def go(batches: Iterator[pd.DataFrame], rows: list = rows) -> Iterator[pd.DataFrame]:
            block = Words(rows)
            for pdf in batches:
                yield pd.DataFrame({"token": pdf["token"], "known": [[dict(zip(("kind", "word", "weight"), x)) for x in block.look(t)] for t in pdf["token"]]})

        parts.append(tokens.mapInPandas(go, f"token string, known {_KNOWN}"))
    return _union(parts).groupBy("token").agg(F.flatten(F.collect_list("known")).alias("known"))


def map_names(typed: DataFrame, reference: DataFrame, block_rows: int = 100_000) -> DataFrame:
    """(entered_name, actor_id) for each distinct non-blank name of the one-column frame ``typed``.

    ``reference`` has actorid, namedata, nameorigfulleng. Its words and its
    entries are read in blocks of about ``block_rows`` (the bound of what a task
    holds), and nothing is decided within a block: what a typed word stands for
    is decided by what all blocks know of it, and a name takes the entries of
    the least cost over all blocks, -1 if none or several remain. Names are kept
    byte for byte. Rows of the reference without an id or any name are left out;
    an empty reference leaves all names unmatched.
    """
    column = typed.columns[0]
    names = typed.select(F.col(column).alias("entered_name")).where(F.col("entered_name").rlike(r"(?U)[^\s]")).distinct()
    entries = reference.select(F.col("actorid").cast("long").alias("k"), F.col("nameorigfulleng").alias("f"), F.col("namedata").alias("s")).where(
        "k is not null and (f is not null or s is not null)").distinct()
    split = cut(_tokenized(names))
    flat = split.select("entered_name", F.posexplode_outer("toks").alias("pos", "token"))
    known = _read(flat.select("token").where("token is not null").distinct(), _vocabulary(entries), block_rows)
    told = cut(flat.join(known, "token", "left").groupBy("entered_name").agg(
        F.array_sort(F.collect_list(F.when(F.col("token").isNotNull(), F.struct("pos", "token", "known")))).alias("read")))
    parts = []
    for rows in _blocks(entries, "k", block_rows):
        def go(batches: Iterator[pd.DataFrame], rows: list = rows) -> Iterator[pd.DataFrame]:
            matcher = Matcher(rows)
            for pdf in batches:
                got = [matcher.match([r["token"] for r in read], [readings(r["token"], [(x["kind"], x["word"], x["weight"]) for x in r["known"]]) for r in read]) for read in pdf["read"]]
                yield pd.DataFrame({"entered_name": pdf["entered_name"], "cost": [g[0] for g in got], "ids": [sorted(g[1])[:2] for g in got]})

        parts.append(told.mapInPandas(go, "entered_name string, cost double, ids array<long>"))
    best = _union(parts).groupBy("entered_name").agg(F.min("cost").alias("least"), F.collect_list(F.struct("cost", "ids")).alias("all")).withColumn(
        "one", F.array_distinct(F.flatten(F.transform(F.filter("all", lambda x: x["cost"] == F.col("least")), lambda x: x["ids"]))))
    return best.select("entered_name", F.when(F.size("one") == 1, F.col("one")[0]).otherwise(F.lit(-1)).cast("long").alias("actor_id"))
