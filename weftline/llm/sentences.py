"""Sentence units across languages and scripts.

A line break always ends a unit. Inside a line of a spaced script, every run of
terminators is a node whose arcs (ends a unit, or not) are decided by the word
before it, the marks that close around it and the word that opens after it:
abbreviations, initials, ordinals, quotations and their reporting words keep a
unit together. Runs of Thai, Chinese and Japanese go through lattices of
dictionary words: a gap ends a unit by the word that opens the next run and the
word that ends the one before, and a clause behind a closing quotation mark
reports it by its last word. The dictionaries are common particles, pronouns,
conjunctions and verbs of saying, and words learned from the texts: letters that
stand together far more often than alone, and what lines open and end with.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least counts of learned words are those of so many documents and grow with more; words are learned from all.
PER_DOCUMENTS = 4_000
#: Different words that a task counts before it hands its counts on.
TALLIED = 1_000_000

# Abbreviations that stand before a name, a number or the word they shorten, and so never end a unit.
LEADING = set(
    "dr mr mrs ms prof gen lt col sgt capt maj brig cpl cmdr st sec no nos vs approx ca fig vol ch art jan feb mar apr jun jul aug sep sept oct nov dec "
    "mt ft gov sen rep rev hon pres supt insp "
    "sr sra srta d dña gral cnel tte núm num aprox pág págs av art lic ing "
    "m mme mlle mm pr env réf n "
    "hr fr nr bzw ca evtl ggf inkl "
    "dott sig prof avv ing col sig.ra dott.ssa "
    "exmo ltda eng cel maj n.º "
    "alb yrd doç org tğm yzb sn "
    "г ген ок т тов проф акад см рис стр ул им полк подп майор кап лейт д р гр м с бл п вул просп "
    "د م أ "
    "นพ พญ ดร พ.อ พล.อ พล.ต พล.ท ร.ต ร.อ พ.ต พ.ท".split()
)
# Abbreviations among them that only stand before a number.
NUMBERED = set("no nos vol ch art fig sec núm num nr n pág págs n.º рис стр".split())
# Abbreviations in mid-sentence that may also end a unit before a capital.
TRAILING = set("a.m p.m i.e e.g etc p.ej z.b u.a a.d d.h u.s.w inc co ltd т.д т.п т.е др км руб тыс млн кг cit al ecc ecc".split())
# Month names that follow a day number with a point.
MONTHS = set(
    "januar februar märz april mai juni juli august september oktober november dezember jänner "
    "ocak şubat mart nisan mayıs haziran temmuz ağustos eylül ekim kasım aralık".split()
)
# Words that report what was said right before them.
REPORTING = set("said asked told replied added shouted cried wrote read dijo preguntó dit demanda sagte fragte disse chiese perguntou dedi sordu".split())
# Common Thai words that open statements: people, offices, reports, times, questions.
THAI_OPENERS = (
    "ชาวบ้าน พยาน ทหาร โฆษก นักรบ เจ้าหน้าที่ หน่วยลาดตระเวน หน่วย นพ. พญ. ดร. รายงาน ครอบครัว ผู้บัญชาการ ผู้อพยพ ผู้ลี้ภัย ผู้นำ ผู้ว่า ทำไม หยุด แพทย์ พ.อ. พล.อ. นาย นาง นางสาว ตำรวจ "
    "รัฐบาล กองทัพ กลุ่ม นายก ประธาน สมาชิก นักข่าว ครู นักเรียน เด็ก ราคา วันนี้ เมื่อวาน เมื่อ ขณะนี้ ต่อมา อย่างไรก็ตาม นอกจากนี้ แต่ และ เขา เธอ พวกเขา เรา ฉัน ผม ไม่มีใคร มี"
).split()
# Common Thai words that go on with a statement: counting words, relations, verbs of saying, ends of clauses.
THAI_CONTINUERS = (
    "คน ครั้ง หลัง แห่ง คัน ลำ กระบอก ศพ ราย ตัว หลังคา กม. ก.ม. กิโลเมตร เมตร ลิตร บาท เปอร์เซ็นต์ ปี เดือน วัน ชั่วโมง นาที น. ที่ ใกล้ ใน จาก ถึง โดย กับ ของ ว่า ซึ่ง เพื่อ ไป มา ให้ ถูก ได้ "
    "กล่าว แจ้ง ระบุ โจมตี ปิด ปล่อย ฝัง กล่าวหา ได้ยิน แม้ ขณะที่ ก่อน หลังจาก ระหว่าง เพราะ จน แล้ว อยู่ ด้วย เสียชีวิต บาดเจ็บ อย่าง ต่อ เป็น ไม่"
).split()
# Common Thai words that end statements.
THAI_FINALS = "แล้ว อยู่ คน ครั้ง ด้วย กัน ครับ ค่ะ นะ".split()
# Chinese and Japanese words that end statements, words that open them, and what reports a quotation before it.
HAN_FINALS = "了 吗 呢 吧 啊 呀 嗎 た だ です ます ません でした ました だった であった ない か よ ね".split()
HAN_OPENERS = "但 但是 不过 然而 因此 所以 同时 另外 此外 如果 虽然 因为 他 她 他们 我们 我 他們 我們 しかし だが また そして 一方 さらに なお 彼 彼女 彼ら 私 私たち 我々".split()
HAN_REPORTS = "说 说道 表示 问 问道 喊 喊道 称 告诉 讲 写道 補充 補充道 補充说 说着 說 說道 問 問道 稱".split()
HAN_QUOTING = "と って との という".split()
#: No abbreviation has more letters.
LONGEST_ABBREVIATION = 60

_CLOSE = "\"'”’»」』）)\\]"
_CLOSERS = "\"'”’»“」』）)]"
_NODE = re.compile(f"(?:[.!?…؟۔]+[{_CLOSE}]*(?=\\s|$|[^\\W\\d_]|[\"'“«„(\\[¡¿「『—–-])|[。！？।॥｡។៕။፧።։]+[\"」』”’）)]*)")
_LIST_MARK = re.compile(r"\s*(?:[-•*–—·▪»]\s*)?(?:\(?\d{1,3}[.)]|\(?[a-zA-Z][)])?\s*")
_WORD_BEFORE = re.compile(r"[^\s\"'“”«»„(\[—–]+$")
_WORD_AFTER = re.compile(r"\s*([\"'“«„‚(\[¡¿「『‹—–-]*)\s*([^\W_]+)?")
_THAI = re.compile("[฀-๿]")
_HAN = "぀-ヿ㐀-鿿豈-﫿々ー"
_HAN_RUN = re.compile(f"[{_HAN}]+")
_HAN_CLAUSE = re.compile("[^。！？，,!?\n]*")
_HAN_GAP = re.compile(f"(?<=[{_HAN}])\\s+(?=[{_HAN}])")
# Short words are told by their last five letters.
_POINTED = re.compile(r"([^\W\d_]++)\.(?=\s+\S)")
_UNPOINTED = re.compile(r"[^\W\d_]++(?=[\s,;])")
_LATIN_DOTS = re.compile(r"^(?:[^\W\d_]\.)+[^\W\d_]?$")


class WordLattice:
    """Words of a run of letters without spaces: the path through a dictionary's words with the fewest unknown letters, then the fewest words."""

    def __init__(self, words: set[str]) -> None:
        self.words = words
        self.longest = max(map(len, words), default=1)

    def path(self, run: str) -> list[str]:
        n = len(run)
        best = [(0, 0)] + [(n + 1, n + 1)] * n
        back = [0] * (n + 1)
        for i in range(n):
            lost, used = best[i]
            if (lost + 1, used + 1) < best[i + 1]:
                best[i + 1], back[i + 1] = (lost + 1, used + 1), i
            for j in range(i + 2, min(n, i + self.longest) + 1):
                if (lost, used + 1) < best[j] and run[i:j] in self.words:
                    best[j], back[j] = (lost, used + 1), i
        out: list[str] = []
        while n:
            out.append(run[back[n]:n])
            n = back[n]
        return out[::-1]


class Splitter:
    """Finds unit ends; holds the dictionaries and learned abbreviations."""

    def __init__(self, thai: tuple[str, ...] = (), learned: tuple[str, ...] = (), continuers: tuple[str, ...] = (), finals: tuple[str, ...] = (), han: tuple[str, ...] = ()) -> None:
        self.openers = {*THAI_OPENERS, *thai}
        self.continuers, self.finals = {*THAI_CONTINUERS, *continuers}, {*THAI_FINALS, *finals}
        self.lattice = WordLattice({*self.openers, *self.continuers, *self.finals})
        self.han = WordLattice({*han, *HAN_FINALS, *HAN_OPENERS, *HAN_REPORTS, *HAN_QUOTING})
        self.leading = LEADING | set(learned)
        self._first: dict[str, list[str]] = {}

    def _path(self, run: str) -> list[str]:
        if (known := self._first.get(run)) is None:
            if len(self._first) > 50_000:
                self._first.clear()
            known = self._first[run] = (self.lattice if _THAI.search(run) else self.han).path(run)
        return known

    def _reports(self, line: str, end: int) -> bool:
        """Whether the clause behind a closing quotation mark reports what was said: by a quoting particle that opens it or a verb of saying that ends it."""
        clause = _HAN_CLAUSE.match(line, end)[0]
        runs = _HAN_RUN.findall(clause)
        if not runs or not _HAN_RUN.match(clause.lstrip()):
            return False
        if self._path(runs[0])[0] in HAN_QUOTING or clause.startswith(tuple(HAN_QUOTING)):
            return True
        last = self._path(runs[-1])[-1] if clause.rstrip().endswith(runs[-1]) else ""
        # A word of two letters that ends like a verb of saying is a word of its own; in longer ones a name may have grown into the verb.
        return last in HAN_REPORTS or len(last) > 2 and last.endswith(tuple(HAN_REPORTS))

    def _han_opens(self, before: str, after: str) -> bool:
        """Whether a statement starts after a gap in Chinese or Japanese: the word before it ends statements and the one after it opens them."""
        return self._path(before)[-1] in HAN_FINALS and self._path(after)[0] in HAN_OPENERS

    def _opens(self, before: str, after: str) -> bool:
        """Whether a statement starts after a gap in Thai, by the last word before it and the first word after it."""
        if not after or not _THAI.match(after) or before in ("นพ.", "พญ.", "ดร.", "นาย", "นาง"):
            return False
        first = self._path(after)[0]
        if first in self.openers:
            return True
        # A word that neither opens nor goes on starts a statement only behind a word that ends one.
        return len(first) > 1 and first not in self.continuers and bool(before) and _THAI.match(before) is not None and self._path(before)[-1] in self.finals

    def ends(self, text: str) -> list[int]:
        """Code points from the start of the text to the end of each unit."""
        out: list[int] = []
        start = 0
        for line in text.split("\n"):
            body = line.rstrip()
            if body:
                base = start
                out += [base + e for e in self._line(body)]
            start += len(line) + 1
        return out

    def _line(self, line: str) -> list[int]:
        cuts = []
        body = _LIST_MARK.match(line).end()
        if body >= len(line):
            return [len(line)]
        thai = not line.isascii() and _THAI.search(line) is not None
        for m in _NODE.finditer(line, body):
            end = m.end()
            if line.startswith("“", end) and line.count("„", 0, end) > line.count("“", 0, end):
                end += 1
            if end < len(line) and self._ends(line, m, body, end):
                cuts.append(end)
        if thai:
            runs = list(re.finditer(r"\S+", line[body:]))
            cuts += [body + x.end() for x, y in zip(runs, runs[1:]) if self._opens(x[0], y[0])]
            cuts = sorted(set(cuts))
        if not line.isascii() and (gaps := list(_HAN_GAP.finditer(line, body))):
            runs = {m.end(): m[0] for m in _HAN_RUN.finditer(line)}, {m.start(): m[0] for m in _HAN_RUN.finditer(line)}
            cuts = sorted({*cuts, *(g.start() for g in gaps if self._han_opens(runs[0][g.start()], runs[1][g.end()]))})
        return [*(c for c in cuts if c < len(line)), len(line)]

    def _ends(self, line: str, m: re.Match, body: int, end: int) -> bool:
        mark = m[0]
        first = mark[0]
        closed = end > m.end() or mark.rstrip(_CLOSERS) != mark
        after = line[end:end + 1]
        if first in "。！？｡":
            return not (closed and self._reports(line, end))
        if first in "।॥។៕။፧።։":
            return True
        spaced = after.isspace()
        opening = _WORD_AFTER.match(line, end)
        marks, word = opening[1], opening[2] or ""
        if not word:
            return bool(marks) and spaced
        head = word[0]
        dotted = first == "." and len(mark.rstrip(_CLOSERS)) == 1
        cased = head.isupper() or head.islower()
        if head.islower() and not (marks and marks[0] in "¡¿"):
            return False
        if marks and marks[0] in "—–-" and not spaced:
            return False
        if first in "!?؟" and closed and spaced:
            following = line[end:].split(None, 3)[:3]
            if any(w.strip(",.;:").lower() in REPORTING for w in following):
                return False
        if not dotted:
            return True
        near = line[max(body, m.start() - LONGEST_ABBREVIATION):m.start()]  # a long line stays linear
        before = _WORD_BEFORE.search(near)
        token = before[0] if before else ""
        low = token.lower().lstrip("¡¿")
        if "." in token and low not in TRAILING and low not in self.leading and not _LATIN_DOTS.match(low):
            token = re.split(r"[.!?]", token)[-1]
            low = token.lower()
        if not token:
            return spaced
        last = token[-1]
        if "ऀ" <= last <= "ॿ":
            return False
        if _THAI.match(last):
            return False
        if low in TRAILING or _LATIN_DOTS.match(low):
            if token.isupper() and len(token) > 1 and word.isupper() and len(word) > 1:
                return False
            if low in ("i.e", "e.g", "p.ej", "z.b", "u.a", "a.d", "d.h", "т.е"):
                return False
            return spaced and head.isupper()
        if low in NUMBERED and not (len(token) == 1 and token.isupper()):
            return spaced and head.isupper()
        if low in self.leading:
            # "2021 г." and "стр. 5 м." close a number, and may end a unit.
            ahead = near[:before.start()].rstrip()
            return bool(ahead) and ahead[-1].isdigit() and low in ("г", "м", "с", "р", "д", "т") and head.isupper()
        if len(token) == 1 and token.isalpha():
            ahead = near[:before.start()].rstrip()
            if token.isupper():
                return not (spaced and (ahead == "" or ahead[-1] in ".(“\"«" or word[:1].isupper() and len(word) > 1 and not ahead.lower().endswith(("option", "group", "part", "class", "plan"))))
            return False
        if token.isdigit():
            if len(token) <= 2 and word.lower() in MONTHS:
                return False
            return spaced or (cased and len(token) == 4)
        if not spaced:
            # A missing space after the point: a lower-case word or year before, a capital (or a script without case) after.
            return (last.islower() and head.isupper() and len(low) > 1) or (not cased and not last.isascii()) or (token.isupper() and len(token) > 3 and word.isupper() and len(word) > 2)
        return True


class Tally:
    """Counts over texts that the dictionaries are decided from: what Thai lines open, go on and end with, words with and without a point, strings of Chinese and Japanese."""

    def __init__(self, longest: int = 4) -> None:
        self.longest = longest
        self.opens, self.behind, self.closes, self.amid, self.pointed, self.plain, self.lower_after, self.grams = (Counter() for _ in range(8))
        self.before: dict[str, set[str]] = defaultdict(set)
        self.after: dict[str, set[str]] = defaultdict(set)

    def __len__(self) -> int:
        return sum(map(len, (self.opens, self.behind, self.closes, self.amid, self.pointed, self.plain, self.grams)))

    def add_runs(self, runs: list[str]) -> None:
        for run in runs:
            for n in range(1, self.longest + 1):
                for i in range(len(run) - n + 1):
                    w = run[i:i + n]
                    self.grams[w] += 1
                    if n > 1:
                        self.before[w].add(run[i - 1:i])
                        self.after[w].add(run[i + n:i + n + 1])

    def add(self, text: str) -> None:
        for line in text.split("\n") if not text.isascii() else ():
            if line.isascii():
                continue
            self.add_runs(_HAN_RUN.findall(line))
            if _THAI.search(line):
                runs = line.lstrip("-•*–— 0123456789.)(").split()
                if runs and _THAI.match(runs[0]):
                    self.opens.update(runs[0][:n] for n in range(4, min(len(runs[0]), 14) + 1))
                if runs and _THAI.match(runs[-1][-1]):
                    self.closes.update(runs[-1][-n:] for n in range(3, min(len(runs[-1]), 10) + 1))
                for last, run in zip(runs, runs[1:]):
                    if not _THAI.search(last):
                        self.behind.update(run[:n] for n in range(4, min(len(run), 14) + 1))
                    if not _THAI.search(run):
                        self.amid.update(last[-n:] for n in range(3, min(len(last), 10) + 1))
        self.plain.update([w[-5:] for w in _UNPOINTED.findall(text.lower())])
        for m in _POINTED.finditer(text):
            low = m[1][-5:].lower()
            self.pointed[low] += 1
            nxt = text[m.end():m.end() + 4].strip()[:1]
            self.lower_after[low] += nxt.islower() or nxt.isdigit()

    def rows(self) -> list[tuple]:
        """(family, word, x, y, z, b0, b1, a0, a1): three counts of a word, and the least and greatest letter before and after it."""
        out: list[tuple] = []
        for family, x, y, z in (("start", self.opens, self.behind, {}), ("end", self.closes, self.amid, {}), ("point", self.pointed, self.plain, self.lower_after)):
            out += [(family, w, x.get(w, 0), y.get(w, 0), z.get(w, 0), None, None, None, None) for w in x.keys() | y.keys()]
        return out + [("han", w, n, 0, 0, *((min(self.before[w]), max(self.before[w]), min(self.after[w]), max(self.after[w])) if len(w) > 1 else (None,) * 4)) for w, n in self.grams.items()]


def _bonded(grams: dict[str, tuple], least: float, bond: float) -> set[str]:
    """Strings of two letters and more that stand in different neighbourhoods and hold together; grams has (count, least and greatest letter before and after)."""
    total = sum(g[0] for w, g in grams.items() if len(w) == 1)
    return {w for w, (n, b0, b1, a0, a1) in grams.items() if len(w) > 1 and n >= least and b0 != b1 and a0 != a1
            and all(n * total >= bond * grams[w[:i]][0] * grams[w[i:]][0] for i in range(1, len(w)))}


def learned_words(runs: list[str], longest: int, least: float = 6, bond: float = 10.0) -> set[str]:
    """Words of two letters and more: strings that stand in different neighbourhoods and hold together, every cut of them being ``bond`` times rarer by chance."""
    tally = Tally(longest)
    tally.add_runs(runs)
    return _bonded({r[1]: (r[2], *r[5:]) for r in tally.rows()}, least, bond)


def _sides(at: Counter, off: Counter, taken: tuple[str, ...], least: float = 3) -> tuple[str, ...]:
    """Strings that stand at one place but hardly ever at the other, without those that a shorter one of them opens."""
    own = {w for w, n in at.items() if n >= least and not w.startswith(taken) and off[w] <= 0.02 * n}
    return tuple(sorted(w for w in own if not any(w[:k] in own for k in range(4, len(w)))))


def _decided(rows: list[tuple], documents: int) -> Splitter:
    """A splitter from the counts over so many documents. Least counts are those of ``PER_DOCUMENTS`` documents and grow with more."""
    more = max(1.0, documents / PER_DOCUMENTS)
    of: dict[str, dict[str, tuple]] = defaultdict(dict)
    for family, word, *counts in rows:
        of[family][word] = tuple(counts)
    opens, behind = (Counter({w: c[i] for w, c in of["start"].items() if c[i]}) for i in (0, 1))
    thai = _sides(opens, behind, tuple(THAI_CONTINUERS), 3 * more)
    continuers = _sides(behind, opens, tuple(THAI_OPENERS), 3 * more)
    ending = {w for w, c in of["end"].items() if c[0] >= 5 * more and c[1] <= 0.02 * c[0] and unicodedata.category(w[0])[0] != "M"}
    finals = tuple(sorted(w for w in ending if not any(w[-k:] in ending for k in range(3, len(w)))))
    learned = tuple(sorted(w for w, c in of["point"].items() if c[0] >= 8 * more and c[1] <= 0.02 * c[0] and c[2] >= 0.9 * c[0]))
    return Splitter(thai, learned, continuers, finals, tuple(sorted(_bonded({w: (c[0], *c[3:]) for w, c in of["han"].items()}, 6 * more, 10.0))))


def learn(texts: list[str]) -> Splitter:
    """A splitter with words of the texts: Chinese and Japanese ones, Thai ones that lines open and end with or that go on behind numbers, and short words that almost always carry a point."""
    tally = Tally()
    for text in texts:
        tally.add(text)
    return _decided(tally.rows(), len(texts))


def learn_all(documents: DataFrame) -> Splitter:
    """``learn`` over all texts: tasks count, the counts are summed up by word, and only words that are frequent enough for a decision are collected."""
    columns = ["family", "word", "x", "y", "z", "b0", "b1", "a0", "a1"]

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally = Tally()
        for pdf in batches:
            for text in pdf["text"]:
                tally.add(text)
            if len(tally) > TALLIED:
                yield pd.DataFrame(tally.rows(), columns=columns)
                tally = Tally()
        if len(tally):
            yield pd.DataFrame(tally.rows(), columns=columns)

    counted = documents.where("text is not null").select("text").mapInPandas(go, "family string, word string, x long, y long, z long, b0 string, b1 string, a0 string, a1 string")
    total = counted.groupBy("family", "word").agg(*[F.sum(c).alias(c) for c in "xyz"], *[f(c).alias(c) for c, f in (("b0", F.min), ("b1", F.max), ("a0", F.min), ("a1", F.max))])
    # All parts of a frequent string are as frequent, so none that a decision needs is missing.
    texts = documents.where("text is not null").count()
    more = max(1.0, texts / PER_DOCUMENTS)
    start, end, point = (F.col("family") == k for k in ("start", "end", "point"))
    wanted = ((start & (F.greatest("x", "y") >= 3 * more)) | (end & (F.col("x") >= 5 * more) & (F.col("y") <= 0.02 * F.col("x")))
              | (point & (F.col("x") >= 8 * more) & (F.col("y") <= 0.02 * F.col("x"))) | ((F.col("family") == "han") & ((F.col("x") >= 6 * more) | (F.length("word") == 1))))
    return _decided([tuple(r) for r in total.where(wanted).collect()], texts)


def unit_ends(documents: DataFrame, splitter: Splitter | None = None) -> DataFrame:
    """(doc_id, end_pos), one row per unit; whole texts. Null or blank texts and null ids give nothing; repeated rows count once."""
    splitter = splitter or learn_all(documents)
    shared = documents.sparkSession.sparkContext.broadcast(splitter)

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = shared.value
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ends": [s.ends(t) for t in pdf["text"]]})

    rows = documents.where("doc_id is not null and text is not null").select("doc_id", "text").mapInPandas(go, "doc_id long, ends array<int>")
    return rows.select("doc_id", F.explode("ends").alias("end_pos")).distinct()
