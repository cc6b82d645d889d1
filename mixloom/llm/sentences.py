"""Sentence units of documents in any language and script (problem 7).

A text is first cut into blocks: fenced code, title lines, list items, speakers' turns and
paragraphs.  Paragraphs are split at sentence ends by document-centred disambiguation: whether a
full stop ends an abbreviation and whether a capital letter is a name's are decided by
unambiguous occurrences in the same document.  Where the document is silent or of two minds, the
counts of the whole corpus decide, by shares; fixed lists come last, for words that neither
tells.  Scripts have their own terminators: CJK marks and dandas end at once, Thai uses spaces.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import ChainMap, Counter
from functools import cached_property

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixloom.session import cut

# Abbreviations of several languages, by what may follow them. They are asked last,
# about words that neither the document nor the corpus tells.
TITLES = frozenset(
    "Dr Prof Mr Mrs Ms Mx Messrs Capt Lt Col Sgt Gen Maj Cmdr Adm Rev Hon Gov Sen Rep Pres St Sr Sra Srta Dra Ing Lic Arq Mme Mlle MM Hr Fr Frl Dipl Mag "
    "Univ Herr Frau Д-р Проф проф акад им гр डॉ प्रो श्री".split()
)
NUMERIC = frozenset(
    "No no Nos nos Nr nr Fig fig Figs Eq eq Eqs Vol vol Ch ch Sec sec Tab tab App app Art art Abb Kap Bd pág págs núm fasc chap pp p S vgl "
    "См см рис Рис табл Табл стр гл разд п ver Ver v ca env aprox approx Approx ок p pag Lfg".split()
)
INNER = frozenset(
    "vs e.g i.e cf Cf viz esp incl excl approx al resp bzw bspw z.B d.h u.a vgl Vgl inkl exkl ggf evtl sog insb ex p.ex ej p.ej env ca Abs Nr тыс млн млрд руб напр".split()
)
ENDERS = frozenset("etc Inc Ltd Co Corp Bros Jr U.S U.K U.N E.U D.C a.m p.m A.M P.M al usw usf ff Min min Std sec hrs hr kg cm EE UU Ud Uds Vd ETC т.д т.п г гг др пр тыс al".split())
LISTED = TITLES | NUMERIC | INNER | ENDERS
#: Months that follow an ordinal number.
MONTHS = frozenset("Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember januar februar mars maj juni juli august".split())
#: speakers' labels, besides words that label several lines of a document.
LABELS = frozenset(
    "user assistant system human ai bot question answer q a tool moderator interviewer speaker nutzer nutzerin benutzer assistent assistentin mensch frage antwort "
    "utilisateur utilisatrice assistante système question réponse usuario usuaria asistente sistema pregunta respuesta пользователь ассистент помощник система "
    "用户 助手 系统 问 答 ユーザー アシスタント システム उपयोगकर्ता सहायक प्रयोक्ता ผู้ใช้ ผู้ช่วย المستخدم المساعد".split()
)

_LINE = re.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]")
_FENCE = re.compile(r"\s*(`{3,}|~{3,})")
_HEADING = re.compile(r"\s*#{1,6}(?=\s+\S)")
_ITEM = re.compile(r"\s*(?:[-*+•‣▪·–●○◦]|\(?\d{1,3}[.)]|[(]?[a-z][)]|\d{1,3}、|[a-z][.](?=\s+[A-Z]))\s+(?=\S)")
_LABEL = re.compile(r"\s*([^\W\d_][\w'’. -]{0,23}?)\s?[:：](?=\s|$|[^\s/])")
_RULE = re.compile(r"\s*(?:[-=_*~]\s*){3,}$")
_END = "".join(".!?…。！？｡।॥؟۔‼⁇⁈⁉．")
_CLOSERS = "\"”»’)]}』」》）】〉›"
_OPENERS = "\"“«„‚‘([{『「《（【〈‹"
_PAIRS = {")": "(", "]": "[", "}": "{", "»": "«", "」": "「", "』": "『", "》": "《", "）": "（", "】": "【", "〉": "〈", "›": "‹"}
_OPEN_OF = {v: k for k, v in _PAIRS.items()}
_MARK = re.compile(r"[()\[\]{}«»„“”\"「」『』《》（）【】〈〉‹›]")
#: A full stop before a digit, a small letter or a comma inside a token ends nothing.
_STOP = re.compile(r"[!?…。！？｡।॥؟۔‼⁇⁈⁉．][.!?…。！？｡।॥؟۔‼⁇⁈⁉．]*|\.++[!?…]*(?![\da-z,;:])")
#: Scripts whose words aren't set apart: no letter of theirs belongs to an abbreviation.
_DENSE = "⺀-⿟々-〇぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
_LAST_WORD = re.compile(rf"[^\W\d_{_DENSE}](?:[^\W{_DENSE}]|[ऀ-ःऺ-ॏ'’-]|\.(?=[^\W{_DENSE}]|['’-]))*$")
_WORD_CHAR = re.compile(rf"[^\W{_DENSE}]|[ऀ-ःऺ-ॏ'’-]")
_DIGIT = re.compile(r"\d")
_NEXT_WORD = re.compile(r"[\w][\w'’-]*")
_THAI_GAP = re.compile(r"(?<=[฀-๿])\s+(?=[฀-๿])")
_THAI = re.compile(r"[ก-๎]")
_URLISH = re.compile(r"://|www\.|[=&@]|/\w|\?\w+=")
_INITIAL = re.compile(r"[^\W\d_]")
#: Combining marks belong to words in Indic and Thai scripts.
_TOKEN = re.compile(rf"[^\W\d_{_DENSE}](?:[^\W{_DENSE}]|[ऀ-ःऺ-ॏ'’-])*(?:\.[^\W\d_{_DENSE}]+)*\.?")
_GOES_ON = re.compile(r"\.(?:[,;:)]|[ \xa0]+(?:[a-zß-ÿа-яё]|(\d)))")
_MID = re.compile(r" (?<=[a-zß-ÿа-яё,;] )([A-ZÀ-ÞА-ЯЁ][\w'’-]*)")
_AFTER_MARK = re.compile(r"[!?](?<=[a-zß-ÿа-яё][!?])[ \xa0\n]+[¿¡]?([^\W\d_][\w'’-]*)")
_FIRST = re.compile(r"\s*[\"“«„¿¡(]*([^\W\d_][\w'’-]*)")
_PARAGRAPH = re.compile(r"(?:\r\n|\n|\r)[^\S\r\n]*(?:\r\n|\n|\r)\s*")


#: What is counted of a word: with (d) and without (n) a full stop; the stop before a comma or a small
#: letter (c), before a number (g), at the end of a paragraph (e); with a capital inside of a
#: sentence (m), as the first word of one (s).
COUNTS = "dncgems"
NOTHING = (0,) * len(COUNTS)
#: So many of the corpus' most frequent words are broadcast; all others are joined.
HOT_WORDS = 50_000


class Evidence:
    """Corpus counts of words, which settle what a document alone can't."""

    def __init__(self, counts: dict[str, tuple] | None = None):
        self.counts = counts or {}

    def of(self, word: str) -> tuple:
        return self.counts.get(word, NOTHING)

    def lower(self, word: str) -> int:
        """How often a word occurs in small letters."""
        low = word.lower()
        d, n, *_ = self.of(low)
        return d + n if low[:1].islower() else 0

    def opens(self, word: str) -> bool:
        """Whether a word may open a sentence after a doubtful full stop."""
        d, n, _, _, _, mids, starts = self.of(word)
        if starts:
            return starts >= 0.04 * mids
        # Never seen as the first word of a sentence: mostly inside of sentences, or just not known.
        return word[:1].isupper() and (not mids or 2 * mids < d + n)

    def common(self, word: str) -> bool:
        """Whether a capitalised word is an ordinary word, not a name."""
        return self.lower(word) > self.of(word)[5]

    def starts_low(self, word: str) -> bool:
        """Whether a word opens sentences in small letters."""
        d, n, *_, starts = self.of(word)
        return starts > 0.1 * max(1, d + n)

    def abbreviates(self, word: str) -> bool | None:
        """Whether a word before a full stop is an abbreviation; none if the corpus doesn't tell."""
        d, n, c, g, e, *_ = self.of(word)
        if 4 * n > d:
            return False
        if not d or n + 0.5 > 0.2 * (d + 1):
            return None
        if c >= 0.2 * (d + 1) or g >= 0.5 * (d + 1):
            return True
        # A capitalised word that always has its stop, and never at the end of a paragraph.
        return True if word[:1].isupper() and not n and self.inside(word) else None

    def inside(self, word: str) -> bool:
        """Whether the word's full stop never ends a paragraph, though it is seen often enough."""
        d, e = self.of(word)[0], self.of(word)[4]
        return e + 0.5 < 0.02 * (d + 1)

    def numbered(self, word: str) -> bool:
        """Whether a number mostly follows the word's full stop."""
        d, g = self.of(word)[0], self.of(word)[3]
        return g >= 0.5 * (d + 1)


def word_start(text: str, at: int, dots: bool = True) -> int:
    """Where the token that ends before ``at`` begins, with or without the stops inside it."""
    k = at
    while k and (_WORD_CHAR.match(text, k - 1) or (dots and text[k - 1] == "." and k < at)):
        k -= 1
    return k


def word_before(text: str, at: int, dots: bool = True) -> str:
    """The word, with or without the stops inside it, right before a full stop; none if it has digits."""
    token = text[max(0, at - 24) : at].split()[-1:]
    if token and len(token[0]) < 24 and token[0].isascii() and token[0].isalpha():
        return token[0]
    word = _LAST_WORD.search(text[word_start(text, at, dots) : at])
    return word[0] if word and not _DIGIT.search(word[0]) else ""


def observe(text: str, into: Counter, tokens: Counter) -> None:
    """Adds a document's unambiguous occurrences to the counts (kind, word), and its raw tokens."""
    tokens.update(text.split())
    for m in _GOES_ON.finditer(text):
        if word := word_before(text, m.start()):
            into["g" if m[1] else "c", word] += 1
    for word in _MID.findall(text):
        into["m", word] += 1
    for word in _AFTER_MARK.findall(text):
        into["s", word] += 1
    for part in _PARAGRAPH.split(text):
        part = part.rstrip()
        if not part:
            continue
        if part[-1] == "." and (word := word_before(part, len(part) - 1)):
            into["e", word] += 1
        if (part[-1] in _END or part[-1] in _CLOSERS) and part[0] not in "#-*•`" and (m := _FIRST.match(part)):
            into["s", m[1]] += 1


def settle(tokens: Counter, into: Counter) -> None:
    """Turns raw tokens into words with (d) and without (n) a full stop behind them."""
    for raw, n in tokens.items():
        for token in _TOKEN.findall(raw):
            if token[-1] == ".":
                into["d", token[:-1]] += n
            else:
                into["n", token] += n
    tokens.clear()


def corpus_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``word`` and its COUNTS over all documents, combined in each task before they are shuffled."""
    source = df.select(F.col(text_col).cast("string").alias("text")).where("text is not null and text != ''")

    def run(batches):
        def table(counts):
            words: dict[str, list[int]] = {}
            for (kind, word), n in counts.items():
                words.setdefault(word, [0] * len(COUNTS))[COUNTS.index(kind)] += n
            columns = list(zip(*words.values())) or [()] * len(COUNTS)
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), *(pa.array(c, pa.int64()) for c in columns)], names=["word", *COUNTS])

        counts: Counter = Counter()
        tokens: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                observe(text, counts, tokens)
                if len(tokens) > 200_000:
                    settle(tokens, counts)
            if len(counts) > 300_000:
                yield table(counts)
                counts = Counter()
        settle(tokens, counts)
        yield table(counts)

    counted = source.mapInArrow(run, "word string, " + ", ".join(f"{k} bigint" for k in COUNTS))
    return counted.groupBy("word").agg(*[F.sum(k).alias(k) for k in COUNTS])


def _regions(p: str) -> list[tuple[int, int]]:
    """Outermost balanced quotations and brackets of a paragraph, as (opening, closing) places."""
    stack: list[tuple[str, int]] = []
    open_now = dict.fromkeys("\"“„" + "".join(_OPEN_OF), 0)
    found: list[tuple[int, int]] = []

    def close(marks: str, at: int) -> None:
        while True:
            ch, i = stack.pop()
            open_now[ch] -= 1
            if ch in marks:
                found.append((i, at))
                return

    for m in _MARK.finditer(p):
        ch, i = m[0], m.start()
        if ch in _OPEN_OF or ch == "„":
            opening = True
        elif ch == '"':
            if open_now[ch]:
                close(ch, i)
                continue
            opening = (i == 0 or not p[i - 1].isalnum()) and i + 1 < len(p) and not p[i + 1].isspace()
        elif ch == "“":
            if stack and stack[-1][0] == "„":
                close("„", i)
                continue
            opening = True
        elif ch == "”":
            if open_now["“"] or open_now["„"]:
                close("“„", i)
            continue
        else:
            if open_now[_PAIRS[ch]]:
                close(_PAIRS[ch], i)
            continue
        if opening:
            stack.append((ch, i))
            open_now[ch] += 1
    outer: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if not outer or a > outer[-1][1]:
            outer.append((a, b))
    return outer


def _cjk(ch: str) -> bool:
    return "⺀" <= ch <= "꓏" or "가" <= ch <= "힯" or "豈" <= ch <= "﫿" or "＀" <= ch <= "￯" or ch >= "\U00020000"


def _uncased(ch: str) -> bool:
    return ch.isalpha() and ch.lower() == ch.upper()


class Document:
    """Unambiguous occurrences of words in one document, found when they are first asked for."""

    def __init__(self, text: str):
        self.text = text
        self.kinds: dict[str, str] = {}

    @cached_property
    def continued(self) -> frozenset:
        """Words that go on after a full stop: with a comma or a small letter."""
        return frozenset(word_before(self.text, m.start()) for m in _GOES_ON.finditer(self.text) if not m[1])

    @cached_property
    def bare(self) -> frozenset:
        """Words without a full stop."""
        return frozenset(t for t in _TOKEN.findall(self.text) if t[-1] != ".")

    @cached_property
    def names(self) -> frozenset:
        """Words with a capital inside of a sentence."""
        return frozenset(_MID.findall(self.text))

    @cached_property
    def openers(self) -> frozenset:
        """Words behind a mark that certainly ends a sentence."""
        return frozenset(_AFTER_MARK.findall(self.text))

    @cached_property
    def danda(self) -> bool:
        return "।" in self.text or "॥" in self.text

    def ordinary(self, word: str) -> bool | None:
        """Whether a capitalised word is also written small (an ordinary word), or is a name."""
        name, small = word in self.names, word.lower() in self.bare
        return small if name != small else None


class Splitter:
    """Splits the paragraphs of one document."""

    def __init__(self, text: str, evidence: Evidence, document: Document | None = None):
        self.text, self.evidence, self.document = text, evidence, document or Document(text)
        self.thai = bool(_THAI.search(text))
        self._urls: tuple[list[int], list[int]] | None = None
        self._uncased: bool | None = None

    def opens(self, word: str) -> bool:
        """Whether a word may open a sentence after a doubtful full stop, by document, else by corpus."""
        return word in self.document.openers or bool(self.document.ordinary(word)) or self.evidence.opens(word)

    def common(self, word: str) -> bool:
        """Whether a capitalised word is an ordinary word, not a name, by document, else by corpus."""
        told = self.document.ordinary(word)
        return self.evidence.common(word) if told is None else told

    def kind_of(self, word: str) -> str:
        """The kind of a word, told once a document."""
        kinds = self.document.kinds
        if word not in kinds:
            kinds[word] = self._kind_of(word)
        return kinds[word]

    def _kind_of(self, word: str) -> str:
        """initial, title, numeric, inner, ender, abbreviation or '' of a token before a full stop.

        The document tells whether it is an abbreviation if its occurrences agree, else the corpus,
        else the lists; the kind is told by the corpus, else by the lists.
        """
        if len(word) == 1:
            return "initial" if word.isupper() else "title" if _uncased(word) else "ender"
        goes_on, by_corpus = word in self.document.continued, self.evidence.abbreviates(word)
        if not goes_on and not by_corpus and "." not in word and (by_corpus is False or word not in LISTED):
            # Neither of the three makes it an abbreviation, so the bare words needn't be gathered.
            return ""
        is_one = goes_on if goes_on != (word in self.document.bare) else by_corpus
        if is_one is False:
            return ""
        if is_one or by_corpus:
            if self.evidence.numbered(word):
                return "numeric"
            if self.evidence.inside(word):
                return "inner"
            d, *_, e, _, _ = self.evidence.of(word)
            if e >= 0.02 * d > 0:
                return "ender"
        for kind, words in (("title", TITLES), ("ender", ENDERS), ("inner", INNER), ("numeric", NUMERIC)):
            if word in words:
                return kind
        parts = word.split(".")
        if len(parts) > 1 and all(len(x) <= 2 for x in parts):
            return "ender"
        return "abbreviation" if is_one else ""

    def ends(self, p: str, a: int, b: int) -> bool:
        """Whether the marks p[a:b], outside of quotations and brackets, end a sentence."""
        n = len(p)
        last = p[b - 1]
        if b >= n:
            return True
        if last in "。！？｡":
            return True
        if last in "।॥۔":
            return True
        nxt = p[b]
        j = b
        while j < n and p[j].isspace():
            j += 1
        if j >= n:
            return True
        gap, head = j > b, p[j]
        dots = p[a:b]
        if last == "…" or (last == "." and b - a > 1 and set(dots) == {"."}):
            if not gap or not head.isupper():
                return False
            word = _NEXT_WORD.match(p, j)
            return self.opens(word[0]) if word else False
        if last == "．":
            return gap
        if last in "!?؟‼⁇⁈⁉" or (b - a > 1 and set(dots) & set("!?")):
            if not gap:
                if nxt in _OPENERS + "¿¡":
                    return True
                return nxt.isalpha() and (nxt.isupper() or _uncased(nxt)) and not self._urlish(p, a, n)
            if head in ",;:":
                return False
            if head in "-–—":
                return False
            if head.islower():
                word = _NEXT_WORD.match(p, j)
                return bool(word) and self.evidence.starts_low(word[0])
            return True
        # One full stop.
        if a == 0 or p[a - 1].isspace():
            return False
        if not gap:
            return self._missing_blank(p, a, b)
        word = word_before(p, a)
        if head in ",;:)]}":
            return False
        if head in "-–—" and not (j + 1 < n and p[j + 1].isdigit()):
            k = j
            while k < n and (p[k].isspace() or p[k] in "-–—"):
                k += 1
            return k < n and p[k].isupper() and not word == ""
        kind = self.kind_of(word) if word else ""
        k = j
        while k < n and (p[k] in _OPENERS or p[k] in "¿¡`*_" or p[k].isspace()):
            k += 1
        follow = _NEXT_WORD.match(p, k) if k < n else None
        nword = follow[0] if follow else ""
        number = a > 0 and not word and (p[a - 1].isdigit())
        if head in "¿¡":
            return kind not in ("title", "initial")
        if nword and nword[0].isdigit():
            if kind == "ender":
                return len(word) > 1
            return not kind and not (word and self.evidence.numbered(word))
        if nword and nword[0].islower():
            if kind and kind != "ender":
                return False
            return self.evidence.starts_low(nword) or (not kind and any(c.isupper() for c in nword[1:]))
        if not nword:
            return kind == "" or (kind == "ender")
        devanagari = "ऀ" <= word[-1:] <= "ॿ"
        if devanagari and self.document.danda:
            # Sentences end with dandas, so a full stop abbreviates.
            return False
        if _uncased(nword[0]):
            return kind == "" or (kind == "ender" and len(word) > 1)
        # A capital letter follows.
        if len(nword) == 1 and p[k + 1 : k + 2] == "." and len(word) == 1:
            return False
        if number:
            # Ordinals: a word that never opens a sentence is what is counted.
            d = a
            while d and a - d < 3 and (p[d - 1].isdigit() or p[d - 1] in ".,:"):
                d -= 1
            if a - d < 3 and p[d:a].isdigit():
                return nword not in MONTHS and self.opens(nword)
            return True
        if kind == "":
            return True
        if kind == "initial":
            return self.common(nword) and self.opens(nword)
        if kind == "ender" and len(word) > 1 and (head in _OPENERS or word.islower() or _DIGIT.search(nword)):
            # An abbreviation in small letters is no part of a name, and a name with digits is none of one.
            return True
        t = a - len(word)
        while t and p[t - 1].isspace():
            t -= 1
        if t and p[t - 1].isdigit() and kind != "title":
            # Behind a number it is a unit, which may end a sentence.
            return self.opens(nword)
        if len(word) == 1 and self.evidence.inside(word):
            return False
        if kind == "title" or kind == "inner":
            return False
        if kind == "numeric":
            return word in self.document.bare and self.opens(nword) and self.common(nword)
        if kind == "abbreviation":
            return self.common(nword) and self.opens(nword)
        return self.opens(nword)

    def _urlish(self, p: str, a: int, b: int) -> bool:
        """Whether the unspaced token around p[a] looks like an address up to p[b]."""
        if self._urls is None:
            self._urls = ([], [])
            for m in re.finditer(r"\S+", p):
                if url := _URLISH.search(p, m.start(), m.end()):
                    self._urls[0].append(m.start())
                    self._urls[1].append((m.end(), url.end()))
        i = bisect(self._urls[0], a) - 1
        return i >= 0 and a < self._urls[1][i][0] and self._urls[1][i][1] <= b

    def _missing_blank(self, p: str, a: int, b: int) -> bool:
        """A full stop inside a token: a sentence end whose blank is missing?"""
        nxt = p[b]
        if nxt in "¿¡":
            return True
        k = b
        while k < len(p) and p[k] in "\"“«„(":
            k += 1
        if k >= len(p) or not p[k].isupper():
            return False
        if nxt in _CLOSERS and nxt not in _OPENERS:
            return False
        prev = p[a - 1]
        first, word = word_start(p, a, False), word_before(p, a, False)
        if word:
            if len(word) == 1 or (first > 1 and p[first - 1] == "." and _WORD_CHAR.match(p, first - 2)) or self.kind_of(word) in ("title", "initial", "inner"):
                return False
        elif not (prev.isdigit() or prev in _CLOSERS or prev == "%"):
            return False
        follow = _NEXT_WORD.match(p, k)[0]
        if k + len(follow) < len(p) and p[k + len(follow)] == "." and len(follow) > 1 and k + len(follow) + 1 < len(p) and p[k + len(follow) + 1].isalnum():
            return False
        if len(follow) > 1 and follow.isupper() and prev.isupper():
            return False
        if self._urlish(p, a, b):
            return False
        return self.opens(follow) or len(follow) == 1

    def quote_ends(self, p: str, start: int, a: int, b: int) -> bool:
        """Whether a quotation or bracket p[a..b] that holds a sentence end inside also ends its sentence."""
        n = len(p)
        k = b - 1
        while k > a and (p[k].isspace() or p[k] in _CLOSERS):
            k -= 1
        if p[k] not in _END or p[a] in "《〈【{":
            return False
        j = b + 1
        while j < n and p[j].isspace():
            j += 1
        if j >= n:
            return True
        gap, head = j > b + 1, p[j]
        if head in ",;:.!?。！？，；：、…)-–—）":
            return False
        i = a - 1
        while i >= start and p[i].isspace():
            i -= 1
        at_start = i < start or (p[i] in "¿¡" and i == start)
        introduced = not at_start and p[i] in ":：,，、"
        if p[a] in "([（":
            return at_start and (gap or p[a] == "（")
        follow = _NEXT_WORD.match(p, j)
        if head in _OPENERS:
            if head in "([（":
                return (at_start or introduced) and j + 1 < n and p[j + 1].isupper()
            return True
        if head in "¿¡":
            return True
        if not gap:
            if at_start:
                return False
            return introduced and p[i] in ":：" and (head.isalnum() or _cjk(head))
        if head.islower():
            word = follow[0] if follow else ""
            return introduced and self.evidence.starts_low(word)
        if at_start:
            if head.isupper():
                return not self._uncased_text(p)
            return not _uncased(head)
        if _uncased(head):
            return introduced
        return introduced or head.isupper() or head.isdigit()

    def _uncased_text(self, p: str) -> bool:
        if self._uncased is None:
            self._uncased = any(_uncased(c) and not c.isascii() and c not in "ªº" for c in set(p))
        return self._uncased

    def paragraph(self, s: int, e: int, out: list[tuple[int, int]]) -> None:
        p = self.text[s:e]
        regions = _regions(p) if _MARK.search(p) else []
        openings = {a for a, _ in regions}
        self._urls = self._uncased = None
        cuts: list[int] = []
        start = 0

        def cut_at(end: int) -> None:
            nonlocal start
            while end < len(p) and p[end] in _CLOSERS and (p[end] != '"' or (end + 1 >= len(p) or p[end + 1].isspace())) and end not in openings:
                end += 1
            cuts.append(end)
            start = end
            while start < len(p) and p[start].isspace():
                start += 1

        events = []
        r = 0
        for m in _STOP.finditer(p):
            while r < len(regions) and regions[r][1] < m.start():
                r += 1
            if r < len(regions) and regions[r][0] <= m.start() <= regions[r][1]:
                continue
            events.append((m.end(), 0, m.start(), m.end()))
        events += [(b + 1, 1, a, b) for a, b in regions]
        if self.thai and len(_THAI.findall(p)) > 0.3 * sum(c.isalpha() for c in p):
            r = 0
            for m in _THAI_GAP.finditer(p):
                while r < len(regions) and regions[r][1] < m.start():
                    r += 1
                if r == len(regions) or not regions[r][0] < m.start() < regions[r][1]:
                    events.append((m.start(), 2, m.start(), m.end()))
        events.sort()
        for end, kind, a, b in events:
            if kind == 2:
                cut_at(end)
            elif kind == 0:
                if a >= start and self.ends(p, a, b):
                    cut_at(b)
            elif self.quote_ends(p, start, a, b):
                cut_at(end)
        first = 0
        for end in [*cuts, len(p)]:
            _emit(self.text, s + first, s + end, out)
            first = max(first, end)

    def split(self) -> list[tuple[int, int]]:
        text = self.text
        out: list[tuple[int, int]] = []
        lines, at = [], 0
        for m in _LINE.finditer(text):
            lines.append((at, m.start()))
            at = m.end()
        lines.append((at, len(text)))
        heads = Counter(m[1].lower() for s, e in lines if (m := _LABEL.match(text, s, e)) and " " not in m[1])
        i, n = 0, len(lines)
        block: tuple[int, int] | None = None
        in_list, item_open, first = False, False, True

        def close():
            nonlocal block, first
            if block:
                s, e = block
                line = text[s:e].strip() if first or e - s <= 400 else text[s:e]
                if (first or len(line) <= 40) and len(line) <= 120 and not _LINE.search(line) and line[-1:] not in _END and line[-1:] not in _CLOSERS and not self._sentences_in(line):
                    _emit(text, s, e, out)
                else:
                    self.paragraph(s, e, out)
                first = False
            block = None

        def close_item():
            nonlocal block, first
            if block:
                _emit(text, *block, out)
                first = False
            block = None

        while i < n:
            s, e = lines[i]
            line = text[s:e]
            if not line or line.isspace():
                (close_item if item_open else close)()
                in_list = item_open = False
            elif fence := _FENCE.match(line):
                (close_item if item_open else close)()
                in_list = item_open = False
                mark, j = fence[1], i + 1
                if mark in line[fence.end() :]:
                    j = i
                else:
                    closing = re.compile(rf"\s*{re.escape(mark[0])}{{{len(mark)},}}\s*$")
                    while j < n and not closing.match(text, lines[j][0], lines[j][1]):
                        j += 1
                    j = min(j, n - 1)
                _emit(text, s, lines[j][1], out)
                first, i = False, j
            elif _HEADING.match(line):
                (close_item if item_open else close)()
                in_list = item_open = False
                _emit(text, s, e, out)
                first = False
            elif (m := _ITEM.match(line)) and (block is None or in_list) and not _RULE.match(line):
                (close_item if item_open else close)()
                in_list = item_open = True
                block = (s, e)
            elif (m := _LABEL.match(line)) and (m[1].lower() in LABELS or heads[m[1].lower()] > 1):
                (close_item if item_open else close)()
                in_list = item_open = False
                block = (s, e)
            elif item_open:
                if line[0].isspace() or block[1] - block[0] > 60 or text[block[0] : block[1]].rstrip()[-1:] not in _END:
                    block = (block[0], e)
                else:
                    close_item()
                    item_open = in_list = False
                    block = (s, e)
            elif block is None:
                block = (s, e)
            else:
                block = (block[0], e)
            i += 1
        (close_item if item_open else close)()
        return out

    def _sentences_in(self, line: str) -> bool:
        """Whether a line that may be a title holds more than one sentence."""
        if re.match(r"[^\W\d_]{1,3}\. ?\d+\s?[:.–-]", line):
            return False
        found: list[tuple[int, int]] = []
        Splitter(line, self.evidence, self.document).paragraph(0, len(line), found)
        return len(found) > 1


def _emit(text: str, s: int, e: int, out: list[tuple[int, int]]) -> None:
    while s < e and text[s].isspace():
        s += 1
    while e > s and text[e - 1].isspace():
        e -= 1
    if e > s:
        out.append((s, e))


def split_text(text: str | None, evidence: Evidence | None = None) -> list[tuple[int, int]]:
    """Sentence units of a text as (start, end) in code points; none for a null, empty or blank text."""
    return Splitter(text, evidence or Evidence()).split() if text else []


def asked_words(text: str) -> set[str]:
    """All words about which the splitting of a text may ask the corpus: those before and behind marks."""
    asked = set()
    for m in _STOP.finditer(text):
        # A stop inside a token asks about what follows the last stop before it.
        if m[0] == "." and (word := word_before(text, m.start(), text[m.end() : m.end() + 1].isspace())):
            asked.add(word)
    done = 0
    for m in _ENDING.finditer(text):
        if m.start() >= done:
            done = _BETWEEN.match(text, m.end()).end()
            if word := _NEXT_WORD.match(text, done):
                asked.update((word[0], word[0].lower()))
    return asked


#: Marks that may end a sentence, a quotation or a bracket, and what may lie between them and a word.
_ENDING = re.compile(f"[{re.escape(_END + _CLOSERS)}]")
_BETWEEN = re.compile(rf"[\s{re.escape(_END + _OPENERS + _CLOSERS)}¿¡`*–—-]*+_*+")


def sentence_units(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT_WORDS) -> DataFrame:
    """One row (id, start_char, end_char) for each sentence unit of each document.

    * Null, empty and blank texts have no unit; the units of a text cover all but its white space.
    * Repeated rows and ids give their units each time; a null id stays null.
    * Two passes over the texts: the corpus counts, then the splitting. The counts of the ``hot``
      most frequent words are broadcast, so texts that ask about no other word are split where
      they are read. The others are joined with the counts of the words they ask about, so no
      count is left out and nothing that grows is broadcast. The result doesn't depend on ``hot``.
    """
    counts = cut(corpus_counts(df, text_col))
    top = counts.orderBy(F.desc(F.col("d") + F.col("n")), "word").limit(hot).toPandas()
    known = df.sparkSession.sparkContext.broadcast({w: tuple(map(int, c)) for w, *c in top.itertuples(index=False)})
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null and text != ''")
    kind = dict(source.dtypes)["id"]
    # Fewer words than the limit: the broadcast has them all.
    complete = len(top) < hot

    def first(batches):
        evidence = Evidence(known.value)
        have = known.value.keys()
        base, made = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            texts, asks, units = [], [], []
            for text in batch.column("text").to_pylist():
                ask = set() if complete else asked_words(text) - have
                texts.append(text if ask else None)
                asks.append(sorted(ask))
                units.append([] if ask else split_text(text, evidence))
            keys = pa.array(range(base + made, base + made + len(texts)), pa.int64())
            made += len(texts)
            starts, ends = ([[u[k] for u in x] for x in units] for k in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [keys, batch.column("id"), pa.array(texts, pa.string()), pa.array(asks, pa.list_(pa.string())), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))],
                names=["key", "id", "text", "asks", "starts", "ends"],
            )

    def second(batches):
        hot_words = known.value
        for batch in batches:
            at, starts, ends = [], [], []
            for i, (text, answers) in enumerate(zip(batch.column("text").to_pylist(), batch.column("answers").to_pylist())):
                evidence = Evidence(ChainMap({x["word"]: tuple(x[k] for k in COUNTS) for x in answers or ()}, hot_words))
                units = split_text(text, evidence)
                at += [i] * len(units)
                starts += [u[0] for u in units]
                ends += [u[1] for u in units]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int32())), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["id", "start_char", "end_char"])

    seen = source.mapInArrow(first, f"key bigint, id {kind}, text string, asks array<string>, starts array<bigint>, ends array<bigint>")
    if not complete:
        seen = cut(seen)
    split = seen.where("text is null").select("id", F.explode(F.arrays_zip("starts", "ends")).alias("u")).select("id", F.col("u.starts").alias("start_char"), F.col("u.ends").alias("end_char"))
    if not complete:
        waiting = seen.where("text is not null").select("key", "id", "text")
        answers = seen.where("text is not null").select("key", F.explode("asks").alias("word")).join(counts, "word").groupBy("key").agg(F.collect_list(F.struct("word", *COUNTS)).alias("answers"))
        later = waiting.join(answers, "key", "left").select("id", "text", "answers").mapInArrow(second, f"id {kind}, start_char bigint, end_char bigint")
        split = split.unionByName(later)
    return split.withColumnRenamed("id", id_col)
