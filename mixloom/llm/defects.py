"""Broken prompt and response pairs (problem 2): linear classifiers over hashed n-grams and pair features.

No labels exist, so the classifiers learn from responses of a bounded sample that are broken on
purpose: cut off, replaced by the prompt, swapped with an answer in another language, refused, or
emptied.  The sample's own responses are the counter-examples; a second round takes out those the
first round finds broken.  Each defect has its own logistic regression over its own features and a
threshold calibrated on held-out examples.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
import zlib
from collections import Counter
from functools import lru_cache
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mixloom.functions.names import lang_key
from mixloom.llm.refusals import refusals
from mixloom.session import cut

#: Bounds of what the classifiers are fitted on: prompts, labelled examples for languages, and the
#: characters of each (at most 180 MB in all). Every entry is classified, whatever its size.
SAMPLE_PROMPTS, SAMPLE_LABELLED, SAMPLE_CHARS = 5_000, 6_000, 16_384
DEFECTS = ("empty", "copy", "refusal", "language", "truncated")
BITS = 18
SIZE = 1 << BITS

_TOKEN = re.compile(r"[^\W\d_]+|\d+|_|[^\w\s]")
_DIGITS = re.compile(r"\d+")
_ALNUM = re.compile(r"[^\W_]+")
_DENSE = re.compile(r"[぀-ヿ㐀-鿿豈-﫿฀-๿가-힯]")
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,60}>|\[/?[A-Z_]{2,20}\]|```\w*|~~~\w*")
_TAG_MARK = re.compile(r"[<\[`~]")
_THOUGHT = re.compile(r"(?s)^\s*<think(?:ing)?>.*?</think(?:ing)?>")
_TERMINAL = re.compile(r"[.!?…。！？｡।॥؟۔][\"”»“’)\]』」》）】*_`]*$")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"”»“)]*\s+|(?<=[。！？।])[”」』]*|\n+")
_ECHO = re.compile(
    r"\b(?:copy|repeat|echo|verbatim|word for word|recite|quote|restate|say back|reproduce|wiederhol\w*|abschreiben|kopier\w*|wörtlich|répèt\w*|recopi\w*|mot pour mot|copi[ae]\w*|repit[ea]\w*|"
    r"palabra por palabra|повтори\w*|скопируй\w*|дословно)\b|重复|复述|抄写|照抄|繰り返|復唱|書き写|दोहरा|كرر|انسخ|ทวน|คัดลอก",
    re.I,
)
#: Names of languages in the languages of the data, by code.
_NAMES = {
    "en": "english englisch englische anglais inglés ingles английск 英语 英文 英語 अंग्रेज़ी अंग्रेजी อังกฤษ الإنجليزية",
    "de": "german deutsch allemand alemán aleman немецк 德语 德文 ドイツ語 जर्मन เยอรมัน الألمانية",
    "fr": "french französisch francais français francés frances французск 法语 法文 フランス語 फ़्रेंच ฝรั่งเศส الفرنسية",
    "es": "spanish spanisch espagnol español espanol испанск 西班牙语 スペイン語 स्पेनिश สเปน الإسبانية",
    "ru": "russian russisch russe ruso русск 俄语 ロシア語 रूसी รัสเซีย الروسية",
    "zh": "chinese mandarin chinesisch chinois chino китайск 中文 汉语 中国語 चीनी จีน الصينية",
    "ja": "japanese japanisch japonais japonés japones японск 日语 日文 日本語 जापानी ญี่ปุ่น اليابانية",
    "hi": "hindi хинди 印地语 ヒンディー語 हिंदी हिन्दी ฮินดี الهندية",
    "th": "thai thailändisch thaï tailandés тайск 泰语 タイ語 थाई ภาษาไทย التايلاندية",
    "ar": "arabic arabisch arabe árabe арабск 阿拉伯语 アラビア語 अरबी อาหรับ العربية",
}
_SCRIPTS = (("ru", re.compile(r"[Ѐ-ӿ]")), ("hi", re.compile(r"[ऀ-ॿ]")), ("th", re.compile(r"[฀-๿]")), ("ar", re.compile(r"[؀-ۿ]")), ("ko", re.compile(r"[가-힯]")))
_KANA, _HAN, _LATIN = re.compile(r"[぀-ヿ]"), re.compile(r"[㐀-鿿]"), re.compile(r"[A-Za-zÀ-ɏ]")
_OTHER_SCRIPT = re.compile(r"[Ѐ-ӿऀ-ॿ฀-๿؀-ۿ가-힯぀-ヿ㐀-鿿]")
_LATIN_WORD = re.compile(r"[a-zß-ɏ]+")
_WORD_OR_END = re.compile(r"[a-zß-ɏ]+|\n")
_PART = re.compile(r"[.!?…]\s+|[。！？।\n]+")
#: What stands for a missing answer.
PLACEHOLDERS = (
    "n/a na null none nil nan undefined tbd todo empty blank (empty) [empty] <empty> (blank) [blank] (none) [none] (null) [null] (no response) [no response] <no response> (no answer) [no answer] "
    "(no output) [no output] [response] [answer] (response) [deleted] [removed] [redacted] [placeholder] placeholder [insert answer here] <insert answer> {answer} {{answer}} {response} {{response}} "
    "(leer) [keine antwort] (vide) [pas de réponse] (vacío) [sin respuesta] (пусто) [нет ответа] （空） [无回答] 无 （なし） [回答なし] [no text] no response"
)
LABELS = "answer|assistant|response|output|reply|result|final answer|the answer is|answer is|a|ai|bot|system|antwort|réponse|respuesta|ответ|回答|答案|答|助手|回答：|アシスタント|assistent|asistente|ассистент|उत्तर|คำตอบ|الجواب"
_LABEL = re.compile(rf"^\W*(?:{LABELS})\W*$", re.I)


def slot(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) & (SIZE - 1)


def slots(names: list[str]) -> list[int]:
    try:
        return [zlib.crc32(name.encode()) & (SIZE - 1) for name in names]
    except UnicodeEncodeError:
        return [slot(name) for name in names]


def _continued(starts: list[int], rest: list[str]) -> list[int]:
    """Slots of names whose beginnings have the CRCs ``starts``."""
    try:
        return [zlib.crc32(x.encode(), crc) & (SIZE - 1) for crc, x in zip(starts, rest)]
    except UnicodeEncodeError:
        return [zlib.crc32(x.encode("utf-8", "replace"), crc) & (SIZE - 1) for crc, x in zip(starts, rest)]


def _tokens(text: str) -> list[str]:
    if text.isascii():
        return _TOKEN.findall(_DIGITS.sub("0", text.lower()))
    return ["0" if t[0].isdigit() else t for t in _TOKEN.findall(text.lower())]


_INVISIBLE = re.compile("[" + "".join(re.escape(chr(c)) for c in range(0x110000) if unicodedata.category(chr(c)) in ("Cf", "Cc") and chr(c) not in "\n\t") + "]+")


def plain(text: str) -> str:
    if text.isascii():
        return _INVISIBLE.sub("", text).strip() if not text.isprintable() else text.strip()
    text = unicodedata.normalize("NFKC", text)
    # No printable text holds what is removed.
    return text.strip() if text.isprintable() else _INVISIBLE.sub("", text).strip()


class _Hashed(dict):
    def __missing__(self, token: str) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[token] = zlib.crc32(token.encode("utf-8", "replace"))
        return value


_hashed = _Hashed()


class Languages:
    """Multinomial model of words of Latin scripts; other scripts tell the language themselves."""

    def __init__(self, rows: list[tuple[str, str]]):
        counts: dict[str, Counter] = {}
        for text, lang in rows:
            if lang in ("en", "de", "fr", "es", "pt", "it", "nl", "pl", "tr", "sv"):
                counts.setdefault(lang, Counter()).update(set(_LATIN_WORD.findall(text.lower())))
        self.langs = sorted(counts)
        total = {k: sum(c.values()) + 1 for k, c in counts.items()}
        every = Counter()
        for c in counts.values():
            every.update(c)
        self.scores: dict[str, list[float]] = {}
        for w, n in every.items():
            if n >= 2:
                rates = [(counts[k][w] + 0.05) / total[k] for k in self.langs]
                mean = sum(rates) / len(rates)
                self.scores[w] = [max(-3.0, min(3.0, math.log(r / mean))) for r in rates]

    def shares(self, text: str) -> tuple[Counter, int]:
        """Characters of a text by language, sentence by sentence; and how many could be told."""
        found: Counter = Counter()
        foreign = bool(_OTHER_SCRIPT.search(text))
        for part in _PART.split(text.lower()):
            if not part:
                continue
            n: dict[str, int] = {}
            if foreign and not part.isascii():
                for lang, script in _SCRIPTS:
                    if k := len(script.findall(part)):
                        n[lang] = k
                kana, han = len(_KANA.findall(part)), len(_HAN.findall(part))
                if kana + han:
                    # A character of these scripts says about as much as two letters.
                    n["ja" if kana > 0.15 * (kana + han) else "zh"] = 2 * (kana + han)
            words = [w for w in _LATIN_WORD.findall(part) if w in self.scores]
            if words:
                sums = [sum(column) for column in zip(*map(self.scores.__getitem__, words))]
                known = sum(map(len, words))
                order = sorted(sums)
                if len(sums) == 1 or order[-1] - order[-2] > 0.7:
                    lang = self.langs[sums.index(order[-1])]
                    n[lang] = n.get(lang, 0) + (known if not n else known // 2)
            for lang, k in n.items():
                found[lang] += k
        return found, sum(found.values())

    def _table(self) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
        """A number for each word, at it the word's scores and length; the end of a sentence is -2."""
        if getattr(self, "_made", (None,))[0] is not self.scores:
            words = list(self.scores)
            scores = np.array([self.scores[w] for w in words], np.float64).reshape(len(words), len(self.langs))
            self._made = (self.scores, ({w: i for i, w in enumerate(words)} | {"\n": -2}, scores, np.array([len(w) for w in words], np.int64)))
        return self._made[1]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_made"}

    def shares_many(self, texts: list[str]) -> list[tuple[dict, int]]:
        """What ``shares`` tells about each text, for all at once where only words of Latin scripts tell it."""
        out: list[tuple[dict, int]] = [({}, 0)] * len(texts)
        at, lengths, every = [], [], []
        for i, text in enumerate(texts):
            if not text.isascii() and _OTHER_SCRIPT.search(text):
                out[i] = self.shares(text)
                continue
            words = _WORD_OR_END.findall(_PART.sub("\n", text.lower()))
            at.append(i)
            lengths.append(len(words))
            every += words
        if not every or not self.scores:
            return out
        index, scores, sizes = self._table()
        ids = np.fromiter(map(index.get, every, repeat(-1)), np.int64, len(every))
        row = np.repeat(np.arange(len(at)), lengths)
        part = np.cumsum(ids == -2) + row
        n = int(part[-1]) + 1
        known = ids >= 0
        ids, row, part = ids[known], row[known], part[known]
        sums = np.stack([np.bincount(part, weights=scores[ids, k], minlength=n) for k in range(len(self.langs))])
        chars = np.bincount(part, weights=sizes[ids], minlength=n)
        of = np.zeros(n, np.int64)
        of[part] = row
        sure = chars > 0
        if len(sums) > 1:
            order = np.sort(sums, axis=0)
            sure &= order[-1] - order[-2] > 0.7
        cell = of[sure] * len(sums) + sums.argmax(axis=0)[sure]
        found = np.bincount(cell, weights=chars[sure], minlength=len(at) * len(sums)).astype(np.int64).reshape(len(at), len(sums))
        for i, counts in zip(at, found.tolist()):
            out[i] = ({lang: k for lang, k in zip(self.langs, counts) if k}, sum(counts))
        return out


_EVERY_NAME = re.compile("|".join(re.escape(name) for names in _NAMES.values() for name in names.split()))


def _asked(prompt: str) -> set[str]:
    low = prompt.lower()
    if not _EVERY_NAME.search(low):
        return set()
    return {lang for lang, names in _NAMES.items() if any(name in low for name in names.split())}


class Features:
    """Feature slots of a pair for each defect; ``known`` are the words of the sample."""

    def __init__(self, languages: Languages, known: frozenset[str]):
        self.languages, self.known = languages, known
        self._prompt: tuple[str | None, tuple] = (None, ())
        self._text: tuple[str | None, str, str] = (None, "", "")

    def of(self, prompt: str | None, text: str | None, followed: bool = False) -> dict[str, np.ndarray]:
        """Slots of all defects; ``followed`` says that other responses go on after the last line, a list item."""
        return {d: self.one(d, prompt, text, followed) for d in DEFECTS}

    def many(self, pairs: list[tuple], followed: list[bool] | None = None) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """What ``of`` gives for each pair, packed as by ``Linear.pack``."""
        asked = list(dict.fromkeys(p or "" for p, _ in pairs))
        clean = [plain(p) for p in asked]
        told = dict(zip(asked, zip(clean, self.languages.shares_many(clean))))
        parts = [self._parts(t or "") for _, t in pairs]
        answers = [answer for *_, answer in parts]
        shares = self.languages.shares_many([_code_free(a) if "`" in a else a for a in answers])
        rows: dict[str, list[list[int]]] = {d: [] for d in DEFECTS if d != "refusal"}
        for (p, _), (raw, text, answer), mine, goes_on in zip(pairs, parts, shares, followed or repeat(False)):
            self._prompt_parts(p or "", told[p or ""])
            rows["empty"].append(self._empty(answer))
            rows["copy"].append(self._copy(p or "", answer))
            rows["language"].append(self._language(p or "", answer, mine))
            rows["truncated"].append(self._truncated(raw.rstrip(), text, goes_on))
        packed = {}
        for d, found in rows.items():
            ends = np.concatenate([[0], np.cumsum([len(r) for r in found], dtype=np.int64)])
            packed[d] = np.fromiter(chain.from_iterable(found), np.int32, int(ends[-1])), ends
        flat, row = self._refusals(answers)
        packed["refusal"] = flat[np.argsort(row, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(pairs)))])
        return packed

    def one(self, defect: str, prompt: str | None, text: str | None, followed: bool = False) -> np.ndarray:
        raw, clean, answer = self._parts(text or "")
        prompt = prompt or ""
        if defect == "empty":
            found = self._empty(answer)
        elif defect == "copy":
            found = self._copy(prompt, answer)
        elif defect == "refusal":
            found = self._refusals([answer])[0]
        elif defect == "language":
            found = self._language(prompt, answer)
        else:
            found = self._truncated(raw.rstrip(), clean, followed)
        return np.array(found, np.int32)

    def _parts(self, raw: str) -> tuple[str, str, str]:
        if self._text[0] != raw:
            clean = plain(raw)
            # What the answer says comes after the reasoning.
            self._text = (raw, clean, _THOUGHT.sub("", clean).strip() if "<" in clean else clean)
        return self._text

    def _empty(self, text: str) -> list[int]:
        if len(text) > 100 and "<" not in text and "[" not in text and _MANY.match(text):
            return _FULL
        bare = _TAG.sub(" ", text).strip()
        content = len("".join(_ALNUM.findall(bare)))
        low = bare.lower()
        out = [f"e:n{min(content, 12)}", f"e:len{min(len(bare), 30) // 3}", f"e:tag{bare != text}"]
        if content <= 24:
            inner = low.strip("\"'`*_.-–—:;!?()[]{}<>（）【】 \n\t")
            out += [f"e:is{inner}", f"e:shape{bare[:1] in '([{<（'}{bare[-1:] in ')]}>）'}{bool(inner)}", f"e:label{bool(_LABEL.match(bare))}", f"e:colon{bare.endswith((':', '：'))}"]
            out += [f"e:w{w}" for w in _tokens(low)]
            out.append(f"e:holder{low in _HOLDERS or inner in _HOLDERS_INNER}")
        return slots(out)

    def _prompt_parts(self, prompt: str, told: tuple[str, tuple[dict, int]] | None = None) -> tuple:
        if self._prompt[0] != prompt:
            clean, (found, n) = told or (clean := plain(prompt), self.languages.shares(clean))
            units = self._units(clean)
            self._prompt = (prompt, (Counter(units), set(zip(units, units[1:])), len(units), bool(_ECHO.search(clean)), found, n, _asked(clean)))
        return self._prompt[1]

    @staticmethod
    def _units(text: str) -> list[str]:
        if text.isascii() or not _DENSE.search(text):
            return _ALNUM.findall(text.lower())
        out = []
        for t in _ALNUM.findall(text.lower()):
            out += list(t) if _DENSE.search(t) else [t]
        return out

    def _copy(self, prompt: str, text: str) -> list[int]:
        tokens, ppairs, n, echo, *_ = self._prompt_parts(prompt)
        units = self._units(_TAG.sub(" ", text) if _TAG_MARK.search(text) else text)
        if not units or not n:
            return [slot("c:none")]
        inside = list(filter(tokens.__contains__, units))
        mine = Counter(inside)
        precision = len(inside) / len(units)
        recall = sum(min(k, tokens[t]) for t, k in mine.items()) / n
        # Without two words of the prompt no pair of them can be its own.
        pairs = set(zip(units, units[1:])) if len(inside) > 1 else set()
        shared = len(pairs & ppairs)
        both, back = shared / max(1, len(pairs)), shared / max(1, len(ppairs))
        return _copy_slots(int(precision * 10), int(recall * 10), int(both * 10), int(back * 10), int(min(4, len(units) / n) * 3), echo, min(len(units), 10))

    def _refusals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Slots of all texts, and for each slot the number of its text."""
        tokens = [_tokens(text.replace("’", "'")) for text in texts]
        lengths = [len(t) for t in tokens]
        h = np.fromiter(map(_hashed.__getitem__, chain.from_iterable(tokens)), np.int64, sum(lengths))
        row = np.repeat(np.arange(len(texts)), lengths)
        two = (h[:-1] * 1_000_003 + h[1:]) & 0x7FFFFFFFFFFF
        three = (two[:-1] * 1_000_003 + h[2:]) & 0x7FFFFFFFFFFF
        # No n-gram reaches from a text into the next.
        inside2, inside3 = row[1:] == row[:-1], row[2:] == row[:-2]
        parts, rows = [h, two[inside2], three[inside3]], [row, row[1:][inside2], row[2:][inside3]]
        for i, text in enumerate(texts):
            if not text.isascii() and _DENSE.search(text):
                chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
                c = chars + 0x1000000
                for _ in range(3):
                    if len(c) < 2:
                        break
                    c = (c[:-1] * 1_000_003 + chars[-len(c) + 1 :]) & 0x7FFFFFFFFFFF
                    parts.append(c)
                    rows.append(np.full(len(c), i))
        every = np.concatenate(parts)
        every = ((every ^ (every >> 17)) * 0x9E3779B1 >> 11) & (SIZE - 1)
        sizes = [_length_slot(int(math.log2(len(text) + 1))) for text in texts]
        return np.concatenate([every, np.array(sizes, np.int64)]).astype(np.int32), np.concatenate([*rows, np.arange(len(texts))])

    def _language(self, prompt: str, text: str, shares: tuple[dict, int] | None = None) -> list[int]:
        *_, found, n, asked = self._prompt_parts(prompt)
        mine, told = shares or self.languages.shares(_code_free(text) if "`" in text else text)
        if told < 6 or n < 2:
            return [slot("l:unknown")]
        top = {lang for lang, k in found.items() if k >= 0.3 * n}
        allowed = top | asked
        inside = sum(k for lang, k in mine.items() if lang in allowed) / told
        other = max((k for lang, k in mine.items() if lang not in allowed), default=0) / told
        sure = max(found.values()) / n
        return _language_slots(int(inside * 10), int(other * 10), int(other * 5), other > 0.5, min(6, int(math.log2(told))), int(sure * 4), bool(asked))

    def _truncated(self, raw: str, text: str, followed: bool) -> list[int]:
        if not text:
            return [slot("t:none")]
        ends = text.rstrip(_CLOSING)[-1:] in _TERMINALS
        fences = text.count("```") % 2 == 1
        pieces = _last_tokens(text)
        tokens = ["0" if t[0].isdigit() else t.lower() for t in pieces[-6:]]
        end = text[-1]
        kind = "L" if end.isalpha() else "D" if end.isdigit() else end
        last_line = text.rsplit("\n", 1)[-1].strip()
        sentence = _last_sentence(text) or last_line
        shaped = ["0" if t[0].isdigit() else "X" if t[0].isupper() else t for t in pieces[-6:]]
        last = pieces[-1].lower() if pieces and pieces[-1].isalpha() else ""
        seen = "-" if not last else "dense" if _DENSE.search(last) else str(last in self.known)
        item = bool(_LISTED.match(last_line))
        items = len(_EVERY_LISTED.findall(text)) if "\n" in text and _LIST_MARK.search(text) else int(item)
        # Without a bracket the counts are all 0.
        opened = len(_OPENED.findall(sentence)) - len(_CLOSED.findall(sentence)) if _BRACKET.search(sentence) else 0
        left_open = bool(_OPENING.search(text)) and any(text.count(a) > text.count(b) for a, b in _PAIRS)
        struct = "none"
        if text[:1] in "{[":
            try:
                json.loads(text)
                struct = "json"
            except ValueError:
                struct = "broken"
        inside = _tokens(sentence)
        n = len(inside)
        whole = len(last_line) < 120
        line = inside if whole and last_line == sentence else _tokens(last_line) if whole else _first_tokens(last_line[:120])
        bare = ["-", *line[1:]] if item else line
        tail = _DIGIT.sub("0", text[-8:])
        out = [*_end_slots(kind, ends, fences, bool(followed))]
        out += _continued(_WORDS, _suffixes(tokens))
        out += _form_slots(seen, ends, item, min(items, 3), opened > 0, left_open, sentence.count('"') % 2, struct, min(n, 20))
        out.append(slot(f"t:first{' '.join(inside[:2])}{ends}{min(n, 16) // 2}"))
        out += _rest_slots(not _SENTENCE.search(text), ends, min(n, 8), text.endswith("```"), fences, raw != text)
        out += _continued(_SHAPES, _suffixes(shaped))
        out += _continued(_TAILS, [tail[-k:] for k in range(1, 9)])
        out.append(slot(f"t:whole{ends}:" + " ".join(bare) if whole else "t:whole"))
        out.append(slot(f"t:line{' '.join(line[:3])}{ends}{item}"))
        return out


_LISTED, _EVERY_LISTED, _LIST_MARK = re.compile(r"\s*(?:[-*•+]|\d+[.)])\s"), re.compile(r"(?m)^\s*(?:[-*•+]|\d+[.)])\s"), re.compile(r"[-*•+.)]\s")
_BRACKET, _OPENING = re.compile(r"[(\[{“«„「『《（【)\]}”»」』》）】]"), re.compile(r"[(\[{«「『《（【]")


@lru_cache(100_000)
def _copy_slots(p: int, r: int, b: int, k: int, ratio: int, echo: bool, n: int) -> list[int]:
    out = [f"c:p{p}", f"c:r{r}", f"c:b{b}", f"c:k{k}", f"c:pr{p}.{r}", f"c:bk{b}.{k}", f"c:min{min(p, r)}", f"c:minb{min(b, k)}", f"c:ratio{ratio}", f"c:echo{echo}", f"c:echomin{echo}{min(p, r)}", f"c:n{n}"]
    return slots(out)


@lru_cache(100_000)
def _language_slots(inside: int, other: int, fifth: int, half: bool, told: int, sure: int, asked: bool) -> list[int]:
    out = [f"l:in{inside}", f"l:out{other}", f"l:half{half}", f"l:told{told}", f"l:outtold{fifth}.{told}", f"l:sure{sure}.{half}", f"l:asked{asked}.{half}"]
    return slots(out)


@lru_cache(100)
def _length_slot(n: int) -> int:
    return slot(f"r:len{n}")


#: One fact beside dozens of n-grams needs several slots to weigh as much as they do together.
FOLLOWED_SLOTS = 8
#: CRCs with which the names of the last words, of their shapes and of the last characters begin.
_WORDS, _SHAPES, _TAILS = ([zlib.crc32(f"t:{kind}{k}:".encode()) for k in range(1, most)] for kind, most in (("w", 7), ("s", 7), ("c", 9)))
_DIGIT, _OPENED, _CLOSED = re.compile(r"\d"), re.compile(r"[(\[{“«„「『《（【]"), re.compile(r"[)\]}”»「」』》）】“]")
_PAIRS = ("()", "[]", "{}", "«»", "「」", "『』", "《》", "（）", "【】")


@lru_cache(10_000)
def _end_slots(kind: str, ends: bool, fences: bool, followed: bool) -> tuple[int, ...]:
    return tuple(slots([f"t:end{kind}", f"t:ends{ends}", f"t:fence{fences}"] + ([f"t:followed{k}" for k in range(FOLLOWED_SLOTS)] if followed else [])))


@lru_cache(100_000)
def _form_slots(seen: str, ends: bool, item: bool, items: int, opened: bool, left_open: bool, quotes: int, struct: str, n: int) -> tuple[int, ...]:
    return tuple(slots([f"t:seen{seen}", f"t:seenends{seen}{ends}", f"t:item{item}{items}{ends}", f"t:open{opened}{ends}", f"t:left{left_open}{ends}", f"t:quote{quotes}{ends}", f"t:struct{struct}", f"t:n{n}{ends}"]))


@lru_cache(10_000)
def _rest_slots(only: bool, ends: bool, n: int, closed: bool, fences: bool, space: bool) -> tuple[int, ...]:
    return tuple(slots([f"t:only{only}{ends}{n}", f"t:closed{closed}{fences}", f"t:space{space}"]))


def _suffixes(tokens: list[str]) -> list[str]:
    """The last token, the last two, .. and all of them."""
    out: list[str] = []
    for t in reversed(tokens):
        out.append(f"{t} {out[-1]}" if out else t)
    return out


def _first_tokens(text: str, n: int = 3) -> list[str]:
    if text.isascii():
        return [m[0] for m in islice(_TOKEN.finditer(_DIGITS.sub("0", text.lower())), n)]
    return ["0" if m[0][0].isdigit() else m[0] for m in islice(_TOKEN.finditer(text.lower()), n)]


_TERMINALS, _CLOSING = frozenset(".!?…。！？｡।॥؟۔"), "\"”»“’)]』」》）】*_`"


def _last_tokens(text: str) -> list[str]:
    """At least the last six tokens of a text, if it has so many."""
    size = 40
    while True:
        pieces = _TOKEN.findall(text[-size:])
        # The first token may be cut off by the window.
        if len(pieces) > 6 or size >= len(text):
            return pieces
        size *= 4


def _last_sentence(text: str) -> str:
    """What follows the last sentence end of the whole text."""
    size = 400
    while True:
        parts = _SENTENCE.split(text[-size:])
        if len(parts) > 1 or size >= len(text):
            return parts[-1]
        size *= 4


_MANY = re.compile(r"(?s)(?:[^\w]*[^\W_]){25}")
_FULL = [slot("e:n12"), slot("e:len10"), slot("e:tagFalse")]
_HOLDERS = frozenset(re.findall(r"\([^)]*\)|\[[^\]]*\]|\{+[^}]*\}+|<[^>]*>|（[^）]*）|\S+", PLACEHOLDERS)) | {"no response", "no answer"}
_HOLDERS_INNER = frozenset(x.strip("\"'`*_.-–—:;!?()[]{}<>（）【】 \n\t") for x in _HOLDERS if x not in ("no", "response", "none", "na", "nan", "无")) | {"n/a", "null"}


def _code_free(text: str) -> str:
    return re.sub(r"`[^`\n]*`", " ", re.sub(r"(?s)```.*?(?:```|\Z)", " ", text))


class Linear:
    """Logistic regression over hashed binary features, fitted by AdaGrad."""

    def __init__(self):
        self.w, self.b, self.threshold = np.zeros(SIZE, np.float32), 0.0, 0.5

    @staticmethod
    def pack(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(r) for r in rows], np.int64)
        return np.concatenate(rows) if rows else np.empty(0, np.int32), np.concatenate([[0], np.cumsum(lengths)])

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        return self.packed_margins(*self.pack(rows))

    def packed_margins(self, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(self.w[flat], dtype=np.float64)])
        n = np.maximum(1, np.diff(ends))
        return (sums[ends[1:]] - sums[ends[:-1]]) / np.sqrt(n) + self.b

    def probabilities(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(rows), -30, 30)))

    def fit(self, rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, seed: int, epochs: int = 6, rate: float = 0.5) -> "Linear":
        rng = np.random.default_rng(seed)
        flat, ends = self.pack(rows)
        lengths = np.diff(ends)
        g2, gb = np.full(SIZE, 1e-3, np.float32), 1e-3
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), 64):
                pick = order[at : at + 64]
                n = lengths[pick]
                where = np.repeat(ends[pick] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                idx, row = flat[where], np.repeat(np.arange(len(pick)), n)
                scale = 1 / np.sqrt(np.maximum(1, n))
                z = np.bincount(row, weights=self.w[idx], minlength=len(pick)) * scale + self.b
                err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) * weight[pick]
                used, inverse = np.unique(idx, return_inverse=True)
                grad = np.bincount(inverse, weights=(err * scale)[row], minlength=len(used)).astype(np.float32) + 1e-4 * self.w[used]
                g2[used] += grad**2
                self.w[used] -= rate * grad / np.sqrt(g2[used])
                gb += float(err.sum()) ** 2
                self.b -= rate * float(err.sum()) / math.sqrt(gb)
        return self

    def calibrate(self, rows: list[np.ndarray], y: np.ndarray, prior: float = 0.04) -> None:
        """Threshold of the best F1 if a share ``prior`` of all entries had the defect."""
        p = self.probabilities(rows)
        pos, neg = p[y > 0.5], p[y < 0.5]
        best, at = -1.0, []
        for t in np.linspace(0.05, 0.99, 95):
            tp, fp = prior * (pos >= t).mean(), (1 - prior) * (neg >= t).mean()
            f1 = 2 * tp / max(1e-9, tp + fp + prior)
            if f1 > best + 1e-6:
                best, at = f1, [t]
            elif f1 > best - 1e-6:
                at.append(t)
        self.threshold = float(np.median(at))


#: Stops that end no sentence: of a list number, of an abbreviation, and inside a number or a name.
_INNER_STOP = re.compile(r"(?m)^[^\S\n]*\d{1,3}[.](?=[^\S\n]+\S)|(?<=\w)\.(?=[^\S\n]+[a-zß-ÿа-яё])|\b(?:Dr|Mr|Mrs|Ms|Prof|St|Nr|No|Fig|Sr|Sra|vs|bzw|[а-я])\.(?=[^\S\n]+\S)|(?<=\w)\.(?=\w)")


def _cut(text: str, rng: np.random.Generator) -> str | None:
    """A response broken off somewhere inside, not at a sentence end."""
    n = len(text)
    if rng.random() < 0.1:
        stops = [m.end() for m in _INNER_STOP.finditer(text) if m.end() > max(3, n // 5) and n - m.end() > 1]
        if stops:
            return text[: stops[int(rng.integers(len(stops)))]]
    if rng.random() < (0.15 if n >= 25 else 0.5):
        marks = [m.end() for m in re.finditer(r"[(\[{“«„「『（,;:+*/=<>–—]", text) if m.end() > max(3, n // 5) and n - m.end() > 1]
        if marks:
            return text[: marks[int(rng.integers(len(marks)))]]
    if n < 25:
        return None
    for _ in range(8):
        at = int(rng.integers(max(8, int(n * 0.25)), n - 2))
        if rng.random() < 0.65 and not _DENSE.search(text[max(0, at - 5) : at + 5]):
            space = text.rfind(" ", 0, at)
            at = space if space > 8 else at
        head = text[:at].rstrip()
        if len(head) > 6 and not _TERMINAL.search(head) and head != text.rstrip(" .!?。！？।") and len(text) - len(head) > 3 and not text[len(head) :].lstrip().startswith(("- ", "* ", "```")):
            return head
    return None


def _broken_off(text: str | None) -> bool:
    """Whether the form alone says that a text breaks off: such responses are no counter-examples."""
    t = (text or "").rstrip()
    if not t:
        return False
    if t.count("```") % 2 or t[-1] in "([{“«„「『（《,;+/=<&|" and not t.endswith(("<3",)):
        return True
    return t[-1] in "*-" and len(t) > 3 and t[-2] in " \n"


def _copied(prompt: str, rng: np.random.Generator) -> str:
    p = prompt.strip()
    forms = [
        lambda: p, lambda: p, lambda: p.lower(), lambda: p.upper(), lambda: "> " + p, lambda: f'"{p}"', lambda: "Question: " + p, lambda: "Prompt: " + p, lambda: "User: " + p,
        lambda: p + "\n" + p, lambda: p + " " + p, lambda: p.rstrip(".?!。？！"), lambda: f"**{p}**", lambda: "You asked: " + p, lambda: re.sub(r"[^\w\s]", "", p), lambda: p + "\n\n",
        lambda: "\n".join([p] * int(rng.integers(3, 8))), lambda: " ".join([p] * int(rng.integers(3, 8))), lambda: f"<prompt>{p}</prompt>", lambda: f"```\n{p}\n```", lambda: "Q: " + p + "\nA:",
    ]
    out = forms[int(rng.integers(len(forms)))]()
    words = out.split(" ")
    if len(words) > 5 and rng.random() < 0.35:
        i = int(rng.integers(len(words)))
        how = rng.random()
        if how < 0.4:
            words.pop(i)
        elif how < 0.7 and i + 1 < len(words):
            words[i], words[i + 1] = words[i + 1], words[i]
        else:
            words[i] = words[i][:-1] + words[i][-2:-1] if len(words[i]) > 3 else words[i] + " " + words[i]
        out = " ".join(words)
    return out


def _emptied(rng: np.random.Generator) -> str:
    holders = sorted(_HOLDERS - {"no", "response", "answer", "here", "text", "无", "none", "na", "nan"})
    fillers = ["", " ", "\n", "\t \n", "​", "\xa0", "...", "…", "-", "--", "---", "–", "—", ".", "_", "***", '""', "''", "``", "```\n```", "{}", "[]", "()", "<>", "?", "!", "•", "*", "/", "\\", "﻿", "​\n", "……", "。", "#", "##", "> "]
    tags = ["answer", "think", "response", "output", "p", "br", "div", "final", "result", "solution", "reasoning", "assistant"]
    labels = [x for x in LABELS.split("|") if len(x) > 1]
    kind = rng.random()
    if kind < 0.35:
        return fillers[int(rng.integers(len(fillers)))]
    if kind < 0.55:
        t = tags[int(rng.integers(len(tags)))]
        return [f"<{t}></{t}>", f"<{t}>\n</{t}>\n", f"<{t}>", f"</{t}>", f"<{t}> </{t}>", f"<think></think><{t}></{t}>"][int(rng.integers(6))]
    if kind < 0.75:
        x = labels[int(rng.integers(len(labels)))]
        x = [x.capitalize(), x, x.upper(), f"**{x.capitalize()}"][int(rng.integers(4))]
        return x + [":", "：", ":\n", ": ", ":**", ": ...", ": -"][int(rng.integers(7))]
    h = holders[int(rng.integers(len(holders)))]
    return [h, h.upper(), h.capitalize(), h + "\n", h + "."][int(rng.integers(5))]


def _short(rng: np.random.Generator) -> str:
    """Whole answers of a word or two, which no defect applies to."""
    n = int(rng.integers(0, 1000))
    kinds = [str(n), f"{n}.", f"{n / 10}", f"Final answer: {n}", "Yes", "No", "Yes.", "No.", "yes", "no", f"({'ABCDE'[n % 5]})", "ABCDE"[n % 5], f"{'ABCDE'[n % 5]}.", f"Answer: {n}", f"The answer is {n}", "None of them.", "None", "True", "False", "0", f"\\boxed{{{n}}}", f"The answer is \\boxed{{{n}}}", f"{n} + 1 = {n + 1}", "Ja", "Nein.", "Oui", "Non.", "Sí", "Да", "Нет.", "是", "不是。", "はい", "いいえ。", f"Answer: {'ABCDE'[n % 5]}", f"{n}%", "Paris", "OK", "Maybe."]
    return kinds[int(rng.integers(len(kinds)))]


def _extract(features: Features, jobs: list[tuple], spark: SparkSession | None) -> list[dict[str, np.ndarray]]:
    """Features of (defect or none for all, prompt, text, followed), in the order of the jobs."""
    kinds = lambda d: (d,) if d else DEFECTS
    if spark is None or not jobs:
        return [{k: features.one(k, p, t, x) for k in kinds(d)} for d, p, t, x in jobs]
    shared = spark.sparkContext.broadcast(features)
    columns = list(zip(*jobs))
    names, types = ("defect", "prompt", "text", "followed"), (pa.string(), pa.string(), pa.string(), pa.bool_())
    table = pa.table([pa.array(range(len(jobs)), pa.int64()), *(pa.array(c, t) for c, t in zip(columns, types))], names=["at", *names])

    def run(batches):
        for batch in batches:
            rows = [(at, k, shared.value.one(k, p, t, x)) for at, d, p, t, x in zip(*(c.to_pylist() for c in batch.columns)) for k in kinds(d)]
            at, defect, slots = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(defect, pa.string()), pa.array(slots, pa.list_(pa.int32()))], names=["at", "defect", "slots"])

    found = spark.createDataFrame(table).repartition(max(1, min(64, len(jobs) // 400))).mapInArrow(run, "at bigint, defect string, slots array<int>").toArrow()
    out: list[dict[str, np.ndarray]] = [{} for _ in jobs]
    for batch in found.to_batches():
        for at, d, slots in zip(batch["at"].to_pylist(), batch["defect"].to_pylist(), batch["slots"]):
            out[at][d] = np.asarray(slots.values)
    return out


def train(sample: list[tuple[str, list[str | None]]], labelled: list[tuple[str, str]], followed: list[list[bool]] | None = None, seed: int = 7, spark: SparkSession | None = None) -> tuple[Features, dict[str, Linear]]:
    """Features and one calibrated model for each defect, from sampled prompts with their responses
    and from texts with a known language. ``followed`` says of each response whether its last line is
    a list item after which others go on. The same input gives the same models. With a session the
    features of the examples are computed by its executors."""
    rng = np.random.default_rng(seed)
    languages = Languages(labelled)
    whole = Counter()
    for _, outputs in sample:
        for t in outputs:
            if t:
                # The last word of a text may be cut off and doesn't count as known.
                whole.update(w.lower() for w in set(re.findall(r"[^\W\d_]+(?=[^\w])", t)))
    for t, _ in labelled:
        whole.update(w.lower() for w in set(re.findall(r"[^\W\d_]+(?=[^\w])", t)))
    features = Features(languages, frozenset(w for w, n in whole.items() if n >= 2))
    natural = [(p, t) for p, outputs in sample for t in outputs]
    goes_on = [x for flags in followed for x in flags] if followed else [False] * len(natural)
    by_lang: dict[str, list[str]] = {}
    for p, t in natural:
        if t and len(t) > 30:
            found, n = languages.shares(_code_free(plain(t)))
            if n >= 20 and max(found.values()) > 0.9 * n:
                by_lang.setdefault(max(found, key=found.get), []).append(t)
    bad = {d: np.zeros(len(natural), bool) for d in DEFECTS}
    nfeats = _extract(features, [(None, p, t, x) for (p, t), x in zip(natural, goes_on)], spark)
    decline = refusals(rng, 4000)
    models: dict[str, Linear] = {}
    good = [i for i in range(len(natural)) if natural[i][1]]
    prompts = [p for p, _ in natural if p]
    made: dict[str, list[tuple[str, str]]] = {d: [] for d in DEFECTS}
    extra: list[tuple[str, str]] = []
    origin: list[int] = []
    for i in rng.permutation(good):
        p, t = natural[i]
        if (c := _cut(t, rng)) is not None:
            made["truncated"].append((p, c))
        if rng.random() < 0.5 and _TERMINAL.search(t.rstrip()):
            # Whole but unpunctuated.
            extra.append((p, t.rstrip().rstrip(".!?。！？।\"”»")))
            origin.append(i)
        if rng.random() < 0.15:
            parts = [x for x in _SENTENCE.split(t) if x and len(x) > 8]
            if len(parts) > 2:
                k = int(rng.integers(len(parts) - 1))
                extra.append((p, parts[k].rstrip(".!?。！？।") if rng.random() < 0.5 else parts[k]))
                origin.append(i)
    for p in (prompts[int(rng.integers(len(prompts)))] for _ in range(3000)) if prompts else ():
        if not _ECHO.search(p):
            made["copy"].append((p, _copied(p, rng)))
        own, n = languages.shares(plain(p))
        others = [x for x in by_lang if x not in own and x not in _asked(p)]
        if n >= 8 and others:
            o = by_lang[others[int(rng.integers(len(others)))]]
            made["language"].append((p, o[int(rng.integers(len(o)))]))
    some = lambda: prompts[int(rng.integers(len(prompts)))] if prompts else ""
    made["refusal"] = [(some(), text) for text in decline]
    for _ in range(1500):
        made["empty"].append((some(), _emptied(rng)))
        extra.append((some(), _short(rng)))
    origin += [-1] * (len(extra) - len(origin))
    others = {d: [x for o in ("refusal", "copy") if o != d for x in made[o][:1500]] if d in ("truncated", "refusal") else [] for d in DEFECTS}
    jobs = [(None, p, t, False) for p, t in extra] + [(d, p, t, False) for part in (made, others) for d in DEFECTS for p, t in part[d]]
    feats = iter(_extract(features, jobs, spark))
    extra_feats = [next(feats) for _ in extra]
    made_feats, others = ({d: [next(feats)[d] for _ in part[d]] for d in DEFECTS} for part in (made, others))
    doubtful = {d: np.zeros(len(natural), bool) for d in DEFECTS}
    cut_off = np.array([_broken_off(t) for _, t in natural], bool)
    # The sample's own responses hold broken ones: a short first fit only finds which are doubtful,
    # later fits leave those out, and the surest refusals become examples themselves.
    for turn, epochs in enumerate((1, 4, 6)):
        anybad = np.any([bad[d] for d in DEFECTS], axis=0)
        for k, d in enumerate(DEFECTS):
            pos = list(made_feats[d])
            if turn == 2 and d == "refusal":
                pos += [nfeats[i][d] for i in np.flatnonzero(bad[d])] * 2
            leave = (doubtful[d] if turn == 1 else bad[d] | anybad) | cut_off
            neg = [nfeats[i][d] for i in range(len(natural)) if not leave[i]] + [f[d] for f, i in zip(extra_feats, origin) if i < 0 or not leave[i]] + others[d]
            rows = pos + neg
            if not pos or not neg:
                models[d] = Linear()
                models[d].threshold = 2.0
                continue
            y = np.array([1.0] * len(pos) + [0.0] * len(neg))
            weight = np.where(y > 0, 0.5 * len(rows) / len(pos), 0.5 * len(rows) / len(neg)).clip(0.2, 5)
            held = np.random.default_rng(seed + k).random(len(rows)) < 0.2
            pick = lambda m: [r for r, x in zip(rows, m) if x]
            models[d] = Linear().fit(pick(~held), y[~held], weight[~held], seed + k, epochs)
            models[d].calibrate(pick(held), y[held])
            p = models[d].probabilities([f[d] for f in nfeats])
            if turn == 0:
                doubtful[d] = p >= 0.08
            else:
                bad[d] = p >= max(0.5, min(models[d].threshold, 0.9))
    return features, models


def classify(features: Features, models: dict[str, Linear], pairs: list[tuple], followed: list[bool] | None = None) -> list[str | None]:
    """The defect of each pair, or none. An entry gets the defect whose model is surest."""
    if not pairs:
        return []
    packed = features.many(pairs, followed)
    scores = np.stack([models[d].packed_margins(*packed[d]) - math.log(models[d].threshold / (1 - models[d].threshold)) if models[d].threshold < 1 else np.full(len(pairs), -1.0) for d in DEFECTS])
    best = scores.argmax(axis=0)
    return [("empty" if scores[0, i] >= 0 else DEFECTS[best[i]]) if scores[:, i].max() >= 0 else None for i in range(len(pairs))]


def save(fitted: tuple[Features, dict[str, Linear]], spark: SparkSession, path: str) -> None:
    """Writes fitted models, as plain numbers and words, to a table."""
    features, models = fitted
    lang = features.languages
    rows = [("word", w, 0, None) for w in sorted(features.known)] + [("language", x, i, None) for i, x in enumerate(lang.langs)] + [("score", w, 0, [float(x) for x in v]) for w, v in sorted(lang.scores.items())]
    for d, m in models.items():
        at = np.flatnonzero(m.w)
        rows += [("weight", d, int(i), [float(m.w[i])]) for i in at] + [("model", d, 0, [float(m.b), float(m.threshold)])]
    spark.createDataFrame(rows, "kind string, name string, place int, numbers array<double>").coalesce(1).write.parquet(path)


def load(spark: SparkSession, path: str) -> tuple[Features, dict[str, Linear]]:
    """Models written by ``save``."""
    rows = spark.read.parquet(path).collect()
    languages = Languages([])
    languages.langs = [r["name"] for r in sorted((r for r in rows if r["kind"] == "language"), key=lambda r: r["place"])]
    languages.scores = {r["name"]: list(r["numbers"]) for r in rows if r["kind"] == "score"}
    models = {d: Linear() for d in DEFECTS}
    for r in rows:
        if r["kind"] == "weight":
            models[r["name"]].w[r["place"]] = r["numbers"][0]
        elif r["kind"] == "model":
            models[r["name"]].b, models[r["name"]].threshold = r["numbers"]
    return Features(languages, frozenset(r["name"] for r in rows if r["kind"] == "word")), models


_ITEM = r"(?:[-*•+]|[0-9]+[.)])[ \t\x0B\f]+[^\s]"


def _item_key(line: Column) -> Column:
    """Hash of a list item without its mark, with digits alike; null if the line is none."""
    rest = F.regexp_replace(F.regexp_replace(line, r"^\s*(?:[-*•+]|[0-9]+[.)])\s+", ""), "[0-9]+", "0")
    return F.when(line.rlike(r"^\s*" + _ITEM), F.xxhash64(F.lower(F.trim(F.regexp_replace(rest, r"\s+", " ")))))


_BLANKS = " \t\n\x0b\x0c"


def _unified(text: Column) -> Column:
    """The text without white space at its end, lines ended by line feeds only."""
    return F.rtrim(F.replace(text, F.lit("\r"), F.lit("\n")), F.lit(_BLANKS))


def entries_of(completions: DataFrame) -> DataFrame:
    """gen_id, text, outputs (texts) and for each output ``last``: the key of its last line if that is a list item."""
    texts = F.transform("outputs", lambda o: o["text"])
    source = completions.where("gen_id is not null and outputs is not null").select("gen_id", "text", texts.alias("outputs"))
    return source.withColumn("last", F.transform("outputs", lambda t: _item_key(F.substring_index(_unified(t), "\n", -1))))


def followed_items(entries: DataFrame) -> DataFrame:
    """Keys of the list items that another line follows at least twice, over all responses."""
    texts = entries.select(F.explode("outputs").alias("t")).where(F.col("t").contains("\n") | F.col("t").contains("\r")).select(F.split(_unified(F.col("t")), "\n").alias("lines"))
    lines = texts.select(F.explode(F.slice("lines", F.lit(1), F.greatest(F.size("lines") - 1, F.lit(0)))).alias("line"))
    keys = lines.where(F.col("line").rlike(r"^\s*" + _ITEM)).select(_item_key(F.col("line")).alias("key"))
    return keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")


def with_followed(entries: DataFrame, items: DataFrame, salts: int = 16) -> DataFrame:
    """The entries whose ``last`` holds a key, with ``followed``: the keys that are among ``items``.

    Only keys and ids meet the items; a hot key is spread over ``salts``.
    """
    asked = entries.select("gen_id", F.explode("last").alias("key")).where("key is not null").distinct().withColumn("salt", F.pmod(F.hash("gen_id"), F.lit(salts)))
    known = items.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    flags = asked.join(known, ["key", "salt"]).groupBy("gen_id").agg(F.collect_set("key").alias("followed"))
    return entries.join(flags, "gen_id", "left")


def fit(completions: DataFrame, labelled: DataFrame, items: DataFrame | None = None) -> tuple[Features, dict[str, Linear]]:
    """Models fitted on at most SAMPLE_PROMPTS prompts and SAMPLE_LABELLED labelled examples of at most
    SAMPLE_CHARS characters each, drawn by a hash of their ids."""
    entries = entries_of(completions)
    items = followed_items(entries) if items is None else items
    small = F.coalesce(F.length("text"), F.lit(0)) + F.aggregate("outputs", F.lit(0), lambda n, t: n + F.coalesce(F.length(t), F.lit(0))) <= SAMPLE_CHARS
    # Repeats have the same hash, so they lie side by side and are told apart after the top-n.
    drawn = with_followed(entries.where(small).orderBy(F.xxhash64("gen_id"), "gen_id").limit(SAMPLE_PROMPTS + SAMPLE_PROMPTS // 10), items)
    unique = {r["gen_id"]: r for r in reversed(drawn.orderBy(F.xxhash64("gen_id"), "gen_id", "text").collect())}
    chosen = list(unique.values())[-SAMPLE_PROMPTS:]
    sample = [(r["text"] or "", list(r["outputs"])) for r in chosen]
    followed = [[k is not None and k in (r["followed"] or ()) for k in r["last"]] for r in chosen]
    known = labelled.where("row_id is not null and messages is not null").select("row_id", lang_key(F.col("lang")).alias("lang"), F.array_join(F.transform("messages", lambda m: m["content"]), "\n").alias("text"))
    known = [(r["text"], r["lang"]) for r in known.where(f"lang != 'und' and text != '' and length(text) <= {SAMPLE_CHARS}").orderBy(F.xxhash64("row_id"), "row_id").limit(SAMPLE_LABELLED).collect()]
    return train(sample, known, followed, spark=completions.sparkSession)


def find_defects(completions: DataFrame, labelled: DataFrame, fitted: tuple[Features, dict[str, Linear]] | None = None) -> DataFrame:
    """One row (gen_id, output_no, defect) for each broken entry of ``outputs``.

    * A null entry, a null or blank text is ``empty``; a null or empty list has no entries; a row
      delivered several times gives one row an entry; rows without gen_id are dropped.
    * ``finish_reason`` isn't used: the text decides.
    * The models are ``fitted`` before (see ``fit``, ``save`` and ``load``) or fitted now on a bounded
      sample. Every entry is classified where it is read; only rows with a response that ends in a
      list item are joined, with what all responses tell about that item.
    """
    entries = entries_of(completions)
    items = cut(followed_items(entries))
    shared = completions.sparkSession.sparkContext.broadcast(fitted or fit(completions, labelled, items))
    kind = dict(entries.dtypes)["gen_id"]

    def run(batches):
        features, models = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                keys, prompts, outputs, last, followed = (part.column(c).to_pylist() for c in ("gen_id", "text", "outputs", "last", "followed"))
                where = [(k, j) for k, o in zip(keys, outputs) for j in range(len(o))]
                flags = [k is not None and k in (known or ()) for ks, known in zip(last, followed) for k in ks]
                found = classify(features, models, [(p, t) for p, o in zip(prompts, outputs) for t in o], flags)
                rows = [(k, j, d) for (k, j), d in zip(where, found) if d]
                c = list(zip(*rows)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c[0], batch.schema.field("gen_id").type), pa.array(c[1], pa.int64()), pa.array(c[2], pa.string())], names=["gen_id", "output_no", "defect"])

    listed = F.exists("last", lambda k: k.isNotNull())
    plainly = entries.where(~listed).withColumn("followed", F.lit(None).cast("array<bigint>"))
    both = plainly.unionByName(with_followed(entries.where(listed), items))
    found = both.mapInArrow(run, f"gen_id {kind}, output_no bigint, defect string")
    # Deliveries of one entry are alike; if they weren't, the first defect by name would stand.
    return found.groupBy("gen_id", "output_no").agg(F.min("defect").alias("defect"))
