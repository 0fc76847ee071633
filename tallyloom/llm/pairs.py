"""Broken prompt and response pairs: the one thing that makes a reply useless, if any.

A reply is compared with its question by a suffix automaton of the prompt (stem and choices, squashed to
letters and digits): walking the reply through it gives the longest match that ends at each character, and
so the share of the reply that is the prompt's own text. Refusals are found by an automaton over words
(failure links, as in Aho and Corasick), outside quotations. Languages are voted for by stopwords, outside
quotations, too, for the reply and the question. A stack of delimiters tells replies that end inside a
quotation; they count as cut, beside the replies that ``truncation`` finds.

Defined results: the first that applies of empty (reason), refusal, other_language, copies_question,
truncated, empty (option); replies without a question have no other_language and no copies_question; a
question whose language gets no vote has no other_language; of repeated questions the smallest item counts.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.truncation import cut_texts
from tallyloom.session import cut as cut_lineage

HOT, MOST_HOT = 100_000, 50_000
MIN_MATCH = 8
MIN_COVERED, MAX_GAP, MAX_END = 0.85, 26, 14
#: each window of MIN_MATCH characters holds a whole piece, as _PIECE + _STEP - 1 characters are no more than that
_PIECE = MIN_MATCH // 2
_STEP = MIN_MATCH - _PIECE + 1

LEAD_IN = r"(?:\d+\s*[.):]\s*)?(?:reason(?:ing)?|explanation|rationale|answer|response|question|you asked|motivo|explicaci[oó]n)\s*[:–—-]+\s*"
PLACEHOLDERS = [
    "n/a", "na", "n.a.", "nan", "none", "null", "nil", "tbd", "todo", "unknown", "empty", "blank", "no text", "no result", "no answer", "no response", "no reason",
    "no comment", "missing", "undefined", "not available", "not applicable",
]
REFUSALS = [
    "i decline", "i must decline", "must decline to answer", "have to decline", "request declined", "i cannot comply", "i can't comply", "unable to comply", "can't help there",
    "i can't help with", "i cannot help with", "i can't assist", "i cannot assist", "unable to assist", "unable to answer", "unable to help", "unable to provide an answer",
    "am not able to choose", "am not able to answer", "am not able to help", "not be able to answer", "won't be able to", "no answer can be provided", "i can't answer", "i cannot answer",
    "cannot give legal advice", "can't give legal advice", "cannot provide legal advice", "against my policy", "against my guidelines", "outside what i may discuss", "inappropriate for me to",
    "i'd rather not", "rather not select", "prefer not to answer", "have to pass on this", "don't have enough information to respond", "do not have enough information to respond",
    "no comment on this", "restricted for me", "content not available for", "something i can't do", "something i cannot do", "i won't answer", "i will not answer", "i refuse to",
    "no puedo responder", "no puedo ofrecer", "no puedo ayudar", "no puedo contestar", "no me es posible", "prefiero no contestar", "prefiero no responder", "no debo elegir", "no debo responder",
    "je ne peux pas répondre", "je ne suis pas en mesure", "ich kann nicht antworten", "ich kann diese frage nicht", "não posso responder", "não posso ajudar",
]
STOPWORDS = {
    "en": "the of and to a in is that for it on was with as by at an be this which from or not are but have who when what how does by under one only if its has had were then than once before after",
    "es": "el la los las de que y en un una por con para se del al es no como más pero su sus según cuánto qué quién cuál fue era porque está entre cuando hasta desde tiene debe sin sobre tras ante también",
    "fr": "le la les de des du et en un une est que qui dans pour par sur ne pas au aux avec ce cette il elle à été était selon où jusqu son sa ses plus",
    "de": "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über wurde weil früher nach außerdem jeden dieser",
    "pt": "o a os as de que e do da em um uma para com não por mais dos das como mas foi ao ele se na no nos nas tem seu sua ou ser quando muito há está também já pelo pela até após porque dentro",
}
_LANGUAGE_OF = {}
for _lang, _list in STOPWORDS.items():
    for _w in _list.split():
        _LANGUAGE_OF.setdefault(_w, []).append(_lang)
_QUOTED = re.compile(r"“[^”]*(?:”|$)|«[^»]*(?:»|$)|(?<!\w)\"[^\"]*\"")
_WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_LEAD = re.compile(rf"\A\W*{LEAD_IN}", re.IGNORECASE)
GOOD_OPTIONS = frozenset("ABCD")
_BARE = {re.sub(r"[\W_]+", "", p) for p in PLACEHOLDERS}


class SuffixAutomaton:
    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, last = [-1], [0], 0
        for c in text:
            here = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = here
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                if self.length[q] == self.length[p] + 1:
                    self.link[here] = q
                else:
                    twin = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = twin
                        p = self.link[p]
                    self.link[q] = self.link[here] = twin
            last = here

    def covered(self, text: str, least: int) -> list[bool]:
        """Which characters of the text lie in a match of ``least`` characters or more."""
        state = matched = 0
        inside = [False] * len(text)
        for i, c in enumerate(text):
            while state and c not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if c in self.next[state]:
                state, matched = self.next[state][c], matched + 1
            if matched == least:
                inside[i - least + 1 : i + 1] = [True] * least
            elif matched > least:
                inside[i] = True
        return inside


class PhraseAutomaton:
    """Finds any of the phrases in a list of words."""

    def __init__(self, phrases: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.final, self.fail = [False], [0]
        # Words without any phrase's longest word hold no phrase.
        self.needed = frozenset(max(phrase.split(), key=len) for phrase in phrases)
        for phrase in phrases:
            state = 0
            for w in phrase.split():
                if w not in self.next[state]:
                    self.next.append({})
                    self.final.append(False)
                    self.fail.append(0)
                    self.next[state][w] = len(self.next) - 1
                state = self.next[state][w]
            self.final[state] = True
        queue = deque(self.next[0].values())
        while queue:
            state = queue.popleft()
            for w, child in self.next[state].items():
                back = self.fail[state]
                while back and w not in self.next[back]:
                    back = self.fail[back]
                self.fail[child] = self.next[back].get(w, 0)
                self.final[child] |= self.final[self.fail[child]]
                queue.append(child)

    def found(self, words: list[str]) -> bool:
        if self.needed.isdisjoint(words):
            return False
        state = 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.fail[state]
            state = self.next[state].get(w, 0)
            if self.final[state]:
                return True
        return False


_NO_LETTER = re.compile(r"[\W_]+")
# ASCII characters are told apart by tables of bytes, which take a fraction of an expression's time.
_NO_ASCII_LETTER = bytes(c for c in range(128) if chr(c) not in "abcdefghijklmnopqrstuvwxyz0123456789")
_BLANKED = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz'" or c > 127 else 32 for c in range(256))
# More letters and digits than any placeholder word has.
_LONGER = re.compile(rf"(?:[\W_]*+[^\W_]){{{max(map(len, _BARE)) + 1}}}")


def squashed(text: str) -> str:
    return _squash(text.lower())


def _squash(lower: str) -> str:
    return lower.encode().translate(None, _NO_ASCII_LETTER).decode() if lower.isascii() else _NO_LETTER.sub("", lower)


def without_lead(text: str) -> str:
    while (shorter := _LEAD.sub("", text, count=1)) != text:
        text = shorter
    return text


def is_unusable(text: str | None) -> bool:
    """Null, blank, invisible, bare marks, a lead-in alone, or a placeholder word."""
    if text is None:
        return True
    core = without_lead(text + " ")
    if _LONGER.match(core):
        return False
    core = squashed(core)
    return not core or core in _BARE


def spoken_words(text: str) -> list[str]:
    text = text.lower()
    if "“" in text or '"' in text or "«" in text:
        text = _QUOTED.sub(" ", text)
    text = text.replace("’", "'")
    pieces = text.encode("utf-8", "surrogatepass").translate(_BLANKED).decode("utf-8", "surrogatepass").split()
    if "'" not in text and text.isascii():
        return pieces
    return [w for piece in pieces for w in ((piece,) if "'" not in piece and piece.isascii() else _WORDS.findall(piece))]


def language(words: list[str]) -> str | None:
    """The language with the most stopwords, if it has two or more and more than any other; Cyrillic text without any is ru."""
    votes: dict[str, int] = {}
    for langs in filter(None, map(_LANGUAGE_OF.get, words)):
        for lang in langs:
            votes[lang] = votes.get(lang, 0) + 1
    if not votes:
        return "ru" if sum("а" <= w[0] <= "я" for w in words) * 2 > len(words) else None
    best = max(votes, key=votes.__getitem__)
    return best if votes[best] >= 2 and list(votes.values()).count(votes[best]) == 1 else None


def may_copy(lower: str, source: str) -> bool:
    """False only where the automaton would find too long a gap at the end or at the beginning of a reply in lower case.

    Both tests are bounds: a covered character lies in a window of MIN_MATCH characters that stands in the source,
    and one of the last MAX_END + 1 as well as of the first MAX_GAP + 1 characters must be covered.
    """
    least = MAX_END + MIN_MATCH
    end = _squash(lower[-4 * least :])
    if len(end) < least and len(lower) > 4 * least:
        end = _squash(lower)
    if not _shares(end[-least:], source):
        return False
    least = MAX_GAP + MIN_MATCH
    start = _squash(lower[: 4 * least])
    if len(start) < least and len(lower) > 4 * least:
        start = _squash(lower)
    return _shares(start[:least], source)


def _shares(part: str, source: str) -> bool:
    """Whether any MIN_MATCH characters of ``part`` stand in the source.

    Every such window holds a whole piece of _PIECE characters out of those at each _STEP, so windows are only looked at around a piece that is there.
    """
    most, seen = len(part) - MIN_MATCH, 0
    for at in range(0, len(part) - _PIECE + 1, _STEP):
        if part[at : at + _PIECE] in source:
            last = min(at, most)
            for i in range(max(seen, at + _PIECE - MIN_MATCH), last + 1):
                if part[i : i + MIN_MATCH] in source:
                    return True
            seen = last + 1
    return False


def is_copy(core: str, automaton: SuffixAutomaton) -> bool:
    """The squashed reply holds nothing but the squashed prompt's own text, with small changes."""
    if len(core) < MIN_MATCH:
        return False
    inside = automaton.covered(core, MIN_MATCH)
    gap = most = 0
    for x in inside:
        gap = 0 if x else gap + 1
        most = max(most, gap)
    # What stands uncovered at the end is not a change of form but an answer that begins.
    return sum(inside) >= MIN_COVERED * len(inside) and most <= MAX_GAP and gap <= MAX_END


_OPENS = {"”": "“", "»": "«", ")": "(", "]": "["}
_MARKS = re.compile(r"[“”«»()\[\]\"]")
_SENTENCE_END = re.compile(r"[.!?]\s")


def ends_inside(text: str) -> bool:
    """The stack of delimiters still holds an opening mark at the end; closing marks without an opening one do not count.

    A straight quotation mark opens after a blank or a bracket, and closes after anything but a digit (inches). A
    bracket or a straight quotation mark only counts within the sentence that it opens in, for both also stand alone.
    """
    stack: list[tuple[str, int]] = []
    for m in _MARKS.finditer(text):
        c, before = m.group(), text[m.start() - 1 : m.start()]
        if c == '"':
            opens = before in " \t\r\n(["  # or nothing
            closes = None if opens or before.isdigit() else c
        else:
            closes = _OPENS.get(c)
            opens = closes is None
        at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == closes), None) if closes else None
        if at is not None:
            del stack[at:]  # what was opened inside and never closed ends with it
        elif opens:
            stack.append((c, m.end()))
    return any(c in "“«" or not _SENTENCE_END.search(text, at) for c, at in stack)


class Kept(dict):
    """What ``make`` gives for each key, kept for the last ``most`` keys; plain data, so that it travels with the function."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        self[key] = value = self.make(key)
        return value


def _posed(prompt: str) -> tuple[str, str | None]:
    """A question's squashed text and language."""
    return squashed(prompt), language(spoken_words(prompt))


def defects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    refusal = PhraseAutomaton(REFUSALS)
    # Replies arrive sorted by question, so each question is prepared about once.
    posed, automata = Kept(_posed, 4096), Kept(SuffixAutomaton, 64)
    for batch in batches:
        out = []
        for reason, prompt in zip(batch["reason"], batch["prompt"], strict=True):
            core = without_lead(reason or "")
            if not _LONGER.match(core) and is_unusable(reason):
                out.append("empty")
                continue
            words = spoken_words(core)
            source, asked = posed[prompt] if prompt else ("", None)
            if refusal.found(words):
                out.append("refusal")
            elif asked and (spoken := language(words)) and spoken != asked:
                out.append("other_language")
            elif source and may_copy(lower := core.lower(), source):
                out.append("copies_question" if is_copy(_squash(lower), automata[source]) else "truncated" if ends_inside(reason) else None)
            else:
                out.append("truncated" if ends_inside(reason) else None)
        bad = [not (o is not None and o in GOOD_OPTIONS) and is_unusable(o) for o in batch["option"]]
        yield pd.DataFrame({"pred_id": batch["pred_id"], "option_bad": bad, "defect": out})


def _values(choices: Column) -> Column:
    return F.filter(F.map_values(choices), lambda v: v.isNotNull())


def broken(option: DataFrame, answer: DataFrame, questions: DataFrame) -> DataFrame:
    """pred_id, defect of the replies of ``option`` runs; ``answer`` runs add to the statistics of cut replies."""
    keys = ["corpus", "question_number"]
    first = questions.groupBy(*keys).agg(F.min_by(F.struct("stem", _values(F.col("choices")).alias("choices")), "item_id").alias("q"))
    prompt = F.concat_ws("\n", F.coalesce("q.stem", F.lit("")), F.coalesce("q.choices", F.array().cast("array<string>")))
    replied = option.select("pred_id", *keys, "option", "reason")
    asked = first.select(*keys, prompt.alias("prompt"))
    # A question with more than HOT replies is spread over several tasks, each with its prompt; at most rows / HOT questions are.
    hot = cut_lineage(replied.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > HOT).select(*keys, F.ceil(F.col("n") / HOT).cast("int").alias("parts")))
    if (n_hot := hot.count()) > 0:
        spread = F.broadcast(hot) if n_hot <= MOST_HOT else hot
        replied = replied.join(spread, keys, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("pred_id"), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
        asked = asked.join(spread, keys, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        keys = [*keys, "part"]
    posed = replied.join(asked, keys, "left").select("pred_id", "option", "reason", "prompt")
    kind = option.schema["pred_id"].dataType.simpleString()
    judged = posed.mapInPandas(defects, f"pred_id {kind}, option_bad boolean, defect string")
    texts = option.select("pred_id", "reason", F.lit(True).alias("judged")).unionByName(answer.select("pred_id", "reason", F.lit(False).alias("judged")))
    cut = cut_texts(texts, "pred_id", "reason", "judged").select("pred_id", F.lit("truncated").alias("cut")).distinct()
    return (
        judged.join(cut, "pred_id", "left")
        .select("pred_id", F.coalesce("defect", "cut", F.when(F.col("option_bad"), "empty")).alias("defect"))
        .where("defect is not null").distinct()
    )
