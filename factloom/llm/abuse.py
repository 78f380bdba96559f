"""Scores for abusive, hateful and sexual content.

A word of a text is folded (case, accents, look-alike letters, invisible characters, letters
set apart) and its Levenshtein automaton is run over the lexicon's trie: digits and signs
stand for the letters they imitate or hide, doubled letters cost nothing, swapped
neighbours cost one, other errors are allowed in long words only. Hits alone are not abuse: the roles of
the words in a window around them score them. A hit weighs when it meets a person it is said to or of, an act meets one who does
it and one who suffers it, a group meets what shuts it out; it loses weight when it is quoted, denied, reported or said of a
thing. Evidence adds up as independent odds, so scores are graded and rank for review.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import lexicon
from factloom.session import spread_out

#: Score from which a text counts as abusive.
THRESHOLD = 0.7

#: Distinct words and sentences kept per worker with what was found in them; bounds on memory only.
KEPT_WORDS = 200_000
KEPT_SENTENCES = 100_000

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans("аеорсухіјѕкмтнвгԁԛɡαοερτικν", "aeopcyxijskmthbrdqgaoeptikv", "")
#: Letters that digits and signs imitate.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "$": "s", "@": "a", "!": "i", "|": "il", "€": "e", "+": "t"}
#: Signs that hide any letter.
HIDERS = frozenset("*@#_%&?!$")

_APART = re.compile(r"(?<![\w])(?:[^\W_](?:([.\-_·*~|/])[^\W_])(?:\1[^\W_]){1,}|[^\W\d_](?: [^\W\d_]){2,})(?![\w])")
_WORD = re.compile(r"[\w*@#$€%!|+]+")
_SENTENCE = re.compile(r"(?<=[.!?。！？])1?\s+|\n+|[\U0001F300-\U0001FAFF]+")
_TAIL = re.compile(r"[!?]+1*$")


def fold(text: str) -> str:
    """Lower case without accents and invisible characters, in Latin look-alikes."""
    text = unicodedata.normalize("NFKD", text.casefold().replace("ß", "ss"))
    text = "".join(c for c in text if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    return text.translate(LOOKALIKES)


class Trie:
    def __init__(self, words: dict[str, str]):
        """words: word to class names joined by a space."""
        self.root: dict = {}
        for word, classes in words.items():
            node = self.root
            for c in word:
                node = node.setdefault(c, {})
            node[""] = (word, classes)


def _same(sign: str, letter: str) -> bool:
    return sign == letter or letter in LEET.get(sign, "") or sign in HIDERS


def allowance(word: str) -> int:
    """Errors allowed in a term: swaps, doublings and missing vowels cost less than other errors in short words."""
    return 0 if len(word) < 4 else 2


def _costs(length: int) -> int:
    """Cost of a wrong, missing or extra letter; a swap costs 2 in any term of four letters or more, a vowel left out after the first letter in any of five or more."""
    return 2 if length >= 8 else 3


def matches(word: str, trie: Trie) -> list[tuple[str, str]]:
    """Terms of the trie within reach of the word: its Levenshtein automaton, run along the trie.

    A state of the automaton is a row: the cost of having read each prefix of the word. A branch is left
    when no cost in its row is within reach.
    """
    n, found = len(word), []
    hidden, digits = sum(c in HIDERS for c in word), sum(c in LEET for c in word)
    if n < 3 or hidden * 2 > n or digits == n:
        return found
    step = _costs(n)
    doubled = [i > 0 and word[i] == word[i - 1] for i in range(n)]
    first = [0]
    for i in range(n):
        first.append(first[-1] + step)

    def walk(node: dict, row: list[int], before: list[int] | None, last: str) -> None:
        end = node.get("")
        if end and row[n] <= allowance(end[0]) and (row[n] == 0 or n >= len(end[0]) or len(end[0]) >= 5):
            found.append((row[n], end))
        for letter, child in node.items():
            if not letter:
                continue
            left_out = 2 if last and letter in "aeiou" else step
            new = [row[0] + step]
            for i in range(1, n + 1):
                sign = word[i - 1]
                best = min(row[i - 1] + (0 if _same(sign, letter) else step), row[i] + left_out, new[i - 1] + (0 if doubled[i - 1] else step))
                if before is not None and i > 1 and word[i - 2] == letter and sign == last and letter != last:
                    best = min(best, before[i - 2] + 2)
                new.append(best)
            if min(new) <= 2 or min(row) == 0:  # a swap may still bring the next row within reach
                walk(child, new, row, letter)

    walk(trie.root, first, None, "")
    if not found:
        return []
    least = min(cost for cost, _ in found)
    if least and digits + hidden > n - 2:
        return []
    return [end for cost, end in found if cost == least]


@lru_cache(maxsize=1)
def _lexicon() -> tuple[Trie, dict[str, frozenset[str]], list, frozenset[str]]:
    terms: dict[str, set[str]] = {}
    for name, words in lexicon.TERMS.items():
        for w in words.split():
            terms.setdefault(w, set()).add(name)
    plain: dict[str, set[str]] = {w: set(c) for w, c in terms.items()}
    for name, words in lexicon.ROLES.items():
        for w in words.split():
            plain.setdefault(w, set()).add(name)
    idioms = []
    for kind, weight, words in lexicon.IDIOMS:
        parts = [(6 if part.startswith("~") else 2, frozenset(part.removeprefix("~").split("|"))) for part in words.split()]
        idioms.append((kind, weight, parts))
        for _, options in parts:
            for w in options:
                if not w.startswith("@"):
                    plain.setdefault(w, set())
    return Trie({w: " ".join(sorted(c)) for w, c in terms.items()}), {w: frozenset(c) for w, c in plain.items()}, idioms, frozenset(lexicon.NOT_TERMS)


#: Roles without which nothing in a sentence is evidence, and idioms' first words.
_WEIGHTY = frozenset(lexicon.TERMS) | {"death", "hurt", "nude", "amb_act", "animal", "degrade", "group", "groupword", "exclude", "breed"}
_known: dict[str, tuple[str, frozenset[str]]] = {}


def labels_of(word: str) -> tuple[str, frozenset[str]]:
    """A folded word without hiding signs, and its labels: itself or the terms it disguises, and their roles with ``@``."""
    got = _known.get(word)
    if got is None:
        trie, plain, _, not_terms = _lexicon()
        bare = _TAIL.sub("", word).strip("!?*#%&|+")
        if bare in plain:
            out = {bare} | {f"@{c}" for c in plain[bare]}
        elif bare in not_terms or bare.isdigit():
            out = {bare}
        else:
            out = {bare}
            for term, _ in matches(_TAIL.sub("", word), trie):
                out |= {term, "~"} | {f"@{c}" for c in plain[term]}
        if len(_known) >= KEPT_WORDS:
            _known.clear()
        got = _known[word] = (bare, frozenset(out))
    return got


@lru_cache(maxsize=1)
def _openers() -> frozenset[str]:
    return frozenset(o for _, _, parts in _lexicon()[2] for o in parts[0][1])


class Found(NamedTuple):
    """What a sentence shows by itself, and what it may show together with its neighbours."""

    score: float
    kind: str
    #: An insult that nobody is named for yet, and whether a person or a reader is named.
    open_insult: bool
    names_someone: bool


_EMPTY = Found(0.0, "", False, False)
_QUOTED = re.compile(r"(?:(?<=\s)|(?<=^)|(?<=[(:,]))[\"'“„«‘»]([^\"“”„«»\n]{3,160}?)[\"'”“»’«](?=[\s.,;:!?)]|$)")


class Sentence:
    """The words of a sentence by role, and the tests of distance between roles."""

    def __init__(self, words: list[str], labels: list[frozenset[str]], quoted: list[bool]):
        self.words, self.labels, self.quoted, self.n = words, labels, quoted, len(words)
        self.at: dict[str, list[int]] = {}
        for i, ls in enumerate(labels):
            for x in ls:
                self.at.setdefault(x, []).append(i)
        self.evidence: list[tuple[float, str]] = []

    def has(self, *names: str) -> bool:
        return any(n in self.at for n in names)

    def spots(self, *names: str) -> list[int]:
        return sorted({i for n in names for i in self.at.get(n, ())})

    def near(self, i: int, names: tuple[str, ...], before: int, after: int) -> list[int]:
        """Places of these roles from so many words before ``i`` to so many after it, ``i`` left out."""
        return [j for n in names for j in self.at.get(n, ()) if i - before <= j <= i + after and j != i]

    def doubt(self, kind: str, i: int, fixed: bool = False) -> float:
        """What is left of a hit's weight where it stands: 1, or less if it is quoted, reported, denied or said of a thing."""
        left = 1.0
        if self.quoted[i] and self.has("@media", "@reports"):
            left *= 0.3
        elif self.near(i, ("@media",), 10, 3):
            left *= 0.5
        if any(j < i for j in self.near(i, ("@reports",), 6, 0)) and self.near(i, ("@me",), 6, 2):
            left *= 0.5
        if fixed:
            return left * (0.75 if kind == "threat" and self.near(i, ("@thing",), 0, 8) else 1.0)
        if self.near(i, ("@thing",), 3, 3):
            left *= 0.5
        if self.near(i, ("@negation",), 2, 0):
            left *= 0.6
        return left

    def add(self, kind: str, weight: float, i: int, fixed: bool = False) -> None:
        self.evidence.append((weight * self.doubt(kind, i, fixed), kind))

    def idiom(self, parts: list[tuple[int, frozenset[str]]]) -> int | None:
        """Place of the first word of an idiom if its parts stand in order with small gaps."""
        for start in self.spots(*parts[0][1]):
            i = start
            for gap, options in parts[1:]:
                i = next((j for j in range(i + 1, min(self.n, i + 2 + gap)) if not options.isdisjoint(self.labels[j])), None)
                if i is None:
                    break
            else:
                return start
        return None

    def agent_before(self, i: int) -> bool:
        """Whether someone acts: an agent before the verb and no thing between them or as the subject."""
        before = [j for j in self.spots("@agent", "@hope") if i - 9 <= j < i]
        return bool(before) and not any(max(before) < j < i for j in self.spots("@thing"))


def _insults(s: Sentence) -> None:
    someone = ("@you", "@person", "@group")
    hits = s.spots("@insult")
    for i in hits:
        if s.near(i, ("@you",), 8, 8) or s.near(i, ("@person", "@group"), 10, 10):
            s.add("insult", 0.92, i)
        elif any(0 < abs(j - i) <= 4 and s.words[j] != s.words[i] for j in hits):
            s.add("insult", 0.85, i)
        elif s.near(i, ("@they",), 4, 4) and s.near(i, ("@degrade", "@copula", "@curse"), 3, 1):
            s.add("insult", 0.8, i)
        else:
            s.add("insult", 0.5, i)
    for i in s.spots("@animal", "@beast"):
        if s.near(i, ("@degrade", "@curse", "@insult"), 3, 2) and s.near(i, someone, 6, 5):
            s.add("insult", 0.85, i)
    marks = s.spots("@degrade")
    if len(marks) >= 2 and s.has("@person", "@you") and s.near(marks[0], ("@copula",), 4, 4):
        s.add("insult", 0.55, marks[0])
    for i in s.spots("@curse"):
        if s.near(i, ("@you",), 1, 2) and s.near(i, ("@insult", "@degrade", "@animal"), 3, 4):
            s.add("curse", 0.85, i)
        elif s.near(i, ("@person",), 4, 4) and s.near(i, ("@copula", "@degrade"), 3, 3):
            s.add("insult", 0.55, i)


def _threats(s: Sentence) -> None:
    victim = ("@you", "@they", "@person", "@group")
    for i in s.spots("@kill"):
        if i + 1 < s.n and s.words[i + 1] == "for":
            continue
        fused = s.words[i].endswith(("arte", "aros", "arlos", "aremos"))
        if (fused or s.near(i, victim, 5, 5)) and (s.agent_before(i) or fused) and not s.near(i, ("@insect_killer",), 4, 6):
            s.add("threat", 0.92, i)
        elif s.near(i, ("@group",), 8, 3):
            s.add("hate", 0.9, i)
        elif s.near(i, ("@you", "@they"), 0, 2) and not s.has("@thing"):
            s.add("threat", 0.75, i)
    for i in s.spots("@hurt"):
        part = s.near(i, ("@bodypart",), 4, 5)
        fused = s.words[i].endswith(("ros", "rte"))
        if part and (s.near(i, ("@you", "@they", "@person"), 8, 4) or fused) and (s.agent_before(i) or fused):
            s.add("threat", 0.92, i)
        elif s.agent_before(i) and s.near(i, ("@you", "@person"), 3, 3) and s.near(i, ("@death", "tot", "up", "kaputt"), 0, 4):
            s.add("threat", 0.92, i)
    for i in s.spots("@hope"):
        hits = [j for j in s.near(i, ("@death", "@kill"), 0, 10)]
        if hits and s.near(i, ("@you", "@they", "@person", "@group", "@insult"), 3, 10):
            s.add("threat", 0.9 if s.words[i] not in ("que", "qu") else 0.5, hits[0])
        elif s.near(i, ("@hurt",), 0, 4) and s.near(i, ("@bodypart",), 0, 8) and s.near(i, ("@you", "@they", "@person"), 6, 6):
            s.add("threat", 0.9, i)
        elif s.near(i, ("loses", "lose", "pierda", "perd"), 0, 5) and s.near(i, ("everything", "todo", "tout", "alles"), 0, 7):
            s.add("threat", 0.8, i)


def _hate(s: Sentence) -> None:
    named = [i for i in s.spots("@groupword") if s.near(i, ("people", "folks", "men", "women", "leute", "menschen", "gens", "gente"), 0, 1)]
    for i in [*s.spots("@group"), *named]:
        if s.words[i] == "sort" and not s.near(i, ("@they", "@you"), 1, 0):
            continue
        if s.near(i, ("@beast", "@insult"), 10, 12):
            s.add("hate", 0.9, i, True)
        if s.near(i, ("@exclude",), 9, 11):
            s.add("hate", 0.85, i, True)
        if s.near(i, ("@breed",), 3, 8):
            s.add("hate", 0.85, i, True)
        if s.near(i, ("@negation",), 2, 12) and s.near(i, ("@humans", "@place"), 0, 14):
            s.add("hate", 0.85, i, True)
        if s.near(i, ("@hurt",), 4, 8) and s.near(i, ("@place", "down", "all", "alle", "tous", "todos", "laden", "them"), 4, 10):
            s.add("hate", 0.8, i, True)
        if s.near(i, ("@inblood",), 0, 12):
            s.add("hate", 0.85, i, True)
        if len(s.near(i, ("@degrade",), 6, 8)) >= 2:
            s.add("hate", 0.85, i)
        if s.near(i, ("rot", "rots", "pudre", "verdirbt", "pourrit", "ruin"), 0, 6):
            s.add("hate", 0.8, i, True)
        if s.near(i, ("want", "quiero", "will", "veux", "let", "never", "never-let"), 5, 0) and s.near(i, ("@negation",), 6, 0) and s.near(i, ("answering", "near", "here", "touch", "home", "country", "back"), 0, 10):
            s.add("hate", 0.8, i, True)
        if s.near(i, ("send", "schickt", "renvoyez"), 3, 12) and s.near(i, ("@home", "back"), 0, 14):
            s.add("hate", 0.85, i, True)


def _sexual(s: Sentence) -> None:
    people = ("@agent", "@you", "@they", "@me", "@partner", "@person")
    for i in s.spots("@act"):
        if s.near(i, ("@partner",), 8, 8) or s.near(i, ("@intimate",), 6, 8) or s.near(i, ("@nude", "@sexpart", "@porn", "@horny"), 8, 8):
            s.add("sexual", 0.88, i)
        elif s.labels[i].isdisjoint({"@curse"}) and (s.near(i, people, 4, 4) or s.near(i, ("beim", "while", "pendant", "al", "a", "zum", "to"), 2, 1)):
            s.add("sexual", 0.8, i)
    for i in s.spots("@amb_act"):
        if s.near(i, ("@sexpart", "@nude", "@horny", "@porn", "@act"), 8, 8):
            s.add("sexual", 0.88, i)
        elif len(s.near(i, ("@intimate",), 7, 8)) >= 2 and s.near(i, ("@agent", "@they", "@me", "@partner"), 6, 4) and not s.near(i, ("@thing", "missing"), 2, 2):
            s.add("sexual", 0.8, i)
        elif s.near(i, ("best",), 2, 0) and s.near(i, ("life", "night"), 0, 4):
            s.add("sexual", 0.75, i)
        elif s.near(i, ("@partner",), 4, 4) and s.near(i, ("@ask", "tonight", "soir"), 6, 6):
            s.add("sexual", 0.85, i)
    for i in s.spots("@sexpart"):
        if s.near(i, ("@ask", "@act", "@amb_act", "@nude", "@horny"), 8, 8):
            s.add("sexual", 0.85, i)
        elif s.near(i, ("her", "his", "your", "my", "tes", "ses", "ta", "sa", "ihre", "deine", "tus", "sus", "tu", "su"), 3, 0) and (s.near(i, ("@intimate",), 0, 8) or s.labels[i] & {"boobs", "tits", "titten", "tetas", "nichons", "pussy", "dick"}):
            s.add("sexual", 0.8, i)
    for i in s.spots("@nude"):
        if s.near(i, ("@ask",), 7, 6) and s.near(i, ("@me", "@you", "@they", "body", "pics", "photos", "fotos", "partner"), 7, 6):
            s.add("sexual", 0.88, i)
        elif s.near(i, ("@amb_act", "@act", "@sexpart", "@horny"), 9, 9):
            s.add("sexual", 0.88, i)
        elif s.near(i, ("@agent", "we"), 5, 1) and s.near(i, ("@intimate",), 3, 5) and not s.near(i, ("eye", "eyes", "pared", "mur", "wand"), 0, 3):
            s.add("sexual", 0.72, i)
    for i in s.spots("@porn"):
        if "panties" in s.labels[i] or s.near(i, ("@partner", "@ask", "@agent", "@me", "@you"), 9, 9):
            s.add("sexual", 0.85, i)
        else:
            s.add("sexual", 0.55, i)
    for i in s.spots("@horny"):
        if s.near(i, ("@agent", "@me", "@you", "estoy", "bin", "suis", "am"), 4, 4):
            s.add("sexual", 0.85, i)
    if s.near(0, ("without", "ohne", "sans", "sin"), 0, s.n) and s.has("clothes", "panties", "kleider", "vetements", "ropa") and s.has("@ask", "@sexpart"):
        s.add("sexual", 0.85, s.spots("clothes", "panties", "kleider", "vetements", "ropa")[0])


def _sentence(text: str) -> Found:
    """Evidence of one sentence."""
    folded = _APART.sub(lambda m: re.sub(r"[.\-_·*~|/ ]", "", m[0]), fold(text))
    pairs = [labels_of(w) for w in _WORD.findall(folded)]
    labels = [ls for _, ls in pairs]
    every = frozenset().union(*labels)
    names = not every.isdisjoint(("@you", "@person", "@group"))
    weighty = any(x[1:] in _WEIGHTY for x in every if x[:1] == "@")
    if not weighty and every.isdisjoint(_openers()):
        return Found(0.0, "", False, names)
    quoted = [False] * len(pairs)
    for m in _QUOTED.finditer(folded):
        first, size = len(_WORD.findall(folded[: m.start(1)])), len(_WORD.findall(m[1]))
        quoted[first : first + size] = [True] * min(size, len(quoted) - first)
    s = Sentence([w for w, _ in pairs], labels, quoted)
    for kind, weight, parts in _lexicon()[2]:
        if not parts[0][1].isdisjoint(every) and all(not options.isdisjoint(every) for _, options in parts[1:]):
            at = s.idiom(parts)
            if at is not None:
                s.add(kind, weight, at, True)
    if weighty:
        _insults(s)
        _threats(s)
        _hate(s)
        _sexual(s)
    if not s.evidence:
        return Found(0.0, "", False, names)
    none = 1.0
    best: dict[str, float] = {}
    for weight, kind in s.evidence:
        best[kind] = max(best.get(kind, 0.0), weight)
    for weight in best.values():
        none *= 1 - weight
    top = max(best, key=best.get)
    bare = best.get("insult", 0.0) >= 0.5 and best[top] < THRESHOLD
    return Found(1 - none if best[top] >= 0.5 else best[top], top, bare, names)


_kept: dict[str, Found] = {}


def score(text: str | None) -> tuple[float, str]:
    """(score, kind): the strongest sentence, with a little more for each further one; 0 for null and empty texts.

    An insult that names nobody counts when the sentence before or after it names a person or the reader.
    """
    if not text:
        return 0.0, ""
    found = []
    for part in _SENTENCE.split(text):
        got = _kept.get(part)
        if got is None:
            got = _sentence(part) if part and not part.isspace() else _EMPTY
            if len(_kept) >= KEPT_SENTENCES:
                _kept.clear()
            _kept[part] = got
        if got is not _EMPTY:
            found.append(got)
    top = max(found, key=lambda f: f.score, default=_EMPTY)
    best, kind = top.score, top.kind
    for a, b in zip(found, found[1:]):
        if a.open_insult and b.names_someone or b.open_insult and a.names_someone:
            if best < 0.8:
                best, kind = 0.8, "insult"
    more = sum(f.score >= THRESHOLD for f in found) - 1
    if more > 0:
        best = 1 - (1 - best) / (1 + more)
    return round(best, 4), kind if best >= THRESHOLD else ""


def scores(documents: DataFrame) -> DataFrame:
    """doc_id, source, score and kind of every row; null and empty texts score 0. No shuffle.

    Only text counts; it is read whole. Repeated rows come out repeated, other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [score(t if isinstance(t, str) else None) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "source": batch["source"], "score": [s for s, _ in got], "kind": [k for _, k in got]})

    return spread_out(documents.select("doc_id", "source", "text")).mapInPandas(run, "doc_id bigint, source string, score double, kind string")


def abuse_rates(scored: DataFrame) -> DataFrame:
    """Documents, abusive ones and their rate per source (trimmed, lower case; null and empty stay together as null)."""
    name = F.nullif(F.lower(F.trim("source")), F.lit(""))
    return scored.groupBy(name.alias("source")).agg(
        F.count(F.lit(1)).alias("n_documents"),
        F.count_if(F.col("score") >= THRESHOLD).alias("n_abusive"),
        F.round(F.count_if(F.col("score") >= THRESHOLD) / F.count(F.lit(1)), 6).alias("abuse_rate"),
    )
