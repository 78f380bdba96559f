"""Which language a file is in, its tokens, and its verdict by derivatives."""

from __future__ import annotations

import io
import re
import tokenize
from functools import lru_cache
from typing import NamedTuple

import regex

from factloom.llm import grammars as G
from factloom.llm.derivatives import Grammar, Language

#: Extension to language.
LANGUAGES = {".ts": "typescript", ".mts": "typescript", ".tsx": "tsx", ".js": "javascript", ".mjs": "javascript", ".jsx": "jsx", ".json": "json", ".py": "python"}


class Verdict(NamedTuple):
    valid: bool
    #: "truncated" if the text ends where more must follow, "token" for a token that can't stand there, "" if valid.
    failure: str
    #: Character offset of the failing token, -1 if valid.
    offset: int
    token: str


VALID = Verdict(True, "", -1, "")

_TRIVIA = re.compile(r"(?:[\s﻿]+|//[^\n\r  ]*|/\*[\s\S]*?\*/)*")
_NEW_LINE = re.compile(r"[\n\r  ]")
_TOKEN = regex.compile(
    r"""(?P<word>(?:[\p{ID_Start}$_]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\p{ID_Continue}$‌‍]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*+)
    |(?P<NUM>(?:0[xX][0-9a-fA-F]+(?:_[0-9a-fA-F]+)*+n?|0[oO][0-7]+(?:_[0-7]+)*+n?|0[bB][01]+(?:_[01]+)*+n?
      |(?:[0-9]+(?:_[0-9]+)*+n|(?:[0-9]+(?:_[0-9]+)*+(?:\.(?:[0-9]+(?:_[0-9]+)*+)?)?|\.[0-9]+(?:_[0-9]+)*+)(?:[eE][+-]?[0-9]+(?:_[0-9]+)*+)?))(?![\p{ID_Start}$_0-9]))
    |(?P<STR>"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*+"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*+')
    |(?P<PRIVATE>\#[\p{ID_Start}$_][\p{ID_Continue}$]*+)
    |(?P<tick>`(?:[^`\\$]|\\[\s\S]|\$(?!\{))*+(?:`|\$\{))
    |(?P<OPTCHAIN>\?\.(?![0-9]))
    |(?P<ASSIGN>\*\*=|&&=|\|\|=|\?\?=|<<=|\+=|-=|\*=|/=|%=|&=|\|=|\^=)
    |(?P<LOGIC>&&|\|\|)
    |(?P<NULLISH>\?\?)
    |(?P<POW>\*\*)
    |(?P<BINARY>===|!==|==|!=|<=|<<|%|\^)
    |(?P<INC>\+\+|--)
    |(?P<TILDE>~)
    |(?P<punct>\.\.\.|=>|[{}()\[\];,<>+\-*/|&!?:=.@])""",
    regex.VERBOSE,
)
_CONTINUED = re.compile(r"\}(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)")
_REGEX = regex.compile(r"/(?![*/])(?:[^/\\\[\n\r  ]|\\[^\n\r  ]|\[(?:[^\]\\\n\r  ]|\\[^\n\r  ])*+\])++/[\p{ID_Continue}$]*+")
_JSX_TEXT = re.compile(r"[^{}<>]+")
_JSX_STRING = re.compile(r"\"[^\"]*\"|'[^']*'")
_JSX_NAME = regex.compile(r"[\p{ID_Start}$_][\p{ID_Continue}$]*+(?:-[\p{ID_Continue}$]*+)++")
_HASHBANG = re.compile(r"#![^\n\r  ]*")
_JSON_TOKEN = re.compile(r"[ \t\n\r]*(?:(?P<STR>\"(?:[^\"\\\x00-\x1f]|\\(?:[\"\\/bfnrt]|u[0-9a-fA-F]{4}))*\")|(?P<NUM>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)(?![\w.])|(?P<word>true|false|null)(?!\w)|(?P<punct>[{}\[\],:]))")
_JSON_SPACE = re.compile(r"[ \t\n\r]*")


@lru_cache(maxsize=None)
def grammar(language: str) -> Grammar:
    if language == "json":
        return Grammar(G.JSON, "document")
    if language == "python":
        return Grammar(G.PYTHON, "file", {"NAME": G.NAME})
    text = G.script_grammar(language in ("typescript", "tsx"), language in ("tsx", "jsx"))
    return Grammar(text, "program", {"ID": G.ID, "WORD": G.WORD, "ATTRIBUTE": G.ATTRIBUTE}, insert="ASI", closers=frozenset(["}", "EOF"]))


_WORDS = {w: w for w in G.RESERVED | G.CONTEXTUAL}


#: Tokens in plain ASCII after blanks, line ends and line comments, which are nearly all; groups: 1 line ends, 2 word, 3 punctuation that goes
#: no further, 4 the equals sign, 5 arrow, 6 dot, 7 string, 8 number, 9 and 10 operators. What it doesn't match is left to the full patterns.
_FAST_TEXT = (
    r"[ ]*((?://[^\n\r\u2028\u2029]*)?\n[ \n]*(?://[^\n\r\u2028\u2029]*\n[ \n]*)*)?"
    r"(?:([A-Za-z_$][A-Za-z0-9_$]*+)(?![^\x00-\x7f]|\\%s)|([()\[\]{};,:>@]|<(?![<=])|[+](?![+=])|-(?![-=])|\*(?![*=])|!(?!=)|\?(?![.?])|\|(?![|=])|&(?![&=]))"
    r"|(=)(?![=>])|(=>)|(\.)(?![.0-9])|%s|([0-9]++)(?![.\w$]|[^\x00-\x7f])|(&&|\|\|)(?!=)|(===|!==))"
)
_FAST = re.compile(_FAST_TEXT % ("", r"(\"[^\"\\\n\r]*\"|'[^'\\\n\r]*')"))
#: The same inside tags, where names may hold hyphens and strings are others.
_FAST_TAG = re.compile(_FAST_TEXT % ("|-", r"(\Zx)"))
_FAST_KIND = (None, None, None, None, "=", "=>", ".", "STR", "NUM", "LOGIC", "BINARY")
_TEXT, _TEMPLATE, _QUOTED, _NAME, _DIVIDES, _OPERAND = 1, 2, 4, 8, 16, 32


def _mode(g: Grammar, lang: Language) -> int:
    may = g.first(lang)
    lang.mode = (
        (_TEXT if "JSXTEXT" in may else 0)
        | (_TEMPLATE if "TMID" in may or "TTAIL" in may else 0)
        | (_QUOTED if "JSXSTR" in may else 0)
        | (_NAME if "JSXNAME" in may else 0)
        | (_DIVIDES if "/" in may else 0)
        | (_OPERAND if "NUM" in may and "<" in may else 0)
    )
    return lang.mode


@lru_cache(maxsize=4096)
def regex_is_sound(literal: str) -> bool:
    """Whether a regular expression literal has closed groups, something to repeat before each sign of repetition, and flags that exist."""
    body, _, flags = literal[1:].rpartition("/")
    if len(set(flags)) != len(flags) or not set(flags) <= set("dgimsuvy"):
        return False
    depth, may_repeat, i = 0, False, 0
    while i < len(body):
        c = body[i]
        if c == "\\":
            i += 2
            may_repeat = True
            continue
        if c == "[":
            i += 1
            while i < len(body) and body[i] != "]":
                i += 2 if body[i] == "\\" else 1
            may_repeat = True
        elif c == "(":
            depth, may_repeat = depth + 1, False
            if m := re.match(r"\?(?::|=|!|<=|<!|<[^>]*>|[ims]*-?[ims]*:)", body[i + 1 :]):
                i += m.end()
            elif body[i + 1 : i + 2] == "?":
                return False
        elif c == ")":
            depth, may_repeat = depth - 1, True
            if depth < 0:
                return False
        elif c in "*+?":
            if not may_repeat:
                return False
            if body[i + 1 : i + 2] == "?":
                i += 1
            may_repeat = False
        elif c == "{" and (m := re.match(r"\{\d+(,\d*)?\}\??", body[i:])):
            if not may_repeat:
                return False
            i += m.end() - 1
            may_repeat = False
        else:
            may_repeat = c not in "|^"
        i += 1
    return depth == 0


class _Elements:
    """Names of the elements that are open, so that a closing tag must name the one it closes.

    The language says that a closing tag comes; which name it must bear no grammar of finite size can say.
    """

    _CLOSES = regex.compile(r"<(?:\s|/\*.*?\*/)*/(?:\s)*([\p{ID_Start}$_][\p{ID_Continue}$\-.:]*+)?", regex.DOTALL)
    _OPENS = regex.compile(r"<\s*([\p{ID_Start}$_][\p{ID_Continue}$\-.:]*+)?")

    def __init__(self):
        self.stack: list[list] = []  # [name, confirmed, angle brackets of types] or a brace
        self.closing = False

    def angle(self, text: str, pos: int, mode: int) -> bool:
        """At ``<``; false if a closing tag names another element."""
        top = self.stack[-1] if self.stack else None
        if mode & (_TEXT | _OPERAND):
            m = self._CLOSES.match(text, pos)
            if m:
                self.closing = True
                if top and top[0] != "{" and top[1]:
                    self.stack.pop()
                    return top[0] == (m[1] or "")
                return True
            self.stack.append([self._OPENS.match(text, pos)[1] or "", False, 0])
        elif top and top[0] != "{" and not top[1]:
            top[2] += 1
        return True

    def end(self, before: str, text_follows: bool) -> None:
        """At ``>``: it ends a closing tag, a list of types, an element without children or an opening tag."""
        top = self.stack[-1] if self.stack else None
        if self.closing:
            self.closing = False
        elif top and top[0] != "{" and not top[1]:
            if top[2]:
                top[2] -= 1
            elif before == "/" or not text_follows:
                self.stack.pop()
            else:
                top[1] = True

    def brace(self, opens: bool) -> None:
        if opens:
            self.stack.append(["{"])
        else:
            while self.stack and self.stack[-1][0] != "{":
                self.stack.pop()
            if self.stack:
                self.stack.pop()


def _script(text: str, language: str) -> Verdict:
    """Tokens are cut as the language reached so far demands: a slash begins a regular expression only
    where an operand may stand and no operator may, a brace goes on with a template only inside one."""
    g = grammar(language)
    derive, empty, fast, fast_tag, words, fast_kind = g.derive, g.empty, _FAST.match, _FAST_TAG.match, _WORDS.get, _FAST_KIND
    elements = _Elements() if language in ("tsx", "jsx") else None
    lang, pos, size, before = g.start, 1 if text.startswith("\ufeff") else 0, len(text), ""
    if m := _HASHBANG.match(text, pos):
        lang, pos = derive(lang, "HASHBANG"), m.end()
    count = 0
    while True:
        mode = lang.mode
        if mode is None:
            mode = _mode(g, lang)
            count += 1
            if count % 1000 == 0 and (kept := g.trim(lang)) is not lang:
                lang, empty = kept, g.empty
                mode = _mode(g, lang)
        m = fast(text, pos) if not mode & 15 else None if mode & 3 else fast_tag(text, pos)
        if m is not None:
            k, end = m.lastindex, m.end()
            kind = words(m[2], "IDENT") if k == 2 else m[3] if k == 3 else fast_kind[k]
            new_line = m.start(1) >= 0
            found = (lang.by_kind_nl if new_line else lang.by_kind).get(kind)
            if found is None:
                found = derive(lang, kind, new_line)
            if found is empty:
                return Verdict(False, "token", m.start(k), text[m.start(k) : min(end, m.start(k) + 40)])
            if elements is not None and k == 3 and kind in "{}<>":
                if kind == "<":
                    if not elements.angle(text, end - 1, mode):
                        return Verdict(False, "token", end - 1, text[end - 1 : end + 39])
                elif kind == ">":
                    elements.end(before, "JSXTEXT" in g.first(found))
                else:
                    elements.brace(kind == "{")
            lang, pos, before = found, end, kind
            continue
        if mode & _TEXT and (m := _JSX_TEXT.match(text, pos)):
            kind, new_line, end = "JSXTEXT", False, m.end()
        elif mode & _TEXT and text[pos : pos + 1] in ("{", "<"):
            kind, new_line, end = text[pos], False, pos + 1
        else:
            m = _TRIVIA.match(text, pos)
            new_line = _NEW_LINE.search(text, pos, m.end()) is not None
            pos = m.end()
            if pos >= size:
                return VALID if derive(lang, "EOF", new_line) is not empty else Verdict(False, "truncated", size, "")
            c = text[pos]
            if c == "}" and mode & _TEMPLATE:
                m = _CONTINUED.match(text, pos)
                if m is None:
                    return Verdict(False, "truncated", pos, "`")
                kind, end = "TTAIL" if m[1] == "`" else "TMID", m.end()
            elif c == "/" and not mode & _DIVIDES and (m := _REGEX.match(text, pos)):
                kind, end = "REGEX", m.end()
                if not regex_is_sound(m[0]):
                    return Verdict(False, "token", pos, m[0][:40])
            elif c in "\"'" and mode & _QUOTED:
                m = _JSX_STRING.match(text, pos)
                if m is None:
                    return Verdict(False, "truncated", pos, c)
                kind, end = "JSXSTR", m.end()
            elif mode & _NAME and (m := _JSX_NAME.match(text, pos)):
                kind, end = "JSXNAME", m.end()
            else:
                m = _TOKEN.match(text, pos)
                if m is None:
                    return Verdict(False, "truncated" if c in "`" or text.startswith("/*", pos) else "token", pos, text[pos : pos + 20])
                kind, end = m.lastgroup, m.end()
                if kind == "word":
                    kind = _WORDS.get(m[0], "IDENT")
                elif kind == "punct":
                    kind = m[0]
                elif kind == "tick":
                    kind = "TFULL" if m[0][-1] == "`" else "THEAD"
        found = (lang.by_kind_nl if new_line else lang.by_kind).get(kind)
        if found is None:
            found = derive(lang, kind, new_line)
        if found is empty:
            return Verdict(False, "token", pos, text[pos : min(end, pos + 40)])
        if elements is not None:
            if kind == "<":
                if not elements.angle(text, pos, mode):
                    return Verdict(False, "token", pos, text[pos : pos + 40])
            elif kind == ">":
                elements.end(before, "JSXTEXT" in g.first(found))
            elif kind in ("{", "}"):
                elements.brace(kind == "{")
        lang, pos, before = found, end, kind


def _json(text: str) -> Verdict:
    g = grammar("json")
    lang, pos, size = g.start, 0, len(text)
    while True:
        m = _JSON_TOKEN.match(text, pos)
        if m is None:
            pos = _JSON_SPACE.match(text, pos).end()
            if pos >= size:
                return VALID if g.derive(lang, "EOF") is not g.empty else Verdict(False, "truncated", size, "")
            return Verdict(False, "token", pos, text[pos : pos + 20])
        kind = m.lastgroup
        lang = g.derive(lang, kind if kind in ("STR", "NUM") else m[kind])
        if lang is g.empty:
            return Verdict(False, "token", m.start(kind), m[kind][:40])
        pos = m.end()


_PY_COMPARE = frozenset(["==", "!=", "<", ">", "<=", ">=", "<>"])
_PY_OPERATOR = frozenset(["%", "//", "<<", ">>", "&", "|", "^"])
_PY_PLAIN = frozenset("( ) [ ] { } , : . ; @ = -> ... * ** + - / ~ := !".split())
_PY_SKIP = frozenset([tokenize.COMMENT, tokenize.NL, tokenize.ENCODING])
_PY_KIND = {
    tokenize.NEWLINE: "NEWLINE", tokenize.INDENT: "INDENT", tokenize.DEDENT: "DEDENT", tokenize.NUMBER: "NUM", tokenize.STRING: "STR", tokenize.ENDMARKER: "EOF",
    tokenize.FSTRING_START: "FSTART", tokenize.FSTRING_MIDDLE: "FMIDDLE", tokenize.FSTRING_END: "FEND",
}


def _python_kind(t: tokenize.TokenInfo) -> str:
    if t.type == tokenize.NAME:
        return t.string if t.string in G.PYTHON_KEYWORDS or t.string in G.PYTHON_SOFT else "IDENT"
    if t.type != tokenize.OP:
        return _PY_KIND.get(t.type, "ERROR")
    s = t.string
    if s in ("|",):
        return "|"
    if s in _PY_COMPARE:
        return "COMPARE"
    if s in _PY_OPERATOR:
        return "OPERATOR"
    if s in _PY_PLAIN:
        return s
    return "AUGMENT" if s.endswith("=") else "ERROR"


def _python(text: str) -> Verdict:
    g = grammar("python")
    lang = g.start
    text = text.removeprefix("﻿")
    starts = [0]
    for line in io.StringIO(text, newline=""):
        starts.append(starts[-1] + len(line))
    place = lambda at: starts[min(at[0], len(starts)) - 1] + at[1]
    try:
        for t in tokenize.generate_tokens(io.StringIO(text, newline="").readline):
            if t.type in _PY_SKIP:
                continue
            kind = _python_kind(t)
            after = g.derive(lang, kind)
            if after is g.empty:
                early = kind in ("EOF", "DEDENT") and not text[place(t.start) :].strip()
                return Verdict(False, "truncated" if early else "token", place(t.start), t.string[:40])
            lang = after
    except tokenize.TokenError as e:
        at = place(e.args[1]) if len(e.args) > 1 else len(text)
        return Verdict(False, "truncated" if "EOF" in str(e.args[0]) or "unterminated" in str(e.args[0]) else "token", at, str(e.args[0])[:40])
    except (IndentationError, SyntaxError) as e:
        return Verdict(False, "token", place((e.lineno or 1, 0)), str(e.msg)[:40])
    return VALID


def verdict(text: str, language: str) -> Verdict:
    """Whether ``text`` is in the language; an empty text is valid except as JSON."""
    grammar(language).trim()
    return _json(text) if language == "json" else _python(text) if language == "python" else _script(text, language)
