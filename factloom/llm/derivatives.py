"""Memoised parsing with derivatives.

A language is a set of alternatives, each a grammar node followed by another
language; the derivative by a token is what may follow that token. Languages are
hash-consed: equal ones are one object, and alternatives that begin with the same node
share one united tail, so ambiguity does not multiply. Every language keeps its
derivatives by token kind. As most stretches of code lead through the same few
thousand languages, the table becomes an automaton that grows lazily and is kept from
file to file; a token then costs one look-up.

Grammars are text: ``name = alternatives``; quoted or capitalised words are token kinds,
``?``, ``*`` and ``+`` follow a group, ``-{a b}`` before an item forbids that it begins with
these tokens. Rules may not be left-recursive.
"""

from __future__ import annotations

import re

#: Languages kept before the table is started anew; bounds the memory of a worker.
MOST_LANGUAGES = 150_000

_GRAMMAR = re.compile(r"\s*('[^']*'|-\{[^}]*\}|[A-Za-z_]\w*|[()|?*+])")


class Node:
    """A grammar node; kind is one of tok, seq, alt, star, ref, guard."""

    __slots__ = ("kind", "value", "nullable", "first", "memo", "number")

    def __init__(self, kind: str, value, number: int):
        self.kind, self.value, self.number = kind, value, number
        self.nullable, self.first, self.memo = kind == "star", frozenset(), {}


class Language:
    """Hash-consed: ``items`` maps a node to the language after it; ``end`` is true where nothing need follow."""

    __slots__ = ("items", "end", "number", "by_kind", "by_kind_nl", "_first", "mode")

    def __init__(self, items: dict, end: bool, number: int):
        self.items, self.end, self.number = items, end, number
        self.by_kind: dict = {}
        self.by_kind_nl: dict = {}
        self._first = None
        #: What the reader of tokens must look out for here; it is the reader's to set.
        self.mode = None


class Grammar:
    def __init__(self, text: str, start: str, classes: dict[str, frozenset] | None = None, insert: str | None = None, closers: frozenset = frozenset()):
        """classes: names of sets of token kinds. insert: the kind that may be inserted before a token
        that starts a line or is one of closers."""
        self.classes, self.insert, self.closers = classes or {}, insert, closers
        self._nodes: dict = {}
        self.rules: dict[str, Node] = {}
        for line in re.sub(r"\n\s+", " ", text.strip()).splitlines():
            name, _, body = line.partition(" = ")
            self._add(name.strip(), body)
        undefined = {n.value for n in self._nodes.values() if n.kind == "ref"} - set(self.rules)
        if undefined:
            raise ValueError(f"undefined rules {sorted(undefined)}")
        self._settle()
        self.start_node = self._node("ref", start)
        self._settle()
        self.reset()

    # grammar text to nodes

    def _node(self, kind: str, value) -> Node:
        key = (kind, value if not isinstance(value, tuple) else tuple(v.number if isinstance(v, Node) else v for v in value))
        if key not in self._nodes:
            self._nodes[key] = Node(kind, value, len(self._nodes))
        return self._nodes[key]

    def _add(self, name: str, body: str) -> None:
        words, at = _GRAMMAR.findall(body), 0
        if "".join(words) != re.sub(r"\s+", "", body) and re.sub(r"\s+", "", "".join(words)) != re.sub(r"\s+", "", body):
            raise ValueError(f"rule {name} can't be read")

        def alternatives() -> Node:
            nonlocal at
            parts = [sequence()]
            while at < len(words) and words[at] == "|":
                at += 1
                parts.append(sequence())
            return parts[0] if len(parts) == 1 else self._node("alt", tuple(parts))

        def sequence() -> Node:
            nonlocal at
            parts = []
            while at < len(words) and words[at] not in "|)":
                parts.append(item())
            return parts[0] if len(parts) == 1 else self._node("seq", tuple(parts))

        def item() -> Node:
            nonlocal at
            word = words[at]
            at += 1
            if word.startswith("-{"):
                return self._node("guard", (frozenset(word[2:-1].split()), item()))
            if word == "(":
                node = alternatives()
                at += 1
            elif word.startswith("'"):
                node = self._node("tok", frozenset([word[1:-1]]))
            elif word in self.classes:
                node = self._node("tok", self.classes[word])
            elif word.isupper():
                node = self._node("tok", frozenset([word]))
            else:
                node = self._node("ref", word)
            while at < len(words) and words[at] in "?*+":
                sign = words[at]
                at += 1
                if sign == "?":
                    node = self._node("alt", (node, self._node("seq", ())))
                elif sign == "*":
                    node = self._node("star", (node,))
                else:
                    node = self._node("seq", (node, self._node("star", (node,))))
            return node

        node = alternatives()
        if at != len(words):
            raise ValueError(f"rule {name} isn't balanced")
        self.rules[name] = node

    def _settle(self) -> None:
        """Nullability and first sets as least fixpoints."""
        changed = True
        while changed:
            changed = False
            for n in list(self._nodes.values()):
                k, v = n.kind, n.value
                if k == "tok":
                    null, first = False, v
                elif k == "seq":
                    null, first = True, frozenset()
                    for part in v:
                        if null:
                            first |= part.first
                            null = part.nullable
                elif k == "alt":
                    null, first = any(p.nullable for p in v), frozenset().union(*(p.first for p in v))
                elif k == "star":
                    null, first = True, v[0].first
                elif k == "guard":
                    null, first = v[1].nullable, v[1].first - v[0]
                else:
                    body = self.rules[v]
                    null, first = body.nullable, body.first
                if (null, first) != (n.nullable, n.first):
                    n.nullable, n.first, changed = null, first, True

    # languages

    def reset(self) -> None:
        self._languages: dict = {}
        self._united: dict = {}
        self.empty = self._language({}, False)
        self.nothing = self._language({}, True)
        self.start = self._language({self.start_node: self.nothing}, False)

    def trim(self, lang: Language | None = None) -> Language:
        """Start the table anew once it is large, between files or inside one: only what the language in hand is made of is kept."""
        if len(self._languages) <= MOST_LANGUAGES:
            return self.start if lang is None else lang
        self.reset()
        if lang is None:
            return self.start
        copied: dict[int, Language] = {}
        todo = [lang]
        while todo:
            x = todo[-1]
            waiting = [tail for tail in x.items.values() if id(tail) not in copied]
            if waiting:
                todo += waiting
            else:
                copied[id(x)] = self._language({n: copied[id(tail)] for n, tail in x.items.items()}, x.end)
                todo.pop()
        return copied[id(lang)]

    def _language(self, items: dict, end: bool) -> Language:
        key = (end, frozenset([(n.number, tail.number) for n, tail in items.items()]))
        found = self._languages.get(key)
        if found is None:
            found = self._languages[key] = Language(items, end, len(self._languages))
        return found

    def first(self, lang: Language) -> frozenset:
        """The token kinds that may come next."""
        if lang._first is None:
            out, seen, todo = set(), set(), [lang]
            while todo:
                x = todo.pop()
                if x.number in seen:
                    continue
                seen.add(x.number)
                for n, tail in x.items.items():
                    out |= n.first
                    if n.nullable:
                        todo.append(tail)
            lang._first = frozenset(out)
        return lang._first

    def nullable(self, lang: Language) -> bool:
        """Whether the text may end here."""
        seen, todo = set(), [lang]
        while todo:
            x = todo.pop()
            if x.end:
                return True
            if x.number not in seen:
                seen.add(x.number)
                todo += [tail for n, tail in x.items.items() if n.nullable]
        return False

    def _residues(self, n: Node, kind: str) -> tuple:
        """What may follow ``kind`` inside the node: sequences of nodes."""
        out = n.memo.get(kind)
        if out is None:
            if kind not in n.first:
                out = ()
            elif n.kind == "tok":
                out = ((),)
            elif n.kind == "seq":
                found: dict = {}
                for i, part in enumerate(n.value):
                    for r in self._residues(part, kind):
                        found[r + n.value[i + 1 :]] = None
                    if not part.nullable:
                        break
                out = tuple(found)
            elif n.kind == "alt":
                out = tuple(dict.fromkeys(r for part in n.value for r in self._residues(part, kind)))
            elif n.kind == "star":
                out = tuple(r + (n,) for r in self._residues(n.value[0], kind))
            elif n.kind == "guard":
                out = self._residues(n.value[1], kind)
            else:
                out = self._residues(self.rules[n.value], kind)
            n.memo[kind] = out
        return out

    def unite(self, a: Language, b: Language) -> Language:
        if (known := self._union(a, b)) is not None:
            return known
        todo = [(a, b)]
        while todo:  # tails first, without recursion: nesting may be of any depth
            x, y = todo[-1]
            waiting = [(x.items[n], tail) for n, tail in y.items.items() if n in x.items and self._union(x.items[n], tail) is None]
            if waiting:
                todo += waiting
                continue
            items = dict(x.items)
            for n, tail in y.items.items():
                items[n] = self._union(items[n], tail) if n in items else tail
            self._united[(x.number, y.number) if x.number < y.number else (y.number, x.number)] = self._language(items, x.end or y.end)
            todo.pop()
        return self._union(a, b)

    def _union(self, a: Language, b: Language) -> Language | None:
        """The union if it is trivial or known."""
        if a is b or b is self.empty:
            return a
        if a is self.empty:
            return b
        return self._united.get((a.number, b.number) if a.number < b.number else (b.number, a.number))

    def _derive(self, lang: Language, kind: str) -> Language:
        out, seen, todo = self.empty, set(), [lang]
        while todo:
            x = todo.pop()
            if x.number in seen:
                continue
            seen.add(x.number)
            for n, tail in x.items.items():
                for r in self._residues(n, kind):
                    lng = tail
                    for part in reversed(r):
                        lng = self._language({part: lng}, False)
                    out = self.unite(out, lng)
                if n.nullable:
                    todo.append(tail)
        return out

    def derive(self, lang: Language, kind: str, new_line: bool = False) -> Language:
        """The derivative, memoised; with the inserted token where the rule of insertion allows it."""
        table = lang.by_kind_nl if new_line else lang.by_kind
        found = table.get(kind)
        if found is None:
            found = self._derive(lang, kind) if kind in self.first(lang) else self.empty
            if self.insert and (new_line or kind in self.closers) and self.insert in self.first(lang):
                after = self._derive(lang, self.insert)
                if kind in self.first(after):
                    found = self.unite(found, self._derive(after, kind))
            table[kind] = found
        return found

