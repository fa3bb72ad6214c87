"""Syntax checks by a pushdown automaton that is made deterministic as it runs.

A grammar in EBNF becomes a network of states with calls between rules. The automaton keeps the set of all stacks that the
tokens so far allow, so no lookahead or disambiguation is needed; stacks share their tails, and each set and each step from
it is tabled when first met. Code repeats its contexts, so after a short while a token costs one lookup.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

_PART = re.compile(r"'([^']+)'|([A-Za-z_][A-Za-z_0-9]*)|([|()\[\]{}])|\s+|(.)")
AHEAD = 8  # tokens that are read before the automaton sees them: a wrong grammar mostly ends a text early
MAX_SETS = 150_000


class Grammar:
    """Rules, one a line or continued by indentation: ``name: alternatives``; 'x' and UPPER are tokens, [ ] optional, { } repeated."""

    def __init__(self, text: str, starts: tuple[str, ...], soft_end: str | None = None):
        rules: dict[str, list[str]] = {}
        for m in re.finditer(r"(?m)^(\w+):((?:.*\n?)(?:[ \t]+.*\n?)*)", text):
            rules[m[1]] = [x for x in _PART.findall(m[2]) if any(x)]
        self.tokens: list[dict[str, list[int]]] = []
        self.eps: list[list[int]] = []
        self.calls: list[list[tuple[str, int]]] = []
        self.first, self.last = {}, {}
        for name in rules:
            self.first[name], self.last[name] = self._new(), self._new()
        self.ends = {s: n for n, s in self.last.items()}
        for name, parts in rules.items():
            parts = list(parts)
            end = self._alternatives(parts, self.first[name], rules)
            self.eps[end].append(self.last[name])
            if parts:
                raise ValueError(f"rule {name} isn't closed")
        self.soft = soft_end
        self.starts = starts
        self._restart()

    def _new(self) -> int:
        self.tokens.append({})
        self.eps.append([])
        self.calls.append([])
        return len(self.eps) - 1

    def _alternatives(self, parts: list, start: int, rules: dict) -> int:
        end = self._new()
        while True:
            at = start
            while parts and not (parts[0][2] and parts[0][2] in "|)]}"):
                at = self._item(parts, at, rules)
            self.eps[at].append(end)
            if not (parts and parts[0][2] == "|"):
                return end
            parts.pop(0)

    def _item(self, parts: list, at: int, rules: dict) -> int:
        literal, name, mark, odd = parts.pop(0)
        if odd:
            raise ValueError(f"unexpected {odd}")
        if mark:
            inner = self._new()
            self.eps[at].append(inner)
            end = self._alternatives(parts, inner, rules)
            parts.pop(0)
            if mark == "{":
                self.eps[end].append(inner)
            if mark in "{[":
                out = self._new()
                self.eps[inner].append(out)
                self.eps[end].append(out)
                return out
            return end
        to = self._new()
        if name and name in rules:
            self.calls[at].append((name, to))
        elif name and not name.isupper():
            raise ValueError(f"no rule {name}")
        else:
            self.tokens[at].setdefault(literal or name, []).append(to)
        return to

    def _restart(self) -> None:
        self.stacks: dict[tuple, tuple] = {}
        self.closed: dict[int, tuple] = {}
        self.sets: dict[frozenset, dict] = {}
        self.begin = {s: self._set([self._push(self.first[s], None)]) for s in self.starts}

    def _push(self, state: int, below: tuple | None) -> tuple:
        key = (state, id(below))
        got = self.stacks.get(key)
        if got is None:
            got = self.stacks[key] = (state, below)
        return got

    def _close(self, stack: tuple) -> tuple:
        """Stacks reachable without a token whose top state reads one, and whether the start rule can end."""
        got = self.closed.get(id(stack))
        if got is not None:
            return got
        seen, work, live, done = {id(stack)}, [stack], [], False
        while work:
            top = work.pop()
            state, below = top
            if self.tokens[state]:
                live.append(top)
            following = [self._push(s, below) for s in self.eps[state]]
            following += [self._push(self.first[rule], self._push(to, below)) for rule, to in self.calls[state]]
            if state in self.ends:
                if below is None:
                    done = True
                else:
                    following.append(below)
            for x in following:
                if id(x) not in seen:
                    seen.add(id(x))
                    work.append(x)
        got = self.closed[id(stack)] = (tuple(live), done)
        return got

    def _set(self, stacks) -> dict | None:
        live, done = {}, False
        for s in stacks:
            more, end = self._close(s)
            done |= end
            for x in more:
                live[id(x)] = x
        if not live and not done:
            return None
        key = frozenset(live), done
        got = self.sets.get(key)
        if got is None:
            got = self.sets[key] = {None: tuple(live.values()), "": done}
        return got

    def _step(self, at: dict, token: str) -> dict | None:
        to = self._set([self._push(s, below) for state, below in at[None] for s in self.tokens[state].get(token, ())])
        at[token] = to
        return to

    def _soften(self, at: dict) -> dict:
        """The set with the statements that may end here ended."""
        ended = self._set([self._push(s, below) for state, below in at[None] for s in self.tokens[state].get(self.soft, ())])
        both = {id(x): x for x in at[None]}
        done = at[""]
        if ended:
            both |= {id(x): x for x in ended[None]}
            done |= ended[""]
        key = frozenset(both), done
        got = self.sets.get(key)
        if got is None:
            got = self.sets[key] = {None: tuple(both.values()), "": done}
        at["\n"] = got
        return got

    def accepts(self, tokens: Iterable[str], start: str) -> bool:
        """Whether the tokens form ``start``; with a soft end, "\\n" stands for a line break, and "}" and the end may end a statement too."""
        if len(self.sets) > MAX_SETS:
            self._restart()
        at = self.begin[start]
        soft = self.soft is not None
        for t in tokens:
            if soft and (t == "\n" or t == "}"):
                at = at.get("\n") or self._soften(at)
                if t == "\n":
                    continue
            to = at.get(t, 0)
            if to == 0:
                to = self._step(at, t)
            if to is None:
                return False
            at = to
        return bool((self._soften(at) if soft else at)[""])
