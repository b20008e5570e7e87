"""Conditions, rules, watchers and compositions as immutable values; conditions are checked and put in postfix form once."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Options:
    """How a relation's events are narrowed. window is in micros; props holds wanted property values; how_many None asks for any."""

    depth: int = 0
    how_many: int | None = None
    or_more: bool = False
    window: int | None = None
    props: Mapping[str, object] = field(default_factory=dict)

    def counted(self, n: int) -> bool:
        return n > 0 if self.how_many is None else n >= self.how_many if self.or_more else n == self.how_many


@dataclass(frozen=True)
class Term:
    """kind: type, domain, any_type, child, descendants, siblings, peers or cousin."""

    kind: str
    value: object
    options: Options = Options()


@dataclass(frozen=True)
class Condition:
    tokens: tuple = ()

    def _with(self, token) -> Condition:
        return replace(self, tokens=(*self.tokens, token))

    def and_(self):
        return self._with("and")

    def or_(self):
        return self._with("or")

    def group(self):
        return self._with("(")

    def ungroup(self):
        return self._with(")")

    def is_type(self, t: str):
        return self._with(Term("type", t))

    def in_domain(self, d: str):
        return self._with(Term("domain", d))

    def is_any_of_types(self, *types: str):
        return self._with(Term("any_type", types))

    def has_child(self, t: str, **o):
        return self._with(Term("child", t, Options(**o)))

    def has_descendants(self, t: str, **o):
        return self._with(Term("descendants", t, Options(**o)))

    def has_siblings(self, t: str, **o):
        return self._with(Term("siblings", t, Options(**o)))

    def has_peers(self, t: str, **o):
        return self._with(Term("peers", t, Options(**o)))

    def has_cousin(self, t: str, **o):
        return self._with(Term("cousin", t, Options(**o)))

    def terms(self) -> list[Term]:
        return [t for t in self.tokens if isinstance(t, Term)]

    def postfix(self) -> list:
        """AND binds tighter than OR, both from left to right; raises ValueError for what can't be read."""
        rank = {"or": 1, "and": 2}
        out, held = [], []
        for t in self.tokens:
            if isinstance(t, Term):
                out.append(t)
            elif t == "(":
                held.append(t)
            elif t == ")":
                while held and held[-1] != "(":
                    out.append(held.pop())
                if not held:
                    raise ValueError("mismatched parentheses")
                held.pop()
            else:
                while held and held[-1] != "(" and rank[held[-1]] >= rank[t]:
                    out.append(held.pop())
                held.append(t)
        if "(" in held:
            raise ValueError("mismatched parentheses")
        out += reversed(held)
        if not out:
            raise ValueError("empty expression")
        depth = 0
        for t in out:
            depth += 1 if isinstance(t, Term) else -1
            if depth < 1:
                raise ValueError("invalid expression")
        if depth != 1:
            raise ValueError("expression did not collapse")
        return out

    def decide(self, value_of, both=lambda a, b: a and b, either=lambda a, b: a or b):
        """The condition's value from those of its terms; all terms are asked for, in order."""
        stack = []
        for t in self.postfix():
            if isinstance(t, Term):
                stack.append(value_of(t))
            else:
                b, a = stack.pop(), stack.pop()
                stack.append((both if t == "and" else either)(a, b))
        return stack[0]


@dataclass(frozen=True)
class Rule:
    """Events of the trigger types that meet the condition give an event of event_type in domain, with the properties props.

    `process`, if given, is asked instead of the condition: it takes the fold and the anchor's id, and returns whether the
    rule fires and which events besides the anchor contribute.
    """

    rule_id: str
    triggers: tuple[str, ...]
    condition: Condition
    event_type: str
    domain: str
    props: Mapping[str, object] = field(default_factory=dict)
    process: Callable[[object, str], tuple[bool, list[str]]] | None = None


@dataclass(frozen=True)
class Watch:
    """types and domains: None for all, an empty set for none."""

    depth: int
    min_count: int
    types: frozenset | None = None
    domains: frozenset | None = None


@dataclass(frozen=True)
class Composition:
    """required: (type, domain) to the least number of matches (0 counts as 1); window in micros or None; props go to the composed event."""

    composition_id: str
    required: Mapping[tuple[str, str], int]
    event_type: str
    domain: str
    window: int | None = None
    reset_on_fire: bool = False
    props: Mapping[str, object] = field(default_factory=dict)
