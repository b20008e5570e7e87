"""The ordered part: rules that consume what they match, watchers, and compositions that feed events back.

A peer is an event without parents; whatever fires takes its contributors out of all later peer sets. So where rules
share types, have windows or read each other's results, events are folded in order, one state for each independent group.
"""

from __future__ import annotations

import json
from bisect import bisect_left, insort
from collections import defaultdict, deque
from hashlib import sha256
from math import inf

from causeway.plans.dsl import Composition, Rule, Term, Watch

MASK, PRIME, OFFSET = (1 << 64) - 1, (1 << 40) + 435, 0xCBF29CE484222325
MAX_DEPTH = 5


def _fnv(data: bytes) -> int:
    h = OFFSET
    for b in data:
        h = (h ^ b) * PRIME & MASK
    return h


class Fold:
    """State of one group. rows collects derived events, matches and compositions since it was last emptied."""

    def __init__(self, rules: list[Rule], watches: list[Watch] = (), compositions: list[Composition] = (), clock=None, max_cascade: int = 100_000):
        self.rules: dict[str, list[Rule]] = defaultdict(list)
        for rule in rules:
            if rule.process is None:
                rule.condition.postfix()
            for t in rule.triggers:
                self.rules[t].append(rule)
        self.watches, self.compositions, self.clock, self.max_cascade = list(watches), list(compositions), clock, max_cascade
        #: Depth up to which signatures are wanted: none without a watch.
        self.deepest = max([w.depth for w in self.watches if 1 <= w.depth <= MAX_DEPTH], default=0)
        self.events: dict[str, tuple] = {}
        self.number: dict[str, int] = {}
        #: Free events as (ts, number, id) in the order of their times, by type and domain.
        self.free: dict[str, dict[str, list[tuple]]] = defaultdict(dict)
        self.up: dict[str, list[str]] = defaultdict(list)
        self.down: dict[str, list[str]] = defaultdict(list)
        self.signs: dict[str, list[int]] = {}
        self.leaves: dict[tuple, list[int]] = {}
        self.counts: dict[tuple, int] = defaultdict(int)
        self.recent: dict[tuple, list[tuple]] = defaultdict(list)
        self.fired: dict[str, int] = defaultdict(int)
        self.derived: list[dict] = []
        self.matches: list[dict] = []
        self.composed: list[dict] = []
        self._steps = 0

    # relations

    def _levels_up(self, anchor: str, depth: int) -> list[list[str]]:
        seen, frontier, out = {anchor}, [anchor], []
        for _ in range(max(depth, 0)):
            reached = [p for e in frontier for p in self.up[e]]
            frontier = [p for p in dict.fromkeys(reached) if p not in seen]
            seen.update(frontier)
            out.append(frontier)
        return out

    def _related(self, term: Term, anchor: str) -> list[str]:
        kind, t = term.kind, term.value
        own_type, own_domain = self.events[anchor][:2]
        if kind == "child":
            return [c for c in dict.fromkeys(self.down[anchor]) if self.events[c][0] == t]
        if kind == "descendants":
            return [e for level in self._levels_up(anchor, max(term.options.depth, 1)) for e in level]
        if kind == "siblings":
            return [c for c in dict.fromkeys(c for p in self.up[anchor] for c in self.down[p]) if c != anchor]
        if kind == "peers":
            pools = self.free[t]
            return self._within([pools.get(own_domain, [])] if t == own_type else list(pools.values()), anchor, term.options.window)
        found: dict[str, None] = {}
        for i, level in enumerate(self._levels_up(anchor, term.options.depth or 1)):
            for _ in range(i + 1):
                level = list(dict.fromkeys(c for e in level for c in self.down[e]))
            found |= dict.fromkeys(level)
        return [e for e in found if e != anchor]

    def _within(self, pools: list[list[tuple]], anchor: str, window: int | None) -> list[str]:
        """Free events other than the anchor, in the order in which they came; with a window only those in reach are looked at."""
        at = self.events[anchor][2]
        cut = (lambda p: p) if window is None else lambda p: p[bisect_left(p, (at - window,)) : bisect_left(p, (at + window, inf))]
        return [e for _, e in sorted((n, e) for p in pools for _, n, e in cut(p) if e != anchor)]

    def _term(self, term: Term, anchor: str) -> tuple[bool, list[str]]:
        own_type, own_domain, at, _ = self.events[anchor]
        if term.kind in ("type", "domain", "any_type"):
            return {"type": own_type == term.value, "domain": own_domain == term.value, "any_type": term.kind == "any_type" and own_type in term.value}[term.kind], []
        o, out = term.options, []
        strict = term.kind == "siblings"
        for e in self._related(term, anchor):
            event_type, _, ts, props = self.events[e]
            if (strict or (term.value and term.value != own_type)) and event_type != term.value:
                continue
            if o.window is not None and not at - o.window <= ts <= (at if strict else at + o.window):
                continue
            if all(props.get(k) == v for k, v in o.props.items()):
                out.append(e)
        return o.counted(len(out)), out

    def holds(self, condition, anchor: str) -> tuple[bool, list[str]]:
        """The truth of a condition for an event, and the matched events of all its terms in order."""
        gathered: list[str] = []

        def value(term):
            ok, found = self._term(term, anchor)
            gathered.extend(found)
            return ok

        return condition.decide(value), gathered

    # writing

    def add(self, event_id: str, event_type: str, domain: str, ts: int, props: dict | None = None) -> str:
        """An event without contributors as yet; one whose id is known takes the other's place."""
        if event_id in self.events:
            self._take(event_id)
        self.events[event_id] = (event_type, domain, ts, props or {})
        self.number[event_id] = len(self.number)
        insort(self.free[event_type].setdefault(domain, []), (ts, self.number[event_id], event_id))
        if (event_type, domain) not in self.leaves:
            base = _fnv(event_type.encode() + b"\0" + domain.encode() + b"\0")
            self.leaves[event_type, domain] = [base, *[self._lineage(k, base, []) for k in range(1, self.deepest + 1)]]
        self.signs[event_id] = self.leaves[event_type, domain]
        return event_id

    def _take(self, event_id: str) -> None:
        """Out of the free events, if it is one."""
        event_type, domain, ts, _ = self.events[event_id]
        pool, own = self.free[event_type].get(domain, []), (ts, self.number[event_id], event_id)
        i = bisect_left(pool, own)
        if i < len(pool) and pool[i] == own:
            del pool[i]

    @staticmethod
    def _lineage(depth: int, base: int, below: list[int]) -> int:
        return _fnv(b"".join(x.to_bytes(8, "little") for x in (depth, base, *sorted(below))))

    def link(self, contributor: str, derived: str) -> None:
        self.up[contributor].append(derived)
        self.down[derived].append(contributor)
        self._take(contributor)

    def ingest(self, event_id: str, event_type: str, domain: str, ts: int, props: dict | None = None, root: str | None = None) -> None:
        """Add a leaf and run all rules it sets off, breadth first, each rule seeing what the one before it consumed."""
        self.add(event_id, event_type, domain, ts, props)
        root, place = root or event_id, 0
        queue = deque([event_id])
        while queue:
            anchor = queue.popleft()
            for rule in self.rules[self.events[anchor][0]]:
                ok, found = rule.process(self, anchor) if rule.process else self.holds(rule.condition, anchor)
                if ok:
                    self._steps += 1
                    if self._steps > self.max_cascade * max(1, len(self.events)):
                        raise RuntimeError("the cascade doesn't end")
                    place += 1
                    queue.append(self._derive(rule, anchor, [*found, anchor], root, place))

    def _derive(self, rule: Rule, anchor: str, contributors: list[str], root: str, place: int) -> str:
        name = sha256(f"{rule.rule_id}|{anchor}|{root}|{place}".encode()).hexdigest()[:32]
        ts = max(self.events[c][2] for c in contributors)
        self.add(name, rule.event_type, rule.domain, ts, dict(rule.props))
        base = self.signs[name][0]
        self.signs[name] = [base, *[self._lineage(k, base, [self.signs[c][k - 1] for c in contributors]) for k in range(1, self.deepest + 1)]]
        for c in contributors:
            self.link(c, name)
        for k in range(1, self.deepest + 1):
            self.counts[rule.event_type, rule.domain, k, self.signs[name][k]] += 1
        self.derived.append({"derived_id": name, "rule_id": rule.rule_id, "event_type": rule.event_type, "domain": rule.domain, "ts": ts, "root_id": root, "place": place, "anchor_id": anchor, "props": json.dumps(dict(rule.props), sort_keys=True, default=str), "contributors": contributors})
        for watch in self.watches:
            self._watch(watch, name, rule, ts, contributors)
        return name

    def _watch(self, w: Watch, name: str, rule: Rule, ts: int, contributors: list[str]) -> None:
        if w.types is not None and rule.event_type not in w.types or w.domains is not None and rule.domain not in w.domains or not 1 <= w.depth <= MAX_DEPTH:
            return
        sign = self.signs[name][w.depth]
        n = self.counts[rule.event_type, rule.domain, w.depth, sign]
        if n >= w.min_count:
            match = {"event_type": rule.event_type, "domain": rule.domain, "depth": w.depth, "sig": sign, "occurrence": n, "ts": ts, "derived_id": name, "rule_id": rule.rule_id, "contributors": contributors}
            self.matches.append(match)
            for c in self.compositions:
                self.compose(c, match)

    def compose(self, c: Composition, match: dict) -> None:
        """Take a match in; when every required pattern has enough of them close enough in time, ingest the composed event."""
        kind = match["event_type"], match["domain"]
        if kind not in c.required:
            return
        now = match["ts"] if self.clock is None else self.clock
        held = lambda k: self.recent[c.composition_id, k]
        held(kind).append((match["ts"], match["derived_id"]))
        if c.window is not None:
            for k in c.required:
                held(k)[:] = [x for x in held(k) if x[0] >= now - c.window]
        if any(len(held(k)) < max(1, n) for k, n in c.required.items()):
            return
        last = [held(k)[-1] for k in c.required]
        if c.window is not None and (max(last)[0] - min(last)[0] > c.window or min(last)[0] < now - c.window):
            return
        name = sha256(f"{c.composition_id}|{self.fired[c.composition_id]}|{match['derived_id']}".encode()).hexdigest()[:32]
        self.fired[c.composition_id] += 1
        props = {**c.props, "composition_id": c.composition_id, "pattern_count": len(last)}
        self.composed.append({"composition_id": c.composition_id, "event_type": c.event_type, "domain": c.domain, "ts": now, "derived_id": name, "props": json.dumps(props, sort_keys=True, default=str), "patterns": [x[1] for x in last]})
        if c.reset_on_fire:
            for k in c.required:
                held(k).clear()
        self.ingest(name, c.event_type, c.domain, now, props)
        for _, pattern in last:
            if pattern in self.events:
                self.link(pattern, name)

    def __getstate__(self):
        return {k: (dict(v) if isinstance(v, defaultdict) else v) for k, v in self.__dict__.items()}

    def __setstate__(self, state):
        self.__dict__.update(state)
        for k, make in (("rules", list), ("free", dict), ("up", list), ("down", list), ("counts", int), ("recent", list), ("fired", int)):
            setattr(self, k, defaultdict(make, state[k]))
