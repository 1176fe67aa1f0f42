"""A merge list compiled to a deterministic transducer, run over many chunks at once.

The tokens of a prefix are those of a shorter prefix and one more token, its last. So the only prefixes that still matter are
those from which a token may yet go on beyond what was read. A state is that set: for each such prefix the symbols since its end
(a node of the tokens' trie), which tokens may follow it, and how many more tokens it has than the one with fewest. Prefixes from
which no token can go on are left out, and two prefixes after which the same tokens may follow are the same, so states are few.
A transition is annotated with the number of tokens that it emits, which is how far the least count moves, and with the last
token of the prefix that it completes. Transitions are compiled when they are first taken and kept in a bounded table; the number
of states is bounded by the vocabulary, and independent of the text.

Symbols are bytes; the last byte of a pre-token is a symbol of its own (``END`` higher), as is each special token (from
``SPECIAL``). Either leads back to the start state with all tokens emitted.

A text is cut into chunks anywhere. A chunk's map sends the state it is entered in to the state it is left in and what it
emits. Behind its first ending symbol a map does not depend on the entry; before, it is kept as the symbols to be read. Maps
of all chunks are made side by side, one symbol of each chunk a step, and composed by a scan: a chunk whose predecessor's
exit is known reads its head, and a run of chunks without an ending symbol passes its state along.

Which tokens a text has follows from the last tokens, backwards from the end of a pre-token. Within one that has not ended, the
merge list's lookahead tells which tokens no continuation can change: these are emitted, the rest is carried on.
"""

from __future__ import annotations

import numpy as np

END, SPECIAL = 256, 512
#: Chunks that are read side by side, symbols read between two looks at the table's size, and states kept.
LANES, BLOCK, STATES = 2_048, 1 << 19, 400_000
_SHIFT, _START = 10, 0
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: A node with as many tokens below it, or fewer, has them listed; numbers of such lists start behind all tokens.
FEW, _LISTS = 30, 1 << 24
#: Pairs of tokens that are remembered.
KNOWN = 200_000


class Pairs:
    """Whether two tokens may stand side by side: whether merging their symbols gives exactly these two."""

    def __init__(self, pairs: list[tuple[str, str]], vocab: dict[str, int]):
        self.ids = vocab
        self.rank = {(vocab[a], vocab[b]): i for i, (a, b) in enumerate(pairs)}
        # The rule that makes each token and its two parts; symbols have none.
        self.made = {vocab[a + b]: (i, vocab[a], vocab[b]) for i, (a, b) in enumerate(pairs)}
        self.known: dict[int, bool] = {}

    def fit(self, left: int, right: int) -> bool:
        """Remembered under left << 32 | right; a left of -1 is the start."""
        key = left << 32 | right
        known = self.known.get(key)
        if known is None:
            if len(self.known) >= KNOWN:
                self.known.clear()
            known = self.known[key] = left < 0 or self._fit(left, right)
        return known

    def _fit(self, left: int, right: int) -> bool:
        """Take the younger of the two tokens at the seam apart, again and again: no rule may join across it before."""
        rank, made = self.rank, self.made
        bound = len(rank)  # a rule of this rank or later comes after a token at the seam was made
        left_rank, right_rank = made.get(left, (-1,))[0], made.get(right, (-1,))[0]
        # A rule as old as the right token's own is applied from the left, so it takes the seam first.
        while True:
            if rank.get((left, right), bound) < bound:
                return False
            if left_rank < 0 and right_rank < 0:
                return True
            if left_rank > right_rank:
                bound, left = left_rank, made[left][2]
                left_rank = made.get(left, (-1,))[0]
            else:
                bound, right = right_rank + 1, made[right][1]
                right_rank = made.get(right, (-1,))[0]

    def clear(self) -> None:
        self.known.clear()


class Transducer:
    """Tokens of symbol sequences; ``inner`` and ``last`` name tokens (bytes) inside and at the end of a pre-token."""

    def __init__(self, inner: dict[bytes, int], last: dict[bytes, int], pairs: Pairs, special: list[int]):
        self.inner, self.last, self.pairs, self.special = inner, last, pairs, special
        self._plant()
        self.width = np.ones(1 + max([*inner.values(), *last.values(), *special]), np.int64)
        for table in (inner, last):
            for token, number in table.items():
                self.width[number] = len(token)
        self.clear()

    def _plant(self) -> None:
        """The trie of all tokens: children by node and byte; by node its tokens (or -1), and those below it if they are few."""
        self.child: dict[int, int] = {}
        self.token, self.final, self.below = [-1], [-1], [[]]
        for table, of in ((self.inner, self.token), (self.last, self.final)):
            for token, number in table.items():
                node = 0
                for byte in token:
                    if len(self.below[node]) <= FEW:
                        self.below[node].append(number)
                    key = node << 8 | byte
                    at = self.child.get(key)
                    if at is None:
                        at = self.child[key] = len(self.token)
                        self.token.append(-1)
                        self.final.append(-1)
                        self.below.append([])
                    node = at
                of[node] = number

    def clear(self, keep: tuple | None = None) -> int:
        """Forget all transitions, and all states but one; the number that it has now."""
        self.pairs.clear()
        old = self.lists if keep else []
        self.lists: list[tuple[int, ...]] = []
        self.list_number: dict[tuple[int, ...], int] = {}
        keep = tuple((node, self._listed(old[after - _LISTS]) if after >= _LISTS else after, count) for node, after, count in keep or ())
        self.moves: dict[int, int] = {}
        start = ((0, -1, 0),)
        self.states, self.numbers = [start], {start: _START}
        self.table = np.full((1 << 18, 2), -1, np.int64)
        self.edges = 0
        self.count, self.token_at = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.uint32)
        return self._number(keep) if keep else _START

    def _number(self, state: tuple) -> int:
        number = self.numbers.get(state)
        if number is None:
            number = self.numbers[state] = len(self.states)
            self.states.append(state)
        return number

    # What may follow a prefix: its last token, or where few tokens are left the number of their list; -2 is nothing.

    def _allows(self, after: int, token: int) -> bool:
        return token in self.lists[after - _LISTS] if after >= _LISTS else self.pairs.fit(after, token)

    def _narrowed(self, after: int, node: int) -> int:
        """What may follow once ``node`` was read."""
        below = self.below[node]
        if len(below) > FEW and after < _LISTS:
            return after
        left = tuple([t for t in below if self._allows(after, t)])
        return self._listed(left) if left else -2

    def _listed(self, tokens: tuple[int, ...]) -> int:
        number = self.list_number.get(tokens)
        if number is None:
            number = self.list_number[tokens] = _LISTS + len(self.lists)
            self.lists.append(tokens)
        return number

    def step(self, state: tuple, symbol: int) -> tuple[tuple, int, int]:
        """(next state, last token, emitted tokens). A state has (node, what may follow, count) by prefix, the shortest first."""
        if symbol >= SPECIAL:
            return self.states[_START], self.special[symbol - SPECIAL], 1
        ends, byte, child, moves = symbol >= END, symbol & 255, self.child.get, self.moves
        token_of, known, lists = self.final if ends else self.token, self.pairs.known, self.lists
        last, total, after_all = -1, 0, []
        for node, after, count in state:
            node = child(node << 8 | byte)
            if node is None:
                continue
            if last < 0 and (token := token_of[node]) >= 0:
                if after >= _LISTS:
                    fits = token in lists[after - _LISTS]
                else:
                    fits = known.get(after << 32 | token)
                    if fits is None:
                        fits = self.pairs.fit(after, token)
                if fits:
                    last, total = token, count + 1
                    if ends:
                        return self.states[_START], last, total
            key = after << 24 | node
            after = moves.get(key)
            if after is None:
                after = moves[key] = self._narrowed(key >> 24, node)
            if after != -2:
                after_all.append((node, after, count))
        if last < 0:
            raise ValueError(f"no token ends in byte {byte}")
        least = min([total, *[c for _, _, c in after_all]])
        after_all.append((0, last, total))
        return tuple([(n, a, c - least) for n, a, c in after_all]) if least else tuple(after_all), last, least

    # The table: (state, symbol) to (edge, target) by open addressing.

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        shift = np.uint64(64 - (len(self.table).bit_length() - 1))
        return ((keys.view(np.uint64) * _FACTOR) >> shift).view(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """(edge << 32 | target) of keys, -1 where there is none yet."""
        at = self._slot(keys)
        found = np.take(self.table, at, axis=0)
        out = found[:, 1].copy()
        off = np.flatnonzero(found[:, 0] != keys)
        while len(off):
            off = off[out[off] >= 0]  # an empty slot ends the search
            at[off] = (at[off] + 1) & (len(self.table) - 1)
            rows = self.table[at[off]]
            out[off] = rows[:, 1]
            off = off[rows[:, 0] != keys[off]]
        return out

    def _insert(self, keys: np.ndarray, values: np.ndarray) -> None:
        at = self._slot(keys)
        # Each round, one key takes each free slot; the others try the next one.
        while len(keys):
            _, first = np.unique(at, return_index=True)
            first = first[self.table[at[first], 0] < 0]
            self.table[at[first], 0], self.table[at[first], 1] = keys[first], values[first]
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, values, at = keys[left], values[left], (at[left] + 1) & (len(self.table) - 1)

    def _make_room(self, more: int) -> None:
        """Keep two thirds of the slots free, and the arrays long enough."""
        while (self.edges + more) * 3 > len(self.table):
            old = self.table[self.table[:, 0] >= 0]
            self.table = np.full((2 * len(self.table), 2), -1, np.int64)
            self._insert(old[:, 0].copy(), old[:, 1])
        while self.edges + more > len(self.count):
            self.count, self.token_at = (np.resize(x, 2 * len(x)) for x in (self.count, self.token_at))

    def _compile(self, keys: np.ndarray) -> None:
        """Make the edges of keys that have none."""
        self._make_room(len(keys))
        step, states, number, symbol = self.step, self.states, self._number, (1 << _SHIFT) - 1
        made = [step(states[key >> _SHIFT], key & symbol) for key in keys.tolist()]
        targets = np.fromiter((number(state) for state, _, _ in made), np.int64, len(made))
        own = slice(self.edges, self.edges + len(keys))
        self.token_at[own], self.count[own] = [m[1] for m in made], [m[2] for m in made]
        self._insert(keys, np.arange(own.start, own.stop) << 32 | targets)
        self.edges += len(keys)

    def _take(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(edges, targets) from states by symbols."""
        keys = (states << _SHIFT) | symbols
        found = self._find(keys)
        none = np.flatnonzero(found < 0)
        if len(none):
            self._compile(np.unique(keys[none]))
            found[none] = self._find(keys[none])
        return found >> 32, found & 0xFFFFFFFF

    def _read(self, symbols: np.ndarray, edges: np.ndarray, begin: np.ndarray, end: np.ndarray, states: np.ndarray) -> np.ndarray:
        """Read symbols[begin:end] of each lane from its state, side by side; fill ``edges``, give the states at the end."""
        order = np.argsort(begin - end, kind="stable")
        at, length, now = begin[order], (end - begin)[order], states[order].copy()
        active = int(np.count_nonzero(length))
        step = 0
        while active:
            places = at[:active] + step
            edges[places], now[:active] = self._take(now[:active], symbols[places])
            step += 1
            active = int(np.searchsorted(-length, -step, side="left"))
        out = np.empty_like(now)
        out[order] = now
        return out

    def run(self, symbols: np.ndarray, state: int = _START) -> tuple[np.ndarray, int]:
        """(edge of each symbol, state behind the last one) of one block that is entered in ``state``."""
        n = len(symbols)
        edges = np.empty(n, np.int32)
        if not n:
            return edges, state
        lanes = min(LANES, max(1, n // 64))
        cuts = np.linspace(0, n, lanes + 1).astype(np.int64)
        begin, end = cuts[:-1], cuts[1:]
        resets = np.flatnonzero(symbols >= END)
        which = np.searchsorted(resets, begin)
        behind = np.append(resets + 1, n + 1)[which]
        known = behind <= end  # maps that do not depend on the entry behind their heads
        heads = np.minimum(behind, end)
        exits = self._read(symbols, edges, heads, end, np.zeros(lanes, np.int64))
        # Composition: a head is read once its predecessor's exit is known.
        entry = np.full(lanes, -1, np.int64)
        entry[0] = state
        entry[1:][known[:-1]] = exits[:-1][known[:-1]]
        todo = entry >= 0
        while todo.any():
            own = np.flatnonzero(todo)
            left = self._read(symbols, edges, begin[own], heads[own], entry[own])
            todo = np.zeros(lanes, bool)
            for lane, out in zip(own[~known[own]].tolist(), left[~known[own]].tolist()):
                exits[lane] = out
                if lane + 1 < lanes:
                    entry[lane + 1], todo[lane + 1] = out, True
        return edges, int(exits[-1])

    def counts(self, edges: np.ndarray) -> np.ndarray:
        """How many tokens each transition emits."""
        return self.count[edges]

    def tokens(self, edges: np.ndarray, ends: np.ndarray, carried: np.ndarray, lookahead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, how many of them end up to each symbol, what is carried on) of a block.

        ``ends`` marks the symbols that end a pre-token. ``carried`` has the last tokens at the symbols behind the last stable
        place of the block before; they count as symbols in front.
        """
        front = len(carried)
        last = np.concatenate([carried, self.token_at[edges]])
        width = self.width[last]
        chosen = np.zeros(len(last), bool)
        at = np.flatnonzero(ends) + front
        open_from = int(at[-1]) + 1 if len(at) else 0
        begin = np.append(0, at[:-1] + 1)[: len(at)]
        while len(at):
            chosen[at] = True
            at = at - width[at]
            inside = at >= begin
            at, begin = at[inside], begin[inside]
        # Of the pre-token that goes on: tokens that end further back than the lookahead are final.
        path, place = [], len(last) - 1
        while place >= open_from:
            path.append(place)
            place -= int(width[place])
        stable = [p for p in path if p < len(last) - lookahead]
        chosen[stable] = True
        held = last[max(stable, default=open_from - 1) + 1 :]
        ids = last[chosen]
        return ids, np.cumsum(chosen)[front:], held

    def full(self) -> bool:
        return len(self.states) > STATES
