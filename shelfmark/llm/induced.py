"""Suffix arrays with common prefixes by external induced sorting, recursive, with queues and arrays on disk.

Suffixes are L-type if greater than the one that begins a symbol later, else S-type; leftmost S-types seed the sort. One
sweep upwards takes suffix tuples (position, prefix shared with the tuple before) from the queue of each first symbol, in
order, and puts their L-type predecessors into the queues of theirs; a sweep downwards does so for S-types. A queue for
each symbol makes one priority queue: tuples come out by symbol, then in the order in which they went in. What is ready is
taken in blocks of array operations. A predecessor shares one symbol more than the least that the tuples taken since its
queue's last one share.

A first pair of sweeps sorts the pieces between seeds; their ranks are the reduced text, which is sorted by the same induction,
again and again, until ranks differ or tell enough, or are few and sorted in memory; then the seeds are in order and a second pair of sweeps sorts all. In
reduced texts, whose alphabets are large, a queue is for a range of symbols, and only order is carried: what seeds share is
read off the text.

Queues past `memory` bytes go to a file, and arrays over the text are files too, all without names, so that they end with the
task; a step holds `BLOCK` elements. Memory grows with the number of ranges and ranks, some bytes for each of the latter.

Prefixes are told up to `depth` symbols, and order beyond that is arbitrary.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np


#: Suffixes that a range of symbols holds, about, where a text of ranks is sorted.
RANGE = 1 << 15
#: Ranks of a reduced text that is sorted in memory, which ends the recursion.
SMALL = 1 << 17
#: Elements of arrays on disk that one step takes.
BLOCK = 1 << 17
#: Bytes of tuples that the queues of a sweep hold before they go to disk.
MEMORY = 32 << 20


class Queue:
    """Blocks of (position, shared) in order; the oldest are on disk when memory is short."""

    def __init__(self):
        self.blocks: list = []


class Queues:
    def __init__(self, symbols: int, memory: int):
        self.queues = [Queue() for _ in range(symbols)]
        self.memory, self.held, self.file, self.end = memory, 0, None, 0

    def put(self, symbol: int, at: np.ndarray, shared: np.ndarray) -> None:
        self.queues[symbol].blocks.append((at, shared))
        self.held += at.nbytes + shared.nbytes
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile(dir=scratch())
        for q in self.queues:
            for i, b in enumerate(q.blocks):
                if isinstance(b[0], np.ndarray):
                    self.file.seek(self.end)
                    self.file.write(b[0].tobytes() + b[1].tobytes())
                    q.blocks[i] = (self.end, len(b[0]))
                    self.end += b[0].nbytes + b[1].nbytes
        self.held = 0

    def take(self, symbol: int, most: int) -> tuple[np.ndarray, np.ndarray] | None:
        """The first tuples of a queue, in whole blocks until there are `most`."""
        q = self.queues[symbol]
        if not q.blocks:
            return None
        at, shared, n, used = [], [], 0, 0
        for b in q.blocks:
            if n >= most:
                break
            used += 1
            if isinstance(b[0], np.ndarray):
                self.held -= b[0].nbytes + b[1].nbytes
            else:
                self.file.seek(b[0])
                raw = self.file.read(b[1] * 6)
                b = (np.frombuffer(raw, np.int32, b[1]), np.frombuffer(raw, np.int16, b[1], b[1] * 4))
            at.append(b[0])
            shared.append(b[1])
            n += len(b[0])
        del q.blocks[:used]
        return np.concatenate(at), np.concatenate(shared)

    def close(self) -> None:
        if self.file:
            self.file.close()


def s_types(text: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Whether each suffix is S-type; equal neighbours are as the next unequal ones. Block by block, from the end."""
    n = len(text)
    out = on_disk(n, bool)
    following, rises = -1, True
    for at in range((n - 1) // block * block, -1, -block):
        part = np.append(text[at : at + block], following if following >= 0 else text[n - 1])
        differs = np.append(np.flatnonzero(part[1:] != part[:-1]), len(part) - 1)
        kinds = np.append(part[differs[:-1]] < part[differs[:-1] + 1], rises)
        types = np.repeat(kinds, np.diff(differs, prepend=-1))[: len(part) - 1]
        out[at : at + block] = types
        following, rises = int(part[0]), bool(types[0])
    return out


def scratch() -> str | None:
    """Spark's own local folder, where an executor names it."""
    return os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None


def on_disk(n: int, kind) -> np.ndarray:
    """An array in a file without a name, which ends with the task: its pages are the file's, not the process's memory."""
    with tempfile.TemporaryFile(dir=scratch()) as file:
        file.truncate(max(1, n) * np.dtype(kind).itemsize)
        return np.asarray(np.memmap(file, kind, "r+", shape=(max(1, n),)))[:n]


class Written:
    """An array on disk that is filled from its beginning."""

    def __init__(self, n: int, kind):
        self.array, self.n = on_disk(n, kind), 0

    def add(self, values: np.ndarray) -> None:
        self.array[self.n : self.n + len(values)] = values
        self.n += len(values)

    def done(self) -> np.ndarray:
        return self.array[: self.n]


def seeds_of(is_s: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Leftmost S-types: those behind an L-type."""
    out = Written(len(is_s) // 2 + 1, np.int32)
    for at in range(1, len(is_s), block):
        out.add(np.flatnonzero(is_s[at : at + block] & ~is_s[at - 1 : at - 1 + block][: len(is_s[at : at + block])]) + at)
    return out.done()


def _shared(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Symbols that the suffixes at a and b share, up to `depth`; text is padded by that many."""
    if len(a) > BLOCK:
        return np.concatenate([_shared(text, a[i : i + BLOCK], b[i : i + BLOCK], depth) for i in range(0, len(a), BLOCK)])
    a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
    four = np.ndarray((len(text) - 3,), "<u8", text, strides=(2,))
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    while len(live):
        x = four[a[live] + out[live]] ^ four[b[live] + out[live]]
        same = x == 0
        low = x & (~x + np.uint64(1))
        out[live] += np.where(same, 4, np.bitwise_count(low - np.uint64(1)).astype(np.int64) // 16)
        live = live[same & (out[live] < depth)]
    return np.minimum(out, depth).astype(np.int16)


Blocks = Iterator[tuple[np.ndarray, np.ndarray]]


class Sorted:
    """Suffix tuples symbol by symbol, on disk, as a sweep has put them in order."""

    def __init__(self, n: int):
        self.at, self.shared, self.bounds = Written(n, np.int32), Written(n, np.int16), {}

    def add(self, symbol: int, at: np.ndarray, shared: np.ndarray) -> None:
        self.bounds[symbol] = self.bounds.get(symbol, (self.at.n, 0))[0], self.at.n + len(at)
        self.at.add(at)
        self.shared.add(shared)

    def blocks(self, symbol: int, backwards: bool = False) -> Blocks:
        """A symbol's tuples; backwards, each with what it shares with the one behind it. The first one shares nothing yet."""
        begin, end = self.bounds.get(symbol, (0, 0))
        for i in range(0, end - begin, BLOCK):
            if backwards:
                low, high = max(begin, end - i - BLOCK), end - i
                at, shared = self.at.array[low:high][::-1], np.array(self.shared.array[low + 1 : high + 1][::-1])
            else:
                low, high = begin + i, min(end, begin + i + BLOCK)
                at, shared = self.at.array[low:high], np.array(self.shared.array[low:high])
            if not i:
                shared[0] = 0
            yield np.array(at), shared


def _sweep(text, is_s, seeds, symbols: int, down: bool, depth: int, memory: int) -> Sorted:
    """Induces all suffixes of a type from the seeds (blocks of each symbol). Tuples are put in the order of the sweep."""
    waiting, done = Queues(symbols, memory), Sorted(len(is_s))
    since = np.full(symbols, depth, np.int16)

    def induce(at: np.ndarray, shared: np.ndarray) -> None:
        nonlocal since
        fits = np.flatnonzero((at > 0) & (is_s[at - 1] == down))
        before = at[fits] - 1
        symbol = text[before]
        order = np.argsort(symbol, kind="stable")
        symbol, index = symbol[order], fits[order]
        first = np.ones(len(symbol), bool)
        first[1:] = symbol[1:] != symbol[:-1]
        from_ = np.where(first, 0, np.append(0, index[:-1] + 1)) if len(index) else index
        ends = np.append(np.append(shared, np.int16(depth)), np.int16(depth))
        pairs = np.stack([from_, index + 1], axis=1).ravel()
        least = np.minimum.reduceat(ends, pairs)[::2] if len(pairs) else np.zeros(0, np.int16)
        heads = np.flatnonzero(first)
        own = symbol[heads]
        least[heads] = np.minimum(least[heads], since[own])
        value = np.minimum(least + 1, depth).astype(np.int16)
        since = np.minimum(since, shared.min()) if len(shared) else since
        tails = np.append(heads[1:], len(symbol))
        rest = index[tails - 1] + 1 if len(heads) else index
        after = np.minimum.accumulate(np.append(shared, np.int16(depth))[::-1])[::-1]
        since[own] = after[rest]
        where = before[order].astype(np.int32)
        for h, t, c in zip(heads.tolist(), tails.tolist(), own.tolist()):
            waiting.put(c, where[h:t], value[h:t])

    for c in range(symbols - 1, -1, -1) if down else range(symbols):
        last = None
        while (got := waiting.take(c, BLOCK)) is not None:
            at, shared = got[0], got[1].copy()
            if last is None:
                shared[0] = 0
            last = at[-1]
            done.add(c, at, shared)
            induce(at, shared)
        for n, (at, shared) in enumerate(seeds(c)):
            if not n and last is not None:
                shared[0] = _shared(text, np.array([last]), at[:1], depth)[0]
            induce(at, shared)
    waiting.close()
    return done


def _both(text, is_s, seeds, symbols: int, depth: int, memory: int) -> tuple[Sorted, Sorted]:
    """L-types ascending and S-types descending, with what neighbours share."""
    rising = _sweep(text, is_s, seeds, symbols, False, depth, memory)
    return rising, _sweep(text, is_s, lambda c: rising.blocks(c, True), symbols, True, depth, memory)


def _agree(text: np.ndarray, a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Whether the first `least` symbols at a and b are the same, of each pair."""
    out, live, step = np.ones(len(a), bool), np.arange(len(a)), 0
    while len(live):
        same = text[a[live] + step] == text[b[live] + step]
        out[live[~same]] = False
        step += 1
        live = live[same & (step < least[live])]
    return out


def _names(text: np.ndarray, seeds: np.ndarray, pieces: np.ndarray, depth: int, block: int = BLOCK) -> np.ndarray:
    """The reduced text: for each seed the rank, from 0, of its piece, which reaches to the next seed. `pieces`: the seeds in
    order of their pieces. Neighbours are one piece if they agree up to and with the next seed, or as far as order is told."""
    names, rank = on_disk(len(seeds), np.int32), 0
    for at in range(0, len(pieces), block):
        own = np.asarray(pieces[max(0, at - 1) : at + block], np.int64)
        k = np.searchsorted(seeds, own.astype(np.int32))
        size = np.where(k + 1 < len(seeds), seeds[np.minimum(k + 1, len(seeds) - 1)], len(text) - 1) - own
        least = np.minimum(np.minimum(size[1:], size[:-1]) + 1, depth)
        alike = _agree(text, own[1:], own[:-1], least) & ((size[1:] == size[:-1]) | (least >= depth))
        ranks = rank + np.cumsum(~alike)
        names[k[1:]] = ranks
        if not at:
            names[k[0]] = 0
        rank = int(ranks[-1]) if len(ranks) else rank
    return names


def _seeds_in_order(seeds: np.ndarray, names: np.ndarray, depth: int, block: int, memory: int) -> np.ndarray:
    """Seeds in order of their suffixes: by name where names differ or tell enough, else by sorting the reduced text."""
    order, told = on_disk(len(seeds), np.int32), int(names.max()) + 1 == len(names)
    if depth <= 1 and not told:
        order[:] = seeds[np.argsort(names, kind="stable")]
        return order
    sort = _small_order if len(names) <= SMALL else suffix_order
    sorted_ = None if told else sort(names, depth // 2 + 1, block, memory)
    for at in range(0, len(order), BLOCK):
        if told:
            order[names[at : at + BLOCK]] = seeds[at : at + BLOCK]
        else:
            order[at : at + BLOCK] = seeds[sorted_[at : at + BLOCK]]
    return order


def _small_order(text: np.ndarray, depth: int, *_) -> np.ndarray:
    """As `suffix_order`, by doubling."""
    rank, step = np.asarray(text, np.int64), 1
    while step < depth:
        _, rank = np.unique(rank * (len(rank) + 1) + np.append(rank[step:] + 1, np.zeros(min(step, len(rank)), np.int64)), return_inverse=True)
        if rank.max() + 1 == len(rank):
            break
        step *= 2
    return np.argsort(rank, kind="stable").astype(np.int32)


def _parted(text: np.ndarray, at: np.ndarray, ranges: np.ndarray, queues: Queues) -> None:
    """Puts positions, in order, into the queues of their symbols' ranges."""
    to = ranges[text[at]]
    sort = np.argsort(to, kind="stable")
    at, to = at[sort], to[sort]
    starts = np.flatnonzero(np.diff(to, prepend=-1))
    for b, e in zip(starts, np.append(starts[1:], len(to))):
        queues.put(to[b], at[b:e].astype(np.int32), np.zeros(e - b, np.int16))


def _all_of(queues: Queues, r: int) -> np.ndarray:
    got = queues.take(r, 1 << 62)
    return np.zeros(0, np.int32) if got is None else got[0]


def _sweep_ranges(text: np.ndarray, is_s: np.ndarray, seeds, ranges: np.ndarray, down: bool, memory: int) -> Iterator[tuple[int, np.ndarray]]:
    """Range by range all positions of a type, induced from the seeds (of each range), in order of the sweep. As `_sweep`, for
    large alphabets: a queue is for a range of symbols, and what is induced within a range is put in its place there."""
    last = int(ranges[-1])
    waiting, single = Queues(last + 1, memory), np.bincount(ranges) == 1

    def before(at: np.ndarray) -> np.ndarray:
        """Which of the positions have one of the wanted type before them."""
        return np.flatnonzero((at > 0) & (is_s[at - 1] == down))

    def one_symbol(r: int) -> Iterator[np.ndarray]:
        """A symbol of its own: its queue first, and what it adds to itself, then its seeds, in blocks."""
        while (got := waiting.take(r, BLOCK)) is not None:
            yield got[0]
            _parted(text, got[0][before(got[0])] - 1, ranges, waiting)
        seed = seeds(r)
        for i in range(0, len(seed), BLOCK):
            own = seed[i : i + BLOCK]
            _parted(text, own[before(own)] - 1, ranges, waiting)

    for r in range(last, -1, -1) if down else range(last + 1):
        if single[r]:
            yield r, np.concatenate([np.zeros(0, np.int32), *one_symbol(r)])
            continue
        came, seed = _all_of(waiting, r), seeds(r)
        at = np.concatenate([came, seed])
        # A run of one symbol goes by its length so far, then as what it began with; other steps take a round each below.
        none = np.zeros(len(at), np.int64)
        last_ones = (at, none - 1, text[at].astype(np.int64), none, np.arange(len(at)), none)
        levels, n = [last_ones], len(at)
        while True:
            at, _, symbol, run, begun, step = last_ones
            fit = before(at)
            led = at[fit] - 1
            own = ranges[text[led]] == r
            led, fit = led[own], fit[own]
            if not len(led):
                break
            same = text[led] == symbol[fit]
            place = np.arange(n, n + len(led))
            last_ones = (led, fit + (n - len(at)), text[led].astype(np.int64), np.where(same, run[fit] + 1, 0), np.where(same, begun[fit], place), step[fit] + ~same)
            levels.append(last_ones)
            n += len(led)
        at, source, symbol, run, begun, step = (np.concatenate(x) for x in zip(*levels)) if len(levels) > 1 else last_ones
        symbol = symbol.max(initial=0) - symbol if down else symbol - symbol.min(initial=0)
        is_seed = np.zeros(len(at), bool)
        is_seed[len(came) : len(came) + len(seed)] = True
        # By symbol, what is induced before the seeds, run, what came from outside before the range's own, then as the sources.
        inside = source[begun] >= 0
        key = (((symbol * 2 + is_seed) * (run.max(initial=0) + 1) + run) * 2 + inside) * len(at)
        own = np.flatnonzero(inside)
        key += np.where(inside, 0, begun)
        order = np.argsort(key)
        if len(own):
            place, led_by = np.empty(len(at), np.int64), source[begun[own]]
            for _ in range(int(step.max())):  # each round puts what is one step further from outside in order
                place[order] = np.arange(len(at))
                now = key.copy()
                now[own] += place[led_by]
                order = np.argsort(now)
        at = at[order]
        yield r, at[~is_seed[order]]
        led = at[before(at)] - 1
        _parted(text, led[ranges[text[led]] != r], ranges, waiting)
    waiting.close()


def suffix_order(text: np.ndarray, depth: int, block: int, memory: int = MEMORY) -> np.ndarray:
    """Positions of all suffixes of a text in order of their first `depth` symbols, by induced sorting and recursion. `text`
    ends with the only 0; a range of symbols holds some `block` suffixes, or one symbol."""
    n, is_s = len(text), s_types(text)
    seeds = seeds_of(is_s)
    counts = np.bincount(text)
    alone = counts > block
    ends = np.cumsum(counts)
    ends -= counts
    del counts
    ends //= block
    opens = alone | (np.diff(ends, prepend=0) > 0)  # a frequent symbol has a range of its own
    opens[1:] |= alone[:-1]
    opens[0] = False
    ranges = np.cumsum(opens, dtype=np.int32)
    del ends, opens, alone
    single = np.bincount(ranges) == 1

    def ordered(r: int, at: np.ndarray) -> np.ndarray:
        return at if single[r] else at[np.argsort(text[at], kind="stable")]

    def both(order: np.ndarray) -> Iterator[np.ndarray]:
        """Of each range, from the last, all suffixes in order; those of the last symbol of all are S-type or not found."""
        first = Queues(int(ranges[-1]) + 1, memory)
        for at in range(0, len(order), BLOCK):
            _parted(text, order[at : at + BLOCK], ranges, first)
        kept, bounds = Written(n, np.int32), {}
        for r, low in _sweep_ranges(text, is_s, lambda r: ordered(r, _all_of(first, r)), ranges, False, memory):
            bounds[r] = kept.n, kept.n + len(low)
            kept.add(low)
        first.close()
        low = lambda r: kept.array[slice(*bounds[r])]
        for r, high in _sweep_ranges(text, is_s, lambda r: ordered(r, low(r))[::-1], ranges, True, memory):
            yield ordered(r, np.concatenate([low(r), high[::-1]]))

    def backwards(parts: Iterator[np.ndarray], size: int) -> np.ndarray:
        """All parts, which come from the last, behind the end of the text, which nothing induces."""
        out, at = on_disk(size, np.int32), size
        for part in parts:
            out[at - len(part) : at] = part
            at -= len(part)
        if at:
            out[0] = n - 1
        return out

    seeded = on_disk(n, bool)
    seeded[seeds] = True
    pieces = backwards((part[seeded[part]] for part in both(seeds)), len(seeds))
    order = _seeds_in_order(seeds, _names(text, seeds, pieces, depth), depth, block, memory)
    return backwards(both(order), n)


def _by_symbol(text: np.ndarray, at: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in order of their symbols, on disk, and where each symbol's begin."""
    counts = np.zeros(symbols, np.int64)
    for i in range(0, len(at), BLOCK):
        counts += np.bincount(text[at[i : i + BLOCK]], minlength=symbols)
    bounds = np.append(0, np.cumsum(counts))
    out, filled = on_disk(len(at), np.int32), bounds[:-1].copy()
    for i in range(0, len(at), BLOCK):
        own = at[i : i + BLOCK]
        own = own[np.argsort(text[own], kind="stable")]
        found, begins = np.unique(text[own], return_index=True)
        for c, b, e in zip(found.tolist(), begins, np.append(begins[1:], len(own))):
            out[filled[c] : filled[c] + e - b] = own[b:e]
            filled[c] += e - b
    return out, bounds


def shared_neighbours(text: np.ndarray, symbols: int, depth: int, memory: int = MEMORY) -> np.ndarray:
    """Positions whose suffix shares `depth` symbols with another. `text` ends with the only 0; symbols are below `symbols`.

    `memory` bounds the tuples that queues hold; arrays over the text are files, and a step takes `BLOCK` elements of them."""
    n = len(text)
    padded, flagged = on_disk(n + depth + 8, np.int16), on_disk(n, bool)
    for i in range(0, n, BLOCK):
        padded[i : i + BLOCK][: n - i] = text[i : i + BLOCK]
    is_s = s_types(padded[:n])
    seeds = seeds_of(is_s)
    order, bounds = _by_symbol(padded, seeds, symbols)

    def blocks(order: np.ndarray, shared: np.ndarray | None):
        def of(c: int) -> Blocks:
            for i in range(bounds[c], bounds[c + 1], BLOCK):
                at = np.array(order[i : min(i + BLOCK, bounds[c + 1])])
                own = np.zeros(len(at), np.int16) if shared is None else np.array(shared[i : i + len(at)])
                own[0] = own[0] if i > bounds[c] else 0
                yield at, own

        return of

    # First round: from seeds in order of one symbol, induction sorts the pieces between seeds.
    seeded = on_disk(n, bool)
    for i in range(0, len(seeds), BLOCK):
        seeded[seeds[i : i + BLOCK]] = True
    _, down = _both(padded, is_s, blocks(order, None), symbols, depth, memory)
    pieces = Written(len(seeds), np.int32)
    if not down.bounds.get(0):
        pieces.add(np.array([n - 1], np.int32))
    for c in range(symbols):
        for at, _ in down.blocks(c, True):
            pieces.add(at[seeded[at]])
    order = _seeds_in_order(seeds, _names(padded, seeds, pieces.done(), depth), depth, RANGE, memory)
    shared = Written(len(order), np.int16)
    for i in range(0, len(order), BLOCK):
        own = order[max(0, i - 1) : i + BLOCK]
        shared.add(np.append(np.zeros(0 if i else 1, np.int16), _shared(padded, own[1:], own[:-1], depth)))
    rising, falling = _both(padded, is_s, blocks(order, shared.done()), symbols, depth, memory)
    for c in range(symbols):
        last = None
        for part in (rising.blocks(c), falling.blocks(c, True)):
            for i, (at, common) in enumerate(part):
                if last is not None:
                    first = common[0] if i else _shared(padded, np.array([last]), at[:1], depth)[0]
                    flagged[[last, at[0]]] |= first >= depth
                deep = np.flatnonzero(common[1:] >= depth) + 1
                flagged[at[deep]] = True
                flagged[at[deep - 1]] = True
                last = at[-1]
    return np.flatnonzero(flagged)
