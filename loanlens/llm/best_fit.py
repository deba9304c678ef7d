"""Bin packing of a length histogram: best fit, then swap-based local search.

Pieces of equal length are interchangeable, so a packing is a list of bin *kinds* (a tuple of
lengths) with a multiplicity.  The histogram has at most ``capacity`` entries whatever the number of
pieces, and best fit in bulk adds at most a few kinds per length, so the search is as large for a
thousand pieces as for 10^12: it runs on the driver on the histogram alone, while ranking pieces
within their length and placing them are Spark jobs."""

from __future__ import annotations

import functools
from bisect import bisect_right
from collections import Counter


def best_fit(hist: dict[int, int], capacity: int) -> Counter:
    """Best-fit decreasing, many equal bins at once: {kind: number of bins}."""
    room: dict[int, Counter] = {}  # free space -> kinds with that space

    def put(kind: tuple, n: int) -> None:
        room.setdefault(capacity - sum(kind), Counter())[kind] += n

    for length in sorted((x for x, n in hist.items() if n), reverse=True):
        left = hist[length]
        for free in sorted(f for f in room if f >= length):  # the fullest bins first
            kinds = room.pop(free)
            for kind, n in sorted(kinds.items()):
                k = free // length  # sequential best fit puts as many as go into the bin it has just used
                full = min(n, left // k)
                if full:
                    put(kind + (length,) * k, full)
                    left -= full * k
                if full < n and left:  # 0 < left < k
                    put(kind + (length,) * left, 1)
                    full, left = full + 1, 0
                if full < n:
                    put(kind, n - full)
            if not left:
                break
        k = capacity // length
        if left // k:
            put((length,) * k, left // k)
        if left % k:
            put((length,) * (left % k), 1)
    return Counter({kind: n for kinds in room.values() for kind, n in kinds.items()})


@functools.lru_cache(maxsize=50_000)
def _gives(kind: tuple) -> tuple[list, list, dict]:
    """What a bin of this kind can give: its lengths, the sums of two of them, and the two of each sum."""
    pairs: dict = {}
    for i, a in enumerate(kind):
        for b in kind[i + 1:]:
            pairs[a + b] = max(pairs.get(a + b, ()), (a, b))
    return sorted(set(kind)), sorted(pairs), pairs


def _exchanges(receiver: tuple, donor: tuple, free: int):
    """The exchange that fills the receiver most: (gain, given by the donor, given back), or None.
    Kinds of exchange: move one; one for one; two for one.  For each length given back the largest that fits is found in
    sorted lists; of equal gains the one that gives back more, then the one that gives a longer piece."""
    singles, sums, pairs = _gives(donor)
    best = None
    for back in (0, *_gives(receiver)[0]):
        k = bisect_right(singles, free + back)
        if k and singles[k - 1] > back:
            found = (singles[k - 1] - back, back, (singles[k - 1],))
            best = found if best is None or found > best else best
        if back:
            k = bisect_right(sums, free + back)
            if k and sums[k - 1] > back:
                found = (sums[k - 1] - back, back, pairs[sums[k - 1]])
                best = found if best is None or found > best else best
    return best and (best[0], best[2], (best[1],) if best[1] else ())


def _changed(kind: tuple, less: tuple, more: tuple) -> tuple:
    c = Counter(kind)
    c.subtract(less)
    c.update(more)
    return tuple(sorted(c.elements(), reverse=True))


def local_search(bins: Counter, capacity: int) -> Counter:
    """Exchange documents between underfull bins (move, one for one, two for one) as long as the sum
    of squared fills grows; a bin that becomes empty goes.  Each step applies one exchange to as many
    equal pairs of bins as there are.  Ends at the lower bound on bins or when no exchange helps, which it does because
    squared fill grows at each step.

    Whether a pair of kinds has an exchange does not depend on how many there are, so kinds are numbered as they appear
    and each donor remembers up to which number it has found none: after a step it looks at the new kinds only."""
    bins = bins_sorted(bins)
    bound = -(-sum(sum(k) * n for k, n in bins.items()) // capacity)
    number: dict[tuple, int] = {}
    order: list[tuple] = []  # (free space, kind) by number
    by_free: dict[int, set] = {}  # free space -> underfull kinds there are

    def note(kind: tuple) -> None:
        free = capacity - sum(kind)
        if kind and free:
            if kind not in number:
                number[kind] = len(order)
                order.append((free, kind))
            by_free.setdefault(free, set()).add(kind)

    for kind in sorted(bins):
        note(kind)
    looked: dict[tuple, int] = {}  # donor -> kinds before this number have no exchange with it

    def find():
        for free in sorted(by_free, reverse=True):  # emptiest donors first
            for donor in sorted(by_free[free]):
                begin = looked.get(donor, 0)
                if begin == len(order):
                    continue
                alone = False
                for room, receiver in sorted(x for x in order[begin:] if x[1]):  # fullest receivers first
                    if room <= free:
                        if donor == receiver and bins[donor] == 1:
                            alone = True  # may have a partner later
                        elif found := _exchanges(receiver, donor, room):
                            return donor, receiver, found
                # kinds that are gone are noted anew, with a new number, when they come back
                looked[donor] = number[donor] if alone else len(order)
        return None

    while bins.total() > bound and (step := find()):
        donor, receiver, (_, give, back) = step
        n = bins[donor] // 2 if donor == receiver else min(bins[donor], bins[receiver])
        for kind, by in ((donor, -n), (receiver, -n), (_changed(donor, give, back), n), (_changed(receiver, back, give), n)):
            bins[kind] += by
            if not kind or bins[kind] == 0:
                del bins[kind]
                free = capacity - sum(kind)
                if kind in by_free.get(free, ()):
                    by_free[free].discard(kind)
                    if not by_free[free]:
                        del by_free[free]
                    order[number.pop(kind)] = (free, ())
            else:
                note(kind)
    return bins


def bins_sorted(bins: Counter) -> Counter:
    out: Counter = Counter()
    for kind, n in bins.items():
        out[tuple(sorted(kind, reverse=True))] += n
    return out


def pack(hist: dict[int, int], capacity: int) -> Counter:
    """{kind: number of bins} for a histogram of lengths, each of 1 to ``capacity``."""
    return local_search(best_fit(hist, capacity), capacity)


def placement(bins: Counter) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, number, first bin, offset): the pieces of that length with these ranks go
    one each to consecutive bins, at this offset."""
    out, used, first = [], Counter(), 0
    for kind, n in sorted(bins.items(), reverse=True):
        at = 0
        for length in kind:
            out.append((length, used[length], n, first, at))
            used[length] += n
            at += length
        first += n
    return out
