"""Connected sets of a graph's atoms as bitmaps, grown many at a time in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Sets that grow at once.
CHUNK = 1 << 14


class Molecules:
    """The molecules of a batch: each atom's neighbours as a bitmap over its molecule's atoms, in 64-bit words."""

    def __init__(self, adj: pa.MapArray):
        adj = adj.combine_chunks() if isinstance(adj, pa.ChunkedArray) else adj
        sizes = np.diff(adj.offsets.to_numpy())
        ids, near = adj.keys.to_numpy().astype(np.int64), adj.items
        first = np.cumsum(sizes) - sizes
        base = adj.offsets.to_numpy()[0] if len(adj.offsets) else 0
        ids, near = ids[base : base + sizes.sum()], near.slice(base, int(sizes.sum()))
        mol = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort([ids, mol])  # atoms by number
        self.ids, self.first, self.sizes = ids[order], first, sizes
        self.words = np.maximum(-(-sizes // 64), 1)
        self.width = int(self.words.max(initial=1))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        degree = near.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        ends, owner = near.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(len(ids)), degree)
        span = int(max(ids.max(initial=0), ends.max(initial=0))) + 1
        known = mol[order] * span + self.ids
        at = np.searchsorted(known, mol[owner] * span + ends)
        at = np.minimum(at, max(len(known) - 1, 0))
        real = known[at] == mol[owner] * span + ends if len(ends) else np.zeros(0, bool)
        bit = at[real] - first[mol[owner[real]]]
        self.near = np.zeros((len(ids), self.width), U)
        np.bitwise_or.at(self.near, (place[owner[real]], bit // 64), U(1) << (bit % 64).astype(U))
        most = int(sizes.max(initial=0))
        self.above = np.zeros((most + 1, self.width), U)  # bits greater than a place
        for p in range(most):
            for w in range(self.width):
                lo = max(p + 1 - 64 * w, 0)
                self.above[p, w] = U(0xFFFFFFFFFFFFFFFF) << U(lo) if lo < 64 else U(0)


class Sets:
    """Sets of one size: their molecule, atoms' places in the order of growth, distances from the first, bitmap."""

    def __init__(self, mol: np.ndarray, path: np.ndarray, dist: np.ndarray, mask: np.ndarray):
        self.mol, self.path, self.dist, self.mask = mol, path, dist, mask

    def __len__(self) -> int:
        return len(self.mol)

    def part(self, a: int, b: int) -> Sets:
        return Sets(self.mol[a:b], self.path[a:b], self.dist[a:b], self.mask[a:b])


def starts(mols: Molecules, only: np.ndarray | None = None) -> Sets:
    """Each atom (or one atom's place of each molecule) as a set."""
    mol = np.repeat(np.arange(len(mols.sizes)), mols.sizes if only is None else 1)
    place = np.arange(len(mol)) - np.repeat(mols.first, mols.sizes) if only is None else only
    mask = np.zeros((len(mol), mols.width), U)
    mask[np.arange(len(mol)), place // 64] = U(1) << (place % 64).astype(U)
    return Sets(mol, place[:, None], np.zeros((len(mol), 1), np.int64), mask)


def grown(mols: Molecules, sets: Sets) -> Sets:
    """What sets grow to by one atom.

    A neighbour of a set joins if its number is greater than the first atom's and, by distance then number, it comes after
    the last one; so each connected set is made once, in the order of its growth.
    """
    k = sets.path.shape[1]
    far, last = sets.dist[:, -1], sets.path[:, -1]
    allowed = mols.above[sets.path[:, 0]] & ~sets.mask
    reached = np.zeros_like(sets.mask)
    rows, places, dists = [], [], []
    for s in range(k):  # atoms stand by distance: the first that touches a neighbour gives its distance
        near = mols.near[mols.first[sets.mol] + sets.path[:, s]] & allowed & ~reached
        reached |= near
        d = sets.dist[:, s] + 1
        near = np.where((d > far)[:, None], near, np.where((d == far)[:, None], near & mols.above[last], U(0)))
        for w in range(mols.width):
            row, word = np.flatnonzero(near[:, w]), near[:, w][near[:, w] != 0]
            while len(row):
                low = word & (~word + U(1))
                rows.append(row)
                places.append(np.bitwise_count(low - U(1)).astype(np.int64) + 64 * w)
                dists.append(d[row])
                word = word ^ low
                row, word = row[word != 0], word[word != 0]
    row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    place, d = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (places, dists))
    mask = sets.mask[row]
    mask[np.arange(len(row)), place // 64] |= U(1) << (place % 64).astype(U)
    return Sets(sets.mol[row], np.c_[sets.path[row], place], np.c_[sets.dist[row], d], mask)


def connected(mols: Molecules, first: Sets, most: int | None) -> Iterator[Sets]:
    """All connected sets of up to ``most`` atoms, a bounded number at a time: the deepest sets grow first."""
    waiting = [first.part(a, a + CHUNK) for a in range(0, len(first), CHUNK)]
    while waiting:
        sets = waiting.pop()
        yield sets
        if most is None or sets.path.shape[1] < most:
            more = grown(mols, sets)
            waiting += [more.part(a, a + CHUNK) for a in range(0, len(more), CHUNK)]


def columns(mols: Molecules, sets: Sets) -> list[pa.Array]:
    """``path, atoms, size, mask`` as Arrow arrays."""
    n, k = sets.path.shape
    ends = pa.array(np.arange(0, n * k + 1, k, dtype=np.int32))
    path = mols.ids[mols.first[sets.mol][:, None] + sets.path]
    words = mols.words[sets.mol]
    inside = np.arange(mols.width)[None, :] < words[:, None]
    mask = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(words)].astype(np.int32)), pa.array(sets.mask.view(np.int64)[inside]))
    lists = [pa.ListArray.from_arrays(ends, pa.array(x.ravel().astype(np.int32))) for x in (path, np.sort(path, axis=1))]
    return [*lists, pa.array(np.full(n, k, np.int32)), mask]


#: Bits of a place in a path's key, so that keys order as paths do, and the longest path that has one.
PLACE_BITS, KEYED = 5, 12
#: Pairs that are looked at together.
PAIRS = 1 << 20


class Pairs:
    """Sets of small molecules and their disjoint pairs, one for each union: the first by path order."""

    def __init__(self, parts: list[Sets], most: int):
        self.mol = np.concatenate([p.mol for p in parts])
        self.size = np.concatenate([np.full(len(p), p.path.shape[1]) for p in parts])
        self.mask = np.concatenate([p.mask[:, 0] for p in parts])
        self.path = np.concatenate([np.pad(p.path, ((0, 0), (0, KEYED - p.path.shape[1])), constant_values=-1) for p in parts])
        self.key = ((self.path + 1) << PLACE_BITS * np.arange(KEYED - 1, -1, -1)).sum(axis=1)
        order = np.lexsort([self.key, self.size, self.mol])
        for name in ("mol", "size", "mask", "path", "key"):
            setattr(self, name, getattr(self, name)[order])
        self.alone = np.flatnonzero(self.size <= most)
        self.first, self.second = self.pairs(most)

    def pairs(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.mol)
        span = int(self.size.max(initial=0)) + 2
        code = self.mol * span + self.size
        room = np.minimum(most - self.size, self.size)  # the partner is no larger
        begin = np.searchsorted(code, self.mol * span)
        end = np.where(room > 0, np.searchsorted(code, self.mol * span + room, side="right"), begin)
        end = np.minimum(end, np.where(room == self.size, np.arange(n), end))  # of one size, the one that stands before
        many = np.maximum(end - begin, 0)
        upto = np.cumsum(many)
        known = np.unique(self.mol << 40 | self.mask.astype(np.int64))  # molecules of up to 40 atoms
        best = np.zeros((0, 4), np.int64)
        a = 0
        while a < n:
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, side="right")))
            left = np.repeat(np.arange(a, b), many[a:b])
            right = np.arange(len(left)) - np.repeat(np.cumsum(many[a:b]) - many[a:b], many[a:b]) + begin[left]
            fit = (self.mask[left] & self.mask[right]) == 0
            left, right = left[fit], right[fit]
            union = self.mol[left] << 40 | (self.mask[left] | self.mask[right]).astype(np.int64)
            new = ~np.isin(union, known)
            left, right, union = left[new], right[new], union[new]
            swap = self.key[left] > self.key[right]
            left, right = np.where(swap, right, left), np.where(swap, left, right)
            best = np.concatenate([best, np.stack([union, self.key[left], self.key[right], left * n + right], axis=1)])
            best = best[np.lexsort([best[:, 2], best[:, 1], best[:, 0]])]
            best = best[np.r_[True, best[1:, 0] != best[:-1, 0]]] if len(best) else best
            a = b
        return best[:, 3] // max(n, 1), best[:, 3] % max(n, 1)

    def columns(self, mols: Molecules) -> tuple[np.ndarray, list[pa.Array]]:
        """Each row's molecule, and ``atoms, components, paths, num_components, size, mask``."""
        single, pair = len(self.alone), len(self.first)
        sets = np.r_[self.alone, np.stack([self.first, self.second], axis=1).ravel()]
        ends = np.r_[np.arange(single), single + 2 * np.arange(pair + 1)]
        atoms = np.where(self.path[sets] >= 0, mols.ids[np.minimum(mols.first[self.mol[sets]][:, None] + self.path[sets], max(len(mols.ids) - 1, 0))], np.iinfo(np.int64).max)
        length = self.size[sets]
        inner = np.r_[0, np.cumsum(length)].astype(np.int32)
        ordered = np.sort(atoms, axis=1)
        inside = np.arange(KEYED)[None, :] < length[:, None]
        outer = pa.array(ends.astype(np.int32))
        nested = [pa.ListArray.from_arrays(outer, pa.ListArray.from_arrays(pa.array(inner), pa.array(x[inside].astype(np.int32)))) for x in (ordered, atoms)]
        mol = np.r_[self.mol[self.alone], self.mol[self.first]]
        size = np.r_[self.size[self.alone], self.size[self.first] + self.size[self.second]]
        both = np.concatenate([np.full((single, KEYED), np.iinfo(np.int64).max), ordered[single + 1 :: 2]])
        union = np.sort(np.concatenate([np.concatenate([ordered[:single], ordered[single::2]]), both], axis=1), axis=1)
        whole = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(union[np.arange(2 * KEYED)[None, :] < size[:, None]].astype(np.int32)))
        mask = np.r_[self.mask[self.alone], self.mask[self.first] | self.mask[self.second]].view(np.int64)
        masks = pa.ListArray.from_arrays(pa.array(np.arange(len(mol) + 1, dtype=np.int32)), pa.array(mask))
        return mol, [whole, *nested, pa.array(np.repeat([1, 2], [single, pair]).astype(np.int32)), pa.array(size.astype(np.int32)), masks]


#: Sets, at most (by the numbers of atoms), of the shapes whose sets are made together, and of those that a task keeps.
BLOCK, HELD = 1 << 18, 1 << 20


class Shape:
    """The atom sets of all molecules of one shape, by size, parts and path: bitmaps of places, sizes, parts, and paths of two parts (-1 where none)."""

    def __init__(self, atoms: int, mask: np.ndarray, size: np.ndarray, parts: np.ndarray, paths: np.ndarray):
        self.atoms, self.mask, self.size, self.parts, self.paths = atoms, mask, size, parts, paths
        self.inside = (mask[:, None] >> np.arange(atoms) & 1).astype(float)

    def least(self, enough: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and sets of ``enough`` (a row for each molecule, a column for each set) that have no smaller one of their row inside."""
        row, one = np.nonzero(enough)
        above = np.zeros((len(enough), 1 << self.atoms), bool)  # by bitmap: whether one of the sets is inside
        above[row, self.mask[one]] = True
        for b in range(self.atoms):
            halves = above.reshape(len(enough), -1, 2, 1 << b)
            halves[:, :, 1] |= halves[:, :, 0]
        mask, smaller = self.mask[one], np.zeros(len(row), bool)
        for b in range(self.atoms):
            smaller |= (mask >> b & 1).astype(bool) & above[row, mask & ~(1 << b)]
        return row[~smaller], one[~smaller]


class Shapes:
    """Molecules of up to 16 atoms by their shape, which is each atom's neighbours by place: those of one shape have the same sets."""

    def __init__(self, max_subgraph: int, most: int):
        self.sizes, self.known, self.held = (max_subgraph, most), {}, 0

    def each(self, mols: Molecules, adj: pa.MapArray) -> Iterator[tuple[Shape, np.ndarray]]:
        """Each shape of ``mols`` (made of ``adj``) and the rows that have it; a shape's sets are made once, and kept while there is room."""
        width = int(mols.sizes.max(initial=0))
        code = np.zeros((len(mols.sizes), width + 1), np.uint32)
        code[:, 0] = mols.sizes
        mol = np.repeat(np.arange(len(mols.sizes)), mols.sizes)
        code[mol, 1 + np.arange(len(mol)) - np.repeat(np.cumsum(mols.sizes) - mols.sizes, mols.sizes)] = mols.near[:, 0]
        kinds, first, group = np.unique(code, axis=0, return_index=True, return_inverse=True)
        order = np.argsort(group.ravel(), kind="stable")
        rows = np.split(order, np.cumsum(np.bincount(group.ravel()))[:-1])
        keys = [k[: 1 + k[0]].tobytes() for k in kinds]
        fresh = np.array([i for i, key in enumerate(keys) if key not in self.known], np.int64)
        for i, key in enumerate(keys):
            if key in self.known:
                yield self.known[key], rows[i]
        room = np.cumsum(1 << kinds[fresh, 0].astype(np.int64)) // BLOCK
        for some in np.split(fresh, np.flatnonzero(np.diff(room)) + 1):
            for i, shape in zip(some, self.made(adj.take(pa.array(first[some]))) if len(some) else [], strict=True):
                if self.held + len(shape.mask) <= HELD:
                    self.known[keys[i]] = shape
                    self.held += len(shape.mask)
                yield shape, rows[i]

    def made(self, adj: pa.MapArray) -> list[Shape]:
        mols = Molecules(adj)
        sets = Pairs(list(connected(mols, starts(mols), self.sizes[0])), self.sizes[1])
        one, two = np.r_[sets.alone, sets.first], np.r_[np.full(len(sets.alone), -1), sets.second]
        pair = two >= 0
        order = np.lexsort([np.where(pair, sets.key[two], 0), sets.key[one], pair, sets.size[one] + np.where(pair, sets.size[two], 0), sets.mol[one]])
        one, two, pair = one[order], two[order], pair[order]
        mask = (sets.mask[one] | np.where(pair, sets.mask[two], U(0))).astype(np.int64)
        paths = np.stack([sets.path[one], np.where(pair[:, None], sets.path[two], -1)], axis=1).astype(np.int8)
        ends = np.searchsorted(sets.mol[one], np.arange(len(adj) + 1))
        size = np.bitwise_count(mask).astype(np.int32)
        return [Shape(int(n), mask[a:b], size[a:b], 1 + pair[a:b].astype(np.int32), paths[a:b]) for n, a, b in zip(mols.sizes, ends, ends[1:], strict=False)]


def counts(count: int, parts: Iterator[Sets], most: int) -> tuple[np.ndarray, ...]:
    """Molecule, size, number of parts, combinations and different atom sets of ``count`` molecules of up to 40 atoms: single sets and disjoint pairs of up to ``most`` atoms."""
    found = [(p.mol, np.full(len(p), p.path.shape[1]), p.mask[:, 0].astype(np.int64)) for p in parts]
    mol, size, mask = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else ([], [], [])))
    fit = size <= most
    order = np.lexsort([size[fit], mol[fit]])
    mol, size, mask = mol[fit][order], size[fit][order], mask[fit][order]
    n, span = len(mol), most + 1
    code = mol * span + size
    tally = lambda codes: np.bincount(codes, minlength=count * span)
    room = np.minimum(most - size, size)  # the partner is no larger
    begin = np.searchsorted(code, mol * span)
    end = np.where(room > 0, np.searchsorted(code, mol * span + room, side="right"), begin)
    end = np.where(room == size, np.minimum(end, np.arange(n)), end)  # of one size, the one that stands before
    many = np.maximum(end - begin, 0)
    upto = np.cumsum(many)
    one, two, distinct, a = tally(code), tally(code[:0]), tally(code[:0]), 0
    held = np.zeros(0, np.int64)
    while a < n:
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, side="right")))
        left = np.repeat(np.arange(a, b), many[a:b])
        right = np.arange(len(left)) - np.repeat(np.cumsum(many[a:b]) - many[a:b], many[a:b]) + begin[left]
        apart = (mask[left] & mask[right]) == 0
        left, right = left[apart], right[apart]
        two += tally(code[left] + size[right])
        held = np.unique(np.concatenate([held, mol[left] << 40 | mask[left] | mask[right]]))
        done = np.searchsorted(held, mol[b] << 40) if b < n else len(held)  # molecules that no later set belongs to
        distinct += tally((held[:done] >> 40) * span + np.bitwise_count(held[:done] & ((1 << 40) - 1)))
        held, a = held[done:], b
    single, pair = np.flatnonzero(one), np.flatnonzero(two)
    place = np.r_[single, pair]
    return place // span, place % span, np.repeat([1, 2], [len(single), len(pair)]), np.r_[one[single], two[pair]], np.r_[one[single], distinct[pair]]


def words_of(masks: pa.ListArray) -> np.ndarray:
    """Bitmaps as rows of as many words as the longest has."""
    n = masks.value_lengths().to_numpy().astype(np.int64)
    values = masks.flatten().to_numpy().view(U)
    out = np.zeros((len(n), int(n.max(initial=1))), U)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)] = values
    return out


def stacked(parts: list[np.ndarray]) -> np.ndarray:
    """Bitmaps one under another, filled to the widest."""
    width = max(p.shape[1] for p in parts)
    return np.concatenate([np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in parts])


def has_inside(masks: np.ndarray, smaller: np.ndarray) -> np.ndarray:
    """Whether each bitmap has one of ``smaller`` as a subset."""
    out = np.zeros(len(masks), bool)
    if not len(smaller) or not len(masks):
        return out
    width = max(masks.shape[1], smaller.shape[1])
    masks, smaller = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (masks, smaller))
    step = max(1, (1 << 20) // len(masks))
    for a in range(0, len(smaller), step):
        some = smaller[a : a + step]
        left = np.flatnonzero(~out)
        if not len(left):
            break
        rest = np.zeros((len(left), len(some)), bool)
        for w in range(width):
            rest |= (some[None, :, w] & ~masks[left, w, None]) != 0
        out[left] = ~rest.all(axis=1)
    return out
