"""Neighbours, spanning trees, average linkage and Gaussian affinities of many rows, exact and without a matrix of all pairs.

Rows are cut into boxes of close ones (`Leaves`); a search meets only boxes that may hold a better answer than the one it has."""

from __future__ import annotations

import numpy as np


class Leaves:
    """Rows in an order in which stretches of at most `size` lie close together, cut at medians along the widest side."""

    def __init__(self, x: np.ndarray, size: int = 64):
        order, stack, start = np.arange(len(x)), [(0, len(x))], []
        while stack:
            lo, hi = stack.pop()
            if hi - lo <= size:
                start.append(lo)
                continue
            part = x[order[lo:hi]]
            mid = (hi - lo) // 2
            order[lo:hi] = order[lo:hi][np.argpartition(part[:, np.ptp(part, axis=0).argmax()], mid)]
            stack += [(lo, lo + mid), (lo + mid, hi)]
        self.order, self.start = order, np.sort(start)
        self.end = np.append(self.start[1:], len(x))
        self.x = x[order]
        self.low, self.high = np.minimum.reduceat(self.x, self.start, axis=0), np.maximum.reduceat(self.x, self.start, axis=0)

    def apart(self, i: int) -> np.ndarray:
        """Least distance of a row of leaf i from one of each leaf."""
        return np.sqrt((np.maximum(0, np.maximum(self.low - self.high[i], self.low[i] - self.high)) ** 2).sum(1)) * (1 - 1e-9)

    def rows(self, leaves: np.ndarray) -> np.ndarray:
        n = self.end[leaves] - self.start[leaves]
        return np.arange(n.sum()) + np.repeat(self.start[leaves] - (np.cumsum(n) - n), n)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Seen from the middle of a, so that close rows far from the origin keep their digits."""
    a, b = a - (middle := a.mean(0)), b - middle
    return np.sqrt(np.maximum(0, (a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T))


def core_distances(x: np.ndarray, k: int) -> np.ndarray:
    """Distance to the k-th nearest row, itself the first."""
    tree, k = Leaves(x), min(len(x), k)
    out = np.empty(len(x))
    for i, (s, e) in enumerate(zip(tree.start, tree.end, strict=True)):
        apart = tree.apart(i)
        near = np.argsort(apart, kind="stable")
        enough = near[: int(np.searchsorted(np.cumsum((tree.end - tree.start)[near]), k)) + 1]
        kth = np.partition(distances(tree.x[s:e], tree.x[tree.rows(enough)]), k - 1, 1)[:, k - 1]
        within = np.flatnonzero(apart <= kth.max())
        if len(within) > len(enough) or len(np.setdiff1d(within, enough)):
            kth = np.partition(distances(tree.x[s:e], tree.x[tree.rows(within)]), k - 1, 1)[:, k - 1]
        out[tree.order[s:e]] = kth
    return out


def find(up: list[int], i: int) -> int:
    while up[i] != i:
        up[i] = up[up[i]]
        i = up[i]
    return i


def reachability_tree(x: np.ndarray, core: np.ndarray) -> list[tuple[float, int, int]]:
    """Sorted edges of a minimum spanning tree where two rows are max(distance, core, core) apart (Boruvka): in each round every
    component gets its lightest edge to another one."""
    n, tree = len(x), Leaves(x)
    c, comp, lower = core[tree.order], np.arange(n), core[tree.order].copy()  # no edge of a row out of its component is lighter than lower
    known, weight = np.full(n, -1), np.full(n, np.inf)  # the lightest such edge met so far, and where it leads
    up, edges, parts = list(range(n)), [], n
    while parts > 1:
        weight[(known >= 0) & (comp[known] == comp)] = np.inf
        known[np.isinf(weight)] = -1
        best, at = np.full(n, np.inf), np.full(n, -1)

        def offer(rows: np.ndarray) -> None:
            rows = rows[known[rows] >= 0]
            rows = rows[np.argsort(weight[rows], kind="stable")]
            own, first = np.unique(comp[rows], return_index=True)
            rows = rows[first]
            better = weight[rows] < best[own]
            best[own[better]], at[own[better]] = weight[rows[better]], rows[better]

        offer(np.arange(n))
        first = comp[tree.start]
        whole = np.where(np.minimum.reduceat(comp, tree.start) == np.maximum.reduceat(comp, tree.start), first, -1)
        for i, (s, e) in enumerate(zip(tree.start, tree.end, strict=True)):
            if not (lower[s:e] < best[comp[s:e]]).any():
                continue
            apart = tree.apart(i)
            order = np.argsort(apart, kind="stable")
            order = order[(whole[order] != whole[i]) | (whole[order] < 0)]
            done, step = 0, 8
            while done < len(order):
                rows = s + np.flatnonzero(lower[s:e] < best[comp[s:e]])
                if not len(rows) or apart[order[done]] >= best[comp[rows]].max():
                    break
                met = tree.rows(order[done : done + step])
                w = np.maximum(np.maximum(distances(tree.x[rows], tree.x[met]), c[rows, None]), c[None, met])
                w[comp[rows][:, None] == comp[met][None]] = np.inf
                j = w.argmin(1)
                w = w[np.arange(len(rows)), j]
                better = w < weight[rows]
                known[rows[better]], weight[rows[better]] = met[j[better]], w[better]
                offer(rows)
                done, step = done + step, step * 2
                # what has not been met yet is at least this far
                rest = apart[order[done]] if done < len(order) else np.inf
                lower[rows] = np.maximum(lower[rows], np.minimum(weight[rows], rest))
        chosen = np.unique(at[at >= 0])
        for a in chosen[np.argsort(weight[chosen], kind="stable")].tolist():
            b = int(known[a])
            ra, rb = find(up, a), find(up, b)
            if ra != rb:
                up[rb] = ra
                edges.append((float(weight[a]), int(tree.order[a]), int(tree.order[b])))
                parts -= 1
        while True:  # every row gets the root of its component
            root = np.array(up)
            if (root[root] == root).all():
                break
            up = root[root].tolist()
        comp = root
    return sorted(edges)


class AverageLinkage:
    """The tree of average linkage in Euclidean space: all pairs of clusters that are each other's nearest merge at once, round by round,
    which gives the tree of merging the nearest two one after another, as no merge brings clusters nearer to a third.

    The mean distance of two clusters is at least that of their centers and at most the root of its square plus both variances. Where
    this does not tell which is nearer, the clusters are taken apart along the tree until it does, to single rows if need be."""

    MOST = 1 << 20
    SLACK = 1e-10

    def __init__(self, x: np.ndarray):
        n, p = x.shape
        self.center, self.var, self.size = np.empty((2 * n - 1, p)), np.zeros(2 * n - 1), np.ones(2 * n - 1)
        self.kids = np.full((2 * n - 1, 2), -1)
        self.center[:n] = x
        active, nearest, nodes = np.arange(n), np.full(2 * n - 1, -1), n
        todo = active
        while len(active) > 1:
            nearest[todo] = self._nearest(active, todo)
            other = nearest[active]
            a = active[(nearest[other] == active) & (active < other)]
            if not len(a):  # only where rounding makes equal distances differ
                a = todo[:1]
            b = nearest[a]
            new = np.arange(nodes, nodes + len(a))
            nodes += len(a)
            self.kids[new, 0], self.kids[new, 1] = a, b
            na, nb = self.size[a], self.size[b]
            self.size[new] = na + nb
            off = ((self.center[a] - self.center[b]) ** 2).sum(1)
            self.center[new] = (self.center[a] * na[:, None] + self.center[b] * nb[:, None]) / (na + nb)[:, None]
            self.var[new] = (self.var[a] * na + self.var[b] * nb) / (na + nb) + off * na * nb / (na + nb) ** 2
            gone = np.zeros(nodes, bool)
            gone[a] = gone[b] = True
            active = np.append(active[~gone[active]], new)
            old = active[active < new[0]]
            todo = np.append(old[gone[nearest[old]]], new)
        self.rows, self.root = n, nodes - 1

    def _bounds(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        square = ((self.center[a] - self.center[b]) ** 2).sum(1)
        return np.sqrt(square), np.sqrt(square + self.var[a] + self.var[b])

    def _nearest(self, active: np.ndarray, todo: np.ndarray) -> np.ndarray:
        tree, wanted = Leaves(self.center[active]), np.zeros(2 * len(self.var), bool)
        wanted[todo] = True
        ids = active[tree.order]
        place = np.full(len(self.var), -1)
        place[todo] = np.arange(len(todo))
        rows, pairs = [], []
        for i, (s, e) in enumerate(zip(tree.start, tree.end, strict=True)):
            own = s + np.flatnonzero(wanted[ids[s:e]])
            if not len(own):
                continue

            def ranges(met: np.ndarray, own: np.ndarray = own) -> tuple[np.ndarray, np.ndarray]:
                low = distances(tree.x[own], tree.x[met])
                low[own[:, None] == met[None]] = np.inf
                return low, np.sqrt(low**2 + self.var[ids[own]][:, None] + self.var[ids[met]][None])

            most = ranges(np.arange(s, e))[1].min(1)
            met = tree.rows(np.flatnonzero(tree.apart(i) <= most.max()))
            low, high = ranges(met)
            r, j = np.nonzero(low <= high.min(1)[:, None] * (1 + self.SLACK) + self.SLACK * 1e-6)
            rows.append(place[ids[own[r]]])
            pairs.append(ids[met[j]])
        row, b = np.concatenate(rows), np.concatenate(pairs)
        o = np.lexsort((b, row))
        return self._choose(row[o], todo[row[o]], b[o], len(todo))

    def _choose(self, row: np.ndarray, a: np.ndarray, b: np.ndarray, n: int, largest: bool = False) -> np.ndarray:
        """For each of n rows the b of its pair (a, b) of the least mean distance, the first on ties; or the place of the pair of the largest."""
        answer = np.full(n, -1)
        value = np.arange(len(row)) if largest else b
        count = np.bincount(row, minlength=n)
        alone = count[row] == 1
        answer[row[alone]] = value[alone]
        left = np.flatnonzero(~alone)
        if not len(left):
            return answer
        # some rows at a time, whole ones
        cut = np.flatnonzero(np.append(True, row[left][1:] != row[left][:-1]))
        at = 0
        while at < len(cut):
            end = min(len(cut), at + max(1, self.MOST // 64))
            part = left[cut[at] : cut[end] if end < len(cut) else len(left)]
            self._settle(row[part], a[part], b[part], value[part], answer, largest)
            at = end
        return answer

    def _settle(self, row, a, b, value, answer, largest) -> None:
        # pieces (a, b, their share of the pair's products), the pair that they belong to, and what is known of the rest of it
        lo_id, hi_id = np.minimum(a, b), np.maximum(a, b)  # the same sums for (a, b) and (b, a)
        pa, pb, pair, share = lo_id, hi_id, np.arange(len(row)), np.ones(len(row))
        fixed, open_ = np.zeros(len(row)), np.ones(len(row), bool)
        rows, row_of = np.unique(row, return_inverse=True)
        while True:
            low, high = self._bounds(pa, pb)
            least = fixed + np.bincount(pair, share * low, len(row))
            most = fixed + np.bincount(pair, share * high, len(row))
            if largest:
                least, most = -most, -least
            bound = np.full(len(rows), np.inf)
            np.minimum.at(bound, row_of[open_], most[open_])
            reach = bound[row_of]
            open_ &= least <= reach + np.abs(reach) * self.SLACK + self.SLACK * 1e-6
            unsure = np.bincount(row_of[open_ & (most - least > np.abs(most) * self.SLACK)], minlength=len(rows)) > 0
            several = np.bincount(row_of[open_], minlength=len(rows)) > 1
            over = ~(several & unsure)
            ready = np.flatnonzero(open_ & over[row_of])
            ready = ready[np.lexsort((value[ready], least[ready].round(12), row_of[ready]))]
            first = ready[np.append(True, row_of[ready][1:] != row_of[ready][:-1])] if len(ready) else ready
            answer[rows[row_of[first]]] = value[first]
            open_ &= ~over[row_of]
            if not open_.any():
                return
            keep = open_[pair]
            pa, pb, pair, share, low, high = pa[keep], pb[keep], pair[keep], share[keep], low[keep], high[keep]
            gap = share * (high - low)
            exact = (self.var[pa] == 0) & (self.var[pb] == 0)
            np.add.at(fixed, pair[exact], share[exact] * low[exact])
            pa, pb, pair, share, gap = pa[~exact], pb[~exact], pair[~exact], share[~exact], gap[~exact]
            if len(pa) > self.MOST:  # too many pieces to hold: what is left of these pairs is summed row by row
                for q in np.flatnonzero(open_):
                    fixed[q] = self._mean(int(lo_id[q]), int(hi_id[q]))
                pa, pb, pair, share = pa[:0], pb[:0], pair[:0], share[:0]
                continue
            widest = np.zeros(len(row))
            np.maximum.at(widest, pair, gap)
            split = gap >= 0.25 * widest[pair]
            whole = [v[~split] for v in (pa, pb, pair, share)]
            pa, pb, pair, share = pa[split], pb[split], pair[split], share[split]
            of_a = (self.var[pa] >= self.var[pb])[:, None]
            cut = np.where(of_a[:, 0], pa, pb)
            kids = self.kids[cut]
            parts = share[:, None] * self.size[kids] / self.size[cut][:, None]
            pa2 = np.where(of_a, kids, pa[:, None]).ravel()
            pb2 = np.where(of_a, pb[:, None], kids).ravel()
            pa, pb, pair, share = (np.concatenate(v) for v in zip(whole, (pa2, pb2, np.repeat(pair, 2), parts.ravel()), strict=True))

    def members(self, node: int) -> np.ndarray:
        found, level = [], np.array([node])
        while len(level):
            single = self.kids[level, 0] < 0
            found.append(level[single])
            level = self.kids[level[~single]].ravel()
        return np.sort(np.concatenate(found))

    def _mean(self, a: int, b: int, block: int = 1024) -> float:
        xa, xb = self.center[self.members(a)], self.center[self.members(b)]
        return sum(float(distances(xa[i : i + block], xb[j : j + 8192]).sum()) for i in range(0, len(xa), block) for j in range(0, len(xb), 8192)) / (len(xa) * len(xb))

    def cut(self, k: int) -> np.ndarray:
        """Labels 0 .. k - 1: the clusters that stay when the k - 1 highest merges are undone."""
        nodes = [self.root]
        while len(nodes) < min(k, self.rows):
            can = np.array([v for v in nodes if self.kids[v, 0] >= 0])
            top = can[self._choose(np.zeros(len(can), int), self.kids[can, 0], self.kids[can, 1], 1, largest=True)[0]]
            nodes.remove(top)
            nodes += self.kids[top].tolist()
        label = np.empty(self.rows, int)
        for i, node in enumerate(sorted(nodes, key=lambda v: self.members(v)[0])):
            label[self.members(node)] = i
        return label


#: Values of a factor: 8 bytes each, of which only those that are written take memory.
MOST_FACTOR = 200_000_000


def gaussian_factor(x: np.ndarray, gamma: float, rest: float = 1e-8) -> np.ndarray:
    """f with exp(-gamma |a - b|^2) = f.T @ f but for a remainder (pivoted Cholesky). The remainder is positive, so its trace over the least
    row sum bounds what it changes of the normalised affinity; rows are added to f until that is at most `rest`. There are as many
    as the affinity has rank: all n where its width tells every row from every other."""
    n = len(x)
    most = min(n, MOST_FACTOR // n)
    left, out, total = np.ones(n), np.empty((most, n)), np.zeros(n)
    for k in range(most):
        i = int(left.argmax())
        if left[i] <= 1e-13:
            return out[:k]
        out[k] = (np.exp(-gamma * ((x - x[i]) ** 2).sum(1)) - out[:k, i] @ out[:k]) / np.sqrt(left[i])
        total += out[k].sum() * out[k]
        left = np.maximum(0, left - out[k] ** 2)
        left[i] = 0
        if left.sum() <= rest * max(1.0, total.min()):
            return out[: k + 1]
    if most < n:
        raise MemoryError(f"the affinity of {n} rows has a rank over {most}: they are too many for so narrow a kernel")
    return out
