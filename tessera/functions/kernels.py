"""Clustering and representation fits in numpy, one candidate and seed a task.

Spark's own k-means serves tables that no task can hold (`kmeans_distributed`); the fits here run side by side, one group of (candidate,
seed) each, over a matrix whose size the search checks before it deals it out."""

from __future__ import annotations

import warnings

import numpy as np

from tessera.functions.neighbours import AverageLinkage, core_distances, find, gaussian_factor, reachability_tree

#: Rows of which a fit holds the distances of all pairs; with more, linkage, density and affinity are found without that matrix.
MOST_DENSE = 2000


def _sq(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x**2).sum(1)[:, None] + (c**2).sum(1)[None] - 2 * x @ c.T)


def _spread_seeds(x: np.ndarray, k: int, r: np.random.Generator) -> np.ndarray:
    """k-means++ starting centers."""
    c = [x[r.integers(len(x))]]
    near = _sq(x, np.array(c))[:, 0]
    for _ in range(1, k):
        p = near / near.sum() if near.sum() > 0 else np.full(len(x), 1 / len(x))
        c.append(x[r.choice(len(x), p=p)])
        near = np.minimum(near, _sq(x, c[-1][None])[:, 0])
    return np.array(c)


def _lloyd(x: np.ndarray, c: np.ndarray, weight: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    for _ in range(rounds):
        d = _sq(x, c)
        lab = d.argmin(1)
        mass = np.bincount(lab, weight, len(c))
        new = np.stack([np.bincount(lab, x[:, j] * weight, len(c)) for j in range(x.shape[1])], 1) / np.maximum(mass, 1e-12)[:, None]
        for j in np.flatnonzero(mass == 0):
            new[j] = x[d.min(1).argmax()]
        if np.allclose(new, c, atol=1e-10):
            break
        c = new
    d = _sq(x, c)
    return d.argmin(1), c, float((d.min(1) * weight).sum())


def kmeans(x: np.ndarray, k: int, seed: int, starts: int = 4, weight: np.ndarray | None = None, **_) -> tuple[np.ndarray, dict]:
    r, w = np.random.default_rng(seed), np.ones(len(x)) if weight is None else weight
    best = min((_lloyd(x, _spread_seeds(x, k, r), w) for _ in range(starts)), key=lambda t: t[2])
    return best[0], {"inertia": best[2]}


def minibatch_kmeans(x: np.ndarray, k: int, seed: int, batch: int = 256, rounds: int = 100, **_) -> tuple[np.ndarray, dict]:
    r = np.random.default_rng(seed)
    c, seen = _spread_seeds(x, k, r), np.zeros(k)
    for _ in range(rounds):
        part = x[r.integers(len(x), size=min(batch, len(x)))]
        for row, j in zip(part, _sq(part, c).argmin(1), strict=True):
            seen[j] += 1
            c[j] += (row - c[j]) / seen[j]
    d = _sq(x, c)
    return d.argmin(1), {"inertia": float(d.min(1).sum())}


def gmm(x: np.ndarray, k: int, seed: int, covariance_type: str = "full", rounds: int = 100, reg: float = 1e-6, **_) -> tuple[np.ndarray, dict]:
    """Expectation-maximisation of a Gaussian mixture; covariance full, tied, diag or spherical."""
    n, p = x.shape
    resp = np.eye(k)[kmeans(x, k, seed, 1)[0]]
    last = -np.inf
    for _ in range(rounds):
        mass = resp.sum(0) + 1e-10
        pi, mu = mass / n, resp.T @ x / mass[:, None]
        if covariance_type in ("full", "tied"):
            cov = np.stack([(resp[:, j, None] * (x - mu[j])).T @ (x - mu[j]) / mass[j] for j in range(k)])
            if covariance_type == "tied":
                cov = np.broadcast_to((cov * pi[:, None, None]).sum(0), cov.shape)
            cov = cov + reg * np.eye(p)
        else:
            var = np.maximum(0, resp.T @ x**2 / mass[:, None] - mu**2) + reg
            if covariance_type == "spherical":
                var = np.broadcast_to(var.mean(1, keepdims=True), var.shape)
            cov = np.stack([np.diag(v) for v in var])
        log = np.empty((n, k))
        for j in range(k):
            low = np.linalg.cholesky(cov[j])
            z = np.linalg.solve(low, (x - mu[j]).T)
            log[:, j] = np.log(pi[j]) - 0.5 * (p * np.log(2 * np.pi) + (z**2).sum(0)) - np.log(np.diag(low)).sum()
        top = log.max(1, keepdims=True)
        norm = top[:, 0] + np.log(np.exp(log - top).sum(1))
        resp = np.exp(log - norm[:, None])
        if abs(norm.mean() - last) < 1e-5:
            break
        last = norm.mean()
    free = {"full": k * p * (p + 1) // 2, "tied": p * (p + 1) // 2, "diag": k * p, "spherical": k}[covariance_type] + k * p + k - 1
    return resp.argmax(1), {"bic": float(-2 * norm.sum() + free * np.log(n)), "average_confidence": float(resp.max(1).mean()), "assignment_entropy": float(-(resp * np.log(resp + 1e-12)).sum(1).mean())}


def _metric(x: np.ndarray, metric: str) -> np.ndarray:
    if metric in ("manhattan", "l1", "cityblock"):
        return np.abs(x[:, None] - x[None]).sum(2)
    if metric == "cosine":
        u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        return np.maximum(0, 1 - u @ u.T)
    return np.sqrt(_sq(x, x))


def agglomerative(x: np.ndarray, k: int, seed: int = 0, linkage: str = "ward", metric: str = "euclidean", **_) -> tuple[np.ndarray, dict]:
    """Merges by the Lance-Williams update until k clusters are left."""
    n = len(x)
    if n > MOST_DENSE and linkage == "average" and metric == "euclidean":
        return AverageLinkage(x).cut(k), {}
    d, size, member = _metric(x, metric), np.ones(n), np.arange(n)
    if linkage == "ward":
        d = d**2
    np.fill_diagonal(d, np.inf)
    for _ in range(n - k):
        i, j = sorted(divmod(int(d.argmin()), n))
        a, b = size[i], size[j]
        if linkage == "ward":
            new = ((a + size) * d[i] + (b + size) * d[j] - size * d[i, j]) / (a + b + size)
        elif linkage == "average":
            new = (a * d[i] + b * d[j]) / (a + b)
        else:
            new = np.maximum(d[i], d[j]) if linkage == "complete" else np.minimum(d[i], d[j])
        new[[i, j]] = np.inf
        new[np.isinf(d[i]) & np.isinf(d[j])] = np.inf
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        size[i] += b
        member[member == j] = i
    return np.unique(member, return_inverse=True)[1], {}


def spectral_cut(affinity: np.ndarray, k: int, weight: np.ndarray | None = None, seed: int = 0) -> np.ndarray:
    """k-means on the leading eigenvectors of the normalised affinity; weight stands for that many equal rows."""
    w = np.ones(len(affinity)) if weight is None else weight.astype(float)
    k = min(k, len(affinity))
    degree = np.maximum(affinity @ w, 1e-12)
    _, v = np.linalg.eigh(np.sqrt(w / degree)[:, None] * affinity * np.sqrt(w / degree)[None])
    top = v[:, -k:] / np.sqrt(w * degree)[:, None]
    top = top / np.maximum(np.linalg.norm(top, axis=1, keepdims=True), 1e-12)
    return kmeans(top, k, seed, weight=w)[0]


def factor_cut(factor: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """spectral_cut of the affinity factor.T @ factor, which is never formed: its eigenvectors are the factor's right singular vectors.
    The factor is overwritten."""
    root = np.sqrt(np.maximum(factor.sum(1) @ factor, 1e-12))
    factor /= root
    value, v = np.linalg.eigh(factor @ factor.T)
    k = min(k, len(value))
    top = (v[:, -k:].T @ factor).T / np.sqrt(np.maximum(value[-k:], 1e-300)) / root[:, None]
    top = top / np.maximum(np.linalg.norm(top, axis=1, keepdims=True), 1e-12)
    return kmeans(top, k, seed)[0]


def spectral(x: np.ndarray, k: int, seed: int, affinity: str = "rbf", gamma: float = 1.0, neighbors: int = 10, **_) -> tuple[np.ndarray, dict]:
    if len(x) > MOST_DENSE and affinity != "nearest_neighbors":
        return factor_cut(gaussian_factor(x, gamma), k, seed), {}
    d = _sq(x, x)
    if affinity == "nearest_neighbors":
        near = np.argsort(d, 1)[:, : neighbors + 1]
        a = np.zeros_like(d)
        a[np.arange(len(x))[:, None], near] = 1
        a = (a + a.T) / 2
    else:
        a = np.exp(-gamma * d)
    return spectral_cut(a, k, seed=seed), {}


def _spanning_edges(d: np.ndarray) -> list[tuple[float, int, int]]:
    """Minimum spanning tree by Prim's algorithm."""
    n = len(d)
    best, via, open_ = d[0].copy(), np.zeros(n, int), np.ones(n, bool)
    open_[0], out = False, []
    for _ in range(n - 1):
        j = int(np.where(open_, best, np.inf).argmin())
        out.append((float(best[j]), int(via[j]), j))
        open_[j] = False
        closer = open_ & (d[j] < best)
        best[closer], via[closer] = d[j][closer], j
    return sorted(out)


def hdbscan(x: np.ndarray, seed: int = 0, min_cluster_size: int = 5, min_samples: int | None = None, **_) -> tuple[np.ndarray, dict]:
    """Density clusters: mutual reachability, its spanning tree, the tree condensed to clusters of a least size, the most stable ones."""
    n = len(x)
    if n < 2:
        return np.full(n, -1), {}
    samples = min(n, min_samples or min_cluster_size)
    if n > MOST_DENSE:
        edges = reachability_tree(x, core_distances(x, samples))
    else:
        d = _metric(x, "euclidean")
        core = np.sort(d, 1)[:, samples - 1]
        edges = _spanning_edges(np.maximum(d, np.maximum(core[:, None], core[None])))
    # single-linkage tree
    up, top, tree, size = list(range(n)), list(range(n)), [], [1] * n
    for dist, a, b in edges:
        ra, rb = find(up, a), find(up, b)
        tree.append((top[ra], top[rb], dist))
        size.append(size[top[ra]] + size[top[rb]])
        up[rb], top[ra] = ra, len(size) - 1
    splits: dict[int, int] = {}

    def under(node: int) -> list[int]:
        out, stack = [], [node]
        while stack:
            v = stack.pop()
            if v < n:
                out.append(v)
            else:
                stack += tree[v - n][:2]
        return out

    # condense: a cluster lives from the density at which it splits off to where it falls apart
    birth, kids, gain, falls = {0: 0.0}, {0: []}, {0: 0.0}, {0: []}
    stack, nxt = [(2 * n - 2, 0)], 1
    while stack:
        node, c = stack.pop()
        if node < n:
            continue
        a, b, dist = tree[node - n]
        level = 1 / max(dist, 1e-12)
        big = [v for v in (a, b) if size[v] >= min_cluster_size]
        if len(big) == 2:
            gain[c] += (level - birth[c]) * (size[a] + size[b])
            for v in big:
                birth[nxt], kids[nxt], gain[nxt], falls[nxt] = level, [], 0.0, []
                kids[c].append(nxt)
                splits[nxt] = v
                stack.append((v, nxt))
                nxt += 1
        else:
            for v in (a, b):
                if v not in big:
                    gain[c] += (level - birth[c]) * size[v]
                else:
                    stack.append((v, c))
    chosen: dict[int, list[int]] = {}
    worth: dict[int, float] = {}
    for c in range(nxt - 1, 0, -1):
        below = sum(worth[j] for j in kids[c])
        if kids[c] and below > gain[c]:
            worth[c], chosen[c] = below, [x_ for j in kids[c] for x_ in chosen[j]]
        else:
            worth[c], chosen[c] = gain[c], [c]
    label = np.full(n, -1)
    for i, c in enumerate(x_ for j in kids[0] for x_ in chosen[j]):
        label[under(splits[c])] = i
    return label, {}


def optics(x: np.ndarray, seed: int = 0, min_samples: int = 5, xi: float = 0.05, **_) -> tuple[np.ndarray, dict]:
    """Order by reachability; clusters are the stretches between steep walls of at least min_samples points."""
    n, d = len(x), _metric(x, "euclidean")
    core = np.sort(d, 1)[:, min(n - 1, min_samples - 1)]
    reach, done, order = np.full(n, np.inf), np.zeros(n, bool), []
    for _ in range(n):
        i = int(np.where(done, np.inf, np.where(np.isinf(reach), 1e300, reach)).argmin())
        done[i] = True
        order.append(i)
        reach = np.where(done, reach, np.minimum(reach, np.maximum(core[i], d[i])))
    r = reach[order]
    finite = r[np.isfinite(r)]
    wall = np.median(finite) / max(1e-12, 1 - xi) + 2 * np.std(finite) if len(finite) else np.inf
    label, cur, start = np.full(n, -1), -1, 0
    cuts = [0, *[i for i in range(1, n) if r[i] > wall], n]
    for start, end in zip(cuts, cuts[1:], strict=False):
        if end - start >= min_samples:
            cur += 1
            label[np.array(order[start:end])] = cur
    return label, {"reachability_mean": float(finite.mean()) if len(finite) else 0.0, "ordering_size": float(n)}


def birch(x: np.ndarray, k: int, seed: int = 0, threshold: float = 0.5, **_) -> tuple[np.ndarray, dict]:
    """One pass of cluster features of bounded radius, then average linkage of their centers."""
    count, total, square = [], [], []
    of = np.empty(len(x), int)
    for i, row in enumerate(x):
        if count:
            c = np.array(total) / np.array(count)[:, None]
            j = int(((c - row) ** 2).sum(1).argmin())
            n, s, q = count[j] + 1, total[j] + row, square[j] + row @ row
            if max(0.0, q / n - (s / n) @ (s / n)) <= threshold**2:
                count[j], total[j], square[j], of[i] = n, s, q, j
                continue
        count.append(1)
        total.append(row.astype(float))
        square.append(float(row @ row))
        of[i] = len(count) - 1
    centers = np.array(total) / np.array(count)[:, None]
    lab = agglomerative(centers, min(k, len(centers)))[0]
    return lab[of], {"subcluster_count": float(len(centers))}


class Dense:
    """Layers of a small network, tanh between them, trained by Adam."""

    def __init__(self, sizes: list[int], r: np.random.Generator):
        self.w = [r.normal(0, np.sqrt(1 / a), (a, b)) for a, b in zip(sizes, sizes[1:], strict=False)]
        self.b = [np.zeros(b) for b in sizes[1:]]
        self.m = [np.zeros_like(a) for a in self.w + self.b]
        self.v = [np.zeros_like(a) for a in self.w + self.b]
        self.t = 0

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        out = [x]
        for i, (w, b) in enumerate(zip(self.w, self.b, strict=True)):
            z = out[-1] @ w + b
            out.append(z if i == len(self.w) - 1 else np.tanh(z))
        return out

    def backward(self, acts: list[np.ndarray], g: np.ndarray, rate: float = 1e-3) -> np.ndarray:
        gw, gb = [], []
        for i in range(len(self.w) - 1, -1, -1):
            if i < len(self.w) - 1:
                g = g * (1 - acts[i + 1] ** 2)
            gw.append(acts[i].T @ g)
            gb.append(g.sum(0))
            g = g @ self.w[i].T
        self.t += 1
        for j, (p, d) in enumerate(zip(self.w + self.b, gw[::-1] + gb[::-1], strict=True)):
            self.m[j] = 0.9 * self.m[j] + 0.1 * d
            self.v[j] = 0.999 * self.v[j] + 0.001 * d**2
            p -= rate * (self.m[j] / (1 - 0.9**self.t)) / (np.sqrt(self.v[j] / (1 - 0.999**self.t)) + 1e-8)
        return g


def autoencoder(x: np.ndarray, seed: int, latent_dim: int = 10, hidden: tuple[int, ...] = (64,), epochs: int = 100, batch: int = 256, patience: int = 10, variational: bool = False, **_) -> tuple[np.ndarray, dict]:
    """Latent codes of an encoder and decoder trained on the mean squared error (and, if variational, the divergence from a unit normal)."""
    r = np.random.default_rng(seed)
    latent = min(latent_dim, x.shape[1])
    enc, dec = Dense([x.shape[1], *hidden, latent * (1 + variational)], r), Dense([latent, *hidden[::-1], x.shape[1]], r)
    best, keep, wait = np.inf, None, 0
    for _ in range(epochs):
        total, order = 0.0, r.permutation(len(x))
        for i in range(0, len(x), batch):
            part = x[order[i : i + batch]]
            ea = enc.forward(part)
            mu, scale = ea[-1][:, :latent], np.clip(ea[-1][:, latent:], -8, 8)
            noise = r.normal(size=mu.shape) if variational else 0.0
            z = mu + noise * np.exp(scale / 2) if variational else mu
            da = dec.forward(z)
            err = da[-1] - part
            total += float((err**2).sum())
            g = dec.backward(da, 2 * err / err.size)
            if variational:
                kl = 1 / len(part) / latent
                g = np.concatenate([g + mu * kl, g * noise * np.exp(scale / 2) / 2 + (np.exp(scale) - 1) / 2 * kl], 1)
            enc.backward(ea, g)
        total /= x.size
        if total < best - 1e-8:
            best, wait, keep = total, 0, ([w.copy() for w in enc.w], [b.copy() for b in enc.b])
        else:
            wait += 1
            if wait >= patience:
                break
    enc.w, enc.b = keep
    return enc.forward(x)[-1][:, :latent], {"reconstruction_loss": best}


def ae_kmeans(x, k, seed, **p):
    z, m = autoencoder(x, seed, **p)
    lab, n = kmeans(z, k, seed)
    return lab, m | n | {"space": z}


def ae_gmm(x, k, seed, covariance_type="diag", **p):
    z, m = autoencoder(x, seed, **p)
    lab, n = gmm(z, k, seed, covariance_type)
    return lab, m | n | {"space": z}


def vae_gmm(x, k, seed, **p):
    z, m = autoencoder(x, seed, variational=True, **p)
    lab, n = gmm(z, k, seed, "diag")
    return lab, m | n | {"space": z}


def ae_centroid_refinement(x, k, seed, rounds: int = 50, **p):
    """Centers in latent space moved towards a sharpened Student-t assignment; the encoder stays as it is."""
    z, m = autoencoder(x, seed, **{"epochs": 75, **p})
    lab = kmeans(z, k, seed)[0]
    c = np.stack([z[lab == j].mean(0) if (lab == j).any() else z[j % len(z)] for j in range(k)])
    mo, ve, wait, best = np.zeros_like(c), np.zeros_like(c), 0, np.inf
    for t in range(1, rounds + 1):
        q = 1 / (1 + _sq(z, c))
        q = q / q.sum(1, keepdims=True)
        goal = q**2 / q.sum(0)
        goal = goal / goal.sum(1, keepdims=True)
        loss = float((goal * np.log((goal + 1e-12) / (q + 1e-12))).sum() / len(z))
        wait = 0 if loss < best - 1e-4 else wait + 1
        best = min(best, loss)
        if wait >= 5:
            break
        f = (goal - q) / (1 + _sq(z, c))
        g = -2 * (f.T @ z - f.sum(0)[:, None] * c) / len(z)
        mo, ve = 0.9 * mo + 0.1 * g, 0.999 * ve + 0.001 * g**2
        c = c - 0.001 * (mo / (1 - 0.9**t)) / (np.sqrt(ve / (1 - 0.999**t)) + 1e-8)
    q = 1 / (1 + _sq(z, c))
    q = q / q.sum(1, keepdims=True)
    sure = {"average_confidence": float(q.max(1).mean()), "assignment_entropy": float(-(q * np.log(q + 1e-12)).sum(1).mean())}
    return q.argmax(1), m | sure | {"kl": best, "space": z}


def umap(x: np.ndarray, seed: int, n_components: int = 2, n_neighbors: int = 15, min_dist: float = 0.1, epochs: int = 200, **_) -> np.ndarray:
    """Fuzzy neighbour graph laid out by attraction along its edges and repulsion from sampled rows."""
    n, r = len(x), np.random.default_rng(seed)
    k = min(n_neighbors, n - 1)
    d = _metric(x, "euclidean")
    near = np.argsort(d, 1)[:, 1 : k + 1]
    nd = np.take_along_axis(d, near, 1)
    rho, lo, hi = nd[:, :1], np.full((n, 1), 1e-6), np.full((n, 1), 1e3)
    for _ in range(50):
        mid = (lo + hi) / 2
        over = np.exp(-np.maximum(0, nd - rho) / mid).sum(1, keepdims=True) > np.log2(max(2, k))
        lo, hi = np.where(over, lo, mid), np.where(over, mid, hi)
    w = np.zeros((n, n))
    np.put_along_axis(w, near, np.exp(-np.maximum(0, nd - rho) / ((lo + hi) / 2)), 1)
    w = w + w.T - w * w.T
    i, j = np.nonzero(np.triu(w))
    p = w[i, j]
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    y = u[:, :n_components] * s[:n_components]
    y = 10 * y / max(1e-12, np.abs(y).max()) + r.normal(0, 1e-4, y.shape)
    b, a = 0.9, 1.6 if min_dist <= 0.1 else 1.0
    for e in range(epochs):
        rate = 1 - e / epochs
        use = r.random(len(p)) < p
        s_, t_ = i[use], j[use]
        diff = y[s_] - y[t_]
        q = np.maximum((diff**2).sum(1, keepdims=True), 1e-12)
        pull = np.clip(-2 * a * b * q ** (b - 1) / (1 + a * q**b) * diff, -4, 4)
        np.add.at(y, s_, rate * pull)
        np.add.at(y, t_, -rate * pull)
        o = r.integers(0, n, len(s_))
        diff = y[s_] - y[o]
        q = (diff**2).sum(1, keepdims=True)
        np.add.at(y, s_, rate * np.clip(2 * b / ((0.001 + q) * (1 + a * q**b)) * diff, -4, 4))
    return y


def tsne(x: np.ndarray, seed: int = 0, rounds: int = 250) -> np.ndarray:
    """Exact t-SNE of a bounded sample for pictures: perplexity max(2, min(30, (n - 1) // 3)), started from two principal components."""
    n = len(x)
    want, d = np.log(max(2, min(30, (n - 1) // 3))), _sq(x, x)
    lo, hi = np.full((n, 1), 1e-10), np.full((n, 1), 1e10)
    for _ in range(60):
        beta = np.sqrt(lo * hi)
        p = np.exp(-(d - np.min(d + np.diag(np.full(n, np.inf)), 1, keepdims=True)) * beta)
        np.fill_diagonal(p, 0)
        p /= np.maximum(p.sum(1, keepdims=True), 1e-300)
        h = -(p * np.log(p + 1e-300)).sum(1, keepdims=True)
        lo, hi = np.where(h > want, beta, lo), np.where(h > want, hi, beta)
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    y = np.zeros((n, 2))
    y[:, : min(2, len(s))] = u[:, :2] * s[:2]
    y = 1e-4 * y / max(1e-12, y[:, 0].std())
    step = np.zeros_like(y)
    for t in range(rounds):
        q = 1 / (1 + _sq(y, y))
        np.fill_diagonal(q, 0)
        f = ((12 if t < 100 else 1) * p - q / q.sum()) * q
        step = (0.5 if t < 100 else 0.8) * step - max(50.0, n / 48) * 4 * (f.sum(1)[:, None] * y - f @ y)
        y = y + step
    return y


CLUSTERERS = {f.__name__: f for f in (kmeans, minibatch_kmeans, gmm, agglomerative, hdbscan, spectral, optics, birch, ae_kmeans, ae_gmm, ae_centroid_refinement, vae_gmm)}
_OLD = {"dec": "ae_centroid_refinement", "vade": "vae_gmm"}


def fit_predict(name: str, x: np.ndarray, params: dict, seed: int) -> tuple[np.ndarray, dict]:
    """Labels and metadata of a clusterer by name; noise is -1."""
    if name in _OLD:
        warnings.warn(f"{name} is now {_OLD[name]}", DeprecationWarning, stacklevel=2)
        name = _OLD[name]
    if name not in CLUSTERERS:
        raise ValueError(f"unknown clusterer: {name}")
    p = {k: v for k, v in params.items() if k not in ("n_clusters", "n_components")}
    k = params.get("n_clusters", params.get("n_components"))
    if k is not None:
        p["k"] = int(k)
    return CLUSTERERS[name](x, seed=seed, **p)


def represent(name: str, x: np.ndarray, params: dict, seed: int) -> np.ndarray:
    if name == "none":
        return x
    if name == "pca":
        u, s, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
        k = min(int(params.get("n_components", 2)), len(s))
        sign = np.sign(v[np.arange(k), np.abs(v[:k]).argmax(1)])
        out = u[:, :k] * s[:k] * sign
        return out / out.std(0, ddof=1) if params.get("whiten") else out
    if name == "umap":
        return umap(x, seed, **params)
    if name == "autoencoder":
        return autoencoder(x, seed, **params)[0]
    raise ValueError(f"unknown representation: {name}")


def internal_quality(x: np.ndarray, labels: np.ndarray, block: int = 1024) -> dict[str, float]:
    """Silhouette, Davies-Bouldin and Calinski-Harabasz of a matrix; noise is left out. What isn't defined is -1, infinite and 0."""
    real = labels >= 0
    x, code = x[real], np.unique(labels[real], return_inverse=True)[1]
    n, k = len(x), int(code.max()) + 1 if len(code) else 0
    if not 2 <= k < n:
        return {"silhouette": -1.0, "davies_bouldin": float("inf"), "calinski_harabasz": 0.0}
    size, member = np.bincount(code, minlength=k), np.zeros((n, k))
    member[np.arange(n), code] = 1
    total = 0.0
    for lo in range(0, n, block):
        own = code[lo : lo + block]
        sums = np.sqrt(np.maximum(0, _sq(x[lo : lo + block], x))) @ member
        row = np.arange(len(own))
        a = sums[row, own] / np.maximum(1, size[own] - 1)
        away = sums / size
        away[row, own] = np.inf
        b = away.min(1)
        s = (b - a) / np.maximum(np.maximum(a, b), 1e-300)
        total += float(np.where(size[own] == 1, 0, s).sum())
    center = member.T @ x / size[:, None]
    off = np.sqrt(((x - center[code]) ** 2).sum(1))
    spread = np.bincount(code, off, k) / size
    apart = np.sqrt(np.maximum(0, _sq(center, center)))
    np.fill_diagonal(apart, 0)
    ratio = np.divide(spread[:, None] + spread[None], apart, out=np.zeros((k, k)), where=apart > 0)  # equal centers don't count
    within, between = float((off**2).sum()), float((size * ((center - x.mean(0)) ** 2).sum(1)).sum())
    return {"silhouette": total / n, "davies_bouldin": float(ratio.max(1).mean()), "calinski_harabasz": between / (k - 1) / (within / (n - k)) if within > 0 else 1.0}
