"""Measures of one graph on a dense weight matrix W (0: no edge). No Spark in here.

Undefined values are NaN, unreachable distances inf; the callers turn both into NULL.
"""

from __future__ import annotations

import numpy as np


def binary(w: np.ndarray) -> np.ndarray:
    a = (w != 0).astype(float)
    np.fill_diagonal(a, 0)
    return a


def distances(w: np.ndarray, weighted: bool = False) -> np.ndarray:
    """Shortest path lengths: breadth-first from all sources at once, or Floyd-Warshall."""
    n = len(w)
    if weighted:
        d = np.where(w != 0, w, np.inf).astype(float)
        np.fill_diagonal(d, 0)
        if (w < 0).any():
            raise ValueError("negative lengths")
        for k in range(n):
            np.minimum(d, d[:, k : k + 1] + d[k], out=d)
        return d
    a = binary(w)
    d = np.where(np.eye(n) > 0, 0.0, np.inf)
    front = np.eye(n)
    for step in range(1, n):
        front = ((front @ a) > 0) & np.isinf(d)
        if not front.any():
            break
        d[front] = step
        front = front.astype(float)
    return d


def _reciprocal(d: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        r = 1 / d
    np.fill_diagonal(r, 0)
    return r


def nodal_efficiency(d: np.ndarray) -> np.ndarray:
    n = len(d)
    return _reciprocal(d).sum(1) / (n - 1) if n > 1 else np.zeros(n)


def global_efficiency(d: np.ndarray) -> float:
    return float(nodal_efficiency(d).mean()) if len(d) else np.nan


def local_efficiency(w: np.ndarray, weighted: bool = False) -> np.ndarray:
    """Global efficiency of the subgraph that a vertex's neighbours induce."""
    out = np.zeros(len(w))
    for i in range(len(w)):
        near = np.flatnonzero(w[i])
        near = near[near != i]
        if len(near) > 1:
            out[i] = global_efficiency(distances(w[np.ix_(near, near)], weighted))
    return out


def vertex_path_length(d: np.ndarray) -> np.ndarray:
    """Mean finite distance to others; 0 where none is reached."""
    x = np.where(np.isinf(d), 0, d)
    reached = (~np.isinf(d)).sum(1) - 1
    return np.divide(x.sum(1), reached, out=np.zeros(len(d)), where=reached > 0)


def path_length(d: np.ndarray) -> float:
    off = ~np.eye(len(d), dtype=bool) & ~np.isinf(d)
    return float(d[off].mean()) if off.any() else np.nan


def diameter(d: np.ndarray) -> float:
    ok = d[~np.isinf(d)]
    return float(ok.max()) if len(ok) else np.nan


def eccentricity(d: np.ndarray) -> np.ndarray:
    return np.where(np.isinf(d), 0, d).max(1, initial=0)


def closeness(d: np.ndarray) -> np.ndarray:
    """1 / sum of the finite distances; NaN for isolates."""
    s = np.where(np.isinf(d), 0, d).sum(1)
    return np.divide(1.0, s, out=np.full(len(d), np.nan), where=s > 0)


def vulnerability(w: np.ndarray, weighted: bool = False) -> np.ndarray:
    """Share of the global efficiency that is lost without the vertex; 0 for isolates."""
    n, whole = len(w), global_efficiency(distances(w, weighted))
    out = np.zeros(n)
    for i in range(n):
        if np.count_nonzero(w[i]) and whole:
            keep = np.arange(n) != i
            out[i] = 1 - global_efficiency(distances(w[np.ix_(keep, keep)], weighted)) / whole
    return out


def components(w: np.ndarray) -> np.ndarray:
    """Component numbers from 1, largest first (ties: the one with the smaller vertex)."""
    n = len(w)
    label = np.full(n, -1)
    for s in range(n):
        if label[s] < 0:
            stack = [s]
            label[s] = s
            while stack:
                i = stack.pop()
                for j in np.flatnonzero((w[i] != 0) | (w[:, i] != 0)):
                    if label[j] < 0:
                        label[j] = s
                        stack.append(j)
    return rank_labels(label)


def rank_labels(label: np.ndarray) -> np.ndarray:
    """Renumber from 1 by falling size, ties by label."""
    values, inverse, sizes = np.unique(label, return_inverse=True, return_counts=True)
    order = np.lexsort((values, -sizes))
    rank = np.empty(len(values), int)
    rank[order] = np.arange(1, len(values) + 1)
    return rank[inverse]


def betweenness(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unweighted vertex and edge betweenness, each unordered pair once. Path counts grow
    level by level from all sources at once; dependencies come back the same way."""
    a = binary(w)
    n = len(a)
    d = distances(a)
    sigma = np.eye(n)
    far = int(d[~np.isinf(d)].max(initial=0))
    for level in range(1, far + 1):
        sigma += np.where(d == level, np.where(d == level - 1, sigma, 0) @ a, 0)
    delta = np.zeros((n, n))
    edge = np.zeros((n, n))
    for level in range(far, 0, -1):
        share = np.divide(1 + delta, sigma, out=np.zeros((n, n)), where=d == level)
        before = np.where(d == level - 1, sigma, 0)
        edge += (before.T @ share) * a
        delta += before * (share @ a)
    vertex = (delta * ~np.eye(n, dtype=bool)).sum(0) / 2
    return vertex, (edge + edge.T) / 2


def coreness(w: np.ndarray) -> np.ndarray:
    a = binary(w)
    k = a.sum(1)
    core, alive, level = np.zeros(len(a), int), np.ones(len(a), bool), 0
    while alive.any():
        i = int(np.where(alive, k, np.inf).argmin())
        level = max(level, int(k[i]))
        core[i] = level
        alive[i] = False
        k -= a[i]
    return core


def s_core(w: np.ndarray) -> np.ndarray:
    """Levels of repeated removal of the vertices of least strength, one pass a level; a
    vertex that loses all its neighbours first stays at 0."""
    w = w.copy().astype(float)
    np.fill_diagonal(w, 0)
    out, level = np.zeros(len(w), int), 1
    while True:
        s = w.sum(0)
        if not (s > 1e-12).any():
            return out
        least = s[s > 1e-12].min()
        gone = (s > 1e-12) & (s <= least + 1e-9)
        out[gone] = level
        w[gone] = 0
        w[:, gone] = 0
        level += 1


def leading_vector(m: np.ndarray) -> np.ndarray:
    """The leading eigenvector of a symmetric matrix, largest entry 1."""
    if not len(m) or not m.any():
        return np.ones(len(m))
    v = np.abs(np.linalg.eigh(m)[1][:, -1])
    return v / v.max()


def hits(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return leading_vector(w @ w.T), leading_vector(w.T @ w)


def pagerank(w: np.ndarray, damping: float = 0.85) -> np.ndarray:
    n = len(w)
    out = w.sum(1)
    p = np.divide(w, out[:, None], out=np.full((n, n), 1 / max(n, 1)), where=out[:, None] > 0)
    return np.linalg.solve(np.eye(n) - damping * p.T, np.full(n, (1 - damping) / n)) if n else np.zeros(0)


def expm_sym(m: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh(m)
    return (vectors * np.exp(values)) @ vectors.T


def communicability(w: np.ndarray, weighted: bool = False) -> np.ndarray:
    """exp of the adjacency matrix, or of the degree-normalised weights."""
    if not weighted:
        return expm_sym(binary(w))
    s = w.sum(1)
    r = np.divide(1, np.sqrt(s), out=np.zeros(len(s)), where=s > 0)
    return expm_sym(w * r[:, None] * r)


def subgraph_centrality(w: np.ndarray) -> np.ndarray:
    return np.diag(communicability(w)).copy()


def communicability_betweenness(w: np.ndarray) -> np.ndarray:
    a = binary(w)
    n = len(a)
    whole = expm_sym(a)
    scale = (n - 1) ** 2 - (n - 1)
    out = np.full(n, np.nan)
    for r in range(n if scale else 0):
        b = a.copy()
        b[r] = b[:, r] = 0
        share = (whole - expm_sym(b)) / whole
        share[r] = share[:, r] = 0
        np.fill_diagonal(share, 0)
        out[r] = share.sum() / scale
    return out


def triangles(a: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ji->i", a @ a, a) / 2


def clustering(w: np.ndarray) -> np.ndarray:
    """Local transitivity, 0 with under two neighbours."""
    a = binary(w)
    k = a.sum(1)
    return np.divide(2 * triangles(a), k * (k - 1), out=np.zeros(len(a)), where=k > 1)


def mean_clustering(w: np.ndarray) -> float:
    """Mean over the vertices with two neighbours or more."""
    many = binary(w).sum(1) > 1
    return float(clustering(w)[many].mean()) if many.any() else np.nan


def transitivity(w: np.ndarray) -> float:
    a = binary(w)
    k = a.sum(1)
    triples = (k * (k - 1)).sum()
    return float(2 * triangles(a).sum() / triples) if triples else np.nan


def barrat(w: np.ndarray) -> np.ndarray:
    """Weighted local transitivity; NaN with under two neighbours."""
    a = binary(w)
    k, s = a.sum(1), w.sum(1)
    return np.divide(np.einsum("ij,ij->i", w @ a, a), s * (k - 1), out=np.full(len(a), np.nan), where=(k > 1) & (s != 0))


def knn(w: np.ndarray, weighted: bool = False) -> np.ndarray:
    a = binary(w)
    m = w if weighted else a
    return np.divide(m @ a.sum(1), m.sum(1), out=np.full(len(a), np.nan), where=m.sum(1) != 0)


def leverage(w: np.ndarray) -> np.ndarray:
    a = binary(w)
    k = a.sum(1)
    total = k[:, None] + k
    x = np.divide(k[:, None] - k, total, out=np.zeros_like(a), where=total > 0)
    return np.divide((a * x).sum(1), k, out=np.full(len(a), np.nan), where=k > 0)


def assortativity(w: np.ndarray) -> float:
    a = binary(w)
    k = a.sum(1)
    i, j = np.nonzero(a)
    x, y = k[i], k[j]
    return float(np.corrcoef(x, y)[0, 1]) if len(i) and x.std() > 0 else np.nan


def nominal_assortativity(w: np.ndarray, group: np.ndarray) -> float:
    a = binary(w)
    values, g = np.unique(group, return_inverse=True)
    one = np.eye(len(values))[g]
    e = one.T @ a @ one
    if not e.sum():
        return np.nan
    e /= e.sum()
    chance = float((e.sum(0) * e.sum(1)).sum())
    return float((np.trace(e) - chance) / (1 - chance)) if chance < 1 else np.nan


def modularity(w: np.ndarray, group: np.ndarray) -> float:
    total = w.sum()
    if not total:
        return np.nan
    same = group[:, None] == group
    s = w.sum(1)
    return float(((w - np.outer(s, s) / total) * same).sum() / total)


def participation(w: np.ndarray, group: np.ndarray) -> np.ndarray:
    one = np.eye(group.max() + 1)[group] if len(group) else np.zeros((0, 0))
    k = w.sum(1)
    part = w @ one
    return 1 - np.divide((part**2).sum(1), k**2, out=np.full(len(w), np.nan), where=k != 0)


def within_module_z(w: np.ndarray, group: np.ndarray) -> np.ndarray:
    inside = (w * (group[:, None] == group)).sum(1)
    out = np.full(len(w), np.nan)
    for g in np.unique(group):
        at = group == g
        if at.sum() > 1:
            sd = inside[at].std(ddof=1)
            if sd > 0:
                out[at] = (inside[at] - inside[at].mean()) / sd
    return out


def gateway(w: np.ndarray, group: np.ndarray, centrality: np.ndarray) -> np.ndarray:
    """Gateway coefficient; 0 for all if there is one module, NaN for isolates."""
    values, g = np.unique(group, return_inverse=True)
    if len(values) < 2:
        return np.zeros(len(w))
    one = np.eye(len(values))[g]
    k = w.sum(1)
    part = w @ one
    most = (one.T @ centrality).max()
    between = one.T @ part  # module S (rows) x module of the other end
    bar = np.divide(part, between[:, g].T, out=np.zeros_like(part), where=between[:, g].T != 0)
    c = (binary(w) * centrality) @ one
    gate = 1 - bar * (c / most if most else 0)
    return 1 - np.divide((part**2 * gate**2).sum(1), k**2, out=np.full(len(w), np.nan), where=k != 0)


def rich_club(w: np.ndarray, k: int, weighted: bool = False) -> float:
    a = binary(w)
    rich = a.sum(1) > k
    n = int(rich.sum())
    inside = np.triu(w[np.ix_(rich, rich)], 1)
    if weighted:
        count = int(np.count_nonzero(inside))
        top = np.sort(np.triu(w, 1)[np.triu(w, 1) != 0])[::-1][:count].sum()
        return float(inside.sum() / top) if count and top else np.nan
    return float(2 * np.count_nonzero(inside) / (n * (n - 1))) if n > 1 else np.nan


def rich_core(w: np.ndarray, weighted: bool = False) -> tuple[int, int, float]:
    """Rank of the core's boundary, degree (or scaled strength) there, and its share."""
    a = binary(w)
    m = np.ceil(w / w[w > 0].min()) if weighted and (w > 0).any() else a
    k = m.sum(1)
    order = np.argsort(-k, kind="stable")
    plus = (m * (k[None] > k[:, None])).sum(1)[order]
    best = len(plus) - 1 - int(plus[::-1].argmax())
    return best + 1, int(k[order[best]]), (best + 1) / len(k)


def hubness(strength, between, cluster, length, keep: float = 0.2) -> np.ndarray:
    """How often a vertex is in the top share by strength and betweenness and in the bottom
    share by clustering and path length; ties by vertex order."""
    n = len(strength)
    cut = int(np.rint(keep * n))
    out = np.zeros(n, int)
    for values in (-np.asarray(strength, float), -np.asarray(between, float), np.asarray(cluster, float), np.asarray(length, float)):
        out[np.argsort(values, kind="stable")[:cut]] += 1
    return out


# Communities. Vertex order is fixed and draws are seeded, so reruns agree.


def louvain(w: np.ndarray, seed: int = 0, gain=None) -> np.ndarray:
    """Modularity is defined on symmetric weights, so `w` is mirrored first: on a matrix
    whose triangles differ, single moves have no common potential and may go in circles. A
    level ends when a whole pass over its vertices gains next to nothing."""
    n = len(w)
    member = np.arange(n)
    m = w.astype(float)
    m = (m + m.T) / 2
    rng = np.random.default_rng(seed)
    while m.sum() > 0:
        size, total, s = len(m), m.sum(), m.sum(1)
        least = 1e-12 * total
        at = np.arange(size)
        mass = s.copy()
        order = rng.permutation(size)
        moved_any, gained = False, np.inf
        while gained > least * size:
            gained = 0.0
            for i in order:
                old = at[i]
                link = np.bincount(at, m[i], size)
                link[old] -= m[i, i]
                mass[old] -= s[i]
                score = link - mass * s[i] / total
                score[np.bincount(at, minlength=size) == 0] = -np.inf
                score[old] = link[old] - mass[old] * s[i] / total
                new = int(score.argmax())
                if score[new] <= score[old] + least:
                    new = old
                mass[new] += s[i]
                if new != old:
                    at[i] = new
                    moved_any = True
                    gained += score[new] - score[old]
        if not moved_any:
            break
        names, at = np.unique(at, return_inverse=True)
        member = at[member]
        one = np.eye(len(names))[at]
        m = one.T @ m @ one
    return rank_labels(member)


def fast_greedy(w: np.ndarray) -> np.ndarray:
    """Merges the pair of communities that raises modularity most, and keeps the best cut."""
    n, total = len(w), w.sum()
    if not total:
        return rank_labels(np.arange(n))
    e = w / total
    a, member, alive = e.sum(1), np.arange(n), np.ones(n, bool)
    q = float(np.trace(e) - (a**2).sum())
    best, best_member = q, member.copy()
    e = e.copy()
    while alive.sum() > 1:
        gain = np.where(e > 0, 2 * (e - np.outer(a, a)), -np.inf)
        np.fill_diagonal(gain, -np.inf)
        gain[~alive] = gain[:, ~alive] = -np.inf
        i, j = np.unravel_index(gain.argmax(), gain.shape)
        if np.isinf(gain[i, j]):
            break
        q += gain[i, j]
        e[i] += e[j]
        e[:, i] += e[:, j]
        e[j] = e[:, j] = 0
        a[i] += a[j]
        a[j], alive[j] = 0, False
        member[member == j] = i
        if q > best + 1e-12:
            best, best_member = q, member.copy()
    return rank_labels(best_member)


def walktrap(w: np.ndarray, steps: int = 4) -> np.ndarray:
    """Ward merges of random-walk profiles between adjacent communities; best modularity."""
    n = len(w)
    b = w + np.diag(np.where(w.sum(1) > 0, w.sum(1) / np.maximum((w != 0).sum(1), 1), 1))
    k = b.sum(1)
    p = np.linalg.matrix_power(b / k[:, None], steps) / np.sqrt(k)
    size, member, adjacent = np.ones(n), np.arange(n), w != 0
    alive = np.ones(n, bool)
    best, best_member = modularity(w, member), member.copy()
    if np.isnan(best):
        return rank_labels(member)
    while True:
        pair, least = None, np.inf
        for i in np.flatnonzero(alive):
            js = np.flatnonzero(adjacent[i] & alive)
            js = js[js > i]
            if len(js):
                cost = size[i] * size[js] / (size[i] + size[js]) * ((p[js] - p[i]) ** 2).sum(1)
                if cost.min() < least - 1e-15:
                    least, pair = cost.min(), (i, int(js[cost.argmin()]))
        if pair is None:
            return rank_labels(best_member)
        i, j = pair
        p[i] = (size[i] * p[i] + size[j] * p[j]) / (size[i] + size[j])
        size[i] += size[j]
        adjacent[i] |= adjacent[j]
        adjacent[:, i] |= adjacent[:, j]
        adjacent[i, i] = False
        alive[j] = False
        member[member == j] = i
        q = modularity(w, member)
        if q > best + 1e-12:
            best, best_member = q, member.copy()


def label_propagation(w: np.ndarray, seed: int = 0, rounds: int = 200) -> np.ndarray:
    n, rng = len(w), np.random.default_rng(seed)
    label = np.arange(n)
    for _ in range(rounds):
        changed = False
        for i in rng.permutation(n):
            if w[i].any():
                vote = np.bincount(label, w[i], n)
                top = np.flatnonzero(vote >= vote.max() - 1e-12)
                if label[i] not in top:
                    label[i] = top[rng.integers(len(top))]
                    changed = True
        if not changed:
            break
    return rank_labels(label)


def leading_eigen(w: np.ndarray) -> np.ndarray:
    """Splits by the sign of the modularity matrix's leading eigenvector while that helps."""
    total, s = w.sum(), w.sum(1)
    member = components(w) - 1
    if not total:
        return rank_labels(member)
    b = w - np.outer(s, s) / total
    queue = list(np.unique(member))
    while queue:
        g = queue.pop(0)
        at = np.flatnonzero(member == g)
        if len(at) < 2:
            continue
        part = b[np.ix_(at, at)].copy()
        part -= np.diag(part.sum(1))
        values, vectors = np.linalg.eigh(part)
        side = vectors[:, -1] > 0
        if values[-1] < 1e-10 or side.all() or not side.any():
            continue
        sign = np.where(side, 1.0, -1.0)
        if sign @ part @ sign <= 1e-10:
            continue
        new = member.max() + 1
        member[at[side]] = new
        queue += [g, new]
    return rank_labels(member)


def edge_betweenness_communities(w: np.ndarray) -> np.ndarray:
    a, best, best_member = binary(w), -np.inf, None
    while True:
        member = components(a)
        q = modularity(w, member)
        if best_member is None or q > best + 1e-12:
            best, best_member = q, member
        if not a.any():
            return best_member
        e = np.triu(betweenness(a)[1])
        i, j = np.unravel_index(e.argmax(), e.shape)
        a[i, j] = a[j, i] = 0


def spinglass(w: np.ndarray, spins: int = 25, seed: int = 0, start: float = 1.0, stop: float = 0.01, cool: float = 0.9) -> np.ndarray:
    """Potts model with the configuration null model, annealed by heat-bath sweeps."""
    n, total, rng = len(w), np.abs(w).sum(), np.random.default_rng(seed)
    if not total:
        return rank_labels(np.arange(n))
    pos, neg = np.maximum(w, 0), np.maximum(-w, 0)
    coupling = w - np.outer(pos.sum(1), pos.sum(1)) / max(pos.sum(), 1e-300) + np.outer(neg.sum(1), neg.sum(1)) / max(neg.sum(), 1e-300) * bool(neg.any())
    np.fill_diagonal(coupling, 0)
    spin, t = rng.integers(0, spins, n), start * np.abs(coupling).sum(1).max()
    floor = stop * t
    best, best_spin = -np.inf, spin.copy()
    while t > floor:
        for i in rng.permutation(n):
            field = np.bincount(spin, coupling[i], spins)
            p = np.exp((field - field.max()) / t)
            spin[i] = rng.choice(spins, p=p / p.sum())
        energy = (coupling * (spin[:, None] == spin)).sum()
        if energy > best:
            best, best_spin = energy, spin.copy()
        t *= cool
    return rank_labels(best_spin)


def _map_equation(w: np.ndarray, member: np.ndarray) -> float:
    """Two-level description length of an undirected walk (bits)."""
    total = w.sum()
    one = np.eye(member.max() + 1)[member]
    p = w.sum(1) / total
    inside = np.einsum("im,ij,jm->m", one, w, one) / total
    mass = one.T @ p
    leave = mass - inside
    f = lambda x: float((x[x > 0] * np.log2(x[x > 0])).sum())
    return f(np.array([leave.sum()])) - 2 * f(leave) - f(p) + f(leave + mass)


def infomap(w: np.ndarray, seed: int = 0) -> np.ndarray:
    """Greedy moves of vertices between communities that shorten the map equation."""
    n, rng = len(w), np.random.default_rng(seed)
    member = np.arange(n)
    if not w.sum():
        return rank_labels(member)
    length, moved = _map_equation(w, member), True
    while moved:
        moved = False
        for i in rng.permutation(n):
            tried = {}
            for g in np.unique(member[np.flatnonzero(w[i])]):
                if g != member[i]:
                    x = member.copy()
                    x[i] = g
                    tried[g] = _map_equation(w, x)
            if tried and min(tried.values()) < length - 1e-12:
                member[i] = min(tried, key=tried.get)
                length, moved = tried[member[i]], True
        groups = np.unique(member)
        for g in groups:  # merges of whole communities
            for h in groups:
                if g < h and (member == g).any() and (member == h).any():
                    x = np.where(member == h, g, member)
                    if (y := _map_equation(w, x)) < length - 1e-12:
                        member, length, moved = x, y, True
    return rank_labels(member)


def optimal(w: np.ndarray) -> np.ndarray:
    """The partition of greatest modularity, by enumeration of restricted growth strings."""
    n = len(w)
    if n > 10:
        raise ValueError("optimal communities are for up to 10 vertices")
    best, found = -np.inf, np.zeros(n, int)

    def grow(i: int, member: list[int], groups: int) -> None:
        nonlocal best, found
        if i == n:
            q = modularity(w, np.array(member))
            if q > best + 1e-12:
                best, found = q, np.array(member)
            return
        for g in range(groups + 1):
            grow(i + 1, [*member, g], max(groups, g + 1))

    grow(0, [], 0)
    return rank_labels(found)


COMMUNITIES = {
    "louvain": louvain, "fast_greedy": fast_greedy, "walktrap": walktrap, "label_prop": label_propagation, "leading_eigen": leading_eigen,
    "edge_betweenness": edge_betweenness_communities, "spinglass": spinglass, "infomap": infomap, "optimal": optimal,
}


def communities(w: np.ndarray, method: str = "louvain", **options) -> np.ndarray:
    """Labels from 1 by falling size. Negative weights need walktrap (on |w|) or spinglass."""
    if (w < 0).any() and method not in ("walktrap", "spinglass"):
        method = "walktrap"
    return COMMUNITIES[method](np.abs(w) if method == "walktrap" else w, **options)


# Random graphs


def _edge_list(a: np.ndarray) -> list[tuple[int, int]]:
    return list(zip(*(x.tolist() for x in np.nonzero(np.triu(a, 1)))))


def rewire(w: np.ndarray, seed=0, trials: int | None = None, connected: bool = False) -> np.ndarray:
    """Degree-preserving double-edge swaps; with `connected`, none that splits the graph."""
    a = binary(w)
    edges = _edge_list(a)
    m, rng = len(edges), np.random.default_rng(seed)
    if m < 2:
        return a
    trials = max(10 * m, 10_000) if trials is None else trials
    picks, flips = rng.integers(0, m, (trials, 2)), rng.random(trials) < 0.5
    whole = connected and components(a).max() == 1
    last, since, undo = a.copy(), 0, list(edges)
    for (p, q), flip in zip(picks.tolist(), flips.tolist()):
        (i, j), (k, l) = edges[p], edges[q]  # noqa: E741
        if flip:
            k, l = l, k  # noqa: E741
        if len({i, j, k, l}) < 4 or a[i, l] or a[k, j]:
            continue
        a[i, j] = a[j, i] = a[k, l] = a[l, k] = 0
        a[i, l] = a[l, i] = a[k, j] = a[j, k] = 1
        edges[p], edges[q] = (i, l), (k, j)
        since += 1
        if whole and since >= 20:
            if components(a).max() > 1:
                a, edges = last.copy(), list(undo)
            else:
                last, undo = a.copy(), list(edges)
            since = 0
    if whole and since and components(a).max() > 1:
        a = last
    return a


def degree_sequence(w: np.ndarray, seed=0) -> np.ndarray:
    """A random simple graph with the degrees of w; connected if w is."""
    return rewire(w, seed, connected=True)


def _closing_swap(a: np.ndarray, many: np.ndarray, rng: np.random.Generator) -> tuple[int, int, int, int] | None:
    """A draw of vertices (u, p, v, q): u and v are linked to one vertex but not to each
    other, p and q hang on u and v and aren't linked either. Swapping u-p, v-q for u-v, p-q
    keeps all degrees and closes the triangle over u and v. None if the draw has no such."""
    x = rng.choice(many)
    ends = [int(y) for y in np.flatnonzero(a[x]) if a[y].sum() > 1]
    if len(ends) < 2:
        return None
    u, v = (int(y) for y in rng.choice(ends, 2, replace=False))
    if a[u, v]:
        return None
    of_u = [y for y in np.flatnonzero(a[u]) if y not in (x, v)]
    if not of_u:
        return None
    p = int(rng.choice(of_u))
    of_v = [y for y in np.flatnonzero(a[v]) if y not in (x, u, p)]
    if not of_v:
        return None
    q = int(rng.choice(of_v))
    return None if a[p, q] else (u, p, v, q)


def clustered(w: np.ndarray, target: float, seed=0, trials: int | None = None, swaps: int = 100, attempts: int = 2000) -> np.ndarray:
    """Rewires, then takes swaps that raise transitivity, `swaps` at most, until it is
    `target` or more. A swap is looked for in up to `attempts` draws; if none is found the
    graph stays as it is (`transitivity` of the result tells whether the target was met)."""
    a, rng = rewire(w, seed, trials), np.random.default_rng([seed, 1] if np.isscalar(seed) else [*seed, 1])
    c = transitivity(a)
    many = np.flatnonzero(a.sum(1) > 1)
    taken = tried = 0
    while len(many) and c < target and taken < swaps and tried < attempts:
        tried += 1
        if (found := _closing_swap(a, many, rng)) is None:
            continue
        u, p, v, q = found
        a[[u, p, v, q], [p, u, q, v]] = 0
        a[[u, v, p, q], [v, u, q, p]] = 1
        if (new := transitivity(a)) > c:
            c, taken, tried = new, taken + 1, 0
        else:
            a[[u, v, p, q], [v, u, q, p]] = 0
            a[[u, p, v, q], [p, u, q, v]] = 1
    return a


def hqs(cov: np.ndarray, seed=0) -> np.ndarray:
    """A random correlation matrix whose entries match a covariance matrix's moments (sample
    variance of the off-diagonal ones). A mean below zero has no real square root, so such
    covariances have no draw. The number of factors grows with the subjects behind `cov`; they
    are drawn and summed 16,384 at a time."""
    off = cov[~np.eye(len(cov), dtype=bool)]
    e, v, mean = off.mean(), off.var(ddof=1), np.diag(cov).mean()
    if e < 0:
        return np.full(cov.shape, np.nan)
    m = max(2, int((mean**2 - e**2) // v)) if v > 0 else 2
    centre = np.sqrt(e / m)
    spread = np.sqrt(max(-(centre**2) + np.sqrt(centre**4 + v / m), 0))
    rng, s = np.random.default_rng(seed), np.zeros(cov.shape)
    for k in range(0, m, 16384):
        f = centre + spread * rng.standard_normal((len(cov), min(16384, m - k)))
        s += f @ f.T
    a = 1 / np.sqrt(np.diag(s))
    return s * np.outer(a, a)


# Robustness


def _sizes_after_removal(n: int, edges: list[tuple[int, int]], order: list[int], kind: str) -> np.ndarray:
    """Largest component after 0, 1, ... removals: insertion in reverse with union-find."""
    parent, size = list(range(n)), [1] * n

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(i, j):
        i, j = find(i), find(j)
        if i != j:
            if size[i] < size[j]:
                i, j = j, i
            parent[j] = i
            size[i] += size[j]
        return size[i]

    largest, out = 0, [0]
    if kind == "vertex":
        near: list[list[int]] = [[] for _ in range(n)]
        for i, j in edges:
            near[i].append(j)
            near[j].append(i)
        there = [False] * n
        for v in reversed(order):
            there[v] = True
            largest = max(largest, 1)
            for u in near[v]:
                if there[u]:
                    largest = max(largest, join(v, u))
            out.append(largest)
    else:
        largest = 1
        for p in reversed(order):
            largest = max(largest, join(*edges[p]))
            out.append(largest)
    return np.array(out[::-1], float)


def robustness(w: np.ndarray, kind: str = "vertex", measure: str = "btwn.cent", n_random: int = 1000, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Share removed, largest component, and that over the original: targeted (most central
    first, order fixed at the start, ties by position) or random (mean over repeats)."""
    n, edges = len(w), _edge_list(binary(w))
    count = n if kind == "vertex" else len(edges)
    if measure == "random":
        rng = np.random.default_rng(seed)
        sizes = np.mean([_sizes_after_removal(n, edges, rng.permutation(count).tolist(), kind) for _ in range(n_random)], 0)
    else:
        if kind == "edge":
            e = betweenness(w)[1]
            score = np.array([e[i, j] for i, j in edges])
        else:
            score = betweenness(w)[0] if measure == "btwn.cent" else binary(w).sum(1)
        sizes = _sizes_after_removal(n, edges, np.argsort(-score.round(9), kind="stable").tolist(), kind)
    sizes[-1] = 0
    return np.linspace(0, 1, count + 1), sizes, sizes / sizes[0] if sizes[0] else sizes


def random_draws(w: np.ndarray, n: int, seed: int = 0, target: float | None = None):
    for r in range(n):
        yield r, (clustered(w, target, [seed, r]) if target is not None else degree_sequence(w, [seed, r]) if components(w).max(initial=1) == 1 else rewire(w, [seed, r]))
