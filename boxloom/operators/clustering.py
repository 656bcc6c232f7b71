"""Clustering of one group's vectors: functions (vectors, k, frames) -> labels, run per group with applyInPandas.

A group is a video after the noise filter, which keeps some 4000 boxes (operators.detections.KEEP_BEST).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SEED = 1234567


def cosine_distances(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    unit = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
    d = np.clip(1 - unit @ unit.T, 0, 1)
    np.fill_diagonal(d, 0)
    return d


def same_frame(frames: np.ndarray) -> np.ndarray:
    """1 for two boxes of one frame, which can't be one character."""
    m = (frames[:, None] == frames[None, :]).astype(float)
    np.fill_diagonal(m, 0)
    return m


def dbscan(d: np.ndarray, eps: float, least: int = 4) -> np.ndarray:
    """Labels by density: core points in row order, a border point goes to the first cluster that reaches it."""
    near = d <= eps
    core = near.sum(axis=1) >= least
    label = np.full(len(d), -1)
    n = 0
    for i in np.flatnonzero(core):
        if label[i] >= 0:
            continue
        label[i], stack = n, [i]
        while stack:
            for k in np.flatnonzero(near[stack.pop()] & (label < 0)):
                label[k] = n
                if core[k]:
                    stack.append(k)
        n += 1
    return label


def constraint(frames: np.ndarray, tubes: np.ndarray | None = None) -> np.ndarray:
    """1 for boxes that can't be one character (of one frame), less 1 for boxes of one tube, which are."""
    return same_frame(frames) - (same_frame(tubes) if tubes is not None else 0.0)


def _sweep(d: np.ndarray, start: float, step: float, tries: int) -> Iterator[tuple[float, np.ndarray, int]]:
    """(eps, labels, clusters) for eps rising by step, until all has grown together or the number falls twice in a row."""
    seen: list[int] = []
    for i in range(tries):
        label = dbscan(d, start + i * step)
        seen.append(int(label.max(initial=-1)) + 1)
        yield start + i * step, label, seen[-1]
        if (len(seen) > 1 and seen[-1] == 1 <= seen[-2]) or (len(seen) > 2 and seen[-3] > seen[-2] > seen[-1]):
            return


# First span and start of eps, sweeps and steps of a sweep, share of k that is near enough, share of a step that the next sweep starts before the best, and its least start.
SPAN, FIRST, TRIES, NEAR, BACK, LEAST_EPS = 15.0, 0.001, 12, 0.2, 0.95, 0.01


def constrained_dbscan(x: np.ndarray, k: int, frames: np.ndarray, tubes: np.ndarray | None = None) -> np.ndarray:
    """Density clusters for the first eps found that gives about k of them, else for the best: finer sweeps around the best so far.

    Boxes of one frame are at distance 1 at least, unless they are of one tube.
    """
    d = np.maximum(cosine_distances(x), constraint(frames, tubes))
    best = (k, np.full(len(x), -1), None)  # how far from k, labels, eps
    start, step = FIRST, SPAN / TRIES
    for _ in range(TRIES):
        eps = start
        for eps, label, found in _sweep(d, start, step, TRIES):
            if abs(found - k) < best[0]:
                best = (abs(found - k), label, eps)
            if abs(found - k) <= NEAR * k:
                return label
        start = eps if best[2] is None else max(LEAST_EPS, best[2] - BACK * step)
        step = 2 * step / TRIES
    return best[1]


def optics(d: np.ndarray, least: int = 7, size: int = 7, xi: float = 0.05) -> np.ndarray:
    """Labels from the reachability order: leaf clusters between steep falls and rises (by xi), of at least `size` points."""
    n = len(d)
    if n < least:
        return np.full(n, -1)
    core = np.partition(d, least - 1, axis=1)[:, least - 1]
    reach, order, left = np.full(n, np.inf), [], np.ones(n, bool)
    while left.any():
        i = int(np.argmin(np.where(left, reach, np.inf))) if np.isfinite(reach[left]).any() else int(np.flatnonzero(left)[0])
        left[i] = False
        order.append(i)
        reach = np.where(left, np.minimum(reach, np.maximum(core[i], d[i])), reach)
    r = np.append(reach[order], np.inf)
    fall, rise = r[:-1] * (1 - xi) >= r[1:], r[:-1] <= r[1:] * (1 - xi)
    found = []
    for s in np.flatnonzero(fall):
        for e in np.flatnonzero(rise):
            if e - s + 1 < size:
                continue
            inside = r[s + 1 : e + 1]
            if len(inside) and inside.max() <= min(r[s], r[e + 1]) * (1 - xi):
                found.append((int(s), int(e)))
    label = np.full(n, -1)
    taken = 0
    for s, e in sorted(found, key=lambda c: c[1] - c[0]):
        spots = [order[i] for i in range(s, e + 1)]
        if (label[spots] == -1).all():
            label[spots] = taken
            taken += 1
    return label


def constrained_optics(x: np.ndarray, k: int, frames: np.ndarray, tubes: np.ndarray | None = None) -> np.ndarray:
    return optics(cosine_distances(x) + constraint(frames, tubes))


def k_means_bare(x: np.ndarray, k: int, frames: np.ndarray | None = None) -> np.ndarray:
    """One seeded start."""
    return k_means(x, k, restarts=1, rounds=300)


def agglomerative_average(x: np.ndarray, k: int, frames: np.ndarray | None = None) -> np.ndarray:
    return agglomerative(x, k, linkage="average", metric="euclidean")


def k_means(x: np.ndarray, k: int, frames: np.ndarray | None = None, restarts: int = 100, rounds: int = 2000, seed: int = SEED) -> np.ndarray:
    """The best of several starts, each seeded by squared distance."""
    rng, best = np.random.default_rng(seed), (np.inf, np.zeros(len(x), int))
    k = min(k, len(x))
    for _ in range(restarts):
        centers = x[[rng.integers(len(x))]]
        while len(centers) < k:
            gap = ((x[:, None] - centers[None]) ** 2).sum(axis=2).min(axis=1)
            p = gap / gap.sum() if gap.sum() > 0 else np.full(len(x), 1 / len(x))
            centers = np.vstack((centers, x[[rng.choice(len(x), p=p)]]))
        for _ in range(rounds):
            gap = ((x[:, None] - centers[None]) ** 2).sum(axis=2)
            label = gap.argmin(axis=1)
            new = np.array([x[label == j].mean(axis=0) if (label == j).any() else centers[j] for j in range(k)])
            if np.allclose(new, centers, atol=1e-12):
                break
            centers = new
        cost = float(gap.min(axis=1).sum())
        if cost < best[0]:
            best = (cost, label)
    return best[1]


def agglomerative(x: np.ndarray, k: int, frames: np.ndarray | None = None, linkage: str = "complete", metric: str = "cosine") -> np.ndarray:
    """Merges the nearest two clusters until k are left; complete or average linkage."""
    d = cosine_distances(x) if metric == "cosine" else np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(axis=2), 0))
    d, size, member = d.copy(), np.ones(len(x)), [[i] for i in range(len(x))]
    np.fill_diagonal(d, np.inf)
    for _ in range(max(0, len(x) - k)):
        i, j = np.unravel_index(int(d.argmin()), d.shape)
        i, j = min(i, j), max(i, j)
        joined = np.maximum(d[i], d[j]) if linkage == "complete" else (d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j])
        d[i], d[:, i] = joined, joined
        d[j], d[:, j], d[i, i] = np.inf, np.inf, np.inf
        size[i] += size[j]
        member[i] += member[j]
        member[j] = []
    label = np.zeros(len(x), int)
    for n, m in enumerate(m for m in member if m):
        label[m] = n
    return label


def affinity_propagation(x: np.ndarray, k: int = 0, frames: np.ndarray | None = None, damping: float = 0.5, rounds: int = 500) -> np.ndarray:
    """Exemplars by messages; clusters of one are noise."""
    n = len(x)
    s = -((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(s, np.median(s[~np.eye(n, dtype=bool)]) if n > 1 else 0)
    # equal similarities would keep the messages swinging: a disturbance of the last digits tells them apart
    s = s + (np.finfo(float).eps * np.abs(s) + 100 * np.finfo(float).tiny) * np.random.default_rng(SEED).standard_normal(s.shape)
    r, a = np.zeros((n, n)), np.zeros((n, n))
    for _ in range(rounds):
        t = a + s
        top = t.argmax(axis=1)
        first = t[np.arange(n), top]
        t[np.arange(n), top] = -np.inf
        new = s - first[:, None]
        new[np.arange(n), top] = s[np.arange(n), top] - t.max(axis=1)
        r = damping * r + (1 - damping) * new
        p = np.maximum(r, 0)
        np.fill_diagonal(p, r.diagonal())
        new = p.sum(axis=0)[None] - p
        own = new.diagonal().copy()
        new = np.minimum(new, 0)
        np.fill_diagonal(new, own)
        a = damping * a + (1 - damping) * new
    exemplars = np.flatnonzero((a + r).diagonal() > 0)
    if not len(exemplars):
        return np.full(n, -1)
    label = s[:, exemplars].argmax(axis=1)
    label[exemplars] = np.arange(len(exemplars))
    sizes = np.bincount(label, minlength=len(exemplars))
    new = np.cumsum(sizes > 1) - 1
    return np.where(sizes[label] > 1, new[label], -1)


def mean_shift(x: np.ndarray, k: int = 0, frames: np.ndarray | None = None, quantile: float = 0.3, rounds: int = 300) -> np.ndarray:
    """Points climb to the mean of their neighbourhood; peaks nearer than the bandwidth are one cluster."""
    d = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(axis=2), 0))
    width = float(np.mean(np.sort(d, axis=1)[:, max(1, int(len(x) * quantile)) - 1])) or 1e-9
    peaks = x.copy()
    for _ in range(rounds):
        near = ((peaks[:, None] - x[None]) ** 2).sum(axis=2) <= width**2
        new = (near @ x) / np.maximum(near.sum(axis=1, keepdims=True), 1)
        if np.abs(new - peaks).max() < 1e-3 * width:
            break
        peaks = new
    label, centers = np.full(len(x), -1), []
    for i in range(len(x)):
        gaps = [np.linalg.norm(peaks[i] - c) for c in centers]
        if gaps and min(gaps) <= width:
            label[i] = int(np.argmin(gaps))
        else:
            label[i] = len(centers)
            centers.append(peaks[i])
    return label


def discretize(v: np.ndarray, seed: int = SEED, rounds: int = 30, starts: int = 30) -> np.ndarray:
    """Labels from eigenvectors (rows: points): the rotation that brings the rows nearest to indicators, by turns with these."""
    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    n, k = v.shape
    rng, best = np.random.default_rng(seed), (-np.inf, np.zeros(n, int))
    for _ in range(starts):
        turn = np.zeros((k, k))
        turn[:, 0] = v[rng.integers(n)]
        far = np.zeros(n)
        for j in range(1, k):  # rows that are the least along those chosen before
            far += np.abs(v @ turn[:, j - 1])
            turn[:, j] = v[far.argmin()]
        last = -np.inf
        for _ in range(rounds):
            label = (v @ turn).argmax(axis=1)
            left, size, right = np.linalg.svd(np.eye(k)[label].T @ v, full_matrices=False)
            if size.sum() - last < 1e-12:
                break
            last, turn = size.sum(), right.T @ left.T
        if last > best[0]:
            best = (last, label)
    return best[1]


def spectral(x: np.ndarray, k: int, frames: np.ndarray | None = None) -> np.ndarray:
    """The leading eigenvectors of the normalised cosine affinity, made discrete."""
    w = 1 - cosine_distances(x)
    root = 1 / np.sqrt(np.maximum(w.sum(axis=1), 1e-12))
    _, v = np.linalg.eigh(root[:, None] * w * root[None])
    return discretize(v[:, -min(k, len(x)) :])


def modularity(x: np.ndarray, k: int = 0, frames: np.ndarray | None = None, cut: float = 0.6, penalty: float = 0.45) -> np.ndarray:
    """Communities of the similarity graph: pairs of one frame are weakened, the lowest `cut` percent of edges dropped;
    points move to the neighbouring community that gains most modularity, communities then become points."""
    w = np.clip(1 - cosine_distances(x), 0, None)
    np.fill_diagonal(w, 0)
    if frames is not None:
        w = np.where(same_frame(frames) > 0, w * penalty, w)
    if len(x) > 1:
        w[w < np.percentile(w[np.triu_indices(len(x), 1)], cut)] = 0
    label = np.arange(len(x))
    while True:
        n, total, degree = len(w), w.sum() or 1.0, w.sum(axis=1)
        part, moved_any, moved = np.arange(n), False, True
        while moved:
            moved = False
            for i in range(n):
                ties = np.bincount(part, weights=w[i], minlength=n)
                ties[part[i]] -= w[i, i]
                sums = np.bincount(part, weights=degree, minlength=n)
                sums[part[i]] -= degree[i]
                gain = ties - degree[i] * sums / total
                best = int(gain.argmax())
                if gain[best] > gain[part[i]] + 1e-12:
                    part[i], moved, moved_any = best, True, True
        if not moved_any:
            return label
        names, part = np.unique(part, return_inverse=True)
        label = part[label]
        one = np.eye(len(names))[part]
        w = one.T @ w @ one


def silhouette(d: np.ndarray, label: np.ndarray) -> float:
    names = np.unique(label)
    if len(names) < 2 or len(names) == len(label):
        return 0.0
    one = (label[:, None] == names[None]).astype(float)
    size, total = one.sum(axis=0), d @ one
    own = one.argmax(axis=1)
    a = total[np.arange(len(d)), own] / np.maximum(size[own] - 1, 1)
    mean = total / size
    mean[np.arange(len(d)), own] = np.inf
    b = mean.min(axis=1)
    top = np.maximum(a, b)
    s = np.where((size[own] > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1), 0)
    return float(s.mean())


def search_k(x: np.ndarray, frames: np.ndarray) -> np.ndarray:
    """Tries k and keeps the labels with the largest silhouette times share of clustered points; noise is clustered again.

    Up to 50 points are clusters of their own.
    """
    n = len(x)
    if n <= 50:
        return np.arange(n)
    top = int(min(max(15, n / 40), 60))
    d, best = cosine_distances(x), (-1.0, np.full(n, -1))
    for k in range(max(5, top // 4), top):
        label = constrained_dbscan(x, k, frames)
        ok = label >= 0
        score = silhouette(d[np.ix_(ok, ok)], label[ok]) * ok.mean() if len(set(label[ok])) > 1 else -1.0
        if score > best[0]:
            best = (score, label)
    return recluster_noise(x, frames, best[1])


def recluster_noise(x: np.ndarray, frames: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Noise gets the labels of its own density clusters, after the largest, if there are two of them or more."""
    spots = np.flatnonzero(label < 0)
    if len(spots) < 2:
        return label
    inner = constrained_optics(x[spots], 0, frames[spots])
    if len(set(inner[inner >= 0])) < 2:
        return label
    out = label.copy()
    out[spots] = np.where(inner >= 0, inner + max(label.max(), -1) + 1, -1)
    return out


METHODS: dict[str, Callable] = {
    "dbscan": constrained_dbscan,
    "optics": constrained_optics,
    "k_means": k_means,
    "k_means_bare": k_means_bare,
    "agglomerative": agglomerative,
    "agglomerative_average": agglomerative_average,
    "affinity_propagation": affinity_propagation,
    "mean_shift": mean_shift,
    "spectral": spectral,
    "modularity": modularity,
    "search": lambda x, k, frames: search_k(x, frames),
}


def identity(x: np.ndarray) -> np.ndarray:
    return x


def l1(x: np.ndarray) -> np.ndarray:
    """By column, as l2 is too."""
    return x / (np.abs(x).sum(axis=0) + 1e-4)


def l2(x: np.ndarray) -> np.ndarray:
    return x / (np.linalg.norm(x, axis=0) + 1e-4)


def pca_whitening(x: np.ndarray, dims: int = 30) -> np.ndarray:
    u, s, _ = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    dims = min(dims, len(x), x.shape[1])
    keep = s[:dims] > 1e-12
    return (u[:, :dims] * keep) * np.sqrt(max(len(x) - 1, 1))


NORMALIZERS: dict[str, Callable] = {"identity": identity, "l1": l1, "l2": l2, "pca_whitening": pca_whitening}


#: Methods that take tubes, the tracks of boxes that are one character.
WITH_TUBES = ("dbscan", "optics")


def cluster(boxes: DataFrame, method: str, k: int, key: str = "video", normalizer: str = "identity", tube: str | None = None) -> DataFrame:
    """(key, box_id, label) by a method of METHODS within each key; rows in order of box_id. Boxes of one value of `tube`
    are not kept apart by the methods WITH_TUBES; a null tube is the box's own."""
    find, scale = METHODS[method], NORMALIZERS[normalizer]
    if tube is not None and method not in WITH_TUBES:
        raise ValueError(f"{method} knows no tubes")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("box_id", ignore_index=True)
        x = np.nan_to_num(np.array(g["features"].tolist(), float))
        more = {}
        if tube is not None:
            own = pd.factorize(g[tube])[0]
            more["tubes"] = np.where(own < 0, -1 - np.arange(len(g)), own)
        frames = pd.factorize(g["keyframe_id"])[0]
        return pd.DataFrame({key: g[key], "box_id": g["box_id"], "label": find(scale(x), k, frames, **more).astype("int64")})

    kind = dict(boxes.dtypes)[key]
    columns = dict.fromkeys([key, "box_id", "keyframe_id", "features", *([tube] if tube else [])])
    return boxes.select(*columns).groupBy(key).applyInPandas(run, f"{key} {kind}, box_id long, label long")
