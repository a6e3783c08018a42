"""Small single-process versions of the iterative operators, for tests on a few hundred rows."""

from __future__ import annotations

import numpy as np


def pairwise(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(-1), 0))


def core(dist: np.ndarray, k: int) -> np.ndarray:
    return np.sort(dist, axis=1)[:, k]


def reach(x: np.ndarray, k: int) -> np.ndarray:
    dist = pairwise(x)
    c = core(dist, k)
    out = np.maximum(dist, np.maximum(c[:, None], c[None]))
    np.fill_diagonal(out, np.inf)
    return out


def prim(weight: np.ndarray) -> np.ndarray:
    """Sorted edge weights of a minimum spanning tree."""
    n = len(weight)
    near, seen, out = weight[0].copy(), np.zeros(n, bool), []
    seen[0] = True
    for _ in range(n - 1):
        j = np.where(seen, np.inf, near).argmin()
        out.append(near[j])
        seen[j] = True
        near = np.minimum(near, weight[j])
    return np.sort(out)


def density_labels(weight: np.ndarray, min_size: int, tiny: float = 1e-10) -> np.ndarray:
    """Clusters by excess of mass from full pairwise reachability, by recursion over threshold graphs."""
    n = len(weight)
    labels = np.full(n, -1)

    def parts(members, limit):
        left, out = set(members), []
        while left:
            stack = [left.pop()]
            part = set(stack)
            while stack:
                i = stack.pop()
                for j in [j for j in left if weight[i, j] < limit]:
                    left.discard(j)
                    part.add(j)
                    stack.append(j)
            out.append(sorted(part))
        return out

    def heaviest(members):
        sub = weight[np.ix_(members, members)]
        return prim(sub)[-1]

    def solve(members, birth, root):
        """(best stability, chosen member lists) of the cluster starting with ``members``."""
        stability, current = 0.0, members
        while True:
            if len(current) == 1:
                limit = np.inf
            limit = heaviest(current)
            density = 1 / max(limit, tiny)
            split = parts(current, limit)
            big = [p for p in split if len(p) >= min_size]
            stability += (density - birth) * sum(len(p) for p in split if len(p) < min_size)
            if len(big) == 1:
                current = big[0]
                continue
            if not big:
                return stability, [] if root else [members]
            stability += (density - birth) * sum(len(p) for p in big)
            best, chosen = 0.0, []
            for p in big:
                value, lists = solve(p, density, False)
                best += value
                chosen += lists
            if root or best > stability:
                return best, chosen
            return stability, [members]

    if n >= min_size:
        for i, members in enumerate(sorted(solve(list(range(n)), 0.0, True)[1], key=min)):
            labels[members] = i
    return labels
