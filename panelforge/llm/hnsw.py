"""A hierarchical navigable small-world graph in NumPy, built and searched in batches.

Nodes are ordered by level, so layer ``l`` holds the nodes ``0 .. size(l) - 1``. Layers are
built from the top down; a batch of new nodes is searched in the graph so far, compared within
itself, and linked to neighbours that are nearer to it than to each other.
"""

from __future__ import annotations

import numpy as np

LINKS = 16
BUILD_BEAM = 64
FANOUT = 16
TOP = 64
BATCH = 512
STEP = 4
FAR = np.float32(-3.0)


class Hnsw:
    """Index of unit vectors (float32, one per row) by inner product."""

    def __init__(self, x: np.ndarray, links: int = LINKS, build_beam: int = BUILD_BEAM, seed: int = 7):
        self.order = np.random.default_rng(seed).permutation(len(x))
        self.x = np.ascontiguousarray(x[self.order], dtype=np.float32)
        self.links, self.build_beam = links, build_beam
        sizes = [len(x)]
        while sizes[-1] > TOP:
            sizes.append(-(-sizes[-1] // FANOUT))
        self.sizes = sizes
        self.layers: list[np.ndarray] = [np.empty((0, 0), dtype=np.int64)] * len(sizes)
        for layer in reversed(range(len(sizes) - 1)):
            self._build(layer)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers of ``x`` (-1: none) and similarities of the best ``beam`` found, best first."""
        ids, sims = self._find(q, 0, beam, len(self.x))
        return np.where(ids >= 0, self.order[ids], -1), sims

    # --- build ------------------------------------------------------------------
    def _build(self, layer: int) -> None:
        n, most = self.sizes[layer], self.links * (2 if layer == 0 else 1)
        self.layers[layer] = np.full((n, most), -1, dtype=np.int64)
        done = 0
        while done < n:
            new = np.arange(done, min(n, done + max(2 * TOP, min(done, BATCH))))
            sims = self.x[new] @ self.x[new].T
            np.fill_diagonal(sims, FAR)
            width = min(len(new), self.build_beam)
            near = np.argpartition(-sims, width - 1, axis=1)[:, :width]
            cand, score = new[near], np.take_along_axis(sims, near, axis=1)
            cand = np.where(score > FAR, cand, -1)
            if done:
                ids, found = self._find(self.x[new], layer, self.build_beam, done)
                cand, score = np.concatenate([cand, ids], axis=1), np.concatenate([score, found], axis=1)
            chosen = self._select(cand, score, self.links)
            self.layers[layer][new, : chosen.shape[1]] = chosen
            self._link_back(layer, new, chosen, most)
            done = int(new[-1]) + 1

    def _select(self, cand: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` candidates per row: first those nearer to the row than to one chosen before, then the nearest."""
        best = np.argsort(-score, axis=1, kind="stable")[:, : 4 * most]
        cand, score = np.take_along_axis(cand, best, axis=1), np.take_along_axis(score, best, axis=1)
        vectors = self.x[cand]
        between = vectors @ vectors.transpose(0, 2, 1)
        spread = np.zeros(cand.shape, dtype=bool)
        for i in range(cand.shape[1]):
            rival = np.where(spread, between[:, i, :], FAR).max(axis=1)
            spread[:, i] = (cand[:, i] >= 0) & (rival < score[:, i])
        first = np.where(cand < 0, 2, np.where(spread, 0, 1))
        keep = np.argsort(first, axis=1, kind="stable")[:, :most]
        return np.take_along_axis(cand, keep, axis=1)

    def _link_back(self, layer: int, new: np.ndarray, chosen: np.ndarray, most: int) -> None:
        table = self.layers[layer]
        source = np.repeat(new, chosen.shape[1])
        target = chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        score = np.einsum("ij,ij->i", self.x[source], self.x[target])
        order = np.lexsort((-score, target))
        source, target = source[order], target[order]
        nodes, start, count = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(start, count)
        wide = min(int(count.max(initial=0)), 4 * most)
        incoming = np.full((len(nodes), wide), -1, dtype=np.int64)
        fits = place < wide
        incoming[np.repeat(np.arange(len(nodes)), count)[fits], place[fits]] = source[fits]
        for at in range(0, len(nodes), BATCH):
            rows = nodes[at : at + BATCH]
            cand = np.concatenate([table[rows], incoming[at : at + BATCH]], axis=1)
            cand = np.sort(cand, axis=1)
            cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
            sims = (self.x[cand] @ self.x[rows][:, :, None])[:, :, 0]
            table[rows] = self._select(cand, np.where(cand >= 0, sims, FAR), most)[:, :most]

    # --- search -----------------------------------------------------------------
    def _find(self, q: np.ndarray, layer: int, beam: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Search down to ``layer``, whose first ``limit`` nodes are linked so far."""
        top = len(self.sizes) - 1
        if top == layer:
            sims = q @ self.x.T
            return np.argsort(-sims, axis=1)[:, :beam], -np.sort(-sims, axis=1)[:, :beam]
        sims = q @ self.x[: self.sizes[top]].T
        entry = np.argsort(-sims, axis=1)[:, :STEP]
        for lower in reversed(range(layer + 1, top)):
            entry = self._beam(q, lower, entry, 2 * STEP, self.sizes[lower])[0]
        return self._beam(q, layer, entry, beam, limit)

    def _beam(self, q: np.ndarray, layer: int, entry: np.ndarray, beam: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
        parts = [self._beam_part(q[i : i + BATCH], layer, entry[i : i + BATCH], beam, limit) for i in range(0, len(q), BATCH)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _beam_part(self, q, layer, entry, beam, limit):
        table, b = self.layers[layer], len(q)
        seen = np.zeros((b, limit), dtype=bool)
        ids = np.full((b, beam), -1, dtype=np.int64)
        sims = np.full((b, beam), FAR, dtype=np.float32)
        closed = np.ones((b, beam), dtype=bool)
        entry = entry[:, :beam]
        entry = np.where(entry < limit, entry, -1)
        k = entry.shape[1]
        ids[:, :k], closed[:, :k] = entry, entry < 0
        start = (self.x[entry] @ q[:, :, None])[:, :, 0]
        sims[:, :k] = np.where(entry >= 0, start, FAR)
        rows = np.repeat(np.arange(b), k)[entry.ravel() >= 0]
        seen[rows, entry.ravel()[entry.ravel() >= 0]] = True
        active = np.arange(b)
        while len(active):
            pick = np.argsort(closed[active], axis=1, kind="stable")[:, :STEP]
            open_ = ~np.take_along_axis(closed[active], pick, axis=1)
            at = np.take_along_axis(ids[active], pick, axis=1)
            closed[active[:, None], pick] = True
            near = np.where(open_[:, :, None], table[at], -1).reshape(len(active), -1)
            near = np.sort(near, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            fresh = (near >= 0) & ~seen[active[:, None], near]
            r, c = np.nonzero(fresh)
            found = near[r, c]
            seen[active[r], found] = True
            new_sims = np.full(near.shape, FAR, dtype=np.float32)
            new_sims[r, c] = np.einsum("ij,ij->i", self.x[found], q[active[r]])
            all_ids = np.concatenate([ids[active], np.where(fresh, near, -1)], axis=1)
            all_sims = np.concatenate([sims[active], new_sims], axis=1)
            all_closed = np.concatenate([closed[active], ~fresh], axis=1)
            best = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            ids[active] = np.take_along_axis(all_ids, best, axis=1)
            sims[active] = np.take_along_axis(all_sims, best, axis=1)
            closed[active] = np.take_along_axis(all_closed, best, axis=1)
            active = active[~closed[active].all(axis=1)]
        return ids, sims
