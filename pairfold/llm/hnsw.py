"""A hierarchical navigable small-world graph of one shard, in numpy.

Vectors are inserted and searched in batches: all queries of a batch walk the graph side by side,
each with its own beam. Searches use single precision; callers verify what they get.
"""

from __future__ import annotations

import io

import numpy as np

M, M0, BUILD_BEAM, BATCH = 12, 24, 48, 256


def _search(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and similarities (queries x beam) of what the beams hold, the best first; -1 for none.

    ``entry``: places to start from, queries x any number.
    """
    n, wide = len(queries), max(beam, entry.shape[1])
    step = max(1, beam // 16)
    rows = np.arange(n)
    place = np.full((n, wide), -1, dtype=np.int32)
    sim = np.full((n, wide), -np.inf, dtype=np.float32)
    done = np.zeros((n, wide), dtype=bool)
    seen = np.zeros((n, len(vectors)), dtype=bool)
    place[:, : entry.shape[1]] = entry
    sim[:, : entry.shape[1]] = np.einsum("qkd,qd->qk", vectors[entry], queries)
    seen[rows[:, None], entry] = True
    live = rows
    while len(live):
        open_sim = np.where(done[live], -np.inf, sim[live])
        k = min(step, wide)
        pick = np.argpartition(-open_sim, k - 1, axis=1)[:, :k] if k < wide else np.broadcast_to(np.arange(wide), (len(live), wide))
        ok = np.isfinite(np.take_along_axis(open_sim, pick, axis=1))
        more = ok.any(axis=1)
        live, pick, ok = live[more], pick[more], ok[more]
        if not len(live):
            break
        done[live[:, None], pick] |= ok
        from_ = np.where(ok, place[live[:, None], pick], 0)
        near = np.where(ok[:, :, None], links[from_], -1).reshape(len(live), -1)
        q, c = np.nonzero(near >= 0)
        target = near[q, c]
        fresh = ~seen[live[q], target]
        q, target = q[fresh], target[fresh]
        _, first = np.unique(q.astype(np.int64) * len(vectors) + target, return_index=True)
        q, target = q[first], target[first]
        if not len(q):
            continue
        seen[live[q], target] = True
        s = np.einsum("kd,kd->k", vectors[target], queries[live[q]])
        new = int(np.bincount(q, minlength=len(live)).max())
        column = np.arange(len(q)) - np.r_[0, np.cumsum(np.bincount(q, minlength=len(live)))[:-1]][q]
        add_place = np.full((len(live), new), -1, dtype=np.int32)
        add_sim = np.full((len(live), new), -np.inf, dtype=np.float32)
        add_place[q, column], add_sim[q, column] = target, s
        all_sim = np.concatenate([sim[live], add_sim], axis=1)
        keep = np.argpartition(-all_sim, wide - 1, axis=1)[:, :wide] if new else np.broadcast_to(np.arange(wide), (len(live), wide))
        sim[live] = np.take_along_axis(all_sim, keep, axis=1)
        place[live] = np.take_along_axis(np.concatenate([place[live], add_place], axis=1), keep, axis=1)
        done[live] = np.take_along_axis(np.concatenate([done[live], np.zeros_like(add_place, dtype=bool)], axis=1), keep, axis=1)
    order = np.argsort(-sim, axis=1, kind="stable")
    return np.take_along_axis(place, order, axis=1), np.take_along_axis(sim, order, axis=1)


def _diverse(vectors: np.ndarray, place: np.ndarray, sim: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (the best first) those that are closer to it than to one chosen before; then the next best."""
    n, k = place.shape
    own = vectors[np.maximum(place, 0)]
    among = np.einsum("nad,nbd->nab", own, own)
    chosen = np.zeros((n, k), dtype=bool)
    blocked = np.full((n, k), -np.inf, dtype=np.float32)
    for c in range(k):
        take = (place[:, c] >= 0) & (sim[:, c] > blocked[:, c]) & (chosen.sum(axis=1) < most)
        chosen[:, c] = take
        blocked = np.where(take[:, None], np.maximum(blocked, among[:, c, :]), blocked)
    rank = np.where(place < 0, 2 * k + np.arange(k), np.where(chosen, 0, k) + np.arange(k))
    order = np.argsort(rank, axis=1)[:, :most]
    out = np.take_along_axis(place, order, axis=1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1) if out.shape[1] < most else out


def _connect(vectors: np.ndarray, links: np.ndarray, new: np.ndarray, place: np.ndarray, sim: np.ndarray) -> None:
    """Link the places ``new`` to the best of their candidates and back."""
    most = links.shape[1]
    got = _diverse(vectors, place, sim, most)
    links[new] = got
    a, c = np.nonzero(got >= 0)
    back, source = got[a, c], new[a]
    order = np.argsort(back, kind="stable")
    back, source = back[order], source[order]
    nodes, start, count = np.unique(back, return_index=True, return_counts=True)
    for at in range(0, len(nodes), BATCH):
        some, first, size = nodes[at : at + BATCH], start[at : at + BATCH], count[at : at + BATCH]
        wide = int(size.max())
        extra = np.full((len(some), wide), -1, dtype=np.int32)
        col = np.arange(wide)
        inside = col[None, :] < size[:, None]
        extra[inside] = source[(first[:, None] + col)[inside]]
        extra = np.where((extra[:, :, None] == links[some][:, None, :]).any(axis=2), -1, extra)
        every = np.concatenate([links[some], extra], axis=1)
        s = np.where(every >= 0, np.einsum("nkd,nd->nk", vectors[np.maximum(every, 0)], vectors[some]), -np.inf)
        best = np.argsort(-s, axis=1, kind="stable")[:, : most + 64]
        links[some] = _diverse(vectors, np.take_along_axis(every, best, axis=1), np.take_along_axis(s, best, axis=1), most)


class Graph:
    """``levels``: places of each level's vectors and their links, the bottom level first."""

    def __init__(self, vectors: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.vectors, self.levels = vectors.astype(np.float32), levels

    @classmethod
    def build(cls, vectors: np.ndarray) -> Graph:
        """The vectors' order decides their levels; give them in a random one."""
        v = vectors.astype(np.float32)
        levels, n = [], len(v)
        while n and (not levels or n > 1):  # the first n vectors make up a level
            most = M if levels else M0
            links = np.full((n, most), -1, dtype=np.int32)
            at = 1
            while at < n:
                new = np.arange(at, min(n, at + min(BATCH, at)))
                entry = np.tile(np.unique(np.linspace(0, at - 1, min(at, 8)).astype(np.int32)), (len(new), 1))
                place, sim = _search(v[:n], links, v[new], entry, BUILD_BEAM)
                near = v[new] @ v[new].T
                np.fill_diagonal(near, -np.inf)
                best = np.argsort(-near, axis=1, kind="stable")[:, : min(len(new) - 1, most)]
                place = np.concatenate([place, new[best].astype(np.int32)], axis=1)
                sim = np.concatenate([sim, np.take_along_axis(near, best, axis=1)], axis=1)
                order = np.argsort(-sim, axis=1, kind="stable")
                _connect(v[:n], links, new, np.take_along_axis(place, order, axis=1), np.take_along_axis(sim, order, axis=1))
                at = int(new[-1]) + 1
            levels.append((np.arange(n, dtype=np.int32), links))
            n //= M
        graph = cls(v, levels)
        graph._reach_all()
        return graph

    def _reach_all(self) -> None:
        """Give each vector that no path of the bottom level leads to a link from its nearest one that has."""
        if not self.levels:
            return
        places, links = self.levels[0]
        reached = np.zeros(len(places), dtype=bool)
        front = np.array([0])
        extra: dict[int, list[int]] = {}
        while True:
            while len(front):
                reached[front] = True
                near = np.unique(links[front])
                front = near[(near >= 0)]
                front = front[~reached[front]]
            lost = np.flatnonzero(~reached)
            if not len(lost):
                break
            known = np.flatnonzero(reached)
            best = known[(self.vectors[known] @ self.vectors[lost[0]]).argmax()]
            extra.setdefault(int(best), []).append(int(lost[0]))
            front = lost[:1]
        if extra:
            wide = np.full((len(places), max(map(len, extra.values()))), -1, dtype=np.int32)
            for k, x in extra.items():
                wide[k, : len(x)] = x
            self.levels[0] = places, np.concatenate([links, wide], axis=1)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        q = queries.astype(np.float32)
        entry = np.zeros((len(q), 1), dtype=np.int32)
        for places, links in self.levels[:0:-1]:
            entry = _search(self.vectors[: len(places)], links, q, entry, 1)[0][:, :1]
        return _search(self.vectors, self.levels[0][1], q, entry, min(beam, len(self.vectors)))

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, **{f"links{k}": links for k, (_, links) in enumerate(self.levels)})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, vectors: np.ndarray, data: bytes) -> Graph:
        held = np.load(io.BytesIO(data))
        return cls(vectors, [(np.arange(len(held[f"links{k}"]), dtype=np.int32), held[f"links{k}"]) for k in range(len(held.files))])
