"""A balanced tree over one task's points, asked for many points at once. Numpy only; answers are exact."""

from __future__ import annotations

import numpy as np

#: Points in a leaf; pairs of a point and a node that are looked at in one step.
LEAF, STEP = 16, 1 << 15


def squared(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    return x * x + y * y + z * z


class Tree:
    """Halves along the widest axis until a node has few points; every node has its box."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        self.depth = max(0, int(np.ceil(np.log2(len(points) / leaf))))
        size = -(-len(points) >> self.depth) if self.depth else len(points)
        # The last point stands in where leaves would not be full.
        rest = points[np.minimum(np.arange(size << self.depth), len(points) - 1)]
        self.low, self.high = [], []
        for level in range(self.depth + 1):
            nodes = rest.reshape(1 << level, -1, 3)
            self.low.append(nodes.min(1))
            self.high.append(nodes.max(1))
            if level < self.depth:
                axis = (self.high[-1] - self.low[-1]).argmax(1)
                along = np.take_along_axis(nodes, axis[:, None, None], 2)[:, :, 0]
                halves = np.argpartition(along, nodes.shape[1] // 2, axis=1)
                rest = np.take_along_axis(nodes, halves[:, :, None], 1)
        self.leaves = [np.ascontiguousarray(rest.reshape(1 << self.depth, size, 3)[:, :, i]) for i in range(3)]

    def to_box(self, level: int, node: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Squared distances to boxes, never above those to the points within, rounding included."""
        return squared(*outside(self.low[level][node], self.high[level][node], at).T)

    def to_leaf(self, node: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.empty(len(node))
        for lo in range(0, len(node), STEP):
            part = slice(lo, lo + STEP)
            out[part] = squared(*(self.leaves[i][node[part]] - at[part, i, None] for i in range(3))).min(1)
        return out

    def nearest(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The squared distance from each place to its nearest point, or its bound where that is less."""
        home = np.zeros(len(at), int)
        for level in range(1, self.depth + 1):
            left = home * 2
            home = left + (self.to_box(level, left + 1, at) < self.to_box(level, left, at))
        best = np.fmin(bound, self.to_leaf(home, at))
        # Parts wait on a stack, the deepest on top, so their number stays small however many nodes are as near as the best.
        wait = [(0, np.arange(len(at)), np.zeros(len(at), int))]
        while wait:
            level, i, node = wait.pop()
            if level == self.depth:
                away = node != home[i]
                i, node = i[away], node[away]
                np.minimum.at(best, i, self.to_leaf(node, at[i]))
                continue
            i, node = np.concatenate([i, i]), np.concatenate([node * 2, node * 2 + 1])
            near = self.to_box(level + 1, node, at[i]) < best[i]
            i, node = i[near], node[near]
            wait += [(level + 1, i[lo : lo + STEP], node[lo : lo + STEP]) for lo in range(0, len(i), STEP)]
        return best


def outside(low: np.ndarray, high: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How far places are out of boxes on each axis; 0 within."""
    return np.maximum(np.maximum(low - at, at - high), 0.0)
