"""Nearest palette entries by a k-d tree over Lab, with exact ties, and clusters and boxes of packed colours."""

from __future__ import annotations

import numpy as np
import pandas as pd

from atlasmill.functions import color as c

LEAF = 16


_BYTES = np.arange(256) / 255.0
_LINEAR = np.where(_BYTES <= 0.04045, _BYTES / 12.92, ((_BYTES + 0.055) / 1.055) ** 2.4)


def linear_of(rgb: np.ndarray) -> np.ndarray:
    """Linear light of the channels of packed colours."""
    return _LINEAR[np.stack([rgb >> 16 & 255, rgb >> 8 & 255, rgb & 255], axis=-1)]


def lab_of(rgb: np.ndarray) -> np.ndarray:
    """CIE Lab of packed colours."""
    rows = np.array(c.XYZ_ROWS)
    t = linear_of(rgb) @ rows[:, :3].T / rows[:, 3]
    f = np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16.0 / 116.0)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], axis=-1)


def _ticks(square: np.ndarray) -> np.ndarray:
    """Squared distances in billionths, the unit in which ties are exact."""
    return np.floor(square * 1e9 + 0.5).astype(np.int64)


class ColorTree:
    """Palette entries as rows of ``lab``; of entries at equal distance the first is the nearest.

    All queries of a batch walk down together. A half of the space is left out for the queries whose
    best distance is smaller than the distance to it, and kept on a tie, so the result is that of
    comparing every pair. A palette of one leaf is compared as a whole.
    """

    def __init__(self, lab: np.ndarray):
        self.lab = lab
        self.root = self._build(np.arange(len(lab)))

    def _build(self, entries: np.ndarray):
        spread = np.ptp(self.lab[entries], axis=0)
        if len(entries) <= LEAF or not spread.any():
            return np.sort(entries)
        axis = int(spread.argmax())
        order = entries[np.argsort(self.lab[entries, axis], kind="stable")]
        half = len(order) // 2
        low, high = order[:half], order[half:]
        return axis, self.lab[low[-1], axis], self.lab[high[0], axis], self._build(low), self._build(high)

    def nearest(self, lab: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(entry, distance)`` of each query row, the squared distance in billionths."""
        best = np.full(len(lab), np.iinfo(np.int64).max)
        entry = np.full(len(lab), len(self.lab))
        for at in range(0, len(lab), 4096):
            self._visit(self.root, lab, np.arange(at, min(at + 4096, len(lab))), best, entry)
        return entry, best

    def _visit(self, node, lab, rows, best, entry) -> None:
        if not len(rows):
            return
        if isinstance(node, np.ndarray):
            gap = lab[rows, None, :] - self.lab[None, node, :]
            ticks = _ticks(gap[..., 0] ** 2 + gap[..., 1] ** 2 + gap[..., 2] ** 2)
            first = ticks.argmin(axis=1)
            found, near = node[first], ticks[np.arange(len(rows)), first]
            better = (near < best[rows]) | ((near == best[rows]) & (found < entry[rows]))
            best[rows[better]], entry[rows[better]] = near[better], found[better]
            return
        axis, low, high, left, right = node
        value = lab[rows, axis]
        goes_left = value - low <= high - value
        self._visit(left, lab, rows[goes_left], best, entry)
        self._visit(right, lab, rows[~goes_left], best, entry)
        beyond = np.where(goes_left, high - value, value - low)
        open_ = (beyond <= 0) | (_ticks(beyond ** 2) <= best[rows])
        self._visit(right, lab, rows[goes_left & open_], best, entry)
        self._visit(left, lab, rows[~goes_left & open_], best, entry)


# --- rows of packed colours ------------------------------------------------------------
#
# A row holds the colours of one chunk of an image as arrays, with arrays that all chunks of the image
# share: its palette (``idx, p_rgb``) or its tree of boxes (``low, high, pick, limit``).

def lab_or_nan(rgb: np.ndarray) -> np.ndarray:
    lab = np.full((len(rgb), 3), np.nan)
    known = ~np.isnan(rgb)
    lab[known] = lab_of(rgb[known].astype(np.int64))
    return lab


def over_chunks(batches, names: list[str], emit, prepare):
    """One frame per batch from ``emit(row, shared)``, a tuple of equally long arrays per row; ``prepare(row)`` runs once an image."""
    image, shared = None, None
    for batch in batches:
        ids, parts = [], []
        for row in batch.itertuples(index=False):
            if shared is None or row.image_id != image:
                image, shared = row.image_id, prepare(row)
            parts.append(emit(row, shared))
            ids.append(row.image_id)
        if parts:
            found = {name: np.concatenate([part[k] for part in parts]) for k, name in enumerate(names)}
            yield pd.DataFrame({"image_id": np.repeat(ids, [len(part[0]) for part in parts])} | found)


def floats(values) -> np.ndarray:
    return np.asarray(values, dtype=float)


def palette_of(row):
    return np.asarray(row.idx), floats(row.p_rgb), ColorTree(lab_or_nan(floats(row.p_rgb)))


def nearest_entries(row, palette):
    """``rgb, n, d, idx, near_rgb`` of every colour."""
    idx, p_rgb, tree = palette
    rgb = floats(row.rgb)
    entry, d = tree.nearest(lab_or_nan(rgb))
    # an unknown entry is the smallest number, which has black channels
    return rgb, np.asarray(row.n), d, idx[entry], np.where(np.isnan(p_rgb), np.iinfo(np.int32).min, p_rgb)[entry]


def _linear(rgb: np.ndarray) -> np.ndarray:
    known = np.where(np.isnan(rgb), 0, rgb).astype(np.int64)
    return np.where(np.isnan(rgb)[:, None], np.nan, linear_of(known))


def cluster_sums(row, entry, idx, space: str, weighted: bool):
    """``idx, w, s0, s1, s2`` of the clusters met in a chunk; the sums leave out unknown colours."""
    rgb = floats(row.rgb)
    w = floats(row.n) if weighted else np.ones(len(rgb))
    values = np.nan_to_num(lab_or_nan(rgb) if space == "lab" else _linear(rgb))
    met = np.bincount(entry, minlength=len(idx)) > 0
    sums = [np.bincount(entry, weights=w * v, minlength=len(idx))[met] for v in (1.0, *values.T)]
    return idx[met], *sums


def nearest_members(row, entry, idx):
    """``idx, d, y, x, rgb``: of every cluster met in a chunk the colour nearest to its mean ``t_l, t_a, t_b``."""
    return _nearest_to(row, entry, idx, np.stack([floats(row.t_l), floats(row.t_a), floats(row.t_b)], axis=-1))


def _nearest_to(row, entry, idx, mean):
    rgb = floats(row.rgb)
    gap = lab_or_nan(rgb) - mean[entry]
    d = _ticks(gap[:, 0] ** 2 + gap[:, 1] ** 2 + gap[:, 2] ** 2)
    y, x = np.asarray(row.y), np.asarray(row.x)
    order = np.lexsort((x, y, d, entry))
    met, first = np.unique(entry[order], return_index=True)
    best = order[first]
    return idx[met], d[best], y[best], x[best], rgb[best]


def packed_of_linear(light: np.ndarray) -> np.ndarray:
    """Packed sRGB of linear light, half-even rounded."""
    srgb = np.where(light <= 0.0031308, light * 12.92, 1.055 * np.power(np.maximum(light, 0), 1 / 2.4) - 0.055)
    r, g, b = np.clip(np.rint(srgb * 255), 0, 255).astype(np.int64).T
    return r << 16 | g << 8 | b


def whole_clusters(row, k: int, space: str, weighted: bool, rounds: int):
    """``idx, rgb``: the k-means palette of an image whose colours are all in this row, by the steps that chunks take."""
    rgb = floats(row.rgb)
    lab = lab_or_nan(rgb)
    palette = rgb[:k].copy()
    idx = np.arange(len(palette))
    for _ in range(rounds):
        entry = ColorTree(lab_or_nan(palette)).nearest(lab)[0]
        met, w, *sums = cluster_sums(row, entry, idx, space, weighted)
        means = np.stack(sums, axis=-1) / w[:, None]
        aim = np.full((len(idx), 3), np.nan)
        aim[met] = means if space == "lab" else lab_of(packed_of_linear(means))
        met, _, _, _, best = _nearest_to(row, entry, idx, aim)
        known = ~np.isnan(best)  # a cluster of unknown colours stays
        palette[met[known]] = best[known]
    return idx, palette


def boxes_of(row):
    return [np.asarray(v) for v in (row.low, row.high, row.pick, row.limit)]


def _box_of(rgb: np.ndarray, boxes) -> tuple[np.ndarray, np.ndarray]:
    """``(node, channels)`` of every colour: down the tree, to the low side up to the limit of a box."""
    low, high, pick, limit = boxes
    channels = np.stack([rgb >> 16, rgb >> 8 & 255, rgb & 255], axis=-1)
    at, row = np.zeros(len(rgb), dtype=np.int64), np.arange(len(rgb))
    while (inner := low[at] >= 0).any():
        side = np.where((channels[row, pick[at]] << 24 | rgb) <= limit[at], low[at], high[at])
        at = np.where(inner, side, at)
    return at, channels


def known_colors(row) -> tuple[np.ndarray, np.ndarray]:
    rgb = floats(row.rgb)
    known = ~np.isnan(rgb)
    return rgb[known].astype(np.int64), known


def box_histograms(row, boxes):
    """``node, channel, value, size, pixels`` of the colours in open boxes; unknown colours of the first box have value -1."""
    rgb, known = known_colors(row)
    node, channels = _box_of(rgb, boxes)
    n, open_ = np.asarray(row.n)[known], np.asarray(row.open)[node]
    out = []
    for k in range(3):
        keys, back = np.unique(node[open_] << 8 | channels[open_, k], return_inverse=True)
        out.append((keys >> 8, np.full(len(keys), k), keys & 255, np.bincount(back, minlength=len(keys)),
                    np.bincount(back, weights=n[open_], minlength=len(keys)).astype(np.int64)))
    if len(boxes[0]) == 1 and not known.all():
        pixels = np.full(3, np.asarray(row.n)[~known].sum())
        out.append((np.zeros(3, dtype=np.int64), np.arange(3), np.full(3, -1), np.full(3, (~known).sum()), pixels))
    return tuple(np.concatenate(v) for v in zip(*out))


def colors_at_cut(row, boxes):
    """``node, rgb, n`` of the colours in open boxes whose picked channel has the value where the box is cut."""
    rgb, known = known_colors(row)
    node, channels = _box_of(rgb, boxes)
    here = np.asarray(row.open)[node] & (channels[np.arange(len(rgb)), boxes[2][node]] == np.asarray(row.value)[node])
    return node[here], rgb[here], np.asarray(row.n)[known][here]


def boxed(row, boxes):
    """``rgb, n, y, x, box`` of every known colour."""
    rgb, known = known_colors(row)
    box = np.asarray(row.box)[_box_of(rgb, boxes)[0]]
    return rgb, np.asarray(row.n)[known], np.asarray(row.y)[known], np.asarray(row.x)[known], box


def box_labels(row, boxes):
    """Position of every colour's box among the box numbers ``idx``, and these numbers."""
    idx = np.asarray(row.idx)
    return np.searchsorted(idx, np.asarray(row.box)[_box_of(floats(row.rgb).astype(np.int64), boxes)[0]]), idx
