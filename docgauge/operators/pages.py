"""What pages' arrays need beyond expressions: overlapping boxes by a sweep, greedy matches, inversions by merging.

Each function takes Arrow lists, a list a page, and works on all pages of a batch
at once with numpy; a page is a row, so nothing is shuffled.  Time is n log n in a
page's blocks, and for overlaps in the pairs that meet on one axis.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Elements of all lists, and offsets; null counts as empty."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return pc.list_flatten(lists), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _boxes(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(corners, page, index in the page) of boxes of four numbers, and offsets of all."""
    boxes, offsets = _flat(lists)
    whole = np.flatnonzero(pc.fill_null(pc.list_value_length(boxes), 0).to_numpy(zero_copy_only=False) == 4)
    corners = pc.list_flatten(boxes.take(pa.array(whole))).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, 4)
    known = ~np.isnan(corners).any(axis=1)
    whole, corners = whole[known], corners[known]
    page = np.searchsorted(offsets, whole, "right") - 1
    return corners, page, whole - offsets[page], offsets


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    upto = np.cumsum(size)
    return np.arange(upto[-1] if len(upto) else 0) + np.repeat(first - upto + size, size)


def _meeting(p: np.ndarray, g: np.ndarray, p_page: np.ndarray, g_page: np.ndarray, pages: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a page whose sides overlap on that axis on which fewer of the page's do.

    Of two sides that overlap one begins within the other: either the true one
    within the predicted one, or the other way round.  Both are ranges of a sorted
    list of beginnings.
    """
    plans = []
    for axis in (0, 1):
        ends = np.concatenate([p[:, axis], p[:, axis + 2], g[:, axis], g[:, axis + 2]])
        distinct, rank = np.unique(ends, return_inverse=True)
        wide, n, m = len(distinct) + 1, len(p), len(g)
        p_lo, p_hi = p_page * wide + rank[:n], p_page * wide + rank[n : 2 * n]
        g_lo, g_hi = g_page * wide + rank[2 * n : 2 * n + m], g_page * wide + rank[2 * n + m :]
        p_order, g_order = np.argsort(p_lo, kind="stable"), np.argsort(g_lo, kind="stable")
        a = np.searchsorted(g_lo[g_order], p_lo, "right")
        within_p = np.maximum(0, np.searchsorted(g_lo[g_order], p_hi, "left") - a)
        b = np.searchsorted(p_lo[p_order], g_lo, "left")
        within_g = np.maximum(0, np.searchsorted(p_lo[p_order], g_hi, "left") - b)
        met = np.bincount(p_page, within_p, pages) + np.bincount(g_page, within_g, pages)
        plans.append((a, within_p, b, within_g, p_order, g_order, met))
    pick = plans[1][-1] < plans[0][-1]
    left, right = [], []
    for (a, within_p, b, within_g, p_order, g_order, _), own in zip(plans, (~pick, pick)):
        n, m = np.where(own[p_page], within_p, 0), np.where(own[g_page], within_g, 0)
        left += [np.repeat(np.arange(len(p)), n), p_order[_ranges(b, m)]]
        right += [g_order[_ranges(a, n)], np.repeat(np.arange(len(g)), m)]
    return np.concatenate(left), np.concatenate(right)


def overlapping(pred: pa.Array, gt: pa.Array, clamp: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(page, prediction, true box, overlap) of all pairs of a page with an overlap above 0, in no order."""
    (p, p_page, p_at, _), (g, g_page, g_at, _) = _boxes(pred), _boxes(gt)
    if not len(p) or not len(g):
        return (*(np.empty(0, np.int64),) * 3, np.empty(0))
    i, j = _meeting(p, g, p_page, g_page, len(pred))
    a, b = p[i], g[j]
    wide = np.maximum(0.0, np.minimum(a[:, 2], b[:, 2]) - np.maximum(a[:, 0], b[:, 0]))
    high = np.maximum(0.0, np.minimum(a[:, 3], b[:, 3]) - np.maximum(a[:, 1], b[:, 1]))
    area = lambda x: np.maximum(0.0, (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])) if clamp else (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        both = wide * high
        union = area(a) + area(b) - both
        value = np.where(union > 0, both / union, 0.0)
    some = value > 0
    return p_page[i[some]], p_at[i[some]], g_at[j[some]], value[some]


def greedy(pred: pa.Array, gt: pa.Array, at_least: float, strict: bool, policy: str, clamp: bool) -> pa.Array:
    """Per page its matches (p, g, iou): each prediction in turn takes the best (or with `first` the first) free true box that is good enough."""
    page, p, g, value = overlapping(pred, gt, clamp)
    good = value > at_least if strict else value >= at_least
    page, p, g, value = page[good], p[good], g[good], value[good]
    order = np.lexsort((g, -value, p, page) if policy == "best" else (g, p, page))
    page, p, g, value = page[order], p[order], g[order], value[order]
    _, gt_offsets = _flat(gt)
    # a prediction with candidates is a turn; the k-th turns of all pages are taken together, as no page looks at another
    begins = np.flatnonzero(np.concatenate([[True], (np.diff(page) != 0) | (np.diff(p) != 0)])) if len(page) else np.empty(0, np.int64)
    size, of_page = np.diff(begins, append=len(page)), page[begins]
    turn = np.arange(len(begins)) - np.searchsorted(of_page, of_page, "left")
    by_turn = np.argsort(turn, kind="stable")
    rows = _ranges(begins[by_turn], size[by_turn])
    upto = np.concatenate([[0], np.cumsum(size[by_turn])])
    ends = upto[np.searchsorted(turn[by_turn], np.arange(1, (turn.max() if len(turn) else 0) + 2), "left")] if len(turn) else np.empty(0, np.int64)
    box, group = (gt_offsets[page] + g)[rows], np.repeat(np.arange(len(begins)), size[by_turn])
    used, taken, a = np.zeros(gt_offsets[-1] + 1, bool), [], 0
    for b in ends.tolist():
        free = np.flatnonzero(~used[box[a:b]]) + a
        if len(free):
            own = group[free]
            first = free[np.concatenate([[True], own[1:] != own[:-1]])]
            used[box[first]] = True
            taken.append(first)
        a = b
    taken = np.sort(rows[np.concatenate(taken)]) if taken else np.empty(0, np.int64)
    offsets = np.searchsorted(page[taken], np.arange(len(pred) + 1), "left")
    found = pa.StructArray.from_arrays([pa.array(p[taken], pa.int32()), pa.array(g[taken], pa.int32()), pa.array(value[taken])], ["p", "g", "iou"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), found)


def _tied(*keys: np.ndarray, of: np.ndarray, pages: int) -> np.ndarray:
    """Pairs of a page with equal keys."""
    order = np.lexsort((*keys, of))
    new = np.concatenate([[True], np.diff(of[order]) != 0]) if len(order) else np.empty(0, bool)
    for k in keys:
        new[1:] |= np.diff(k[order]) != 0
    begins = np.flatnonzero(new)
    n = np.diff(begins, append=len(order))
    return np.bincount(of[order][begins], n * (n - 1) / 2, pages).astype(np.int64)


def inversions(value: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per list the pairs i < j with value i > value j, by merging ever longer stretches of all lists at once; values are numbers from 0."""
    sizes = np.diff(offsets)
    of = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(value)) - offsets[of]
    out, half, most = np.zeros(len(sizes), np.int64), 1, int(sizes.max()) if len(sizes) else 0
    top = int(value.max()) + 1 if len(value) else 1
    while half < most:
        # stretches of a pass, numbered over all lists; in each, equal values of the left half come before those of the right
        stretch = at // (2 * half)
        number = np.cumsum(np.concatenate([[0], (np.diff(of) != 0) | (np.diff(stretch) != 0)])) if len(at) else at
        right = at // half % 2
        order = np.argsort((number * top + value) * 2 + right, kind="stable")
        lefts = np.concatenate([[0], np.cumsum(1 - right[order])])
        first = np.searchsorted(number, np.arange(number[-1] + 1)) if len(number) else number
        ends = np.append(first, len(number))[1:] if len(number) else number
        mine = number[order]
        # of a right element: the left ones of its stretch that come after it
        after = lefts[ends[mine]] - lefts[1:]
        out += np.bincount(of[order], np.where(right[order] == 1, after, 0), len(sizes)).astype(np.int64)
        half *= 2
    return out


def pair_counts(a: pa.Array, b: pa.Array) -> pa.Array:
    """Per page, of all pairs of places: concordant, discordant, equal in a, equal in b. A null is equal to nothing and in no order; of lists of different lengths the shorter one ends both orders."""
    (x, x_off), (y, y_off) = _flat(a), _flat(b)
    pages = len(a)

    def ranked(values: pa.Array, offsets: np.ndarray):
        known = pc.is_valid(values).to_numpy(zero_copy_only=False)
        rank = np.full(len(values), -1)
        _, rank[known] = np.unique(pc.drop_null(values).to_numpy(zero_copy_only=False), return_inverse=True)
        of = np.repeat(np.arange(pages), np.diff(offsets))
        return rank, known, of, np.arange(len(values)) - offsets[of]

    x_rank, x_known, x_of, x_at = ranked(x, x_off)
    y_rank, y_known, y_of, y_at = ranked(y, y_off)
    equal_a, equal_b = _tied(x_rank[x_known], of=x_of[x_known], pages=pages), _tied(y_rank[y_known], of=y_of[y_known], pages=pages)
    least = np.minimum(np.diff(x_off), np.diff(y_off))
    keep_x, keep_y = x_at < least[x_of], y_at < least[y_of]
    u, v, of = x_rank[keep_x], y_rank[keep_y], x_of[keep_x]
    both = (u >= 0) & (v >= 0)
    u, v, of = u[both], v[both], of[both]
    order = np.lexsort((v, u, of))
    u, v, of = u[order], v[order], of[order]
    n = np.bincount(of, minlength=pages)
    offsets = np.concatenate([[0], np.cumsum(n)])
    discordant = inversions(v, offsets)
    ordered = n * (n - 1) // 2 - _tied(u, of=of, pages=pages) - _tied(v, of=of, pages=pages) + _tied(u, v, of=of, pages=pages)
    return pa.StructArray.from_arrays([pa.array(z, pa.int64()) for z in (ordered - discordant, discordant, equal_a, equal_b)], ["c", "d", "ta", "tb"])


def visited(pred: pa.Array, gt: pa.Array, order: pa.Array, at_least: float) -> pa.Array:
    """Per page the true boxes that predictions in turn take, and the counts of pairs of their places with the boxes (`own`) and with the boxes' ranks in `order` (`ranked`)."""
    taken = greedy(pred, gt, at_least, True, "best", False)
    offsets, g = taken.offsets, taken.values.field("g")
    sizes = np.diff(offsets.to_numpy())
    page = np.repeat(np.arange(len(pred)), sizes)
    lists = lambda values: pa.ListArray.from_arrays(offsets, values)
    visits, places = lists(g), lists(pa.array(np.arange(len(g)) - offsets.to_numpy()[page], pa.int32()))
    ranks, rank_offsets = _flat(order)
    at = rank_offsets[page] + g.to_numpy()
    ranked = lists(ranks.take(pa.array(at, mask=at >= rank_offsets[page + 1])))
    return pa.StructArray.from_arrays([visits, pair_counts(visits, places), pair_counts(places, ranked)], ["visits", "own", "ranked"])
