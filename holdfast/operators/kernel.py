"""Numpy kernels for forests on ranks. Run inside tasks, so they import numpy only.

A row is known to a forest by the ranks of its values: how many of the forest's thresholds of that feature lie below the
value. A value is at most the i-th threshold (from 0) if its rank is at most i. Ranks are held feature by feature: an
array of features x rows.

Contributions: a path from root to leaf with distinct features 1..d holds, per feature, an interval of ranks and the
share z of the training weight that follows the path at that feature's splits. A row follows feature j if its rank is in
the interval (o_j = 1, else 0). The Shapley contribution of feature j at a leaf with value v is

    v (o_j - z_j) * integral over t in [0, 1] of prod_{i != j} ((1 - t) z_i + t o_i)

because the Shapley weight of a coalition of size k is the integral of t^k (1 - t)^(d - 1 - k). The
integrand is a polynomial of degree d - 1, for which a Gauss-Legendre rule with ceil(d / 2) nodes is
exact.
"""

import numpy as np

# Doubles held by one intermediate array: 2**17 of them are 1 MB.
CHUNK = 1 << 17
# Paths with so many features at most have a table of all their patterns, others only where rows outnumber the patterns.
PATTERN_FEATURES = 9
MOST_PATTERN_FEATURES = 16
ROWS = 1 << 13
# Neighbouring paths of a tree share one table of so many cells at most, if there are enough rows to be worth it.
GROUP_CELLS = 1 << 11
GROUPED_ROWS = 1 << 12
# A bound above all ranks.
TOP = np.iinfo(np.uint32).max


def rank_columns(x, cuts):
    """Ranks of a matrix (rows x features) among the sorted thresholds of each feature, as features x rows."""
    most = max((len(c) for c in cuts), default=0)
    out = np.zeros((len(cuts), len(x)), dtype=np.uint16 if most <= np.iinfo(np.uint16).max else np.uint32)
    for j, c in enumerate(cuts):
        if len(c):
            # Not-a-number comes last, so it is above all thresholds.
            out[j] = np.searchsorted(c, x[:, j], side="left")
    return out


def tree_arrays(feature, cut, left, right, value):
    """A tree for `walk`: a leaf is its own child, and `depth` steps reach it from the root (node 0)."""
    leaf = feature < 0
    me = np.arange(len(feature), dtype=np.int32)
    left, right = np.where(leaf, me, left).astype(np.int32), np.where(leaf, me, right).astype(np.int32)
    level, depth = np.zeros(1, np.int32), 0
    while not leaf[level].all():
        level, depth = np.unique(np.r_[left[level], right[level]]), depth + 1
    return np.where(leaf, 0, feature).astype(np.int32), np.where(leaf, 0, cut).astype(np.uint32), left, right, value, depth


def walk(ranks, trees):
    """Sum of the leaf values that each row reaches, over the trees."""
    width, n = ranks.shape
    total = np.zeros(n)
    for first in range(0, n, ROWS):
        some = np.ascontiguousarray(ranks[:, first : first + ROWS])
        flat, m = some.ravel(), some.shape[1]
        rows = np.arange(m)
        for feature, cut, left, right, value, depth in trees:
            at = np.zeros(m, dtype=np.int32)
            for _ in range(depth):
                goes_left = flat[feature[at] * m + rows] <= cut[at]
                at = np.where(goes_left, left[at], right[at])
            total[first : first + m] += value[at]
    return total


def _cells(intervals):
    """Bounds between the segments of a feature's ranks, and the cell of each: segments in the same intervals are one cell.

    Returns (bounds, cell of each segment, for every cell whether it is in each interval)."""
    bounds = sorted({b for low, high in intervals for b in (low, high + 1)} - {0})
    cells, of = {}, []
    for start in (0, *bounds):
        of.append(cells.setdefault(tuple(low <= start <= high for low, high in intervals), len(cells)))
    return bounds, of, list(cells)


def _neighbours(features, low, high):
    """A group number per path: consecutive paths, as many as have at most GROUP_CELLS cells in all."""
    groups, number, held = [], -1, {}
    for path in zip(features, low, high):
        mine = {f: (a, b) for f, a, b in zip(*path)}
        both = {f: held.get(f, frozenset()) | {i} for f, i in mine.items()}
        both = {**held, **both}
        size = 1
        for intervals in both.values():
            size *= 2 if len(intervals) == 1 else len(_cells(intervals)[2])
        if number < 0 or size > GROUP_CELLS:
            number, both = number + 1, {f: frozenset([i]) for f, i in mine.items()}
        held = both
        groups.append(number)
    return groups


def group_paths(features, low, high, share, value):
    """Paths as dense arrays, one block per number of distinct features. Bounds are the least and greatest rank that follows.

    ``group`` numbers runs of neighbouring paths."""
    sizes = np.array([len(f) for f in features], dtype=np.int64)
    groups = np.array(_neighbours(features, low, high), dtype=np.int64)
    blocks = []
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        if d == 0:
            continue
        blocks.append(
            {
                "feature": np.array([features[i] for i in rows], dtype=np.int32).reshape(-1, d),
                "low": np.array([low[i] for i in rows], dtype=np.uint32).reshape(-1, d),
                "high": np.array([high[i] for i in rows], dtype=np.uint32).reshape(-1, d),
                "share": np.array([share[i] for i in rows], dtype=np.float64).reshape(-1, d),
                "value": np.asarray(value, dtype=np.float64)[rows],
                "group": groups[rows],
            }
        )
    return blocks


def merge_blocks(parts):
    """Blocks of several trees as one block per number of features."""
    by_size, first = {}, 0
    for blocks in parts:
        for b in blocks:
            by_size.setdefault(b["feature"].shape[1], []).append({**b, "group": b["group"] + first})
        first += max((int(b["group"].max()) + 1 for b in blocks), default=0)
    return [{k: np.concatenate([b[k] for b in same]) for k in same[0]} for _, same in sorted(by_size.items())]


def _follows(ranks, feature, low, high):
    values = ranks[feature]
    if low == 0:
        return values <= high
    if high == TOP:
        return values >= low
    return (values >= low) & (values <= high)


def _leaf_terms(follows, share, leaf):
    """The formula above for each feature: ``follows[j]`` is rows x paths (or fits it), the rest is per path."""
    d = len(follows)
    nodes, weights = np.polynomial.legendre.leggauss((d + 1) // 2)
    nodes, weights = (nodes + 1) / 2, weights / 2
    total = [0.0] * d
    for t, w in zip(nodes, weights):
        factor = [(1 - t) * share[j] + t * follows[j] for j in range(d)]
        product = w
        for f in factor:
            product = product * f
        for j in range(d):
            total[j] = total[j] + product / factor[j]
    return [total[j] * (follows[j] - share[j]) * leaf for j in range(d)]


def _pattern_terms(block, some):
    """For each path the terms of all 2**d ways to follow it or not: paths x features x ways."""
    d = block["feature"].shape[1]
    patterns = (np.arange(1 << d)[:, None] >> np.arange(d)) & 1
    terms = _leaf_terms([patterns[:, [j]] for j in range(d)], [block["share"][some, j] for j in range(d)], block["value"][some])
    return np.ascontiguousarray(np.stack(terms).transpose(2, 0, 1))


def _group_table(paths, most):
    """Features of a group's paths, for each its number of the cell of every rank, and the sums of the paths' terms by cell.

    A path is (features, low, high, terms); the cells of all features together make one number.
    """
    names = sorted({f for path in paths for f in path[0]})
    code, radix, lookups = np.zeros((len(paths), 1), dtype=np.intp), 1, []
    for f in names:
        at = {p: path[0].index(f) for p, path in enumerate(paths) if f in path[0]}
        own = {p: (paths[p][1][j], paths[p][2][j]) for p, j in at.items()}
        intervals = sorted(set(own.values()))
        bounds, of, cells = _cells(intervals)
        ranks = np.searchsorted(np.array(bounds, dtype=np.int64), np.arange(most[f] + 1), side="right")
        lookups.append((np.array(of, dtype=np.uint16) * np.uint16(radix))[ranks])
        bits = np.zeros((len(paths), len(cells)), dtype=np.intp)
        for p, j in at.items():
            i = intervals.index(own[p])
            bits[p] = [c[i] << j for c in cells]
        code = (bits[:, :, None] + code[:, None, :]).reshape(len(paths), -1)
        radix *= len(cells)
    table = np.zeros((len(names), radix))
    place = {f: i for i, f in enumerate(names)}
    for path, mine in zip(paths, code):
        for f, terms in zip(path[0], path[3]):
            table[place[f]] += terms.take(mine)
    return names, lookups, table


def _add_by_group(ranks, blocks, out):
    """One table for the paths of a group. `blocks` hold whole groups of paths with at most so many features as fit a table."""
    most = ranks.max(axis=1).tolist()
    n = ranks.shape[1]
    wide = ranks.astype(np.intp)
    found = np.empty(ROWS)
    ends = [np.unique(b["group"]) for b in blocks]
    numbers = np.unique(np.concatenate(ends)) if ends else []
    orders = [np.argsort(b["group"], kind="stable") for b in blocks]
    for first in range(0, len(numbers), 64):
        low, high = numbers[first], numbers[min(first + 64, len(numbers)) - 1]
        groups = {}
        for b, order in zip(blocks, orders):
            some = order[np.searchsorted(b["group"], low, "left", order) : np.searchsorted(b["group"], high, "right", order)]
            if len(some):
                rows = zip(b["feature"][some].tolist(), b["low"][some].tolist(), b["high"][some].tolist(), _pattern_terms(b, some))
                for number, path in zip(b["group"][some].tolist(), rows):
                    groups.setdefault(number, []).append(path)
        for paths in groups.values():
            names, lookups, table = _group_table(paths, most)
            for a in range(0, n, ROWS):
                mine = wide[:, a : a + ROWS]
                code = lookups[0].take(mine[names[0]])
                for f, lookup in zip(names[1:], lookups[1:]):
                    code += lookup.take(mine[f])
                code = code.astype(np.intp)
                terms = found[: len(code)]
                for f, row in zip(names, table):
                    row.take(code, out=terms, mode="clip")
                    out[f, a : a + ROWS] += terms


def _add_by_pattern(ranks, block, out):
    """One table per path with the terms of all 2**d ways to follow it or not; rows look theirs up."""
    n_paths, d = block["feature"].shape
    n = ranks.shape[1]
    code_type = np.uint8 if d <= 8 else np.uint16
    step = max(1, CHUNK >> d)
    for first in range(0, n_paths, step):
        some = slice(first, min(first + step, n_paths))
        tables = _pattern_terms(block, some)
        feature = block["feature"][some].tolist()
        low, high = block["low"][some].tolist(), block["high"][some].tolist()
        for a in range(0, n, ROWS):
            mine = ranks[:, a : a + ROWS]
            for path, columns in enumerate(feature):
                code = np.zeros(mine.shape[1], dtype=code_type)
                for j, f in enumerate(columns):
                    code |= _follows(mine, f, low[path][j], high[path][j]).view(np.uint8).astype(code_type, copy=False) << code_type(j)
                code = code.astype(np.intp)
                table = tables[path]
                for j, f in enumerate(columns):
                    out[f, a : a + ROWS] += table[j].take(code)


def _add_by_row(ranks, block, out):
    """Terms row by row, for paths with many features and so too many patterns."""
    n_paths, d = block["feature"].shape
    n = ranks.shape[1]
    for a in range(0, n, ROWS):
        mine = ranks[:, a : a + ROWS]
        step = max(1, CHUNK // mine.shape[1])
        for first in range(0, n_paths, step):
            paths = range(first, min(first + step, n_paths))
            some = slice(paths.start, paths.stop)
            bounds = [block["feature"][some].T, block["low"][some].T, block["high"][some].T]
            follows = [np.stack([_follows(mine, *b) for b in zip(*(x[j].tolist() for x in bounds))], axis=1).astype(np.float64) for j in range(d)]
            terms = _leaf_terms(follows, [block["share"][some, j] for j in range(d)], block["value"][some])
            for j in range(d):
                for k, p in enumerate(paths):
                    out[block["feature"][p, j], a : a + ROWS] += terms[j][:, k]


def contributions(ranks, blocks):
    """Contribution of every feature (features x rows), summed over the paths."""
    out = np.zeros(ranks.shape, dtype=np.float64)
    n = ranks.shape[1]
    if n:
        ranks = np.ascontiguousarray(ranks)
        if n >= GROUPED_ROWS:
            fitting = [b for b in blocks if 1 << b["feature"].shape[1] <= GROUP_CELLS]
            _add_by_group(ranks, fitting, out)
            blocks = [b for b in blocks if 1 << b["feature"].shape[1] > GROUP_CELLS]
        for block in blocks:
            d = block["feature"].shape[1]
            by_pattern = d <= PATTERN_FEATURES or (d <= MOST_PATTERN_FEATURES and 1 << d <= n)
            (_add_by_pattern if by_pattern else _add_by_row)(ranks, block, out)
    return out
