"""Copy number changes along regions of calls: a hidden Markov model over gains and frequencies."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Gains from -2 to 20, and ten frequencies of the changed cells.
GAINS, FREQUENCIES = range(-2, 21), tuple(k / 10 for k in range(1, 11))
_LGAMMA = np.frompyfunc(math.lgamma, 1, 1)
#: Columns of a call.
VALUES = ("depth_tumor", "depth_normal", "vaf_tumor", "prob_het")
#: Calls that are gathered before their regions are worked out, regions worked out side by side, and calls whose emissions are there at once.
BUFFER, SIDE_BY_SIDE, BLOCK = 60_000, 128, 16_384


def poisson_ln(k: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Log probability of counts; a mean of zero allows only none."""
    k, mean = np.asarray(k, float), np.asarray(mean, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = k * np.log(mean) - mean - np.asarray(_LGAMMA(k + 1), float)
    return np.where(mean > 0, out, np.where(k == 0, 0.0, -np.inf))


def binomial_ln(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Log probability of k hits in n."""
    k, n, p = np.asarray(k, float), np.asarray(n, float), np.asarray(p, float)
    choose = np.asarray(_LGAMMA(n + 1) - _LGAMMA(k + 1) - _LGAMMA(n - k + 1), float)
    with np.errstate(divide="ignore", invalid="ignore"):
        hits = np.where(k == 0, 0.0, k * np.log(p))
        rest = np.where(n - k == 0, 0.0, (n - k) * np.log1p(-p))
    return choose + hits + rest


def states(purity: float) -> pd.DataFrame:
    """Gain, frequency, factor of the depth and shares of the alternative allele with it or the other one changed; the first is no change."""
    rows = [(0, 1.0)] + [(g, f) for f in FREQUENCIES for g in GAINS if g != 0]
    out = pd.DataFrame(rows, columns=["gain", "frequency"])
    share = out["frequency"] * purity
    copies = 2 + share * out["gain"]
    out["depth_factor"] = copies / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        out["with_alt"] = np.where(copies > 0, np.clip((1 + share * np.maximum(out["gain"], -1)) / copies, 0, 1), 0.0)
        out["with_ref"] = np.where(copies > 0, np.clip(1 - (1 + share * np.maximum(out["gain"], -1)) / copies, 0, 1), 0.0)
    return out


def emissions(calls: pd.DataFrame, table: pd.DataFrame, depth_factor: float) -> np.ndarray:
    """Log probability of each call (row) under each state: depth, and the frequency where it is heterozygous."""
    tumor, normal = calls["depth_tumor"].to_numpy(float)[:, None], calls["depth_normal"].to_numpy(float)[:, None]
    depth = poisson_ln(tumor, normal * depth_factor * table["depth_factor"].to_numpy()[None, :])
    hits = np.round(calls["vaf_tumor"].to_numpy(float) * calls["depth_tumor"].to_numpy(float))[:, None]
    either = math.log(0.5) + np.logaddexp(binomial_ln(hits, tumor, table["with_alt"].to_numpy()[None, :]), binomial_ln(hits, tumor, table["with_ref"].to_numpy()[None, :]))
    either[:, 0] = 0.0
    full = depth + either
    het = np.clip(calls["prob_het"].to_numpy(float), 0, 1)[:, None]
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log(het) + full, np.log1p(-het) + full[:, :1])


def transitions(n: int, least_factor: float) -> tuple[float, float]:
    """Log chances to keep a state and to change to a given other one, from the least Bayes factor of a stretch."""
    e = least_factor - 1.0
    return math.log((1 + e) / (n + e)), math.log(1 / (n + e))


def _steps(emit: Callable[[np.ndarray], np.ndarray], codes: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, Iterator[tuple[int, np.ndarray, np.ndarray]]]:
    """The calls of regions side by side: first calls of all, second calls, and so on.

    ``lens`` must descend, so that the regions that go on at a step are the first ones.
    ``emit`` gives the emissions of codes; calls with equal codes share theirs.  Returns where
    each step begins in the order of steps, and per step its number, emissions and which of
    them each region has.
    """
    begins = np.cumsum(lens) - lens
    step = np.arange(int(lens.sum())) - np.repeat(begins, lens)
    order = np.argsort(step, kind="stable")
    flat = codes[(np.repeat(starts, lens) + step)[order]]
    offsets = np.r_[0, np.cumsum(np.bincount(step))]

    def walk() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        k = 0
        while k < len(offsets) - 1:
            z = max(k + 1, int(np.searchsorted(offsets, offsets[k] + BLOCK, side="right")) - 1)
            which, at = np.unique(flat[offsets[k] : offsets[z]], return_inverse=True)
            rows = emit(which)
            for s in range(k, z):
                yield s, rows, at[offsets[s] - offsets[k] : offsets[s + 1] - offsets[k]]
            k = z

    return offsets, walk()


def _side_by_side(lens: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of regions in groups of similar length, each in descending order of it."""
    order = np.argsort(-lens, kind="stable")
    for k in range(0, len(order), SIDE_BY_SIDE):
        yield order[k : k + SIDE_BY_SIDE]


def stretches(emit: Callable[[np.ndarray], np.ndarray], n_states: int, codes: np.ndarray, starts: np.ndarray, lens: np.ndarray, least_factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First call, end and state of the stretches of the likeliest path of each region, in order.

    Changes cost the same whatever the states, so that the best predecessor is the state
    itself or the best of all.  A path is therefore known from the best state at each call and
    the call at which that was last changed to; nothing is kept per state.
    """
    keep, change = transitions(n_states, least_factor)
    found = []
    for group in _side_by_side(lens):
        offsets, walk = _steps(emit, codes, starts[group], lens[group])
        score, since = np.empty((len(group), n_states)), np.zeros((len(group), n_states), np.int32)
        every, tops, top_since = np.arange(len(group)), np.empty(offsets[-1], np.int32), np.empty(offsets[-1], np.int32)
        best = np.empty(0)
        for s, rows, at in walk:
            m = len(at)
            now, begun = score[:m], since[:m]
            if s == 0:
                now[:] = rows[at] - math.log(n_states)
            else:
                moved = (best[:m] + change)[:, None]
                now += keep
                np.copyto(begun, s, where=~(now >= moved))
                np.maximum(now, moved, out=now)
                now += rows[at]
            top = now.argmax(axis=1)
            best = now[every[:m], top]
            tops[offsets[s] : offsets[s + 1]], top_since[offsets[s] : offsets[s + 1]] = top, begun[every[:m], top]
        i, last = every, lens[group] - 1
        while len(i):
            here = offsets[last] + i
            found.append(np.stack([starts[group][i] + top_since[here], starts[group][i] + last + 1, tops[here]]))
            last = top_since[here] - 1
            i, last = i[last >= 0], last[last >= 0]
    first, end, state = (x := np.concatenate(found, axis=1))[:, np.argsort(x[0], kind="stable")]
    new = np.r_[True, (state[1:] != state[:-1]) | np.isin(first[1:], starts)]
    at = np.flatnonzero(new)
    return first[at], end[np.r_[at[1:], len(first)] - 1], state[at]


def log_likelihoods(emit: Callable[[np.ndarray], np.ndarray], n_states: int, codes: np.ndarray, starts: np.ndarray, lens: np.ndarray, least_factor: float) -> np.ndarray:
    """Log likelihood of each region over all states.

    Shares of the states are linear and sum to one after each call.  None is less than the
    chance to change before a call, and emissions are multiples of the largest one, so that
    a sum can't underflow.
    """
    keep, change = map(math.exp, transitions(n_states, least_factor))
    out = np.empty(len(lens))

    def scaled(which: np.ndarray) -> np.ndarray:
        rows = emit(which)
        top = rows.max(axis=1, keepdims=True)
        top = np.where(top == -np.inf, 0.0, top)
        return np.hstack([np.exp(rows - top), top])

    for group in _side_by_side(lens):
        share, total, ll = np.empty((len(group), n_states)), np.ones(len(group)), np.zeros(len(group))
        _, walk = _steps(scaled, codes, starts[group], lens[group])
        for s, rows, at in walk:
            m = len(at)
            now, emitted = share[:m], rows[at]
            if s == 0:
                now[:] = 1 / n_states
            else:
                now *= ((keep - change) / total[:m])[:, None]
                now += change
            now *= emitted[:, :-1]
            sums = now.sum(axis=1)
            with np.errstate(divide="ignore"):
                ll[:m] += np.log(sums) + emitted[:, -1]
            total[:m] = np.where(sums == 0, 1.0, sums)  # impossible from here on
        out[group] = ll
    return out


def viterbi(emit: np.ndarray, least_factor: float) -> np.ndarray:
    """Likeliest states of a region."""
    first, end, state = stretches(emit.__getitem__, emit.shape[1], np.arange(len(emit)), np.zeros(1, int), np.array([len(emit)]), least_factor)
    return np.repeat(state, end - first)


def forward(emit: np.ndarray, least_factor: float) -> float:
    """Log likelihood of a region over all states."""
    return float(log_likelihoods(emit.__getitem__, emit.shape[1], np.arange(len(emit)), np.zeros(1, int), np.array([len(emit)]), least_factor)[0])


def _changes(column: pa.Array) -> np.ndarray:
    """Where a value differs from the one before; a null is a value."""
    none = column.is_null().to_numpy(zero_copy_only=False)
    differs = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).fill_null(False).to_numpy(zero_copy_only=False)
    return np.r_[True, differs | (none[1:] != none[:-1])]


def _coded(rows: pa.RecordBatch) -> tuple[np.ndarray, pd.DataFrame]:
    """A number for each call, and the distinct calls in order of their numbers."""
    values = pd.DataFrame({c: rows.column(c).to_numpy(zero_copy_only=False) for c in VALUES})
    code = np.zeros(len(values), np.int64)
    for c in VALUES:
        own, seen = pd.factorize(values[c], use_na_sentinel=False)
        code = pd.factorize(code * len(seen) + own)[0]
    first = np.unique(code, return_index=True)[1]
    return code, values.iloc[first]


def _by_region(df: DataFrame, region: Sequence[str], order: str, gap: float | None, work: Callable, schema: str) -> DataFrame:
    """Rows that ``work`` gives for batches of whole regions: of their rows in order, the first rows of regions and the regions' numbers within their keys."""
    region, least = list(region), BUFFER

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held, most, number = [], 0, least, 0

        def whole(rows: pa.RecordBatch, ended: bool):
            """Result of the regions that are complete; the rest, and the number of its region."""
            new_key = np.logical_or.reduce([_changes(rows.column(k)) for k in region])
            new = new_key.copy()
            if gap is not None:
                at = rows.column(order)
                new[1:] |= pc.greater(pc.subtract(at.slice(1), at.slice(0, len(at) - 1)), gap).fill_null(False).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new)
            count = np.arange(len(starts))
            keyed = np.maximum.accumulate(np.where(new_key[starts], count, 0))
            numbers = count - keyed + np.where(keyed == 0, number, 0)  # the first rows go on with their key
            if ended:
                return work(rows, starts, numbers), None, 0
            if len(starts) == 1:
                return None, rows, number
            done = rows.slice(0, starts[-1])
            return work(done, starts[:-1], numbers[:-1]), rows.slice(starts[-1]), int(numbers[-1])

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            n_held += b.num_rows
            if n_held >= most:
                got, rest, number = whole(pa.concat_batches(held), False)
                held, n_held = [rest], rest.num_rows
                most = max(least, 2 * n_held)  # a long region is put together a few times only
                if got is not None:
                    yield got
        if held:
            yield whole(pa.concat_batches(held), True)[0]

    return df.select(*region, order, *VALUES).repartition(*region).sortWithinPartitions(*region, order, *VALUES).mapInArrow(stream, schema)


def _region_columns(df: DataFrame, region: Sequence[str], gap: float | None) -> str:
    types = dict(df.dtypes)
    return ", ".join([*(f"`{k}` {types[k]}" for k in region), *(["region bigint"] if gap is not None else [])])


def call_cnvs(df: DataFrame, region: Sequence[str], order: str, depth_factor: float, purity: float = 1.0, least_factor: float = 100.0, gap: float | None = None) -> DataFrame:
    """Stretches of two or more calls of a region with the same change: first and last ``order``, gain, frequency, calls.

    ``df`` has ``depth_tumor``, ``depth_normal``, ``vaf_tumor`` and ``prob_het``.  Regions
    (of calls near one another) are named by ``region``; with ``gap`` these are keys within
    which a region ends where the step to the next call exceeds it, and the result has
    their number from 0 as ``region``.  Rows of a key stream through one task, of which a
    region at most is held; many regions are decoded side by side.
    """
    table = states(purity)
    types = dict(df.dtypes)
    schema = f"{_region_columns(df, region, gap)}, first_pos {types[order]}, last_pos {types[order]}, gain int, frequency double, n_calls int, ln_no_change double"

    def decode(rows: pa.RecordBatch, starts: np.ndarray, numbers: np.ndarray) -> pa.RecordBatch:
        code, distinct = _coded(rows)
        first, end, state = stretches(lambda which: emissions(distinct.iloc[which], table, depth_factor), len(table), code, starts, np.diff(np.r_[starts, len(code)]), least_factor)
        called = (table["gain"].to_numpy()[state] != 0) & (end - first > 1)
        first, end, state = first[called], end[called], state[called]
        unchanged = np.r_[emissions(distinct, table.iloc[:1], depth_factor)[:, 0][code], 0.0]
        sums = np.add.reduceat(unchanged, np.column_stack([first, end]).ravel())[::2] if len(first) else np.empty(0)
        out = {k: rows.column(k).take(pa.array(first)) for k in region}
        if gap is not None:
            out["region"] = pa.array(numbers[np.searchsorted(starts, first, side="right") - 1], pa.int64())
        out |= {"first_pos": rows.column(order).take(pa.array(first)), "last_pos": rows.column(order).take(pa.array(end - 1)), "gain": pa.array(table["gain"].to_numpy()[state], pa.int32()), "frequency": pa.array(table["frequency"].to_numpy()[state])}
        return pa.RecordBatch.from_pydict(out | {"n_calls": pa.array(end - first, pa.int32()), "ln_no_change": pa.array(sums)})

    return _by_region(df, region, order, gap, decode, schema)


def region_likelihoods(df: DataFrame, region: Sequence[str], order: str, depth_factor: float, purity: float = 1.0, least_factor: float = 100.0, gap: float | None = None) -> DataFrame:
    """Log likelihood of each region over all states; for ``gap`` see ``call_cnvs``."""
    table = states(purity)

    def total(rows: pa.RecordBatch, starts: np.ndarray, numbers: np.ndarray) -> pa.RecordBatch:
        code, distinct = _coded(rows)
        ll = log_likelihoods(lambda which: emissions(distinct.iloc[which], table, depth_factor), len(table), code, starts, np.diff(np.r_[starts, len(code)]), least_factor)
        out = {k: rows.column(k).take(pa.array(starts)) for k in region}
        if gap is not None:
            out["region"] = pa.array(numbers, pa.int64())
        return pa.RecordBatch.from_pydict(out | {"ln_likelihood": pa.array(ll)})

    return _by_region(df, region, order, gap, total, f"{_region_columns(df, region, gap)}, ln_likelihood double")
