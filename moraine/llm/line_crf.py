"""Document quality from a linear-chain conditional random field over lines.

Every line of a text is labelled good or bad; its features are those of its own
characters and words and those of its neighbours.  Forward-backward gives each
line's marginal, and a document's score is their mean weighted by line length.

Training sees a bounded sample (SAMPLE documents by hash, SAMPLE_BYTES bytes and
SAMPLE_LINES lines at most; a text that doesn't fit is passed over) of the
labelled rows outside the held-out fold.  Labels are of documents; a line's own
is its document's unless a first model, of its own features alone and with both
labels weighing the same, says otherwise with CONFIDENT probability.  So lines
may be unlike their document, and the weights of neighbouring labels are learned
from both kinds of neighbours.

Scoring covers all rows and whole texts, in one pass without a shuffle.  Memory
doesn't grow with a text beyond some 20 bytes a line: characters are looked at
ARRAY_BYTES at a time (a longer line in windows, its words by key), lines
BLOCK_LINES at a time, and blocks of one text pass their messages on.  A chain
is cut into segments that run side by side, so its length costs no Python step
a line.

Defined results: a null or empty text is one empty line; texts of any length and
number of lines are scored whole; repeated rows get equal scores; of several
texts of an id the least is learned from, and of several labels the greatest;
ids of one hash come in id order; labels that are null are not learned from;
without both labels in the sample every score is the share of label 1 (0.5 if
there are none); a score of THRESHOLD itself is kept; empty tables give an empty
result; further columns pass through ``keep_good``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_hash, texts_of

FOLDS = 5
#: Documents learned from at most, and the bytes and lines of their texts that come to the driver at most.
SAMPLE = 2000
SAMPLE_BYTES = 24_000_000
SAMPLE_LINES = 300_000
#: Probability by its own features from which on a line is labelled unlike its document.
CONFIDENT = 0.75
THRESHOLD = 0.3
STEPS = 150
RATE = 0.1
PENALTY = 1e-4
#: Bytes of text whose lines a task labels at once, bytes whose character arrays (some 100 bytes a byte) it holds at once, and lines whose features and messages (some 500 bytes a line) it holds at once.
CHUNK_BYTES = 2_000_000
ARRAY_BYTES = 500_000
BLOCK_LINES = 50_000

# Character classes of UTF-8 bytes: fixed by their ranges.
_B = np.arange(256)
_UPPER, _LOWER, _DIGIT, _HIGH = (_B >= 65) & (_B <= 90), (_B >= 97) & (_B <= 122), (_B >= 48) & (_B <= 57), _B >= 128
_SPACE = np.isin(_B, [9, 11, 12, 13, 32])
_STOP = np.isin(_B, np.frombuffer(b".,;:?'\"()-", np.uint8))
_MARK = np.isin(_B, np.frombuffer(b"!#$%&*+/<=>@[]^_`{|}~\\", np.uint8))
CLASSES = np.stack([_UPPER, _LOWER | _HIGH, _DIGIT, _SPACE, _STOP, _MARK], axis=1).astype(np.uint8)
N_OWN = 14
N_FEATURES = 3 * N_OWN + 3


def line_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Own features (lines x N_OWN) of the lines data[starts:ends]; lines end before a newline or a text's end.

    All of them are array operations over the whole buffer.
    """
    n = len(starts)
    out = np.zeros((n, N_OWN))
    length = (ends - starts).astype(np.float64)
    full = np.flatnonzero(ends > starts)
    if len(full):
        # reduceat over [start, end) of the lines with bytes: odd entries are the gaps between them
        cuts = np.stack([starts[full], ends[full]], axis=1).reshape(-1)
        padded = np.append(data, 0)
        sums = lambda x: np.add.reduceat(x, cuts, dtype=np.int64)[::2]
        counts = np.stack([sums(CLASSES[:, k][padded]) for k in range(6)], axis=1)
        is_space = (CLASSES[:, 3] == 1) | (_B == 10)
        space = is_space[padded]
        inside = np.zeros(len(padded), bool)
        steps = np.zeros(len(padded) + 1, np.int8)
        np.add.at(steps, starts[full], 1)
        np.add.at(steps, ends[full], -1)
        inside = np.cumsum(steps[:-1]) > 0
        word = ~space & inside
        fresh = np.zeros(len(padded), bool)
        fresh[starts[full]] = True
        first = word & (fresh | ~np.append(False, word[:-1]))
        at = np.flatnonzero(first)
        words = sums(first.astype(np.uint8)).astype(np.float64)
        repeats, far, marked = np.zeros(len(full)), np.zeros(len(full)), np.zeros(len(full))
        if len(at):
            size = np.add.reduceat(word, at, dtype=np.int64)
            number = np.cumsum(first) - 1
            place = np.arange(len(padded)) - at[np.maximum(number, 0)]
            weigh = np.where(word, _weigh(padded, place), 0)
            key = np.add.reduceat(weigh, at) * 64 + np.minimum(size, 63)
            line = np.searchsorted(starts[full], at, "right") - 1
            same = np.append(False, (key[1:] == key[:-1]) & (line[1:] == line[:-1]))
            repeats = np.bincount(line, same, len(full))
            order = np.lexsort((key, line))
            again = np.append(False, (key[order][1:] == key[order][:-1]) & (line[order][1:] == line[order][:-1]))
            far = np.bincount(line[order], again, len(full))
            mark_end = CLASSES[:, 5][padded[np.minimum(at + size - 1, len(padded) - 1)]]
            marked = np.bincount(line, mark_end, len(full))
        out[full] = _own(counts, length[full], words, repeats, far, marked)
    return out


def _own(counts, chars, words, repeats, far, marked) -> np.ndarray:
    """The features of lines that have bytes, from counts of classes, bytes, words, words like the last, words seen before in the line, and words that end in a mark."""
    w, letters = np.maximum(words, 1), np.maximum(counts[:, 0] + counts[:, 1], 1)
    return np.stack(
        [
            np.ones(len(chars)), np.log1p(chars) / 6, np.log1p(words) / 4, counts[:, 0] / letters, counts[:, 2] / chars, counts[:, 3] / chars, counts[:, 4] / chars * 5, np.minimum(counts[:, 5] / chars * 5, 2),
            np.minimum(chars / w / 10, 3), repeats / w, far / w, marked / w, (words <= 2).astype(float), (counts[:, 5] == 0).astype(float),
        ], axis=1,
    )


def _weigh(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    """What the bytes of words add to their words' keys."""
    return (data.astype(np.int64) + 1) * (place * place * 7919 + place * 31 + 1)


def long_line_features(data: np.ndarray) -> np.ndarray:
    """Own features (1 x N_OWN) of one line of any length, as line_features gives them; its bytes are looked at in windows."""
    counts = np.bincount(data, minlength=256) @ CLASSES.astype(np.int64)
    keys, marked = [], 0
    held, size, last = 0, 0, 0  # the sum, size and last byte of a word that goes on
    for at in range(0, len(data), ARRAY_BYTES):
        b = data[at : at + ARRAY_BYTES]
        word = CLASSES[b, 3] == 0
        if size and not word[0]:
            keys.append(np.array([held * 64 + min(size, 63)], np.int64))
            marked, held, size = marked + int(CLASSES[last, 5]), 0, 0
        begins = np.flatnonzero(word & ~np.append(False, word[:-1]))
        if not len(begins):
            continue
        ends = np.flatnonzero(word & ~np.append(word[1:], False)) + 1
        sizes = ends - begins
        own = np.cumsum(sizes) - sizes
        place = np.arange(int(sizes.sum())) - np.repeat(own, sizes)
        place[: sizes[0]] += size
        sums = np.add.reduceat(_weigh(b[word], place), own)
        sums[:1] += np.array([held])  # wraps, as the products do
        sizes[0] += size
        if ends[-1] == len(b):
            held, size, last = int(sums[-1]), int(sizes[-1]), int(b[-1])
            sums, sizes, ends = sums[:-1], sizes[:-1], ends[:-1]
        else:
            held, size = 0, 0
        keys.append(sums * 64 + np.minimum(sizes, 63))
        marked += int(CLASSES[b[ends - 1], 5].sum())
    if size:
        keys.append(np.array([held], np.int64) * 64 + min(size, 63))
        marked += int(CLASSES[last, 5])
    keys = np.concatenate(keys) if keys else np.empty(0, np.int64)
    one = lambda x: np.array([x], np.float64)
    return _own(counts[None, :], one(len(data)), one(len(keys)), one((keys[1:] == keys[:-1]).sum()), one(len(keys) - len(np.unique(keys))), one(marked))


def features(own: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Own features, the neighbours' (zero beyond a text's ends), and flags."""
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first], after[last] = 0, 0
    return np.concatenate([own, before, after, first[:, None], last[:, None], (first & last)[:, None]], axis=1)


def pieces(texts: list[bytes]):
    """(text, its number, first, last): runs of whole lines of about ARRAY_BYTES bytes and at most BLOCK_LINES lines, in order; a longer line is alone."""
    for i, text in enumerate(texts):
        at = 0
        while True:
            end = len(text)
            if end - at > ARRAY_BYTES:
                end = text.rfind(b"\n", at, at + ARRAY_BYTES)
                if end < 0:
                    end = text.find(b"\n", at + ARRAY_BYTES)
                    end = len(text) if end < 0 else end
            if text.count(b"\n", at, end) >= BLOCK_LINES:
                end = at + int(np.flatnonzero(np.frombuffer(text, np.uint8, end - at, at) == 10)[BLOCK_LINES - 1])
            yield text[at:end] if at or end < len(text) else text, i, at == 0, end == len(text)
            if end == len(text):
                break
            at = end + 1


def blocks(texts: list[bytes]):
    """(own features, byte lengths, text numbers, first, last) of the lines of runs of pieces."""
    held, used, lines = [], 0, 0
    for piece in pieces(texts):
        n = piece[0].count(b"\n") + 1
        if held and (used + len(piece[0]) > ARRAY_BYTES or lines + n > BLOCK_LINES):
            yield _block(held)
            held, used, lines = [], 0, 0
        held.append(piece)
        used, lines = used + len(piece[0]) + 1, lines + n
    if held:
        yield _block(held)


def _block(held: list):
    if len(held) == 1 and len(held[0][0]) > ARRAY_BYTES:  # one long line
        text, i, first, last = held[0]
        return long_line_features(np.frombuffer(text, np.uint8)), np.array([len(text)], np.int32), np.array([i]), np.array([first]), np.array([last])
    data = np.frombuffer(b"\n".join(t for t, *_ in held), np.uint8)
    cuts = np.flatnonzero(data == 10)
    starts, ends = np.append(0, cuts + 1), np.append(cuts, len(data))
    n = np.array([t.count(b"\n") + 1 for t, *_ in held], np.int64)
    bounds = np.cumsum(n)
    first, last = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
    first[bounds - n], last[bounds - 1] = [h[2] for h in held], [h[3] for h in held]
    return line_features(data, starts, ends), (ends - starts).astype(np.int32), np.repeat([h[1] for h in held], n), first, last


def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines, byte lengths of lines, lines of each text): for training, whose lines are few."""
    own, sizes, number, first, last = (np.concatenate(x) for x in zip(*blocks(texts)))
    return features(own, first, last), sizes, np.bincount(number, minlength=len(texts))


def log_odds(texts: list[bytes], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log-odds of good of all lines, byte lengths of lines, lines of each text); features are made and used a block at a time."""
    w = weights[: 3 * N_OWN].reshape(3, N_OWN)
    n = np.array([t.count(b"\n") + 1 for t in texts], np.int64)
    odds, sizes, at, before = np.empty(int(n.sum())), np.empty(int(n.sum()), np.int32), 0, 0.0
    for own, size, _, first, last in blocks(texts):
        x, from_last, from_next = (own @ w.T).T
        end = at + len(x)
        odds[at:end] = x + weights[-3] * first + weights[-2] * last + weights[-1] * (first & last)
        odds[at + 1 : end] += np.where(first[1:], 0, from_last[:-1])
        odds[at : end - 1] += np.where(last[:-1], 0, from_next[1:])
        if not first[0]:
            odds[at] += before
            odds[at - 1] += from_next[0]
        sizes[at:end], at, before = size, end, from_last[-1]
    return odds, sizes, n


def _time_major(begin: np.ndarray, length: np.ndarray):
    """(order, steps): runs by falling length; for each step the flat indexes of the runs, in that order, that still go on."""
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    live = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), "left")
    return order, [begin[:k] + t for t, k in enumerate(live)]


def _unit(m: np.ndarray) -> np.ndarray:
    """Vectors or matrices scaled to sum 1."""
    return m / m.sum(axis=tuple(range(1, m.ndim)), keepdims=True)


ONES = np.ones((2, 2))


def _potentials(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    e = np.stack([np.zeros_like(x), x], axis=1)
    top = np.maximum(x, 0)
    return np.exp(e - top[:, None]), top


def _products(e: np.ndarray, t: np.ndarray, steps: list, opens: np.ndarray) -> np.ndarray:
    """Scaled products of the lines' matrices of each run; a run that opens a chain has no label pair before its first line."""
    p = np.zeros((len(opens), 2, 2))
    for k, at in enumerate(steps):
        m = t[None] * e[at][:, None, :]
        if not k:
            m[opens] = ONES * e[at[opens]][:, None, :]
            p[:] = _unit(m)
        else:
            p[: len(at)] = _unit(p[: len(at)] @ m)
    return p


def marginals(x: np.ndarray, trans: np.ndarray, n: np.ndarray, into: np.ndarray | None = None, onto: np.ndarray | None = None):
    """P(good) of each line, its pairs' marginals summed (2 x 2), and log Z summed over chains.

    x: log-odds of good; trans: log-weights of (label, next label); n: lines of
    each chain.  ``into`` and ``onto`` are the messages (chains x 2) of what
    lies before and after; without them chains begin and end here.  Chains are
    cut into segments, of about the root of the longest, that run side by side:
    a segment's product of matrices takes messages across it.
    """
    if not len(x):
        return np.empty(0), np.zeros((2, 2)), 0.0
    t, (e, top) = np.exp(trans - trans.max()), _potentials(x)
    width = max(32, int(np.ceil(np.sqrt(n.max()))))
    per = -(-n // width)
    chain = np.repeat(np.arange(len(n)), per)
    place = np.arange(len(chain)) - np.repeat(np.cumsum(per) - per, per)
    begin = (np.cumsum(n) - n)[chain] + place * width
    length = np.minimum(width, n[chain] - place * width)
    order, steps = _time_major(begin, length)
    opens = (place == 0)[order] if into is None else np.zeros(len(chain), bool)
    a, b = np.full((len(chain), 2), 0.5), np.full((len(chain), 2), 0.5)
    heads, tails = np.cumsum(per) - per, np.cumsum(per) - 1
    if into is not None:
        a[heads] = into
    if onto is not None:
        b[tails] = onto
    if per.max() > 1:
        p = np.empty((len(chain), 2, 2))
        p[order] = _products(e, t, steps, opens)
        for k in range(1, int(per.max())):
            s = heads[per > k] + k
            a[s] = _unit((a[s - 1][:, None, :] @ p[s - 1])[:, 0])
            s = tails[per > k] - k
            b[s] = _unit((p[s + 1] @ b[s + 1][:, :, None])[:, :, 0])
    a, b = a[order], b[order]
    f, back, scale = np.empty_like(e), np.empty_like(e), np.empty(len(x))
    for k, at in enumerate(steps):
        m = (f[steps[k - 1][: len(at)]] if k else a) @ t
        if not k:
            m[opens] = 1.0
        m *= e[at]
        s = m.sum(1)
        scale[at], f[at] = s, m / s[:, None]
    pairs = np.zeros((2, 2))
    for k in range(len(steps) - 1, -1, -1):
        at = steps[k]
        ends = len(steps[k + 1]) if k + 1 < len(steps) else 0
        back[at[ends:]] = b[ends : len(at)]
        m = e[at] * back[at]
        before = f[steps[k - 1][: len(at)]] if k else a
        z = ((before @ t) * m).sum(1, keepdims=True)
        if k:
            back[steps[k - 1][: len(at)]] = _unit(m @ t.T)
            pairs += (before.T @ (m / z)) * t
        else:
            pairs += (before[~opens].T @ (m / z)[~opens]) * t
    both = f * back
    # opened chains had t scaled by its maximum once for each pair within them
    n_pairs = len(x) - (len(n) if into is None else 0)
    return both[:, 1] / both.sum(1), pairs, float(np.log(scale).sum() + top.sum() + n_pairs * trans.max())


def chain_marginals(x: np.ndarray, trans: np.ndarray):
    """(begin, P(good) of the lines from there) of one long chain, BLOCK_LINES at a time."""
    t, cuts = np.exp(trans - trans.max()), list(range(0, len(x), BLOCK_LINES))
    onto = [np.full((1, 2), 0.5)]
    for k in reversed(cuts[1:]):
        onto.append(_unit((_whole_product(x[k : k + BLOCK_LINES], t) @ onto[-1][:, :, None])[:, :, 0]))
    into = None
    for k, after in zip(cuts, reversed(onto)):
        block = x[k : k + BLOCK_LINES]
        p = marginals(block, trans, np.array([len(block)]), into, after)[0]
        into = _unit(((np.full((1, 1, 2), 0.5) if into is None else into[:, None, :]) @ _whole_product(block, t, into is None))[:, 0])
        yield k, p


def _whole_product(x: np.ndarray, t: np.ndarray, opens: bool = False) -> np.ndarray:
    """The scaled product (1 x 2 x 2) of all lines' matrices."""
    width = max(32, int(np.ceil(np.sqrt(len(x)))))
    begin = np.arange(0, len(x), width)
    order, steps = _time_major(begin, np.minimum(width, len(x) - begin))
    p = np.empty((len(begin), 2, 2))
    p[order] = _products(_potentials(x)[0], t, steps, (order == 0) & opens)
    out = p[:1]
    for m in p[1:]:
        out = _unit(out @ m)
    return out


class Crf:
    """Line weights, label pairs' weights, share of label 1, and the (slope, offset) that make a mean marginal a probability."""

    def __init__(self, weights: np.ndarray, trans: np.ndarray, share: float, scale: tuple[float, float] = (1.0, 0.0)):
        self.weights, self.trans, self.share, self.scale = weights, trans, share, scale

    def line_marginals(self, texts: list[bytes]):
        """(P(good) of all lines, byte lengths of lines, lines of each text)."""
        x, sizes, n = log_odds(texts, self.weights)
        if len(n) == 1 and n[0] > BLOCK_LINES:
            for k, p in chain_marginals(x, self.trans):
                x[k : k + len(p)] = p  # in place: the block's log-odds have been used
            return x, sizes, n
        return marginals(x, self.trans, n)[0], sizes, n

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Mean marginal of each text's lines, weighted by their bytes plus one, as a probability of label 1."""
        if not texts:
            return np.empty(0)
        if self.weights is None:
            return np.full(len(texts), self.share)
        slope, offset = self.scale
        return 1 / (1 + np.exp(-(slope * _logit(self.means(texts)) + offset)))

    def means(self, texts: list[bytes]) -> np.ndarray:
        p, sizes, n = self.line_marginals(texts)
        at, w = np.cumsum(n) - n, sizes + 1
        np.multiply(p, w, out=p)
        return np.add.reduceat(p, at) / np.add.reduceat(w, at, dtype=np.int64)


def _logit(p: np.ndarray) -> np.ndarray:
    """Bounded, so that a mean of 0 or 1 stays finite."""
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def calibrated(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (positive, so the order stays) and offset of a logistic fit with smoothed labels, by Newton's method."""
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a = np.stack([x, np.ones_like(x)], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        w = w + np.clip(np.linalg.solve(h, a.T @ (t - p) - 1e-3 * (w - [1, 0])), -1, 1)
    return max(float(w[0]), 0.05), float(w[1])


def _ascend(gradient, size: int, steps: int) -> np.ndarray:
    """Adam from zero, the same on every run."""
    theta, m, v = np.zeros(size), 0.0, 0.0
    for k in range(1, steps + 1):
        g = gradient(theta) - PENALTY * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return theta


def told_apart(own: np.ndarray, y: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Labels of lines from those of their documents (y) and their own features: see CONFIDENT."""
    w = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    p_of = lambda theta: 1 / (1 + np.exp(-np.clip(own @ theta, -30, 30)))
    p = p_of(_ascend(lambda theta: own.T @ (w * (y - p_of(theta))) / len(y), own.shape[1], steps))
    return np.where(p >= CONFIDENT, 1, np.where(p <= 1 - CONFIDENT, 0, y))


def fit(texts: list[bytes], labels: np.ndarray, steps: int = STEPS) -> Crf:
    """Maximum penalised likelihood of the lines' labels, the same on every run."""
    labels = np.asarray(labels)
    share = float(labels.mean()) if len(labels) else 0.5
    if len(set(labels.tolist())) < 2:
        return Crf(None, None, share)
    x, _, n = encode(texts)
    step = x.std(0)  # features of like scale are learned alike; the weights take it up below
    step = np.where(step > 1e-6, np.maximum(step, 1e-3), 1.0)
    x /= step
    y = told_apart(x[:, :N_OWN], np.repeat(labels, n), steps)
    inner = np.ones(len(y), bool)
    inner[np.cumsum(n) - n] = False
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[np.flatnonzero(inner) - 1], y[inner]), 1)

    def gradient(theta):
        p, pairs, _ = marginals(x @ theta[:-4], theta[-4:].reshape(2, 2), n)
        return np.append(x.T @ (y - p), (seen - pairs).reshape(-1)) / len(y)

    theta = _ascend(gradient, x.shape[1] + 4, steps)
    model = Crf(theta[:-4] / step, theta[-4:].reshape(2, 2), share)
    model.scale = calibrated(_logit(np.concatenate([model.means(texts[a:b]) for a, b in groups(texts)])), labels)
    return model


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, most_bytes: int = SAMPLE_BYTES, most_lines: int = SAMPLE_LINES) -> tuple[list[bytes], np.ndarray]:
    """Labelled texts outside the held-out fold: of the ``size`` ids of smallest hash those that fit, in that order.

    The ids, bounded by ``size``, are found first, and their texts are set
    aside by a broadcast of those.  The driver sees lengths, passes over what
    doesn't fit into ``most_bytes`` and ``most_lines``, and fetches the rest.
    """
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    ids = usable.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", text.alias("text")).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"))
    own = materialize(own.select("*", F.octet_length("text").alias("n_bytes"), (F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).alias("n_lines"), F.xxhash64("doc_id").alias("h")), "crf-sample")
    chosen, used, lines = [], 0, 0
    for r in own.select("doc_id", "n_bytes", "n_lines", "h").orderBy("h", "doc_id").collect():  # ``size`` rows of numbers at most
        if used + r["n_bytes"] <= most_bytes and lines + r["n_lines"] <= most_lines:
            chosen, used, lines = [*chosen, r["doc_id"]], used + r["n_bytes"], lines + r["n_lines"]
    rows = own.filter(F.col("doc_id").isin(chosen)).select("doc_id", "text", "quality").collect() if chosen else []
    found = {r["doc_id"]: r for r in rows}
    return [found[i]["text"].encode() for i in chosen], np.array([found[i]["quality"] for i in chosen], np.int64)


def train(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Crf:
    return fit(*sample(docs, labels, size))


def groups(texts: list[bytes], most: int = CHUNK_BYTES):
    """(begin, end) of runs of texts of about ``most`` bytes and BLOCK_LINES lines; a text of more lines is alone."""
    begin, used, lines = 0, 0, 0
    for i, t in enumerate(texts):
        n = t.count(b"\n") + 1
        if i > begin and (used + len(t) > most or lines + n > BLOCK_LINES):
            yield begin, i
            begin, used, lines = i, 0, 0
        used, lines = used + len(t) + 1, lines + n
    if begin < len(texts):
        yield begin, len(texts)


def score(docs: DataFrame, model: Crf) -> DataFrame:
    """(doc_id, text_hash, score) of every row."""
    def run(batches):
        for batch in batches:
            texts = texts_of(batch)
            s = np.concatenate([model.scores(texts[a:b]) for a, b in groups(texts)] or [np.empty(0)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(s, pa.float64())], ["doc_id", "text_hash", "score"])

    return docs.select("doc_id", text_hash().alias("text_hash"), "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, score double")


def line_labels(docs: DataFrame, model: Crf) -> DataFrame:
    """(doc_id, line, n_bytes, p_good, good): every line of every text."""

    def run(batches):
        for batch in batches:
            texts, ids = texts_of(batch), batch.column("doc_id")
            for a, b in groups(texts):
                if model.weights is not None:
                    p, sizes, n = model.line_marginals(texts[a:b])
                else:
                    _, sizes, n = log_odds(texts[a:b], np.zeros(N_FEATURES))
                    p = np.full(len(sizes), model.share)
                ends = np.cumsum(n)
                for k in range(0, len(p), BLOCK_LINES):
                    at = np.arange(k, min(k + BLOCK_LINES, len(p)))
                    text = np.searchsorted(ends, at, "right")
                    cols = [ids.take(pa.array(a + text)), pa.array(at - (ends - n)[text], pa.int64()), pa.array(sizes[at], pa.int64()), pa.array(p[at]), pa.array(p[at] >= 0.5)]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "line", "n_bytes", "p_good", "good"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, line long, n_bytes long, p_good double, good boolean")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return score(docs, train(docs, labels)).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score reaches THRESHOLD, whole and in their own columns.

    A row's texts go through the workers once and come back with it, so
    nothing is shuffled.
    """
    model = train(docs, labels)
    names = [f"c{i}" for i in range(len(docs.columns))]  # any names, dots included, pass through
    text = names[docs.columns.index("text")]

    def run(batches):
        for batch in batches:
            texts = texts_of(batch, text)
            s = np.concatenate([model.scores(texts[a:b]) for a, b in groups(texts)] or [np.empty(0)])
            yield batch.filter(pa.array(s >= THRESHOLD))

    safe = docs.toDF(*names)
    return safe.mapInArrow(run, safe.schema).toDF(*docs.columns)
