"""A linear-chain conditional random field over word-shape features, in numpy.

Scores are sums of weights of features of a word and its two neighbours, and of pairs of labels. Weights maximise the
penalised log-likelihood of a small labelled table (full-batch Adam; gradients by forward-backward over padded
batches). Decoding is Viterbi over whole sequences: words that are surely O, whatever stands around them, cut a sequence
into runs, which are decoded in padded batches.
"""

from __future__ import annotations

import re

import numpy as np

from .common import TwoGenerationCache

#: Bytes of words whose features are known, and feature rows that are kept.
WORD_BYTES, MOST_ROWS = 24 << 20, 50_000
#: Words that tell what a number or address next to them is.
CUES = frozenset(("phone", "tel", "telephone", "call", "fax", "mobile", "mail", "email", "contact", "write", "ip", "host", "server", "card", "visa", "credit", "account", "ssn", "passport", "id", "number", "no", "version", "license", "page", "at", "dot", "in", "on", "since", "year"))

#: Marks around a word that its cue does not have.
MARKS = ".,;:!?()[]\"'"


def shape(word: str) -> str:
    """Runs of capitals, other letters and digits as A, a and 9; other characters as they are, up to 12."""
    s = re.sub("[A-Z]+", "A", word)
    s = re.sub(r"[^\W\d_A]+", "a", s)
    return re.sub("[0-9]+", "9", s)[:12]


def features(word: str, cue: str | None = None) -> tuple[str, ...]:
    """Names of the features of one word, or of its signature with its cue."""
    digits = sum("0" <= c <= "9" for c in word)
    bare = word.strip(MARKS).lower() if cue is None else cue
    groups = len(re.findall("[0-9]+", word))
    return (f"shape={shape(word)}", f"digits={min(digits, 20)}", f"groups={min(groups, 6)}", f"at={'@' in word}", f"plus={word[:1] == '+'}", f"paren={word[:1] == '('}", f"letters={bool(re.search('[^0-9@+().:/-]', word))}", f"long={min(len(word) // 8, 3)}", *([f"cue={bare}"] if bare in CUES else []))


class _Signs(dict):
    """What stands for each character in a signature: A, a and 9 for ASCII letters and digits, a for what else is a letter."""

    def __missing__(self, code: int) -> int:
        c = chr(code)
        sign = "A" if "A" <= c <= "Z" else "9" if "0" <= c <= "9" else "a" if c.isalnum() and not c.isdecimal() else c
        if len(self) < 100_000:
            self[code] = ord(sign)
        return ord(sign)


_SIGNS = _Signs()


def signature(word: str) -> tuple[str, str]:
    """A text with the features of the word, the same for very many words, and the word's cue or ''."""
    bare = word.strip(MARKS).lower()
    return word.translate(_SIGNS), bare if bare in CUES else ""


def _log_sum(s: np.ndarray, axis: int) -> np.ndarray:
    """log of the sum of exp(s) along an axis."""
    top = s.max(axis, keepdims=True)
    return (top + np.log(np.exp(s - top).sum(axis, keepdims=True))).squeeze(axis)


def _in_stretches(gain: np.ndarray, first: np.ndarray, more: float) -> np.ndarray:
    """Which words are in some stretch whose summed gain, and more, is not below zero; first tells where sequences begin.

    The largest sum of a stretch that ends at a word comes from running sums and their running minimum, that of one
    which begins there from the same the other way round. Sequences are kept apart by a large loss (what still crosses
    it is decoded for nothing, not lost).
    """
    if not len(gain):
        return np.zeros(0, bool)
    apart = np.cumsum(first)
    place = np.arange(len(gain)) + apart
    wide = np.full(len(gain) + int(apart[-1]) + 1, -1000.0)
    wide[place] = gain
    total = np.cumsum(wide)
    ending = total - np.minimum.accumulate(np.concatenate([[0.0], total[:-1]]))
    back = np.cumsum(wide[::-1])
    beginning = (back - np.minimum.accumulate(np.concatenate([[0.0], back[:-1]])))[::-1]
    return (ending + beginning - wide)[place] + more > -1e-6


class CRF:
    def __init__(self, labels: list[str]):
        self.labels, self.names = labels, {}

    def _index(self, sequences: list[list[str]], grow: bool) -> list[list[list[int]]]:
        out = []
        for words in sequences:
            own = [features(w) for w in words]
            rows = []
            for i in range(len(words)):
                names = [f"0{f}" for f in own[i]] + ([f"-{f}" for f in own[i - 1]] if i else ["-start"]) + ([f"+{f}" for f in own[i + 1]] if i + 1 < len(words) else ["+end"])
                rows.append([self.names.setdefault(n, len(self.names)) if grow else self.names[n] for n in names if grow or n in self.names])
            out.append(rows)
        return out

    def objective(self, sequences: list[list[str]], tags: list[list[str]], penalty: float):
        """The mean penalised log-likelihood of a labelled table, as a function of weights (features by labels) and transitions, with its gradients."""
        k, index = len(self.labels), self._index(sequences, True)
        n, t = len(sequences), max(map(len, sequences))
        mask = np.zeros((n, t), bool)
        gold = np.zeros((n, t), int)
        rows, cols = [], []
        for i, seq in enumerate(index):
            mask[i, : len(seq)] = True
            gold[i, : len(seq)] = [self.labels.index(x) for x in tags[i]]
            for j, fs in enumerate(seq):
                rows += [i * t + j] * len(fs)
                cols += fs
        rows, cols, f = np.array(rows), np.array(cols), len(self.names)
        at, starts = np.unique(rows, return_index=True)  # rows ascend
        gather = lambda p: np.stack([np.bincount(cols, p[rows, y], f) for y in range(k)], 1)
        seen = gather(np.eye(k)[gold.reshape(-1)])
        pairs = np.zeros((k, k))
        both = mask[:, 1:] & mask[:, :-1]
        np.add.at(pairs, (gold[:, :-1][both], gold[:, 1:][both]), 1)

        def look(w: np.ndarray, a: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
            e = np.zeros((n * t, k))
            e[at] = np.add.reduceat(w[cols], starts)
            e = e.reshape(n, t, k)
            ahead, back = np.zeros((n, t, k)), np.zeros((n, t, k))
            ahead[:, 0] = e[:, 0]
            for j in range(1, t):
                nxt = _log_sum(ahead[:, j - 1, :, None] + a, 1) + e[:, j]
                ahead[:, j] = np.where(mask[:, j, None], nxt, ahead[:, j - 1])
            for j in range(t - 2, -1, -1):
                back[:, j] = np.where(mask[:, j + 1, None], _log_sum(a + (back[:, j + 1] + e[:, j + 1])[:, None], 2), 0)
            z = _log_sum(ahead[:, -1], 1)
            p = np.exp(ahead + back - z[:, None, None]) * mask[..., None]
            want = gather(p.reshape(-1, k))
            trans = np.zeros((k, k))
            for j in range(t - 1):
                q = np.exp(ahead[:, j, :, None] + a + (e[:, j + 1] + back[:, j + 1])[:, None] - z[:, None, None])
                trans += (q * mask[:, j + 1, None, None]).sum(0)
            value = ((seen * w).sum() + (pairs * a).sum() - z.sum()) / n - penalty / 2 * ((w * w).sum() + (a * a).sum())
            return value, (seen - want) / n - penalty * w, (pairs - trans) / n - penalty * a

        return look, (f, k)

    def fit(self, sequences: list[list[str]], tags: list[list[str]], steps: int = 100, rate: float = 0.1, penalty: float = 1e-3) -> CRF:
        look, (f, k) = self.objective(sequences, tags, penalty)
        w, a = np.zeros((f, k)), np.zeros((k, k))
        moments = [np.zeros_like(x) for x in (w, w, a, a)]
        for step in range(1, steps + 1):
            _, gw, ga = look(w, a)
            for x, g, m, v in ((w, gw, *moments[:2]), (a, ga, *moments[2:])):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.w, self.a = w, a
        return self

    def _forget(self) -> None:
        """Empties what is known of words. Rows hold what a word adds to its own labels, to the next word's and to the one's before; the first two are those of the ends."""
        k = len(self.labels)
        self.words, self.row_of = TwoGenerationCache(WORD_BYTES), {}
        self.rows = np.zeros((3, 1024, k))
        for i, name in enumerate(("-start", "+end")):
            if name in self.names:
                self.rows[i + 1, i] = self.w[self.names[name]]
        self.used = 2

    def _row(self, word: str) -> int:
        sign = signature(word)
        known = self.row_of.get(sign)
        if known is None:
            own = features(*sign)
            if self.used == self.rows.shape[1]:
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)], axis=1)
            known = self.row_of[sign] = self.used
            self.used += 1
            for i, prefix in enumerate("0-+"):
                self.rows[i, known] = sum((self.w[self.names[prefix + f]] for f in own if prefix + f in self.names), np.zeros(len(self.labels)))
        return known

    def _places(self, words: list[str]) -> np.ndarray:
        """The rows of words."""
        if not hasattr(self, "rows") or self.used > MOST_ROWS:
            self._forget()
        new = self.words.missing(words)
        self.words.add(new, [self._row(w) for w in new])
        return np.fromiter(map(self.words.young.__getitem__, words), np.int32, len(words))

    def tagged(self, sequences: list[list[str]]) -> dict[int, dict[int, str]]:
        """By sequence, the words that are not O in its best labelling, with their labels.

        Against a labelling with O throughout, a stretch of other labels between two O gains at most what its words
        gain by themselves and what the best transitions into, within and out of a stretch add. Words that are in no
        stretch whose bound is above zero are O in the best labelling, so they cut a sequence, and what is between them
        is decoded on its own. The bound is taken twice: with the best gain of each word's row, then, for what is left,
        with that of its scores. The first label is O.
        """
        lengths = np.array([len(s) for s in sequences])
        at = self._places([w for s in sequences for w in s])
        if not len(at):
            return {}
        a, ends = self.a, np.cumsum(lengths)
        first, last = np.zeros(len(at), bool), np.zeros(len(at), bool)
        first[(ends - lengths)[lengths > 0]], last[ends[lengths > 0] - 1] = True, True
        before, after = np.concatenate([at[:1], at[:-1]]), np.concatenate([at[1:], at[:1]])
        before[first], after[last] = 0, 1
        rows = self.rows[:, : self.used]
        gain = (rows[:, :, 1:] - rows[:, :, :1]).max(2)
        within, around = (a[1:, 1:]).max() - a[0, 0], max((a[0, 1:] - a[0, 0]).max(), 0) + max((a[1:, 0] - a[0, 0]).max(), 0)
        place = np.flatnonzero(_in_stretches(gain[0][at] + gain[1][before] + gain[2][after] + within, first, around - within))
        e = rows[0][at[place]]
        e += rows[1][before[place]]
        e += rows[2][after[place]]
        begins = first[place] | np.concatenate([[True], np.diff(place) > 1])[: len(place)]
        own = _in_stretches((e[:, 1:] - e[:, :1]).max(1) + within, begins, around - within)
        place, e = place[own], e[own]
        if not len(place):
            return {}
        begins = np.flatnonzero(np.concatenate([[True], (np.diff(place) > 1) | first[place[1:]]]))
        stops = np.concatenate([begins[1:], [len(place)]])
        e[begins] += a[0] * ~first[place[begins], None]
        e[stops - 1] += a[:, 0] * ~last[place[stops - 1], None]
        word, label = self._best(e, begins, stops - begins)
        word = place[word]
        owner = np.searchsorted(ends, word, side="right")
        out: dict[int, dict[int, str]] = {}
        for i, j, y in zip(owner.tolist(), (word - (ends - lengths)[owner]).tolist(), label.tolist(), strict=True):
            out.setdefault(i, {})[j] = self.labels[y]
        return out

    def decode(self, sequences: list[list[str]]) -> list[list[str]]:
        """Best labels of every word."""
        found = self.tagged(sequences)
        return [[found.get(i, {}).get(j, self.labels[0]) for j in range(len(s))] for i, s in enumerate(sequences)]

    def _best(self, e: np.ndarray, begins: np.ndarray, lengths: np.ndarray, most: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi over runs of rows of e, all runs of a length together: the rows that are not O, and their labels."""
        rows, labels = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for t in np.unique(lengths).tolist():
            own = begins[lengths == t]
            at_once = max(1, most // (t * len(self.labels)))
            for i in range(0, len(own), at_once):
                place = own[i : i + at_once, None] + np.arange(t)
                n = np.arange(len(place))
                best, came = e[place[:, 0]], []
                for j in range(1, t):
                    s = best[:, :, None] + self.a
                    came.append(s.argmax(1).astype(np.int8))
                    best = s.max(1) + e[place[:, j]]
                path = np.empty((len(place), t), np.int64)
                path[:, -1] = best.argmax(1)
                for j in range(t - 1, 0, -1):
                    path[:, j - 1] = came[j - 1][n, path[:, j]]
                some = path > 0
                rows.append(place[some])
                labels.append(path[some])
        return np.concatenate(rows), np.concatenate(labels)
