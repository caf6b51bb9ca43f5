"""Personal data in texts: fixed patterns, and a character network that adds what they miss.

The network is a bidirectional LSTM over characters with a conditional random field on top, trained in numpy from
spans that the patterns label (and from altered forms of them). Texts are read in overlapping windows; each
character takes its label from the window in which it is furthest from an edge, and spans are put together over
the whole text. Every window is scored. Viterbi's search is left out only where the scores prove that the path without
any span is the best one.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.bpe import id_type
from cohortspark.llm.common import free_names, map_batches, with_columns

# The kinds in order, and the patterns of the contract.
KINDS = ["email", "ip", "card", "phone"]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

SIGN = re.compile(r"[0-9@]")
# An address with its signs in words; a bare "at" needs a "dot" in words as well.
WRITTEN = re.compile(r"[A-Za-z0-9._%+-]+( ?[(\[]at[)\]] ?[A-Za-z0-9-]+((\.| dot )[A-Za-z0-9-]+)+| at [A-Za-z0-9-]+( dot [A-Za-z0-9-]+)+)")
LENGTH, STRIDE = 256, 224
EXAMPLE = 128  # characters of the windows that are learnt from
WINDOWS = 512  # scored together
EMBEDDED, HIDDEN = 12, 12
LETTERS = 130  # ASCII, other letters, other characters
SLACK = 1e-2  # far above the rounding of a window's sums
TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the local part, @ and the domain; found from each @, in linear time."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            floor = domain.end()
            out.append((start, floor))
        at = text.find("@", domain.end() if domain else at + 1)
    return out


def valid(kind: str, found: str) -> bool:
    """The checks on what a pattern or the network has found."""
    digits = digits_of(found)
    if kind == "ip":
        pieces = re.findall(r"[0-9]+", found)
        return len(pieces) == 4 and all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in pieces)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    return "@" in found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by the patterns, in order of kind and start; ends are exclusive, in code points."""
    out = [("email", *x) for x in _emails(text)] if "@" in text else []
    if any(c in text for c in "0123456789"):
        for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
            out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if valid(kind, m[0])]
    return out


def codes(text: str) -> np.ndarray:
    """A small number for each character; 0 is kept for padding."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.where(points < 128, np.maximum(points, 1), 129).astype(np.uint8)
    others, place = np.unique(points[points >= 128], return_inverse=True)
    if len(others):
        out[points >= 128] = np.array([128 if chr(p).isalpha() else 129 for p in others], np.uint8)[place]
    return out


def tags(length: int, spans: list[tuple[str, int, int]]) -> np.ndarray:
    out = np.zeros(length, np.int64)
    for kind, start, end in spans:
        k = 1 + 2 * KINDS.index(kind)
        out[max(0, start) : max(0, end)] = k + 1
        if 0 <= start < length:
            out[start] = k
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Tagger:
    """The weights by name: embedding, for either direction input, recurrent and bias, output, transitions."""

    weights: dict[str, np.ndarray]

    def _lstm(self, x: np.ndarray, side: str):
        w, u, b = (self.weights[f"{side}_{name}"] for name in ("in", "rec", "bias"))
        steps, n = x.shape[1], len(x)
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        into = x @ w + b
        trace = []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = into[:, t] + h @ u
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            before, h_before = c, h
            c = f * c + i * g
            th = np.tanh(c)
            h = o * th
            trace.append((t, i, f, o, g, before, th, h_before, h))
        out = np.empty((n, steps, HIDDEN), np.float32)
        for step in trace:
            out[:, step[0]] = step[-1]
        return out, trace

    def scores(self, letters: np.ndarray, keep: bool = False):
        """Score of each tag at each character of windows (rows of codes)."""
        x = self.weights["embedding"][letters]
        forward, f_trace = self._lstm(x, "f")
        backward, b_trace = self._lstm(x, "b")
        both = np.concatenate([forward, backward], axis=2)
        out = both @ self.weights["out"] + self.weights["out_bias"]
        return (out, x, both, f_trace, b_trace) if keep else out

    def quick_scores(self, letters: np.ndarray) -> np.ndarray:
        """The same as `scores`, with steps before windows, for many windows and without what training keeps.

        Both directions take a step together. A letter's embedding stands below the state, so that one product gives the
        gates; states and cells carry a factor of two, as a sigmoid is (1 + tanh(x / 2)) / 2. The tags of a step are rows.
        """
        steps = np.ascontiguousarray(letters.T).astype(np.intp)
        count, n = steps.shape
        embedding = np.ascontiguousarray(self.weights["embedding"].T)
        kind = embedding.dtype
        half = np.ones((4 * HIDDEN, 1), kind)
        half[: 3 * HIDDEN] = 0.5
        rows = lambda side: [self.weights[f"{side}_rec"].T / 2, self.weights[f"{side}_in"].T, self.weights[f"{side}_bias"][:, None]]
        into = np.stack([np.concatenate(rows(side), axis=1) * half for side in "fb"]).astype(kind)
        onto = np.stack([self.weights["out"][:HIDDEN].T, self.weights["out"][HIDDEN:].T]) / kind.type(2)
        state = np.zeros((2, HIDDEN + EMBEDDED + 1, n), kind)
        state[:, -1] = 1
        h, first, second = state[:, :HIDDEN], state[0, HIDDEN:-1], state[1, HIDDEN:-1]
        c, z = np.zeros((2, HIDDEN, n), kind), np.empty((2, 4 * HIDDEN, n), kind)
        gates, i, f, o, g = z[:, : 3 * HIDDEN], *(z[:, k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
        tags = np.empty((2, TAGS, n), kind)
        out = np.empty((count, TAGS, n), kind)
        out[:] = self.weights["out_bias"][:, None]
        for t in range(count):
            embedding.take(steps[t], axis=1, out=first, mode="clip")
            embedding.take(steps[-1 - t], axis=1, out=second, mode="clip")
            np.matmul(into, state, out=z)
            np.tanh(z, out=z)
            gates += 1
            c *= f
            i *= g
            c += i
            c *= 0.5
            np.tanh(c, out=g)
            np.multiply(o, g, out=h)
            np.matmul(onto, h, out=tags)
            out[t] += tags[0]
            out[-1 - t] += tags[1]
        return out.transpose(0, 2, 1)

    def decode(self, letters: np.ndarray) -> np.ndarray:
        """The best tag sequence of each window under scores and transitions."""
        return self._viterbi(self.quick_scores(letters))

    def marked(self, letters: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(row, best tag sequence) of the windows whose best sequence has a span.

        A path with a span differs from the one without by what its characters gain over tag 0 and by what its transitions
        gain. `reach` bounds what a span that ends here can gain, with the best tag of each character and the best
        transition of each sort. Where that is below zero all along, the path without spans is the best, and no search is
        needed.
        """
        scores, moves = self.quick_scores(letters), self.weights["moves"]
        gains = scores[:, :, 1:].max(axis=2) - scores[:, :, 0]
        moves = moves - moves[0, 0]
        enter, stay, leave = moves[0, 1:].max(), moves[1:, 1:].max(), moves[1:, 0].max()
        reach, most = gains[0], gains[0] + leave
        for step in gains[1:]:
            reach = np.maximum(reach + stay, enter) + step
            np.maximum(most, reach + leave, out=most)
        open_rows = np.flatnonzero(np.maximum(most, reach) >= -SLACK)
        paths = self._viterbi(scores[:, open_rows])
        return [(int(row), path) for row, path in zip(open_rows, paths) if path.any()]

    def _viterbi(self, scores: np.ndarray) -> np.ndarray:
        moves = self.weights["moves"]
        steps, n, _ = scores.shape
        best, back = scores[0], np.empty((steps, n, TAGS), np.int8)
        for t in range(1, steps):
            ways = best[:, :, None] + moves[None]
            back[t] = ways.argmax(axis=1)
            best = ways.max(axis=1) + scores[t]
        out = np.empty((n, steps), np.int64)
        out[:, -1] = best.argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            out[:, t - 1] = back[t, np.arange(n), out[:, t]]
        return out

    def _crf(self, scores: np.ndarray, wanted: np.ndarray):
        """Gradients of the negative log-likelihood with respect to scores and transitions."""
        moves = self.weights["moves"]
        n, steps, _ = scores.shape
        lse = lambda x, axis: np.log(np.exp(x - (m := x.max(axis=axis, keepdims=True))).sum(axis=axis)) + m.squeeze(axis)
        ahead, behind = np.empty_like(scores), np.zeros_like(scores)
        ahead[:, 0] = scores[:, 0]
        for t in range(1, steps):
            ahead[:, t] = scores[:, t] + lse(ahead[:, t - 1][:, :, None] + moves[None], 1)
        for t in range(steps - 2, -1, -1):
            behind[:, t] = lse(moves[None] + (scores[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
        total = lse(ahead[:, -1], 1)[:, None, None]
        d_scores = np.exp(ahead + behind - total)
        np.put_along_axis(d_scores, wanted[:, :, None], np.take_along_axis(d_scores, wanted[:, :, None], 2) - 1, 2)
        d_moves = np.zeros_like(moves)
        for t in range(1, steps):
            pair = ahead[:, t - 1][:, :, None] + moves[None] + (scores[:, t] + behind[:, t])[:, None, :] - total
            d_moves += np.exp(pair).sum(axis=0)
        np.add.at(d_moves, (wanted[:, :-1].ravel(), wanted[:, 1:].ravel()), -1)
        return d_scores / n, d_moves / n

    def _lstm_back(self, side: str, x: np.ndarray, trace: list, d_out: np.ndarray, grads: dict) -> np.ndarray:
        w, u = self.weights[f"{side}_in"], self.weights[f"{side}_rec"]
        d_x = np.zeros_like(x)
        d_w, d_u, d_b = np.zeros_like(w), np.zeros_like(u), np.zeros(4 * HIDDEN, np.float32)
        d_h, d_c = np.zeros((len(x), HIDDEN), np.float32), np.zeros((len(x), HIDDEN), np.float32)
        for t, i, f, o, g, before, th, h_before, _ in reversed(trace):
            d_h = d_h + d_out[:, t]
            d_c = d_c + d_h * o * (1 - th * th)
            d_z = np.concatenate(
                [d_c * g * i * (1 - i), d_c * before * f * (1 - f), d_h * th * o * (1 - o), d_c * i * (1 - g * g)], axis=1
            )
            d_w += x[:, t].T @ d_z
            d_u += h_before.T @ d_z
            d_b += d_z.sum(axis=0)
            d_x[:, t] = d_z @ w.T
            d_h, d_c = d_z @ u.T, d_c * f
        grads[f"{side}_in"], grads[f"{side}_rec"], grads[f"{side}_bias"] = d_w, d_u, d_b
        return d_x

    def gradients(self, letters: np.ndarray, wanted: np.ndarray) -> dict[str, np.ndarray]:
        scores, x, both, f_trace, b_trace = self.scores(letters, keep=True)
        grads: dict[str, np.ndarray] = {}
        d_scores, grads["moves"] = self._crf(scores, wanted)
        grads["out"] = np.einsum("nth,ntk->hk", both, d_scores)
        grads["out_bias"] = d_scores.sum(axis=(0, 1))
        d_both = d_scores @ self.weights["out"].T
        d_x = self._lstm_back("f", x, f_trace, d_both[:, :, :HIDDEN], grads)
        d_x = d_x + self._lstm_back("b", x, b_trace, d_both[:, :, HIDDEN:], grads)
        grads["embedding"] = np.zeros_like(self.weights["embedding"])
        np.add.at(grads["embedding"], letters.ravel(), d_x.reshape(-1, EMBEDDED))
        return grads


def train(windows: list[str], labels: list[np.ndarray], epochs: int = 8, rate: float = 0.02, seed: int = 5) -> Tagger:
    """A tagger fitted by Adam to windows with a tag for each character."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) * 0.2).astype(np.float32)
    weights = {"embedding": draw(LETTERS, EMBEDDED), "out": draw(2 * HIDDEN, TAGS), "out_bias": np.zeros(TAGS, np.float32)}
    weights["moves"] = draw(TAGS, TAGS)
    for side in "fb":
        weights |= {f"{side}_in": draw(EMBEDDED, 4 * HIDDEN), f"{side}_rec": draw(HIDDEN, 4 * HIDDEN)}
        weights[f"{side}_bias"] = np.zeros(4 * HIDDEN, np.float32)
        weights[f"{side}_bias"][HIDDEN : 2 * HIDDEN] = 1
    tagger = Tagger(weights)
    letters, wanted = np.zeros((len(windows), EXAMPLE), np.int64), np.zeros((len(windows), EXAMPLE), np.int64)
    for row, (text, tag) in enumerate(zip(windows, labels)):
        letters[row, : len(text)], wanted[row, : len(text)] = codes(text), tag
    first, second = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(windows))
        for i in range(0, len(order), 64):
            rows = order[i : i + 64]
            step += 1
            for name, g in tagger.gradients(letters[rows], wanted[rows]).items():
                g = np.clip(g, -1, 1)
                first[name] += 0.1 * (g - first[name])
                second[name] += 0.01 * (g * g - second[name])
                move = (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)
                weights[name] -= (rate / (1 + epoch) * move).astype(np.float32)
    return tagger


def altered(window: str, spans: list[tuple[str, int, int]], rng: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """The window with one span written as the patterns don't know it, still labelled: a phone number without its
    country code, a number in groups with dots, an address with its signs in words."""
    for k, (kind, start, end) in enumerate(spans):
        found = window[start:end]
        if kind == "phone" and start >= 0 and end <= len(window):
            new = rng.choice(["00" + found[1:], "(+" + found[1:2] + ")" + found[2:]])
        elif kind == "card" and 0 <= start and end <= len(window):
            sign = rng.choice([".", "_", "  "])
            digits = digits_of(found)
            new = sign.join(digits[i : i + 4] for i in range(0, len(digits), 4))
        elif kind == "email" and 0 <= start and end <= len(window):
            sign, point = rng.choice([(" at ", " dot "), (" (at) ", " dot "), (" [at] ", "."), ("(at)", ".")])
            name, host = found.split("@")
            new = name + sign + host.replace(".", point)
        else:
            continue
        window = window[:start] + new + window[end:]
        grown = len(new) - len(found)
        moved = [(a, s + grown * (s >= end), e + grown * (s >= end)) for a, s, e in spans]
        moved[k] = (kind, start, start + len(new))
        window = window[:EXAMPLE]
        return window, [(a, s, min(e, len(window))) for a, s, e in moved if s < len(window)]
    return window, spans


def fit(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", most_docs: int = 2_000, most_windows: int = 3_000
) -> Tagger | None:
    """A tagger from spans that the patterns label in a bounded sample; None if no text has a digit or an @.

    The sample: about `most_docs` documents with a digit or @, drawn by a hash of id and text; of each the first
    window and the first eight around such a sign. Only windows are brought together, and `most_windows` reach the driver.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("t")).where(F.col("t").rlike("[0-9@]"))
    share = int(10**12 * min(1.0, most_docs / max(1, rows.count())))
    rows = rows.where(F.pmod(F.xxhash64("id", "t"), F.lit(10**12)) < share)

    def run(batch):
        out = [[], [], [], []]
        for t in batch.column(0).to_pylist():
            spans, at, taken = base_spans(t), 0, 0
            while taken < 9 and (taken == 0 or (sign := SIGN.search(t, at))):
                start = max(0, sign.start() - 8 - (sign.start() * 7) % (EXAMPLE // 2)) if taken else 0
                window = t[start : start + EXAMPLE]
                inside = [(k, s - start, e - start) for k, s, e in spans if s - start < len(window) and e > start]
                for column, value in zip(out, (window, [k for k, _, _ in inside], [s for _, s, _ in inside], [e for *_, e in inside])):
                    column.append(value)
                at, taken = start + EXAMPLE if taken else 0, taken + 1
        return out

    schema = "t string, kinds array<string>, starts array<bigint>, ends array<bigint>"
    found = map_batches(rows, ["t"], run, schema).orderBy(F.xxhash64("t"), "t").limit(most_windows).collect()
    if not found:
        return None
    rng = random.Random(9)
    windows, labels = [], []
    for row in found:
        spans = list(zip(row.kinds, row.starts, row.ends))
        examples = [(row.t, spans)] + ([altered(row.t, spans, rng)] if spans else [])
        for window, marked in examples:
            windows.append(window)
            labels.append(tags(len(window), marked))
    return train(windows, labels)


def windows(text: str) -> np.ndarray:
    """The codes of all windows of a text, one a row: they start every STRIDE characters, the last one holds the end."""
    count = 1 + max(0, -(-(len(text) - LENGTH) // STRIDE))
    padded = np.zeros((count - 1) * STRIDE + LENGTH, np.uint8)
    padded[: len(text)] = codes(text)
    return np.lib.stride_tricks.sliding_window_view(padded, LENGTH)[::STRIDE]


def window_batches(texts: list[str]):
    """([(row, start)], codes) of the windows of all texts, WINDOWS at most together."""
    places, pieces, held = [], [], 0
    for row, text in enumerate(texts):
        some = windows(text) if text else np.zeros((0, LENGTH), np.uint8)
        at = 0
        while at < len(some):
            piece = some[at : at + WINDOWS - held]
            places += [(row, (at + i) * STRIDE) for i in range(len(piece))]
            pieces.append(piece)
            at, held = at + len(piece), held + len(piece)
            if held == WINDOWS:
                yield places, np.concatenate(pieces)
                places, pieces, held = [], [], 0
    if held:
        yield places, np.concatenate(pieces)


def plausible(kind: str, text: str, start: int, end: int) -> bool:
    """The checks of the kind; besides, no letter or digit goes on at either end, an e-mail address has no blank
    unless its signs are in words, and a phone number has more than digits."""
    found = text[start:end]
    if text[start - 1 : start].isalnum() or text[end : end + 1].isalnum():
        return False
    if not valid(kind, found) and not (kind == "email" and WRITTEN.fullmatch(found)):
        return False
    if kind == "email":
        return WRITTEN.fullmatch(found) is not None or found.count("@") == 1 and not any(c.isspace() for c in found)
    return kind != "phone" or not found.isdigit() or found.startswith("00")


def added_spans(text: str, marked: list[tuple[int, np.ndarray]], base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of the network, over the whole text, that pass the checks and touch no span of the patterns.

    `marked` has the start and the tags of the windows that have any; a character counts in one window only.
    """
    margin = (LENGTH - STRIDE) // 2
    label: dict[int, int] = {}
    for start, row in marked:
        low = 0 if start == 0 else margin
        high = LENGTH if start + LENGTH >= len(text) else LENGTH - margin
        for i in range(low, min(high, len(text) - start)):
            if row[i]:
                label[start + i] = int(row[i])
    out, taken = [], [(s, e) for _, s, e in base]
    runs: list[list[int]] = []  # kind, start, end
    for p in sorted(label):
        kind, begins = (label[p] - 1) // 2, label[p] % 2 == 1
        if runs and runs[-1][2] == p and runs[-1][0] == kind and not begins:
            runs[-1][2] = p + 1
        else:
            runs.append([kind, p, p + 1])
    for kind, start, end in runs:
        found = text[start:end]
        start, end = start + len(found) - len(found.lstrip()), end - (len(found) - len(found.rstrip()))
        if plausible(KINDS[kind], text, start, end) and not any(s < end and start < e for s, e in taken):
            out.append((KINDS[kind], start, end))
            taken.append((start, end))
    return out


def all_spans(tagger: Tagger | None, texts: list[str]) -> list[list[tuple[str, int, int, bool]]]:
    """(kind, start, end, by pattern) of each text, in order of kind and start."""
    base = [base_spans(t) for t in texts]
    marked: list[list] = [[] for _ in texts]
    for places, letters in window_batches(texts) if tagger is not None else ():
        for k, path in tagger.marked(letters):
            row, start = places[k]
            marked[row].append((start, path))
    out = []
    for t, some, known in zip(texts, marked, base):
        both = [(*x, True) for x in known] + [(*x, False) for x in added_spans(t, some, known)]
        out.append(sorted(both, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))
    return out


def find(docs: DataFrame, tagger: Tagger | None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kinds, starts, ends, by_pattern) of all spans of every whole text, in order of kind and start.

    Null and empty texts have none; repeated rows give repeated results; without a tagger the patterns stand alone.
    """

    def run(batch):
        both = all_spans(tagger, [t or "" for t in batch.column(1).to_pylist()])
        columns = [[list(x) for x in (zip(*spans) if spans else ([], [], [], []))] for spans in both]
        return batch.column(0), *[[row[i] for row in columns] for i in range(4)]

    kind = id_type(docs, id_column)
    schema = f"doc_id {kind}, kinds array<string>, starts array<bigint>, ends array<bigint>, by_pattern array<boolean>"
    return map_batches(docs, [id_column, text], run, schema)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans go together."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def masked(docs: DataFrame, tagger: Tagger | None, text: str = "text") -> DataFrame:
    """The rows with every span in their texts replaced by its kind; all other columns stay, null texts too."""

    def run(columns):
        texts = columns[0]
        found = all_spans(tagger, [t or "" for t in texts])
        return [[t if t is None else redacted(t, [x[:3] for x in spans]) for t, spans in zip(texts, found)]]

    (name,) = free_names(docs, "_masked")
    marked = with_columns(docs, [text], run, f"{name} string")
    return marked.withColumn(text, F.col(name)).select(*docs.columns)
