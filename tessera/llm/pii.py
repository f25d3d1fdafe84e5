"""Personal data: fixed patterns, and a character-level bidirectional LSTM with a CRF that adds what they miss.

The patterns find e-mail addresses, IPv4 addresses, payment card numbers and telephone numbers; a match that fails its test (parts over 255,
Luhn, number of digits) is dropped and not tried again, so a telephone number that runs into a card number is lost to them.
The model reads characters as classes, labels each with O or B-/I- of a kind, and is trained in numpy, by backpropagation
through time and the CRF's forward-backward sums, on labelled spans: the matches in a bounded sample of the documents, and
the same strings set side by side, in brackets and at line ends, as text in which the patterns fail.

What passes a kind's test lies within a run of the characters that the kind is made of: letters, digits and ._%+-@ around an @, or
digits, spaces and ().+- around a digit. Every such run is read whole, however long, with `CONTEXT` characters on both sides for the
model to see; outside these runs no span of the four kinds can be. Overlapping windows are decoded together: the scores of a
character are averaged over its windows, weighted towards their middles, and one CRF path is found over each whole stretch,
whose scores are worked off some windows at a time while the path's state is carried on, so no span is cut at a border. A found span
is added if it passes its kind's test and touches no other span. All patterns are linear in the length of the text.

Defined results: null text is empty and holds nothing; offsets are code points, ends exclusive; repeated rows get the same spans;
with no example to learn from the model is trained on the built-in ones alone; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ensure_columns

KINDS = ("email", "ip", "card", "phone")
# The patterns of the task. Runs of digits are taken whole (a match can't begin or end within one), which keeps them linear.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ACTIVE = re.compile(r"[0-9@]")

WINDOW, CONTEXT, HIDDEN, EMBED = 96, 40, 16, 12
SAMPLE = 1500


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def valid(kind: str, s: str) -> bool:
    if kind == "email":
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++", s))
    if kind == "ip":
        return bool(re.fullmatch(r"[0-9]++(\.[0-9]++){3}", s)) and all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in s.split(".")))
    d = digits_of(s)
    if kind == "card":
        return 16 <= len(d) <= 19 and bool(re.fullmatch(r"[0-9]([\x20.-]?[0-9])+", s)) and luhn(d)
    return bool(re.fullmatch(r"[+(]?[0-9][\x20().0-9-]*[0-9]", s)) and 8 <= len(d) <= 15


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The patterns' matches, leftmost and non-overlapping per kind."""
    out = []
    if not _ACTIVE.search(text):
        return out
    last = 0
    for m in _DOMAIN.finditer(text) if "@" in text else ():
        start = m.start()
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < m.start():
            out.append(("email", start, m.end()))
            last = m.end()
    for kind, pattern in (("ip", _IP), ("card", _CARD)):
        for m in pattern.finditer(text):
            if m.end() - m.start() >= 7 and valid(kind, m[0]):
                out.append((kind, m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if valid("phone", m[0])]
    return out


# --------------------------------------------------------------------------------------------------------- model

CLASSES = 22
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))


def classes(text: str) -> np.ndarray:
    """Characters as small numbers: digits, letters and what spans are made of apart from each other."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(code < 128, _CLASS[np.minimum(code, 127)], 21)


_CLASS = np.full(128, 20)
_CLASS[ord("0") : ord("9") + 1] = [1, 2, 2, 3, 4, 4, 4, 4, 5, 5]
_CLASS[ord("a") : ord("z") + 1] = 6
_CLASS[ord("A") : ord("Z") + 1] = 7
for _i, _c in enumerate("@.+-() \n,:_%"):
    _CLASS[ord(_c)] = 8 + _i


@dataclass
class Tagger:
    """Weights by name: embed, and for each direction w (input and state to the four gates) and b; out, bias; steps between tags."""

    w: dict[str, np.ndarray]

    def scores(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """(windows, length) of classes -> (windows, length, tags)."""
        e = self.w["embed"][x]
        states = []
        for way in ("f", "r"):
            seq = e if way == "f" else e[:, ::-1]
            n, length, _ = seq.shape
            h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
            given = seq @ self.w["w" + way][:EMBED] + self.w["b" + way]
            u, out, tape = self.w["w" + way][EMBED:], np.empty((n, length, HIDDEN)), []
            for t in range(length):
                z = given[:, t] + h @ u
                s = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
                i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
                g = np.tanh(z[:, 3 * HIDDEN :])
                if keep is not None:
                    tape.append((h, c, i, f, o, g))
                c = f * c + i * g
                h = o * np.tanh(c)
                out[:, t] = h
            if keep is not None:
                keep.append((seq, tape))
            states.append(out if way == "f" else out[:, ::-1])
        both = np.concatenate(states, axis=2)
        if keep is not None:
            keep.append(both)
        return both @ self.w["out"] + self.w["bias"]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def crf_loss(scores: np.ndarray, tags: np.ndarray, steps: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of the tags, and its gradients by scores and steps."""
    n, length, k = scores.shape
    alpha, beta = np.empty_like(scores), np.zeros_like(scores)
    alpha[:, 0] = scores[:, 0]
    for t in range(1, length):
        alpha[:, t] = scores[:, t] + _logsum(alpha[:, t - 1, :, None] + steps, 1)
    for t in range(length - 2, -1, -1):
        beta[:, t] = _logsum(steps + (scores[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
    total = _logsum(alpha[:, -1], 1)
    by_score = np.exp(alpha + beta - total[:, None, None])
    by_step = np.exp(alpha[:, :-1, :, None] + steps + (scores + beta)[:, 1:, None, :] - total[:, None, None, None]).sum((0, 1))
    row, col = np.arange(n)[:, None], np.arange(length)
    gold = scores[row, col, tags].sum() + steps[tags[:, :-1], tags[:, 1:]].sum()
    by_score[row, col, tags] -= 1
    np.add.at(by_step, (tags[:, :-1], tags[:, 1:]), -1)
    return (total.sum() - gold) / n, by_score / n, by_step / n


class Path:
    """Viterbi's path over a stretch of any length, whose scores come part by part."""

    def __init__(self, steps: np.ndarray):
        self.steps, self.back, self.v = steps, [], None

    def add(self, scores: np.ndarray) -> None:
        back, at = np.zeros(scores.shape, np.int8), 0
        if self.v is None and len(scores):
            self.v, at = scores[0], 1
        for t in range(at, len(scores)):
            x = self.v[:, None] + self.steps
            back[t] = x.argmax(0)
            self.v = x.max(0) + scores[t]
        self.back.append(back)

    def tags(self) -> np.ndarray:
        back = np.concatenate(self.back)
        out = np.empty(len(back), np.int8)
        out[-1] = tag = int(self.v.argmax())
        for t in range(len(back) - 1, 0, -1):
            out[t - 1] = tag = back[t, tag]
        return out


def best_path(scores: np.ndarray, steps: np.ndarray) -> np.ndarray:
    path = Path(steps)
    path.add(scores)
    return path.tags()


def gradients(tagger: Tagger, x: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    keep: list = []
    scores = tagger.scores(x, keep)
    both = keep.pop()
    loss, ds, dsteps = crf_loss(scores, tags, tagger.w["steps"])
    g = {"steps": dsteps, "out": np.tensordot(both, ds, ((0, 1), (0, 1))), "bias": ds.sum((0, 1)), "embed": np.zeros_like(tagger.w["embed"])}
    dboth = ds @ tagger.w["out"].T
    for way, (seq, tape) in zip("fr", keep, strict=True):
        dout = dboth[:, :, :HIDDEN] if way == "f" else dboth[:, ::-1, HIDDEN:]
        w = tagger.w["w" + way]
        dw, db, dseq = np.zeros_like(w), np.zeros(4 * HIDDEN), np.empty_like(seq)
        dh, dc = np.zeros((len(seq), HIDDEN)), np.zeros((len(seq), HIDDEN))
        for t in range(seq.shape[1] - 1, -1, -1):
            h, c, i, f, o, cand = tape[t]
            tc = np.tanh(f * c + i * cand)
            dh = dh + dout[:, t]
            dc = dc + dh * o * (1 - tc**2)
            dz = np.concatenate([dc * cand * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - cand**2)], axis=1)
            dw[:EMBED] += seq[:, t].T @ dz
            dw[EMBED:] += h.T @ dz
            db += dz.sum(0)
            dseq[:, t] = dz @ w[:EMBED].T
            dh, dc = dz @ w[EMBED:].T, dc * f
        g["w" + way], g["b" + way] = dw, db
        np.add.at(g["embed"], x if way == "f" else x[:, ::-1], dseq)
    return loss, g


def fresh(seed: int = 5) -> Tagger:
    r = np.random.default_rng(seed)
    k = len(TAGS)
    w = {"embed": r.normal(0, 0.4, (CLASSES, EMBED)), "out": r.normal(0, 0.2, (2 * HIDDEN, k)), "bias": np.zeros(k), "steps": np.zeros((k, k))}
    for way in "fr":
        w["w" + way] = r.normal(0, 0.25, (EMBED + HIDDEN, 4 * HIDDEN))
        w["b" + way] = np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]
    return Tagger(w)


def train(examples: list[tuple[str, list[tuple[str, int, int]]]], passes: int = 10, seed: int = 5) -> Tagger:
    """Adam over shuffled batches of windows cut from labelled texts."""
    xs, ys = [], []
    for text, spans in examples:
        x, y = classes(text), np.zeros(len(text), np.int64)
        for kind, a, z in spans:
            y[a:z] = 2 + 2 * KINDS.index(kind)
            y[a] -= 1
        for a in range(0, max(1, len(x) - WINDOW // 2), WINDOW // 2):
            px, py = np.zeros(WINDOW, np.int64), np.zeros(WINDOW, np.int64)
            px[: len(x[a : a + WINDOW])], py[: len(x[a : a + WINDOW])] = x[a : a + WINDOW], y[a : a + WINDOW]
            xs.append(px)
            ys.append(py)
    x, y, tagger, r = np.array(xs), np.array(ys), fresh(seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in tagger.w.items()}
    v, step, batch = {k: np.zeros_like(a) for k, a in tagger.w.items()}, 0, 48
    total = passes * -(-len(x) // batch)
    for _ in range(passes):
        order = r.permutation(len(x))
        for i in range(0, len(x), batch):
            part = order[i : i + batch]
            _, g = gradients(tagger, x[part], y[part])
            step += 1
            norm = np.sqrt(sum((a**2).sum() for a in g.values()))
            rate = 0.02 * min(1, 1.2 - step / total) * min(1.0, 5 / max(norm, 1e-9))
            for k, a in g.items():
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.999 * v[k] + 0.001 * a**2
                tagger.w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return tagger


def _card(r: np.random.Generator) -> str:
    n = int(r.choice([16, 16, 16, 16, 17, 18, 19]))
    d = "4" + "".join(map(str, r.integers(0, 10, n - 2)))
    d += next(c for c in "0123456789" if luhn(d + c))
    gap = str(r.choice(["", "", " ", "-"]))
    return gap.join(d[i : i + 4] for i in range(0, n, 4)) if gap else d


def _made(kind: str, r: np.random.Generator) -> str:
    letters = lambda n: "".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    number = lambda n: "".join(map(str, r.integers(0, 10, n)))
    if kind == "email":
        return f"{letters(r.integers(2, 9))}{r.choice(['', '.', '_', '-'])}{number(r.integers(0, 4))}{letters(r.integers(1, 4))}@{letters(r.integers(3, 8))}{number(r.integers(0, 2))}.{r.choice(['example.com', 'com', 'org', 'co.uk', 'net'])}"
    if kind == "ip":
        return ".".join(map(str, r.integers(0, 256, 4)))
    if kind == "card":
        return _card(r)
    country = str(r.integers(1, 99))
    return str(r.choice([f"+1 ({number(3)}) {number(3)}-{number(4)}", f"+{country} {number(3)} {number(3)} {number(4)}", f"+{country}-{number(3)}-{number(7)}", f"+{country}{number(9)}", f"+{country} ({number(2)}) {number(4)} {number(4)}"]))


def _plain(r: np.random.Generator) -> str:
    """Numbers and signs that are no personal data."""
    n = lambda a, b: str(r.integers(a, b))
    return str(r.choice([n(0, 10), n(10, 100), n(1900, 2100), f"{n(1, 9)}.{n(0, 9)}", f"{n(1, 30)}.{n(1, 12)}.{n(1990, 2030)}", f"{n(1, 999)},{n(100, 999)}", f"{n(0, 9)}.{n(0, 20)}.{n(0, 20)}", f"{n(1, 99)}-{n(100, 9999)}", f"{n(10000, 9999999)}", f"{n(300, 999)}.{n(0, 255)}.{n(0, 255)}.{n(0, 255)}", f"@{n(1, 9)}", f"{n(1000, 9999)} {n(1000, 9999)}", f"+{n(1, 9)}", f"{n(10**11, 10**12)}", f'"{r.integers(0, 2**60):x}{r.integers(0, 2**60):x}"', f"{n(0, 24)}:{n(10, 60)}"]))


def built_examples(words: list[str], found: dict[str, list[str]], count: int = 1400, seed: int = 3) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Texts of real words with spans set in: found ones and made ones, alone or side by side, and numbers that are none."""
    r, out = np.random.default_rng(seed), []
    for _ in range(count):
        text, spans = "", []
        while len(text) < 70:
            text += " ".join(r.choice(words, r.integers(1, 4))) + str(r.choice([" ", " ", " ", ", ", ". ", "\n", ": ", " ("]))
            u = r.random()
            if u < 0.25:
                text += _plain(r) + " "
            elif u < 0.8:
                for _ in range(int(r.choice([1, 1, 2, 2, 3]))):
                    kind = KINDS[r.integers(0, 4)]
                    s = str(r.choice(found[kind])) if found.get(kind) and r.random() < 0.4 else _made(kind, r)
                    spans.append((kind, len(text), len(text) + len(s)))
                    text += s + str(r.choice([" ", " ", " ", ", ", "\n", ") "]))
        out.append((text, spans))
    return out


def fit(documents: DataFrame) -> Tagger:
    """Train on the patterns' matches in SAMPLE documents at most, those of the smallest hash among all that have any."""
    docs = ensure_columns(documents, doc_id="long", text="string")
    active = docs.where(F.col("text").rlike(r"[0-9][0-9]|@"))

    def around(batches):
        for b in batches:
            out = []
            for t in b.column(0).to_pylist():
                spans = base_spans(t)
                if spans:
                    kind, a, z = spans[len(t) % len(spans)]
                    lo = max(0, a - CONTEXT)
                    cut = t[lo : z + CONTEXT]
                    out.append((int.from_bytes(hashlib.blake2b(cut.encode(), digest_size=7).digest(), "big"), cut, kind, t[a:z]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["order", "cut", "kind", "found"])

    rows = active.select("text").mapInArrow(around, "order long, cut string, kind string, found string").distinct().orderBy("order", "cut").limit(SAMPLE).collect()
    found: dict[str, list[str]] = {}
    words = ["the", "of", "Number", "at", "mail", "call"]
    real = []
    for r in rows:
        found.setdefault(r.kind, []).append(r.found)
        words += [w for w in r.cut.replace(r.found, " ").split() if not _ACTIVE.search(w)]
        spans = base_spans(r.cut)
        left = r.cut
        for _, a, z in spans:
            left = left[:a] + " " * (z - a) + left[z:]
        if not _ACTIVE.search(left):  # no digits beside the matches: nothing that the patterns may have missed
            real.append((r.cut, spans))
    return train(real[:600] + built_examples(words, found))


_MAIL_RUN = re.compile(r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]*+@[A-Za-z0-9._%+@-]*+")
_NUMBER_RUN = re.compile(r"(?<![0-9\x20().+-])[\x20().+-]*+[0-9][0-9\x20().+-]*+")


def stretches(text: str) -> list[tuple[int, int]]:
    """All runs that can hold a span, with their contexts, merged where they meet."""
    runs = [m.span() for m in _NUMBER_RUN.finditer(text)]
    if "@" in text:
        runs = sorted(runs + [m.span() for m in _MAIL_RUN.finditer(text)])
    out: list[list[int]] = []
    for a, z in runs:
        a, z = max(0, a - CONTEXT), min(len(text), z + CONTEXT)
        if out and a <= out[-1][1]:
            out[-1][1] = max(z, out[-1][1])
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


_WEIGHT = 1.0 + np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1])
HOP = WINDOW // 2


class _Stretch:
    """A stretch whose windows come in order: their scores are averaged and handed to the path as soon as no later window adds to them."""

    def __init__(self, text: int, a: int, z: int, steps: np.ndarray):
        self.text, self.a, self.z, self.done = text, a, z, a
        self.left = max(1, -(-(z - a - HOP) // HOP))
        self.total, self.weight, self.path = np.zeros((WINDOW, len(TAGS))), np.zeros(WINDOW), Path(steps)

    def windows(self, x: np.ndarray):
        for at in range(self.a, self.a + self.left * HOP, HOP):
            p = np.zeros(WINDOW, np.int64)
            part = x[at : min(self.z, at + WINDOW)]
            p[: len(part)] = part
            yield p

    def take(self, scores: np.ndarray) -> bool:
        """Add the next window's scores; True when it was the last one."""
        self.total += scores * _WEIGHT[:, None]
        self.weight += _WEIGHT
        self.left -= 1
        n = HOP if self.left else self.z - self.done
        self.path.add(self.total[:n] / self.weight[:n, None])
        self.done += n
        self.total = np.concatenate([self.total[HOP:], np.zeros((WINDOW - HOP, len(TAGS)))])
        self.weight = np.concatenate([self.weight[HOP:], np.zeros(WINDOW - HOP)])
        return not self.left

    def spans(self) -> list[tuple[str, int, int]]:
        tags, out, begin, kind = self.path.tags(), [], -1, -1
        some = np.flatnonzero(tags)
        if not len(some):
            return out
        for i, tag in enumerate([*tags[some[0] :].tolist(), 0], int(some[0])):
            if not (tag > 0 and tag % 2 == 0 and (tag - 1) // 2 == kind):
                if begin >= 0:
                    out.append((KINDS[kind], self.a + begin, self.a + i))
                begin, kind = (i, (tag - 1) // 2) if tag > 0 else (-1, -1)
        return out


def tag_texts(tagger: Tagger, texts: list[str], most: int = 1024) -> list[list[tuple[str, int, int]]]:
    """Spans of the model alone. Windows of all texts are run together, `most` at a time; each stretch is decoded as one."""
    owners, held, out = [], [], [[] for _ in texts]

    def solve():
        if held:
            for owner, scores in zip(owners, tagger.scores(np.array(held)), strict=True):
                if owner.take(scores):
                    out[owner.text] += owner.spans()
        owners.clear()
        held.clear()

    for n, text in enumerate(texts):
        x = None
        for a, z in stretches(text):
            x = classes(text) if x is None else x
            stretch = _Stretch(n, a, z, tagger.w["steps"])
            for p in stretch.windows(x):
                owners.append(stretch)
                held.append(p)
                if len(held) >= most:
                    solve()
    solve()
    return out


def all_spans(texts: list[str], tagger: Tagger) -> list[tuple[list, list]]:
    """For each text the patterns' spans, and all spans; both by kind as listed, then start."""
    out = []
    for text, added in zip(texts, tag_texts(tagger, texts), strict=True):
        base = base_spans(text)
        given, at, end, more = sorted((a, z) for _, a, z in base), 0, 0, []  # end: of all spans taken so far that begin before this one
        for kind, a, z in sorted(added, key=lambda s: s[1]):
            while a < z and text[a] in " \n(),:;." and not (kind == "phone" and text[a] == "("):
                a += 1
            while z > a and text[z - 1] in " \n(),:;.-":
                z -= 1
            while at < len(given) and given[at][0] < z:
                end = max(end, given[at][1])
                at += 1
            if a < z and a >= end and valid(kind, text[a:z]):
                more.append((kind, a, z))
                end = z
        order = lambda s: (KINDS.index(s[0]), s[1])
        out.append((sorted(base, key=order), sorted(base + more, key=order)))
    return out


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{z}" for k, a, z in spans)


def find_personal_data(documents: DataFrame, tagger: Tagger) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) per row; counts and digest are of the patterns' spans, `spans` lists all."""
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

    def run(batches):
        for b in batches:
            got = all_spans([t or "" for t in b.column(1).to_pylist()], tagger)
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in got], pa.int64()) for k in KINDS]
            yield pa.record_batch([b.column(0), *counts, pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in got], pa.string()), pa.array([written(every) for _, every in got], pa.string())], names=[c.split()[0] for c in schema.split(", ")])

    return ensure_columns(documents, doc_id="long", text="string").mapInArrow(run, schema)


def redact(documents: DataFrame, tagger: Tagger) -> DataFrame:
    """The same rows and columns, with every span of the text replaced by its kind in angle brackets."""
    column, schema = documents.columns.index("text"), documents.schema

    def run(batches):
        for b in batches:
            texts = b.column(column).to_pylist()
            out = []
            for text, (_, spans) in zip(texts, all_spans([t or "" for t in texts], tagger), strict=True):
                end = len(text or "") + 1
                for kind, a, z in sorted(spans, key=lambda s: -s[1]):
                    if z <= end:
                        text = f"{text[:a]}<{kind}>{text[z:]}"
                        end = a
                out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if i == column else c for i, c in enumerate(b.columns)], names=b.schema.names)

    return documents.mapInArrow(run, schema)
