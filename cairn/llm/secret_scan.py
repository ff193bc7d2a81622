"""Operator 8, secret scans: patterns, and a linear-chain conditional random field that tags what they miss.

Tokens are runs of [A-Za-z0-9+/_.=-]. The field tags each as the beginning of a secret, its inside, or outside, from the
token's shape (character classes, length, entropy), the neighbouring words and what stands between, and features of
the file; Viterbi decodes all tokens of a text as one chain. Scores of a token are kept, so that plain words cost a
lookup, and the chain is cut where the outside is best whatever stands beside it, which changes no result.

The field is fitted on whole documents of the corpus, tagged by the patterns, and on ``MADE`` sentences of a fixed seed
with secrets of other forms. A chain in which the patterns found a secret is learnt once more with what triggered the
pattern hidden (the words before it are other words of the text, and no sign stands between), so that the field must
know secrets by their shape and other neighbours. At most ``SAMPLE`` documents, half of them with a pattern's match, are
taken by the smallest hashes of their texts from ``POOL`` documents of the corpus (a documented bound on the rows that the
model is fitted on). The model has a fixed size and is sent to all tasks. Texts are scanned whole, without a shuffle.

Defined results: null and empty texts have no spans. Rows that repeat stay rows, each with its spans. Very long texts and
very long tokens are scanned like others. An empty table trains on the made sentences alone and gives an empty result.
``spans`` has the patterns' spans and those of the field that no base span touches; ``n_crf`` counts all that the field
tags, ``n_added`` those that it adds. Only the id and the text are read, so clashing names do no harm.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import LOWER, blocks, bounded_batches, column_bytes, words

# Fixed patterns, over bytes: they hold ASCII only, so letters match in either case of ASCII alone.
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
KINDS = ("assign", "access", "hex")
TRIGGERS = (b"password", b"passwd", b"secret", b"token", b"api")

LEAST, LONG = 8, 24
#: Characters of a token that is scored together with others.
SHORT = 24
#: Tokens whose scores a task keeps.
KNOWN = 200_000
SAMPLE, POOL, MADE, PASSES = 2_000, 40_000, 600, 6
#: What a text holds where a pattern may match; a filter before the sample.
WEAK = "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*+[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"
BITS = 16
OUT, BEGIN, INSIDE = 0, 1, 2
#: Score by which a begin must beat the outside: spans are added only where the field is sure.
SURE = 1.0

_TOKEN = np.zeros(256, dtype=bool)
for _r in (range(48, 58), range(65, 91), range(97, 123), map(ord, "+/_.=-")):
    _TOKEN[list(_r)] = True
#: Classes of characters by number, in the order of the characters that stand for them.
_CODE = np.zeros(256, dtype=np.int64)
_CODE[48:58], _CODE[65:91], _CODE[97:123] = 1, 2, 3
_CLASS = bytes(ord("0") if 48 <= b < 58 else ord("A") if 65 <= b < 91 else ord("a") if 97 <= b < 123 else ord("-") for b in range(256))


def base_spans(raw: bytes, low: bytes, long_hex: bool) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of the matches that hold. ``low`` is ``raw`` in lower case."""
    out = []
    if any(t in low for t in TRIGGERS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(raw) if m.end() - m.start() >= 20]
    if long_hex:
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(raw) if m.end() - m.start() >= 24]
    return sorted(out)


_IS_HEX = np.zeros(256, dtype=bool)
_IS_HEX[48:58] = _IS_HEX[97:103] = True


class Block:
    """Tokens, candidates and code points of a block of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        lo, hi = int(offsets[0]), int(offsets[-1])
        body = data[lo:hi]
        self.rows = offsets - lo
        self.raw, self.low = body.tobytes(), LOWER[body].tobytes()
        self.starts, self.ends, self.first = words(body, self.rows, _TOKEN)
        count = lambda mask: np.concatenate(([0], np.cumsum(mask)))
        digits, uppers = count((body >= 48) & (body < 58)), count((body >= 65) & (body < 91))
        size = self.ends - self.starts
        inner = np.minimum(self.starts + 1, self.ends)
        chance = (size >= LONG) | (digits[self.ends] > digits[self.starts]) | (uppers[self.ends] - uppers[inner] >= 2)
        self.candidate = chance & (size >= LEAST)
        self.points = count((body & 0xC0) != 0x80)
        h_start, h_end, h_first = words(body, self.rows, _IS_HEX)
        long_runs = np.flatnonzero(h_end - h_start >= 24)
        self.long_hex = np.zeros(len(offsets) - 1, dtype=bool)
        self.long_hex[np.searchsorted(self.rows, h_start[long_runs], side="right") - 1] = True

    def chains(self, r: int, place: random.Random) -> list[list[int]]:
        """Chains to learn from: candidates of row r and the tokens beside them, as token numbers; and where plain words
        stand, the longest of them and one by chance, each with the words beside it."""
        a, b = int(self.first[r]), int(self.first[r + 1])
        if a == b:
            return []
        near = np.convolve(self.candidate[a:b], np.ones(3), "same")[: b - a] > 0 if b - a > 2 else np.ones(b - a, dtype=bool)
        size = np.where(self.candidate[a:b], 0, (self.ends - self.starts)[a:b])
        for i in (int(size.argmax()), place.randrange(b - a)):
            near[max(0, i - 2) : i + 3] = True
        return [c.tolist() for c in runs(np.flatnonzero(near) + a)]

    def emissions(self, field: Field) -> np.ndarray:
        """The scores of all tokens of the block."""
        n, spots = len(self.starts), np.arange(len(self.starts))
        ids = np.array(field.known([self.raw[a:b] for a, b in zip(self.starts.tolist(), self.ends.tolist())]), dtype=np.int64)
        row = np.repeat(np.arange(len(self.rows) - 1), np.diff(self.first))
        a, none = self.starts, field.ids[b""]
        body = np.frombuffer(self.raw, dtype=np.uint8)
        count = lambda mask: np.concatenate(([0], np.cumsum(mask)))
        lo = np.maximum(self.rows[row], a - 3)
        inside = lambda mask: (lambda c: c[a] > c[lo])(count(mask))
        at, sign = inside(body == 64), inside((body == 61) | (body == 58))
        last = body[np.maximum(a - 1, 0)]
        quoted = (a > self.rows[row]) & ((last == 34) | (last == 39))
        v = field.table
        out = v[ids, 0:3] + np.where(at[:, None], v[ids, 15:18], v[ids, 12:15])
        for step, col in ((-1, 3), (-2, 6), (1, 9)):
            j = spots + step
            ok = (j >= self.first[row]) & (j < self.first[row + 1])
            out += v[np.where(ok, ids[np.clip(j, 0, max(n - 1, 0))], none), col : col + 3]
        gaps = np.array([field.score([f"g{x}{y}"]) for x in (False, True) for y in (False, True)])
        files = np.array([field.score(self.file_features(r)) if self.first[r + 1] > self.first[r] else np.zeros(3) for r in range(len(self.rows) - 1)])
        return out + gaps[sign * 2 + quoted] + files[row]

    def file_features(self, r: int) -> list[str]:
        a, b = int(self.rows[r]), int(self.rows[r + 1])
        text = self.raw[a:b]
        n = int(self.first[r + 1] - self.first[r])
        share = int(self.candidate[self.first[r] : self.first[r + 1]].sum()) / max(1, n)
        code = (text.count(b"{") + text.count(b";") + text.count(b"=")) / max(1, text.count(b" "))
        return [f"share{min(9, int(share * 40))}", f"code{min(5, int(code * 20))}", f"size{len(str(n))}"]

    def features(self, i: int, r: int, file: list[str], hidden: tuple[int, str, str] | None = None) -> np.ndarray:
        """Coordinates of the features of token i of row r; ``hidden`` says where its secret begins, and gives words that
        stand before that instead, without a sign."""
        a, b = int(self.starts[i]) if hidden is None else hidden[0], int(self.ends[i])
        first, last = int(self.first[r]), int(self.first[r + 1])
        t = self.raw[a:b]
        word = lambda j: _word(self.raw[int(self.starts[j]) : int(self.ends[j])]) if first <= j < last else "<>"
        gap = b" " if hidden else self.raw[max(int(self.rows[r]), a - 3) : a]
        before = hidden[1:] if hidden else (word(i - 1), word(i - 2))
        return _coordinates([
            *_own(t), f"d{'.' in t.decode()}{'@' in gap.decode('latin-1')}", f"p{before[0]}", f"q{before[1]}", f"f{word(i + 1)}",
            f"g{'=' in gap.decode('latin-1') or ':' in gap.decode('latin-1')}{gap[-1:] in (b'"', b'\x27')}", *file,
        ])


def runs(at: np.ndarray) -> list[np.ndarray]:
    """Runs of consecutive numbers."""
    return np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else []


def _word(t: bytes) -> str:
    return t.lower().decode()


def _halves(bits):
    """Whole half bits of an entropy, the same however it was summed."""
    return np.floor(np.round(np.asarray(bits) * 2, 9)).astype(np.int64)


def _own(t: bytes) -> list[str]:
    """Features of a token by itself."""
    classes = t.translate(_CLASS)
    shape = re.sub(rb"(.)\1+", rb"\1", classes)
    halves = int(_halves(-sum(c / len(t) * math.log2(c / len(t)) for c in Counter(t).values())))
    kinds = "".join(sorted(set(classes.decode())))
    changes = sum(x != y for x, y in zip(classes, classes[1:]))
    return [
        f"k{kinds}", f"k{kinds}l{min(len(t) // 4, 12)}", f"e{halves}", f"e{halves}k{kinds}", f"s{shape[:10].decode()}", f"c{min(changes, 12)}", f"n{min(len(t), 48)}",
        f"x{_IS_HEX[np.frombuffer(t, dtype=np.uint8)].all()}", f"h{t[:4].decode().lower()}",
    ]


def _coordinates(names: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(n.encode()) & ((1 << BITS) - 1) for n in names])


class Field:
    """Weights of the chain: one row of three scores for each coordinate, and transition scores."""

    def __init__(self):
        self.w = np.zeros((1 << BITS, 3))
        self.t = np.zeros((3, 3))
        self.t[OUT, INSIDE] = -50.0  # a secret begins with a begin
        self.ids, self.table = {}, np.zeros((1024, 18))
        self._g, self._gt = np.full((1 << BITS, 3), 1e-8), np.full((3, 3), 1e-8)

    def score(self, names: list[str]) -> np.ndarray:
        return self.w[_coordinates(names)].sum(axis=0)

    def known(self, tokens: list[bytes]) -> list[int]:
        """Rows of ``table`` of the tokens: the scores of each by itself, as a neighbour (before, two before, after), and by dots."""
        if len(self.ids) > KNOWN:
            self.ids = {}
        new = [t for t in {b"": 0, **dict.fromkeys(tokens)} if t not in self.ids]
        if new:
            first = len(self.ids)
            while first + len(new) > len(self.table):
                self.table = np.concatenate((self.table, np.zeros_like(self.table)))
            for i in range(0, len(new), 1 << 14):
                self.table[first + i : first + min(i + (1 << 14), len(new))] = self._scores(new[i : i + (1 << 14)])
            self.ids.update(zip(new, range(first, first + len(new))))
        return [self.ids[t] for t in tokens]

    def _scores(self, tokens: list[bytes]) -> np.ndarray:
        """The rows of ``table`` of new tokens; short ones all at once, feature by feature."""
        out = np.zeros((len(tokens), 18))
        mask = (1 << BITS) - 1
        low = [t.lower() or b"<>" for t in tokens]
        for col, name in ((3, b"p"), (6, b"q"), (9, b"f")):
            start = zlib.crc32(name)
            out[:, col : col + 3] = self.w[np.array([zlib.crc32(t, start) & mask for t in low])]
        dots = self.w[_coordinates([f"d{x}{y}" for x in (False, True) for y in (False, True)])]
        has_dot = np.array([b"." in t for t in tokens], dtype=np.int64)
        out[:, 12:15], out[:, 15:18] = dots[has_dot * 2], dots[has_dot * 2 + 1]
        size = np.array([len(t) for t in tokens])
        for k in np.flatnonzero(size > SHORT).tolist():
            out[k, :3] = self.score(_own(tokens[k]))
        at = np.flatnonzero((size > 0) & (size <= SHORT))
        if not len(at):
            return out
        n = size[at]
        inside = np.arange(SHORT) < n[:, None]
        text = np.zeros(inside.shape, dtype=np.uint8)
        text[inside] = np.frombuffer(b"".join([tokens[k] for k in at.tolist()]), dtype=np.uint8)
        kind = _CODE[text]
        kinds = np.bitwise_or.reduce(np.where(inside, 1 << kind, 0), axis=1)
        change = (kind[:, 1:] != kind[:, :-1]) & inside[:, 1:]
        changes = change.sum(axis=1)
        run = np.concatenate((np.zeros((len(at), 1), dtype=np.int64), np.cumsum(change, axis=1)), axis=1)
        head = np.concatenate((np.ones((len(at), 1), dtype=bool), change), axis=1) & (run < 10)
        shape = np.where(head, (kind + 1) * 5 ** np.minimum(run, 10), 0).sum(axis=1)
        count = ((text[:, :, None] == text[:, None, :]) & inside[:, None, :]).sum(axis=2)
        share = np.where(inside, count / n[:, None], 1.0)
        entropy = _halves(-np.where(inside, np.log2(share), 0.0).sum(axis=1) / n)
        is_hex = (_IS_HEX[text] | ~inside).all(axis=1)
        begin = np.ascontiguousarray(LOWER[text[:, :4]]).view("<u4")[:, 0]
        names = ["".join(c for i, c in enumerate("-0Aa") if k >> i & 1) for k in range(16)]

        def add(code, name) -> None:
            each, back = np.unique(code, return_inverse=True)
            out[at, :3] += self.w[_coordinates([name(int(x)) for x in each])][back]

        add(kinds, lambda x: f"k{names[x]}")
        add(kinds * 16 + np.minimum(n // 4, 12), lambda x: f"k{names[x >> 4]}l{x & 15}")
        add(entropy, lambda x: f"e{x}")
        add(entropy * 16 + kinds, lambda x: f"e{x >> 4}k{names[x & 15]}")
        add(shape, lambda x: "s" + "".join("-0Aa"[x // 5**i % 5 - 1] for i in range(10) if x // 5**i))
        add(np.minimum(changes, 12), lambda x: f"c{x}")
        add(np.minimum(n, 48), lambda x: f"n{x}")
        add(is_hex.astype(np.int64), lambda x: f"x{bool(x)}")
        add(begin, lambda x: "h" + x.to_bytes(4, "little").rstrip(b"\0").decode())
        return out

    def open(self, e: np.ndarray, sure: float = SURE) -> np.ndarray:
        """Which tokens may be other than outside on a best path. Where the outside leads by more than any change of
        transitions (and of the next tag from inside to begin) can cost, the outside is best: chains can be cut there."""
        t, tagged = self.t, [BEGIN, INSIDE]
        into = (t[:, tagged] - t[:, [OUT]]).max()
        leave = (t[tagged][:, [OUT, BEGIN]] - t[OUT, [OUT, BEGIN]]).max()
        turn = t[tagged, INSIDE].max() - t[OUT, BEGIN] + (t[INSIDE] - t[BEGIN]).max()
        following = np.append(e[1:, INSIDE] - e[1:, BEGIN], 0.0)[: len(e)]
        return e[:, OUT] + sure - e[:, tagged].max(axis=1) <= into + np.maximum(leave, turn + following)

    def emissions(self, chain: list[np.ndarray]) -> np.ndarray:
        return np.array([self.w[f].sum(axis=0) for f in chain])

    def expected(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """For a chain between outsides, by forward and backward sums: the chance of each tag of each token, the expected
        number of each transition, and the log of the sum over all paths."""
        n = len(e)
        forward, backward = np.empty((n, 3)), np.empty((n, 3))
        forward[0] = self.t[OUT] + e[0]
        for i in range(1, n):
            forward[i] = np.logaddexp.reduce(forward[i - 1][:, None] + self.t, axis=0) + e[i]
        backward[-1] = self.t[:, OUT]
        for i in range(n - 2, -1, -1):
            backward[i] = np.logaddexp.reduce(self.t + (e[i + 1] + backward[i + 1])[None, :], axis=1)
        z = np.logaddexp.reduce(forward[-1] + backward[-1])
        p = np.exp(forward + backward - z)
        steps = np.exp(forward[:-1, :, None] + self.t + (e[1:] + backward[1:])[:, None, :] - z).sum(axis=0)
        steps[OUT] += p[0]
        steps[:, OUT] += p[-1]
        return p, steps, z

    def learn(self, chain: list[np.ndarray], tags: list[int], rate: float = 0.2, decay: float = 1e-4) -> None:
        """One AdaGrad step on the log-likelihood; the chain stands between outsides."""
        p, gt, _ = self.expected(self.emissions(chain))
        for i, f in enumerate(chain):
            g = p[i].copy()
            g[tags[i]] -= 1
            g = g[None, :] + decay * self.w[f]
            self._g[f] += g * g
            self.w[f] -= rate * g / np.sqrt(self._g[f])
        path = [OUT, *tags, OUT]
        for x, y in zip(path, path[1:]):
            gt[x, y] -= 1
        gt[OUT, INSIDE] = 0
        self._gt += gt * gt
        self.t -= rate * gt / np.sqrt(self._gt)

    def decode(self, e: np.ndarray, sure: float = SURE) -> list[int]:
        """The best tags of a chain between outsides, by Viterbi."""
        n = len(e)
        e = e.copy()
        e[:, OUT] += sure
        best, back = self.t[OUT] + e[0], []
        for i in range(1, n):
            step = best[:, None] + self.t
            back.append(step.argmax(axis=0))
            best = step.max(axis=0) + e[i]
        tag = int((best + self.t[:, OUT]).argmax())
        out = [tag]
        for b in reversed(back):
            tag = int(b[tag])
            out.append(tag)
        return out[::-1]


def _made(seed: int = 5) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """Sentences with secrets of forms that the patterns miss, and look-alikes that are none."""
    r = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    mixed = letters + letters.upper() + "0123456789"
    some = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    vocabulary = [some(letters, r.randrange(2, 10)) for _ in range(400)]
    vocabulary += [w.title() for w in vocabulary[:60]] + [some("0123456789", r.randrange(1, 6)) for _ in range(30)] + [some(letters, 4) + "-" + some(letters, 5) for _ in range(20)]
    vocabulary += [".".join(some(letters, r.randrange(2, 5)).upper()) + "." for _ in range(20)] + [some(letters, r.randrange(2, 5)).upper() for _ in range(10)] + [w + "." for w in vocabulary[60:90]]
    secret = [
        lambda: ["ghp_" + some(mixed, 36)], lambda: ["sk-" + some(mixed, 40)], lambda: ["xoxb-" + some("0123456789", 11) + "-" + some(mixed, 24)],
        lambda: [some(mixed + "+/", 40)], lambda: ["eyJ" + some(mixed, 30) + "." + some(mixed, 40) + "." + some(mixed + "-_", 43)],
        lambda: [some(mixed + "+/", 64) for _ in range(r.randrange(2, 5))], lambda: ["AIza" + some(mixed + "-_", 35)], lambda: [some(mixed, r.randrange(16, 33))],
    ]
    short = [lambda: [some(letters, r.randrange(4, 8)) + some("0123456789", r.randrange(1, 4))], lambda: [some(letters, 1).upper() + some(mixed, r.randrange(4, 7))], lambda: [some(letters, r.randrange(14, 24))]]
    near = ["pwd", "login", "passphrase", "passcode"]
    lead = ["key", "credential", "bearer", "auth", "pwd", "private", "access", "login", "signature"]
    plain = [
        lambda: some("0123456789", r.randrange(8, 20)), lambda: f"{r.randrange(1990, 2030)}-{r.randrange(10, 13)}-{r.randrange(10, 29)}", lambda: ".".join(str(r.randrange(256)) for _ in range(4)),
        lambda: some(letters, 6) + "." + some(letters, 5) + "/" + some(letters, 7) + "/" + str(r.randrange(9999)), lambda: some(letters, r.randrange(24, 40)), lambda: some(letters, 5) + "-" + some(letters, 6) + "-" + str(r.randrange(99)),
        lambda: some(letters, 7).upper() + "-" + str(r.randrange(9999)), lambda: "mail" + str(r.randrange(99)) + ".example.com", lambda: "v" + str(r.randrange(9)) + "." + str(r.randrange(99)) + ".0-release", lambda: some(letters, 6).upper() + some(letters, 4).upper(),
        lambda: some(letters, 5).title() + some(letters, 5).title() + some(letters, 5).title(), lambda: some(letters, 4) + "_" + some(letters, 5) + str(r.randrange(9)),
    ]
    out = []
    for _ in range(MADE):
        text, spans = "", []
        for _ in range(r.randrange(1, 4)):
            text += " ".join(r.choice(vocabulary) for _ in range(r.randrange(1, 12))) + r.choice([" ", ".\n", ": "])
            if r.random() < 0.5:
                text += r.choice(lead) + r.choice([" ", ": ", "=", ' = "', " is "]) if r.random() < 0.8 else ""
                parts = r.choice(secret)()
                start = len(text)
                text += "\n".join(parts) + r.choice([" ", '" ', "\n"])
                spans.append((start, start + len("\n".join(parts))))
            elif r.random() < 0.3:  # short ones, and words, stand by a lead
                text += r.choice(near) + r.choice([" ", ": ", " is "])
                start = len(text)
                text += r.choice(short)()[0]
                spans.append((start, len(text)))
                text += r.choice([" ", "! ", "\n"])
            else:
                text += r.choice(plain)() + " "
        out.append((text.encode(), spans))
    return out


def _chains(marked: list[tuple[bytes, list | None]], seed: int = 3) -> list[tuple[list[np.ndarray], list[int]]]:
    """Chains to learn: features of each token, and tags. Texts without given spans are tagged by the patterns."""
    import pyarrow as pa

    out, order = [], random.Random(seed)
    data, offsets = column_bytes(pa.array([t for t, _ in marked], pa.large_binary()))
    for a, b in blocks(offsets):
        block = Block(data, offsets[a : b + 1])
        for r in range(b - a):
            lo, hi = int(block.rows[r]), int(block.rows[r + 1])
            spans = marked[a + r][1]
            weak, values = spans is None, []
            if weak:
                text = block.raw[lo:hi]
                spans = [(x, y) for x, _, y in base_spans(text, block.low[lo:hi], block.long_hex[r])]
                values = [m.start(2) if (m := ASSIGN.match(text, x, y)) else x for x, y in spans]
            file = block.file_features(r)
            first, last = int(block.first[r]), int(block.first[r + 1])
            for chain in block.chains(r, order) if weak else [list(range(first, last))] if last > first else []:
                tags, owner, before = [], [], None
                for i in chain:
                    s, e = int(block.starts[i]) - lo, int(block.ends[i]) - lo
                    k = next((n for n, (x, y) in enumerate(spans) if x < e and s < y and (not weak or block.candidate[i])), None)
                    tags.append(OUT if k is None else INSIDE if k == before else BEGIN)
                    owner.append(before := k)
                out.append(([block.features(i, r, file) for i in chain], tags))
                for i, k in zip(chain, owner):  # once more, without what the pattern saw
                    if weak and k is not None:
                        near = [order.randrange(first, last) for _ in range(2)]
                        near = [_word(block.raw[int(block.starts[j]) : int(block.ends[j])]) if not block.candidate[j] else "<>" for j in near]
                        out.append(([block.features(i, r, file, (max(int(block.starts[i]), lo + values[k]), *near))], [BEGIN]))
    return out


def train(texts: list[bytes], passes: int = PASSES) -> Field:
    """A field fitted on texts tagged by the patterns and on made sentences."""
    chains = _chains([(t, None) for t in texts] + _made())
    field, order = Field(), random.Random(3)
    for _ in range(passes):
        order.shuffle(chains)
        for c, tags in chains:
            field.learn(c, tags)
    return field


_MODEL: dict[str, Field] = {}


def _model(name: str, weights: tuple) -> Field:
    """The field of these weights; a worker keeps the last one, with the scores it knows, for its next task."""
    if name not in _MODEL:
        _MODEL.clear()
        _MODEL[name] = Field()
        _MODEL[name].w, _MODEL[name].t = weights
    return _MODEL[name]


def scan_block(data: np.ndarray, offsets: np.ndarray, field: Field) -> list[tuple[list, list, list]]:
    """For each row its base spans, the added ones and all of the field, as (start, kind, end) in code points; the field's have kind 3."""
    block = Block(data, offsets)
    scores = block.emissions(field)
    maybe = np.flatnonzero(field.open(scores))
    cuts = np.searchsorted(maybe, block.first)
    out = []
    for r in range(len(offsets) - 1):
        lo, hi = int(block.rows[r]), int(block.rows[r + 1])
        point = lambda p: int(block.points[p] - block.points[lo])
        base = base_spans(block.raw[lo:hi], block.low[lo:hi], block.long_hex[r])
        added: list[tuple[int, int, int]] = []
        for chain in runs(maybe[cuts[r] : cuts[r + 1]]):
            tags = field.decode(scores[chain])
            k = 0
            while k < len(chain):
                if tags[k] == OUT:
                    k += 1
                    continue
                j = k + 1
                while j < len(chain) and tags[j] == INSIDE:
                    j += 1
                added.append((int(block.starts[chain[k]]) - lo, 3, int(block.ends[chain[j - 1]]) - lo))
                k = j
        reach, i, fresh = 0, 0, []
        for s, kind, e in added:  # only what no base span touches
            while i < len(base) and base[i][0] < e:
                reach = max(reach, base[i][2])
                i += 1
            if reach <= s:
                fresh.append((s, kind, e))
        out.append(tuple([(point(lo + s), k, point(lo + e)) for s, k, e in x] for x in (base, fresh, added)))
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{(*KINDS, 'crf')[k]}:{s}:{e}" for s, k, e in sorted(spans))


def sample(docs: DataFrame, text_col: str = "text", most: int = SAMPLE, pool: int = POOL) -> list[bytes]:
    """At most ``most`` whole texts, half of them where a pattern may match, of about ``pool`` with the smallest hashes."""
    rows = docs.select(F.col(text_col).alias("t"))
    h, total, out = F.pmod(F.xxhash64("t"), F.lit(1 << 30)), docs.count(), []
    for weak, wide in ((True, pool), (False, 2 * most)):
        near = rows.withColumn("h", h).where(F.col("h") < int(min(1.0, wide / max(1, total)) * (1 << 30)))
        near = near.where(F.col("t").rlike(WEAK) if weak else F.col("t").rlike("[0-9]") & ~F.col("t").rlike(WEAK))
        out += [r.t.encode() for r in near.orderBy("h", "t").limit(most // 2).toLocalIterator()]
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_crf, n_added, found (structs of spans)."""
    import pyarrow as pa

    field = field or train(sample(docs, text_col))
    sent = docs.sparkSession.sparkContext.broadcast((field.w, field.t))
    name = hashlib.sha256(field.w.tobytes() + field.t.tobytes()).hexdigest()
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        model = _model(name, sent.value)
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            rows = [x for a, b in blocks(offsets) for x in scan_block(data, offsets[a : b + 1], model)]
            number = lambda k: pa.array([sum(s[1] == k for s in base) for base, _, _ in rows], pa.int64())
            found = [[{"kind": (*KINDS, "crf")[k], "start": s, "end": e} for s, k, e in sorted(base + more)] for base, more, _ in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), number(0), number(1), number(2), pa.array([hashlib.sha256(listed(b).encode()).hexdigest() for b, _, _ in rows], pa.string()), pa.array([listed(b + m) for b, m, _ in rows], pa.string()),
                 pa.array([len(f) for _, _, f in rows], pa.int64()), pa.array([len(m) for _, m, _ in rows], pa.int64()),
                 pa.array(found, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf", "n_added", "found"])

    return bounded_batches(d, run, f"doc_id {dict(d.dtypes)['doc_id']}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long, n_added long, found array<struct<kind:string,start:long,end:long>>")
