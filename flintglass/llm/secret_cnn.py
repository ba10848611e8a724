"""Secret scan by a character convolutional network.

Base rules (assignments, access keys, hex runs) always give spans. Candidates are the runs of 12 or more key characters
with a letter, whether or not base spans touch them; a network of numpy (embedding, convolution, max pooling, dense) reads each
whole candidate in windows, every window with the characters before and after it. It is trained on labelled findings:
all base rules' findings and other runs of the whole table, and the written forms below, a part of each
with its surroundings blanked out, so that the value's own shape counts too. Findings that are equal with their surroundings
count once, however many rows hold them. They are dealt by a hash to shards; each epoch trains on every shard from the
same weights and goes on with their mean, summed in whole numbers, so that the result doesn't depend on the partitions.

Temperature and threshold are calibrated on all findings of the held-out texts, a fourth of them, by a candidate's highest
window, as in scanning. The threshold is the highest (in steps of 1 / STEPS of a score) that keeps a recall of MIN_RECALL
there, whatever clean runs score. Candidates at or above it that reach beyond the base spans are added as kind `cnn`.

Defined results: null text = empty text; one row for each input row; without both kinds of labels nothing is added;
an added span may hold base spans, but never lies inside them; repeated rows give equal rows; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import cut, groups, slices

#: About so many rows of findings make a shard; a row holds at most so many windows of a finding, a longer one has more rows.
SHARD, ROW_WINDOWS = 8_000, 8
EPOCHS, SEED = 10, 7
MIN_RECALL = 0.98
#: Whole numbers to which weights are summed, and to which scores (up to HIGHEST on both sides) are counted.
FIXED, STEPS, HIGHEST = 2.0**36, 1_024, 150.0
BEFORE, INSIDE, AFTER = 24, 48, 16
WINDOW = BEFORE + INSIDE + AFTER
WIDTH, EMBED, FILTERS = 5, 8, 16
#: The windows of the convolution that only see what stands before, that touch the candidate, and the others.
PARTS = (0, BEFORE - WIDTH + 1, BEFORE + INSIDE, WINDOW - WIDTH + 1)
ALPHABET = 98
#: Windows scored at a time, in parts that stay in a core's cache; characters of texts scanned together.
BLOCK, CACHED, GROUP_CHARS = 2_048, 128, 500_000

# The base patterns; ASCII case folding only in the names.
ASSIGN = re.compile(r"(?i:(?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KEY_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-"
KEY_RUN = 12
_LETTER = re.compile(r"[A-Za-z]")
_NAMES = (b"passw", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex")
#: Codes of the characters up to 127, which stands for all later ones too; 1 for the codes of key characters.
_CODES = bytes([0, *[96] * 31, *range(1, 96), 97, *[0] * 128])
_KEY = bytes(int(0 < c < 96 and chr(c + 31) in KEY_CHARS) for c in range(256))

# Written forms of secrets and of clean runs. {b:n} stands for n letters and digits, {s:n} also for + and /,
# {d:n} for digits, {u:n} for capitals and digits, {w} for a word, {W} for a capitalised one, {e} for one of
# WORDS, {f} for one in small letters.
WORDS = "Request Response Handler Manager Service Context Builder Stream Buffer Listener Adapter Transaction Configuration Exception Iterator Template Resolver Strategy Descriptor Scheduler".split()
SECRETS = """
Authorization: Bearer {b:40}
Authorization: Basic {s:32}==
aws_secret_access_key = {s:40}
GITHUB_PAT=ghp_{b:36}
xoxb-{d:12}-{b:24}
sk_live_{b:24}
the key AIza{b:35} of {w}
eyJ{b:30}.eyJ{b:40}.{b:42}
PRIVATE-TOKEN: glpat-{b:20}
{w} auth={b:20} {w}
credentials {b:16}
private_key {s:64}
sig={b:32}&{w}
https://{w}:{b:18}@{w}.example
{w} {b:28} {w}
{w} {s:44}= {w}
serial {u:24}
x-api-key {b:40} {w}
SG.{b:22}.{b:43}
npm_{b:36}
AccountKey {s:86}==
{w} = '{b:24}'
""".strip().split("\n")  # fmt: skip
CLEAN = """
see https://www.{w}.example/{w}/{w}-{d:3}.html
version {d:1}.{d:2}.{d:3}-{w}{d:1}
on {d:4}-{d:2}-{d:2}T{d:2}:{d:2}
/usr/lib/{w}{d:1}.{d:2}/{w}/{w}.py
{w} {w}_{w}_{w}{d:1} {w}
class {W}{W}{W} of
the {w}{w}{w}{w} of {w}
{w}-{w}-{w}-{w}
mail.{w}.{w}.example.com
{w} {w}{w}.{w}{d:2}.example
order {W}-{d:4}-{d:4}
{w} ....................... {d:2}
x================y
item_{d:4}_{w}.tar.gz
{w}/{w}/{w}/{w}
ISBN-{d:3}-{d:1}-{d:2}-{d:6}-{d:1}
{w}{w}{w}{w}.
{w}{d:2}@{w}{d:1}.{w}.example.com
{w} {W}{w}{w}{w}, {w}
+{d:2}/{d:3}/{d:7}-ext.{d:2}
class {e}{e}{e}{e} {w}
new {e}{e}{e}()
com.{w}.{w}.{e}{e}
{w}.{e}{e}{e}.{w}
the {e}{W}{e}Test of {w}
{e}_{e}_{e}_{d:2}
by {f}_{f}_{d:4}
{w} {f}_{w}_{d:4}, {w}
user {f}-{f}{d:2} {w}
{f}.{f}.{w} {d:4}
at {d:4}/{d:2}/{d:2} by {w}.{f}_{d:2}
""".strip().split("\n")  # fmt: skip
_SLOT = re.compile(r"\{(\w)(?::(\d+))?\}")
_LETTERS = {"b": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "d": "0123456789", "u": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"}
_LETTERS["s"] = _LETTERS["b"] + "+/"


def written_findings(each: int = 40, seed: int = 5, forms: list[tuple[str, bool]] | None = None) -> Iterator[tuple[str, int, int, bool]]:
    """(text, start, end, secret): the written forms filled at random; of a text the longest run is the finding."""
    rng = np.random.default_rng(seed)

    def fill(m: re.Match) -> str:
        if m[1] in "ef":
            word = WORDS[rng.integers(len(WORDS))]
            return word if m[1] == "e" else word.lower()
        if m[1] in "wW":
            word = "".join(rng.choice(list("bcdfghklmnprstvw")) + rng.choice(list("aeiou")) for _ in range(rng.integers(2, 5)))
            return word.capitalize() if m[1] == "W" else word
        return "".join(rng.choice(list(_LETTERS[m[1]]), int(m[2])))

    for form, secret in forms or [*((f, True) for f in SECRETS), *((f, False) for f in CLEAN)]:
        for _ in range(each):
            text = _SLOT.sub(fill, form)
            runs = key_runs(*codes_of([text]))[0]
            if runs:
                yield text, *max(runs, key=lambda r: r[1] - r[0]), secret


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts in one array with blanks (0) around each, and the place of each text in it."""
    gap = "\0" * max(BEFORE, AFTER)
    points = np.frombuffer((gap + gap.join(texts) + gap).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.frombuffer(np.minimum(points, 127).astype(np.uint8).tobytes().translate(_CODES), np.uint8)
    lengths = np.array([len(gap) + len(t) for t in texts], np.int64)
    return codes, len(gap) + np.cumsum(lengths) - lengths


def key_runs(codes: np.ndarray, place: np.ndarray) -> list[list[tuple[int, int]]]:
    """The runs of KEY_RUN or more key characters of each text: all values of base rules and all candidates lie in them."""
    inside = np.frombuffer(codes.tobytes().translate(_KEY), np.bool_)
    edges = (np.flatnonzero(inside[1:] != inside[:-1]) + 1).reshape(-1, 2)  # blanks stand around each text
    edges = edges[edges[:, 1] - edges[:, 0] >= KEY_RUN]
    found: list[list[tuple[int, int]]] = [[] for _ in place]
    text = np.searchsorted(place, edges[:, 0], "right") - 1
    for i, s, e in zip(text.tolist(), *(edges - place[text, None]).T.tolist(), strict=True):
        found[i].append((s, e))
    return found


def base_findings(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) by start, then kind; of a text and its key runs."""
    found = []
    if runs:
        low = text.encode("utf-8", "surrogatepass").lower()
        if any(name in low for name in _NAMES):
            found += [(m.start(), 0, m.end(), m.start(1)) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    for s, e in runs:
        if "AKIA" in text[s:e]:
            found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text, s, e) if m.end() - m.start() >= 18]
        found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text, s, e)]
    return sorted(found)


def candidates(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """All key runs with a letter."""
    return [r for r in runs if _LETTER.search(text, *r)]


def uncovered(spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(characters outside the base spans, characters of them inside) of each of the spans, which do not overlap."""
    found, i, joined = [], 0, []
    for s, _, e in base:
        if joined and s <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], e)
        else:
            joined.append([s, e])
    for s, e in spans:
        while i < len(joined) and joined[i][1] <= s:
            i += 1
        k, inside = i, 0
        while k < len(joined) and joined[k][0] < e:
            inside += min(e, joined[k][1]) - max(s, joined[k][0])
            k += 1
        found.append((e - s - inside, inside))
    return found


def window_starts(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, candidate) of every window of the candidates."""
    n = np.maximum(1, -(-(ends - starts) // INSIDE))
    owner = np.repeat(np.arange(len(n)), n)
    at = starts[owner] + INSIDE * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    return at, np.minimum(at + INSIDE, ends[owner]), owner


def windows(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Codes of windows: the characters before, the candidate's own (padded with 0) and the characters after."""
    place = np.arange(WINDOW) - BEFORE
    at = starts[:, None] + place
    late = place >= INSIDE
    at[:, late] = ends[:, None] + (place[late] - INSIDE)
    out = codes[np.minimum(at, len(codes) - 1)]
    out[:, ~late & (place >= 0)] *= (at < ends[:, None])[:, ~late & (place >= 0)]
    return out


def convolved(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Sums of the tables' rows by place, window and filter: what is pooled stands in whole blocks."""
    at = codes.T.astype(np.intp, order="C")
    steps = len(at) - WIDTH + 1
    h = tables[0].take(at[:steps], axis=0)
    more = np.empty_like(h)
    for i in range(1, WIDTH):
        h += tables[i].take(at[i : i + steps], axis=0, out=more, mode="clip")
    return h


@dataclass
class Network:
    """Weights, temperature and threshold; `threshold` None adds nothing."""

    embed: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: np.ndarray
    temperature: float = 1.0
    threshold: float | None = None
    tables: np.ndarray | None = None

    def layers(self) -> np.ndarray:
        """Tables of the convolution by place and code."""
        return np.stack([self.embed @ self.conv[i * EMBED : (i + 1) * EMBED] for i in range(WIDTH)]).astype(np.float32)

    def forward(self, codes: np.ndarray) -> tuple[np.ndarray, ...]:
        tables = self.layers()
        h = convolved(tables, codes)
        h += self.bias.astype(np.float32)
        # the candidate and its surroundings are pooled apart, so that the network knows where a pattern stands
        where, pooled = np.empty((len(codes), 3, FILTERS), np.intp), np.empty((len(codes), 3, FILTERS))
        for k, (lo, hi) in enumerate(zip(PARTS, PARTS[1:], strict=False)):
            top = h[lo:hi].max(0)
            left = (h[lo:hi] == top).view(np.uint8) * np.arange(hi - lo, 0, -1, dtype=np.uint8)[:, None, None]
            where[:, k] = hi - left.max(0).astype(np.intp)  # the first place of the highest value
            pooled[:, k] = np.maximum(top, 0)
        pooled = pooled.reshape(len(codes), -1)
        return tables, where, pooled, pooled @ self.out + self.shift

    def ready(self) -> Network:
        """Tables of the convolution, for scoring."""
        self.tables = self.layers()
        return self

    def score(self, codes: np.ndarray) -> np.ndarray:
        pooled = np.empty((len(codes), 3 * FILTERS), np.float32)
        for lo in range(0, len(codes), CACHED):
            h = convolved(self.tables, codes[lo : lo + CACHED])
            for k, (a, b) in enumerate(zip(PARTS, PARTS[1:], strict=False)):
                pooled[lo : lo + CACHED, k * FILTERS : (k + 1) * FILTERS] = h[a:b].max(0)
        return np.maximum(pooled + np.tile(self.bias, 3), 0) @ self.out + self.shift

    def probability(self, scores: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(scores / self.temperature, -30, 30)))

    def best(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The highest probability of each candidate's windows, scored in blocks of bounded size."""
        at, until, owner = window_starts(starts, ends)
        best = np.full(len(starts), -np.inf)
        for lo in range(0, len(at), BLOCK):
            part = slice(lo, lo + BLOCK)
            np.maximum.at(best, owner[part], self.score(windows(codes, at[part], until[part])))
        return self.probability(best)


#: The trained arrays.
SHAPES = {"embed": (ALPHABET, EMBED), "conv": (WIDTH * EMBED, FILTERS), "bias": (FILTERS,), "out": (3 * FILTERS,), "shift": ()}


class Training:
    """A network and the moments of Adam on weighted cross-entropy. Each epoch takes the surroundings of other windows away."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        start = (rng.normal(0, 0.3, SHAPES["embed"]), rng.normal(0, 0.2, SHAPES["conv"]), np.zeros(FILTERS), rng.normal(0, 0.2, SHAPES["out"]), 0.0)
        value = np.concatenate([np.ravel(x) for x in start])
        self.hold(value, np.zeros(len(value)), np.zeros(len(value)), 0.0)

    def hold(self, value: np.ndarray, first: np.ndarray, second: np.ndarray, step: float) -> None:
        """All weights stand in one array, which the network's own arrays are parts of, and so do both moments."""
        self.value, self.first, self.second, self.step = value, first, second, step
        ends = np.cumsum([int(np.prod(shape)) for shape in SHAPES.values()])
        self.net = Network(*(part.reshape(shape) for part, shape in zip(np.split(value, ends[:-1]), SHAPES.values(), strict=True)))

    def epoch(self, codes: np.ndarray, y: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> Training:
        net, codes = self.net, blanked(codes, rng)
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            self.step += 1
            x = codes[part]
            _, where, pooled, z = net.forward(x)
            dz = weight[part] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)
            dpool = (dz[:, None] * net.out * (pooled > 0)).reshape(len(part), 3, FILTERS)
            grads = {"out": pooled.T @ dz, "shift": dz.sum(), "bias": dpool.sum((0, 1)), "conv": np.zeros_like(net.conv), "embed": np.zeros_like(net.embed)}
            # by place in the window, code and filter: summed by code and filter first
            at = x.ravel().take((np.arange(len(part)) * WINDOW)[:, None, None] + where + np.arange(WIDTH)[:, None, None, None]).astype(np.int64) * FILTERS
            at += np.arange(FILTERS) + (np.arange(WIDTH) * ALPHABET * FILTERS)[:, None, None, None]
            met = np.bincount(at.ravel(), np.tile(dpool.ravel(), WIDTH), WIDTH * ALPHABET * FILTERS).reshape(WIDTH, ALPHABET, FILTERS)
            for i in range(WIDTH):
                own = slice(i * EMBED, (i + 1) * EMBED)
                grads["conv"][own] = net.embed.T @ met[i]
                grads["embed"] += met[i] @ net.conv[own].T
            change = np.concatenate([np.ravel(grads[k]) for k in SHAPES])
            self.first, self.second = 0.9 * self.first + 0.1 * change, 0.999 * self.second + 0.001 * np.square(change)
            self.value -= 0.01 * (self.first / (1 - 0.9**self.step)) / (np.sqrt(self.second / (1 - 0.999**self.step)) + 1e-8)
        return self

    def packed(self) -> np.ndarray:
        return np.concatenate([self.value, self.first, np.sqrt(self.second), [self.step]])

    @classmethod
    def unpacked(cls, numbers: np.ndarray) -> Training:
        made = cls()
        value, first, second = numbers[:-1].reshape(3, -1)
        made.hold(value.copy(), first, np.square(second), float(numbers[-1]))
        return made


def blanked(codes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The windows, with the surroundings of some taken away."""
    codes = codes.copy()
    codes[np.ix_(rng.random(len(codes)) < 0.3, [*range(BEFORE), *range(BEFORE + INSIDE, WINDOW)])] = 0
    return codes


def class_weights(y: np.ndarray, share: float) -> np.ndarray:
    """Both labels weigh the same in sum, where `share` of the windows are secrets."""
    return np.where(y > 0, 0.5 / share, 0.5 / (1 - share))


def joined(findings: list[tuple[np.ndarray, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the findings, and 1.0 for those of secrets."""
    return np.concatenate([w for w, _ in findings]), np.repeat([float(s) for _, s in findings], [len(w) for w, _ in findings])


def train(findings: list[tuple[np.ndarray, bool, bool]], epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """findings: (windows, secret, held out), few enough for one machine."""
    made = Training(seed)
    known, held = [f[:2] for f in findings if not f[2]], [f[:2] for f in findings if f[2]]
    if len({y for _, y in known}) < 2 or len({y for _, y in held}) < 2:
        return made.net
    rng = np.random.default_rng(seed)
    codes, y = joined(known)
    weight = class_weights(y, y.mean())
    for _ in range(epochs):
        made.epoch(codes, y, weight, rng)
    net = made.net.ready()
    return calibrated(net, np.array([net.score(w).max() for w, _ in held]), np.array([s for _, s in held]), np.ones(len(held), np.int64))


def calibrated(net: Network, z: np.ndarray, t: np.ndarray, n: np.ndarray) -> Network:
    """Temperature and threshold by n findings each of score z and label t."""

    def loss(temperature: float) -> float:
        p = np.clip(1 / (1 + np.exp(-np.clip(z / temperature, -30, 30))), 1e-9, 1 - 1e-9)
        return float(-((t * np.log(p) + (1 - t) * np.log(1 - p)) * n).sum() / n.sum())

    net.temperature = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0), key=loss)
    net.threshold = threshold(net.probability(z[t]), n[t])
    return net


def threshold(secret: np.ndarray, n: np.ndarray | None = None) -> float:
    """The highest probability that at least MIN_RECALL of the secrets reach; n of each, or one."""
    order = np.argsort(secret)
    until = np.cumsum(np.ones(len(secret), np.int64) if n is None else n[order])
    return float(secret[order[np.searchsorted(until, int((1 - MIN_RECALL) * until[-1]), "right")]])


def labelled(texts: list[str]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray, list[bool]]]:
    """(text, first window, windows, long finding, secret) of the rows of all findings: every base finding's value and every run
    that no base span touches. A finding of more than ROW_WINDOWS windows has more rows, with a number other than 0 in
    common."""
    codes, place = codes_of(texts)
    spans: list[tuple[int, int, int, bool]] = []
    for i, (text, keys) in enumerate(zip(texts, key_runs(codes, place), strict=True)):
        base, runs = base_findings(text, keys), candidates(text, keys)
        spans += [(i, v, e, True) for _, _, e, v in base]
        spans += [(i, *r, False) for r, (_, inside) in zip(runs, uncovered(runs, [b[:3] for b in base]), strict=True) if not inside]
    if not spans:
        return
    text, start, end = (np.array([x[i] for x in spans], np.int64) for i in range(3))
    at, until, owner = window_starts(start + place[text], end + place[text])
    first = np.searchsorted(owner, owner)
    begins = np.flatnonzero((np.arange(len(owner)) - first) % ROW_WINDOWS == 0)
    of = owner[begins]
    long = np.zeros(len(spans), np.int64)
    for i in np.flatnonzero(end - start > ROW_WINDOWS * INSIDE):
        value = texts[text[i]][start[i] : end[i]].encode("utf-8", "surrogatepass")
        long[i] = int.from_bytes(hashlib.blake2b(value, digest_size=8).digest(), "little", signed=True) or 1
    ends = np.append(begins, len(owner))
    for lo in range(0, len(begins), BLOCK):  # windows of a bounded number of rows at a time
        hi = min(lo + BLOCK, len(begins))
        part = slice(begins[lo], ends[hi])
        yield text[of[lo:hi]], ends[lo : hi + 1] - ends[lo], windows(codes, at[part], until[part]), long[of[lo:hi]], np.array([spans[i][3] for i in of[lo:hi]])


def finding_rows(docs: DataFrame) -> DataFrame:
    """(codes, long, y, held): the windows of every finding of all texts, once each; a fourth of the texts is held out."""
    schema = pa.schema([("codes", pa.binary()), ("long", pa.int64()), ("y", pa.bool_()), ("held", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, held = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi in groups(texts, GROUP_CHARS):
                for text, begins, found, long, secret in labelled(texts[lo:hi]):
                    codes = pa.Array.from_buffers(pa.binary(), len(text), [None, pa.py_buffer((begins * WINDOW).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(found))])
                    yield pa.RecordBatch.from_arrays([codes, pa.array(long), pa.array(secret), pa.array(held[lo:hi][text])], schema=schema)

    held = (F.pmod(F.crc32("text"), F.lit(4)) == 0).alias("held")
    return docs.filter("text IS NOT NULL").select("text", held).mapInArrow(run, "codes binary, long long, y boolean, held boolean").distinct()


def epoch_over(shards: DataFrame, made: Training, written: list[tuple[np.ndarray, bool]], share: float, epoch: int) -> Training:
    """One epoch on each shard, and the mean of what they end with. A shard's rows stand together, in order."""
    numbers, more = made.packed(), joined(written)
    schema = pa.schema([("place", pa.int32()), ("value", pa.int64())])

    def learn(shard: int, rows: list[tuple[bytes, bool]]) -> pa.RecordBatch:
        codes = np.concatenate([np.frombuffer(b"".join(w for w, _ in rows), np.uint8).reshape(-1, WINDOW), more[0]])
        y = np.concatenate([np.repeat([float(s) for _, s in rows], [len(w) // WINDOW for w, _ in rows]), more[1]])
        ended = Training.unpacked(numbers).epoch(codes, y, class_weights(y, share), np.random.default_rng([SEED, shard, epoch])).packed()
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(ended), dtype=np.int32)), pa.array(np.rint(ended * FIXED).astype(np.int64))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows = None, []
        for batch in slices(batches):
            for own, codes, secret in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != shard and rows:
                    yield learn(shard, rows)
                    rows = []
                shard = own
                rows.append((codes, secret))
        if rows:
            yield learn(shard, rows)

    means = shards.mapInArrow(run, "place int, value long").groupBy("place").agg((F.sum("value") / F.count("*") / FIXED).alias("mean"))
    found = means.orderBy("place").collect()  # one row for each number of the network and its moments
    return Training.unpacked(np.array([r["mean"] for r in found]))


def fit(docs: DataFrame, shard: int = SHARD) -> Network:
    """Train and calibrate on the written forms and all findings of the table."""
    written = []
    for i, (text, s, e, secret) in enumerate(written_findings()):
        codes, place = codes_of([text])
        at, until, _ = window_starts(np.array([s]) + place[0], np.array([e]) + place[0])
        written.append((windows(codes, at, until), secret, i % 4 == 0))
    own, kept = [f[:2] for f in written if not f[2]], [f[:2] for f in written if f[2]]
    findings = cut(finding_rows(docs))
    counts = findings.filter("NOT held").groupBy("y").agg(F.count("*").alias("rows"), F.sum(F.length("codes") / WINDOW).alias("windows")).collect()
    n_shards = -(-sum(r.rows for r in counts) // shard)
    if not n_shards:
        return train(written)
    y = joined(own)[1]
    secret = sum(r.windows for r in counts if r.y) + n_shards * y.sum()
    share = secret / (sum(r.windows for r in counts) + n_shards * len(y))
    dealt = findings.filter("NOT held").select(F.pmod(F.xxhash64("codes"), F.lit(n_shards)).alias("shard"), "codes", "y", "long")
    shards = cut(dealt.repartition(n_shards, "shard").sortWithinPartitions("shard", F.xxhash64("codes"), "codes", "y", "long").drop("long"))
    made = Training()
    for epoch in range(EPOCHS):
        made = epoch_over(shards, made, own, share, epoch)
    net = made.net.ready()

    schema = pa.schema([("long", pa.int64()), ("y", pa.bool_()), ("z", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = batch.column(0).to_pylist()
            if found:
                n = np.array([len(w) // WINDOW for w in found])
                z = net.score(np.frombuffer(b"".join(found), np.uint8).reshape(-1, WINDOW))
                best = np.maximum.reduceat(z, np.cumsum(n) - n).astype(np.float64)
                yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(best)], schema=schema)

    scored = findings.filter("held").select("codes", "long", "y").mapInArrow(run, "long long, y boolean, z double")
    best = scored.filter("long = 0").select("y", "z").union(scored.filter("long <> 0").groupBy("long", "y").agg(F.max("z").alias("z")).select("y", "z"))
    step = F.floor(F.least(F.greatest("z", F.lit(-HIGHEST)), F.lit(HIGHEST)) * STEPS).alias("step")
    met = best.groupBy(step, "y").count().collect()  # at most 4 * HIGHEST * STEPS rows
    z = np.array([net.score(w).max() for w, _ in kept] + [r["step"] / STEPS for r in met])
    return calibrated(net, z, np.array([s for _, s in kept] + [r.y for r in met]), np.array([1] * len(kept) + [r["count"] for r in met]))


def scan_texts(texts: list[str | None], net: Network) -> Iterator[tuple[list[tuple[int, int, int]], list[tuple[int, int, float]]]]:
    """Base spans (start, kind, end) and added spans (start, end, probability) of each text."""
    group: list[str] = []
    size = 0
    for t in texts:
        group.append(t or "")
        size += len(group[-1])
        if size >= GROUP_CHARS:
            yield from _scan_group(group, net)
            group, size = [], 0
    yield from _scan_group(group, net)


def _scan_group(texts: list[str], net: Network) -> Iterator[tuple[list[tuple[int, int, int]], list[tuple[int, int, float]]]]:
    codes, place = codes_of(texts)
    runs = key_runs(codes, place)
    base = [[f[:3] for f in base_findings(t, r)] for t, r in zip(texts, runs, strict=True)]
    if net.threshold is None:
        yield from ((b, []) for b in base)
        return
    more = [candidates(t, r) for t, r in zip(texts, runs, strict=True)]
    flat = np.array([x for c in more for x in c], np.int64).reshape(-1, 2)
    shift = np.repeat(place, [len(c) for c in more])
    p = net.best(codes, flat[:, 0] + shift, flat[:, 1] + shift) if len(flat) else np.zeros(0)
    at = 0
    for b, c in zip(base, more, strict=True):
        yield b, [(s, e, float(x)) for (s, e), x, (outside, _) in zip(c, p[at : at + len(c)], uncovered(c, b), strict=True) if x >= net.threshold and outside]
        at += len(c)


def scan_text(text: str | None, net: Network) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, float]]]:
    return next(scan_texts([text], net))


def spans_text(base: list[tuple[int, int, int]], added: list[tuple[int, int, float]]) -> str:
    every = [(s, k, KINDS[k], e) for s, k, e in base] + [(s, len(KINDS), "cnn", e) for s, e, _ in added]
    return ",".join(f"{kind}:{s}:{e}" for s, _, kind, e in sorted(every))


def redacted(text: str | None, base: list[tuple[int, int, int]], added: list[tuple[int, int, float]], mark: str = "[secret]") -> str | None:
    """The text with every found span replaced by the mark; overlapping spans are joined first."""
    if text is None or not (base or added):
        return text
    parts, at = [], 0
    for s, e in sorted([(s, e) for s, _, e in base] + [(s, e) for s, e, _ in added]):
        if s >= at:
            parts += [text[at:s], mark]
        at = max(at, e)
    return "".join([*parts, text[at:]])


def report_row(base: list[tuple[int, int, int]], added: list[tuple[int, int, float]]) -> tuple:
    counts = [sum(k == i for _, k, _ in base) for i in range(3)]
    digest = hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest()
    return (*counts, digest, spans_text(base, added), max((p for *_, p in added), default=0.0))


def report(docs: DataFrame, net: Network) -> DataFrame:
    """Counts and digest of the base spans, all spans and the highest probability of an added one, of each row."""
    fields = [("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("score", pa.float64())]
    schema = pa.schema([("doc_id", pa.int64()), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [report_row(*found) for found in scan_texts(batch.column(1).to_pylist(), net)]
            cols = list(zip(*rows, strict=True)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True))], schema=schema)

    ddl = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, score double"
    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(run, ddl)
