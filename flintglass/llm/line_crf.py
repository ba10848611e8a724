"""Quality rules by line labelling.

A linear-chain conditional random field with two states (content, boilerplate) runs over the lines of a text that have
a word; Viterbi decoding marks each line, and the share of words in content lines decides whether the document stays.
The field is fitted on a bounded sample of labelled documents (about `MAX_LABELLED`, `MAX_RUNS` runs of their lines):
every line starts with its document's quality as label, and lines of bad documents that the field itself finds to be
content are relabelled twice. The share that a document needs is chosen on a fourth of the sample that was held out.

Defined results: null text = text without words (all counts 0, content share 0, base_failed true, kept false); a
repeated doc_id gives one row for each input row; without labels no line is boilerplate and the base rule decides;
extra columns of the input are ignored unless named in `keep`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import WordHasher, blank_words, cut, hash_below, per_row, shingle_hashes, slices

#: About so many labelled documents are drawn, with a hash of their id; a fourth of them is held out.
MAX_LABELLED = 2000
#: Lines of a training run, and the most runs (N_FEATURES numbers a line) that reach the driver, drawn by a hash.
RUN, MAX_RUNS = 20, 3_000
#: Share of the good held-out documents that must stay.
KEEP_GOOD = 0.995
SYMBOLS = "#*$%&|<>"
N_FEATURES = 14
_SPACE = " \t\n\r\x0b\x0c"


@dataclass
class LineField:
    weights: np.ndarray
    transitions: np.ndarray
    share: float = 0.5


def line_features(lines: list[str]) -> np.ndarray:
    """One row of features for each line (all with at least one word)."""
    out = np.zeros((len(lines), N_FEATURES))
    seen: set[str] = set()
    for i, line in enumerate(lines):
        words = line.split()
        n = len(words) or 1
        chars = len(line)
        distinct = len(set(words))
        marks = sum(line.count(c) for c in SYMBOLS)
        capitals = sum(map(str.isupper, words))
        stops = line.count(".") + line.count(",") + line.count(";")
        equal = sum(a == b for a, b in zip(words, words[1:], strict=False))
        out[i] = (
            1.0, min(n, 400) ** 0.5 / 10, min(chars / n, 20) / 10, min(marks / n, 2), capitals / n, 1 - distinct / n, equal / n,
            min(line.count("!") / n, 2), line.count("|") / n, min(stops / n, 1), line[-1:] in ".?!\"'" and not line.endswith("!!"),
            n < 4, line in seen, min(sum(map(line.count, "0123456789")) / chars if chars else 0, 1),
        )
        seen.add(line)
    return out


def viterbi(scores: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Best state path; scores: content score of each line against 0 for boilerplate. Ties go to content."""
    n = len(scores)
    path = np.zeros(n, bool)
    if not n:
        return path
    (bb, bc), (cb, cc) = transitions.tolist()
    back, bad, good = [], 0.0, float(scores[0])
    for s in scores[1:].tolist():
        from_good_b, from_good_c = good + cb >= bad + bb, good + cc >= bad + bc
        back.append((from_good_b, from_good_c))
        bad, good = (good + cb if from_good_b else bad + bb), s + (good + cc if from_good_c else bad + bc)
    state = good >= bad
    path[-1] = state
    for i in range(n - 2, -1, -1):
        state = back[i][state]
        path[i] = state
    return path


def _posterior(x: np.ndarray, mask: np.ndarray, w: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over padded runs: P(content) of each line and P(state pair) of each step."""
    rows, length, _ = x.shape
    node = np.stack([np.zeros((rows, length)), x @ w], -1)
    fwd, bwd = np.zeros((rows, length, 2)), np.zeros((rows, length, 2))
    fwd[:, 0] = node[:, 0]
    for i in range(1, length):
        step = np.logaddexp(fwd[:, i - 1, 0, None] + t[0], fwd[:, i - 1, 1, None] + t[1]) + node[:, i]
        fwd[:, i] = np.where(mask[:, i, None], step, fwd[:, i - 1])
    for i in range(length - 2, -1, -1):
        after = node[:, i + 1] + bwd[:, i + 1]
        step = np.logaddexp(t[:, 0] + after[:, 0, None], t[:, 1] + after[:, 1, None])
        bwd[:, i] = np.where(mask[:, i + 1, None], step, 0)
    total = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
    p = np.exp(np.clip(fwd[:, :, 1] + bwd[:, :, 1] - total[:, None], -50, 0)) * mask
    pair = np.exp(np.clip(fwd[:, :-1, :, None] + t + (node + bwd)[:, 1:, None, :] - total[:, None, None, None], -50, 0))
    return p, pair * mask[:, 1:, None, None]


def fit_field(docs: list[tuple[np.ndarray, int]], steps: int = 80) -> LineField:
    """docs: (features of the lines, quality 0/1). Maximum likelihood by Adam, with two rounds of relabelling."""
    runs = [(x[i : i + RUN], q) for x, q in docs for i in range(0, len(x), RUN)]
    if not runs or len({q for _, q in runs}) < 2:
        return LineField(np.eye(N_FEATURES)[0] * 5, np.zeros((2, 2)))
    length = max(len(x) for x, _ in runs)
    x, mask = np.zeros((len(runs), length, N_FEATURES)), np.zeros((len(runs), length), bool)
    y = np.zeros((len(runs), length))
    for i, (f, q) in enumerate(runs):
        x[i, : len(f)], mask[i, : len(f)], y[i, : len(f)] = f, True, q
    good = np.array([q for _, q in runs], bool)
    weight = np.where(good, 0.5 / good.mean(), 0.5 / (1 - good.mean()))[:, None]
    w, t = np.zeros(N_FEATURES), np.zeros((2, 2))
    for _ in range(3):
        moments = [np.zeros(N_FEATURES + 4), np.zeros(N_FEATURES + 4)]
        observed = np.stack([1 - y, y], -1)
        seen = observed[:, :-1, :, None] * observed[:, 1:, None, :] * mask[:, 1:, None, None]
        for step in range(1, steps + 1):
            p, pair = _posterior(x, mask, w, t)
            gw = np.einsum("rl,rlf->f", (y - p) * mask * weight, x) / mask.sum() - 1e-4 * w
            gt = ((seen - pair) * weight[:, :, None, None]).sum((0, 1)) / mask.sum() - 1e-3 * t
            g = np.concatenate([gw, gt.ravel()])
            moments[0] = 0.9 * moments[0] + 0.1 * g
            moments[1] = 0.999 * moments[1] + 0.001 * g * g
            move = 0.15 * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-8)
            w, t = w + move[:N_FEATURES], t + move[N_FEATURES:].reshape(2, 2)
        p, _ = _posterior(x, mask, w, t)
        y = np.where(good[:, None], 1.0, p > 0.5) * mask
    return LineField(w, t)


def content_share(lines: list[str], field: LineField, features: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    x = line_features(lines) if features is None else features
    path = viterbi(x @ field.weights, field.transitions)
    words = np.array([len(line.split()) or 1 for line in lines], float)
    return (float((words * path).sum() / words.sum()) if len(lines) else 0.0), path


def text_lines(text: str | None) -> list[str]:
    return [line for line in (text or "").split("\n") if line.strip(_SPACE)]


def drawn_texts(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, quality, text, held) of about `max_labelled` labelled documents, one row an id."""
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL")
    known = known.filter(hash_below("doc_id", max_labelled, known.count())).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    found = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # about max_labelled ids
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 0
    return cut(found.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).withColumn("held", held))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> LineField:
    """Fit the field on runs of lines, then choose the share on the held-out documents."""
    drawn = drawn_texts(docs, labels, max_labelled)
    schema = pa.schema([("doc_id", pa.int64()), ("run", pa.int32()), ("quality", pa.int32()), ("x", pa.list_(pa.float64()))])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 50):
            rows = []
            for doc_id, quality, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                x = line_features(text_lines(text))
                rows += [(doc_id, i, quality, x[i : i + RUN].ravel().tolist()) for i in range(0, len(x), RUN)]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    found = drawn.filter("NOT held").selectExpr("CAST(doc_id AS LONG) AS doc_id", "quality", "text").mapInArrow(runs, "doc_id long, run int, quality int, x array<double>")
    rows = found.orderBy(F.xxhash64("doc_id", "run"), "doc_id", "run").limit(MAX_RUNS).collect()  # RUN * N_FEATURES numbers a row at most
    field = fit_field([(np.array(r.x).reshape(-1, N_FEATURES), r.quality) for r in rows])

    measured = pa.schema([("quality", pa.int32()), ("share", pa.float64())])
    share = per_row(["text"], measured, lambda text: (content_share(text_lines(text), field)[0],), ["quality"])
    held = drawn.filter("held").select("quality", "text").mapInArrow(share, "quality int, share double").collect()  # two numbers a document
    good, bad = (np.array([r.share for r in held if r.quality == q]) for q in (1, 0))
    if len(good) and len(bad):
        grid = [s for s in np.linspace(0.05, 0.95, 19) if (good >= s).mean() >= KEEP_GOOD]
        field.share = float(max(grid, key=lambda s: ((bad < s).mean(), -abs(s - 0.5)), default=0.05))
    return field


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_content_lines long, content_share double"
_FIELDS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("n_content_lines", pa.int64()), ("content_share", pa.float64())]


def describe(text: str | None, field: LineField, hasher: WordHasher) -> tuple:
    text = text or ""
    words = blank_words(text)
    n = len(words)
    lines = text_lines(text)
    repeated = 0
    if n >= 3:
        _, inverse, counts = np.unique(shingle_hashes(hasher.array(words), 3), return_inverse=True, return_counts=True)
        if len(counts) < n - 2:
            twice = counts[inverse] > 1
            covered = np.zeros(n, bool)
            for i in range(3):
                covered[i : n - 2 + i] |= twice
            repeated = int(covered.sum())
    failed = n < 50 or 100 * repeated > 50 * n
    share, path = content_share(lines, field)
    return (
        n, len(text) - sum(map(text.count, _SPACE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated,
        failed, not failed and share >= field.share, int(path.sum()), share,
    )


def score_documents(docs: DataFrame, field: LineField, keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """`keep` columns (doc_id by default) and the measures of each text, named with `prefix`."""
    keep = ["doc_id"] if keep is None else keep
    hasher = WordHasher()
    docs = docs.select(*dict.fromkeys([*keep, "text"]))
    arrow = docs.select(*keep).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = pa.schema([*to_arrow_schema(arrow), *[(prefix + k, v) for k, v in _FIELDS]])
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in arrow), *(prefix + c for c in COLUMNS.split(", "))])
    return docs.mapInArrow(per_row(["text"], schema, lambda text: describe(text, field, hasher), keep), ddl)
