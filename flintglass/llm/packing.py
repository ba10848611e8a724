"""Best-fit packing of tokenised documents by bin completion with branch and bound.

A document's ids end with END_ID and are cut into pieces of at most `capacity`. Pieces are dealt by hash into packing
groups of about GROUP pieces, and each group is packed on its own: the largest piece opens a sequence, the undominated
fillings of its room are tried from the least waste on, and the search goes back over all sequences. A branch ends when
the waste so far shows that it cannot need fewer sequences than the best packing known; best-fit decreasing and a dive
that takes the fullest filling each time are the first incumbents, and a lower bound ends the search.

A group whose search ends within its budgets (FILL_NODES, NODES) has the fewest sequences possible; beyond, the best
packing found stands, with all its pieces. Groups of a dozen pieces are always solved.

Defined results: null text = empty text (one piece that holds END_ID alone); one document for each input row, also with
null or repeated ids (equal rows are dealt to different groups); an empty table gives no pieces; ties go to the row that
sorts first; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import cut

CAPACITY, END_ID = 4096, 1
#: Pieces of a packing group.
GROUP = 8_000
#: Nodes of the search for one filling in the two dives, and of the branch and bound over all sequences of a group.
FILL_NODES, NODES = (300, 3_000), 400_000
#: Of the search: sequences beside the wasteful ones, waste above one sequence (a part of it), nodes of a try, tries without gain.
TOGETHER, SPARE, TRY_NODES, TURNS = 24, 1, 10_000, 60
#: Waste of the first fillings that are made.
FIRST_WASTE = 8
#: Pre-tokens whose ids a Python worker remembers.
CACHE = 250_000
#: New pre-tokens encoded in one call.
JOINED = 4_000
#: Characters of the texts that are cut at a time.
GROUP_CHARS = 1_000_000

#: Fixed values of the tokenizer's pre-tokenization, here for ASCII and the letters of Latin-1, in lower case.
_LOWER = bytes(c + 32 if 65 <= c <= 90 or 0xC0 <= c <= 0xDE and c != 0xD7 else c for c in range(256))
_PRETOKEN = re.compile(rb"[a-z\xdf-\xf6\xf8-\xff]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\sa-z0-9\xdf-\xf6\xf8-\xff]+")
_KNOWN = bytes(c for c in range(256) if c < 0x80 or c >= 0xC0 and c not in (0xD7, 0xF7))
#: The settings of a vocabulary file for which these rules hold.
_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def cuts_alike(model) -> bool:
    """Whether a tokenizer cuts texts by the rules above and marks the end of each pre-token."""
    settings = json.loads(model.to_str())
    special = all(t["content"].startswith("<|") for t in settings["added_tokens"])
    return special and settings["model"].get("end_of_word_suffix") == "</w>" and all(settings[k] == v for k, v in _RULES.items())


def _groups(texts: list[str | None]) -> Iterator[list[str]]:
    """Runs of texts of about GROUP_CHARS characters."""
    group, size = [], 0
    for t in texts:
        group.append(t or "")
        size += len(group[-1])
        if size >= GROUP_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


class PretokenTokenizer:
    """ids of a text as little-endian bytes, equal to those of the whole text.

    The model encodes each pre-token (run of letters, digit, run of marks) by itself. Texts of ASCII and Latin-1 letters
    are therefore cut into pre-tokens, of which each is encoded once and remembered; other texts (those that might hold a
    special token, and all texts of a vocabulary file with other rules) are given to the model whole."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model, self.known = Tokenizer.from_file(path), {}
        self.cuts = cuts_alike(self.model)
        self.ends = np.zeros(self.model.get_vocab_size(), bool)
        for token, i in self.model.get_vocab().items():
            self.ends[i] = token.endswith("</w>")

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, missing: list[bytes]) -> None:
        """Each pre-token ends with a token that ends a word, so that a joined text falls apart there."""
        for lo in range(0, len(missing), JOINED):
            part = missing[lo : lo + JOINED]
            ids = self._encode(b" ".join(part).decode("latin-1"))
            cuts = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            if len(cuts) == len(part):
                data, marks = ids.tobytes(), [0, *cuts.tolist()]
                found = [data[x:y] for x, y in zip(marks, marks[1:], strict=False)]
            else:
                found = [self._encode(w.decode("latin-1")).tobytes() for w in part]
            self.known.update(zip(part, found, strict=True))

    def _pretokens(self, text: str) -> list[bytes] | None:
        if not self.cuts:
            return None
        try:
            data = text.encode("latin-1").translate(_LOWER)
        except UnicodeEncodeError:
            return None
        return None if data.translate(None, _KNOWN) or b"<|" in data else _PRETOKEN.findall(data)

    def ids(self, texts: list[str | None]) -> list[bytes]:
        out, end = [], np.uint32(END_ID).astype("<u4").tobytes()
        for group in _groups(texts):
            cut = [self._pretokens(t) for t in group]
            every = set().union(*(c for c in cut if c))
            new = every.difference(self.known)
            if new and len(self.known) + len(new) > CACHE:
                self.known, new = {}, every
            self._learn(list(new))
            ids_of = self.known.__getitem__
            out += [(self._encode(t).tobytes() if c is None else b"".join(map(ids_of, c))) + end for t, c in zip(group, cut, strict=True)]
        return out


@lru_cache(maxsize=1)
def worker_tokenizer(path: str) -> PretokenTokenizer:
    """One for all tasks of a Python worker."""
    return PretokenTokenizer(path)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece of every document."""
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    fields += [("ids", pa.list_(pa.int32()))] * with_ids
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = worker_tokenizer(tokenizer_path)
        for batch in batches:
            rows: list[tuple] = []
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo in range(0, len(texts), 500):
                for doc_id, data in zip(ids_of[lo : lo + 500], tokenizer.ids(texts[lo : lo + 500]), strict=True):
                    for k, at in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[at : at + 4 * capacity]
                        row = (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part))
                        rows.append((*row, np.frombuffer(part, "<i4").tolist()) if with_ids else row)
            cols = list(zip(*rows, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(run, ddl)


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of positions; each piece goes to the fullest bin that holds it."""
    bins: list[list[int]] = []
    open_bins: list[tuple[int, int]] = []  # (room, bin), sorted
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at = bisect_left(open_bins, (lengths[i], -1))
        if at < len(open_bins):
            room, b = open_bins.pop(at)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if room > lengths[i]:
            insort(open_bins, (room - lengths[i], b))
    return bins


def lower_bound(lengths: list[int], capacity: int) -> int:
    """Martello and Toth's L2: pieces that exclude each other, and what the smaller ones need beside them."""
    x = np.sort(np.array(lengths, np.int64))
    below = np.concatenate([[0], np.cumsum(x)])
    half = np.searchsorted(x, capacity // 2, "right")
    best = -(-int(below[-1]) // capacity)
    for k in np.unique(np.concatenate([[0], x[:half]])).tolist():
        large, least = np.searchsorted(x, capacity - k, "right"), np.searchsorted(x, k, "left")
        middle = max(0, large - half)
        room = middle * capacity - int(below[max(large, half)] - below[half])
        small = int(below[half] - below[min(least, half)])
        best = max(best, len(x) - int(max(large, half)) + middle + max(0, -(-(small - room) // capacity)))
    return best


class Pieces:
    """A multiset of lengths: the sizes present in rising order, and how many of each."""

    def __init__(self, lengths: list[int]):
        self.count: dict[int, int] = {}
        for v in lengths:
            self.count[v] = self.count.get(v, 0) + 1
        self.sizes = sorted(self.count)

    def take(self, v: int) -> int:
        self.count[v] -= 1
        if not self.count[v]:
            del self.count[v]
            del self.sizes[bisect_left(self.sizes, v)]
        return v

    def put(self, v: int) -> None:
        if v not in self.count:
            self.count[v] = 0
            insort(self.sizes, v)
        self.count[v] += 1


def fullest(room: int, left: Pieces, nodes: int) -> list[int]:
    """A filling of `room` with the least waste found, larger pieces first; at most about `nodes` steps. Equal pieces are
    taken in one step, so that the search is no deeper than the different lengths whose sum fits."""
    sizes, count = left.sizes, left.count
    best: list[tuple[int, int]] = []
    least, budget = room, nodes

    def descend(room: int, high: int, chosen: list[tuple[int, int]]) -> bool:
        nonlocal best, least, budget
        if room < least:
            best, least = chosen[:], room
        if room == 0:
            return True
        if high and room <= sizes[high - 1] and room in count:
            best, least = [*chosen, (room, 1)], 0
            return True
        at = bisect_right(sizes, room, 0, high) - 1
        while at >= 0 and budget > 0:
            v = sizes[at]
            most = min(count[v], room // v)
            for k in range(most, 0, -1):
                budget -= 1
                rest = room - k * v
                if k == most and rest and rest - least >= 7 * v:
                    return False  # a dive leaves the many small pieces to later sequences; the search below knows no such rule
                chosen.append((v, k))
                done = descend(rest, at, chosen)
                chosen.pop()
                if done:
                    return True
                if budget <= 0:
                    break
            at -= 1
        return False

    descend(room, len(sizes), [])
    return [v for v, k in best for _ in range(k)]


def dive(lengths: list[int], capacity: int, nodes: int) -> list[list[int]]:
    """Sequences (lists of lengths): the largest piece left opens one, which the fullest filling found completes."""
    left, bins = Pieces(lengths), []
    while left.sizes:
        members = [left.take(left.sizes[-1])]
        if members[0] < capacity:
            members += [left.take(v) for v in fullest(capacity - members[0], left, nodes)]
        bins.append(members)
    return bins


def dominated(filling: list[int], room: int, left: Pieces) -> bool:
    """Whether one piece left out could stand for some of the filling's pieces, being as large or larger, and still fit."""
    used: dict[int, int] = {}
    one, some, many = 1, 0, 0  # bit t: the empty set, sets of one piece, of more pieces have the sum t
    for v in filling:
        used[v] = used.get(v, 0) + 1
        many |= (some | many) << v
        some |= 1 << v
    sums, slack = one | some | many, room - sum(filling)
    for x in left.sizes[: bisect_right(left.sizes, room)]:
        if left.count[x] > used.get(x, 0):
            low = max(0, x - slack)
            if sums >> low & (1 << (x - low)) - 1 or many >> x & 1:
                return True
    return False


class OutOfNodes(Exception):
    pass


def fillings(room: int, left: Pieces, most_waste: int, spend, even: bool = False) -> Iterator[list[int]]:
    """Undominated fillings of `room` that waste no more than `most_waste`, one by one, from the least waste on. They are
    made for a range of wastes at a time, as the search asks for them; the empty one is among them. Of equal wastes the one
    with the largest pieces comes first or, if `even`, the one whose largest piece is smallest."""
    sizes, count = left.sizes[: bisect_right(left.sizes, room)], left.count
    below = [0]
    for v in sizes:
        below.append(below[-1] + v * count[v])
    low, high = 0, min(most_waste, FIRST_WASTE)
    while low <= most_waste:
        found: list[list[int]] = []
        waiting = [(room, len(sizes), ())]
        while waiting:
            rest, top, chosen = waiting.pop()
            spend()
            if low <= rest <= high:
                found.append([v for v, k in chosen for _ in range(k)])
            for at in range(bisect_right(sizes, rest, 0, top) - 1, -1, -1):
                if rest - below[at + 1] > high:
                    break
                v = sizes[at]
                waiting += [(rest - k * v, at, (*chosen, (v, k))) for k in range(1, min(count[v], rest // v) + 1)]
        for filling in sorted(found, key=lambda f: (-sum(f), [v if even else -v for v in f])):
            if not dominated(filling, room, left):
                yield filling
        low, high = high + 1, min(most_waste, 4 * high + 3)


def branch_and_bound(lengths: list[int], capacity: int, best: list[list[int]], bound: int, nodes: int, even: bool = False) -> tuple[list[list[int]], bool, int]:
    """The best packing found, as lists of lengths, whether it is proved to need the fewest sequences, and the nodes left."""
    left, total, budget = Pieces(lengths), sum(lengths), nodes

    def spend() -> None:
        nonlocal budget
        budget -= 1
        if budget < 0:
            raise OutOfNodes

    def opened(waste: int) -> list:
        """[largest piece, its fillings to come, the one in use, waste before]."""
        largest = left.take(left.sizes[-1])
        allowed = (len(best) - 1) * capacity - total - waste
        return [largest, fillings(capacity - largest, left, allowed, spend, even), None, waste]

    try:
        path = [opened(0)]
        while path:
            largest, options, used, waste = frame = path[-1]
            for v in used or ():
                left.put(v)
            frame[2] = None
            filling = next(options, None)
            more = waste + capacity - largest - sum(filling or ())
            if filling is None or -(-(total + more) // capacity) >= len(best):  # later fillings waste no less
                left.put(largest)
                path.pop()
                continue
            for v in filling:
                left.take(v)
            frame[2] = filling
            if left.sizes:
                path.append(opened(more))
            elif len(path) < len(best):
                best = [[f[0], *f[2]] for f in path]
                if len(best) <= bound:
                    return best, True, budget
    except OutOfNodes:
        return best, False, 0
    return best, True, budget


def searched(bins: list[list[int]], capacity: int, bound: int, nodes: int) -> list[list[int]]:
    """Fewer sequences where branch and bound finds them. It takes the most wasteful sequences, as many as waste one
    sequence and a part of another between them, and TOGETHER others beside them apart and packs their pieces anew; what it
    finds takes their place. A group of few sequences is searched as a whole, and an end of that search proves it."""
    bins = sorted(bins, key=sum)
    turn = 0
    while len(bins) > bound and nodes > 0 and turn < TURNS:
        waste = many = 0
        while many < len(bins) and waste < capacity + capacity // SPARE:
            waste += capacity - sum(bins[many])
            many += 1
        if waste < capacity:
            break  # no sequence can go
        others = range(many + turn % max(1, (len(bins) - many) // TOGETHER), len(bins), max(1, (len(bins) - many) // TOGETHER))
        picked = [*range(many), *others]
        apart = [bins[i] for i in picked]
        pieces = [v for b in apart for v in b]
        found, ended, left = branch_and_bound(pieces, capacity, apart, lower_bound(pieces, capacity), min(nodes, TRY_NODES), even=turn % 2 == 0)
        nodes -= min(nodes, TRY_NODES) - left
        if len(found) < len(apart):
            out = set(picked)
            bins = sorted([*(b for i, b in enumerate(bins) if i not in out), *found], key=sum)
            turn = 0
        elif ended and len(picked) == len(bins):
            break  # proved
        else:
            turn += 1
    return bins


def pack_lengths(lengths: list[int], capacity: int = CAPACITY, nodes: int = NODES) -> list[list[int]]:
    """Sequences as lists of positions."""
    if not lengths:
        return []
    bound = lower_bound(lengths, capacity)
    best = [[lengths[i] for i in b] for b in best_fit_decreasing(lengths, capacity)]
    for n in FILL_NODES:
        if len(best) > bound:
            best = min(best, dive(lengths, capacity, n), key=len)
    if len(best) > bound:
        best = searched(best, capacity, bound, nodes)
    waiting: dict[int, list[int]] = {}
    for i in range(len(lengths) - 1, -1, -1):
        waiting.setdefault(lengths[i], []).append(i)
    return [[waiting[v].pop() for v in b] for b in best]


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to the pieces."""
    parts = cut(parts)  # row numbers of a written table are the same in every attempt of a task
    groups = max(1, -(-parts.count() // GROUP))
    dealt = parts.withColumn("_group", F.pmod(F.xxhash64(*parts.columns[:5], F.monotonically_increasing_id()), F.lit(groups)))

    def run(table: pa.Table) -> pa.Table:
        group = table.column("_group")[0].as_py()
        # a fixed order, so that a recomputed task gives the same packing
        table = table.sort_by([(c, "ascending") for c in ("length", "doc_id", "piece", "ids_crc32")])
        lengths = table.column("length").to_pylist()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for b, members in enumerate(pack_lengths(lengths, capacity)):
            at = 0
            for i in members:
                sequence[i], offset[i] = (group << 32) + b, at
                at += lengths[i]
        return table.drop_columns(["_group"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return dealt.groupBy("_group").applyInArrow(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema), "sequence_id long", "offset long"]))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    return pack(pieces(docs, tokenizer_path, capacity, with_ids), capacity)
