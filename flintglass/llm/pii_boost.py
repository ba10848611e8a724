"""Personal data by boosted candidates, in DataFrame expressions only.

Base rules (e-mail, IPv4, card, phone) always give spans. High-recall generators propose further, overlapping spans;
each gets a code of format and context features. Boosted depth-2 trees are fitted on counts of (code, label, fold): of
the candidates of all documents, positive where they hold a base span, and of examples made of the written forms below,
whose marked values are personal data that no base rule knows. At most 2 ** N_BITS codes a generator exist, so the table that reaches
the driver has a fixed bound. Scores are made monotone probabilities on a held-out fold, and a threshold for each
generator (precision of at least MIN_PRECISION there) selects the candidates. Selected candidates that are no base span
themselves are added to the base spans; they may overlap them, where they hold more than the base rule found.

Positions are sums over the lengths of matches and of the gaps between them, taken in blocks, and context comes from
the gaps, so that a text with many candidates costs no more a candidate than a short one (but for 1 / CHUNK of it).

The trees never see the base rules' own tests (Luhn, part sizes). Defined results: null text = empty text (no span);
one row for each input row, repeated rows included; an empty table gives no rows; a generator without positives adds
nothing; ties take the smaller bit; other columns are ignored.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textops import cut

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
# The base patterns, written with possessive loops (no backtracking, no deep recursion on long runs).
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Generators (name, pattern).
GENERATORS = {
    "mail_like": r"(?<![^\s<>\x22\x27,;:=])[^\s@(\[<>\x22\x27,;:=]++(?:\x27[^\s@(\[<>\x22\x27,;:=]++)?+(?:@|\x20?[(\[]at[)\]]\x20?)[\w-]++(?:\.[\w-]++)*+",
    "number_like": r"(?<![0-9])(?:\+|\()?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+",
    "dotted_like": r"(?<![0-9.])[0-9]{1,4}+(?:[.:][0-9]{1,5}+){2,7}+",
    "date_like": r"(?<![0-9./-])[0-9]{1,4}+[./-][0-9]{1,2}+[./-][0-9]{1,4}+(?![0-9./-])",
    "account_like": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{2,4}+){3,8}+(?![A-Za-z0-9])",
    "colon_like": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}+(?:[:-][0-9A-Fa-f]{1,4}+){5,7}+(?![0-9A-Fa-f:])",
}
#: Characters of the gap before a candidate that give its context.
CONTEXT = 24
# Words of the context, tested before the span in lower case.
_CUES = (
    r"(phone|tel|call|fax|mobil|appel|handy)", r"(card|visa|credit|iban|konto|account|tarjeta|carte|ssn|social|passport)", r"(mail|contact|@|write|reach)", r"(\bip\b|host|server|addr|port|\bmac\b)",
    r"(born|birth|\bdob\b|n\u00e9e? le|geboren|nacid)", r"(version|release|isbn|order|total|page|section|part|updated|published|build)",
)
N_BITS = 18
#: Matches whose lengths are summed together.
CHUNK = 256
ROUNDS, RATE, MIN_PRECISION = 60, 0.4, 0.9
#: What one written example weighs against one candidate of the table.
WRITTEN_WEIGHT = 2
#: Examples made of each written form; one of so many calibrates and does not train.
EACH, CALIBRATE = 12, 3
# Words before personal data and before other numbers, by kind, in four languages.
CUES = {
    "mail": "write to|please mail|contact|contact:|reach me:|e-mail|mail an|schreib an|kontakt:|contactez|courriel|mail \u00e0|correo|escribe a",
    "phone": "call|tel|tel.|phone:|phone|fax|mobile|handy|mobil:|telefon|anrufen|appelez|t\u00e9l tel|llama al tel|tel\u00e9fono tel",
    "account": "account|konto|credit account|account no|kontonummer|tarjeta|carte", "social": "ssn|social security|ssn:|passport", "iban": "iban|IBAN:|konto|account|iban bitte|IBAN",
    "host": "host|server|ip|addr|server addr|the ip", "mac": "mac|addr|mac addr|mac:", "birth": "born|born on|dob|dob:|date of birth|birth date|geboren am|geboren:|n\u00e9 le|n\u00e9e le|nacido el|nacida el",
    "other": "order|total|page|section|version|release|part|published|updated|build|isbn|it was|in the years|as|at|room|item no|seit|la p\u00e1gina|le total|sobre",
}
# Written forms. What stands between << and >> is personal data. {d:n} stands for n digits, {b} for a number up
# to 255, {D} and {M} for a day and a month, {Y} for a year of birth, {R} for a recent year, {w} for a word, {h:n} for n
# hexadecimal digits, {C:n} for n capitals.
FORMS = """
mail | <<{w}.{w}(at){w}.org>>
mail | <<{w}[at]{w}.{w}.net>>
mail | <<{w} (at) {w}.com>>
mail | <<{w}_{w}(at){w}-{w}.de>>
mail | <<{w}{d:2} [at] {w}.fr>>
mail | <<{w}(at){w}.es>>
mail | <<d'{w}@{w}.com>>
mail | <<o'{w}@{w}.org>>
phone | <<{d:3}-{d:3}-{d:4}>>
phone | <<({d:3}) {d:3}-{d:4}>>
phone | <<({d:3}) {d:3} {d:4}>>
phone | <<{d:3}.{d:3}.{d:4}>>
phone | <<0{d:2} {d:4} {d:4}>>
phone | <<0{d:3} {d:3} {d:4}>>
phone | <<0{d:4} {d:6}>>
phone | <<0{d:1} {d:2} {d:2} {d:2} {d:2}>>
phone | <<0{d:3}-{d:7}>>
phone | <<(0{d:3}) {d:6}>>
phone | <<{d:3} {d:3} {d:3}>>
account | <<{d:4} {d:4} {d:4}>>
account | <<{d:4}-{d:4}-{d:4}>>
account | <<{d:10}>>
social | <<{d:3}-{d:2}-{d:4}>>
social | <<{d:3} {d:2} {d:4}>>
iban | <<DE{d:2} {d:4} {d:4} {d:4} {d:4} {d:2}>>
iban | <<GB{d:2} {C:4} {d:4} {d:4} {d:4} {d:2}>>
iban | <<FR{d:2} {d:4} {d:4} {d:4} {d:4} {d:1}{C:1}{d:2} {d:3}>>
iban | <<ES{d:2} {d:4} {d:4} {d:4} {d:4} {d:4}>>
iban | <<NL{d:2} {C:4} {d:4} {d:4} {d:2}>>
iban | <<AT{d:2} {d:4} {d:4} {d:4} {d:4}>>
host | <<10.{b}.{b}.{b}:{d:4}>>
host | <<192.168.{b}.{b}:{d:3}>>
host | <<172.16.{b}.{b}:{d:5}>>
host | <<2001:0db8:{h:4}:{h:4}:{h:4}:{h:4}:{h:4}:{h:4}>>
host | <<fd{h:2}:{h:4}:{h:4}:{h:4}:{h:4}:{h:4}:{h:4}:{h:4}>>
mac | <<{h:2}:{h:2}:{h:2}:{h:2}:{h:2}:{h:2}>>
mac | <<{h:2}-{h:2}-{h:2}-{h:2}-{h:2}-{h:2}>>
birth | <<{D}/{M}/{Y}>>
birth | <<{Y}-{M}-{D}>>
birth | <<{D}.{M}.{Y}>>
birth | <<{M}/{D}/{Y}>>
other | {w}@{w}
other | look(at){w} and
other | the {w}(at){w} of
other | {d:7} has come
other | {R} {R} {R} and
other | {d:2}.{d:3}.{d:3} units
other | 978-{d:1}-{d:2}-{d:6}-{d:1}
other | 1700000{d:5}
other | 3.{d:8} shows
other | {d:1} {d:1} {d:1} {d:1} {d:1} {d:1} {d:1} {d:1} of
other | {d:1}.{d:2}.{d:1} is out
other | {d:1}.{d:1}.{d:1}.{d:1}.{d:1} says
other | {d:2}:{d:2}:{d:2} sharp
other | {R}.{M}.{D} has
other | {D}/{M}/{R} by
other | {R}-{M}-{D} again
other | {D}.{M}.{R} then
other | {C:2}{d:2} {d:4} {d:4} {d:4} fits
other | {C:2}{d:2} {R} {d:4} {d:4}
other | {d:2}:{d:2}:{d:2}:{d:2}:{d:2}:{d:2} of
other | {d:4} {d:4} pieces
other | {d:3} {d:3} {d:3} rows
other | {d:4}-{d:4}-{d:2}
other | {b}.{d:3}.{d:1}.{d:4}
""".strip().split("\n")
_SLOT = re.compile(r"\{(\w)(?::(\d))?\}")
#: Words after an example.
_TAILS = ("", " today", " please", " and more", " or later", " bitte", " s'il vous", " por favor", ", thanks", ".")
_MARKED = re.compile(r"<<(.*?)>>")
_SPANS = "array<struct<start:int,end:int,value:string,before:string,after:string>>"


def _located(rows: DataFrame, patterns: dict[str, tuple[str, str]]) -> DataFrame:
    """For each name (pattern, test) an array s_<name> of its matches in `t`: start, end, value and the gaps around.

    Each step is a projection of its own, so that no match is made twice."""
    def step(sql: Callable[[str], str], kind: str, mark: str) -> DataFrame:
        return rows.withColumns({f"{mark}_{n}": F.expr(f"CASE WHEN {test if mark == 'h' else f'size(h_{n}) > 0'} THEN {sql(n)} ELSE CAST(array() AS {kind}) END") for n, (_, test) in patterns.items()})

    rows = step(lambda n: f"regexp_extract_all(t, r'{patterns[n][0]}', 0)", "array<string>", "h")
    rows = step(lambda n: f"split(t, r'{patterns[n][0]}', -1)", "array<string>", "g")
    rows = step(lambda n: f"zip_with(h_{n}, slice(g_{n}, 1, size(h_{n})), (h, g) -> length(h) + length(g))", "array<int>", "n")
    running = "aggregate(slice({n}, b * {c} + 1, {c}), CAST(array() AS array<int>), (a, x) -> array_append(a, coalesce(try_element_at(a, -1), 0) + x))"
    # running sums in blocks of CHUNK, so that the work does not grow with the square of their number
    rows = step(lambda n: f"transform(sequence(0, (size(n_{n}) - 1) div {CHUNK}), b -> {running.format(n=f'n_{n}', c=CHUNK)})", "array<array<int>>", "b")
    rows = step(
        lambda n: f"aggregate(b_{n}, struct(0 AS at, CAST(array() AS array<array<int>>) AS parts), (a, p) -> struct(a.at + element_at(p, -1) AS at, "
        "array_append(a.parts, transform(p, x -> x + a.at)) AS parts), a -> flatten(a.parts))", "array<int>", "e",
    )
    rows = step(
        lambda n: f"zip_with(zip_with(h_{n}, e_{n}, (h, e) -> struct(e - length(h) AS start, e AS end, h AS value)), "
        f"zip_with(slice(g_{n}, 1, size(h_{n})), slice(g_{n}, 2, size(h_{n})), (b, a) -> struct(lower(substring(b, -{CONTEXT}, {CONTEXT})) AS before, substring(a, 1, 2) AS after)), "
        "(p, c) -> struct(p.start AS start, p.end AS end, p.value AS value, c.before AS before, c.after AS after))", _SPANS, "s",
    )
    return rows.select(*(c for c in rows.columns if c[:2] not in ("h_", "g_", "n_", "b_", "e_")))


def _valid(kind: str, value: str) -> str:
    """SQL test of a base match."""
    digits = f"regexp_replace({value}, '[^0-9]', '')"
    bare = "ltrim('0', p)"
    return {
        "email": "true", "ip": f"forall(split({value}, '[.]'), p -> length({bare}) < 3 OR length({bare}) = 3 AND {bare} <= '255')",
        "card": f"CASE WHEN length({digits}) BETWEEN 16 AND 19 THEN luhn_check({digits}) ELSE false END", "phone": f"length({digits}) BETWEEN 8 AND 15",
    }[kind]


def _code() -> str:
    """SQL of the format and context features of a candidate `s` as bits of one integer."""
    digits = "length(regexp_replace(s.value, '[^0-9]', ''))"
    bits = [
        f"{digits} >= 8", f"{digits} >= 11", f"{digits} >= 16", "startswith(s.value, '+')", "contains(s.value, '(')", "s.value RLIKE '[ -]'", r"s.value RLIKE r'\..*\.'",
        r"s.value RLIKE r'\.[A-Za-z]{2,}$'", "s.value RLIKE '^[A-Za-z0-9]'", "s.value RLIKE '[:,;]'", *(f"s.before RLIKE r'{c}'" for c in _CUES),
        "s.before RLIKE '[A-Za-z0-9]$'", "s.after RLIKE '^[A-Za-z0-9]'",
    ]
    return " + ".join(f"IF({b}, {1 << i}, 0)" for i, b in enumerate(bits))


def propose(docs: DataFrame) -> DataFrame:
    """(doc_id, fold, base: array of (kind, start, end), candidates: array of (generator, start, end, code, label, own)).

    label: the candidate holds a base span or, where `docs` has a column `truth`, one of its values; own: it is itself
    what a base rule finds. Nothing but the candidate's own text is searched for these."""
    truth = "truth" if "truth" in docs.columns else "CAST(NULL AS array<string>) AS truth"
    rows = docs.selectExpr("doc_id", "coalesce(text, '') AS t", truth)
    digit, mail = "t RLIKE '[0-9]'", "contains(t, '@')"
    tests = {"email": mail, "phone": f"contains(t, '+') AND {digit}", "mail_like": rf"({mail} OR t RLIKE r'[(\[]at[)\]]')"}
    rows = _located(rows, {n: (p, tests.get(n, digit)) for n, p in (BASE | GENERATORS).items()})
    base = [f"transform(filter(s_{k}, s -> {_valid(k, 's.value')}), s -> struct('{k}' AS kind, s.start AS start, s.end AS end))" for k in KINDS]
    inside = ", ".join(f"filter(regexp_extract_all(s.value, r'{p}', 0), v -> {_valid(k, 'v')})" for k, p in BASE.items())
    described = "struct(c.generator, c.start, c.end, c.code, CASE WHEN truth IS NULL THEN size(c.inside) > 0 ELSE exists(truth, v -> contains(c.value, v)) END AS label, array_contains(c.inside, c.value) AS own)"
    found = [f"transform(transform(s_{n}, s -> struct({i} AS generator, s.start AS start, s.end AS end, s.value AS value, {_code()} AS code, concat({inside}) AS inside)), c -> {described})" for i, n in enumerate(GENERATORS)]
    return rows.selectExpr("doc_id", "CAST(pmod(xxhash64(t), 4) AS INT) AS fold", f"concat({', '.join(base)}) AS base", f"concat({', '.join(found)}) AS candidates")


def written_lines(each: int = EACH, seed: int = 3) -> list[tuple[int, str, list[str]]]:
    """(number, text, its personal data): each written form filled `each` times, behind words of its kind."""
    rng, found = random.Random(seed), []
    letters = {"d": "0123456789", "h": "0123456789abcdef", "C": "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}

    def fill(m: re.Match) -> str:
        kind, n = m[1], int(m[2] or 1)
        if kind in letters:
            return "".join(rng.choice(letters[kind]) for _ in range(n))
        if kind == "w":
            return "".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 5)))
        low, high = {"b": (0, 255), "D": (1, 28), "M": (1, 12), "Y": (1940, 2004), "R": (2010, 2026)}[kind]
        return f"{rng.randint(low, high):0{1 if kind == 'b' else 2}d}"

    for i, form in enumerate(FORMS):
        kind, pattern = form.split(" | ")
        for j in range(each):
            line = f"{rng.choice(CUES[kind].split('|'))} {_SLOT.sub(fill, pattern)}{rng.choice(_TAILS)}"
            found.append((i * each + j, _MARKED.sub(r"\1", line), _MARKED.findall(line)))
    return found


def written_examples(spark: SparkSession, each: int = EACH, seed: int = 3) -> DataFrame:
    """The examples as (doc_id: the form's number times `each`, and on, text, truth)."""
    quoted = lambda x: '"' + x + '"'
    lines = [f"({i}, {quoted(text)}, CAST(array({', '.join(map(quoted, truth))}) AS array<string>))" for i, text, truth in written_lines(each, seed)]
    return spark.sql("SELECT * FROM VALUES " + ", ".join(lines) + " AS examples(doc_id, text, truth)")


@dataclass
class Booster:
    """Trees over the bits of (code, generator): (bit, (bit, low, high) if unset, (bit, low, high) if set)."""

    start: float = 0.0
    trees: list[tuple] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=lambda: [math.inf] * len(GENERATORS))

    def raw(self, x: int) -> float:
        total = self.start
        for bit, unset, isset in self.trees:
            b, low, high = isset if x >> bit & 1 else unset
            total += high if x >> b & 1 else low
        return total

    def sql(self, x: str) -> str:
        """The score of a widened code as an SQL expression."""
        leaf = lambda t: f"IF({x} & {1 << t[0]} <> 0, {t[2]!r}D, {t[1]!r}D)"
        return " + ".join([f"{self.start!r}D", *(f"IF({x} & {1 << bit} <> 0, {leaf(isset)}, {leaf(unset)})" for bit, unset, isset in self.trees)])


def widened(code: int, generator: int) -> int:
    """The code with the generator's own bit above the others."""
    return code | 1 << (N_BITS + generator)


def _bits(codes: np.ndarray) -> np.ndarray:
    return (codes[:, None] >> np.arange(N_BITS + len(GENERATORS)) & 1).astype(np.float64)


def fit_booster(counts: list[tuple[int, int, bool, int, float]], rounds: int = ROUNDS) -> Booster:
    """counts: (generator, code, label, fold, n). Fold 0 calibrates, the others train."""
    model = Booster()
    train: dict[int, list[float]] = {}
    for g, code, label, fold, n in counts:
        if fold:
            train.setdefault(widened(code, g), [0.0, 0.0])[bool(label)] += n
    if not train:
        return model
    codes = np.array(sorted(train), np.int64)
    neg, pos = np.array([train[c] for c in codes.tolist()]).T
    model.start = math.log((pos.sum() + 1) / (neg.sum() + 1))
    bits, scores = _bits(codes), np.full(len(codes), model.start)

    def split(part: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple:
        """(bit, value where it is unset, value where it is set) of the greatest gain."""
        g, h = grad[part] @ bits[part], hess[part] @ bits[part]
        other_g, other_h = grad[part].sum() - g, hess[part].sum() - h
        bit = int(np.argmax(g * g / (h + 1) + other_g * other_g / (other_h + 1)))
        return bit, float(RATE * other_g[bit] / (other_h[bit] + 1)), float(RATE * g[bit] / (h[bit] + 1))

    for _ in range(rounds):
        q = 1 / (1 + np.exp(-scores))
        grad, hess = pos - (pos + neg) * q, (pos + neg) * q * (1 - q)
        bit = split(np.ones(len(codes), bool), grad, hess)[0]
        isset = bits[:, bit] > 0
        tree = (bit, split(~isset, grad, hess), split(isset, grad, hess))
        model.trees.append(tree)
        for side, (b, low, high) in ((~isset, tree[1]), (isset, tree[2])):
            scores[side] += np.where(bits[side, b] > 0, high, low)
    for generator in range(len(GENERATORS)):
        held: dict[float, list[float]] = {}
        for g, code, label, fold, n in counts:
            if g == generator and not fold:
                held.setdefault(model.raw(widened(code, g)), [0.0, 0.0])[bool(label)] += n
        blocks: list[list[float]] = []  # pooled adjacent violators: score, negatives, positives, from high to low
        for s, (m, p) in sorted(held.items(), reverse=True):
            blocks.append([s, m, p])
            while len(blocks) > 1 and blocks[-2][2] * (blocks[-1][1] + blocks[-1][2]) < blocks[-1][2] * (blocks[-2][1] + blocks[-2][2]):
                low = blocks.pop()
                blocks[-1] = [low[0], blocks[-1][1] + low[1], blocks[-1][2] + low[2]]
        good = [s for s, m, p in blocks if p >= MIN_PRECISION * (m + p)]
        model.thresholds[generator] = min(good, default=math.inf)
    return model


def _counts(proposed: DataFrame, fold: Column) -> list[tuple]:
    """(generator, code, label, fold, n) of all candidates; a row for each of at most generators * 2 ** N_BITS codes reaches the driver."""
    c = F.col("c")
    number = lambda y, f: F.count_if((c["label"] == y) & (F.col("f") == f))
    rows = proposed.select(fold.cast("int").alias("f"), F.explode("candidates").alias("c")).groupBy(c["generator"].alias("g"), c["code"].alias("code"))
    found = rows.agg(*(number(bool(y), f).alias(f"n{y}{f}") for y in (0, 1) for f in (0, 1))).collect()
    return [(r.g, r.code, bool(y), f, r[f"n{y}{f}"]) for r in found for y in (0, 1) for f in (0, 1) if r[f"n{y}{f}"]]


def fit(proposed: DataFrame) -> Booster:
    counts = _counts(proposed, F.col("fold") > 0)
    written = _counts(propose(written_examples(proposed.sparkSession)), F.col("doc_id") % CALIBRATE > 0)
    return fit_booster(counts + [(*x[:4], WRITTEN_WEIGHT * x[4]) for x in written])


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (arrays of (kind, start, end); base kinds first in their order, then the generators'
    names), n_candidates and n_selected."""
    proposed = cut(propose(docs.select("doc_id", "text")))
    model = fit(proposed)
    limit = " ".join(f"WHEN {i} THEN {min(t, 1e300)!r}D" for i, t in enumerate(model.thresholds))
    score = model.sql(f"(c.code | shiftleft(1, {N_BITS} + c.generator))")
    names = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(GENERATORS))
    selected = proposed.withColumn("selected", F.expr(f"filter(candidates, c -> {score} >= CASE c.generator {limit} END - 1e-9D)"))
    added = F.expr(f"transform(filter(selected, c -> NOT c.own), c -> struct(CASE c.generator {names} END AS kind, c.start AS start, c.end AS end))")
    return selected.select("doc_id", "base", F.concat("base", added).alias("spans"), F.size("candidates").cast("long").alias("n_candidates"), F.size("selected").cast("long").alias("n_selected"))


def digest_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    found = detect(docs)

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(digest_text(F.col("base")), 256).alias("base_sha256"), digest_text(F.col("spans")).alias("spans"), "n_candidates", "n_selected")
