"""N-gram Jaccard join with several global token orders.

A document is the set of its distinct word shingles (64-bit hashes). Texts with equal sets form a class; that members of
a class have equal sets is proved by a second key of 64 bits. Under any
global order, two sets with a Jaccard similarity of at least t share a token among the first |A| - ceil(t |A|) + 1 of
each; ORDERS such orders are used, all with the frequent shingles (found by a sketch over all documents) last, so that
common lines and passages hardly ever stand in a prefix. The first order proposes pairs: of a token's classes only those
that another one of them fits in size go on, tokens with the same classes become one with their number as weight, and a
pair must share SHARED tokens (fewer where the threshold asks for fewer) among so many more than a pair's prefixes need
to share one. A pair goes on only if under
EVERY order the two prefixes share a token and their known parts differ in no more tokens than the threshold allows;
then the whole sets are compared. These filters are exact: no link is lost.

Groups of near copies are not expanded into pairs. First each class is compared with the class of smallest doc_id with
which it shares most prefix tokens; components of the links found are joined; after some such rounds, whether or not
they found anything, all pairs that share enough prefix tokens and lie in different components are compared. Result: one row
for each document with its class and component. The windows and the join by a prefix token hold all classes of the token
in one task; prefix tokens are rare ones, but for those of a large group of near copies.

Defined results: null, empty and blank texts have an empty set and link with nothing, not even with each other (each is
its own component); repeated rows give one row each; a null doc_id never names a component that has another id; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from .components import components
from .textops import cut, lower_ascii, mix, shingle_hashes, slices, unused, word_hashes

NGRAM, PERCENT, ORDERS = 3, 90, 3
#: The frequency sketch keeps at most so many shingles; they only shape the order.
FREQUENT = 400_000
#: Shingles that a task has met so often are reported to the sketch, and those of at least so many documents kept.
LOCAL_COUNT, LEAST_DOCUMENTS = 3, 6
#: A task's counter is thinned beyond so many distinct shingles.
COUNTER = 1_500_000
#: Rounds with one partner a class before all remaining pairs are compared.
STAR_ROUNDS = 2
#: Prefix tokens that a pair must share to be compared, where its sizes allow.
SHARED = 3
#: Classes to verify are broadcast (two numbers each) up to so many rows, and joined by a shuffle of the texts beyond.
BROADCAST_ROWS = 100_000
#: The second key of a class is a key of the seed that lies so far on.
PROOF = 1_000
_TOP = np.uint64(1 << 63)


def shingle_set(text: str | None, ngram: int) -> np.ndarray:
    found = np.sort(shingle_hashes(word_hashes(lower_ascii(text)), ngram))
    return found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) else found


def frequent_shingles(docs: DataFrame, ngram: int, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles of many documents and their (lower bounds of) document counts, at most `most`."""
    schema = pa.schema([("token", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        met: set[int] = set()
        waiting: list[np.ndarray] = []

        def fold() -> None:
            """Merge what waits into the counter; only the new part is sorted."""
            nonlocal tokens, counts
            if not waiting:
                return
            fresh, n = np.unique(np.concatenate(waiting), return_counts=True)
            waiting.clear()
            at = np.searchsorted(tokens, fresh)
            known = np.zeros(len(fresh), bool)
            known[at < len(tokens)] = tokens[at[at < len(tokens)]] == fresh[at < len(tokens)]
            counts[at[known]] += n[known].astype(np.int32)
            counts = np.insert(counts, at[~known], n[~known].astype(np.int32))
            tokens = np.insert(tokens, at[~known], fresh[~known])
            least = 1
            while len(tokens) > COUNTER:
                least += 1
                tokens, counts = tokens[counts >= least], counts[counts >= least]

        size = 0
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                found = shingle_set(text, ngram)
                cls = class_key(found)
                if cls in met or len(found) == 0:
                    continue  # a copy of a text of this task proposes no pairs
                if len(met) > 1_000_000:
                    met.clear()
                met.add(cls)
                waiting.append(found)
                size += len(found)
                if size > 500_000:
                    fold()
                    size = 0
        fold()
        often = counts >= LOCAL_COUNT
        yield pa.RecordBatch.from_arrays([pa.array(tokens[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], schema=schema)

    found = docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = found.filter(F.col("n") >= LEAST_DOCUMENTS).orderBy(F.desc("n"), "token").limit(most).toArrow()
    tokens = top.column("token").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], top.column("n").to_numpy()[order]


def frequent_among(tokens: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the frequent tokens and their counts as 31-bit numbers."""
    known, counts = frequent
    if not len(known):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
    often = np.flatnonzero(known[at] == tokens)
    return often, np.minimum(counts[at[often]], (1 << 30) - 1).astype(np.uint64)


def ranks(tokens: np.ndarray, order: int, often: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Place of each token in a global order, as sortable 64-bit numbers: rare ones by hash, frequent ones by count."""
    mixed = mix(tokens, order + 1)
    out = mixed >> np.uint64(1)
    if len(often):
        out[often] = _TOP | counts << np.uint64(32) | mixed[often] >> np.uint64(32)
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    """Unsigned order kept in signed numbers."""
    return (x ^ _TOP).view(np.int64)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def signatures(docs: DataFrame, ngram: int, percent: int, frequent: tuple[np.ndarray, np.ndarray], orders: int = ORDERS, seed: int = 0) -> DataFrame:
    """(doc_id, n, cls, proof, p0..): set size, class key, a second key and prefixes; a task gives the prefixes of a class
    once."""
    fields = [("doc_id", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("proof", pa.int64())]
    schema = pa.schema([*fields, *[(f"p{k}", pa.list_(pa.int64())) for k in range(orders)]])
    shared = docs.sparkSession.sparkContext.broadcast(frequent)  # at most FREQUENT pairs of numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = set()
        for batch in slices(batches):
            cols: list[list] = [[] for _ in schema]
            for text in batch.column(1).to_pylist():
                tokens = shingle_set(text, ngram)
                n = len(tokens)
                cls = class_key(tokens, seed)
                cols[1].append(n)
                cols[2].append(cls)
                cols[3].append(class_key(tokens, seed + PROOF))
                fresh = n > 0 and cls not in met
                if fresh:
                    if len(met) > 1_000_000:
                        met.clear()
                    met.add(cls)
                    common = frequent_among(tokens, shared.value)
                length = prefix_length(n, percent)
                for k in range(orders):
                    if fresh:
                        r = ranks(tokens, k, *common)
                        cols[4 + k].append(np.sort(_signed(np.partition(r, length - 1)[:length] if length < n else r)))
                    else:
                        cols[4 + k].append(None)
            arrays = [batch.column(0), *(pa.array(c, f.type) for c, f in zip(cols[1:], list(schema)[1:], strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    ddl = "doc_id long, n long, cls long, proof long, " + ", ".join(f"p{k} array<long>" for k in range(orders))
    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(run, ddl)


def class_key(tokens: np.ndarray, seed: int = 0) -> int:
    """A 64-bit key of a set; each seed gives other keys."""
    if not len(tokens):
        return 0
    a, b = np.bitwise_xor.reduce(mix(tokens, 101 + 10 * seed)), np.add.reduce(mix(tokens, 102 + 10 * seed))
    return int(mix(np.array([a ^ mix(b[None] + np.uint64(len(tokens)), 103)[0]], np.uint64), 104).view(np.int64)[0])


def _near(pairs: DataFrame, sets: DataFrame, percent: int, orders: int, few: bool) -> DataFrame:
    """Pairs (a, b) that pass the prefix filters of all orders; only the prefixes of their own classes are moved. `few`: there
    are no more classes than may be broadcast."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    wanted = wanted if few else cut(wanted)
    small = few or wanted.count() <= BROADCAST_ROWS
    sets = sets.join(F.broadcast(wanted) if small else wanted, "cls", "left_semi").dropDuplicates(["cls"])
    side = lambda s: sets.select(F.col("cls").alias(s), F.col("n").alias(f"n{s}"), *(F.col(f"p{k}").alias(f"{s}{k}") for k in range(orders)))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    na, nb = F.col("na"), F.col("nb")
    spare = na + nb - 2 * _overlap(na, nb, percent)
    keep = (100 * F.least(na, nb) >= percent * F.greatest(na, nb))
    for k in range(orders):
        a, b = F.col(f"a{k}"), F.col(f"b{k}")
        last = F.least(F.element_at(a, -1), F.element_at(b, -1))
        common = F.size(F.array_intersect(a, b))
        inside = lambda c, last=last: F.size(F.filter(c, lambda x: x <= last))
        keep = keep & (common > 0) & (inside(a) + inside(b) - 2 * common <= spare)
    return both.filter(keep).select("a", "b")


def _verified(pairs: DataFrame, docs: DataFrame, members: DataFrame, ngram: int, percent: int, seed: int) -> DataFrame:
    """Pairs whose whole sets reach the threshold; the sets are made again from the texts of the classes in question."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(members, "cls").select("cls", F.col("first_doc").alias("doc_id"))
    schema = pa.schema([("cls", pa.int64()), ("tokens", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, sets = [], []
            for cls, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = shingle_set(text, ngram)
                key = class_key(tokens, seed)
                if cls is None or key == cls:
                    keys.append(key)
                    sets.append(tokens.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, schema.field("tokens").type)], schema=schema)

    wanted = cut(wanted)
    n, no_id = wanted.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    texts = docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text")
    small = n <= BROADCAST_ROWS
    known = texts.join(F.broadcast(wanted) if small else wanted.hint("shuffle_hash"), "doc_id").select("cls", "text")
    nameless = texts.filter("doc_id IS NULL").selectExpr("CAST(NULL AS LONG) AS cls", "text")  # found by their class only
    made = [x.mapInArrow(run, "cls long, tokens array<long>") for x in (known, nameless)]
    every = made[0].union(made[1].join(wanted.select("cls"), "cls", "left_semi")) if no_id else made[0]
    sets = every.dropDuplicates(["cls"])
    side = lambda s: sets.select(F.col("cls").alias(s), F.col("tokens").alias(f"t{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("ta", "tb"))
    return both.filter(100 * common >= percent * (F.size("ta") + F.size("tb") - common)).select("a", "b")


def class_components(docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT, orders: int = ORDERS) -> tuple[DataFrame, DataFrame, int]:
    """(doc_id, n, cls) of every document, (cls, first_doc, copies, comp) of every class with words, and the keys' seed.

    Documents of a class must agree in a second key of 64 bits as well; if any do not, all keys are made anew."""
    frequent, seed = frequent_shingles(docs, ngram), 0
    while True:
        sets = cut(signatures(docs, ngram, percent, frequent, orders, seed))
        kept = sets.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"), F.min("proof").alias("least"), F.max("proof").alias("most"))
        members = cut(kept.select("cls", "first_doc", "copies", (F.col("least") != F.col("most")).alias("mixed")))
        n_classes, mixed = members.agg(F.count("*"), F.max("mixed")).first()
        if not mixed:
            break
        seed += 1
    members = members.drop("mixed")
    chosen = sets.filter("p0 IS NOT NULL").select("cls", "n", *(f"p{k}" for k in range(orders)))
    shared = cut(_shared(sets.filter("p0 IS NOT NULL").select("cls", "n", "doc_id", F.posexplode("p0").alias("pos", "token")), percent))

    edges, labels, tested = None, None, None
    for turn in range(STAR_ROUNDS + 1):
        if labels is None:  # no link yet: each class is its own component
            at = shared.withColumn("label", F.col("cls"))
        else:
            at = shared.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
            members_of = Window.partitionBy("token")
            at = at.withColumn("low", F.min("label").over(members_of)).withColumn("high", F.max("label").over(members_of)).filter("low <> high").drop("low", "high")
        pairs = _star_pairs(at, turn, percent) if turn < STAR_ROUNDS else _all_pairs(at, percent)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = cut(pairs)
        if not pairs.take(1):
            continue  # a round without a new partner says nothing about the pairs of the last round
        tested = pairs if tested is None else tested.union(pairs)
        found = cut(_verified(cut(_near(pairs, chosen, percent, orders, n_classes <= BROADCAST_ROWS)), docs, members, ngram, percent, seed).select(F.col("a").alias("u"), F.col("b").alias("v")))
        edges = found if edges is None else cut(edges.union(found))
        labels = components(edges)
    known = members.withColumn("comp", F.col("cls"))
    if labels is not None:
        known = members.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("label", "cls")).drop("label")
    return sets.select("doc_id", "n", "cls"), known, seed


def link_components(docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT, orders: int = ORDERS) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) of every document."""
    return _named(*class_components(docs, ngram, percent, orders)[:2])


def _fits(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _overlap(na: Column, nb: Column, percent: int) -> Column:
    """The least number of tokens that two linked sets have in common."""
    return F.ceil(F.lit(percent) * (na + nb) / F.lit(100 + percent))


def _least_shared(na: Column, nb: Column, percent: int) -> Column:
    """The least number of tokens that the prefixes of two linked sets have in common, of one order.

    The set whose prefix ends first has all but n - prefix_length(n) of the common tokens in it, and they stand in the other
    prefix too."""
    return _overlap(na, nb, percent) + 1 - F.ceil(F.lit(percent) * F.greatest(na, nb) / F.lit(100))


def _shared(rows: DataFrame, percent: int) -> DataFrame:
    """(token, pos, cls, n, doc_id, weight): the classes of a token that another one of them fits in size; tokens with the same
    such classes become one, the first of them in the order, with their count as weight.

    By size the neighbours of a class fit it if any other does. Two classes that fit stay under every token that they
    share, so that their weights add up to the number of these."""
    by_size = Window.partitionBy("token").orderBy("n", "cls", "doc_id")
    near = rows.select("*", *(f("cls").over(by_size).alias(f"{s}_cls") for f, s in ((F.lag, "less"), (F.lead, "more"))), *(f("n").over(by_size).alias(f"{s}_n") for f, s in ((F.lag, "less"), (F.lead, "more"))))
    fits = [F.coalesce((F.col(f"{s}_cls") != F.col("cls")) & _fits(F.col(f"{s}_n"), F.col("n"), percent), F.lit(False)) for s in ("less", "more")]
    once = near.filter(fits[0] | fits[1]).groupBy("token", "pos", "cls", "n").agg(F.min("doc_id").alias("doc_id"))
    members = Window.partitionBy("token")
    alike = once.select("*", F.count("*").over(members).alias("k"), F.bit_xor(F.xxhash64("cls")).over(members).alias("x"), F.bit_xor(F.xxhash64("cls", F.lit(1))).over(members).alias("y"))
    return alike.groupBy("k", "x", "y", "cls", "n").agg(F.min("token").alias("token"), F.min("pos").alias("pos"), F.min("doc_id").alias("doc_id"), F.count("*").alias("weight")).drop("k", "x", "y")


def _star_pairs(rows: DataFrame, turn: int, percent: int) -> DataFrame:
    """One partner for each class: of the leaders of its tokens, the one met most often, if they share half of the tokens that
    linked classes do; some tokens of a pair may have another leader.

    Leaders are the member of smallest doc_id in the first turn and of largest doc_id after it."""
    order = [F.col("doc_id").asc() if turn % 2 == 0 else F.col("doc_id").desc(), F.col("cls").asc()]
    w = Window.partitionBy("token").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    led = rows.withColumn("lead", F.first(F.struct("cls", "n", "label")).over(w))
    led = led.filter((F.col("lead.label") != F.col("label")) & _fits(F.col("lead.n"), F.col("n"), percent))
    counted = led.groupBy("cls", "n", F.col("lead.cls").alias("other"), F.col("lead.n").alias("m")).agg(F.sum("weight").alias("n_shared"))
    counted = counted.filter(2 * F.col("n_shared") >= _least_shared(F.col("n"), F.col("m"), percent))
    best = counted.groupBy("cls").agg(F.max_by("other", F.struct("n_shared", "other")).alias("other"))
    return best.select(F.least("cls", "other").alias("a"), F.greatest("cls", "other").alias("b")).distinct()


def _all_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """All pairs of different components that fit in size and share enough tokens among the first of both.

    Of linked sets the first n - overlap + k tokens share k at least, for each k that keeps them inside the prefixes. Tokens
    of equal members count in full if the first of them lies there, so that no pair counts too little."""
    one = lambda s, *more: rows.select("token", F.col("cls").alias(s), F.col("n").alias(f"n{s}"), F.col("pos").alias(f"i{s}"), F.col("label").alias(f"l{s}"), *more)
    na, nb = F.col("na"), F.col("nb")
    least = F.least(F.lit(SHARED), _least_shared(na, nb, percent))
    apart = (F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & _fits(na, nb, percent)
    early = F.least(na - F.col("ia"), nb - F.col("ib")) > _overlap(na, nb, percent) - least
    counted = one("a", "weight").join(one("b"), "token").filter(apart & early).groupBy("a", "b", "na", "nb").agg(F.sum("weight").alias("n_shared"))
    return counted.filter(F.col("n_shared") >= least).select("a", "b")


def _named(sets: DataFrame, known: DataFrame) -> DataFrame:
    """Smallest doc_id of each component, brought back to the documents."""
    names = cut(known.groupBy("comp").agg(F.min("first_doc").alias("component_id"), F.sum("copies").alias("size")).filter("size > 1"))
    named = known.join(names, "comp").select("cls", F.col("first_doc").alias("class_doc"), "component_id")
    out = sets.join(named, "cls", "left")
    alone = F.col("n") == 0
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.coalesce("class_doc", "doc_id")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT, orders: int = ORDERS) -> DataFrame:
    """The rows of `docs` with one row of each component: that of the smallest doc_id (null ids last), then of the smallest
    class key; of rows that are equal in both, one with the smallest text. Rows without words all stay.

    Every row's fate follows from its own text: another text under the same doc_id is not touched."""
    sets, known, seed = class_components(docs, ngram, percent, orders)
    sizes = known.groupBy("comp").agg(F.sum("copies").alias("size")).filter("size > 1")
    grouped = cut(known.join(sizes, "comp").select("cls", "comp"))  # classes that do not stand alone
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "cls")
    rows = sets.filter("n > 0").join(grouped, "cls")
    same = cut(rows.groupBy("comp", "doc_id", "cls").agg(F.count("*").alias("n")).withColumn("rank", rank))
    first = same.groupBy("comp").agg(F.min("rank").alias("first"))
    winners = cut(same.join(first, "comp").filter(F.col("rank") == F.col("first")).select("comp", F.col("doc_id").alias("win_doc"), F.col("cls").alias("win_cls"), (F.col("n") > 1).alias("repeated")))

    mark = unused("_join_", docs.columns)
    keyed = with_class(docs.withColumn(mark + "id", F.col("doc_id").cast("long")), ngram, mark + "cls", seed)
    fate = cut(grouped.join(winners, "comp").select(*(F.col(c).alias(mark + c) for c in ("cls", "comp", "win_doc", "win_cls", "repeated"))))
    small = fate.count() <= BROADCAST_ROWS  # five numbers a row
    judged = keyed.join(F.broadcast(fate) if small else fate, mark + "cls", "left")
    is_first = F.col(mark + "id").eqNullSafe(F.col(mark + "win_doc")) & (F.col(mark + "cls") == F.col(mark + "win_cls"))
    stays, twice = F.col(mark + "comp").isNull() | is_first, F.coalesce(F.col(mark + "repeated"), F.lit(False))
    kept = judged.filter(stays & ~twice).select(*docs.columns)
    if not winners.filter("repeated").take(1):
        return kept
    again = judged.filter(stays & twice).groupBy(mark + "comp").agg(F.min_by(F.struct(*docs.columns), F.struct("text", F.to_json(F.struct(*docs.columns)))).alias("r"))
    return kept.unionByName(again.select("r.*"))


def with_class(docs: DataFrame, ngram: int, name: str, seed: int) -> DataFrame:
    """The rows with the class key of their text (0 without words)."""
    schema = to_arrow_schema(docs.schema).append(pa.field(name, pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            keys = pa.array([class_key(shingle_set(t, ngram), seed) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], schema=schema)

    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{name}` long"]))
